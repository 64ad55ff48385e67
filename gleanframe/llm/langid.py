"""Language identification: a linear-chain conditional random field labels each word of a text.

Features of a word: its character n-grams with border marks (those at a border are affixes) and
the word itself (the lexicon); transitions between the labels of neighbouring words are learned as
well, on texts joined from pieces of several languages. Forward-backward gives each word's label
probabilities in the whole text; the document's language is that of most probability mass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, slices, text_slices
from .shingles import U, mix

FEATURE_BITS, GRAMS = 18, (2, 3, 4)
#: Documents of each language, and bytes of their texts, at most, that the model is fitted on; and its rounds.
FIT_DOCUMENTS, FIT_BYTES, FIT_ROUNDS, SEQUENCE, PIECE_WORDS = 150, 1 << 20, 30, 128, 25
#: Bytes of text that are labelled at once, and words in a block of the chain.
CHUNK, BLOCK = 384 << 10, 128
IS_WORD = np.array([chr(b).isascii() and chr(b).isalpha() or b >= 128 for b in range(256)])
WORD_CHARACTER = re.compile(r"[^\W\d_]")
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=U)


def has_letters(text: str | None) -> bool:
    """Whether a character is a letter; numbers in other forms (½, ², Ⅷ, ①) aren't."""
    return any(m[0].isalpha() for m in WORD_CHARACTER.finditer(text or ""))


def word_spans(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts between border bytes, where each begins, first and last byte of each word, and where each text's words begin (one more at the end)."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    inner = IS_WORD[data]
    first = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    last = np.flatnonzero(inner[:-1] & ~inner[1:])
    return data, starts, first, last, np.searchsorted(first, starts)


def word_features(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words in a row, where each word's begin, and where each text's words begin (one more at the end).

    Every word stands between two border bytes, so n-grams are runs of bytes within one word.
    """
    data, _, first, last, of_text = word_spans(texts)
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), of_text
    length = last - first + 3  # with both borders
    begin = np.concatenate([[0], np.cumsum(length)])
    offset = np.arange(begin[-1]) - np.repeat(begin[:-1], length)
    source = np.repeat(first - 1, length) + offset
    edge = (offset == 0) | (offset == np.repeat(length, length) - 1)
    letters = np.where(edge, U(1), data[source].astype(U) + U(2))
    left = np.repeat(length, length) - offset  # how many bytes of the word are left
    h = letters * PRIMES[0]
    parts, keep = [], []
    for n in range(2, max(GRAMS) + 1):
        shifted = np.zeros_like(h)
        shifted[: len(h) - n + 1] = letters[n - 1 :]
        h = (h ^ (shifted + U(n))) * PRIMES[n % 4]
        if n in GRAMS:
            parts.append(h >> U(64 - FEATURE_BITS + 1))
            keep.append(left >= n)
    whole = np.add.reduceat(letters * mix(offset.astype(U) + U(77)), begin[:-1])
    counts = np.sum([np.add.reduceat(k, begin[:-1], dtype=np.int64) for k in keep], axis=0) + 1
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(at[-1], dtype=np.int64)
    out[at[:-1]] = (mix(whole) >> U(64 - FEATURE_BITS + 1)).astype(np.int64) + (1 << (FEATURE_BITS - 1))
    mask = np.stack(keep, axis=1)
    values = np.stack(parts, axis=1)[mask].astype(np.int64)
    holes = np.ones(at[-1], dtype=bool)
    holes[at[:-1]] = False
    out[holes] = values
    return out, at[:-1], of_text


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # languages x languages, log

    def emissions(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), len(self.languages)), dtype=np.float32)
        for words, mine, begin, count in word_blocks(features, at):
            for i in range(len(self.languages)):
                out[words, i] = np.add.reduceat(self.weights[:, i][mine], begin) / np.sqrt(count)
        return out


def word_blocks(features: np.ndarray, at: np.ndarray, step: int = 1 << 15) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Words in blocks, so that what is computed for each feature stays small: the words, their features, where each word's begin in these, and how many it has."""
    ends = np.append(at, len(features))
    for lo in range(0, len(at), step):
        hi = min(lo + step, len(at))
        yield slice(lo, hi), features[ends[lo] : ends[hi]], ends[lo:hi] - ends[lo], np.diff(ends[lo : hi + 1]).astype(np.float32)


def all_features(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_features`` of many texts, computed in slices of CHUNK bytes."""
    parts = [word_features(texts[lo:hi]) for lo, hi in slices(map(len, texts), CHUNK)] or [word_features([])]
    shift = np.cumsum([0, *(len(f) for f, _, _ in parts)])
    words = np.cumsum([0, *(len(a) for _, a, _ in parts)])
    at = np.concatenate([a + n for (_, a, _), n in zip(parts, shift, strict=False)])
    of_text = np.concatenate([*(o[:-1] + n for (_, _, o), n in zip(parts, words, strict=False)), words[-1:]])
    return np.concatenate([f.astype(np.int32) for f, _, _ in parts]), at, of_text


def chain_messages(scores: np.ndarray, begins: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Emissions and transitions as factors, and the messages forward (with the word's emission) and backward (without) at every word, each scaled; ``begins`` marks the words that begin a text.

    A text's beginning forgets what stands before it, so all texts form one chain. The chain is cut
    into blocks whose transfer matrices are multiplied side by side; a pass over the blocks then
    gives each block the exact message it begins with, both ways.
    """
    n, labels = scores.shape
    if not n:
        return scores, np.exp(transitions), scores, scores
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    t = np.exp(transitions - transitions.max()).astype(np.float64)
    blocks = -(-n // block)
    pad = blocks * block - n
    e = np.concatenate([e, np.ones((pad, labels))]).reshape(blocks, block, labels)
    new = np.concatenate([begins, np.ones(pad, dtype=bool)]).reshape(blocks, block)

    def onward(v: np.ndarray, k: int) -> np.ndarray:
        """v (blocks, rows, labels) moved over the transition into word k of each block."""
        moved = v @ t
        fresh = new[:, k]
        moved[fresh] = v[fresh].sum(axis=-1, keepdims=True)
        return moved

    through = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for k in range(block):
        through = onward(through, k) * e[:, k, None, :]
        if k % 8 == 7:
            through /= through.max(axis=(1, 2), keepdims=True)
    come = np.empty((blocks, 1, labels))
    v = np.full((1, labels), 1 / labels)
    for b in range(blocks):
        come[b] = v
        v = v @ through[b]
        v /= v.sum()
    back = np.empty((blocks, labels))
    w = np.ones(labels)
    for b in range(blocks - 1, -1, -1):
        back[b] = w
        w = through[b] @ w
        w /= w.sum()
    forward = np.empty((blocks, block, labels))
    v = come
    for k in range(block):
        v = onward(v, k) * e[:, k, None, :]
        v /= v.sum(axis=-1, keepdims=True)
        forward[:, k] = v[:, 0]
    backward = np.empty_like(forward)
    w = back
    for k in range(block - 1, -1, -1):
        backward[:, k] = w
        x = w * e[:, k]
        w = x @ t.T
        fresh = new[:, k]
        w[fresh] = x[fresh].sum(axis=1, keepdims=True)
        w /= w.sum(axis=1, keepdims=True)
    whole = lambda x: x.reshape(-1, labels)[:n]
    return whole(e), t, whole(forward), whole(backward)


def chain_marginals(scores: np.ndarray, begins: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Label probabilities of every word by forward-backward."""
    _, _, forward, backward = chain_messages(scores, begins, transitions, block)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


def expected_transitions(messages: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], begins: np.ndarray) -> np.ndarray:
    """How often each label is expected to follow each: sums of the pair marginals forward * transition * emission * backward."""
    e, t, forward, backward = messages
    inner = ~begins[1:]
    before, after = forward[:-1][inner], (e * backward)[1:][inner]
    total = ((before @ t) * after).sum(axis=1, keepdims=True)
    return t * ((before / total).T @ after)


def mixed_sequences(words: list[np.ndarray], labels: list[int], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sequences (rows of SEQUENCE words) joined from pieces of texts in random order, and the words' labels."""
    pieces = []
    for w, label in zip(words, labels, strict=True):
        at = 0
        while at < len(w):
            n = 1 + int(rng.geometric(1 / PIECE_WORDS))
            pieces.append((w[at : at + n], label))
            at += n
    if not pieces:
        return np.zeros((0, SEQUENCE), dtype=np.int64), np.zeros((0, SEQUENCE), dtype=np.int64)
    # Runs of the same text stay together now and then, as most texts have one language.
    order = np.argsort(rng.random(len(pieces)) + np.arange(len(pieces)) / len(pieces) * rng.integers(0, 3))
    x = np.concatenate([pieces[i][0] for i in order])
    y = np.concatenate([np.full(len(pieces[i][0]), pieces[i][1]) for i in order])
    short = -len(x) % SEQUENCE
    return np.concatenate([x, x[:short] if short <= len(x) else np.resize(x, short)]).reshape(-1, SEQUENCE), np.concatenate([y, y[:short] if short <= len(y) else np.resize(y, short)]).reshape(-1, SEQUENCE)


def fit(texts: list[str], langs: list[str], rounds: int = FIT_ROUNDS, seed: int = 3) -> Model:
    """Fits weights and transitions by maximum likelihood (Adam on the whole sample, light L2)."""
    languages = sorted(set(langs))
    n_labels = len(languages)
    features, at, of_text = all_features([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    model = Model(languages, np.zeros((1 << FEATURE_BITS, n_labels), dtype=np.float32), np.zeros((n_labels, n_labels), dtype=np.float32))
    if n_labels < 2 or not len(at):
        return model
    words = [np.arange(a, b) for a, b in zip(of_text, of_text[1:], strict=False)]
    x, y = mixed_sequences(words, [languages.index(g) for g in langs], np.random.default_rng(seed))
    scale = 1 / np.sqrt(np.diff(np.append(at, len(features))))
    begins = np.zeros(x.shape, dtype=bool)
    begins[:, 0] = True
    target = np.eye(n_labels)[y.ravel()]
    pairs = np.zeros((n_labels, n_labels))
    np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    m, v = [np.zeros_like(model.weights), np.zeros_like(model.transitions)], [np.zeros_like(model.weights), np.zeros_like(model.transitions)]
    for step in range(1, rounds + 1):
        scores = model.emissions(features, at)[x.ravel()]
        messages = chain_messages(scores, begins.ravel(), model.transitions, SEQUENCE)
        gamma = messages[2] * messages[3]
        gamma /= gamma.sum(axis=1, keepdims=True)
        error = np.zeros((len(at), n_labels))
        for i in range(n_labels):
            error[:, i] = np.bincount(x.ravel(), (target - gamma)[:, i], len(at)) * scale
        grad = np.zeros((1 << FEATURE_BITS, n_labels))
        for block, mine, _, count in word_blocks(features, at):
            for i in range(n_labels):
                grad[:, i] += np.bincount(mine, np.repeat(error[block, i], count.astype(np.int64)), 1 << FEATURE_BITS)
        expect = expected_transitions(messages, begins.ravel())
        for k, (p, g) in enumerate(((model.weights, grad / len(at) * 100 - 1e-4 * model.weights), (model.transitions, (pairs - expect) / len(at)))):
            m[k] = 0.8 * m[k] + 0.2 * g
            v[k] = 0.95 * v[k] + 0.05 * g * g
            p += (0.3 * (m[k] / (1 - 0.8**step)) / (np.sqrt(v[k] / (1 - 0.95**step)) + 1e-5)).astype(np.float32)
    return model


def labelled(model: Model, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of all words in a row, and where each text's words begin (one more at the end)."""
    features, at, of_text = word_features(texts)
    begins = np.zeros(len(at), dtype=bool)
    begins[of_text[:-1][of_text[1:] > of_text[:-1]]] = True
    return chain_marginals(model.emissions(features, at), begins, model.transitions), of_text


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """The language of each whole text and the share of its words' probability; ``und`` without letters."""
    if not model.languages:
        return [("und", 0.0)] * len(texts)
    gamma, of_text = labelled(model, [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])
    out: list[tuple[str, float]] = []
    sums = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(gamma, axis=0)])
    for i, text in enumerate(texts):
        a, b = of_text[i], of_text[i + 1]
        if a == b or not has_letters(text):
            out.append(("und", 0.0))
            continue
        share = (sums[b] - sums[a]) / (b - a)
        best = int(share.argmax())
        out.append((model.languages[best], float(min(1.0, max(0.0, share[best])))))
    return out


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the text's runs of words in one language, in order: array of (lang, words, text, score).

    ``text`` goes from the run's first word to its last, in lower case; ``score`` is the mean
    probability of the label. Null text, and text without letters, has no runs.
    """

    def runs(raw: list[bytes], texts: list[str | None]) -> Iterator[list[dict]]:
        data, _, first, last, of_text = word_spans(raw)
        gamma = labelled(model, raw)[0]
        label = gamma.argmax(axis=1)
        whole = data.tobytes()
        for i, text in enumerate(texts):
            a, b = int(of_text[i]), int(of_text[i + 1])
            cuts = [a, *(np.flatnonzero(label[a + 1 : b] != label[a : b - 1]) + a + 1).tolist(), b] if a < b and has_letters(text) else []
            yield [{"lang": model.languages[label[x]], "words": y - x, "text": whole[first[x] : last[y - 1] + 1].decode("utf-8", "replace"), "score": float(gamma[x:y, label[x]].mean())} for x, y in zip(cuts, cuts[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("text", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in text_slices(texts, CHUNK):
                raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
                out = list(runs(raw, texts[lo:hi])) if model.languages else [[]] * (hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, kind)], ["doc_id", "runs"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, runs array<struct<lang:string,words:long,text:string,score:double>>")


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_on(docs: DataFrame, per_language: int = FIT_DOCUMENTS, bytes_per_language: int = FIT_BYTES) -> Model:
    """Fits on labelled documents of each language, whole, those whose ids hash lowest: at most ``per_language`` and ``bytes_per_language``.

    Only rows that aren't held out count. Rows without id, text or language teach nothing; of rows
    that share id and language one does. A document that alone is over the bound teaches nothing.
    """
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(~held_out())
    known = known.select("*", F.xxhash64("text").alias("t"), F.octet_length("text").alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)).alias("place")).where(F.col("size") <= bytes_per_language)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((1 << FEATURE_BITS, 0), dtype=np.float32), np.zeros((0, 0), dtype=np.float32))
    share = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(min(1.0, 1.5 * per_language / n + 20 / n)))])
    # Rows of one id and language are one here, so there are about 1.5 times as many keys as documents wanted.
    near = known.where(F.col("place") < share[F.col("lang")] * 1_000_003).groupBy("lang", "place", "doc_id").agg(F.min(F.struct("t", "size")).alias("x"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    keys = near.select("lang", "place", "doc_id", "x.*").withColumn("no", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order))
    chosen = [(r.lang, r.doc_id, r.t) for r in keys.where((F.col("no") <= per_language) & (F.col("upto") <= bytes_per_language)).select("lang", "doc_id", "t").collect()]
    if not chosen:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, doc_id long, t long")
    # As many rows as there are documents to fit on: bounded by the parameter.
    rows = known.join(F.broadcast(wanted), ["lang", "doc_id", "t"]).groupBy("lang", "doc_id", "t", "place").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["lang"], r["place"], r["doc_id"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; reads doc_id and text alone, texts of any length whole.

    ``lang_pred`` is ``und`` with score 0 for null text and text without letters. Rows of equal
    doc_id are labelled each on its own; a null doc_id counts as not held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            got = [x for lo, hi in text_slices(texts, CHUNK) for x in predict(model, texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known; those labelled ``und`` go."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = [g != "und" for lo, hi in text_slices(texts, CHUNK) for g, _ in predict(model, texts[lo:hi])]
            yield batch.filter(pa.array(keep, pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
