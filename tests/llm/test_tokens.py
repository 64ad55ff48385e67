from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gleanframe.llm import encoding
from gleanframe.llm.common import Scratch
from gleanframe.llm.encoding import PieceEncoder
from gleanframe.llm.packing import hilbert_key, pack
from gleanframe.llm.token_files import as_ids, read_document, read_tokens, token_digest, write_tokens

from .odd import odd_documents

BYTES, WORDS = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", "  a  b\n\n c ", "don't I'll foo'south x", "a\x1cb c", "Éá ǅ ΑΣ Σα", "<|endoftext|>x <|endoftext|>", "12 3a4 _-x\r\n\t y  ", "日本語 テスト ½ ²x", "İstanbul ß ẞ É", "a​b a᠎b x y　", "é.É,ñ!! (", " x", "x \n", "\n x", "a  \n b", "µm ÀÉ×÷", "ÿ'S'LL"]


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize(("path", "kind"), [(BYTES, "bytes"), (WORDS, "words")])
def test_pieces_encode_as_the_whole_text(path, kind):
    mine, theirs = PieceEncoder(path, kind), Tokenizer.from_file(path)
    for text in [*ODD, " ".join(ODD), "\n".join(x.strip() for x in ODD)]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_hilbert_steps_are_neighbours():
    for n, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        order = cells[np.argsort(hilbert_key(cells, bits))]
        assert sorted(hilbert_key(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_token_files_round_trip(spark):
    docs, theirs = odd_documents(spark), Tokenizer.from_file(BYTES)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*theirs.encode(r.text or "", add_special_tokens=False).ids, 0])
    at, starts = 0, {}
    for k in sorted(want, key=lambda k: (k is not None, k)):
        starts[k] = at
        at += sum(map(len, want[k]))
    rows = token_digest(docs, BYTES).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted((k is None, k or 0, len(i), crc(i)) for k, v in want.items() for i in v)
    assert {k: min(r.start for r in rows if r.doc_id == k) for k in want} == starts
    assert max(r.start + r.n_tokens for r in rows) == at
    path = Scratch(spark, "t").path("set")
    write_tokens(docs, path, BYTES)
    plan = spark.read.parquet(f"{path}/shards").where("shard_first <= 30 and shard_last >= 30").select("offsets")._jdf.queryExecution().executedPlan().toString()
    assert "shard_first,30)" in plan.split("PushedFilters")[1] and "GreaterThanOrEqu" in plan.split("PushedFilters")[1]
    assert read_document(spark, path, 30) == want[30][0]
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in read_tokens(spark, path).where("doc_id <> 9 and doc_id is not null").collect()} == {k: v[0] for k, v in want.items() if k not in (9, None)}
    assert token_digest(docs.limit(0), BYTES).count() == 0


def test_packing_is_gapless(spark):
    docs, theirs = odd_documents(spark), Tokenizer.from_file(WORDS)
    want = sorted([*theirs.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect())
    rows = sorted(pack(docs, WORDS, 4096).collect(), key=lambda r: (r.sequence_id, r.offset))
    at, held, got = 0, [], []
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert r.sequence_id * 4096 + r.offset == at and r.length == len(ids) and r.ids_crc32 == crc(ids) and r.start == len(held)
        at += r.length
        held += ids.tolist()
        if len(held) == r.doc_tokens:
            got.append(held)
            held = []
    assert not held and sorted(got) == want
    copies = [(r.sequence_id, r.offset) for r in rows if r.doc_id == 9]
    assert len(copies) == 2
    assert pack(docs.limit(0), WORDS).count() == 0


def test_kept_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_BYTES", 4000)
    monkeypatch.setattr(encoding, "WORD_BYTES", 4000)
    theirs = Tokenizer.from_file(BYTES)
    mine = PieceEncoder(BYTES, "bytes")
    for i in range(60):
        text = " ".join(f"word{i * 7 + j} again{j}," for j in range(20)) + " " + "x" * 200
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
        for kept in (mine, mine.after):
            assert sum(encoding.ENTRY_BYTES + 2 * len(k) + len(v) for k, v in kept.items()) <= 4000 and all(len(k) <= encoding.LONGEST_PIECE for k in kept)


@pytest.mark.parametrize(("path", "kind"), [(BYTES, "bytes"), (WORDS, "words")])
@pytest.mark.parametrize("window", [5, 64, 2 << 20])
def test_texts_encode_together_as_each_alone(monkeypatch, path, kind, window):
    monkeypatch.setattr(encoding, "WINDOW_BYTES", window, raising=False)
    monkeypatch.setattr(encoding, "JOINED_WORDS", 3, raising=False)
    monkeypatch.setattr(encoding, "WORD_BYTES", 4000)
    mine, theirs = PieceEncoder(path, kind), Tokenizer.from_file(path)
    more = ["x \xa0<|endoftext|>", "a\xa0 b", "x\u2003 y.z", "é.ñ,×.à!»?", "İ, ", "a.\nb.\n c.\n\nd\r\n e", "'s.'ll,x", "\n", "tab\tand tab\n", "mañana, Größe; l'été: 3,5", "\x00 a\x00b"]
    texts = [x for i, odd in enumerate([*ODD, *more]) for x in (odd, f"wordy{i} {odd} {odd}\n{odd}.{odd}")]
    ids, firsts = mine.encode_all(pa.array(["left out", *texts, None]).slice(1))
    assert len(firsts) == len(texts) + 2 and firsts[-1] == firsts[-2] == len(ids)
    for text, a, b in zip(texts, firsts, firsts[1:], strict=False):
        assert ids[a:b].tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)
    assert sum(encoding.ENTRY_BYTES + 2 * len(k) + len(v) for k, v in mine.items()) <= 4000 and all(len(k) <= encoding.LONGEST_PIECE for k in mine)


def test_new_words_share_calls_of_the_library():
    class Counted:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def tokenize(self, run):
            self.calls += 1
            return self.model.tokenize(run)

    kept = encoding.encoder(BYTES, "bytes")
    counted = kept.model = Counted(kept.model)
    text = " ".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + "ñqé" + chr(97 + i // 676) for i in range(5000))
    try:
        assert as_ids(BYTES, text, 0, 2)[:-1].tolist() == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids
    finally:
        kept.model = counted.model
    assert counted.calls <= 50


@pytest.mark.parametrize(("path", "kind", "text"), [(BYTES, "bytes", "x  y \xa0<|endoftext|>" + "y" * 64), (WORDS, "words", "İ, é")])
def test_marks_and_added_tokens_behind_odd_characters(path, kind, text):
    assert as_ids(path, text, 0, 4, kind)[:-1].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_ids_that_need_more_bits_are_refused():
    with pytest.raises(ValueError):
        as_ids(BYTES, "a", 70_000, 2)
    assert as_ids(BYTES, "a", 70_000, 4)[-1] == 70_000
