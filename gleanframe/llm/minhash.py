"""Near-duplicates by b-bit MinHash.

1. Each text's shingle set gives 256 minima. Four neighbouring minima of the first half make a
   band key (32 keys); the two low bits of each minimum make a packed signature of 64 bytes.
2. Equal sets become one class, so copies never meet in a bucket.
3. Within a bucket of equal band keys, signatures are compared by counting bits; the estimate is
   corrected for low bits that agree by chance. It only says which pairs are tested first.
4. Such pairs are confirmed on the full sets. Every member of a bucket is tested against a leader
   of the bucket that it is likely to be linked to, then, twice, against the likeliest member of
   another component; that joins large groups of near copies by few tests. At last all pairs that
   remain between different components are tested. No estimate drops any of them: only sizes do, and
   parities of 4096 parts of the sets, which show how many shingles differ at least.
   So no link between different components goes untested, yet no group is expanded into all pairs.
Two sets at the threshold of 0.8 share no band with a chance of (1 - 0.8**4)**32 < 5e-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_slices
from .components import components
from .shingles import CHUNK, U, mix, shingle_sets

HASHES, BANDS, BAND, BITS = 256, 32, 4, 2
BLOCK = 2048
_RNG = np.random.default_rng(27_644_437)
FLIP = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
TIMES = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
BAND_SALT = _RNG.integers(0, 1 << 64, BANDS, dtype=U)
LOW = U(0x5555555555555555)
#: Parts of a set whose parities are kept, and how many words of them are compared first.
PARITY_BITS, FIRST_WORDS = 12, 8
#: Rounds in which each member is tested against its likeliest partner, before all pairs left are.
BEST_ROUNDS = 2


def minima(hashes: np.ndarray, flip: np.ndarray = FLIP, times: np.ndarray = TIMES) -> np.ndarray:
    """The least value of the set under each of some bijections of 32-bit words."""
    h = (hashes >> U(32)).astype(np.uint32)
    out = np.full(len(flip), 0xFFFFFFFF, dtype=np.uint32)
    step = (1 << 20) // len(flip)
    for at in range(0, len(h), step):
        np.minimum(out, ((h[at : at + step, None] ^ flip) * times).min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * BAND].reshape(-1, BAND).astype(U)
    key = BAND_SALT.copy()
    for i in range(BAND):
        key = mix(key ^ rows[:, i])
    return key.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    slots = (least & np.uint32((1 << BITS) - 1)).astype(U).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(slots << (np.arange(64 // BITS, dtype=U) * U(BITS)), axis=1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the low-bit slots differ, by bit counts of packed signatures."""
    x = a ^ b
    return np.bitwise_count((x | (x >> U(1))) & LOW).sum(axis=-1, dtype=np.int64)


def estimate(differ: np.ndarray | float) -> np.ndarray | float:
    """Similarity from differing slots: slots of different minima agree by chance once in 2**BITS."""
    chance = 2.0**-BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def most_differing(threshold: float, errors: float = 4.5) -> int:
    """The most differing slots at which a pair is still likely to reach ``threshold``."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * threshold
    return HASHES - math.floor(HASHES * (agree - errors * math.sqrt(agree * (1 - agree) / HASHES)))


def parity(items: np.ndarray) -> np.ndarray:
    """A packed bit for each part of a set: whether it holds an odd number of the set's hashes."""
    return np.packbits((np.bincount((items >> U(64 - PARITY_BITS)).astype(np.int64), minlength=1 << PARITY_BITS) & 1).astype(np.uint8)).view(U)


def can_link(n1, n2, p1: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """False only for pairs under the threshold: a part of unlike parities holds a shingle that one set alone has.

    So d unlike parts leave at most (n1 + n2 - d) / 2 shingles in common.
    """
    d = np.bitwise_count(p1 ^ p2).sum(axis=-1, dtype=np.int64)
    return (100 + percent) * d <= (100 - percent) * (n1 + n2)


def parities(sets: DataFrame) -> DataFrame:
    """(rep, parity) of each full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [parity(np.frombuffer(x.as_buffer(), dtype=U)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rep", "parity"])

    return sets.select("rep", "items").mapInArrow(run, "rep long, parity binary")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """row_id, doc_id, t (the text's hash), n, h1, h2 (of the whole set), bands (packed keys), sig of each row; a row without words has null bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, t, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k), strict=True):
                row = [(part << 36) + no, doc_id, t, len(s), 0, 0, None, None]
                no += 1
                if len(s):
                    least = minima(s)
                    row[4:] = int(s.sum(dtype=U).view(np.int64)), int(mix(s ^ LOW).sum(dtype=U).view(np.int64)), band_keys(least).tobytes(), signature(least).tobytes()
                out.append(tuple(row))
            if out:
                types = [pa.int64()] * 6 + [pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["row_id", "doc_id", "t", "n", "h1", "h2", "bands", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "row_id long, doc_id long, t long, n long, h1 long, h2 long, bands binary, sig binary")


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches as arrays in which all rows with equal values in the first ``keys`` columns are together."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cols = [held.column(i).to_numpy() for i in range(keys)]
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield _arrays(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield _arrays(held)


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    packed = {"sig", "parity"}.intersection(table.column_names)
    out = {n: table.column(n).to_numpy() for n in table.column_names if n not in packed}
    return out | {n: np.frombuffer(b"".join(table.column(n).to_pylist()), dtype=U).reshape(table.num_rows, -1) for n in packed}


def _sizes_link(n1, n2, percent: int) -> np.ndarray:
    return np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent


def _may_link(n1, n2, s1, s2, most: int, percent: int) -> np.ndarray:
    return (differing(s1, s2) <= most) & _sizes_link(n1, n2, percent)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def leader_pairs(members: DataFrame, likely: int, percent: int) -> DataFrame:
    """Each member with the first leader of its bucket's block that it is likely to be linked to; one without becomes a leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in runs_of(batches, 2):
            rest = np.arange(len(x["rep"]))
            while len(rest):
                key, block = x["key"][rest], x["block"][rest]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
                head = rest[np.flatnonzero(new)[np.cumsum(new) - 1]]
                link = _may_link(x["n"][rest], x["n"][head], x["sig"][rest], x["sig"][head], likely, percent) & ~new
                if link.any():
                    yield _pairs(x["rep"][rest[link]], x["rep"][head[link]])
                rest = rest[~link & ~new]

    dealt = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / BLOCK))).select("key", "block", "rep", "n", "sig")
    return dealt.repartition("key", "block").sortWithinPartitions("key", "block", "rep").mapInArrow(run, "a long, b long")


def remaining_pairs(members: DataFrame, comps: DataFrame, most: int, percent: int, sets: DataFrame | None) -> DataFrame:
    """Pairs of one bucket and different components that may be linked.

    Without ``sets`` each member with the one that differs least, if that is likely to be linked;
    with the members' full sets all pairs whose sizes and parities don't rule a link out; a pair may
    come from several buckets. Only buckets with more than one component are looked at; one of
    many blocks is dealt to tasks by pairs of blocks.
    """
    now = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m")
    rows = now.drop("m").join(mixed, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "rep", "n", "comp", "mine", "sig")
    best = sets is None
    if not best:
        rows = rows.join(parities(sets.join(rows.select("rep").distinct(), "rep", "left_semi")), "rep").select(*rows.columns, "parity")

    def bucket(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if (x["comp"] == x["comp"][0]).all():
            return
        whole = x["p"][0] == x["q"][0]
        for i in range(len(x["rep"])):
            j = np.arange(0 if best else i + 1, len(x["rep"]))
            j = j[(x["comp"][j] != x["comp"][i]) & (whole | (x["mine"][j] != x["mine"][i]))]
            if best:
                j = j[_may_link(x["n"][j], x["n"][i], x["sig"][j], x["sig"][i], most, percent)]
                if len(j):
                    j = j[np.argmin(differing(x["sig"][j], x["sig"][i]))][None]
            else:
                j = j[_sizes_link(x["n"][j], x["n"][i], percent)]
                for upto in (FIRST_WORDS, None):
                    j = j[can_link(x["n"][j], x["n"][i], x["parity"][j, :upto], x["parity"][i, :upto], percent)]
            if len(j):
                yield _pairs(x["rep"][j], np.full(len(j), x["rep"][i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in runs_of(batches, 3):
            new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[c][1:] != x[c][:-1] for c in ("key", "p", "q")])]))
            for a, b in zip(new, [*new[1:], len(x["key"])], strict=True):
                yield from bucket({n: c[a:b] for n, c in x.items()})

    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "rep").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, items): the whole sets of the classes in ``wanted`` (rep, least, h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in text_slices(texts, CHUNK):
                sets = list(shingle_sets(texts[lo:hi], k))
                one, two = ([int(f(s).sum(dtype=U).view(np.int64)) for s in sets] for f in (lambda s: s, lambda s: mix(s ^ LOW)))
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "items"])

    ids = wanted.select(F.col("least").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text")
    chosen = texts.join(ids, texts.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text")
    return chosen.mapInArrow(run, "h1 long, h2 long, items binary").join(wanted, ["h1", "h2"]).dropDuplicates(["rep"]).select("rep", "items")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=U) for c in (2, 3))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("s"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, t, n, comp, component_id) of each row; comp is null for a row without shingles."""
    scratch = Scratch(docs.sparkSession, "minhash")
    most, likely = most_differing(percent / 100), most_differing(percent / 100, 0)
    sketch = scratch.table("sketches", sketches(docs, k))
    worded = sketch.where("n > 0")
    classes = scratch.table("classes", worded.groupBy("h1", "h2", "n").agg(F.min("row_id").alias("rep"), F.min("doc_id").alias("least")))
    reps = scratch.table("reps", worded.join(classes.select("rep"), worded.row_id == F.col("rep")).select("rep", "n", "sig", "bands"))
    hexed = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("bands"), i * 8 + 1, F.lit(8)))
    keyed = reps.select("rep", F.posexplode(hexed).alias("band", "word")).select("rep", F.xxhash64("word", "band").alias("key"))
    keys = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = scratch.table("shared", keyed.join(keys, "key"))
    members = scratch.table("members", shared.join(reps.drop("bands"), "rep").select("key", "rep", "n", "sig", "m"))
    scratch.drop("shared", "reps")
    wanted = members.select("rep").distinct().join(classes, "rep").select("rep", "least", "h1", "h2")
    sets = scratch.table("sets", full_sets(docs, wanted, k))
    links = scratch.table("links-0", confirmed(leader_pairs(members, likely, percent).distinct(), sets, percent))
    comps = components(scratch, "comps-0", links)
    for i in range(1, BEST_ROUNDS + 2):
        pairs = scratch.table(f"pairs-{i}", remaining_pairs(members, comps, most, percent, None if i <= BEST_ROUNDS else sets).distinct())
        more = scratch.table(f"links-{i}", confirmed(pairs, sets, percent))
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = components(scratch, f"comps-{i}", links)
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    final = scratch.table("named", named.join(least, "comp").select("h1", "h2", "n", "comp", "component_id"))
    scratch.keep_only("sketches", "named")
    out = sketch.select("doc_id", "t", "n", "h1", "h2").join(final, ["h1", "h2", "n"], "left")
    return out.select("doc_id", "t", "n", "comp", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, component_id, kept.

    A document's component is all that links reach; component_id is its least doc_id and ``kept``
    says whether that is the document's own. Null or empty text, or text of white space alone:
    no shingles, no links. Rows of equal doc_id are compared each on its own text (and each
    whose id is the component's is kept); a null doc_id never names a component that has another id.
    Texts of any length are compared whole. An empty table gives no rows; other columns aren't read.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return grouped(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs``, all columns, of each group of near-duplicates: one with the group's least doc_id.

    Of several such rows the one stays whose text hashes lowest, and of wholly repeated rows any
    one. Rows without shingles belong to no group and all stay.
    """
    scratch = Scratch(docs.sparkSession, "deduplicated")
    found = scratch.table("rows", grouped(docs, k, percent).where("comp is null or doc_id <=> component_id").select("doc_id", "t", "comp"))
    per_text = found.where("comp is not null").groupBy("comp", "doc_id", "t").agg(F.count("*").alias("rows"))
    chosen = per_text.groupBy("comp").agg(F.min(F.struct("t", "doc_id", "rows")).alias("c")).select(F.col("c.doc_id").alias("__id"), F.col("c.t").alias("__t"), F.col("c.rows").alias("__rows"))
    chosen = scratch.table("chosen", chosen.unionByName(found.where("comp is null").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct().withColumn("__rows", F.lit(1).cast("long"))))
    rows = docs.withColumn("__hash", F.xxhash64("text"))
    same = lambda to: F.col("doc_id").eqNullSafe(to["__id"]) & (F.col("__hash") == to["__t"])
    one, many = (chosen.where(f"__rows {x} 1") for x in ("=", ">"))
    # Only rows that occur several times are dealt again, and copies of them meet before that.
    return rows.join(one, same(one), "left_semi").unionByName(rows.join(many, same(many), "left_semi").dropDuplicates(["doc_id", "__hash"])).drop("__hash")
