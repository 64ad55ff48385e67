"""Benchmark decontamination by greedy string tiling.

1. The seeds of a benchmark item are its runs of ``k`` words (an item of fewer words is one run).
   A bit table of all seeds, of fixed size, tells which runs of a document can be one.
2. Those runs are joined to the seeds; a document and an item that share one are a candidate pair.
3. Each pair is tiled: running Karp-Rabin finds the longest runs that both have and that no tile
   covers yet, longest first, until none of ``k`` words is left.
4. A test item is leaked if tiles cover enough of it, in whatever order its parts stand.
The benchmark may be of any size: nothing of it but the bit table reaches the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, text_slices
from .shingles import STEP, U, mix, word_hashes

#: Places of the bit table: 2 MB, and as much at the most in rows to the driver.
FILTER_BITS = 24
#: Bytes of text that are scanned at once.
CHUNK = 256 << 10
#: ASCII marks part words as white space does.
PARTS = bytes(b if chr(b).isalnum() or b >= 128 else 0x20 for b in range(256))
RADIX = U(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    """Lower case, marks as spaces."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(PARTS)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; runs of other lengths have others."""
    n = max(0, len(words) - k + 1)
    total = words[:n] * STEP[0]
    for i in range(1, k):
        total = total + words[i : n + i] * STEP[i % len(STEP)]
    return mix(total + U(k))


class Rolling:
    """Karp-Rabin hashes of all runs of one sequence, of any length: sums of powers, modulo 2**64."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free = words, free
        self.power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(words), RADIX, dtype=U)]))
        self.sums = np.concatenate([[U(0)], np.cumsum(mix(words) * self.power[1:])])

    def places(self, size: int) -> np.ndarray:
        """Where a run of ``size`` free words begins."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        return np.flatnonzero(taken[size:] == taken[:-size]) if size <= len(self.words) else np.zeros(0, dtype=np.int64)

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        # All hashes are brought to one power, so runs compare wherever they stand.
        return (self.sums[at + size] - self.sums[at]) * self.power[len(self.words) - size - at]


def common_runs(item: Rolling, doc: Rolling, size: int) -> tuple[np.ndarray, ...]:
    """Free places of item and document with their hashes, of runs of ``size`` words whose hash both have."""
    p, q = item.places(size), doc.places(size)
    # The two sequences' hashes stand at different powers; the shorter one's are raised.
    raised = U(pow(int(RADIX), abs(len(item.words) - len(doc.words)), 1 << 64))
    a, b = item.hashes(p, size), doc.hashes(q, size)
    a, b = (a, b * raised) if len(item.words) >= len(doc.words) else (a * raised, b)
    in_a, in_b = np.isin(a, b), np.isin(b, a)
    return p[in_a], a[in_a], q[in_b], b[in_b]


def tiles(item: Sequence[int], doc: Sequence[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in doc, length) of at least ``least`` words: always the longest, of those the first in the item, then in the document.

    The greatest length is found by halving, as a common run of some length holds one of each
    lesser length; then all tiles of that length are set in one pass. As later tiles are no
    longer than earlier ones, a run is free if both its ends are. A zero in ``doc`` is a gap.
    """
    i = Rolling(np.asarray(item, dtype=U), np.ones(len(item), dtype=bool))
    d = Rolling(np.asarray(doc, dtype=U), np.asarray(doc, dtype=U) != 0)
    found: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while most >= least:
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            if len(common_runs(i, d, middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            return found
        size, before = low, len(found)
        at_item, one, at_doc, two = common_runs(i, d, size)
        places = defaultdict(list)
        for q, h in zip(at_doc.tolist()[::-1], two.tolist()[::-1], strict=True):
            places[h].append(q)
        for p, h in zip(at_item.tolist(), one.tolist(), strict=True):
            if not (i.free[p] and i.free[p + size - 1]):
                continue
            left = places[h]
            # A place that is covered stays so.
            while left and not (d.free[left[-1]] and d.free[left[-1] + size - 1]):
                left.pop()
            if left and np.array_equal(i.words[p : p + size], d.words[left[-1] : left[-1] + size]):
                q = left.pop()
                i.free[p : p + size] = d.free[q : q + size] = False
                found.append((p, q, size))
        most = size if len(found) > before else size - 1
    return found


def items_of(scratch: Scratch, benchmark: DataFrame, k: int) -> DataFrame:
    """(item, item_id, words, size, seeds) of each row of the benchmark that has words; ``item`` numbers rows, whatever their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows: list[tuple] = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, _ = word_hashes([normal(text)])
                if len(words):
                    size = min(k, len(words))
                    rows.append(((part << 36) + no, item_id, words.tobytes(), size, np.unique(run_hashes(words, size)).view(np.int64)))
                    no += 1
            if rows:
                types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["item", "item_id", "words", "size", "seeds"])

    return scratch.table("items", benchmark.select("item_id", "text").mapInArrow(run, "item long, item_id long, words binary, size int, seeds array<long>"))


def bit_table(seeds: DataFrame) -> np.ndarray:
    """A bit for each value that the first FILTER_BITS bits of a seed have; its size doesn't grow with the seeds."""
    bit = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    rows = seeds.select(bit.alias("bit")).groupBy((F.shiftright("bit", 6)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=U)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(U)
    return out


def scanned(scratch: Scratch, docs: DataFrame, seeds: DataFrame, sizes: list[int]) -> DataFrame:
    """(row_id, doc_id, t, n_words, runs) of each document: its number of words, and its runs that the bit table takes for seeds."""
    bound_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(bit_table(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, part, no = table.value, TaskContext.get().partitionId(), 0
        run_type = pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32()), ("words", pa.binary())]))
        for batch in batches:
            texts, doc_ids, hashes = (batch.column(c).to_pylist() for c in (1, 0, 2))
            for lo, hi in text_slices(texts, CHUNK):
                words, at = word_hashes([normal(t) for t in texts[lo:hi]])
                runs: list[list[dict]] = [[] for _ in range(hi - lo)]
                for size in sizes:
                    h = run_hashes(words, size)
                    top = h >> U(64 - FILTER_BITS)
                    near = np.flatnonzero((bits[(top >> U(6)).astype(np.int64)] >> (top & U(63))) & U(1))
                    owner = np.searchsorted(at, near, side="right") - 1
                    inside = near + size <= at[owner + 1]
                    for p, o in zip(near[inside].tolist(), owner[inside].tolist(), strict=True):
                        runs[o].append({"seed": int(h[p].view(np.int64)), "place": p - int(at[o]), "words": words[p : p + size].tobytes()})
                ids = np.arange(no, no + hi - lo) + (part << 36)
                no += hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(doc_ids[lo:hi], pa.int64()), pa.array(hashes[lo:hi], pa.int64()), pa.array(np.diff(at)), pa.array(runs, run_type)], ["row_id", "doc_id", "t", "n_words", "runs"])

    out = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "row_id long, doc_id long, t long, n_words long, runs array<struct<seed:long,place:int,words:binary>>")
    return scratch.table("scanned", out)


def tiled(pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(row_id, item_id, share) of the candidate pairs whose tiles cover at least ``threshold`` of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=U)
                # Only what seeds cover can lie in a tile; gaps are kept apart by a zero.
                doc: list[np.ndarray] = []
                upto = -1
                for run in batch.column(3)[i].as_py():
                    p, words = run["place"], np.frombuffer(run["words"], dtype=U)
                    if p > upto and doc:
                        doc.append(np.zeros(1, dtype=U))
                    if p + len(words) > upto:
                        doc.append(words[max(p, upto) - p :])
                        upto = p + len(words)
                share = sum(n for _, _, n in tiles(own, np.concatenate(doc), min(k, len(own)))) / len(own)
                if share >= threshold:
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), share))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.float64()], strict=True)], ["row_id", "item_id", "share"])

    return pairs.mapInArrow(run, "row_id long, item_id long, share double")


def leaks(scratch: Scratch, docs: DataFrame, benchmark: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The scanned documents, and (row_id, item_id, share) of the items that they leak."""
    items = items_of(scratch, benchmark, k)
    # At most k values.
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    seeds = scratch.table("seeds", items.select("item", F.explode("seeds").alias("seed")))
    rows = scanned(scratch, docs, seeds, sizes)
    runs = rows.where(F.size("runs") > 0).select("row_id", F.explode("runs").alias("run")).select("row_id", "run.*")
    pairs = runs.join(seeds, "seed").groupBy("row_id", "item").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("runs"))
    found = scratch.table("leaks", tiled(pairs.join(items.select("item", "item_id", "words"), "item").select("row_id", "item_id", "words", "runs"), k, threshold))
    scratch.keep_only("scanned", "leaks")
    return rows, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, items (ids of leaked test items, ascending, each once), coverage (the greatest), contaminated.

    One row for each document; null and empty texts have no words and leak nothing, as do items
    without words. An item of fewer than ``k`` words must appear whole. Rows of equal doc_id or
    item_id stand each for itself; an item without an id counts in coverage and contaminated,
    but isn't named. Texts of any length are scanned whole; other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows, found = leaks(scratch, docs, benchmark, k, threshold)
    per_row = found.groupBy("row_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("share").alias("coverage"))
    out = rows.select("row_id", "doc_id", "n_words").join(per_row, "row_id", "left")
    none = F.array().cast("array<long>")
    return out.select("doc_id", "n_words", F.coalesce("items", none).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.col("coverage").isNotNull().alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item of ``benchmark``, named or not."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows, found = leaks(scratch, docs, benchmark, k, threshold)
    # Rows of one id and text leak alike.
    leaked = rows.join(found.select("row_id").distinct(), "row_id", "left_semi").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    return hashed.join(leaked, hashed["doc_id"].eqNullSafe(leaked["__id"]) & (F.col("__hash") == F.col("__t")), "left_anti").drop("__hash")
