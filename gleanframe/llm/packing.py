"""Packing along a space-filling curve: neighbours in meaning share a training sequence.

Each document's token ids are hashed to a vector of few dimensions (a fixed random sign for each
id and dimension, summed and divided by the root of the count), the vector's place on a Hilbert
curve is its key, rows are range-sorted by that key, and one gapless stream of all ids is cut at
every multiple of the sequence length. Only the last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running_start
from .token_files import ids_of

DIMENSIONS, BITS, SEED = 3, 10, 20_011


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of ``cells`` (unsigned, each under 2**bits).

    Gray-code transposition: from the highest bit down, each axis either reflects the first
    axis's lower bits or trades them with its own; what is left is a Gray code over the axes.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        low = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            trade = (x[0] ^ x[i]) & low
            first = np.where(up, x[0] ^ low, x[0] ^ trade)
            x[i] = np.where(up, x[i], x[i] ^ trade) if i else first
            if i:
                x[0] = first
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curve_keys(documents: list[np.ndarray], signs: np.ndarray, bits: int = BITS) -> list[int]:
    """The curve places of documents (arrays of ids); one without ids lies in the middle of the space."""
    spread = np.array([signs[ids].sum(axis=0, dtype=np.int64) / max(1, len(ids)) ** 0.5 for ids in documents])
    cells = np.clip((np.tanh(spread / 4) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    return hilbert_key(cells, bits).tolist()


def sign_table(vocabulary: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), (vocabulary, dimensions))


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end: int = 2, vocabulary: int = 1 << 16, kind: str = "words") -> DataFrame:
    """Cuts all ids of ``docs`` (doc_id, text) into pieces that fill sequences of ``length``.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    curve_key, ids (binary, little-endian unsigned 16-bit). Null or empty text is the end id
    alone. Rows of equal doc_id are packed each on its own; a null doc_id is kept. Ties on the
    curve are ordered by doc_id. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, part, no = sign_table(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo in range(0, len(doc_ids), 500):
                ids = list(ids_of(tokenizer, batch.column(1).slice(lo, 500), end, 2, kind))
                n = len(ids)
                row_ids = [(part << 36) + no + i for i in range(n)]
                no += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_ids, pa.int64()), pa.array(doc_ids[lo : lo + 500], pa.int64()), pa.array(curve_keys([x[:-1] for x in ids], signs), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["row_id", "doc_id", "curve_key", "doc_tokens", "ids"],
                )

    encoded = scratch.table("encoded", docs.select("doc_id", "text").mapInArrow(encode, "row_id long, doc_id long, curve_key long, doc_tokens long, ids binary"))
    placed = running_start(scratch, "placed", encoded.select("row_id", "doc_id", "curve_key", "doc_tokens"), ["curve_key", "doc_id", "row_id"], "doc_tokens", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key", "ids"]
        types = [pa.int64()] * 8 + [pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, total, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, start = np.frombuffer(raw, dtype="<u2"), 0
                while start < total:
                    sequence, offset = divmod(at + start, length)
                    n = min(length - offset, total - start)
                    piece = ids[start : start + n]
                    out.append((doc_id, start, n, zlib.crc32(piece.astype("<u4").tobytes()), total, sequence, offset, key, piece.tobytes()))
                    start += n
            for lo in range(0, len(out), 4000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 4000], strict=True), types, strict=True)], names)

    joined = encoded.select("row_id", "ids").join(placed, "row_id").select("doc_id", "curve_key", "doc_tokens", "at", "ids")
    return joined.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long, ids binary")
