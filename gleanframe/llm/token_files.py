"""Token-id output: zstandard frames that share one trained dictionary, with an offset index.

Format (version 1). A file set is a folder of Parquet part files in which each row is one shard,
written by Spark's committer, so lost executors leave no halves behind and any store that Spark
reaches can hold it. A shard holds some documents in ascending id order:

``shard_first``  the id of its first document, ``shard_last`` that of its last; null ids are in neither;
                 shards of a set sort by (part, shard), and row groups are small, so a reader
                 of one document skips the others' payloads by these two columns
``dict_hash``    xxh64 of the dictionary (in the set's ``dictionary`` table) its frames need
``payload``      one zstandard frame after another, one for each document
``offsets``      where each document's frame starts in ``payload``, and at last its length
``doc_ids``      ids of the documents, in the order of the frames
``n_tokens``     how many ids each document has, so sums need no decompression

The ids of a document are little-endian unsigned 16-bit where the vocabulary is under 65,536,
else 32-bit (``width``). Reading one short document takes the index and one frame.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, running_start, shuffle_parts
from .encoding import encoder

SHARDS = "part int, shard int, shard_first long, shard_last long, dict_hash long, width int, payload binary, offsets array<long>, doc_ids array<long>, n_tokens array<long>, total long"
SHARD_BYTES = 4 << 20
SAMPLE_DOCUMENTS, SAMPLE_TEXT_BYTES, DICTIONARY_BYTES = 500, 128 << 10, 64 << 10
ROW_GROUP_BYTES = 8 << 20


def ids_of(path: str, texts: pa.Array, end: int, width: int, kind: str = "bytes") -> Iterator[np.ndarray]:
    """The ids of each text, null being empty, with the end id."""
    ids, firsts = encoder(path, kind).encode_all(texts)
    if width == 2 and max(end, int(ids.max(initial=0))) > 0xFFFF:
        raise ValueError("an id needs more than 16 bits; write with width 4")
    ids = ids.astype("<u2" if width == 2 else "<u4")
    last = np.array([end], dtype=ids.dtype)
    for a, b in pairwise(firsts.tolist()):
        yield np.concatenate([ids[a:b], last])


def as_ids(path: str, text: str | None, end: int, width: int, kind: str = "bytes") -> np.ndarray:
    return next(ids_of(path, pa.array([text], pa.string()), end, width, kind))


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on serialized id arrays; their own bytes if they are too few to train on; empty if none."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes() if len(samples) >= 8 else b"".join(samples)[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_hash(dictionary: bytes) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(dictionary)).astype(np.int64))


def sample_dictionary(docs: DataFrame, tokenizer: str, end: int, width: int, documents: int = SAMPLE_DOCUMENTS, longest: int = SAMPLE_TEXT_BYTES) -> bytes:
    """Trains on the id arrays of at most ``documents`` whole documents of at most ``longest`` bytes: those whose ids hash lowest, one text an id."""
    known = docs.where(F.col("doc_id").isNotNull() & (F.octet_length(F.coalesce("text", F.lit(""))) <= longest))
    chosen = sorted({r[0] for r in known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).collect()})
    if not chosen:
        return b""
    rows = known.where(F.col("doc_id").isin(chosen)).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return train_dictionary([as_ids(tokenizer, r.text, end, width).tobytes() for r in sorted(rows, key=lambda r: r.doc_id)])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 0, width: int = 2) -> bytes:
    """Encodes ``docs`` (doc_id, text) and writes the file set at ``path``; returns the dictionary.

    Null text counts as empty: its document is the end id alone. Rows with equal doc_id all stay,
    next to each other; a null doc_id sorts first. An empty table gives an empty set.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = sample_dictionary(docs, tokenizer, end, width)
    known = dictionary_hash(dictionary)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False)
        part, no = TaskContext.get().partitionId(), 0
        frames, at, doc_ids, counts = [], [0], [], []

        def row() -> pa.RecordBatch:
            one = [part, no, next((x for x in doc_ids if x is not None), None), doc_ids[-1], known, width, b"".join(frames), at, doc_ids, counts, sum(counts)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, types, strict=True)], [c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of(tokenizer, batch.column(1), end, width), strict=True):
                frames.append(press.compress(ids.tobytes()))
                at.append(at[-1] + len(frames[-1]))
                doc_ids.append(doc_id)
                counts.append(len(ids))
                if at[-1] >= SHARD_BYTES:
                    yield row()
                    no += 1
                    frames, at, doc_ids, counts = [], [0], [], []
        if frames:
            yield row()

    bound_batches(spark)
    # Rows of one id, or of none, may be many: their texts' hash parts them.
    ordered = docs.repartitionByRange(shuffle_parts(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    ordered.mapInArrow(shards, SHARDS).write.option("compression", "none").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/shards")
    spark.createDataFrame([(known, bytearray(dictionary))], "dict_hash long, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return dictionary


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.schema("dict_hash long, dictionary binary").parquet(f"{path}/dictionary").take(1)
    dictionary = bytes(rows[0].dictionary)
    if dictionary_hash(dictionary) != rows[0].dict_hash:
        raise ValueError("the dictionary isn't the one its hash names")
    return dictionary


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, no, doc_id, ids binary as unsigned 32-bit, n_tokens) of a file set."""
    dictionary = read_dictionary(spark, path)
    known = dictionary_hash(dictionary)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard, doc_ids, frames in _frames(batches, dictionary, known):
            held, size, first = [], 0, 0
            for no, ids in enumerate(frames):
                held.append(ids.tobytes())
                size += len(held[-1])
                if size >= SHARD_BYTES or no == len(doc_ids) - 1:
                    n = len(held)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(range(first, first + n), pa.int32()), pa.array(doc_ids[first : first + n], pa.int64()), pa.array(held, pa.binary()), pa.array([len(x) // 4 for x in held], pa.int64())],
                        ["part", "shard", "no", "doc_id", "ids", "n_tokens"],
                    )
                    held, size, first = [], 0, no + 1

    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards").select("part", "shard", "dict_hash", "width", "payload", "offsets", "doc_ids")
    return shards.mapInArrow(documents, "part int, shard int, no int, doc_id long, ids binary, n_tokens long")


def _frames(batches: Iterator[pa.RecordBatch], dictionary: bytes, known: int):
    import zstandard

    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for batch in batches:
        for i in range(batch.num_rows):
            part, shard, dict_hash, width = (batch.column(c)[i].as_py() for c in range(4))
            if dict_hash != known:
                raise ValueError("a shard was written with another dictionary")
            payload, at = memoryview(batch.column(4)[i].as_buffer()), batch.column(5)[i].as_py()
            kind = "<u2" if width == 2 else "<u4"
            yield part, shard, batch.column(6)[i].as_py(), (np.frombuffer(unpress.decompress(payload[a:b]), dtype=kind).astype("<u4") for a, b in zip(at, at[1:], strict=False))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document: payloads of shards that can't hold it aren't read, and only its own frame is decompressed."""
    import zstandard

    rows = spark.read.schema(SHARDS).parquet(f"{path}/shards").where(F.col("shard_first") <= doc_id).where(F.col("shard_last") >= doc_id).where(F.array_contains("doc_ids", doc_id))
    frame = rows.withColumn("p", F.array_position("doc_ids", doc_id).cast("int")).selectExpr("width", "substring(payload, cast(offsets[p - 1] as int) + 1, cast(offsets[p] - offsets[p - 1] as int)) as frame")
    one = frame.take(1)[0]
    dictionary = read_dictionary(spark, path)
    raw = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress(bytes(one.frame))
    return np.frombuffer(raw, dtype="<u2" if one.width == 2 else "<u4").tolist()


def token_digest(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """Writes a file set for ``docs``, reads it back, and returns for each document: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in ascending doc_id order (a null id
    first; rows of equal id in the order of the files).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token_files")
    path = scratch.path("set")
    write_tokens(docs, path, tokenizer, end)
    dictionary = read_dictionary(spark, path)
    known = dictionary_hash(dictionary)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard, doc_ids, frames in _frames(batches, dictionary, known):
            counts, sums = [], []
            for ids in frames:
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.tobytes()))
            n = len(doc_ids)
            starts = np.cumsum([0, *counts[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    starts = running_start(scratch, "starts", shards.select("part", "shard", "total"), ["part", "shard"], "total", "base")
    read = shards.select("part", "shard", "dict_hash", "width", "payload", "offsets", "doc_ids").mapInArrow(digests, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
