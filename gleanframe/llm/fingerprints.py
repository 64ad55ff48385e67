"""Canonical exact digests: equal canonical texts, and only those, have equal fingerprints.

Everything runs as Spark expressions. Canonical form: NFKC, full case folding, NFKC again, each
run of Unicode white space as one space, trimmed. Unicode forms come from the ICU classes that
Spark itself ships, called by its ``java_method`` function; texts of ASCII alone need only
``lower``. A fingerprint is 128 bits of xxhash64 (two lanes); texts in an equal bucket are
compared byte by byte, and buckets with different texts get a longer digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_parts

#: Stands for a null id.
LEAST = -(1 << 63)
WHITE = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def canonical(text: Column) -> Column:
    """The canonical form of ``text``; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(plain, WHITE, " "))


def lanes(canon: Column) -> list[Column]:
    return [F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon)]


def digest(canon: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in lanes(canon)])


def shared_buckets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Digests whose bucket holds different canonical texts, found by comparing their bytes.

    Copies of a text meet already in the map-side step, so a text that a third of all rows
    share is sent once for each task.
    """
    canon = docs.select(canonical(F.col(text)).alias("canon")).withColumn("digest", digest(F.col("canon")))
    return canon.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("digest")


def fingerprint(canon: Column, shared: Column) -> Column:
    return F.when(shared, F.concat(digest(canon), F.lit("-"), F.sha2(canon, 256))).otherwise(digest(canon))


def spread_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` partitions a number that Spark's hash deals to it, so ranges named by them never share a task."""
    rows = spark.range(0, 40 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).collect()
    return [r.id for r in sorted(rows)]


def add_next(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text) with ``next``: the text of the next document in descending doc_id; the first's after the last.

    Documents are dealt by ranges of doc_id, so a text moves once; only each range's first
    document is looked up by the range before it. Equal ids are ordered by their texts' hash,
    then by text; a null id comes last. An id with the rows of several ranges is dealt to these by
    the texts' hash, so only rows equal in id and text must share a range.
    """
    held = docs.withColumn("k", F.coalesce("doc_id", F.lit(LEAST))).withColumn("tie", F.xxhash64("text"))
    bounds = sorted(held.select(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []) if parts > 1 else []
    keys = spread_keys(docs.sparkSession, parts)[: len(bounds) + 1] or [0]
    below = lambda c: F.size(F.filter(F.lit(bounds), c)) if bounds else F.lit(0)
    place = below(lambda b: b <= F.col("k"))
    if len(set(bounds)) < len(bounds):
        ranges = place - below(lambda b: b < F.col("k"))
        share = (F.col("tie").cast("double") + 2.0**63) / 2.0**64
        place = place - F.when(ranges > 1, F.least(F.floor(share * ranges), ranges - 1)).otherwise(F.lit(0)).cast("int")
    dealt = held.withColumn("place", place).withColumn("range", F.element_at(F.lit(keys), F.col("place") + 1).cast("long"))
    order = [F.col("k").desc(), F.col("tie"), F.col("text")]
    top = dealt.groupBy("range").agg(F.max("k").alias("top"))
    # One row for each range, and there are as many ranges as shuffle partitions.
    first = dealt.join(F.broadcast(top), "range").where("k = top").groupBy("range", "place").agg(F.min(F.struct("tie", "text"))["text"].alias("first"))
    around = Window.orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.withColumn("all", F.collect_list("place").over(around)).withColumn("after", F.coalesce(F.get(F.filter("all", lambda r: r < F.col("place")), 0), F.get("all", 0)))
    follow = after.select("range", "after").join(first.select(F.col("place").alias("after"), "first"), "after").select("range", "first")
    led = dealt.withColumn("next", F.lead("text").over(Window.partitionBy("range").orderBy(*order)))
    return led.join(F.broadcast(follow), "range").select("doc_id", "text", F.coalesce("next", "first").alias("next"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last third replaced by the next text's start).

    Null text counts as empty; an empty table gives no rows; rows of equal doc_id all stay. Texts of
    any length are taken whole; other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = scratch.table("shared", shared_buckets(docs))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.when(cut == 0, F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut)))
    rows = add_next(docs, shuffle_parts(spark)).select("doc_id", "text", "next", edited.alias("edited"))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("e"), canonical(F.col("next")).alias("x"))
    like = lambda other: F.when(F.col("c") == F.col(other), F.lit(1.0)).otherwise(F.lit(0.0))
    base = rows.select("doc_id", "n_chars", "edited_sha256", digest(F.col("c")).alias("fingerprint"), digest(F.col("e")).alias("edited_fingerprint"), like("e").alias("near_edited"), like("x").alias("near_next"), F.sha2("c", 256).alias("c2"), F.sha2("e", 256).alias("e2"))
    if shared.isEmpty():
        return base.drop("c2", "e2")
    for name, more in (("fingerprint", "c2"), ("edited_fingerprint", "e2")):
        base = base.join(shared.select(F.col("digest").alias(name), F.lit(True).alias("is_shared")), name, "left")
        base = base.withColumn(name, F.when(F.col("is_shared"), F.concat(name, F.lit("-"), more)).otherwise(F.col(name))).drop("is_shared")
    return base.drop("c2", "e2")
