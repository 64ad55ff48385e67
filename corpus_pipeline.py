"""From raw documents to packed training sequences; every stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm.common import Scratch
from gleanframe.llm.decontaminate import drop_leaks
from gleanframe.llm.langid import fit_on, keep_identified
from gleanframe.llm.minhash import drop_near_duplicates
from gleanframe.llm.packing import pack
from gleanframe.llm.pii import pseudonymize
from gleanframe.llm.queries import KEY, table, tokenizer

#: The stages on language, near-duplicates and training aren't expressible in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null or empty text, no letters) go."""
    return keep_identified(docs, fit_on(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, in whatever order, go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; n_chars follows the new text."""
    names = docs.columns
    out = pseudonymize(docs, KEY)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(names) if "n_chars" in names else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids, gapless in their sequences."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again.

    Null ids and repeated rows go through every stage by the rules of its operator; rows of one group
    of near-duplicates come down to one, repeated rows too. Columns besides those that the stages
    read, whatever their names, are carried up to packing. An empty table gives no rows.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(str(i), stage(spark, docs, sf_dir))
        scratch.keep_only(str(i))
    return STAGES[-1][1](spark, docs, sf_dir)
