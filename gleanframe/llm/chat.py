"""Chat formatting: collapse cumulative snapshots, then render what is left.

A log that saves a conversation after each turn holds all its beginnings as well. Each turn gets a
rolling hash of the turns up to it (hashes of place, role and text, joined by xor); a conversation
whose last rolling hash is found inside a longer conversation is a snapshot of that, and an
anti-join drops it. Everything runs as Spark expressions, joins and running sums over ranges; no
conversation is gathered in one task. Equal conversations are one row before they are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_parts


def rolling(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """``turns`` with place (from 1), n_turns, and the rolling hash (a, b) of each turn.

    Turns are range-partitioned by conversation and turn, numbered and summed within each range;
    what a conversation has in earlier ranges is added from the ranges' totals, of which there
    is one for each conversation that crosses a border.
    """
    spark = scratch.spark
    order = ["conv_id", "turn", "role", "tie"]
    dealt = turns.repartitionByRange(shuffle_parts(spark), *order).withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("range", "conv_id").orderBy("turn", "role", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = scratch.table("numbered", dealt.withColumn("k", F.row_number().over(inside).cast("long")))
    counts = numbered.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("conv_id")
    crossing = scratch.table("crossing", counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("n_turns", F.sum("n").over(everything)))
    placed = numbered.join(crossing.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), "before", "n_turns"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).drop("c", "r").withColumn("place", F.col("before") + F.col("k"))
    # Joined by xor, which has no bound on the number of turns; each hash holds its turn's place.
    term = lambda salt: F.xxhash64(F.lit(salt), "place", "role", "text")
    placed = scratch.table("placed", placed.withColumn("ta", term("a")).withColumn("tb", term("b")).drop("k", "before", "tie"))
    sums = placed.groupBy("conv_id", "range").agg(F.bit_xor("ta").alias("sa"), F.bit_xor("tb").alias("sb"))
    base = sums.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(f"base_{s}") for s in ("sa", "sb")])
    upto = Window.partitionBy("range", "conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.withColumn("ua", F.bit_xor("ta").over(upto)).withColumn("ub", F.bit_xor("tb").over(upto)).join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return joined.select("conv_id", "turn", "role", "text", "place", "n_turns", F.col("ua").bitwiseXOR(F.col("base_sa")).alias("a"), F.col("ub").bitwiseXOR(F.col("base_sb")).alias("b"))


def escaped(text: Column) -> Column:
    """Marks of the template are parted by a backslash; as nothing is taken out, no other mark can come together."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template; neither its text nor its role can fake a mark."""
    return F.concat(F.lit("<|"), escaped(F.lower(F.trim(role))), F.lit("|>\n"), escaped(text), F.lit("<|end|>\n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """The turns of maximal conversations: conv_id, place, n_turns, role, text, rendered.

    A conversation that is the beginning of a longer one goes; of equal ones the least conv_id
    stays. Sorted by place the rendered turns join to the whole. Null role or text counts as
    empty; turns with equal numbers are ordered by role and text, and repeated rows are turns
    like others; rows without a conv_id are one conversation, which never replaces another.
    Texts of any length are compared whole, by their hashes; an empty table gives no rows; other
    columns aren't read.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rolled = scratch.table("rolled", rolling(scratch, turns))
    last = rolled.where("place = n_turns").select("conv_id", F.col("place").alias("n"), "a", "b")
    inner = rolled.where("place < n_turns and conv_id is not null").select(F.col("place").alias("n"), "a", "b").distinct()
    firsts = scratch.table("firsts", last.groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id")))
    kept = scratch.table("kept", firsts.join(inner, ["n", "a", "b"], "left_anti").select("conv_id"))
    scratch.keep_only("rolled", "kept")
    chosen = rolled.join(kept.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    return chosen.select("conv_id", "place", "n_turns", "role", "text", render(F.col("role"), F.col("text")).alias("rendered"))
