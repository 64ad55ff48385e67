"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Everything runs as Spark joins and aggregates. ``balanced_shards`` takes any links; law ``rows``:
the shards' counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running_start

BLOCK = 64


def copy_links(scratch: Scratch, nodes: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of nodes with equal ``keys``: a tree in which each node hangs at the least node of its block.

    Blocks hold about ``block`` nodes; the blocks' least nodes are put into blocks again until
    one is left, so no node has many links however large its group.
    """
    # Written, so that Spark can split a large group in the join.
    groups = scratch.table("groups", nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))
    left = groups.agg(F.max("n")).first()[0] or 0
    level, links = 0, None
    members = nodes.join(groups, list(keys)).select(*keys, "node", "n")
    while links is None or left > 1:
        dealt = scratch.table(f"level-{level}", members.withColumn("n", F.ceil(F.col("n") / block)).withColumn("block", F.pmod(F.xxhash64("node", F.lit(level)), F.col("n"))))
        least = dealt.groupBy(*keys, "n", "block").agg(F.min("node").alias("least"))
        found = dealt.join(least, [*keys, "n", "block"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
        links = found if links is None else links.unionByName(found)
        members = least.select(*keys, F.col("least").alias("node"), "n").where("n > 1")
        left, level = -(-left // block), level + 1
    return links


def propagate(scratch: Scratch, nodes: DataFrame, links: DataFrame, shards: int, rounds: int) -> DataFrame:
    """(node, shard) after ``rounds`` of moves. A move needs most of a node's neighbours there, and room there.

    Of two nodes with no other link the later one moves, so they never trade places.
    Room: a shard takes its free capacity plus what leaves it. Where more would come than there is
    room for, a share of them is chosen by hash, so no group is ranked in one task.
    """
    n = nodes.count()
    room = n / shards
    both = scratch.table("both", links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    at = scratch.table("at-0", nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")))
    for i in range(1, rounds + 1):
        seen = both.join(at.select(F.col("node").alias("b"), F.col("shard").alias("there")), "b").groupBy("a", "there").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        own = seen.join(at.select(F.col("node").alias("a"), F.col("shard").alias("here")), "a")
        best = own.groupBy("a").agg(F.max_by("there", F.struct("n", -F.col("there"))).alias("there"), F.max("n").alias("most"), F.max(F.when(F.col("there") == F.col("here"), F.col("n")).otherwise(0)).alias("mine"), F.min("here").alias("here"), F.sum("n").alias("links"), F.min("b").alias("least"))
        wish = scratch.table(f"wish-{i}", best.where("most > mine and 2 * most > links and (links > 1 or least < a)").select(F.col("a").alias("node"), "here", "there"))
        sizes = at.groupBy("shard").agg(F.count("*").alias("has"))
        come = wish.groupBy(F.col("there").alias("shard")).agg(F.count("*").alias("come"))
        leave = wish.groupBy(F.col("here").alias("shard")).agg(F.count("*").alias("leave"))
        quota = come.join(sizes, "shard", "left").join(leave, "shard", "left").select(F.col("shard").alias("there"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(room) - F.coalesce("has", F.lit(0)) + F.least(F.coalesce("leave", F.lit(0)), F.col("come"))) / F.col("come"))).alias("share"))
        # One row for each shard.
        moved = wish.join(F.broadcast(quota), "there").where(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("node", F.col("there").alias("new"))
        at = scratch.table(f"at-{i}", at.join(moved, "node", "left").select("node", F.coalesce("new", "shard").alias("shard")))
    return at


def balanced_shards(docs: DataFrame, shards: int = 40, rounds: int = 4, links: DataFrame | None = None) -> DataFrame:
    """Shard and slot of each document; counts of shards are at most one apart (law ``rows``).

    ``links`` (a, b: doc_id values) may add links; by default equal texts are linked. Null text is
    empty; rows of equal doc_id are placed each on its own; a null doc_id is kept. After the
    moves the nodes, in order of shard and group, are cut into equal runs, which passes what a
    shard has too much on to the next one and cuts a group at 39 places at most.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("wide"), text).alias("g2"))
    nodes = scratch.table("nodes", base.withColumn("node", F.monotonically_increasing_id()))
    linked = copy_links(scratch, nodes, "g1", "g2")
    if links is not None:
        ids = nodes.select("doc_id", "node")
        linked = linked.unionByName(links.join(ids.select(F.col("doc_id").alias("a"), F.col("node").alias("na")), "a").join(ids.select(F.col("doc_id").alias("b"), F.col("node").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).where("a <> b"))
    at = propagate(scratch, nodes, linked, shards, rounds)
    n = max(1, nodes.count())
    placed = nodes.join(at.withColumnRenamed("shard", "near"), "node").withColumn("one", F.lit(1).cast("long"))
    placed = running_start(scratch, "placed", placed, ["near", "g1", "g2", "node"], "one", "at")
    scratch.keep_only("placed")
    return placed.withColumn("shard", F.expr(f"cast(at * {shards}L div {n}L as int)")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.expr(f"at - (shard * {n}L + {shards - 1}L) div {shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
