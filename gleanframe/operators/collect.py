"""Collecting listings from many buckets: quotas, duplicates, fair order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.session import stored


def first_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of rows with equal key the first in ``order``; rows without a key all stay.

    One window, whose groups are trimmed before the shuffle; each row without a key is a group of its own.
    """
    alone = df.withColumn("__alone", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    first = Window.partitionBy(key, "__alone").orderBy(*order)
    return alone.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__alone")


def quota(df: DataFrame, bucket: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each bucket; Spark trims each task's rows before the shuffle."""
    if limit <= 0:
        return df.limit(0)
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order)))
    return ranked.where(F.col("__n") <= limit).drop("__n")


def interleave(df: DataFrame, bucket: str, order: Sequence[str], total: int | None = None, position: str = "position") -> DataFrame:
    """Rows in turns, one of each bucket, buckets in order of their number; ``position`` counts from 1.

    With ``total`` only so many turns are dealt: no bucket can give more than ``total`` rows, so
    each is cut before all meet in one order.
    """
    depth = df.withColumn("__depth", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    if total is None:
        return depth.withColumn(position, F.row_number().over(Window.orderBy("__depth", bucket))).drop("__depth")
    top = depth.where(F.col("__depth") <= total).orderBy("__depth", bucket).limit(max(0, total))
    return top.withColumn(position, F.row_number().over(Window.orderBy("__depth", bucket))).drop("__depth")


def fair_feed(df: DataFrame, site: str, bucket: str, order: Sequence[str], limit: int, sites: int) -> DataFrame:
    """Two levels: buckets in turns within each site, at most ``limit`` of a site; then sites in turns."""
    if limit <= 0:
        return df.limit(0)
    in_bucket = df.withColumn("__depth", F.row_number().over(Window.partitionBy(site, bucket).orderBy(*order)))
    in_site = in_bucket.where(F.col("__depth") <= limit).withColumn("site_rank", F.row_number().over(Window.partitionBy(site).orderBy("__depth", bucket)))
    return interleave(in_site.where(F.col("site_rank") <= limit).drop("__depth"), site, ["site_rank"], limit * sites, "position")


def greedy_quota(df: DataFrame, bucket: str, key: str, order: str, limit: int, step: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows as they come: one is taken if its key is new and its bucket has room.

    A row turned away for lack of room doesn't use its key up, so a later bucket may take it.
    By deferred acceptance: each key proposes its earliest row still alive; each bucket holds its
    ``limit`` earliest proposals, and what lies behind the last of them dies, as that edge only ever
    moves forward; until no proposal dies. Only edges are looked for, so no bucket is ranked in one
    task. ``step`` writes a round's rows; by default to a table in the shared folder.
    """
    if limit <= 0:
        return df.limit(0)
    step = step or stored
    live = df.withColumn("__n", F.row_number().over(Window.partitionBy(bucket, key).orderBy(order))).where("__n = 1").drop("__n")
    while True:
        proposed = step(live.withColumn("__p", F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1))
        held = proposed.where("__p").withColumn("__r", F.row_number().over(Window.partitionBy(bucket).orderBy(order))).where(F.col("__r") <= limit)
        edges = step(held.groupBy(F.col(bucket).alias("__bucket")).agg(F.max(order).alias("__edge"), F.count("*").alias("__held")).where(F.col("__held") == limit).drop("__held"))
        dies = F.coalesce(F.col(order) > F.col("__edge"), F.lit(False))
        judged = proposed.join(edges, F.col(bucket).eqNullSafe(F.col("__bucket")), "left")
        if judged.where(dies & F.col("__p")).isEmpty():
            return proposed.where("__p").drop("__p")
        live = judged.where(~dies).drop("__p", "__bucket", "__edge")


def greedy_quota_fold(df: DataFrame, bucket: str, key: str, order: str, limit: int) -> DataFrame:
    """The same rows as ``greedy_quota`` in one task, for inputs of known small size: a fold over the first row of each key in each bucket."""
    if limit <= 0:
        return df.limit(0)
    names = df.columns
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(bucket, key).orderBy(order))).where("__n = 1").drop("__n")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        room: dict = {}
        for rows in parts:
            keep = []
            for b, k in zip(rows[bucket], rows[key], strict=True):
                take = k not in seen and room.get(b, 0) < limit
                if take:
                    seen.add(k)
                    room[b] = room.get(b, 0) + 1
                keep.append(take)
            yield rows[keep]

    return first.repartition(1).sortWithinPartitions(order).mapInPandas(fold, df.select(*names).schema)


def order_column(*parts: str) -> Column:
    """The place of a listing in the scan: page, term, site, position on the page."""
    return F.struct(*parts)
