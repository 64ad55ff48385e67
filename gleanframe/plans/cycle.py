"""One cycle from pages to delivered messages, and the cycles as a stream."""

from __future__ import annotations

import json
import logging
import os
import signal
import threading
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.identity import identity_parts, listing_id
from gleanframe.operators import assess as model
from gleanframe.operators import collect, delivery, extraction, rules, templates
from gleanframe.session import stored
from gleanframe.sources.extract import FIELDS
from gleanframe.sources.fetch import PagesDataSource
from gleanframe.sources.requests import Site, as_site, request_table, sites_table, terms_table
from gleanframe.streaming.history import History

LOG = logging.getLogger(__name__)
#: Messages after which their ids are written to the history.
REMEMBERED_AT_ONCE = 20


def read_env(path: str, into: dict[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines of a file; what the shell has set wins."""
    into = os.environ if into is None else into  # type: ignore[assignment]
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                name, mark, value = line.removeprefix("export ").partition("=")
                if mark and not line.startswith("#"):
                    into.setdefault(name.strip(), value.strip().strip("\"'"))
    return into


def missing_settings(needed: Sequence[str], files: Sequence[str], env: Mapping[str, str] = os.environ) -> list[str]:
    return [f"{n} is not set" for n in needed if not env.get(n)] + [f"{f} not found" for f in files if not os.path.isfile(f)]


def _bucket(name: str, search_url: str) -> str:
    return f"{name}\x1f{search_url}"


def listed(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Listings of fetched pages with their key, bucket and place in the scan.

    ``requests`` (page, term_idx, site_idx, name, search_url, url, term, parser) says what was asked
    for; ``pages`` (page_url, body, content_type) what came back.
    """
    asked = requests.select("page", "term_idx", "site_idx", "name", "search_url", "parser", "term", F.col("url").alias("page_url"))
    fetched = asked.join(pages.where("body is not null").select("page_url", "body", "content_type"), "page_url")
    rows = extraction.listings(fetched, "page", "term_idx", "site_idx", "name", "search_url", "term")
    rows = rows.withColumn("source", F.coalesce("source", "name")).withColumn("search_term", F.coalesce("search_term", "term"))
    key = F.coalesce("url", F.concat_ws(":", "source", "title", F.coalesce("company", F.lit("None"))))
    return rows.withColumn("key", key).withColumn("bucket", F.concat_ws("\x1f", "name", "search_url")).withColumn("ord", F.struct("page", "term_idx", "site_idx", "pos"))


def dealt(taken: DataFrame, limit: int, total_sites: int) -> DataFrame:
    """Listings taken under quotas in turns over URLs and sites."""
    first = taken.groupBy("bucket").agg(F.min("site_idx").alias("bucket_idx"))
    sites = taken.groupBy("name").agg(F.min("site_idx").alias("site_order"))
    placed = taken.join(first, "bucket").join(sites, "name")
    return collect.fair_feed(placed, "site_order", "bucket_idx", ["ord"], limit, total_sites).select("position", *FIELDS)


def scan(requests: DataFrame, pages: DataFrame, limit: int, total_sites: int) -> DataFrame:
    """Listings of fetched pages, collected under quotas and dealt in turns over URLs and sites."""
    return dealt(collect.greedy_quota(listed(requests, pages), "bucket", "key", "ord", limit), limit, total_sites)


def run_cycle(listings: DataFrame, history: History, ruleset: Mapping[str, Mapping[str, Any]], template: dict[str, Any], assessor: model.Assessor, channel: delivery.Channel | None, chat: str = "", write: Callable[[str, DataFrame], DataFrame] = lambda name, df: stored(df), per_minute: float = 0, sleep: Callable[[float], None] = lambda s: None) -> dict[str, int]:
    """Assesses, filters and sends what is new; returns counts. Without ``channel`` it is a dry run.

    ``write`` writes a table and gives it back: answers of the model and outcomes of sending must
    not be made twice. Sending runs on the driver, one message after another, and an id is
    remembered once its message went out or may have gone out.
    """
    have = [c for c in FIELDS if c in listings.columns]
    named = write("listings", listings.withColumn("job_id", listing_id(*identity_parts(have))))
    found = named.count()
    unsent = history.fresh(named)
    fresh = write("fresh", collect.first_wins(unsent, "job_id", ["position"]))
    new = unsent.count()
    answered = write("answers", model.assess(fresh.select("position", "job_id", *have), template, assessor, per_minute))
    rows = model.parsed(answered.where("answer is not null"), templates.schema(template))
    kept = write("kept", rules.apply_rules(rows, ruleset, "assessment", "present").where("passed").select("position", "job_id", "answer", *have))
    n_fresh = fresh.count()
    counts = {"found": found, "old": found - new, "duplicates": new - n_fresh, "fresh": n_fresh, "assessed": answered.where("answer is not null").count(), "passed": kept.count(), "sent": 0}
    done: list[str] = []
    try:
        for row in kept.orderBy("position").toLocalIterator():
            listing, answer = {f: row[f] for f in have}, json.loads(row["answer"])
            if channel is None:
                LOG.info("dry run: %s", delivery.body(answer, delivery.heading(listing, answer)))
                continue
            (outcome,) = delivery.send_all(channel, chat, [(listing, answer)], sleep=sleep)
            counts["sent"] += outcome == delivery.SENT
            if outcome in (delivery.SENT, delivery.UNCERTAIN) and row["job_id"]:
                done.append(row["job_id"])
                if len(done) >= REMEMBERED_AT_ONCE:
                    history.add_all(done)
                    done = []
    finally:
        # Also when the sending breaks off: what went out must not go out again.
        history.add_all(done)
    return counts


def collect_sites(spark: SparkSession, sites: Sequence[Site | str], terms: Sequence[str] | str, limit: int, max_pages: int = 1, options: Mapping[str, str] | None = None, write: Callable[[str, DataFrame], DataFrame] = lambda name, df: stored(df)) -> DataFrame:
    """From sites and terms to listings: ``scan`` over pages fetched as they are needed.

    Pages and terms go one after another, the sites of each side by side; a site's URL that has
    given its ``limit`` of listings is asked no more. ``options`` go to the page source.
    """
    if limit <= 0:
        return spark.createDataFrame([], ", ".join(["position int", *(f"{f} string" for f in FIELDS)]))
    spark.dataSource.register(PagesDataSource)
    table = sites_table(spark, sites)
    asked = request_table(table, terms_table(spark, terms), max_pages)
    rows: DataFrame | None = None
    taken: DataFrame | None = None
    full: set[str] = set()
    headers = {s.search_url: s for s in map(as_site, sites)}
    for page in range(1, max_pages + 1):
        for term in range(1 if isinstance(terms, str) else len(terms)):
            wave = [r.asDict() for r in asked.where((F.col("page") == page) & (F.col("term_idx") == term)).select("page", "term_idx", "site_idx", "name", "search_url", "url", "term", "parser").collect()]
            wave = [r for r in wave if _bucket(r["name"], r["search_url"]) not in full]
            if not wave:
                continue
            calls = json.dumps([{"url": r["url"], "headers": dict(headers[r["search_url"]].headers), "respect_robots": headers[r["search_url"]].respect_robots} for r in wave])
            pages = spark.read.format("public_pages").options(**dict(options or {})).option("requests", calls).load()
            part = write(f"pages-{page}-{term}", listed(spark.createDataFrame(wave, asked.select(*wave[0]).schema), pages))
            rows = part if rows is None else rows.unionByName(part)
            taken = write(f"taken-{page}-{term}", collect.greedy_quota(rows, "bucket", "key", "ord", limit))
            full = {r.bucket for r in taken.groupBy("bucket").count().where(F.col("count") >= limit).collect()}
    if taken is None:
        return spark.createDataFrame([], ", ".join(["position int", *(f"{f} string" for f in FIELDS)]))
    return dealt(taken, limit, len({s.name for s in headers.values()}))


def run_forever(cycle: Callable[[], Any], hours: float, stop: threading.Event | None = None, signals: bool = True) -> None:
    """A cycle, then a rest from its end on, until a signal; a cycle that fails doesn't end it."""
    stop = stop or threading.Event()
    if signals:
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
    while not stop.is_set():
        try:
            cycle()
        except Exception:
            LOG.exception("the cycle failed")
        stop.wait(hours * 3600)


def stream_cycles(source: DataFrame, cycle: Callable[[DataFrame], Any], checkpoint: str, every: str | None = None):
    """Cycles over a stream of listings; without ``every`` all that is there is taken, then it stops."""
    writer = source.writeStream.foreachBatch(lambda batch, _: cycle(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def first_seen(spark: SparkSession, path: str, schema: str, key: str, at: str, checkpoint: str, out: str):
    """A stream of Parquet files to the first row of each key within a day, by event time."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, "1 day").dropDuplicatesWithinWatermark([key]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpoint_sink(name: str, df: DataFrame, ask: Callable[[str], str] = input, rows: int = 20) -> DataFrame:
    """For ``write`` of an interactive cycle: writes a stage's rows, shows some of them, and goes on only on the answer True."""
    df = stored(df)
    print(f"{name}: {df.count()} rows")
    df.show(rows, truncate=80, vertical=True)
    try:
        answer = ask(f"{name}: go on? Type True: ")
    except EOFError:
        answer = ""
    if answer.strip() != "True":
        raise SystemExit(1)
    return df


def remember_first(batch: DataFrame, key: str, order: str, path: str) -> None:
    """A cycle that appends each key's first row to the table at ``path``, for keys that it doesn't hold."""
    spark = batch.sparkSession
    fresh = collect.first_wins(batch.where(F.col(key).isNotNull()), key, [order])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(batch.columns)
    stored(fresh).write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
