"""Fetched pages to listings in scan order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.functions.text import host
from gleanframe.operators.predicates import in_chrome, is_posting_url, looks_like_json, plausible_title
from gleanframe.session import bound_batches
from gleanframe.sources import extract

ANCHORS = "pos int, url string, title string, tags array<string>, blobs array<string>"
ROWS = ", ".join(f"{f} string" for f in extract.FIELDS)
#: The most rows that wait to go back to Spark, and the text in them after which they go, in code points.
HELD_ROWS, HELD_CHARS = 2000, 1 << 19


def _chars(value: Any) -> int:
    """The text in a field: a string's, or that of a list of strings."""
    return len(value) if isinstance(value, str) else sum(map(len, value)) if isinstance(value, list) else 0


def _spread(pages: DataFrame, keep: list[str], rows: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Calls ``rows`` with each page's dict; its rows stand beside the kept columns.

    A worker holds one batch, bounded by bytes, and a bounded piece of what comes out.
    """
    bound_batches(pages.sparkSession)
    out = T.StructType([pages.schema[c] for c in keep] + list(T.StructType.fromDDL(schema).fields))
    blank = {f.name: None for f in out.fields if f.name not in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for page in batch.to_pylist():
                kept = {c: page[c] for c in keep} | blank
                for row in rows(page):
                    held.append(kept | row)
                    size += sum(map(_chars, held[-1].values()))
                    if len(held) >= HELD_ROWS or size >= HELD_CHARS:
                        yield pa.RecordBatch.from_pylist(held, types)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, types)

    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(out)
    return pages.mapInArrow(run, out)


def anchors(pages: DataFrame, *keep: str) -> DataFrame:
    """All links of pages (body, page_url), with a flag for those in page furniture."""
    rows = _spread(pages.select(*dict.fromkeys([*keep, "body", "page_url"])), list(keep), lambda p: extract.anchors(extract.parse(p["body"] or ""), p["page_url"] or ""), ANCHORS)
    return rows.withColumn("in_chrome", in_chrome(F.col("tags"), F.col("blobs"))).drop("tags", "blobs")


def _good_link(page_url: str = "page_url"):
    """Whether a link outside page furniture has the shape of a posting's."""
    return ~F.col("in_chrome") & plausible_title(F.col("title")) & is_posting_url(F.col("url"), host(F.col(page_url)))


def linked_listings(pages: DataFrame, *keep: str) -> DataFrame:
    """Listings by the shape of links: title and URL of each posting outside page furniture, each URL once a page."""
    keep = tuple(dict.fromkeys([*keep, "page_url"]))
    good = anchors(pages, *keep).where(_good_link())
    return good.groupBy(*keep, "url").agg(F.min(F.struct("pos", "title")).alias("first")).select(*keep, F.col("first.pos").alias("pos"), F.col("first.title").alias("title"), "url")


def listings(pages: DataFrame, *keep: str, parsers: Mapping[str, extract.Parser] | None = None) -> DataFrame:
    """Listings of fetched pages (body, page_url, content_type, parser) with their place on the page.

    A page goes to its own parser if it names one, else by its kind to the JSON or the HTML
    reader; HTML without JSON-LD postings is read by its links. Each page is parsed once: such a
    page gives its links, which are judged as columns.
    """
    known = dict(extract.PARSERS) | dict(parsers or {})
    keep = tuple(dict.fromkeys([*keep, "page_url"]))
    read = pages.select(*keep, "body", "parser", looks_like_json(F.coalesce("body", F.lit("")), F.coalesce("content_type", F.lit(""))).alias("is_json"))

    def rows(page: dict) -> Iterable[dict]:
        body, url = page["body"] or "", page["page_url"] or ""
        if page["parser"]:
            found = known[page["parser"]](body, url)
        elif page["is_json"]:
            found = extract.from_json(body, url)
        else:
            tree = extract.parse(body)
            found = extract.from_json_ld(tree, url)
            if not found:
                return ({"is_link": True, **link} for link in extract.anchors(tree, url))
        return ({"is_link": False, "pos": i, **row} for i, row in enumerate(found))

    parsed = _spread(read, list(keep), rows, f"is_link boolean, pos int, {ROWS}, tags array<string>, blobs array<string>")
    links = parsed.withColumn("in_chrome", F.col("is_link") & in_chrome(F.coalesce("tags", F.array()), F.coalesce("blobs", F.array()))).drop("tags", "blobs")
    good = links.where(~F.col("is_link") | _good_link())
    # Links of one page with equal URL are one listing; other rows stand each for itself.
    same = Window.partitionBy(*keep, "is_link", F.when(F.col("is_link"), F.col("url")).otherwise(F.col("pos").cast("string"))).orderBy("pos")
    return good.withColumn("__n", F.row_number().over(same)).where("__n = 1").select(*keep, "pos", *extract.FIELDS)
