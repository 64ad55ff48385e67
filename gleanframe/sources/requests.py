"""What to fetch: the ordered matrix of pages, terms and sites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REFUSED_HEADERS = frozenset(("authorization", "cookie"))


def refused_headers(headers: Mapping[str, str]) -> list[str]:
    """The headers that would sign in."""
    return sorted(REFUSED_HEADERS.intersection(h.lower() for h in headers))


@dataclass(frozen=True)
class Site:
    """A search page: its URL has {query} and may have {page}; a parser is named if the page needs its own."""

    name: str
    search_url: str
    parser: str | None = None
    respect_robots: bool = True
    headers: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        refused = refused_headers(self.headers)
        if refused:
            raise ValueError(f"only public pages are read; headers not allowed: {', '.join(refused)}")


def as_site(site: Site | str) -> Site:
    """A bare URL template as a site named after its host; it must have {query}."""
    if isinstance(site, Site):
        return site
    if "{query}" not in site:
        raise ValueError(f"no {{query}} in {site!r}")
    return Site(urlsplit(site).netloc, site)


def sites_table(spark: SparkSession, sites: Sequence[Site | str]) -> DataFrame:
    rows = [(i, s.name, s.search_url, s.parser, s.respect_robots, dict(s.headers)) for i, s in enumerate(map(as_site, sites))]
    return spark.createDataFrame(rows, "site_idx int, name string, search_url string, parser string, respect_robots boolean, headers map<string,string>")


def terms_table(spark: SparkSession, terms: Sequence[str] | str) -> DataFrame:
    return spark.createDataFrame(list(enumerate([terms] if isinstance(terms, str) else terms)), "term_idx int, term string")


def request_url(template: Column, term: Column, page: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{query}"), F.url_encode(term)), F.lit("{page}"), page.cast("string"))


def request_table(sites: DataFrame, terms: DataFrame, max_pages: int = 1) -> DataFrame:
    """One row for each page to fetch, in order of page, term and site.

    A template without {query} gives the same page for every term: the first term's request
    alone stays, for each template and page, whatever the site's name.
    """
    pages = sites.sparkSession.range(1, max_pages + 1).select(F.col("id").cast("int").alias("page"))
    matrix = sites.crossJoin(terms).crossJoin(pages)
    has_term = F.col("search_url").contains("{query}")
    first = Window.partitionBy("search_url", "page").orderBy("term_idx", "site_idx")
    once = matrix.where(~has_term).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return matrix.where(has_term).unionByName(once).withColumn("url", request_url(F.col("search_url"), F.col("term"), F.col("page")))
