"""Fetching pages: a Python data source over requests, with one task for each host."""

from __future__ import annotations

import json
import re
import time
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleanframe.operators.predicates import LOGIN_PATH

from .requests import refused_headers

# How politely pages are read.
DELAY, TIMEOUT, AGENT = 1.0, 15.0, "Mozilla/5.0 (compatible; listing reader)"
LANGUAGES = "en;q=0.9, he;q=0.8"
#: (final url, status, content type, body); raises OSError where the call fails.
Answer = tuple[str, int, str, str]
Transport = Callable[[str, dict[str, str]], Answer]


class LoginWall(RuntimeError):
    """The page wants a sign-in; it is left alone."""


def over_http(url: str, headers: dict[str, str]) -> Answer:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    request = Request(url, headers={"User-Agent": AGENT, "Accept-Language": LANGUAGES, **headers})
    try:
        with urlopen(request, timeout=TIMEOUT) as r:
            return r.geturl(), r.status, r.headers.get("Content-Type", ""), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except HTTPError as error:
        return url, error.code, "", ""


def root_of(url: str) -> str:
    return "{0.scheme}://{0.netloc}".format(urlsplit(url))


def robots_rules(urls: Iterable[str], transport: Transport) -> dict[str, Callable[[str], bool]]:
    """Whether a URL may be read, for the root of each of ``urls``: by its robots file where it can be had, else yes."""
    table: dict[str, Callable[[str], bool]] = {}
    for root in dict.fromkeys(map(root_of, urls)):
        rules = RobotFileParser()
        try:
            status, body = transport(f"{root}/robots.txt", {})[1::2]
        except OSError:
            status, body = 0, ""
        rules.parse(body.splitlines() if 0 < status < 400 else ())
        table[root] = partial(rules.can_fetch, AGENT)
    return table


class Reader:
    """Reads public pages at most once a second from each host."""

    def __init__(self, transport: Transport = over_http, delay: float = DELAY, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.delay, self.clock, self.sleep = transport, delay, clock, sleep
        self.last: dict[str, float] = {}

    def get(self, url: str, headers: dict[str, str] | None = None) -> tuple[str, str]:
        """(body, content type) of a public page; headers that sign in are refused."""
        if refused := refused_headers(headers or {}):
            raise ValueError(f"only public pages are read; headers not allowed: {', '.join(refused)}")
        host = urlsplit(url).netloc
        wait = self.last.get(host, float("-inf")) + self.delay - self.clock()
        if wait > 0:
            self.sleep(wait)
        self.last[host] = self.clock()
        final, status, kind, body = self.transport(url, dict(headers or {}))
        head = body[:20000].lower()
        if status in (401, 403) or re.search(LOGIN_PATH, urlsplit(final).path) or 'type="password"' in head or "type='password'" in head:
            raise LoginWall(url)
        if status >= 400:
            raise OSError(f"{url}: status {status}")
        return body, kind


class _Host(InputPartition):
    def __init__(self, requests: list[dict]):
        self.requests = requests


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.requests = json.loads(options.get("requests", "[]"))
        self.offline = json.loads(options["bodies"]) if "bodies" in options else None

    def partitions(self) -> list[_Host]:
        hosts: dict[str, list[dict]] = defaultdict(list)
        for r in self.requests:
            hosts[urlsplit(r["url"]).netloc].append(r)
        return [_Host(v) for v in hosts.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        bodies = self.offline

        def canned(url: str, headers: dict[str, str]) -> Answer:
            return (url, 200, "", bodies[url]) if url in bodies else (url, 404, "", "")

        reader = Reader() if bodies is None else Reader(canned, delay=0)
        allowed = robots_rules((r["url"] for r in partition.requests if r.get("respect_robots", True)), reader.transport)
        for r in partition.requests:
            body = kind = error = None
            try:
                if r.get("respect_robots", True) and not allowed[root_of(r["url"])](r["url"]):
                    error = "not allowed by robots"
                else:
                    body, kind = reader.get(r["url"], r.get("headers"))
            except (OSError, LoginWall, ValueError) as e:  # one page that fails doesn't stop the scan
                error = f"{type(e).__name__}: {e}"
            yield r["url"], body, kind, error


class PagesDataSource(DataSource):
    """``spark.read.format("public_pages").option("requests", json)``: page_url, body, content_type, error.

    ``requests`` is a JSON list of {url, headers, respect_robots}; ``bodies``, a JSON object of
    URL to body, stands for the network in tests. Pages of one host are read by one task, so its
    pace holds without any talk between tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "public_pages"

    def schema(self) -> str:
        return "page_url string, body string, content_type string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options)
