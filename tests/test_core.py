from __future__ import annotations

import json
import random
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.functions import text as tx
from gleanframe.functions.identity import listing_id
from gleanframe.functions.numbers import as_number, number_text
from gleanframe.operators import assess, collect, delivery, extraction, rules, templates
from gleanframe.operators.predicates import is_login_page, is_posting_url, looks_like_json, plausible_title
from gleanframe.plans import catalogue, cycle
from gleanframe.session import BATCH_BYTES
from gleanframe.sources import extract
from gleanframe.sources import defaults
from gleanframe.sources.fetch import LoginWall, PagesDataSource, Reader, robots_rules
from gleanframe.sources.requests import Site, as_site, request_table, sites_table, terms_table
from gleanframe.streaming.history import History


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_identity_seeds(spark):
    rows = [("Acme Ltd.", "Junior C++ developer", "Tel-Aviv"), ("ACME  ltd", "junior c developer!", "tel aviv"), ("", "Straße ﬁ", ""), ("", "—", None)]
    got = values(spark, listing_id(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string")
    assert got == ["sha256:5807ced1c3ccdd42dde336231beb371b"] * 2 + ["sha256:28d918e54474dc063a87b4edd3c14ba2", None]


def test_text_functions(spark):
    rows = [("  a  b\n\x1cc ",), (" ",), (None,)]
    assert values(spark, tx.collapse(F.col("v")), rows, "v string") == ["a b c", None, None]
    assert values(spark, tx.shorten(F.col("v"), 4), [("abc d",), ("abcd",)], "v string") == ["abc…", "abcd"]
    assert values(spark, tx.plain(F.col("v")), [("<p>a&amp;b</p> c",)], "v string") == ["a&b c"]
    assert values(spark, tx.label(F.col("v")), [("salary_min_ils",), ("_",)], "v string") == ["Salary min ils", "_"]
    assert values(spark, tx.escape(F.col("v")), [("<a href=\"x\">'&",)], "v string") == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"]
    assert values(spark, tx.first_present(F.col("a"), F.col("b")), [("  ", 0), ("x ", 1), (None, None)], "a string, b int") == ["0", "x", ""]
    assert values(spark, tx.lines_kept(F.col("v"), ["T"], r"^\d+$"), [("T\n x  y \n12\nx y\nz",)], "v string") == ["x y z"]


#: Texts on which Python's white space and HTML's references differ from those of the catalogue's SQL.
ODD_TEXTS = [
    None, "", " ", "\n\t", "\u00a0", "a\u00a0 b\u3000", "\u2003a\x0bb\x1cc\x85\u2028 ", "\x0b", "Bleiner &amp p", "x &lt y &quot &#169; &mdash; &AMP; &amp;lt; &amp;amp;",
    "<p\nclass=a>b</p>&nbsp;&copy;&middot;&quot;<", "w" * 599 + " " + "x" * 9, "w" * 598 + "\u00a0 " + "x" * 9, "w" * 599 + "\x0b" + "x" * 9, "\U0001f926" * 600, "\U0001f926e\u0301" * 301, "&nbsp;" * 3, "<b>", "w &amp" * 200,
]


def odd_query(spark, folder, name, table):
    """A query and its SQL over the odd texts, as rows in order."""
    duckdb = pytest.importorskip("duckdb")
    column = {"pages": "page_id long, html string", "documents": "doc_id long, text string"}[table]
    spark.createDataFrame(list(enumerate(ODD_TEXTS)), column).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, catalogue.QUERIES[name](spark, str(folder)).collect())), sorted(c.execute(catalogue.SQL[name]).fetchall())


def test_html_text_decodes_what_its_sql_does(spark, tmp_path):
    got, want = odd_query(spark, tmp_path, "html_text", "pages")
    assert got == want and got[8] == (8, "Bleiner &amp p")


@pytest.mark.parametrize("name", ["collapse_text", "truncate_ellipsis"])
def test_blank_and_odd_texts_equal_their_sql(spark, tmp_path, name):
    got, want = odd_query(spark, tmp_path, name, "documents")
    assert got == want and got[1] == (1, "" if name == "truncate_ellipsis" else None)


def test_pages_reach_python_in_batches_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = spark.range(40).select("id", F.repeat(F.lit("x"), 500_000).alias("body")).coalesce(1)
    sizes = extraction._spread(pages, ["id"], lambda page: [{"n": sys._getframe(1).f_locals["batch"].nbytes}] * 3, "n long").collect()
    assert len(sizes) == 120 and max(r.n for r in sizes) <= BATCH_BYTES + 600_000
    links = "".join(f"<a href='/jobs/{i}'>A job with number {i}</a>" for i in range(5000))
    rows = extraction.listings(spark.createDataFrame([(links, "https://x.com", "", None)], "body string, page_url string, content_type string, parser string"))
    assert rows.where("url = concat('https://x.com/jobs/', pos) and title = concat('A job with number ', pos)").count() == 4900


def test_numbers(spark):
    rows = [("80",), ("high",), ("1,500.5",), ("12d",), ("1_000",), (" 7 ",), ("nan",), ("1__0",), (None,)]
    got = values(spark, as_number(F.col("v")), rows, "v string")
    assert got[:6] == [80.0, None, 1500.5, None, 1000.0, 7.0] and got[6] != got[6] and got[7:] == [None, None]
    assert values(spark, number_text(F.col("v")), [(75.0,), (0.5,), (1234.5678,), (-3.25,)], "v double") == ["75", "0.5", "1234.57", "-3.25"]


@pytest.mark.parametrize(("url", "ok"), [("https://www.x.com/jobs/12345", True), ("https://x.com/jobs/senior-dev", True), ("https://x.com/jobs", False), ("https://x.com/jobs/search/12345", False), ("https://x.com/view?jobid=123", True), ("https://x.com/view?id=123", False), ("https://x.com/jobs/dev?page=2", False), ("https://other.com/jobs/12345", False), ("https://eu.x.com/jobs/12345", True), ("ftp://x.com/jobs/12345", False), ("https://x.com/jobs/12345?q=", True), (None, False)])
def test_posting_urls(spark, url, ok):
    assert values(spark, is_posting_url(F.col("u"), F.lit("x.com")), [(url,)], "u string") == [ok]


def test_page_predicates(spark):
    assert values(spark, plausible_title(F.col("t")), [("Senior dev",), ("View all",), ("Dev",), ("a " * 22,)], "t string") == [True, False, False, False]
    assert values(spark, looks_like_json(F.col("b"), F.col("c")), [(" {", ""), ("x", "application/JSON"), ("<p>", "text/html")], "b string, c string") == [True, True, False]
    assert values(spark, is_login_page(F.col("u"), F.col("b")), [("https://x/sign-in", ""), ("https://x/jobs", "<input type='password'>"), ("https://x/jobs", "ok")], "u string, b string") == [True, True, False]


def greedy(rows, limit):
    seen, room, out = set(), {}, []
    for o, b, k in sorted(rows):
        if k not in seen and room.get(b, 0) < limit:
            seen.add(k)
            room[b] = room.get(b, 0) + 1
            out.append((o, b, k))
    return out


def test_greedy_quota_both_ways(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [(i, rng.choice("ABC"), rng.randint(0, 8)) for i in range(40)]
        limit = rng.randint(1, 4)
        df = spark.createDataFrame(rows, "ord int, bucket string, key int").repartition(3)
        want = greedy(rows, limit)
        assert sorted(map(tuple, collect.greedy_quota(df, "bucket", "key", "ord", limit).select("ord", "bucket", "key").collect())) == want
        assert sorted(map(tuple, collect.greedy_quota_fold(df, "bucket", "key", "ord", limit).collect())) == want
    assert collect.greedy_quota(df, "bucket", "key", "ord", 0).count() == 0


def test_interleave(spark):
    rows = [(0, 0, "a1"), (0, 1, "a2"), (0, 2, "a3"), (1, 0, "b1")]
    df = spark.createDataFrame(rows, "b int, o int, v string")
    turns = lambda n: [r.v for r in collect.interleave(df, "b", ["o"], n).orderBy("position").collect()]
    assert turns(10) == ["a1", "b1", "a2", "a3"] and turns(3) == ["a1", "b1", "a2"] and turns(0) == []


def check_rule(spark, rule, value, kind="string", other=None):
    df = spark.createDataFrame([(value, other)], f"f {kind}, days double")
    return list(rules.apply_rules(df, {"f": rule}).first().reasons)


def test_rules(spark):
    assert check_rule(spark, {"min": 75}, 75.0, "double") == [] and check_rule(spark, {"min": 75}, 74.0, "double") == ["f 74 is below the minimum 75"]
    assert check_rule(spark, {"min": 75}, "80") == [] and check_rule(spark, {"min": 75}, "N/A") == []
    assert check_rule(spark, {"min": 75}, "high") == ["f is not numeric (high)"]
    days = {"min": 2, "max": 3, "zero_is_unknown": True}
    assert [len(check_rule(spark, days, v, "double")) for v in (0.0, 1.0, 4.0, 2.0)] == [0, 1, 1, 0]
    pay = {"min_by": {"field": "days", "map": {"2": 8000, "3": 12000}, "default": 8000}}
    assert check_rule(spark, pay, 11000.0, "double", 3.0) and not check_rule(spark, pay, 8000.0, "double", 5.0)
    assert not check_rule(spark, {"allowed": ["On-site"]}, "  ON-SITE ") and check_rule(spark, {"allowed": ["On-site"]}, "On site")
    assert check_rule(spark, {"unknown_passes": False}, None) == ["f is not specified"]
    assert list(rules.apply_rules(spark.range(1), {"g": {"required": True}}).first().reasons) == ["g is missing from the assessment"]
    assert check_rule(spark, {"max_items": 1}, ["a", "b"], "array<string>") == ["f has 2 items, more than 1"] and not check_rule(spark, {"max_items": 1}, "ab")
    assert not check_rule(spark, {"min": 1}, float("nan"), "double")
    assert check_rule(spark, {"excludes_any": ["Java"]}, ["x java y"], "array<string>") == ["f contains Java"]
    with pytest.raises(rules.RuleError):
        rules.load_rules({"rules": {"a": 3}})
    assert rules.load_rules({"_note": "x", "a": {"min": 1}, "history_size": {"x": 1}}) == {"a": {"min": 1}}


def test_filter_entries_remember(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 9), (3, "a", 9), (4, None, 9), (5, None, 9), (6, "b", 9)], "o int, id string, n int")
    sent = spark.createDataFrame([("b",)], "job_id string")
    run = lambda **k: sorted(r.o for r in rules.filter_entries(df, {"n": {"min": 5}}, "id", ["o"], **k).collect())
    assert run(history=sent) == [2, 4, 5] and run(history=sent, remember=False) == [2, 3, 4, 5] and run() == [2, 4, 5, 6]


def test_history(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h", 2)
    assert len(h) == 0
    for x in ("a", "b", "a", "c"):
        h.add(spark.createDataFrame([(x, 0)], History.SCHEMA))
    assert [r.job_id for r in h.ids().orderBy("seq").collect()] == ["b", "c"] and "c" in h and "a" not in h
    rows = spark.createDataFrame([("a",), ("c",), (None,)], "job_id string")
    assert {r.job_id for r in h.fresh(rows).collect()} == {"a", None}
    h.resize(1)
    assert [r.job_id for r in h.ids().collect()] == ["c"]
    h.clear()
    assert len(h) == 0
    with pytest.raises(ValueError):
        History(spark, "x", 0)


def test_templates_and_answers():
    template = {"name": "who", "kind": "A | B", "n": "<int> a number, never 0", "tags": ["a tag"], "ok": True, "rate": 0.5}
    schema = templates.schema(template)
    assert [f.dataType for f in schema] == [T.StringType(), T.StringType(), T.LongType(), T.ArrayType(T.StringType(), False), T.BooleanType(), T.DoubleType()]
    assert schema["kind"].metadata["enum"] == ["A", "B"] and schema["n"].metadata["must_estimate"]
    good = {"tags": [], "name": "x", "kind": "A", "n": 1, "ok": False, "rate": 1}
    assert not templates.problems(good, template) and templates.unestimated(good | {"n": 0}, template) == ["n"]
    assert templates.problems(good | {"x": 1}, template) and templates.problems(good | {"name": " "}, template) and templates.problems([], template)
    assert list(templates.in_order(good, template)) == list(template)
    assert templates.read_answer("```json\n{\"a\": 1}\n```") == {"a": 1}
    with pytest.raises(templates.AnswerError):
        templates.read_answer("no")
    calls, slept = [], []

    def flaky(listing, t, attempt):
        calls.append(attempt)
        if len(calls) == 1:
            raise assess.CallError("busy", 503)
        return json.dumps(good | {"n": 0 if attempt == 0 else 5})

    assert assess.assess_one(flaky, {}, template, sleep=slept.append)["n"] == 5 and calls == [0, 0, 1] and slept == [5.0]
    assert assess.wait_before(assess.CallError("x", 429, retry_after=3.0), 0) == 4.0 and assess.wait_before(assess.CallError("x"), 9) == 90.0
    now = [0.0]
    pace = assess.Pace(10, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        pace()
    assert now[0] == 12.0


def test_listing_fields():
    assert extract.place({"jobLocationType": "telecommute"}) == "Remote"
    assert extract.place({"jobLocation": {"address": {"addressLocality": "Haifa", "addressCountry": {"name": "IL"}}}}) == "Haifa, IL"
    assert extract.pay({"currency": "ILS", "value": {"minValue": 1, "maxValue": 2, "unitText": "MONTH"}}) == "ILS 1-2 MONTH"
    assert extract.pay({"currency": "ILS", "value": {"minValue": 0}}) is None and extract.pay({"value": 5}) == "5" and extract.pay("x") == "x"
    rows = extract.from_json('{"jobs":[{"job_title":"A","link":"/1","employer":{"name":"E"},"pay":5},{"name":"B","url":"/1"},{"title":"no url"}]}', "https://x.com/s")
    assert rows == [{"title": "A", "url": "https://x.com/1", "description": None, "company": "E", "location": None, "posted": None, "salary": "5"}]
    assert extract.from_json("{", "x") == []


def test_boards():
    filler = "word " * 60
    page = f"<body><div><div class=c><a href='/UploadSingle.aspx?JobID=7'> Dev  one</a><a href='/Employer/HP/Default.aspx?cid=1'>Acme</a><a href='/SearchResultsGuest.aspx?x=1&city=3'>Haifa</a><p>Good work<p>123<p>{filler}</div><div><a href='/UploadSingle.aspx?JobID=8'>Two</a><p>{filler}2</div></div></body>"
    one, two = extract.board_a(page, "https://a.example/list")
    assert (one["title"], one["company"], one["location"], one["url"]) == ("Dev one", "Acme", "Haifa", "https://a.example/UploadSingle.aspx?JobID=7")
    assert one["description"].startswith("Good work word") and "123" not in one["description"] and two["company"] is None
    page = f"<div><h3><a href='/jobslobby/dev/12345/'>Dev</a></h3><p>מיקום: Haifa</p><p>{filler}</p></div>"
    (row,) = extract.board_b(page, "https://b.example")
    assert row["location"] == "Haifa" and row["company"] is None and row["description"].startswith("מיקום: Haifa word")


def test_links_of_unclosed_pages(spark):
    page = "<div class='side-bar'><a href='/jobs/11111'>In the sidebar</a></div><p><b>x<br><p><a href='/jobs/22222#f'>Data engineer</a><a href='/jobs/22222'>Same again</a>"
    df = spark.createDataFrame([(page, "https://www.x.com/list", None, None)], "body string, page_url string, content_type string, parser string")
    assert [(r.title, r.url) for r in extraction.listings(df).collect()] == [("Data engineer", "https://www.x.com/jobs/22222")]
    assert extraction.listings(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [("abcde", ["abcde"]), ("ab\ncd\nef", ["ab", "cd", "ef"]), ("abcdefg", ["abcde", "fg"]), ("\n\n\n\n\n\n", [])])
def test_chunks(text, want):
    assert delivery.chunks(text, 5) == want


def test_chunks_keep_all_lines():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 60)))
        found = delivery.chunks(text, 7)
        assert all(len(c) <= 7 for c in found)
        assert "".join("".join(found).split()) == "".join(text.split())


def test_rendering_and_sending(spark):
    assert list(delivery.lines({"a_b": 1, "c": {"d": None}, "e": [True, {"f": "<"}], "g": []})) == ["<b>A b:</b> 1", "<b>C</b>", "  <b>D:</b> —", "<b>E</b>", "  • yes", "    <b>F:</b> &lt;", "<b>G</b>", "  —"]
    assert delivery.heading({"title": "T"}, {"company_name": "Not specified"}) == "T"
    sent = []
    assert delivery.send(sent.append, "1", "a\nb", ("Open", "u")) == delivery.SENT and sent[0]["button"]["url"] == "u"

    def raising(error):
        def channel(payload):
            raise error

        return channel

    assert delivery.send(raising(delivery.Uncertain("?")), "1", "x") == delivery.UNCERTAIN
    assert delivery.send(raising(delivery.SendError("no")), "1", "x") == delivery.FAILED
    slept = []
    assert delivery.send(raising(delivery.Retry("down", 2.0)), "1", "x", sleep=slept.append) == delivery.FAILED and slept == [2.0, 2.0]


def test_requests_and_reader(spark):
    sites = sites_table(spark, [Site("A", "https://a/{query}?p={page}"), Site("B", "https://b/?p={page}"), "https://c/?q={query}"])
    rows = request_table(sites, terms_table(spark, ["c++ dev", "x"]), 2).collect()
    assert len(rows) == 4 + 2 + 4 and "https://a/c%2B%2B+dev?p=1" in {r.url for r in rows}
    with pytest.raises(ValueError):
        as_site("https://x")
    with pytest.raises(ValueError):
        Site("A", "x", headers={"Cookie": "1"})
    now, slept = [0.0], []
    pages = {"https://a/robots.txt": (200, "User-agent: *\nDisallow: /no"), "https://a/1": (200, "hi"), "https://a/2": (403, "")}
    transport = lambda u, h: (u, pages[u][0], "t", pages[u][1])
    reader = Reader(transport, clock=lambda: now[0], sleep=slept.append)
    allowed = robots_rules(["https://a/1", "https://a/2"], transport)
    assert list(allowed) == ["https://a"] and allowed["https://a"]("https://a/1") and not allowed["https://a"]("https://a/no/x") and reader.get("https://a/1") == ("hi", "t")
    pages["https://b/robots.txt"] = (404, "User-agent: *\nDisallow: /")

    def down(url, headers):
        raise OSError(url)

    assert robots_rules(["https://b/x"], transport)["https://b"]("https://b/x") and robots_rules(["https://c/x"], down)["https://c"]("https://c/x")
    with pytest.raises(ValueError):
        reader.get("https://a/1", {"Authorization": "x"})
    with pytest.raises(LoginWall):
        reader.get("https://a/2")
    assert slept == [1.0]
    spark.dataSource.register(PagesDataSource)
    asked = json.dumps([{"url": "https://a/1"}, {"url": "https://b/2"}])
    got = {r.page_url: (r.body, r.error) for r in spark.read.format("public_pages").option("requests", asked).option("bodies", json.dumps({"https://a/1": "<p>x"})).load().collect()}
    assert got["https://a/1"] == ("<p>x", None) and got["https://b/2"][0] is None and "404" in got["https://b/2"][1]


def test_two_cycles_send_once(spark, tmp_path):
    link = lambda n: f"<div><a href='/jobs/{n}'>Position number {n}</a></div>"
    sites = sites_table(spark, [Site("A", "https://a.example/jobs/list?q={query}&p={page}"), Site("B", "https://b.example/all")])
    asked = request_table(sites, terms_table(spark, ["dev"]), 1)
    pages = spark.createDataFrame([("https://a.example/jobs/list?q=dev&p=1", link(11111) + link(22222) + link(33333), ""), ("https://b.example/all", link(44444), "")], "page_url string, body string, content_type string")
    found = cycle.scan(asked, pages, 2, 2)
    assert [r.url for r in found.orderBy("position").collect()] == ["https://a.example/jobs/11111", "https://b.example/jobs/44444", "https://a.example/jobs/22222"]
    history, sent = History(spark, f"file://{tmp_path}/history", 700), []
    template = {"job_title": "the title", "match_score": "<int> 0-100, never 0", "skills": ["one"]}
    write = lambda name, df: df.checkpoint()
    run = lambda channel: cycle.run_cycle(found, history, {"match_score": {"min": 1}}, template, assess.offline, channel, "1", write)
    assert run(None)["passed"] == 3 and len(history) == 0
    assert run(sent.append) == {"found": 3, "old": 0, "duplicates": 0, "fresh": 3, "assessed": 3, "passed": 3, "sent": 3} and len(sent) == len(history) == 3
    assert run(sent.append)["fresh"] == 0 and len(sent) == 3
    assert sent[0]["text"].startswith("<b>") and sent[0]["button"]["url"] == "https://a.example/jobs/11111"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "position int, title string")
    rows.write.parquet(f"{tmp_path}/in")
    seen = []
    q = cycle.stream_cycles(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), lambda b: seen.append(b.count()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert sum(seen) == 2
    stop, turns = __import__("threading").Event(), []

    def once():
        turns.append(1)
        stop.set()
        raise RuntimeError("kept going")

    cycle.run_forever(once, 24, stop, signals=False)
    assert turns == [1]
    env = {"A": "shell"}
    (tmp_path / ".env").write_text("# c\nA=file\nexport B='x y'\n")
    assert cycle.read_env(str(tmp_path / ".env"), env) == {"A": "shell", "B": "x y"}
    assert cycle.missing_settings(["A", "Z"], ["/none"], env) == ["Z is not set", "/none not found"]


def test_history_reads_json_forms(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h", 3)
    (tmp_path / "list.json").write_text('["a", "b", "a", "", 7, "c", "d"]')
    (tmp_path / "object.json").write_text('{"size": 9, "ids": ["x", "y"]}')
    (tmp_path / "bad.json").write_text("{")
    h.load_json(f"file://{tmp_path}/list.json")
    assert list(h) == ["b", "c", "d"] and "3 of 3" in repr(h)
    h.load_json(f"file://{tmp_path}/none.json")
    assert list(h) == ["b", "c", "d"]
    h.load_json(f"file://{tmp_path}/object.json")
    assert json.loads(h.json()) == {"size": 3, "ids": ["x", "y"]}
    h.load_json(f"file://{tmp_path}/bad.json")
    assert list(h) == []


def test_channel_outcomes():
    def answering(*answers):
        left = list(answers)

        def post(url, data):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return delivery.http_channel("https://chat.example/send", post)

    slept = []
    run = lambda *answers: delivery.send(answering(*answers), "1", "x", sleep=slept.append)
    assert run((200, '{"ok": true}')) == delivery.SENT
    assert run(ConnectionError("no route"), (200, "")) == delivery.SENT and slept == [1.0]
    assert run((429, '{"parameters": {"retry_after": 7}}'), (200, "{}")) == delivery.SENT and slept[-1] == 7.0
    assert run(TimeoutError()) == delivery.UNCERTAIN and run((502, "")) == delivery.UNCERTAIN
    assert run((403, "blocked")) == delivery.FAILED and run((200, '{"ok": false}')) == delivery.FAILED
    sent = []
    entries = [({"title": "A", "url": "u"}, {"n": 1}), ({"title": "B"}, {"n": 2})]
    assert delivery.send_all(sent.append, "1", entries, {"n": "Number"}, sleep=slept.append) == [delivery.SENT] * 2 and "Number" in sent[0]["text"]

    def refuse(payload):
        raise delivery.SendError("no")

    assert delivery.send_all(refuse, "1", entries) == [delivery.FAILED] * 2
    with pytest.raises(delivery.SendError):
        delivery.send_all(refuse, "1", entries, skip_failures=False)


def test_model_over_http(spark, tmp_path):
    template = {"kind": "A | B", "n": "<int> never 0"}
    calls = []

    def post(url, headers, body):
        calls.append((headers, json.loads(body)))
        if len(calls) == 1:
            return 429, '{"error": {"status": "RESOURCE_EXHAUSTED", "message": "Please retry in 2.5s."}}'
        return 200, json.dumps({"text": json.dumps({"n": 3, "kind": "A"})})

    model = assess.HttpAssessor("https://model.example", "a job", "key", b"%PDF-1", "Haifa", post)
    slept = []
    assert list(assess.assess_one(model, {"title": "T"}, template, sleep=slept.append).items()) == [("kind", "A"), ("n", 3)] and slept == [3.5]
    headers, sent = calls[1]
    assert headers["Authorization"] == "Bearer key" and "a job" in sent["prompt"] and "Haifa" in sent["prompt"] and sent["document"]["type"] == "application/pdf"
    with pytest.raises(templates.ConfigError):
        assess.assess_one(assess.HttpAssessor("https://m", "x", post=lambda *a: (403, "")), {}, template)
    with pytest.raises(templates.ConfigError):
        assess.HttpAssessor("", "x")
    assert assess.stated_delay('"retryDelay": "12s"') == 12.0 and assess.stated_delay("retry after 300 ms") == 0.3 and assess.stated_delay("later") is None
    (tmp_path / "cv.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "cv.txt").write_bytes(b"text")
    assert assess.read_pdf(spark, f"file://{tmp_path}/cv.pdf") == b"%PDF-1.7 x"
    for path, most in (("cv.txt", 100), ("cv.pdf", 5)):
        with pytest.raises(templates.ConfigError):
            assess.read_pdf(spark, f"file://{tmp_path}/{path}", most)


def test_checks_as_columns_equal_plain_ones(spark):
    template = {"name": "who", "n": "<int> never 0", "tags": ["a tag"]}
    answers = [{"name": "x", "n": 1, "tags": []}, {"name": " ", "n": 0, "tags": "no"}, {"name": "x", "n": 0.0}, {"name": None, "n": 2, "tags": [], "more": 1}]
    df = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(answers)], "i int, a string")
    got = {r.i: (r.p, r.u) for r in df.select("i", templates.answer_problems(F.col("a"), template).alias("p"), templates.answer_unestimated(F.col("a"), template).alias("u")).collect()}
    for i, a in enumerate(answers):
        assert len(got[i][0]) == len(templates.problems(a, template)) and got[i][1] == templates.unestimated(a, template), a
    nested = {"a": {"b": "<int> never 0", "c": [{"d": "x"}]}, "e": []}
    good = {"e": [1], "a": {"c": [{"d": "q"}, {"d": "r"}], "b": 0}}
    assert json.dumps(templates.in_order(good, nested)) == '{"a": {"b": 0, "c": [{"d": "q"}, {"d": "r"}]}, "e": [1]}'
    assert templates.unestimated(good, nested) == ["a.b"] and not templates.problems(good, nested)
    assert templates.problems({"a": {"b": 1, "c": [{"d": ""}, 3]}, "e": {}}, nested) == ["a.c[1]: not an object", "a.c[0].d: empty", "e: not an array"]


def test_scan_stops_full_buckets(spark):
    link = lambda n: f"<div><a href='/jobs/{n}'>Position number {n}</a></div>"
    bodies = {f"https://a.example/q={t}&p={p}": "".join(link(10000 * p + 1000 * i + j) for j in range(3)) for p in (1, 2) for i, t in enumerate(("x", "y"))} | {"https://b.example/all": link(70000)}
    sites = [Site("A", "https://a.example/q={query}&p={page}"), Site("B", "https://b.example/all")]
    asked = []
    write = lambda name, df: (asked.append(name), df.checkpoint())[1]
    got = cycle.collect_sites(spark, sites, ["x", "y"], 4, 2, {"bodies": json.dumps(bodies)}, write).orderBy("position").collect()
    assert [r.url for r in got] == ["https://a.example/jobs/10000", "https://b.example/jobs/70000", "https://a.example/jobs/10001", "https://a.example/jobs/10002", "https://a.example/jobs/11000"]
    # The first site is full after two pages; the second gives its page once.
    assert [n for n in asked if n.startswith("pages")] == ["pages-1-0", "pages-1-1", "pages-2-0"]
    assert cycle.collect_sites(spark, sites, "x", 0).count() == 0
    assert len(defaults.SITES) == 7 and len(defaults.TERMS) == 8 and {s.parser for s in defaults.SITES} <= set(extract.PARSERS)


def test_checkpoint_sink_goes_on_only_when_told(spark):
    df = spark.range(3)
    assert cycle.checkpoint_sink("rows", df, lambda q: "True").count() == 3
    with pytest.raises(SystemExit):
        cycle.checkpoint_sink("rows", df, lambda q: "yes")
