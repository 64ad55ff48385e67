from __future__ import annotations

import re
import time

import pytest

from pyspark.sql import functions as F

from gleanframe.llm import html_text
from gleanframe.llm.html_text import extract, main_text


def test_long_texts_of_the_template_are_dropped_in_a_marked_element(spark):
    advert = "Our great winter sale has begun and everything in the whole store is now half price."
    page = lambda i: f"<body><article><h1>Story {i}</h1><div class=box><p>{advert}</p></div><p>Story {i} has a long text of its own that no other page of the host has, {i}.</p></article></body>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(12)] + [(100, "https://one.example/", page(100))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    own = lambda i: f"Story {i} has a long text of its own that no other page of the host has, {i}."
    assert all(got[i] == f"Story {i}\n{own(i)}" for i in range(12))
    assert got[100] == f"Story 100\n{advert}\n{own(100)}"


WORDS = " ".join(f"w{i}" for i in range(50))
UNMARKED = [
    ("<body><div class=post><h1>Title</h1><div class=text><p>One two three.</p><p>Four five six.</p></div></div>", "Title\nOne two three.\nFour five six."),
    (f"<body><div class=post><div class=first><p>{WORDS}</p></div><div class=second><p>The shorter part.</p></div></div>", f"{WORDS}\nThe shorter part."),
    (f"<body><h1>Title</h1><p>A short lead.</p><div class=first><p>{WORDS}</p></div><div class=second><p>The rest.</p></div>", f"Title\nA short lead.\n{WORDS}\nThe rest."),
    (f"<body><div class=post><p>Ten words that come before a list of many items.</p><ul><li>{WORDS}</ul></div>", f"Ten words that come before a list of many items.\n{WORDS}"),
    (f"<body>A text that stands loose but has more than eight words.<div class=post><p>{WORDS}</p></div><div>Label</div>", f"A text that stands loose but has more than eight words.\n{WORDS}"),
    ("<body>Alone", "Alone"),
]


@pytest.mark.parametrize(("page", "want"), UNMARKED)
def test_all_slots_of_an_unmarked_page_stay(page, want):
    assert main_text(page, set(), set()) == want


DEEP = [
    ("<div>" * 100_000 + "x y z", "x y z"),
    ("<a " * 350_000, None),
    ('<a "' * 250_000, None),
    ('<a "x>"' * 150_000, None),
    ("<b>" * 50_000 + "<div></div>" * 50_000, ""),
    ("<p>" * 50_000 + "</x>" * 100_000 + "end", "end"),
    ("<" * 300_000, None),
    ("<p>one two " * 50_000, "\n".join(["one two"] * 50_000)),
    ("&#" + "9" * 5000 + "; and &#0000065;", "\ufffd and A"),
]


@pytest.mark.parametrize(("page", "want"), DEEP)
def test_odd_pages_take_little_time(page, want):
    began = time.process_time()
    got = main_text(page, set(), set())
    assert want is None or got == want
    assert time.process_time() - began < 20


RAW = [
    ("<main><title-bar>x</title-bar><p>The real article.</main>", "x\nThe real article."),
    ("<main><button-group>x</button-group><p>The real article.</main>", "x\nThe real article."),
    ("<main><template-x>x</template-x><p>The real article.</main>", "x\nThe real article."),
    ("<main><button>no</button><SCRIPT>if (a < b) {'</p>'}</SCRIPT ><p>The real article.<script>", "The real article."),
    ("<main><p>a &lt;b&gt; c < d > e<br>f<!-- g --> h<p title='x > y'>i</main>", "a <b> c < d > e f h\ni"),
]


@pytest.mark.parametrize(("page", "want"), RAW)
def test_only_raw_elements_are_left_out(page, want):
    assert main_text(page, set(), set()) == want


def site(host: int, pages: int) -> list[tuple[int, str, str, str]]:
    """Pages of one generated layout without any telling name: a menu, a notice, an advert that varies, the article's box, a foot."""
    rows = []
    for i in range(pages):
        own = [f"Paragraph {j} of page {i} on host {host} says things that no other page says, number {i * 7 + j}." for j in range(2 + i % 4)]
        menu = "".join(f"<li><a href='/{k}'>Part {k}</a>" for k in range(4 + i % 3))
        box = f"<div class=k3><h1>Head {host} {i}</h1><div class=k4>{''.join(f'<p>{p}' for p in own)}<p>Subscribe to everything that we write here, week by week.</div></div>"
        html = f"<html><body><div class=k1><ul>{menu}</ul></div><div class=k2>Buy thing {i * 13 % 17} today</div>{box}<div class=k5>All rights with host {host}</div></body></html>"
        rows.append((host * 1000 + i, f"https://h{host}.example/{i}", html, "\n".join([f"Head {host} {i}", *own])))
    return rows


def test_the_template_alone_finds_the_article(spark):
    rows = site(1, 12) + site(2, 30) + site(3, 5)
    docs = spark.createDataFrame([r[:3] for r in rows] + [rows[0][:3], (7, None, None), (8, None, "")], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("token", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in extract(docs.repartition(5)).collect()]
    want = [(r[0], r[3], len(r[3])) for r in rows]
    assert sorted(got) == sorted([*want, want[0], (7, "", 0), (8, "", 0)])
    assert extract(docs.limit(0)).count() == 0


def plain_slot(pages: list[str]) -> str | None:
    """Brute force: of the paths that each page has once, the innermost with most of the words outside links, as a list of tags."""
    seen: list[dict[str, list[int]]] = []
    for page in pages:
        at, count = [], {}
        for m in re.finditer(r"<(/?)(\w+)(?: class=(\w+))?[^>]*>|([^<]+)", page):
            if m[4]:
                for k in range(len(at) + 1):
                    count["/".join(at[:k])][1] += 0 if "a" in [x.split(".")[0] for x in at] else len(m[4].split())
            elif m[1]:
                while at and at.pop().split(".")[0] != m[2]:
                    pass
            else:
                if m[2] in ("p", "li") and at and at[-1] == m[2]:
                    at.pop()
                at.append(m[2] + ("." + m[3] if m[3] else ""))
                count.setdefault("/".join(at), [0, 0])[0] += 1
            count.setdefault("", [1, 0])
        seen.append(count)
    once = [p for p in seen[0] if all(c.get(p, [0])[0] == 1 for c in seen)]
    total = {p: sum(c[p][1] for c in seen) for p in once}
    most = [p for p in once if 2 * total[p] > total[""]]
    return max(most, key=lambda p: p.count("/"))


def test_the_slot_equals_brute_force(spark):
    for host in (1, 2):
        rows = site(host, 10)
        pages = [r[2].replace("<body>", "<body><div></div>") for r in rows]
        assert plain_slot(pages).endswith("div.k3/div.k4")
        found = html_text.tokens_of(spark.createDataFrame([(r[1], p) for r, p in zip(rows, pages, strict=True)], "url string, html string"))
        slot = html_text.templates(found).first().slot
        # The slot grows by the box that holds the heading.
        path = 0
        for mark in ("html", "body", "div.k3#"):
            path = html_text._under(path, mark)
        assert slot == path
