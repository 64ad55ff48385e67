from __future__ import annotations

import hashlib
import random
import re
import struct
import unicodedata
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from gleanframe.llm import fingerprints, sharding
from gleanframe.llm.common import Scratch
from gleanframe.llm.fingerprints import canonical, fingerprint_report
from gleanframe.llm.sharding import balanced_shards

from .odd import odd_documents


def canon(text: str) -> str:
    n = unicodedata.normalize
    low = n("NFKC", n("NFKC", text).casefold())
    return re.sub("[\t-\r \x85\xa0  -     　]+", " ", low).strip(" ")


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canon(text) == canon(edited)), float(canon(text) == canon(follow)))
    return out


def test_fingerprints_equal_brute_force(spark):
    rows = {r.doc_id: r.text or "" for r in odd_documents(spark).where("doc_id is not null").collect()}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = fingerprint_report(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == brute(list(rows.items()))
    by = defaultdict(set)
    for r in got:
        by[r.fingerprint].add(canon(rows[r.doc_id]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({canon(t) for t in rows.values()})
    assert {r[0] for r in docs.select(canonical(docs.text)).collect()} == {canon(t) for t in rows.values()}


def test_fingerprints_take_odd_tables(spark):
    docs = odd_documents(spark)
    assert fingerprint_report(docs).count() == docs.count()
    assert fingerprint_report(docs.limit(0)).count() == 0
    one = fingerprint_report(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_different_texts_in_one_bucket_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda c: fingerprints.F.lit("same"))
    got = {r.doc_id: r.fingerprint for r in fingerprint_report(spark.createDataFrame([(1, "a"), (2, "b"), (3, " A ")], "doc_id long, text string")).collect()}
    assert got[1] == got[3] != got[2]


def test_shards_are_even_and_keep_copies_together(spark):
    # 200 groups of four copies, one of 120, and 80 texts without a copy.
    rows = [(i, None if i >= 920 and i % 2 else f"text {i // 4 if i < 800 else 'large' if i < 920 else i}") for i in range(1000)]
    got = balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == 1000 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    shard = {r.doc_id: r.shard for r in got}
    whole = sum(len({shard[i + j] for j in range(4)}) == 1 for i in range(0, 800, 4))
    assert whole >= 150  # by chance about none would be
    assert {r.doc_id: r.size for r in got} == {i: len(t or "") + 16 for i, t in rows}


def test_shards_take_odd_tables(spark):
    docs = odd_documents(spark)
    assert balanced_shards(docs).count() == docs.count()
    assert balanced_shards(docs.limit(0)).count() == 0
    links = spark.createDataFrame([(3, 24), (24, 30), (None, 3)], "a long, b long")
    assert balanced_shards(docs, shards=3, links=links).count() == docs.count()


def test_next_texts_form_one_round_where_an_id_is_hot(spark):
    rows = [(i, f"t{i}") for i in range(60)] + [(30, f"hot {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)]
    got = fingerprints.add_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).collect()
    follow, ids = {r.text: r.next for r in got}, {t: i for i, t in rows}
    assert len(got) == len(rows) == len(follow)
    at, seen = "t59", []
    for _ in rows:
        seen.append(at)
        at = follow[at]
    assert at == "t59" and len(set(seen)) == len(rows)
    order = [-1 if ids[t] is None else ids[t] for t in seen]
    assert order == sorted(order, reverse=True)


def test_ranges_never_share_a_task(spark):
    keys = fingerprints.spread_keys(spark, 37)
    rows = spark.createDataFrame([(k,) for k in keys], "range long").repartition(37, "range").select("range", F.spark_partition_id().alias("p")).collect()
    assert {r.range: r.p for r in rows} == {k: p for p, k in enumerate(keys)}


def h64(value: int, bits: int = 64, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<q" if bits == 64 else "<i", value), seed=seed)


def plain_propagation(nodes, links, shards, rounds):
    """Label propagation under quotas, node by node."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    at = {x: signed(h64(x)) % shards for x in nodes}
    both = [*links, *((b, a) for a, b in links)]
    for i in range(1, rounds + 1):
        near = defaultdict(Counter)
        least = {}
        for a, b in both:
            near[a][at[b]] += 1
            least[a] = min(b, least.get(a, b))
        wish = {}
        for a, seen in near.items():
            there = max(seen, key=lambda s: (seen[s], -s))
            most, total = seen[there], sum(seen.values())
            if most > seen[at[a]] and 2 * most > total and (total > 1 or least[a] < a):
                wish[a] = there
        has, come, leave = Counter(at.values()), Counter(wish.values()), Counter(at[a] for a in wish)
        share = {s: min(1.0, max(0.0, (len(nodes) / shards - has[s] + min(leave[s], n)) / n)) for s, n in come.items()}
        at |= {a: s for a, s in wish.items() if signed(h64(i, 32, h64(a))) % 1_000_000 < share[s] * 1_000_000}
    return at


def test_propagation_equals_plain_propagation(spark):
    rng = random.Random(8)
    nodes = list(range(0, 600, 2))
    links = sorted({(a, b) for a, b in ((rng.choice(nodes[:60] if rng.random() < 0.4 else nodes), rng.choice(nodes)) for _ in range(500)) if a != b})
    frame = spark.createDataFrame([(x,) for x in nodes], "node long")
    got = sharding.propagate(Scratch(spark, "t"), frame, spark.createDataFrame(links, "a long, b long"), 5, 3).collect()
    assert {r.node: r.shard for r in got} == plain_propagation(nodes, links, 5, 3)


def test_copies_hang_in_a_tree_of_bounded_degree(spark):
    nodes = spark.createDataFrame([(i, 0 if i < 3000 else i // 2) for i in range(3200)], "node long, g long")
    links = [(r.a, r.b) for r in sharding.copy_links(Scratch(spark, "t"), nodes, "g", block=8).collect()]
    up = dict(links)
    assert len(up) == len(links) and all(b < a for a, b in links)

    def top(x):
        while x in up:
            x = up[x]
        return x

    assert {top(i) for i in range(3000)} == {0} and all(top(i) == i // 2 * 2 for i in range(3000, 3200))
    assert max(Counter(b for _, b in links).values()) <= 100
