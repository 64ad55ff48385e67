from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gleanframe.llm import decontaminate as module
from gleanframe.llm.decontaminate import decontaminate, drop_leaks, tiles

from .odd import odd_documents


def plain_tiles(item, doc, least):
    """Greedy tiling without hashing: the longest free common run, again and again."""
    fi, fd, out = [True] * len(item), [w != 0 for w in doc], []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and fi[p + n] and fd[q + n] and item[p + n] == doc[q + n]:
                    n += 1
                if n > best[2]:
                    best = (p, q, n)
        if best[2] < least:
            return out
        p, q, n = best
        fi[p : p + n] = fd[q : q + n] = [False] * n
        out.append(best)


def test_tiles_equal_plain_greedy():
    rng = random.Random(5)
    for _ in range(300):
        item = [rng.randint(1, 6) for _ in range(rng.randint(0, 14))]
        doc = [rng.randint(0, 6) for _ in range(rng.randint(0, 30))]
        assert tiles(item, doc, 3) == plain_tiles(item, doc, 3)


@pytest.mark.parametrize("words", [300, 3000])
def test_repetitive_texts_take_little_time(words):
    began = time.process_time()
    assert tiles([7] * words, [7] * 3000, 5) == [(0, 0, words)]
    assert sum(n for _, _, n in tiles([7, 8] * (words // 2), [7] * 1000 + [0] + [8, 7] * 1000, 5)) >= min(words, 2000) - 1
    assert time.process_time() - began < 5


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: words(rng.randint(3, 40)) for i in range(30)}
    docs = []
    for i in range(200):
        text = words(rng.randint(0, 120))
        if i % 3 == 0:
            w = items[i % 30]
            cut = rng.randint(0, len(w))
            part = [w, w[cut:] + ["and"] + w[:cut], w[: len(w) // 3], [x.upper() + "!!" for x in w]][i % 4]
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((i, " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None), (98, " .. "), (None, "a b c")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, list(r["items"]), round(r.coverage, 9)) for r in decontaminate(frame, bench).collect()}
    for i, text in docs:
        w = re.findall(r"\w+", text.lower())
        shares = {j: sum(n for _, _, n in plain_tiles(v, w, min(5, len(v)))) / len(v) for j, v in items.items()}
        leaked = {j: s for j, s in shares.items() if s >= 0.5}
        assert got[i] == (len(w), sorted(leaked), round(max(leaked.values(), default=0), 9)), text


@pytest.mark.parametrize("bits", [10, 24])
def test_odd_tables_and_small_bit_tables(spark, monkeypatch, bits):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, "three four five six"), (2, "word1 word2 word3 word4 word5 word6"), (3, "nothing of the sort here")], "item_id long, text string")
    monkeypatch.setattr(module, "FILTER_BITS", bits)
    rows = decontaminate(docs, bench).collect()
    assert len(rows) == docs.count() and all(r.contaminated == bool(r["items"]) for r in rows)
    assert {i for r in rows for i in r["items"]} == {1, 2}
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_items_of_one_id_or_none_stand_each_for_itself(spark):
    docs = spark.createDataFrame([(1, "the first item has these seven words"), (2, "but another text stands under the same"), (3, "and this one has no id at all"), (4, "clean as it is in every way"), (1, "also clean under an id used twice")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "First item has these SEVEN words!"), (1, "another text stands under the same"), (None, "this one has no id at all")], "item_id long, text string").withColumn("doc_id", F.lit(5)).withColumn("n_words", F.lit("clash"))
    got = sorted((r.doc_id, r["items"], r.contaminated) for r in decontaminate(docs, bench).collect())
    assert got == [(1, [], False), (1, [1], True), (2, [1], True), (3, [], True), (4, [], False)]
    clash = docs.withColumn("row_id", F.lit(1)).withColumn("t", F.lit("x")).withColumn("n.words", F.lit(2))
    left = drop_leaks(clash, bench)
    assert left.columns == clash.columns and sorted((r.doc_id, r.text[:5]) for r in left.collect()) == [(1, "also "), (4, "clean")]


def test_a_long_text_is_scanned_whole(spark):
    words = [f"x{i % 5003}" for i in range(200_000)]
    item = [f"leak{i}" for i in range(30)]
    text = " ".join(words[:199_000] + item[15:] + words[199_000:] + item[:15])
    assert len(text) > 1_000_000
    got = decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).first()
    assert (got.n_words, got["items"], got.coverage) == (200_030, [9], 1.0)
