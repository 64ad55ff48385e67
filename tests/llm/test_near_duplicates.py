from __future__ import annotations

import random

import numpy as np

from gleanframe.llm import minhash

from .test_pipeline import groups


def dense_families(seed: int, families: int) -> dict[int, str]:
    """Families of texts of 6 to 14 words: runs of one text, some with a word more or another at an end."""
    rng = random.Random(seed)
    texts: list[str] = []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(14)]
        for _ in range(14):
            n = rng.randint(6, 13)
            at = rng.randint(0, 14 - n)
            words = base[at : at + n]
            if rng.random() < 0.6:
                words = words[: n - rng.randint(0, 1)] + [f"f{f}x{rng.randint(0, 5)}"]
            texts.append(" ".join(words))
    return dict(enumerate(dict.fromkeys(texts)))


def test_dense_families_of_short_texts_equal_brute_force(spark, monkeypatch):
    # Without the rounds of likeliest partners the last one has to find all that leaders leave.
    monkeypatch.setattr(minhash, "BEST_ROUNDS", 0)
    texts = dense_families(11, 40)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == groups(texts, 4)


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    dropped = 0
    for _ in range(4000):
        common, left, right = int(rng.integers(1, 900)), *rng.integers(0, 60, 2).tolist()
        h = rng.integers(0, 1 << 64, common + left + right, dtype=np.uint64)
        s, t = h[: common + left], np.concatenate([h[:common], h[common + left :]])
        linked = 100 * common >= 80 * len(h)
        may = bool(minhash.can_link(len(s), len(t), minhash.parity(s), minhash.parity(t), 80))
        assert may or not linked
        dropped += not may
    assert dropped > 300


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "a"), (1, long, "b"), (1, long + " more", "c"), (2, long, "d"), (3, "quite another text of some length", "e"), (3, "and a second text under one id", "f"), (4, "", "g"), (4, None, "h"), (None, "no id " + long[::-1], "i"), (None, "no id " + long[::-1], "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `source.x` string").repartition(3)
    got = minhash.drop_near_duplicates(docs, 4)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert sum(r[0] == 1 for r in kept) == 1 and not any(r[0] == 2 for r in kept)
    assert {r[2] for r in kept if r[0] in (3, 4)} == set("efgh") and sum(r[0] is None for r in kept) == 1
    assert minhash.drop_near_duplicates(docs.limit(0)).count() == 0
