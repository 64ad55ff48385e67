from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gleanframe.llm.minhash import near_duplicates
from gleanframe.llm.pii import PATTERN, assign, pseudonymize
from gleanframe.llm.common import Scratch
from gleanframe.llm import pii as pii_module

from .odd import odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(texts: dict[int, str | None], k: int):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    while True:
        before = dict(comp)
        for i in sets:
            for j in sets:
                if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def texts_with_groups():
    base = [f"w{i}" for i in range(100)]
    texts: dict[int, str | None] = {100 + i: " ".join(base[:i] + ["new"] + base[i + 1 :]) for i in range(0, 90, 9)}
    chain = list(base)
    for i in range(12):  # neighbours are near, ends are not
        chain = chain[4:] + [f"c{i}{j}" for j in range(4)]
        texts[i] = " ".join(chain)
    shared = " ".join(f"s{i}" for i in range(50))
    texts |= {200 + i: shared + " " + " ".join(f"u{i}x{j}" for j in range(30)) for i in range(20)}
    texts |= {300: None, 301: "", 302: "a b", 303: "A  b", 304: "a b c d", 305: " ".join(base).upper(), 306: "a b c d"}
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_groups_equal_brute_force(spark, k):
    texts = texts_with_groups()
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == groups(texts, k)


def test_groups_take_odd_tables(spark):
    docs = odd_documents(spark)
    assert near_duplicates(docs).count() == docs.count()
    assert near_duplicates(docs.limit(0)).count() == 0


def test_surrogates_keep_form_and_identity(spark):
    texts = {
        1: "Mail anna.k@mail7.example.com or ANNA.K@firm.de, +1 (017) 555-7713; card 9807915762804490 and 4845168114407329.",
        2: "anna.k@mail7.example.com from 97.51.17.173. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"",
        3: "Mrs. Smith met Mr. John Miller and г-жа Иванова; SSN 123-45-6789, DE89370400440532013000",
        4: None,
        5: "",
        6: "Nothing here: 3.5, 12.10.2020, version 1.2.3, 1234.",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, row string")
    rows = pseudonymize(docs, "k", count="n", kinds="kinds").collect()
    got = {r.doc_id: r.text for r in rows}
    assert {i: got[i] for i in (4, 5, 6)} == {i: texts[i] for i in (4, 5, 6)}
    assert {r.doc_id: r.n for r in rows} == {1: 5, 2: 3, 3: 5, 4: 0, 5: 0, 6: 0} and all(r.row == "x" for r in rows)
    mail = re.findall(r"\S+@\S+\b", got[1])[0]
    assert got[2].startswith(mail + " from ") and "anna" not in got[1] + got[2]
    assert re.search(r"or [A-Z]+\.[A-Z]@\S+, \+1 \(\d{3}\) \d{3}-\d{4}; card 9\d{15} and 4\d{15}\.$", got[1])
    assert re.search(r'^\S+ from 10\.\d+\.\d+\.\d+\. token = "[0-9a-f]{40}"$', got[2])
    assert re.search(r"^Mrs\. [A-Z][a-z]+ met Mr\. [A-Z][a-z]+ [A-Z][a-z]+ and г-жа [А-Я][а-я]+а; SSN 9\d\d-\d\d-\d{4}, DE\d{20}$", got[3]), got[3]
    assert {r.doc_id: r.text for r in pseudonymize(docs, "k").collect()} == got != {r.doc_id: r.text for r in pseudonymize(docs, "other").collect()}
    assert "Smith" not in got[3] and "Miller" not in got[3]


def test_collisions_are_resolved(spark, monkeypatch):
    monkeypatch.setattr(pii_module, "surrogate", lambda canon, of, form, key, attempt: pii_module.F.concat(pii_module.F.lit("s"), pii_module.F.pmod(pii_module.F.xxhash64(canon, pii_module.F.lit(attempt)), pii_module.F.lit(60)).cast("string")))
    entities = spark.createDataFrame([(f"e{i}", "email", "") for i in range(40)] + [("s7", "email", "")], "canon string, kind string, form string")
    rows = assign(Scratch(spark, "t"), entities, "k").collect()
    assert len(rows) == len({r.surrogate for r in rows}) == 41 and "s7" not in {r.surrogate for r in rows}


def test_surrogates_take_odd_tables(spark):
    docs = odd_documents(spark)
    assert sorted(map(str, pseudonymize(docs, "k").collect())) == sorted(map(str, docs.collect()))
    assert pseudonymize(docs.limit(0), "k").count() == 0
    assert re.compile("x") and PATTERN


def test_stages_compose_as_brute_force(spark, tmp_path):
    import corpus_pipeline

    from .test_decontaminate import plain_tiles

    texts = texts_with_groups() | {400: "1234 %%% 99", 401: "write to some.one@mail3.example.org about this " + " ".join(f"q{i}" for i in range(9))}
    leak = [f"leak{i}" for i in range(12)]
    texts |= {500: " ".join(["x"] * 30 + leak[6:] + ["y"] + leak[:6]), 501: " ".join(leak[:5])}
    lang = {i: ["en", "de", None][i % 3] for i in texts}
    spark.createDataFrame([(i, t, lang[i], "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {i: t for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    left = {i: left[i] for i, (_, _, kept) in groups(left, 5).items() if kept}
    left = {i: t for i, t in left.items() if sum(n for _, _, n in plain_tiles(leak, re.findall(r"\w+", t.lower()), 5)) < 6}
    docs, seen = corpus_pipeline.table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    seen = {r.doc_id: r for r in docs.collect()}
    assert set(seen) == set(left) and 500 not in seen and 501 in seen
    assert {i for i in left if seen[i].text != left[i]} == {401} and all(r.n_chars == len(r.text) for r in seen.values())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(left)
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())


def test_pipeline_takes_odd_tables(spark, tmp_path):
    import corpus_pipeline

    docs = odd_documents(spark).withColumn("row_id", F.lit(1)).withColumn("t", F.lit("clash"))
    bench = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6"), (None, None)], "item_id long, text string")
    for name, rows in (("odd", docs), ("empty", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    odd = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = Scratch(spark, "t").table("x", stage(spark, odd, f"{tmp_path}/odd"))
        assert odd.columns == docs.columns
    kept = odd.collect()
    # Of the copies under 9, 12, 15 and 9 again one is left; long texts hold the benchmark's words.
    assert sum("two three four five" in re.sub(r"\s+", " ", r.text.lower()) for r in kept) == 1 and not any("word1 " in r.text for r in kept)
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() >= len(kept)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
