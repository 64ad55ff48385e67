"""Documents with the cases that every operator must take: nulls, empty and very long texts, copies, odd white space."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, node long, digest string, at long"


def odd_documents(spark):
    long = " ".join(f"word{i % 977}" for i in range(6000))
    texts = [None, "", "   \n ", "One two three four five six.", "One two three four five six.", "ONE  two\tthree four FIVE six.", "Straße ﬁn", "STRASSE FIN", "日本語 テスト ١٢", "a\x1cb  c\n\n d ", long, long + " more", "don't stop", "x", "%%% ### 12 34"]
    rows = [(i * 3, t, None if i % 4 else "en", "s", None, "clash", 7, "clash", 1) for i, t in enumerate(texts)]
    rows += [(9, "One two three four five six.", "en", None, 3, None, None, None, None), (None, "no id here at all", "en", "s", 1, "a", 1, "b", 1)]
    return spark.createDataFrame(rows, SCHEMA)
