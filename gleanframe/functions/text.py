"""String functions on listings as Spark columns."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELLIPSIS = "…"
#: What Python calls white space: Unicode White_Space and four separators.
SPACES = r"(?U)[\s\x{1c}-\x{1f}]+"
#: What SQL's pattern \s takes for white space, and the space separators that its trim takes off the ends.
SQL_SPACES = r"[\t\n\f\r ]+"
SQL_ENDS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def squeeze(value: Column, spaces: str = SPACES, ends: str = " ") -> Column:
    """White space as one space, without the characters ``ends`` at its ends; blanks are empty."""
    return F.trim(F.regexp_replace(value, spaces, " "), F.lit(ends))


def collapse(value: Column, spaces: str = SPACES, ends: str = " ") -> Column:
    """White space as one space, trimmed; null where nothing is left."""
    return F.nullif(squeeze(value, spaces, ends), F.lit(""))


def shorten(value: Column, limit: int, ends: str | None = None) -> Column:
    """At most ``limit`` code points; a longer text ends in an ellipsis after its last word mark (before any of ``ends``)."""
    head = F.substring(value, 1, limit)
    head = F.rtrim(head, F.lit(ends)) if ends else F.regexp_replace(head, rf"{SPACES}$", "")
    return F.when(F.char_length(value) > limit, F.concat(head, F.lit(ELLIPSIS))).otherwise(value)


TAG = r"<[^>]*>"
_TAG = re.compile(TAG)


@F.pandas_udf(T.StringType())
def _text_of_markup(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(_TAG.sub(" ", v)))


def plain(value: Column, limit: int = 600) -> Column:
    """Markup as plain text: tags are gaps, character references are decoded; Spark has no function for those."""
    return shorten(collapse(_text_of_markup(value)), limit)


def plain_of(value: Column, references: Mapping[str, str], limit: int = 600) -> Column:
    """Markup as plain text where only these references count, each as it is written, and white space is SQL's."""
    text = F.regexp_replace(value, TAG, " ")
    for reference, mark in sorted(references.items(), key=lambda r: r[1] == "&"):  # the ampersand last: nothing is decoded twice
        text = F.replace(text, F.lit(reference), F.lit(mark))
    # As an item of a list the text is worked out once, however often the rest names it.
    return F.get(F.transform(F.array(collapse(text, SQL_SPACES, SQL_ENDS)), lambda t: shorten(t, limit, SQL_ENDS)), 0)


def _nfkc(value: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), value, F.lit(True))


def identity_form(value: Column) -> Column:
    """NFKC, case-folded, letters and digits only; null counts as empty. ICU, which Spark ships, does what ASCII doesn't need."""
    text = F.coalesce(value, F.lit(""))
    ascii_form = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(text), F.lit(True))
    return F.when(F.octet_length(text) == F.char_length(text), ascii_form).otherwise(F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " ")))


def clean(value: Column) -> Column:
    """Lower case with white space collapsed, for comparing; null is empty, punctuation stays."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(value.cast("string")), SPACES, " ")), F.lit(""))


def searchable(items: Column) -> Column:
    """A list as one text for substring search."""
    return F.array_join(F.transform(items, clean), " | ")


def first_present(*values: Column) -> Column:
    """The first value that isn't blank, trimmed; empty if all are."""
    return F.coalesce(*[F.nullif(F.regexp_replace(v.cast("string"), rf"^{SPACES[4:]}|{SPACES[4:]}$", ""), F.lit("")) for v in values], F.lit(""))


def label(key: Column) -> Column:
    """A field name as a label: underscores are spaces, the first letter is large."""
    text = F.trim(F.replace(key, F.lit("_"), F.lit(" ")))
    return F.when(text == "", key).otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)))


def shown(value: Column, kind: str = "string") -> Column:
    """A scalar for display: a dash for null, yes or no for booleans."""
    text = F.when(value, F.lit("yes")).otherwise(F.lit("no")) if kind == "boolean" else value.cast("string")
    return F.when(value.isNull(), F.lit("—")).otherwise(text)


def escape(value: Column) -> Column:
    """The five characters that mean something in HTML, as references."""
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(mark), F.lit(reference))
    return value


def host(url: Column) -> Column:
    """The authority of a URL in lower case, without a leading www."""
    authority = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(authority, r"^www\.", "")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def lines_kept(text: Column, skip: Sequence[Column | str], noise: str, limit: int = 900) -> Column:
    """The lines of a card, each once, but for those to skip and those that match ``noise``; as one text."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.coalesce(collapse(x), F.lit("")))
    drop = F.array(*[s if isinstance(s, Column) else F.lit(s) for s in skip]) if skip else F.array().cast("array<string>")
    kept = F.filter(lines, lambda x: (x != "") & ~F.coalesce(F.array_contains(drop, x), F.lit(False)) & ~F.regexp_like(x, F.lit(noise)))
    return shorten(F.nullif(F.array_join(F.array_distinct(kept), " "), F.lit("")), limit)
