"""A listing's identity: a hash of its normalised company, content and place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_present, identity_form

# The fields that may hold each part, in order of preference.
COMPANY_KEYS = ("company", "company_name", "hiring_company")
LOCATION_KEYS = ("location", "job_location", "city")
CONTENT_KEYS = ("description", "summary", "snippet", "content", "title", "job_title")


def listing_id(company: Column, content: Column, location: Column) -> Column:
    """``sha256:`` and 32 hex digits; null where all three parts are empty."""
    parts = [identity_form(p) for p in (company, content, location)]
    blank = parts[0] == ""
    for p in parts[1:]:
        blank &= p == ""
    return F.when(~blank, F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)))


def identity_parts(fields: Sequence[str], prefix: str = "") -> tuple[Column, Column, Column]:
    """Company, content and location from whatever of the known fields there are."""
    pick = lambda keys: first_present(*[F.col(f"{prefix}{k}") for k in keys if k in fields])
    return pick(COMPANY_KEYS), pick(CONTENT_KEYS), pick(LOCATION_KEYS)


def entry_id(fields: Mapping[str, Sequence[str]], listing: str = "job", assessment: str = "assessment") -> Column:
    """The id of an entry: from the listing if that has any identity field, else from the assessment."""
    own, other = identity_parts(fields[listing], f"{listing}."), identity_parts(fields[assessment], f"{assessment}.")
    known = F.concat(*own) != ""
    return listing_id(*[F.when(known, a).otherwise(b) for a, b in zip(own, other, strict=True)])
