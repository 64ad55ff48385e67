"""Which links of a page are single postings, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segments and keys of URLs, and words of pages, that tell postings from indexes.
JOB_SEGMENTS = (
    "job", "jobs", "jobad", "joboffer", "job-details", "jobdetails", "position", "positions", "vacancy", "vacancies",
    "opening", "openings", "career", "careers", "listing", "listings", "remote-jobs", "jobslobby", "משרה", "משרות", "drushim",
)
INDEX_SEGMENTS = (
    "search", "searches", "results", "category", "categories", "cat", "browse", "tag", "tags", "topic", "topics", "area",
    "areas", "city", "cities", "region", "regions", "field", "fields", "filter", "filters", "index", "all", "list", "sitemap",
    "page", "pages", "login", "register", "signup", "about", "contact", "faq", "blog", "article", "articles", "news",
    "companies", "employers", "advertise", "terms", "privacy", "relocation", "salary", "salaries", "tips", "guide", "guides",
    "home", "קטגוריה", "חיפוש", "רילוקיישן",
)
ID_QUERY_KEYS = (
    "id", "jobid", "job_id", "jid", "jk", "gh_jid", "positionid", "position_id", "vacancyid", "vacancy_id", "oid", "pid",
    "jobcode", "jobnumber", "reqid", "requisitionid",
)
INDEX_QUERY_KEYS = (
    "q", "query", "search", "keyword", "keywords", "term", "terms", "page", "category", "cat", "field", "area", "region",
    "city", "sort", "filter",
)
CHROME_TAGS = ("nav", "header", "footer", "aside")
CHROME_HINT = r"(?i)nav|menu|header|footer|breadcrumb|sidebar|side-bar|tabs?\b|filter|pagination|pager|cookie|banner|social|lang|skip"
GENERIC_TEXT = r"(?i)^(all|more|view|see|browse|show|next|prev|previous|back|home|jobs|careers|vacancies|positions|login|register|sign in|sign up|apply)\b|^(כל|עוד|חיפוש|דרושים|משרות)\s"
LOGIN_PATH = r"(?i)/(log[-_]?in|sign[-_]?in|sign[-_]?up|auth|session|checkpoint)\b"
PASSWORD_FIELD = r"""type=["']password["']"""


def in_chrome(tags: Column, blobs: Column) -> Column:
    """Whether any ancestor is page furniture, by its tag or by a word of its class, id and role."""
    return F.arrays_overlap(tags, F.array(*map(F.lit, CHROME_TAGS))) | F.exists(blobs, lambda b: b.rlike(CHROME_HINT))


def plausible_title(title: Column) -> Column:
    """5 to 120 characters, at most 20 spaces, and no name of a section."""
    spaces = F.char_length(title) - F.char_length(F.replace(title, F.lit(" "), F.lit("")))
    return F.char_length(title).between(5, 120) & ~title.rlike(GENERIC_TEXT) & (spaces <= 20)


def _one_of(value: Column, words: tuple[str, ...]) -> Column:
    return value.isin(*words)


def is_posting_url(url: Column, base_host: Column) -> Column:
    """Whether a URL is shaped like one posting of the site it was found on.

    Parameters decide first: an index key rules a posting out, a job-id key with three digits
    proves one. Else a job segment must be followed by three digits, by an id parameter in the
    query, or by a hyphenated slug of eight characters or more at the end.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    # A plus sign in a path is itself; only the query's stand for spaces.
    decoded = lambda s: F.coalesce(F.try_url_decode(s), s)
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.lower(decoded(F.replace(s, F.lit("+"), F.lit("%2B")))))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.")), lambda p: F.struct(F.lower(decoded(F.substring_index(p, "=", 1))).alias("k"), decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    # Of repeated keys the last counts.
    pairs = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"]))
    local = (base_host == "") | (host == "") | (host == base_host) | host.endswith(F.concat(F.lit("."), base_host))
    index_key = F.exists(pairs, lambda p: _one_of(p["k"], INDEX_QUERY_KEYS))
    id_key = F.exists(pairs, lambda p: _one_of(p["k"], ID_QUERY_KEYS) & p["v"].rlike(r"\d{3}"))
    job_key = F.exists(pairs, lambda p: _one_of(p["k"], ID_QUERY_KEYS) & p["v"].rlike(r"\d{3}") & p["k"].rlike("job|vacancy|position"))
    places = F.filter(F.transform(segments, lambda s, i: F.when(_one_of(s, JOB_SEGMENTS), i)), lambda i: i.isNotNull())
    tail = F.slice(segments, F.get(places, 0) + 2, F.size(segments) + 1)
    last = F.get(tail, F.size(tail) - 1)
    shaped = (F.size(places) > 0) & F.coalesce((F.size(tail) > 0) & (F.exists(tail, lambda s: s.rlike(r"\d{3}")) | id_key | (last.contains("-") & (F.char_length(last) >= 8))), F.lit(False))
    index_segment = F.exists(segments, lambda s: _one_of(s, INDEX_SEGMENTS))
    ok = scheme.isin("http", "https") & local & (F.size(segments) > 0) & ~index_key & (job_key | (~index_segment & shaped))
    return F.coalesce(ok, F.lit(False))


def looks_like_json(body: Column, content_type: Column) -> Column:
    return F.lower(content_type).contains("json") | F.regexp_like(body, F.lit(r"(?U)^\s*[{\[]"))


def is_login_page(url: Column, body: Column) -> Column:
    """A sign-in route, or a password field near the top of the page."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return path.rlike(LOGIN_PATH) | F.lower(F.substring(body, 1, 20000)).rlike(PASSWORD_FIELD)
