"""Main text of web pages by template deduction over equivalence classes.

1. A page is a row of tokens: its tags, each with the path it stands at, and its texts, each
   with its path. Tokens of one host with equal occurrence vectors (how often each page has them)
   form a class. A class is large enough if it occurs on half of the host's pages; it is valid if
   the places its tags hang at belong to one class, the class itself, or none, so that classes
   nest. The valid classes of a host, and the texts that hang at their tags, are its template.
2. What stands between template tokens is a slot. The tags that each page has once form the outer
   class; of its slots the innermost that holds most of the host's words outside links is the
   article's. It grows by slots around it as long as these hold a heading (h1, h2) that it lacks. Slots
   of links alone are menus. A text that belongs to the template is dropped.
3. Marks decide what the template leaves open: where the article's slot stands in an element marked
   as main (article, main), that element is the article; furniture in it (menus, headers, footers,
   sidebars, notices, adverts, forms, comments) is dropped, and a heading just outside the slot
   is kept. A host of one page, or of pages without a common slot, has marks alone: the
   marked element, or else all that is no furniture, but for labels (texts of at most LABEL_WORDS
   words that stand loose at the top of the page, in no element for text).
A text is taken for the template's on the evidence of at least LEAST_PAGES pages of different
content, whatever the size of the host. Occurrence vectors are kept as sums of hashes over pages,
so a host with a third of all pages is summed up before it is sent.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

# Fixed values of HTML: elements whose content is no text, that have no content, that begin a block, and that an opening tag closes.
RAW = frozenset("script style noscript template textarea title svg iframe select button object math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
# Elements, roles, and words of a class or id that mark page furniture.
CHROME_TAGS = frozenset("nav header footer aside form dialog menu".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
CHROME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar side nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer comment comments replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login modal popup overlay pagination pager widget toolbar skip tags".split())
#: A tag whose quotes close before the next "<"; any other goes by ``tag_end``.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: Raw elements that run to the page's end if they aren't closed.
ENDLESS = frozenset("script style title textarea".split())
LONG_REFERENCE = re.compile(r"&#0*+([0-9]*+);?")
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
LEAST_PAGES, LEAST_SHARE, MENU_SHARE = 4, 0.5, 0.8
LABEL_WORDS, LOOSE_TAGS = 8, frozenset("html body div section center".split())
BROADCAST_BYTES = 16 << 20
#: Tokens whose sums a task holds before it sends them on: about 30 MB.
HELD_TOKENS = 60_000
NOTHING = (0, 0, 0, 0)


@dataclass
class Block:
    text: str
    path: int  # hash of the tags around it
    above: int  # of the path without its last tag
    chrome: bool  # by any ancestor
    main: bool
    chrome_in_main: bool
    heading: bool
    loose: bool  # at the top of the page, in no element for text
    inside: bool  # in the slot asked for
    links: int  # how many of its words are in links


@dataclass
class Slot:
    """What a page has at one path: how often, where it hangs, how deep; words outside links and headings in it; words in links and in all of its own."""

    up: int
    depth: int
    count: int = 0
    words: int = 0
    heads: int = 0
    linked: int = 0
    own: int = 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(raw)} if raw else {}


def _is_chrome(tag: str, at: dict[str, str]) -> bool:
    if tag in CHROME_TAGS or at.get("role", "").lower() in CHROME_ROLES or "hidden" in at or at.get("aria-hidden") == "true":
        return True
    return tag not in ("html", "body", "article", "main") and any(w in CHROME_WORDS for w in WORD.findall(f"{at.get('class', '')} {at.get('id', '')}".lower()))


def plain(raw: str) -> str:
    """Character references decoded (numbers beyond any character as U+FFFD), white space as one space, trimmed."""
    if "&" in raw:
        raw = entities.unescape(LONG_REFERENCE.sub(lambda m: "\ufffd" if len(m[1]) > 7 else m[0], raw))
    return " ".join(raw.split())


def tag_end(page: str, at: int, quoted: bool) -> tuple[int, bool]:
    """Where the tag that begins at ``at`` ends (-1: nowhere), and whether quotes still count.

    Quotes hide a ">"; once they hide all that are left, they don't count on this page any more.
    So each part of the page is looked at a few times at most.
    """
    k = at
    while quoted:
        k = _next(page, k)
        if k < 0:
            quoted = False
        elif page[k] == ">":
            return k, True
        else:
            close = page.find(page[k], k + 1)
            if close < 0:
                quoted = False
            else:
                k = close + 1
    return page.find(">", at), False


STOP = re.compile("[>\"']")


def _next(page: str, at: int) -> int:
    m = STOP.search(page, at)
    return m.start() if m else -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of the page's parts in order: text, open, close; comments, raw elements and declarations left out."""
    at, n, quoted = 0, len(page), True
    gone: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        m = TAG.match(page, lt)
        if m:
            end, name, rest = m[1], m[2].lower(), m[3]
            at = m.end()
        elif page.startswith("<!--", lt):
            k = page.find("-->", lt + 4)
            at = n if k < 0 else k + 3
            continue
        elif page.startswith(("<!", "<?"), lt):
            k = page.find(">", lt)
            at = n if k < 0 else k + 1
            continue
        else:
            m = NAME.match(page, lt)
            k = -1
            if m:
                k, quoted = tag_end(page, m.end(), quoted)
            if k < 0:
                # No tag: the mark is text; where no ">" is left, so is all that follows.
                upto = n if m else lt + 1
                yield "text", "", page[lt:upto]
                at = upto
                continue
            end, name, rest = m[1], m[2].lower(), page[m.end() : k]
            at = k + 1
        if end:
            yield "close", name, ""
        elif name not in RAW:
            yield "open", name, rest
        elif not rest.endswith("/") and name not in gone:
            m = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            if m:
                at = m.end()
            elif name in ENDLESS:
                return
            else:
                gone.add(name)


def _token(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts)) >> 1


def _under(path: int, mark: str) -> int:
    """The hash of a path with one more tag."""
    return xxhash.xxh3_64_intdigest(mark.encode("utf-8", "surrogatepass"), path) >> 1


def _text_token(path: int, text: str) -> int:
    return _under(path ^ 1, text)


def parse(page: str, slot: int | None = None) -> tuple[list[Block], dict[int, Slot]]:
    """The page's blocks of text in order, and what it has at each path of tags; ``slot``: the path whose blocks are marked as inside."""
    blocks: list[Block] = []
    found: dict[int, Slot] = {0: Slot(0, 0, 1)}
    # Of each open element: tag, path, chrome anywhere, main, chrome inside main, top of the page, inside the slot, in a link.
    stack: list[tuple[str, int, bool, bool, bool, bool, bool, bool]] = [("", 0, False, False, False, True, False, False)]
    is_open: Counter[str] = Counter()
    sums: list[list[int]] = [[0, 0]]  # of each open element: words outside links, headings
    text: list[str] = []
    linked: list[str] = []
    at = 0  # where in the stack the text began

    def flush() -> None:
        if text:
            words = plain("".join(text))
            if words:
                tag, path, chrome, main, inside_main, top, inside, _ = stack[at]
                heading = tag in ("h1", "h2")
                n, m = words.count(" ") + 1, len(plain(" ".join(linked)).split()) if linked else 0
                here = found[path]
                here.own += n
                here.linked += min(n, m)
                if not chrome:
                    sums[at][0] += max(0, n - m)
                    sums[at][1] += heading
                blocks.append(Block(words, path, found[path].up, chrome, main, inside_main, heading, top and (tag in LOOSE_TAGS or tag not in BLOCKS), inside, min(n, m)))
            text.clear()
            linked.clear()

    def say(piece: str) -> None:
        nonlocal at
        if not text:
            if piece.isspace():
                return
            at = len(stack) - 1
        text.append(piece)
        if stack[-1][7]:
            linked.append(piece)

    def close(k: int) -> None:
        if any(e[0] in BLOCKS for e in stack[k:]) or at >= k:
            flush()
        while len(stack) > k:
            words, heads = sums.pop()
            tag, path, *_ = stack.pop()
            is_open[tag] -= 1
            here = found[path]
            here.words += words
            here.heads += heads
            sums[-1][0] += words
            sums[-1][1] += heads

    for kind, tag, rest in tokens(page):
        if kind == "text":
            say(rest)
            continue
        if kind == "close":
            if is_open[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag == "br":
            if text:
                text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            over, walls = CLOSES.get(tag, (("p",), ()))
            if any(is_open[x] > 0 for x in over):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in over:
                        close(k)
                        if tag != "tr":
                            break
                    elif stack[k][0] in walls or (not walls and stack[k][0] in BLOCKS):
                        break
        _, path, chrome, main, inside_main, top, inside, link = stack[-1]
        attributes = _attributes(rest)
        own = _is_chrome(tag, attributes) if attributes else tag in CHROME_TAGS
        mark = f"{tag}.{attributes.get('class', '')}#{attributes.get('id', '')}" if attributes else tag
        up, path = path, _under(path, mark)
        if path not in found:
            found[path] = Slot(up, found[up].depth + 1)
        found[path].count += 1
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
            continue
        is_main = not own and (tag in ("article", "main") or bool(attributes) and (attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody"))
        # The head of an article may hold its title.
        soft = tag == "header" and main
        stack.append((tag, path, chrome or own, main or is_main, inside_main or (main and own and not soft), top and stack[-1][0] in ("", "html", "body"), inside or path == slot, link or tag == "a"))
        is_open[tag] += 1
        sums.append([0, 0])
    flush()
    close(1)
    found[0].words, found[0].heads = sums[0]
    return blocks, found


def _lanes(page: int, count: int) -> tuple[int, int]:
    """What a page adds to the sums that stand for an occurrence vector; 31 bits each, so sums don't overflow."""
    h = _token(str(page), str(count))
    return h & 0x7FFFFFFF, (h >> 31) & 0x7FFFFFFF


def host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


COLUMNS = "host string, token long, up long, is_text long, pages long, lane1 long, lane2 long, kinds long, depth long, words long, heads long, linked long, own long"


def tokens_of(pages: DataFrame) -> DataFrame:
    """Occurrence sums of each token of a host, and sums of what stands at it, added up within a task as far as HELD_TOKENS goes."""
    bound_batches(pages.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def added(sums: dict[tuple[str, int], list[int]], name: str, page: str) -> None:
        blocks, slots = parse(page)
        sign = _token(*(b.text for b in blocks if not b.chrome))
        bit, lanes = 1 << (sign & 63), {}
        # The page itself is token 0.
        rows = [(p, (s.up, 0, s.depth), s.count, (s.words, s.heads, s.linked, s.own)) for p, s in slots.items()]
        rows += [(_text_token(p, t), (p, 1, 0), n, NOTHING) for (p, t), n in Counter((b.path, b.text) for b in blocks).items()]
        for token, (up, is_text, depth), n, more in rows:
            if n not in lanes:
                lanes[n] = _lanes(sign, n)
            one, two = lanes[n]
            s = sums.get((name, token))
            if s is None:
                sums[name, token] = [up, is_text, 1, one, two, bit, depth, *more]
                continue
            s[2] += 1
            s[3] += one
            s[4] += two
            s[5] |= bit
            if more is not NOTHING:
                for i, x in enumerate(more, 7):
                    s[i] += x

    def emitted(sums: dict[tuple[str, int], list[int]]) -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        for lo in range(0, len(keys), 10_000):
            some = keys[lo : lo + 10_000]
            rows = [sums[k] for k in some]
            cols = [[k[0] for k in some], [k[1] for k in some], *([s[i] for s in rows] for i in range(11))]
            cols[7] = [(x ^ (1 << 63)) - (1 << 63) for x in cols[7]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(cols)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                added(sums, name, page or "")
                if len(sums) >= HELD_TOKENS:
                    yield from emitted(sums)
                    sums = {}
        yield from emitted(sums)

    found = pages.select(host().alias("host"), "html").mapInArrow(run, COLUMNS)
    return found.groupBy("host", "token").agg(
        *[F.min(c).alias(c) for c in ("up", "depth")],
        F.max("is_text").alias("is_text"),
        *[F.sum(c).alias(c) for c in ("pages", "lane1", "lane2", "words", "heads", "linked", "own")],
        F.bit_count(F.bit_or("kinds")).alias("kinds"),
    )


def templates(tokens: DataFrame) -> DataFrame:
    """(host, frame, texts, menus, slot): the tag and text tokens of the valid, nested classes of each host, the paths that hold links alone, and the article's slot.

    A token counts only on the evidence of pages of different content, so copies of one page make
    no template: two for a tag, LEAST_PAGES for a text.
    """
    root = tokens.where("token = 0").select("host", F.col("pages").alias("all_pages"), F.col("words").alias("all_words"), F.xxhash64("pages", "lane1", "lane2").alias("once"))
    enough = F.col("kinds") >= F.when(F.col("is_text") == 1, F.lit(LEAST_PAGES)).otherwise(F.lit(2))
    large = tokens.where("token <> 0").join(root, "host").where((F.col("pages") >= LEAST_SHARE * F.col("all_pages")) & enough)
    named = large.withColumn("class", F.xxhash64("pages", "lane1", "lane2"))
    parent = named.where("is_text = 0").select("host", F.col("token").alias("up"), F.col("class").alias("up_class"), F.col("heads").alias("up_heads"), F.col("up").alias("top"))
    hung = named.join(parent, ["host", "up"], "left")
    outer = F.when(F.col("up_class") != F.col("class"), F.col("up_class"))
    nests = hung.where("is_text = 0").groupBy("host", "class").agg((F.coalesce(F.min(outer), F.lit(0)) == F.coalesce(F.max(outer), F.lit(0))).alias("valid")).where("valid")
    # A text belongs to the class that the place it hangs at has.
    holder = F.when(F.col("is_text") == 1, F.col("up_class")).otherwise(F.col("class"))
    valid = hung.withColumn("holder", holder).join(nests.select("host", F.col("class").alias("holder")), ["host", "holder"])
    # Words in the innermost slot that each page has once and that holds most of them; it grows while its parent has headings that it lacks.
    box = (F.col("is_text") == 0) & (F.col("class") == F.col("once")) & (2 * F.col("words") > F.col("all_words"))
    grows = (F.col("up_class") == F.col("once")) & (F.col("up_heads") > F.col("heads")) & (F.col("depth") > 3)
    inner = F.max_by(F.struct(F.when(grows, F.col("up")).otherwise(F.col("token")).alias("slot")), F.struct("depth", "words", "token"))
    # At most twice the mean number of tokens a page has: each is on half of the host's pages.
    out = valid.groupBy("host").agg(
        F.collect_list(F.when(F.col("is_text") == 0, F.col("token"))).alias("frame"),
        F.collect_list(F.when(F.col("is_text") == 1, F.col("token"))).alias("texts"),
        F.collect_list(F.when((F.col("is_text") == 0) & (F.col("own") > 0) & (F.col("linked") >= MENU_SHARE * F.col("own")), F.col("token"))).alias("menus"),
    )
    chosen = valid.where(box).groupBy("host").agg(inner.alias("in")).select("host", "in.slot")
    return out.join(chosen, "host", "left")


def main_text(page: str | None, frame: set[int], texts: set[int], menus: set[int] = frozenset(), slot: int | None = None) -> str:
    """The article: blocks of its slot, each on a line."""
    blocks, slots = parse(page or "", slot)
    around, up = set(), slot
    while up in slots and up:
        up = slots[up].up
        around.add(up)
    inside = [b for b in blocks if b.inside]
    own = [b for b in inside if not b.chrome]
    if any(b.main for b in own):
        # The slot stands in a marked element: that is the article.
        left = [b for b in blocks if b.main and not b.chrome_in_main]
    elif own and not all(b.path in menus for b in own):
        left = [b for b in blocks if not b.chrome and (b.inside or b.heading and b.above in around)]
    elif any(b.main for b in blocks):
        left = [b for b in blocks if b.main and not b.chrome_in_main]
    else:
        left = [b for b in blocks if not b.chrome]
        left = [b for b in left if not (b.loose and b.text.count(" ") < LABEL_WORDS and b.path not in frame)] or left
    # Texts of any length belong to the template; a page of nothing else keeps them.
    left = [b for b in left if b.path not in menus or b.links < b.text.count(" ") + 1] or left
    left = [b for b in left if b.heading or _text_token(b.path, b.text) not in texts] or left
    return "\n".join(b.text for b in left)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page; null html and pages without an article give an empty text.

    Rows of equal page_id stand each for itself; a null url belongs to the host of no name. Pages of
    any length and depth are parsed whole, in time that grows with the length; other columns aren't read.
    """
    scratch = Scratch(pages.sparkSession, "html")
    # Written once, as the deduction reads it several times; what one kind of page has alone can't be in a template.
    tokens = scratch.table("tokens", tokens_of(pages).where((F.col("token") == 0) | (F.col("kinds") >= 2)))
    deduced = scratch.table("templates", templates(tokens))
    scratch.keep_only("templates")
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    size = deduced.agg(F.sum(8 * (F.size("frame") + F.size("texts") + F.size("menus")) + 64)).first()[0] or 0
    # Templates go to all tasks only while they are small; else both sides are dealt by host, and Spark splits large hosts.
    with_template = rows.join(F.broadcast(deduced) if size <= BROADCAST_BYTES else deduced, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(h, set(f or ()), set(t or ()), set(m or ()), s) for h, f, t, m, s in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_template.select("page_id", "url", "html", "frame", "texts", "menus", "slot").mapInArrow(run, "page_id long, url string, text string, n_chars long")
