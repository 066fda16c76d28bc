"""Main text of web pages: structure first, then a host suffix array over what the structure leaves open.

A page becomes a stream of blocks, each with a zone: in an article, in a main element, in a container named as content, open,
or chrome (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments and the like, told by element, role,
class or id).  The blocks of articles are main text as they stand; so are those of main elements and named containers, around
or beside articles, unless the host repeats them.  A page without any such zone is unsettled: its open blocks may be text or
boilerplate, and the host decides.

For that, the token streams of all blocks outside articles, over all pages of a host, form one generalised suffix array, cut
at a depth of ``RUN`` tokens: a suffix is dealt to a task by the hash of host and first RUN tokens, and those that fall
together are the array's runs of suffixes with that much in common.  A run that meets two distinct pages marks these tokens as
covered in both.  A longer repeated substring is a row of such runs, so exactly the substrings of RUN tokens or more that a whole
array finds are covered, whatever their length (tested against one).  Blocks outside articles of which at least half is covered,
and short open blocks made of links, are removed; the unique runs stay.  Equal suffixes of a hot host are combined before the
shuffle (least and greatest page), so no host or run meets in one task.

Each page is parsed once; what the rest needs of it (text or blocks, suffixes) is stored.

* A null or empty page has empty text; an empty table gives an empty result.  Pages of a host with equal blocks have equal text
  and are one page to the suffix array, whatever their address and other columns; repeated rows and ties give equal rows.
* A page cut off anywhere gives the text up to there; very long pages are read whole, in time that follows their length.
  Passages that pages share stay when they stand in an article.  Pages without an address share the empty host.
* Extra columns pass through, whatever their names; columns named like outputs are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_rules import url_host
from .util import cut, fresh, join_hot, session, small_batches

RUN = 8
LINKED, SHORT = 0.6, 25
ARTICLE, MAIN, NAMED, OPEN, CHROME = range(5)

#: Elements, roles and names; fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript noframes noembed iframe template svg annotation annotation-xml xmp object canvas audio video".split())
CHROME_TAGS = frozenset("nav footer aside form button select input label menu dialog head search datalist fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Names of what is never part of an article, wherever it stands.
HARD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promotion comment comments commentlist disqus "
    "respond replies cookie cookies consent gdpr newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "popup modal overlay paywall breadcrumb breadcrumbs pagination pager".split()
)
#: Names of page furniture; an article or main element inside is still one.
SOFT = frozenset(
    "nav navbar navigation menu header masthead topbar footer bottombar sidebar aside widget widgets banner search login notice notices alert toolbar copyright "
    "legal disclaimer skip teaser tags".split()
)
#: Those that are furniture inside an article, too.
INSIDE = SOFT - {"header", "banner", "tags", "teaser"}
#: Names that make a furniture name tell of layout only, as in page-with-sidebar.
LAYOUT = frozenset("content main page wrapper wrap container layout with has no body grid row column col site".split())
#: Words that make up names together with those above, and do not change what they tell of.
AFFIXES = frozenset(
    "area bar block bottom box btn button buttons center column columns custom desktop default display fixed form global google group head holder horizontal "
    "icon icons inline inner item items large leaderboard left link links list main mini mobile module more native outer panel posts primary reader rectangle "
    "region right secondary section sections site small skyscraper slot sticky strip text title top unit units user users vertical wide zone".split()
)
NAMES = frozenset("content post entry article story articlebody maincontent bodytext postcontent entrycontent".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}

#: An attribute: quotes count only where a value begins; elsewhere they are characters like others.
ONE = r"[^\s>/=][^\s>/=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+"
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|" + ONE + r")*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</?\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block:
    __slots__ = ("zone", "sign", "text", "words", "linked")

    def __init__(self, zone: int, sign: str, text: str, linked: int):
        self.zone, self.sign, self.text, self.linked = zone, sign, text, linked
        self.words = text.split(" ")


def named(names: list[list[str]], kind: frozenset[str]) -> bool:
    """Whether one of the names, each in words, is of a kind: ad-box, but not ad-hoc."""
    known = kind | HARD | SOFT | LAYOUT | AFFIXES | NAMES
    return any("".join(n) in kind or any(w in kind for w in n) and all(w in known or len(w) < 3 for w in n) for n in names)


def judged(tag: str, attributes: str, zone: int, hard: bool) -> tuple[int, bool]:
    """Zone of an element within a zone; whether chrome is so for good."""
    if hard:
        return CHROME, True
    if tag in CHROME_TAGS:
        return CHROME, True
    found: dict[str, str] = {}
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if found:
        style = found.get("style", "").replace(" ", "").lower()
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style:
            return CHROME, True
        role = found.get("role", "").lower()
        if role in CHROME_ROLES and tag not in ("body", "html"):
            return CHROME, True
        split = [[w.lower() for w in WORD.findall(n)] for n in f"{found.get('class', '')} {found.get('id', '')}".split()]
        names = {w for n in split for w in n}
        whole = {re.sub(r"[^a-z]", "", w.lower()) for w in f"{found.get('class', '')} {found.get('id', '')}".split()}
        if tag not in ("body", "html", "main", "h1") and named(split, HARD):
            return CHROME, True
        if tag not in ("body", "html", "main", "article", "h1") and zone not in (ARTICLE, MAIN) and named(split, SOFT) and not names & LAYOUT:
            return CHROME, False
        if tag not in ("body", "html") and zone in (ARTICLE, MAIN) and named(split, INSIDE):
            return CHROME, False
        if zone == OPEN and (role == "main" or found.get("itemprop", "").lower() == "articlebody"):
            return MAIN, False
        if zone == OPEN and tag not in ("body", "html", "article", "main") and (names & NAMES or whole & NAMES):
            return NAMED, False
    if tag == "article":
        return ARTICLE, False
    if tag == "main" or zone == CHROME:
        return (MAIN if tag == "main" and zone != ARTICLE else zone), False
    if tag == "header" and zone not in (ARTICLE, MAIN):
        return CHROME, False
    return zone, False


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have words, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []
    inside: Counter[str] = Counter()  # of open elements, by name
    zone, hard, parts, links, linked, at, end = OPEN, False, [], 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(zone, ">".join(t for t, _, _ in stack[-3:]), text, linked))
            parts.clear()
        linked = 0

    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.split())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif not closing and tag in RAW:
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if closing:
            if inside[tag]:
                flush()
                last = ""
                while last != tag:
                    last = stack.pop()[0]
                    inside[last] -= 1
                zone, hard = stack[-1][1:] if stack else (OPEN, False)
            elif tag in BLOCKS:
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCKS:
            flush()
            while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ())):
                inside[stack.pop()[0]] -= 1
            zone, hard = stack[-1][1:] if stack else (OPEN, False)
        if tag in VOID:
            continue
        new = judged(tag, attributes, zone, hard)
        if tag in BLOCKS or new != (zone, hard):
            if new != (zone, hard):
                flush()
            stack.append((tag, *new))
            inside[tag] += 1
            zone, hard = new
    flush()
    return out


def settled(found: list[Block]) -> int:
    """The best zone that has words; OPEN for an unsettled page."""
    return min((b.zone for b in found if b.zone < OPEN), default=OPEN)


def stream(found: list[Block]) -> np.ndarray:
    """Token hashes of the blocks outside articles, a mark of its place in the page before each."""
    tokens = []
    for b in found:
        if b.zone != ARTICLE:
            tokens.append(xxhash.xxh64_intdigest(b.sign, 1))
            tokens += [xxhash.xxh64_intdigest(w, 0) for w in b.words]
    return np.array(tokens, np.uint64)


def content(found: list[Block], host: str | None) -> int:
    """A page's identity within its host: what its blocks say and where they stand, whatever its address and other columns."""
    h = xxhash.xxh64(repr(host).encode("utf-8", "surrogatepass"), 4)
    for b in found:
        h.update(f"\0{b.zone}\0{b.sign}\0{b.text}".encode("utf-8", "surrogatepass"))
    return int(np.uint64(h.intdigest()).view(np.int64))


def suffixes(tokens: np.ndarray, host: str, run: int) -> np.ndarray:
    """Hash of host and the first run tokens of each suffix that has as many."""
    if len(tokens) < run:
        return np.zeros(0, np.uint64)
    h = np.full(len(tokens) - run + 1, xxhash.xxh64_intdigest(host, 2), np.uint64)
    for k in range(run):
        h = (h ^ tokens[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def wanted(found: list[Block]) -> tuple[int, ...]:
    """The zones that can be main text: all content zones, or what is open on an unsettled page."""
    return (ARTICLE, MAIN, NAMED) if settled(found) < OPEN else (OPEN,)


def decided(found: list[Block]) -> bool:
    """Whether the structure alone decides: all that can be main text stands in articles."""
    zones = wanted(found)
    return all(b.zone == ARTICLE for b in found if b.zone in zones)


def overlaid(starts: Iterable[int], n: int, run: int) -> np.ndarray:
    """Which of n tokens are covered by the runs that start there."""
    mark = np.zeros(n + 1, np.int64)
    for i in starts:
        mark[i] += 1
        mark[min(i + run, n)] -= 1
    return np.cumsum(mark[:-1]) > 0


def chosen(found: list[Block], covered: Iterable[int] | None, run: int) -> str:
    """The main text; covered: starts of repeated runs in the stream of the page."""
    if decided(found):
        return "\n".join(b.text for b in found if b.zone == ARTICLE)
    zones = wanted(found)
    at = [0]
    for b in found:
        at.append(at[-1] + (0 if b.zone == ARTICLE else len(b.words) + 1))
    over = overlaid(covered or (), at[-1], run)
    out = []
    for b, i, j in zip(found, at, at[1:]):
        links = b.zone == OPEN and b.linked >= LINKED * len(b.words) and len(b.words) < SHORT
        if b.zone == ARTICLE or b.zone in zones and 2 * over[i + 1 : j].sum() < j - i - 1 and not links:
            out.append(b.text)
    return "\n".join(out)


BLOCK = pa.struct([("zone", pa.int32()), ("text", pa.string()), ("linked", pa.int32())])
PARSED = pa.struct([("text", pa.string()), ("page", pa.int64()), ("suffixes", pa.list_(pa.int64())), ("blocks", pa.list_(BLOCK))])
PARSED_SQL = "text string, page long, suffixes array<long>, blocks array<struct<zone: int, text: string, linked: int>>"


def extract(pages: DataFrame, run: int = RUN, page: str = "html", url: str = "url", report: bool = False) -> DataFrame:
    """pages with ``text`` and ``n_chars`` (code points) instead of the page; with report also ``n_repeated``, how many words
    outside articles (and marks between blocks) the array covers."""
    small_batches(session(pages))
    pages = pages.drop("text", "n_chars", *(["n_repeated"] if report else []))
    keep = [c for c in pages.columns if c != page]
    got, key, starts = fresh(pages, "got", "page_key", "starts")

    @F.arrow_udf(PARSED_SQL)
    def read(texts: pa.Array, hosts: pa.Array) -> pa.Array:
        out = []
        for t, h in zip(texts.to_pylist(), hosts.to_pylist()):
            found = blocks(t or "")
            out.append(
                {
                    "text": chosen(found, None, run) if decided(found) else None,
                    "page": content(found, h),
                    "suffixes": suffixes(stream(found), h, run).view(np.int64).tolist(),
                    "blocks": None if decided(found) else [{"zone": b.zone, "text": b.text, "linked": b.linked} for b in found],
                }
            )
        return pa.array(out, PARSED)

    @F.arrow_udf("string")
    def read_open(held: pa.Array, covered: pa.Array) -> pa.Array:
        rows = zip(held.to_pylist(), covered.to_pylist())
        return pa.array([None if h is None else chosen([Block(b["zone"], "", b["text"], b["linked"]) for b in h], c, run) for h, c in rows], pa.string())

    parsed = cut(pages.select(*keep, read(F.col(page), url_host(F.col(url))).alias(got)).withColumn(key, F.col(f"{got}.page")), "pages")
    suffix = parsed.select(F.col(key).alias("page"), F.posexplode(f"{got}.suffixes").alias("place", "suffix"))
    met = suffix.groupBy("suffix").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    repeated = cut(met.filter("a <> b").select("suffix"), "repeated")
    # which pages need to know their covered runs: those that structure does not decide, or all
    asked = parsed if report else parsed.filter(F.col(f"{got}.blocks").isNotNull())
    places = asked.select(F.col(key).alias("page"), F.posexplode(f"{got}.suffixes").alias("place", "suffix"))
    covered = places.join(repeated, "suffix", "left_semi").groupBy("page").agg(F.sort_array(F.collect_set("place")).alias(starts))
    table = asked.select(F.col(key).alias("page")).distinct().join(covered, "page", "left").withColumnRenamed("page", key)
    open_ = join_hot(asked, cut(table, "covered"), key)
    text = F.coalesce(F.col(f"{got}.text"), read_open(F.col(f"{got}.blocks"), F.when(F.col(f"{got}.blocks").isNotNull(), F.col(starts))), F.lit("")).alias("text")
    n_chars = F.length("text").cast("long").alias("n_chars")
    if report:
        gaps = F.expr(f"aggregate(transform(sequence(1, size({starts}) - 1), i -> least({run}, {starts}[i] - {starts}[i - 1])), {run}, (n, x) -> n + x)")
        n_repeated = F.when(F.size(starts) > 1, gaps).when(F.size(starts) == 1, F.lit(run)).otherwise(F.lit(0)).cast("long").alias("n_repeated")
        return open_.select(*keep, text, n_repeated).select(*keep, "text", n_chars, "n_repeated")
    done = parsed.filter(F.col(f"{got}.blocks").isNull()).select(*keep, F.coalesce(f"{got}.text", F.lit("")).alias("text"))
    return done.unionByName(open_.select(*keep, text)).select(*keep, "text", n_chars)
