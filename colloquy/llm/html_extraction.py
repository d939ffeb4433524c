"""Operator 10, HTML extraction by nearest-URL page differencing.

Each page becomes a list of text lines, one for a block. Within its host a page is paired with the
page whose URL path is nearest, its neighbour in the order of paths; the two lists are aligned by
their longest common subsequence, and lines that both share are deleted as template text.

Differencing alone can't tell an article that two pages both carry from a template, and misses a
template part that only one page has. So the markup corrects it: lines of menus, footers, forms and
the like are never kept, and lines of a marked article are never deleted. Differencing decides on
all other lines of every page that has a neighbour, whether or not the page marks an article.

Defined results: a null or empty html has the empty text; a page whose url is null or has no host is
alone, as is the only page of a host, and only its markup speaks: if it marks an article, only that
is its text; pages of one path are ordered by
page_id and stay a pair; an element that is never closed ends with the one around it; very long pages
are read as a whole; repeated rows are pages that are each other's neighbours; of other columns none
is read or returned; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

# The elements of HTML by what they are to a reader.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript template svg".split())
NEVER = set("head nav footer aside form dialog menu button select option object canvas".split())
LOOSE = set("p li dt dd tr td th".split())
#: Elements that end without saying so once one of these begins, and up to where they are looked for.
ENDS_BEFORE = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
MAIN_ROLES, NEVER_ROLES = {"main", "article"}, {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog"}
NEVER_NAMES = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments discussion disqus respond form search".split()
)
#: Nouns that a name may end with, after one of these: comment-thread, reader-comments, site-footer and related-posts name such a part; comment-policy and ads-free don't.
AROUND_NAMES = set(
    "header box bar area section sections wrapper wrap container widget block blocks list lists item items link links button buttons icon icons slot slots unit row col column inner outer "
    "thread threads body text label title content contents post posts article articles story stories panel group card cards entry entries form message replies reply".split()
)
#: Beginnings of names that tell how a page is laid out: no-sidebar, has-comments.
LAYOUT_NAMES = set("no has with without is hide show not".split())
#: Names that also say what a text is about: inside a marked article they hold for what is mostly links alone.
WEAK_NAMES = set("social share sharing search related recommended discussion respond".split())
#: Share of links above which a text is a list of links.
LINKS = 0.5
#: Articles that only point to others, where a page has others.
TEASER_NAMES = set("teaser card preview tile excerpt promo".split())
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|(?:^|\s)aria-hidden\s*=\s*[\"']?true|(?:^|\s)style\s*=\s*(?:\"[^\"]*|'[^']*)display\s*:\s*none", re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: What a line is: text of no marked part, of the article, or of a part that is never text. An element may be doubtful until it ends.
PLAIN, MAIN, NEVER_TEXT, DOUBTFUL = 0, 1, 2, 3


def _names_of(name: str) -> set[str]:
    """Of NEVER_NAMES those by which a class or id names a part: its last noun decides."""
    parts = [p for p in re.split(r"[-_]+", name) if p]
    if not parts or parts[0] in LAYOUT_NAMES:
        return set()
    found = NEVER_NAMES.intersection(parts)
    return found if parts[-1] in NEVER_NAMES | AROUND_NAMES else set()


def _part(tag: str, attributes: str, in_main: bool) -> int:
    role, names, tokens = "", set(), set()
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            role = value
        else:
            tokens.update(value.split())
    if tag not in ("html", "body", "main"):
        names = set().union(*map(_names_of, tokens))
    if tag in NEVER or tag == "header" and not in_main or role in NEVER_ROLES or HIDDEN.search(attributes):
        return NEVER_TEXT
    if names - WEAK_NAMES or names and not in_main:
        return NEVER_TEXT
    if names:
        return DOUBTFUL
    return MAIN if tag in ("article", "main") or role in MAIN_ROLES else PLAIN


class _Page:
    """The open elements of a page that is read, and its lines so far."""

    def __init__(self) -> None:
        self.found: list[tuple[str, int]] = []
        self.block: list[str] = []
        self.stack: list[tuple[str, int, int, int, int]] = []  # tag, part, and lines, characters and those in links when it began
        self.never = self.main = self.chars = self.linked = 0
        self.articles: list[tuple[int, int, bool]] = []  # lines from, to, and whether it only points to others
        self.teasers: list[bool] = []  # of the open articles, whether their names say so

    def text(self, text: str, in_link: bool) -> None:
        self.block.append(text)
        n = len(text) - text.count(" ")
        self.chars += n
        self.linked += n * in_link

    def end_block(self) -> None:
        text = " ".join("".join(self.block).split())
        if text:
            self.found.append((text, NEVER_TEXT if self.never else MAIN if self.main else PLAIN))
        self.block.clear()

    def open(self, tag: str, part: int, attributes: str) -> None:
        self.stack.append((tag, part, len(self.found), self.chars, self.linked))
        self.never += part == NEVER_TEXT
        self.main += part == MAIN
        if tag == "article":
            self.teasers.append(any(TEASER_NAMES & set(re.split(r"[-_\s]+", "".join(v).lower())) for n, *v in ATTRIBUTE.findall(attributes) if n.lower() == "class"))

    def close(self, depth: int) -> None:
        """The elements from a depth on end."""
        while len(self.stack) > depth:
            tag, part, lines, chars, linked = self.stack.pop()
            self.never -= part == NEVER_TEXT
            self.main -= part == MAIN
            mostly_links = self.linked - linked > LINKS * (self.chars - chars)
            if part == DOUBTFUL and mostly_links:
                self.found[lines:] = [(text, NEVER_TEXT) for text, _ in self.found[lines:]]
            if tag == "article":
                teaser = self.teasers.pop()
                if not self.teasers and not self.never:
                    self.articles.append((lines, len(self.found), teaser or mostly_links))

    def ends_before(self, tag: str) -> None:
        if self.stack and self.stack[-1][0] == "p":
            self.close(len(self.stack) - 1)
        if tag in ENDS_BEFORE:
            ended, bounds = (x.split() for x in ENDS_BEFORE[tag])
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth][0] in bounds:
                    return
                if self.stack[depth][0] in ended:
                    self.close(depth)
                    return


def lines_of(html: str) -> list[tuple[str, int]]:
    """The text lines of a whole page, each with what it is.

    All articles of a page are its text, but for those that only point to others (by their names, or as
    they are mostly links) where there are such that don't.
    """
    page, at, size, links = _Page(), 0, len(html), 0
    while at < size:
        m = MARKUP.search(html, at)
        stop = m.start() if m else size
        if stop > at:
            page.text(entities.unescape(html[at:stop]), links > 0)
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = m["end"] or m["end2"]
        if not closing and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
            if tag != "svg":
                page.end_block()
            continue
        inline = tag in INLINE
        if not inline:
            page.end_block()
        if tag == "a":
            links = 0 if closing else 1
        if tag in VOID:
            continue
        if closing:
            for depth in range(len(page.stack) - 1, -1, -1):
                if page.stack[depth][0] == tag:
                    if inline:
                        page.end_block()
                    page.close(depth)
                    break
            continue
        if not inline:
            page.ends_before(tag)
        attributes = m["attributes"] or ""
        part = _part(tag, attributes, page.main > 0)
        if part == PLAIN and (inline or tag in LOOSE):
            continue
        if inline:
            page.end_block()
        page.open(tag, part, attributes)
    page.end_block()
    page.close(0)
    found = page.found
    if any(not teaser for *_, teaser in page.articles):
        for start, end, teaser in page.articles:
            if teaser:
                found[start:end] = [(text, NEVER_TEXT) for text, _ in found[start:end]]
    return found


#: Cells of an alignment whose states are kept at once: 4 MB.
CELLS = 1 << 25


def _states(left: list[int], right: list[int]) -> list[int]:
    """The bit-parallel states of the longest common subsequence, after each of left. A cleared bit j: the best length grows at right's j."""
    where: dict[int, int] = defaultdict(int)
    for j, x in enumerate(right):
        where[x] |= 1 << j
    full = (1 << len(right)) - 1
    state, states = full, [full]
    keep = len(left) * len(right) <= CELLS
    for x in left:
        match = state & where[x]
        state = ((state + match) | (state - match)) & full
        if keep:
            states.append(state)
    return states if keep else [state]


def _lengths(left: list[int], right: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of left with each beginning of right."""
    bits = np.unpackbits(np.frombuffer(_states(left, right)[-1].to_bytes(-(-len(right) // 8) or 1, "little"), np.uint8), count=len(right), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(left: list[int], right: list[int]) -> list[int]:
    """Indices of left in a longest common subsequence with right. What is too large for its states is cut in halves, so memory stays linear."""
    if not left or not right:
        return []
    if len(left) * len(right) <= CELLS or len(left) == 1:
        states, shared, j = _states(left, right) if len(left) * len(right) <= CELLS else [(1 << len(right)) - 1, *_states(left, right)], [], len(right)
        for k in range(len(left), 0, -1):
            low = (1 << j) - 1
            if (~states[k] & low).bit_count() > (~states[k - 1] & low).bit_count():
                shared.append(k - 1)
                # The match is the last of right's before j that is equal.
                j -= 1
                while right[j] != left[k - 1]:
                    j -= 1
        return shared[::-1]
    half = len(left) // 2
    upper, lower = _lengths(left[:half], right), _lengths(left[half:][::-1], right[::-1])[::-1]
    cut = int(np.argmax(upper + lower))
    return _aligned(left[:half], right[:cut]) + [half + i for i in _aligned(left[half:], right[cut:])]


def common_lines(a: np.ndarray, b: np.ndarray) -> set[int]:
    """Indices of a's lines in a longest common subsequence with b, by bit-parallel dynamic programming."""
    mine, other = a.tolist(), b.tolist()
    inside = set(mine) & set(other)
    at, right = [i for i, x in enumerate(mine) if x in inside], [x for x in other if x in inside]
    # Equal beginnings and ends are in one that is longest.
    most = min(len(at), len(right))
    begin = next((i for i in range(most) if mine[at[i]] != right[i]), most)
    end = next((i for i in range(most - begin) if mine[at[-1 - i]] != right[-1 - i]), most - begin)
    middle = at[begin : len(at) - end]
    shared = _aligned([mine[i] for i in middle], right[begin : len(right) - end])
    return {*at[:begin], *(middle[i] for i in shared), *at[len(at) - end :]}


def page_lines(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for found in map(lines_of, pages):
        hashes = [xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63) for text, _ in found]
        # The text of what is never kept need not travel on; its hash aligns.
        rows.append(([text if part != NEVER_TEXT else "" for text, part in found], [part for _, part in found], hashes))
    return pd.DataFrame(rows, columns=["lines", "parts", "hashes"])


def shared_lines(hashes: pd.Series, nearest: pd.Series) -> pd.Series:
    """Indices of the lines that a page shares with its neighbour."""
    return pd.Series([sorted(common_lines(mine, other)) for mine, other in zip(hashes, nearest)], dtype=object)


def main_text(lines: pd.Series, parts: pd.Series, shared: pd.Series) -> pd.Series:
    """shared: null for a page without a neighbour."""
    texts = []
    for own, part, template in zip(lines, parts, shared):
        if template is None:
            decided = [p == PLAIN and MAIN not in part for p in part]
        else:
            gone = set(template)
            decided = [p == PLAIN and i not in gone for i, p in enumerate(part)]
        texts.append(" ".join(x for x, p, keep in zip(own, part, decided) if p == MAIN or keep))
    return pd.Series(texts, dtype=object)


def nearest_pages(pages: DataFrame) -> DataFrame:
    """(row, nearest row) from pages (__row, host, path): of the two neighbours in the order of host,
    path and row, the one of the same host whose path takes fewer edits, the former in a tie.

    The order is dealt out in ranges; each range also gets the last row before and the first after it.
    """
    key = F.struct("host", "path", "__row")
    dealt = pages.repartitionByRange(parallelism(pages.sparkSession), "host", "path", "__row")
    dealt = materialize(dealt.select(F.spark_partition_id().alias("range"), key.alias("key")), "pages-ranges")
    ends = dealt.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    ranges = Window.partitionBy().orderBy("range")  # a row for each range
    ends = ends.withColumns({"before": F.lag("high").over(ranges), "after": F.lead("low").over(ranges)})
    echoes = ends.select("range", F.explode(F.array("before", "after")).alias("key")).where("key is not null")
    both = dealt.withColumn("echo", F.lit(False)).unionByName(echoes.withColumn("echo", F.lit(True)))
    order = Window.partitionBy("range").orderBy("key")
    both = both.withColumns({"before": F.lag("key").over(order), "after": F.lead("key").over(order)}).where(~F.col("echo"))

    def edits(other: str):
        return F.when(F.col(f"{other}.host") == F.col("key.host"), F.levenshtein(F.col("key.path"), F.col(f"{other}.path")))

    both = both.withColumns({"d1": edits("before"), "d2": edits("after")})
    nearest = F.when(F.col("d1").isNotNull() & (F.col("d2").isNull() | (F.col("d1") <= F.col("d2"))), F.col("before.__row")).when(F.col("d2").isNotNull(), F.col("after.__row"))
    return both.select(F.col("key.__row").alias("__row"), nearest.alias("__nearest")).where("__nearest is not null")


def extract(pages: DataFrame) -> DataFrame:
    """Every page (page_id, url) with its main text and n_chars."""
    parse = F.pandas_udf(page_lines, "lines array<string>, parts array<int>, hashes array<long>")
    align = F.pandas_udf(shared_lines, "array<int>")
    keep = F.pandas_udf(main_text, "string")
    url = F.coalesce(F.col("url"), F.lit(""))
    own = pages.select("page_id", "url", parse(F.coalesce("html", F.lit(""))).alias("x"))
    own = own.select("page_id", "url", F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"), "x.*")
    own = materialize(own.withColumn("__row", F.monotonically_increasing_id()), "pages-lines")
    # Every page is aligned with its neighbour, by hashes alone. Texts are joined only to the lines in
    # whose place the markup says nothing.
    pairs = nearest_pages(own.where("host <> ''").select("__row", "host", "path"))
    hashes = own.select("__row", "hashes", F.array_contains("parts", F.lit(PLAIN)).alias("plain"))
    other = own.select(F.col("__row").alias("__nearest"), F.col("hashes").alias("__other"))
    aligned = hashes.join(pairs, "__row").join(other, "__nearest").select("__row", "plain", align("hashes", "__other").alias("shared"))
    aligned = materialize(aligned, "pages-shared").where("plain").select("__row", "shared")
    found = own.join(aligned, "__row", "left")
    return found.select("page_id", "url", keep("lines", "parts", "shared").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
