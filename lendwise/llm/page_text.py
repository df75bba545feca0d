"""Main text of web pages: markup structure, and differences between pages with the nearest URLs.

A page is read once into blocks. Blocks inside menus, notices, adverts, forms and the like are left out by their
elements. What remains is compared with the page of the same host whose path is nearest and which is no copy: shared
lines, found by a longest common subsequence, are the site's own and are deleted. Inside the article one neighbour is no
evidence: paragraphs, headings, lists, quotations and tables stay, and of other lines only those at the article's edge
go that stand in most of the pages compared and leave at least half of the article.

Only hashes and lengths of lines travel between pages. Distinct line lists of a host are numbered along its paths, and
dealt to blocks of consecutive numbers with ``LOOK`` neighbours at either end, so a host with very many pages is spread
over many tasks, and copies, exact ones in any number and some edited ones, do not hide the next page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import content_key, small_batches, written

PAGE_BLOCK = 64
TASK_PAGES = 2048
COPY_SHARE = 0.8
ARTICLE_SHARE = 0.5
LOOK = 8
BROADCAST_ROWS = 50_000

#: Elements by their role in HTML: fixed values.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
LEFT_OUT = (
    "aside", "audio", "button", "canvas", "datalist", "dialog", "fieldset", "footer", "form", "head", "header", "label",
    "map", "menu", "nav", "object", "option", "search", "select", "svg", "video",
)
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr",
)
CONTENT = ("article", "main")
PROSE = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption")
UNMARKED = ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6")
ROLES = ("alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search")
#: Words in class and id that mark what is not the article: fixed values.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "notices pagination popup promo promotion promoted recommended related replies reply respond share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: A class or id with one of these words tells what an element around it has or lacks, as has-sidebar or no-comments.
ABOUT = frozenset("has have no non not with without".split())

# Where a block stands.
OUTSIDE, LOOSE, IN_PROSE = 0, 1, 2

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<other>[!?])[^>]*+(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*?)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _left_out(name: str, attrs: str) -> str:
    """Why an element is left out: ``element`` by what it is, ``mark`` by its class or id; empty if it stays."""
    if name in LEFT_OUT:
        return "element"
    why = ""
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "element"
        if key == "role" and value.lower() in ROLES:
            return "element"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "element"
        if key in ("class", "id") and name not in UNMARKED:
            for token in value.split():
                words = {token.lower()} if name in CONTENT else {w.lower() for w in _WORD.findall(token)}
                if not MARKS.isdisjoint(words) and ABOUT.isdisjoint(words):
                    why = "mark"
    return why


def page_blocks(page: str | None) -> list[tuple[str, int]]:
    """The page's text blocks that no element leaves out, and where each stands: outside of every article or main
    element, loose in one, or in an element for prose there.

    Tags without an end, ends without a tag and a page cut anywhere are taken as they come; the first
    article, if it begins inside an unclosed menu or notice, ends that. On a page without article, an element that holds
    more than half of the page's text stays whatever its class or id.
    """
    blocks, main = _blocks(page, frozenset())
    return _blocks(page, main)[0] if main and not any(p for _, p in blocks) else blocks


def _blocks(page: str | None, main: frozenset[int]) -> tuple[list[tuple[str, int]], frozenset[int]]:
    """Blocks, and where the elements start that class or id leave out though they hold most of the text; ``main`` are
    such elements, to stay."""
    blocks: list[tuple[str, int]] = []
    held: list[str] = []
    open_tags: list[tuple[str, bool, int, int]] = []  # name, whether it starts a part left out, mark's place, text before
    skipped = inside = articles = seen = 0
    marked: list[tuple[int, int]] = []  # text inside, and place, of elements left out by class or id
    at, page = 0, page or ""

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            around = next((n for n, *_ in reversed(open_tags) if n not in INLINE), "")
            blocks.append((text, OUTSIDE if not inside else IN_PROSE if around in PROSE else LOOSE))
        held.clear()

    def ended(place: int, before: int) -> None:
        if place >= 0:
            marked.append((seen - before, place))

    while at < len(page):
        start = page.find("<", at)
        stop = len(page) if start < 0 else start
        seen += stop - at
        if not skipped:
            held.append(page[at:stop])
        if start < 0:
            break
        tag = _TAG.match(page, start)
        if not tag:
            if not skipped:
                held.append("<")
            at = start + 1
            continue
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if name == "br" or name == "hr":
            held.append(" ")
            continue
        if name not in INLINE and not skipped:
            flush()
        if tag["close"]:
            if any(n == name for n, *_ in open_tags):
                while True:
                    n, hides, place, before = open_tags.pop()
                    ended(place, before)
                    skipped -= hides
                    inside -= n in CONTENT
                    if n == name:
                        break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in VOID or (tag["attrs"] or "").endswith("/") and name in ("svg", "path"):
            continue
        why = _left_out(name, tag["attrs"] or "")
        hides = bool(why) and start not in main
        if name in CONTENT and not hides:
            if skipped and not articles:
                open_tags.clear()  # an unclosed menu before the first article
                skipped = 0
            articles += 1
        if name in ("p", "li") and open_tags and open_tags[-1][:2] == (name, False):
            open_tags.pop()
        open_tags.append((name, hides, start if hides and why == "mark" else -1, seen))
        skipped += hides
        inside += name in CONTENT
    if not skipped:
        flush()
    for _, _, place, before in open_tags:
        ended(place, before)
    return blocks, frozenset(place for size, place in marked if 2 * size > seen)


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        best = row.copy()
        best[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row = np.maximum.accumulate(best)
    return row


def common_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (Hirschberg: memory grows with one side)."""
    todo, found = [(0, len(a), 0, len(b))], []
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append(j)
        if i == j or k == m:
            continue
        if j - i == 1:
            if (b[k:m] == a[i]).any():
                found.append(i)
            continue
        half = (i + j) // 2
        front, back = _lengths(a[i:half], b[k:m]), _lengths(a[half:j][::-1], b[k:m][::-1])[::-1]
        cut = k + int(np.argmax(front + back))
        todo += [(i, half, k, cut), (half, j, cut, m)]
    return sorted(found)


def deleted_lines(
    lines: np.ndarray, places: np.ndarray, sizes: np.ndarray, wide: np.ndarray, other: np.ndarray
) -> list[int] | None:
    """Which lines of a page to delete, given its line hashes, where they stand, their lengths, which of them stand in
    most pages nearby, and the partner's hashes. None if the partner shares most lines: a copy of the page shows nothing
    about the site."""
    shared = common_lines(lines, other)
    if len(shared) >= COPY_SHARE * max(len(lines), len(other), 1):
        return None
    article = np.nonzero(places != OUTSIDE)[0].tolist()
    loose = {i for i in shared if places[i] == LOOSE and wide[i]}
    edges: set[int] = set()
    for side in (article, article[::-1]):
        for i in side:
            if i not in loose:
                break
            edges.add(i)
    if sizes[sorted(edges)].sum() > ARTICLE_SHARE * sizes[article].sum():
        edges = set()
    return [i for i in shared if places[i] == OUTSIDE or i in edges]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (lower case) and path of a URL; empty if it has none."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path.rstrip("/")
    except ValueError:
        return "", ""


def nearness(a: str, b: str) -> int:
    """How many leading path segments two paths share, then characters of the next one."""
    x, y = a.split("/"), b.split("/")
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    rest = 0
    if n < min(len(x), len(y)):
        while rest < min(len(x[n]), len(y[n])) and x[n][rest] == y[n][rest]:
            rest += 1
    return n * 1000 + min(rest, 999)


def _line_rows(pages: DataFrame) -> DataFrame:
    """Light rows: host, path, line hashes and lengths of each page, and a key ``(c1, c2)`` of its host and lines."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blocks = [page_blocks(h) for h in batch["html"]]
            urls = [split_url(u) for u in batch["url"]]
            yield pd.DataFrame(
                {"k1": batch["k1"], "k2": batch["k2"], "host": [u[0] for u in urls], "path": [u[1] for u in urls],
                 "lines": [[line_hash(t) for t, _ in b] for b in blocks], "inside": [[p for _, p in b] for b in blocks],
                 "sizes": [[len(t) for t, _ in b] for b in blocks]}
            )

    k1, k2 = content_key("page_id", "url", "html")
    kind = "k1 bigint, k2 bigint, host string, path string, lines array<bigint>, inside array<int>, sizes array<int>"
    found = pages.select("url", "html", k1.alias("k1"), k2.alias("k2")).mapInPandas(read, kind).where("host <> ''")
    c1, c2 = content_key("host", "lines", "inside")
    return written(found.withColumn("c1", c1).withColumn("c2", c2), "lines")


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``n``, the row's number along host, path and key: sorted by range, then offset by the ranges' sizes. Also
    returns how many rows there are."""
    order = ["host", "path", "c1", "c2"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("place", F.monotonically_increasing_id()), "pages")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one a partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["n"]
    offsets = placed.sparkSession.createDataFrame(starts or [(0, 0)], "part bigint, base bigint")
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("n", F.col("base") + within), total


def shared_line_positions(pages: DataFrame, page_block: int = PAGE_BLOCK) -> DataFrame:
    """``(k1, k2, gone)``: for pages with lines to delete, their positions among the page's blocks."""
    lines = _line_rows(pages)
    light = F.struct("path", "host", "lines", "inside", "sizes")
    distinct = lines.groupBy("c1", "c2").agg(F.min(light).alias("page")).select("c1", "c2", "page.*")
    numbered, total = _numbered(distinct)
    low, high = F.floor((F.col("n") - LOOK) / page_block), F.floor((F.col("n") + LOOK) / page_block)
    rows = numbered.withColumn("group", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n").reset_index(drop=True)
        group, out = int(frame["group"].iloc[0]), []
        hosts, paths, numbers = frame["host"].tolist(), frame["path"].tolist(), frame["n"].tolist()
        held = [set(lines) for lines in frame["lines"]]
        for i in range(len(frame)):
            row = frame.iloc[i]
            if row["n"] // page_block != group or not len(row["lines"]):
                continue
            near = [i + d * side for d in range(1, LOOK + 1) for side in (-1, 1)]
            near = [j for j in near if 0 <= j < len(frame) and hosts[j] == hosts[i] and abs(numbers[j] - numbers[i]) <= LOOK]
            near.sort(key=lambda j: -nearness(paths[i], paths[j]))
            own, places, sizes = np.asarray(row["lines"]), np.asarray(row["inside"]), np.asarray(row["sizes"])
            wide = np.array([len(near) > 1 and 2 * sum(x in held[j] for j in near) > len(near) for x in row["lines"]])
            for j in near:
                gone = deleted_lines(own, places, sizes, wide, np.asarray(frame["lines"][j]))
                if gone is None:
                    continue  # a copy: the next nearest page tells more
                if gone:
                    out.append((row["c1"], row["c2"], gone))
                break
        return pd.DataFrame(out, columns=["c1", "c2", "gone"])

    found = written(
        rows.select("c1", "c2", "host", "path", "lines", "inside", "sizes", "n", "group")
        .repartition(total // TASK_PAGES + 1, "group")  # light rows, but slow to compare
        .groupBy("group").applyInPandas(pair, "c1 bigint, c2 bigint, gone array<int>"),
        "found",
    )
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return lines.select("k1", "k2", "c1", "c2").join(found, ["c1", "c2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "gone")


def main_text(page: str | None, gone: list[int] | None = None) -> str:
    """Blocks that stay, joined by one space: the article's, or all that are left if the page has none."""
    blocks = page_blocks(page)
    drop = set() if gone is None else set(gone)
    kept = [(t, p) for i, (t, p) in enumerate(blocks) if i not in drop]
    if any(p for _, p in kept):
        kept = [(t, p) for t, p in kept if p]
    return " ".join(t for t, _ in kept)


def extract_main_text(pages: DataFrame, page_block: int = PAGE_BLOCK) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages(page_id, url, html)``; ``text`` is empty if there is none.

    A null html is an empty page; a page without host, or alone on its host, is read by its elements only; repeated
    rows get equal results; null ids stay null; other columns are not read; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    gone = written(shared_line_positions(pages, page_block), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    k1, k2 = content_key("page_id", "url", "html")
    joined = pages.select("page_id", "url", "html", k1.alias("k1"), k2.alias("k2")).join(gone, ["k1", "k2"], "left")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, drops in batches:
            yield pd.Series([main_text(h, d) for h, d in zip(htmls, drops)], dtype=object)

    return joined.select("page_id", "url", read("html", "gone").alias("text"))
