"""Main text of web pages by consensus of a host's pages.

Every page scores its containers and votes for the generalised path (tags and classes, digits folded) of the one that
holds the article; Spark counts the votes per host and path. Then each page is read again with its host's leading paths:
the first that holds MOST of the page's text is used; a page without such a container falls back to its own best one.

Defined results: null, empty or tagless html gives its decoded text as a body would, so an empty string when there is none;
a null url belongs to the host "" and votes there; repeated rows vote each; equal votes go to the path with more text, then
to the greater path; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.url_rules import host_path
from gridloom.session import materialize

#: A comment, the beginning of an element whose content is no text, a declaration, or a tag with its attributes; a tag that
#: is not closed ends before the next one.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|template|svg|noscript|iframe|select|object)\b[^<>]*>"
    r"|<[!?][^<>]*>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']*+(?:\"[^\"]*+\"|'[^']*+')?+)*?)>",
    re.S | re.I,
)
#: Content of these goes on to the page's end where it is not closed; other such elements end at once then, and where
#: their tag closes itself.
TO_THE_END = frozenset("script style title textarea".split())
#: A whole attribute, so that neither the end of a longer name nor what a value quotes is taken for one.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div td th table tbody tr center blockquote".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre figure figcaption address details summary nav header footer aside form "
    "fieldset thead tfoot caption menu dialog br hr".split()
)
OUTSIDE = frozenset("nav header footer aside form menu dialog button label input head".split())
#: Parts of a class, id or role that mark what is not the article, unless too much of the page is in it.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side aside rail widget footer foot header masthead topbar comment comments reply "
    "replies respond discussion disqus cookie cookies consent notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup share sharing social related recommended recommendations pager pagination login "
    "search toolbar complementary contentinfo disclaimer gdpr paywall".split()
)
CLOSES_P = BLOCKS - {"br"}
SAME = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th"}
#: A container holds the article when it holds this share of a page's text outside the parts above.
MOST = 0.8
#: A word marks an element with this share of the text as outside only if the lead article holds LEAD of it elsewhere.
HALF, LEAD = 0.5, 0.2
#: Paths of a host that are tried on its pages; where none fits, the page's own is used.
TRIED = 8


def _outside(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element is no part of the article, whether a word says so, and its step in a path."""
    step, out, marked = tag, tag in OUTSIDE, False
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            name = name.lower()
            if name in ("hidden", "aria-hidden"):
                out = out or value != "false"
                continue
            if name not in ("class", "id", "role"):
                continue
            parts = re.split(r"[^a-z0-9]+", value)
            if tag not in ("html", "body", "main", "article") and not OUTSIDE_WORDS.isdisjoint(parts):
                marked = True
            if name == "class" and value:
                step = tag + "".join("." + c for c in sorted(set(re.sub(r"\d+", "0", value).split())))
    return out, marked, step


def _sums(chunks: list[str | None]) -> list[int]:
    """Length of the text before each chunk."""
    sums = [0]
    for c in chunks:
        sums.append(sums[-1] + (len(c.strip()) if c else 0))
    return sums


def _without(marks: list[list[int]], leads: list[list[int]], chunks: list[str | None]) -> list[tuple[int, int]]:
    """Spans of the marked elements that are no part of the article, apart from each other, in page order.

    The lead is the longest article or main. An element around it stays; so does one with HALF of the text, unless the
    lead holds LEAD of the text outside marked elements. Nothing goes when nothing would be left.
    """
    sums = _sums(chunks)
    total = sums[-1]

    def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not out or hi > out[-1][1]:
                out.append((max(lo, out[-1][1]) if out else lo, hi))
        return out

    def size(spans: list[tuple[int, int]], lo: int, hi: int) -> int:
        return sum(max(0, sums[min(b, hi)] - sums[max(a, lo)]) for a, b in spans if a < hi and b > lo)

    a, b = max(leads, key=lambda s: sums[s[1]] - sums[s[0]], default=(0, 0))
    held = sums[b] - sums[a] > 0
    tried = [(lo, hi) for lo, hi in marks if not (held and lo <= a and b <= hi)]
    elsewhere = held and sums[b] - sums[a] - size(apart(tried), a, b) >= LEAD * total
    gone = apart([(lo, hi) for lo, hi in tried if elsewhere or sums[hi] - sums[lo] < HALF * total])
    return gone if size(gone, 0, len(chunks)) < total else []


def parse(page: str) -> tuple[list[tuple[str, int, int]], list[str | None]]:
    """Containers (path, first and last chunk) in page order, and chunks of article text; None is a break."""
    chunks: list[str | None] = []
    containers: list[list] = [["", 0, 0]]
    marks: list[list[int]] = []
    leads: list[list[int]] = []
    stack: list[tuple[str, str, bool, list[list]]] = [("", "", False, [])]  # tag, path, outside, spans that end with it
    at = 0

    def pop(tag: str, barriers: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                for _, _, _, ends in stack[k:]:
                    for span in ends:
                        span[-1] = len(chunks)
                del stack[k:]
                return
            if stack[k][0] in barriers:
                return

    def text(raw: str) -> None:
        if raw and not stack[-1][2]:
            chunks.append(entities.unescape(raw))

    never: set[str] = set()  # elements that are not closed any more

    def after(tag: str, begin: int, closed: bool) -> int:
        """Where the page goes on after an element whose content is no text."""
        if tag not in TO_THE_END and (closed or tag in never):
            return begin
        end = None if tag in never else re.compile(rf"</{tag}\s*>", re.I).search(page, begin)
        if end is None:
            never.add(tag)
            return len(page) if tag in TO_THE_END else begin
        return end.end()

    while m := MARKUP.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end() if m[1] is None else after(m[1].lower(), m.end(), m[0].endswith("/>"))
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if block:
            chunks.append(None)
        if m[2]:
            if tag not in VOID:
                pop(tag, _NONE)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            pop("p", CONTAINERS)
        if tag in SAME:
            pop(tag, _LISTS)
        out, marked, step = _outside(tag, m[4])
        _, path, above, _ = stack[-1]
        out = out or above
        ends: list[list] = []
        if tag in CONTAINERS:
            path = f"{path}>{step}"
            if not out:
                containers.append([path, len(chunks), -1])
                ends.append(containers[-1])
        if not m[4].endswith("/") or block:
            if marked and not out:
                marks.append([len(chunks), -1])
                ends.append(marks[-1])
            if tag in ("article", "main") and not out:
                leads.append([len(chunks), -1])
                ends.append(leads[-1])
            stack.append((tag, path, out, ends))
    text(page[at:])
    for span in (*containers, *marks, *leads):
        if span[-1] < 0 or span[0] == "":
            span[-1] = len(chunks)
    for lo, hi in _without(marks, leads, chunks) if marks else ():
        chunks[lo:hi] = [c and "" for c in chunks[lo:hi]]
        containers = [c for c in containers if not (lo <= c[1] and c[2] <= hi) or c[0] == ""]
    return [tuple(c) for c in containers], chunks


_NONE: frozenset[str] = frozenset()
_LISTS = frozenset(["ul", "ol", "dl", "table"])


def best(containers: list[tuple[str, int, int]], chunks: list[str | None]) -> tuple[str, int]:
    """The path of the container that holds the article, and the length of its text.

    Of the containers with MOST of the text: the outermost article, else the outermost main. Else the innermost with all of
    it: what is unmarked around the largest container is text, too.
    """
    sums = _sums(chunks)
    total = sums[-1]
    large = [(p, sums[hi] - sums[lo]) for p, lo, hi in containers if total and sums[hi] - sums[lo] >= MOST * total]
    if not large:
        return "", 0
    for tag in ("article", "main"):
        for p, n in large:
            if p.rpartition(">")[2].split(".")[0] == tag:
                return p, n
    return [x for x in large if x[1] == total][-1]


def path_for(containers: list[tuple[str, int, int]], chunks: list[str | None], paths: Sequence[str]) -> str:
    """The first of ``paths`` whose containers hold MOST of the page's text, else the page's own best one."""
    sums = _sums(chunks)
    for path in paths:
        held = end = 0
        for p, lo, hi in containers:
            if p == path and hi > end:
                held += sums[hi] - sums[max(lo, end)]
                end = hi
        if held and held >= MOST * sums[-1]:
            return path
    return best(containers, chunks)[0]


def main_text(containers: list[tuple[str, int, int]], chunks: list[str | None], path: str) -> str:
    """Text of all containers with this path, in page order."""
    spans = [(lo, hi) for p, lo, hi in containers if p == path]
    out: list[str] = []
    end = 0
    for lo, hi in spans:
        out += [" " if c is None else c for c in chunks[max(lo, end) : hi]]
        out.append(" ")
        end = max(end, hi)
    return " ".join("".join(out).split())


def vote(pages: DataFrame) -> DataFrame:
    """host, path, votes (pages) and n (length of their text) of the pages (host, html), summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best(*parse(x or "")) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["host", "path", "n"])

    ballots = pages.select("host", "html").mapInArrow(run, "host string, path string, n long")
    return ballots.where(F.col("path") != "").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("n").alias("n"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, and the path used for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used = [], []
            for h, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                parsed = parse(h or "")
                used.append(path_for(*parsed, paths or ()))
                texts.append(main_text(*parsed, used[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64()), pa.array([p or None for p in used], pa.string())],
                names=["page_id", "url", "text", "n_chars", "path"],
            )

    host, _ = host_path(F.col(url))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("n"), F.desc("path"))
    leading = vote(rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TRIED)
    winners = leading.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path")))["path"].alias("paths"))
    # one row per host, stored so that its size is known before the join: pages are dealt by host only where it is large
    winners = materialize(winners, "winners")
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
