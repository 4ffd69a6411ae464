"""Main text of web pages by removal of site templates.

Pages are parsed into element trees. Two hashes of subtrees are counted per host in Spark:

* of every block element its tag, names and contents, link targets left out;
* of every container (a block that isn't itself running text) its place alone: the containers around it and their names,
  digits and all text masked. So a menu whose entries differ from page to page recurs too.

A subtree is template when it is on many different pages of a host; by its place alone only where it holds a small share
of its pages' text, no heading, and lies outside article and main elements. Templates are deleted first. Elements that by
tag, role or name are never part of an article go as well, for hosts of few pages. What is left is the text: of the article
and main elements if there are any, else of the page.

Pages count as different by the least and the greatest hash of their sentences, so that copies of an article with a few
words changed don't make its paragraphs template. Paragraphs are deleted only at the edges of their container, headings
and the running text of article and main elements never: passages that several articles of a host share are no template.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.session import cut, join_sized

#: A subtree is template when it is on at least this many different pages of the host, and on no more than so many pages for
#: each different one.
LEAST_PAGES, MOST_COPIES = 5, 5
#: A container's place is template when it holds at most this share of the text of its pages.
MOST_SHARE = 0.25
#: Paragraphs at either end of a container that may be template.
EDGE = 2
#: Template subtrees of all hosts that are broadcast at most; beyond that they are joined to the pages with a shuffle.
BROADCAST_ROWS = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "xmp", "noembed", "noframes", "iframe", "template"))
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead"
    " title tr ul".split()
)
#: Blocks of running text.
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
#: Of these, the ones that are prose wherever they stand, and headings.
PROSE, HEADING = frozenset(("p", "blockquote", "pre")), frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of the article.
DROPPED = frozenset("head title nav footer aside form noscript button select textarea svg dialog menu object canvas".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-?bar|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead"
    r"|comments?|replies|disqus|cookies?|notice|consent|gdpr|newsletter|subscribe|subscription|share|sharing|social|related|popup|modal"
    r"|overlay|widget|pagination|pager|toolbar|login|signup|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|disqus)(?:$|[\s_-])", re.IGNORECASE)
#: An open element of the key ends where one of these begins.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
}
#: Elements that an implied end never reaches beyond.
FENCE = frozenset("ul ol dl table select article section div main body html td th".split())

#: Elements that each of these ends.
CLOSES = {name: tuple(k for k, by in CLOSED_BY.items() if name in by) for name in set().union(*CLOSED_BY.values())}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
DIGITS = re.compile(r"\d+")
SENTENCE = re.compile(r"[.!?\n]\s+")


class Page:
    """Elements in page order: ``tag``, ``parent`` and ``attributes`` by number, and ``items``: (element, text), (element, None) at a
    block's edge."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes = [""], [-1], [{}]
        self.items: list[tuple[int, str | None]] = []
        # Open elements; the depths of those of each name, and of those that stop implied ends.
        self._open, self._depths, self._fences = [0], {}, [0]
        at = 0
        for m in iter(lambda: TOKEN.search(source, at), None):
            self._text(source[at : m.start()])
            at = m.end()
            closing, name, rest = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
            if not name:
                continue
            if closing:
                self._close(name)
                continue
            self._begin(name, rest)
            if name in RAW and not rest.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
                self._close(name)
        self._text(source[at:])

    def _text(self, text: str) -> None:
        if text:
            self.items.append((self._open[-1], html.unescape(text)))

    def _begin(self, name: str, rest: str) -> None:
        if name in BLOCK and name not in ("br", "option"):
            self._end_implied(("p",))
        self._end_implied(CLOSES.get(name, ()))
        k = len(self.tag)
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.attributes.append({a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(rest)} if rest.strip() else {})
        if name in BLOCK:
            self.items.append((k, None))
        if name not in VOID:
            self._depths.setdefault(name, []).append(len(self._open))
            if name in FENCE:
                self._fences.append(len(self._open))
            self._open.append(k)

    def _end_implied(self, names: tuple[str, ...]) -> None:
        depth = max((d[-1] for n in names if (d := self._depths.get(n))), default=0)
        if depth and depth >= self._fences[-1]:
            self._cut(depth)

    def _cut(self, depth: int) -> None:
        for k in reversed(self._open[depth:]):
            name = self.tag[k]
            self._depths[name].pop()
            if name in FENCE:
                self._fences.pop()
            if name in BLOCK:
                self.items.append((k, None))
        del self._open[depth:]

    def _close(self, name: str) -> None:
        if depths := self._depths.get(name):
            self._cut(depths[-1])

    def article(self) -> list[bool]:
        """Of each element, whether it is an article or main element or inside of one."""
        out = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            out[k] = out[self.parent[k]] or self.tag[k] in ("article", "main") or self.attributes[k].get("role") == "main"
        return out

    def dropped(self, inside: list[bool]) -> list[bool]:
        """Of each element, whether it or one around it is no part of an article by tag, role or name."""
        out = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            p, tag, own = self.parent[k], self.tag[k], self.attributes[k]
            bad = tag in DROPPED or tag == "header" and not inside[k]
            if not bad and own and tag not in ("html", "body", "main"):
                named = f"{own.get('class', '')} {own.get('id', '')}"
                bad = own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden") == "true"
                if not bad and named.strip():
                    bad = COMMENT.search(named) is not None if tag == "article" else NAMES.search(named) is not None
                    bad = bad and not (inside[k] and tag in TEXT_BLOCK | {"header"})
            out[k] = out[p] or bad
        return out

    def containers(self) -> list[int]:
        """Of each element, the nearest block at or around it that isn't running text."""
        out = [0] * len(self.tag)
        for k in range(1, len(self.tag)):
            tag = self.tag[k]
            out[k] = k if tag in BLOCK and tag not in TEXT_BLOCK and tag not in VOID else out[self.parent[k]]
        return out

    def _label(self, k: int) -> str:
        own = self.attributes[k]
        return DIGITS.sub("0", f"{self.tag[k]}\0{own.get('class', '')}\0{own.get('id', '')}\0") if own else self.tag[k]

    def contents(self, inside: list[bool], container: list[int]) -> dict[int, int]:
        """Signed 64-bit hash of contents of each block's subtree that may be template."""
        parts: list[list[str]] = [[] for _ in self.tag]
        prose: dict[int, list[int]] = {}
        for k, text in self.items:
            if text and (shown := " ".join(text.split())):
                parts[k].append(shown)
        out: dict[int, int] = {}
        for k in range(len(self.tag) - 1, 0, -1):
            if not parts[k]:
                continue
            tag = self.tag[k]
            h = xxhash.xxh64_intdigest("\0".join([self._label(k), *parts[k]]).encode(), 9)
            parts[self.parent[k]].append(f"{h:x}")
            if tag not in BLOCK or tag in HEADING or tag in ("html", "head", "body", "title") or inside[k] and container[k] != k:
                continue
            if tag in PROSE:
                prose.setdefault(container[k], []).append(k)
            out[k] = h - (1 << 64) if h >> 63 else h
        for own in prose.values():
            for k in own[EDGE:-EDGE]:
                del out[k]
        return out

    def places(self, inside: list[bool], container: list[int]) -> dict[int, tuple[int, int]]:
        """Of each container that may be template by its place: the place's signed 64-bit hash and its characters."""
        size, headed = [0] * len(self.tag), set()
        for k, text in self.items:
            if text and (n := len(text) - text.count(" ")):
                size[container[k]] += n
                while k and k != container[k]:
                    if self.tag[k] in HEADING:
                        headed.add(container[k])
                    k = self.parent[k]
        place, out = [1] * len(self.tag), {}
        for k in range(1, len(self.tag)):
            if container[k] != k:
                place[k] = place[self.parent[k]]
                continue
            place[k] = h = xxhash.xxh64_intdigest(self._label(k).encode(), place[self.parent[k]])
            if size[k] and k not in headed and not inside[k] and self.tag[k] not in ("html", "head", "body", "title"):
                out[k] = (h - (1 << 64) if h >> 63 else h, size[k])
        return out

    def identity(self) -> tuple[int, int]:
        """The least and the greatest hash of the page's sentences; of a page of short ones, the hash of its text."""
        found = {zlib.crc32(x.encode()) for _, text in self.items if text and len(text) > 30 for x in SENTENCE.split(text) if len(x) > 20}
        if not found:
            found = {zlib.crc32("\0".join(text for _, text in self.items if text).encode())}
        return min(found), max(found)

    def text(self, template: frozenset[int] | set[int], rules: bool = True) -> str:
        """The article's blocks, white space within each turned into one space, joined by one space."""
        inside, container = self.article(), self.containers()
        skipped = self.dropped(inside) if rules else [tag in RAW or tag == "head" for tag in self.tag]
        silent: set[int] = set()
        if template:
            for k, h in self.contents(inside, container).items():
                if h in template:
                    skipped[k] = True
            silent = {k for k, (h, _) in self.places(inside, container).items() if h in template}
        for k in range(1, len(self.tag)):
            skipped[k] = skipped[k] or skipped[self.parent[k]]
        told = any(text and inside[k] and not skipped[k] and not text.isspace() for k, text in self.items)
        blocks, now = [], []
        for k, text in self.items:
            if text is None:
                blocks.append("".join(now))
                now = []
            elif not skipped[k] and (inside[k] or not told) and container[k] not in silent:
                now.append(text)
        blocks.append("".join(now))
        return " ".join(x for b in blocks if (x := " ".join(b.split())))


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(uid, host, subtree, least, greatest, own, whole): each hash of a page once, the page's identity, and for places the
    characters there and on the page."""
    for b in batches:
        columns: tuple[list, ...] = ([], [], [], [], [], [], [])
        for uid, host, source in zip(b["uid"], b["host"], b["html"], strict=True):
            page = Page(source)
            inside, container = page.article(), page.containers()
            rows = dict.fromkeys(page.contents(inside, container).values(), (0, 1))
            places = page.places(inside, container)
            if places:
                whole = sum(len(t) - t.count(" ") for k, t in page.items if t and page.tag[k] not in RAW and page.tag[k] != "title")
                for h, n in places.values():
                    rows[h] = rows.get(h, (0,))[0] + n, whole
            least, greatest = page.identity()
            for h, (own, whole) in rows.items():
                for c, v in zip(columns, (uid, host, h, least, greatest, own, whole), strict=True):
                    c.append(v)
        yield pd.DataFrame(dict(zip(("uid", "host", "subtree", "least", "greatest", "own", "whole"), columns, strict=True)))


def _seen(rows: DataFrame) -> DataFrame:
    return rows.mapInPandas(_subtrees, "uid long, host string, subtree long, least long, greatest long, own long, whole long")


def templates(seen: DataFrame) -> DataFrame:
    """(host, subtree): hashes of the subtrees that recur on many different pages of the host."""
    counts = seen.groupBy("host", "subtree").agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.countDistinct("least"), F.countDistinct("greatest")).alias("different"),
        F.sum("own").alias("own"),
        F.sum("whole").alias("whole"),
    )
    recurs = (F.col("different") >= LEAST_PAGES) & (F.col("n") <= F.col("different") * MOST_COPIES)
    return counts.where(recurs & (F.col("own") <= F.col("whole") * MOST_SHARE)).select("host", "subtree")


def _with_templates(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``subtrees``: their own hashes that are template. Joined by host and hash, so a host's pages and its
    templates spread over all tasks."""
    sized = found.withColumn("key", F.xxhash64("host", "subtree"))
    own = _seen(rows).select("uid", "host", "subtree").distinct().withColumn("key", F.xxhash64("host", "subtree"))
    counted = cut(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(sized, "key"))
    hits = join_sized(own.select("uid", "key"), counted.select("key", "n"), "key", "n", F.col("uid"), "inner")
    by_page = hits.join(own.select("uid", "key", "subtree"), ["uid", "key"]).groupBy("uid").agg(F.collect_set("subtree").alias("subtrees"))
    repeats = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).join(by_page, "uid")
    return join_sized(rows, cut(repeats), "uid", "n", F.xxhash64("page_id")).drop("n")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty page has the empty text; a null url counts as a host of its own name, "". Null or equal ids and equal
    rows keep their rows. Broken markup is read as far as it goes. An empty table gives an empty result; other columns are
    not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))).withColumn("uid", F.xxhash64("host", "html"))
    found = cut(templates(_seen(rows)))
    if found.count() <= BROADCAST_ROWS:
        known: dict[str, set[int]] = {}
        for r in found.collect():
            known.setdefault(r["host"], set()).add(r["subtree"])
        joined = rows.withColumn("subtrees", F.lit(None).cast("array<long>"))
    else:
        known = {}
        joined = _with_templates(rows, found)
    sent = pages.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for host, source, own in zip(b["host"], b["html"], b["subtrees"], strict=True):
                template = set(own.tolist()) if own is not None else sent.value.get(host, set())
                texts.append(Page(source).text(template))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.select("page_id", "url", "host", "html", "subtrees").mapInPandas(run, "page_id long, url string, text string, n_chars long")
