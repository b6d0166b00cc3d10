"""Main text of web pages: what no rule of markup and no template of the site takes away."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.shared import stored

# Names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "nobr", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var"}
#: Elements that are never main text.
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "datalist", "dialog", "template",
           "object", "svg", "canvas", "audio", "video", "map", "applet", "frameset"} | RAW
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert",
                 "menu", "menubar", "toolbar"}
#: Words of a class or an id that name what surrounds a text, and what readers add to it.
SURROUNDINGS = {"ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
                "promotion", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
                "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup",
                "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing",
                "social", "related", "recommended", "recommendations", "widget", "toolbar", "pagination", "pager",
                "searchbox", "skip"}
COMMENTS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion"}
MAIN = {"article", "main"}
#: Elements that hold running text: inside a declared article they are its text, however often they recur.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "caption", "figcaption"}
#: What an opening tag closes, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
_TAG, _OTHER = re.compile(rf"{_OTHER}|<(/?)([A-Za-z][^\s/>]*)", re.S), re.compile(rf"{_OTHER}|(?!)()()", re.S)
#: Attributes up to the end of the tag, a quoted value (its quote is the group) or the end of the page.
_ATTRIBUTES = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:(?!\s*+=)|\s*+=\s*+(?:[^\s>"'][^\s>]*+|(?=>|\Z))))*+"""
                         r"""(?:>|[^\s/>][^\s/>=]*+\s*+=\s*+(["'])|\Z)""")
#: Attributes that count; other quoted values are passed over, whatever they hold.
_NAMED = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>"']|\Z)"""
                    r"""|=\s*+(?:"[^"]*+"|'[^']*+')""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Ends:
    """Where the tags of a page end. Quoted values are read whole, however long. A tag that does not end outside of them
    ends at its first '>'; the quotes such a tag has met are remembered, so that no place is read again for each tag."""

    def __init__(self, page: str):
        self.page, self.last, self.lost = page, {c: page.rfind(c) for c in ">\"'"}, set()

    def after(self, place: int) -> int:
        """The place behind the tag whose name ends at ``place``, 0 if there is none."""
        if place > self.last[">"]:
            return 0
        met, at = [], place
        while at <= self.last[">"]:
            stop = _ATTRIBUTES.match(self.page, at)
            quote, at = stop[1], stop.end()
            if quote is None:
                if self.page[at - 1] == ">":
                    return at
                break
            if at > self.last[quote] or at in self.lost:
                break
            met.append(at)
            at = self.page.index(quote, at) + 1
        self.lost.update(met)
        return self.page.index(">", place) + 1


class _Node:
    __slots__ = ("tag", "up", "drop", "holds", "body", "hash", "text", "main", "kept")

    def __init__(self, tag: str, up: _Node | None, drop: int):
        self.tag, self.up, self.drop = tag, up, drop
        self.holds, self.text, self.body, self.hash, self.kept = False, False, xxhash.xxh64(tag), 0, None
        self.main = tag in MAIN or bool(up and up.main)


def _dropped(tag: str, attributes: str, main: bool) -> int:
    """0: kept; 1: surroundings by name, kept after all if it holds the article; 2: never kept.

    Inside the declared article (``main``) running text goes by no name, and other elements by a whole name alone, as
    ``ad``, but not ``ad-free``.
    """
    if tag in DROPPED:
        return 2
    if not attributes.strip(" /"):
        return 0
    found = 0
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and tag not in ("html", "body"):
            words = {w.lower() for w in _NAME.findall(value)}
            if main and tag in PROSE:
                continue
            if words & COMMENTS:
                return 2
            if tag not in MAIN and SURROUNDINGS & ({w.lower() for w in value.split()} if main else words):
                found = 1
        elif (name == "role" and value.lower() in DROPPED_ROLES) or name == "hidden" or (
                name == "aria-hidden" and value.lower() == "true") or (
                name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return 2
    return found


class Blocks(NamedTuple):
    """The ``texts`` that markup leaves, each with the number of the innermost subtree around it that a template may take away (``inside``, -1: none); of
    these subtrees their hashes (``marks``) and which one is around each (``around``, a smaller number); and ``trees``, the hashes of all on the page.

    A template takes no subtree that holds the article or the main part, or is prose in it.
    """

    texts: list[str]
    inside: list[int]
    marks: list[int]
    around: list[int]
    trees: list[int]


def blocks(page: str) -> Blocks:
    """What is left of a page, at a cost that grows with its length, however deep it is."""
    page = page or ""
    root = _Node("", None, 0)
    stack, out, open_text = [root], [], []
    tags, place = [], 0
    ends, pattern = _Ends(page), _TAG

    def flush():
        text = " ".join("".join(open_text).split())
        open_text.clear()
        if text:
            node = stack[-1]
            out.append((text, node))
            node.body.update("\0" + text)
            node.text = True

    def close(to: int):
        flush()
        while len(stack) > to:
            node = stack.pop()
            node.hash = node.body.intdigest() - (1 << 63)
            node.up.body.update(f"\1{node.hash}")
            node.up.text |= node.text
            if node.tag in MAIN and node.drop < 2:
                up = node.up
                while up and not up.holds:
                    up.holds = True
                    up = up.up
            tags.append(node)

    def opened(wanted: set, ends: set) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in wanted:
                return i
            if stack[i].tag in ends:
                return 0
        return 0

    while True:
        tag = pattern.search(page, place)
        if tag and tag[2] is not None and not (behind := ends.after(tag.end())):
            # No '>' follows.
            pattern = _OTHER
            tag = pattern.search(page, place)
        text = page[place:tag.start() if tag else len(page)]
        if text:
            open_text.append(html.unescape(text) if "&" in text else text)
        if not tag:
            break
        end, name = tag.groups()
        if name is None:
            place = tag.end()
            if tag[0].startswith("<![CDATA["):
                open_text.append(tag[0][9:].removesuffix("]]>"))
            continue
        attributes, place = page[tag.end():behind - 1], behind
        name = name.lower()
        if end:
            if name in INLINE and not any(n.tag == name for n in stack):
                continue
            if at := opened({name}, MAIN - {name}):
                close(at)
            elif name in ("p", "br"):
                flush()
            continue
        drop = _dropped(name, attributes, stack[-1].main)
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name in RAW:
            flush()
            shut = re.compile(rf"</{name}[\s/>]", re.I).search(page, place)
            place = len(page) if shut is None else shut.start()
            if shut:
                place = page.find(">", place) + 1 or len(page)
            continue
        if name in INLINE and not drop and not any(n.tag == name for n in stack):
            continue
        flush()
        if name in CLOSES and (at := opened(*CLOSES[name])):
            close(at)
        if name not in INLINE and stack[-1].tag == "p":
            close(len(stack) - 1)
        stack.append(_Node(name, stack[-1], drop or (2 if stack[-1].drop == 2 else 0)))
    close(1)
    flush()
    declared = root.holds
    texts, inside, marks, around = [], [], [], []
    root.kept = (True, False, -1)  # of a node: whether it stays, whether it is in the main part, its innermost removable subtree
    for text, node in out:
        path = []
        while node.kept is None:
            path.append(node)
            node = node.up
        stays, main, near = node.kept
        for node in reversed(path):
            stays = stays and not (node.drop == 2 or (node.drop == 1 and not node.holds))
            main = main or node.tag in MAIN
            if stays and _removable(node):
                marks.append(node.hash)
                around.append(near)
                near = len(marks) - 1
            node.kept = (stays, main, near)
        if stays and (main or not declared):
            texts.append(text)
            inside.append(near)
    return Blocks(texts, inside, marks, around, list({n.hash for n in tags if n.text and _removable(n)}))


def without(page: Blocks, gone: set[int]) -> list[str]:
    """The texts that lie in none of the subtrees ``gone``."""
    lost = []
    for mark, up in zip(page.marks, page.around, strict=True):
        lost.append(mark in gone or (up >= 0 and lost[up]))
    return [t for t, i in zip(page.texts, page.inside, strict=True) if i < 0 or not lost[i]]


def _removable(node: _Node) -> bool:
    return not (node.holds or node.tag in MAIN or node.tag in ("html", "body") or (node.main and node.tag in PROSE))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", min_pages: int = 5) -> DataFrame:
    """Main text of each page.

    Every page is cut into its element subtrees, whose hashes (tags and text) Spark counts per host. A subtree that
    recurs on ``min_pages`` pages of a host at least, however many pages the host has, is part of its template
    and goes (pages with the same HTML count once), unless it holds the page's declared article or is running text in it. Navigation, headers,
    footers, forms, adverts, comments and the like go by their tags, roles and names; where a page
    declares an article or a main part, what lies outside goes too. Pages of which no block that is left lies in a
    removable subtree are done; the blocks of the others meet the recurring subtrees in a join, by host
    and hash, so that a host with a third of all pages is spread out.

    Null and empty pages give an empty text; a null or malformed url counts as one host of its own; repeated rows give
    repeated rows. Returns ``page`` (the key), ``url``, ``text``. Columns but those named are not read.
    """
    wanted = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.col(page).alias("html"))
    lists = {"texts": T.StringType(), "inside": T.IntegerType(), "marks": T.LongType(), "around": T.IntegerType()}
    schema = T.StructType([
        wanted.schema["page"], wanted.schema["url"], T.StructField("row", T.LongType()), T.StructField("host", T.StringType()),
        T.StructField("digest", T.LongType()), T.StructField("trees", T.ArrayType(T.LongType())), T.StructField("text", T.StringType()),
        *[T.StructField(n, T.ArrayType(kind)) for n, kind in lists.items()]])
    arrow = {"texts": pa.string(), "inside": pa.int32(), "marks": pa.int64(), "around": pa.int32()}

    def cut(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for rows in got:
            for start in range(0, len(rows), 500):
                part = rows.slice(start, 500)
                htmls = part.column("html").to_pylist()
                found = [blocks(p) for p in htmls]
                left = [any(i >= 0 for i in f.inside) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page"), part.column("url"), pa.array(range(row, row + len(found)), pa.int64()),
                     pa.array([_host(u) for u in part.column("url").to_pylist()]),
                     pa.array([xxhash.xxh64_intdigest(p or "") - (1 << 63) for p in htmls], pa.int64()),
                     pa.array([f.trees for f in found], pa.list_(pa.int64())),
                     pa.array([None if more else " ".join(f.texts) for f, more in zip(found, left, strict=True)], pa.string()),
                     *[pa.array([getattr(f, n) if more else None for f, more in zip(found, left, strict=True)], pa.list_(kind))
                       for n, kind in arrow.items()]], names=schema.names)
                row += len(found)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, inside: pa.Array, marks: pa.Array, around: pa.Array, gone: pa.Array) -> pa.Array:
        pages_ = zip(*(c.to_pylist() for c in (texts, inside, marks, around, gone)), strict=True)
        return pa.array([" ".join(without(Blocks(t, i, m, a, []), set(g or ()))) for t, i, m, a, g in pages_], pa.string())

    parsed = stored(wanted.mapInArrow(cut, schema), "pages")
    recurring = (parsed.select("host", "digest", F.explode("trees").alias("tree")).groupBy("host", "tree").agg(F.count_distinct("digest").alias("n"))
                 .where(F.col("n") >= min_pages).select("host", "tree"))
    open_pages = parsed.where("texts is not null")
    inside = open_pages.select("row", "host", F.explode(F.array_distinct("marks")).alias("tree"))
    gone = inside.join(recurring, ["host", "tree"], "left_semi").groupBy("row").agg(F.collect_set("tree").alias("gone"))
    rest = open_pages.join(gone, "row", "left").select("page", "url", cleaned(*lists, "gone").alias("text"))
    return parsed.where("texts is null").select("page", "url", "text").unionByName(rest)


def _host(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""
