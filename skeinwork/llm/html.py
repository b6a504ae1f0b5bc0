"""Main text of web pages by consensus paths of their hosts.

Pass one parses every page, leaves out what is never article text (by element and by class or id), and scores the
containers that are left by the share of the page's text that they hold, in millionths. A container is named by its
generalised path: element names with their first class, digits as #. Paths go as hashes that are chained from container to
container, so time and memory grow with the page however deep it is. Spark adds the scores up by host and path,
pre-aggregated, so a host with a third of all pages costs a row per task and path; whole numbers add up alike in any
order. The host's path is the deepest that holds most of the text of its pages, or the outermost article or main around
it. Pass two parses the pages again and takes the containers on their host's path; a page that has none falls back on its
own best container.

Blocks follow block elements; br and inline markup are white space or nothing. Null html counts as empty; pages without
a host, a null url among them, vote as one group, by themselves if they have no path in common. Rows that repeat are each
extracted; an empty table gives an empty result, and extra columns aren't read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .urls import parts

_START = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?/]")
# the rest of a tag; of tags that begin within one another and aren't ended, three at most are in the midst of it at any
# place, as a quote takes the states outside, in "" and in '' to different ones: all matches together take linear time
_REST = re.compile(r"((?>[^<>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Elements without content, with raw content, that hold no article text, that are blocks, that hold articles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes xmp".split())
DROPPED = frozenset("head nav header footer aside form button select option menu svg object canvas audio video script style title textarea noscript template iframe noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("body article main section div td".split())
#: Parts of a class, id or role that mark menus, notices, adverts and reader comments.
MARKED = frozenset("""
ad ads adv advert adverts advertisement advertisements adsense adslot banner banners sponsor sponsored promo promos promotion
nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager toc header masthead footer footnav colophon
sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay
comment comments commentlist commentary respond reply replies disqus discussion share sharing social newsletter subscribe
signup login related recommended recirc outbrain taboola skip complementary contentinfo search
""".split())
#: Marks of reader comments, which may well be longer than the article; parts of a class that turn a mark around.
COMMENTS = frozenset("comment comments commentlist commentary respond reply replies disqus discussion".split())
NEGATED = frozenset("no non not without has have with hide hides".split())
_CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_LISTS = frozenset({"ul", "ol", "dl", "table", *CONTAINERS})
_STOPS = (BLOCKS, CONTAINERS, _LISTS)
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}


def _mark(word: str) -> str:
    """The mark that a class, id or role is, or begins or ends with; '' where there is none, or another part negates it."""
    if word in MARKED:
        return word
    p = [x for x in re.split("[-_]+", word) if x]
    if not p or not NEGATED.isdisjoint(p):
        return ""
    return p[0] if p[0] in MARKED else p[-1] if p[-1] in MARKED else ""


def _step(tag: str, attributes: str) -> tuple[str, bool, str]:
    """The generalised step of an element's path, whether it is hidden, and its mark: '', 'comments' or 'other'."""
    name, hidden, mark = "", False, ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden":
                hidden = True
            if key not in ("class", "id", "role"):
                continue
            words = value.lower().split()
            if key == "class" and words and not name:
                name = "." + re.sub("[0-9]+", "#", words[0])
            for w in words:
                if x := _mark(w):
                    mark = "comments" if x in COMMENTS and mark != "other" else "other"
    if tag in ("html", "body", "article", "main"):
        return tag + name, False, ""
    return tag + name, hidden, mark


class Paths:
    """The container paths of a page as a tree: for each its parent, its hash, its depth and the last step's name."""

    def __init__(self) -> None:
        self.parent, self.hash, self.depth, self.step = [0], [0], [0], [""]
        self._known: dict[tuple[int, str], int] = {}

    def under(self, parent: int, step: str) -> int:
        got = self._known.get((parent, step))
        if got is None:
            got = self._known[parent, step] = len(self.step)
            h = xxhash.xxh3_64_intdigest(step, self.hash[parent] & (2**64 - 1))
            self.parent.append(parent)
            self.hash.append(h - (1 << 64) * (h >> 63))
            self.depth.append(self.depth[parent] + 1)
            self.step.append(step)
        return got


class Tokens:
    """(start, end, element, whether it ends it, attributes) of the tags of a page from the place `at`, which whoever reads
    them may move on; comments and declarations have element ''. A tag with an odd quote ends at the next >; what has none
    after it is text. Every search for a mark that isn't there is made once, so the time is linear in the page."""

    def __init__(self, page: str) -> None:
        self.page, self.at, self._gt = page, 0, 0

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        page = self.page
        while m := _START.search(page, self.at):
            at = self.at = m.end()
            if m[0] == "<!--":
                end = page.find("-->", at)
                self.at = len(page) if end < 0 else end + 3
                yield m.start(), self.at, "", False, ""
            elif m[2] and (rest := _REST.match(page, at)):
                self.at = rest.end()
                yield m.start(), self.at, m[2].lower(), bool(m[1]), rest[1]
            else:
                if 0 <= self._gt < at:
                    self._gt = page.find(">", at)
                if self._gt >= 0:
                    self.at = self._gt + 1
                    yield m.start(), self.at, (m[2] or "").lower(), bool(m[1]), page[at : self._gt]


class Open:
    """The open elements of a page as a stack of (element, path, left out, innermost marked element around it), and where each
    element and each kind of element stands in it."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, int]] = []
        self._places: dict[object, list[int]] = {}

    @staticmethod
    def _keys(tag: str) -> list[object]:
        return [tag, *(kind for kind in _STOPS if tag in kind)]

    def push(self, tag: str, path: int, out: bool, around: int) -> None:
        for key in self._keys(tag):
            self._places.setdefault(key, []).append(len(self.stack))
        self.stack.append((tag, path, out, around))

    def close(self, k: int) -> None:
        while len(self.stack) > k:
            for key in self._keys(self.stack.pop()[0]):
                self._places[key].pop()

    def _top(self, key: object) -> int:
        return (self._places.get(key) or (-1,))[-1]

    def last(self, names, stop: frozenset = frozenset()) -> int:
        """The place of the innermost open element of these names, above any of `stop`; -1 if there is none."""
        k = max(map(self._top, names))
        return k if k >= self._top(stop) else -1


def blocks(page: str) -> tuple[Paths, list[tuple[int, str]]]:
    """The paths of a page, and (path, text) of each of its blocks that isn't left out, in page order. A marked element that
    holds most of the page's text stays, and so do comments that hold all of it."""
    paths = Paths()
    found: list[list[tuple[str, int | None, int]]] = []
    open_ = Open()
    stack = open_.stack
    marks: list[tuple[str, int]] = [("", 0)]  # mark, marked element around it
    run: list[tuple[str, int | None, int]] = []  # text, path, marked element around it
    endless: set[str] = set()  # elements with raw content that have no end tag any more

    def flush() -> None:
        if run:
            found.append(run.copy())
        run.clear()

    def say(text: str) -> None:
        if text and not (stack and stack[-1][2]):
            run.append((text, stack[-1][1], stack[-1][3]) if stack else (text, 0, 0))

    at, tags = 0, Tokens(page)
    for start, end, tag, closing, attributes in tags:
        say(page[at:start])
        at = end
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            run.append((" ", None, 0))
        if closing:
            # a stray end tag doesn't close the containers around it
            k = open_.last((tag,), frozenset() if tag in BLOCKS else BLOCKS)
            if k >= 0:
                open_.close(k)
            continue
        if tag in RAW:
            stop = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if stop is None:
                endless.add(tag)
            at = stop.end() if stop else (len(page) if tag in ("script", "style") else at)
            tags.at = at
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in _CLOSES_P and (k := open_.last(("p",), CONTAINERS)) >= 0:
            open_.close(k)
        if tag in _SIBLINGS and (k := open_.last(_SIBLINGS[tag], _LISTS)) >= 0:
            open_.close(k)
        step, hidden, mark = _step(tag, attributes)
        path, out, around = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (0, False, 0)
        if tag in CONTAINERS or hidden or mark:
            path = paths.under(path, step)
        if mark:
            marks.append((mark, around))
            around = len(marks) - 1
        open_.push(tag, path, out or hidden or tag in DROPPED, around)
    say(page[at:])
    flush()
    held, gone = [0] * len(marks), [False] * len(marks)
    if len(marks) > 1:
        for block in found:
            for text, _, around in block:
                held[around] += len("".join(text.split()))
        for i in range(len(marks) - 1, 0, -1):  # an element comes after the ones around it
            held[marks[i][1]] += held[i]
        for i, (mark, around) in enumerate(marks[1:], 1):
            stays = held[i] and (held[i] == held[0] if mark == "comments" else 2 * held[i] > held[0])
            gone[i] = gone[around] or not stays
    out_ = []
    for block in found:
        said = [x for x in block if not gone[x[2]]]
        text = " ".join(entities.unescape("".join(x[0] for x in said)).split())
        if text:
            out_.append((next(x[1] for x in said if x[1] is not None), text))
    return paths, out_


def shares(paths: Paths, got: list[tuple[int, str]]) -> dict[int, int]:
    """The share of a page's text under each container path that has any, in millionths."""
    held, total = [0] * len(paths.step), 0
    for path, text in got:
        held[path] += len(text)
        total += len(text)
    for i in range(len(held) - 1, 0, -1):  # a path comes after its parent
        held[paths.parent[i]] += held[i]
    return {i: n * 1_000_000 // total for i, n in enumerate(held) if i and n}


#: A container that holds this much is the main one, in millionths; one around it that holds so much more is taken instead.
MOST, MORE = 600_000, 20_000


def own_path(paths: Paths, share: dict[int, int]) -> int | None:
    """A page's own main container, by the same rule as chosen()."""
    chain = sorted((i for i, n in share.items() if n >= MOST), key=lambda i: paths.depth[i])
    if not chain:
        return None
    for want in ("article", "main"):
        for i in chain:
            if paths.step[i].split(".")[0] == want:
                return i
    k = len(chain) - 1
    while k and share[chain[k - 1]] > share[chain[k]] + MORE and paths.step[chain[k - 1]] != "html":
        k -= 1
    return chain[k]


def extract(page: str, path: int | None) -> str:
    """The text of a page's blocks under a path, told by its hash, or under the page's own best path if it has no such
    container, or no path is given."""
    paths, got = blocks(page)

    def under(goal: int | None) -> list[str]:
        inside = [goal is not None and h == goal for h in paths.hash]
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[paths.parent[i]]
        return [t for i, t in got if inside[i]]

    if text := under(path):
        return "\n".join(text)
    own = own_path(paths, shares(paths, got))
    return "\n".join(t for _, t in got) if own is None else "\n".join(under(paths.hash[own]))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, x in zip(batch.column("host").to_pylist(), batch.column("html")):
            paths, got = blocks(x.as_py() or "")
            rows += [(host, paths.hash[i], paths.depth[i], paths.step[i], n) for i, n in shares(paths, got).items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()))], ["host", "path", "depth", "step", "share"])


def chosen(chain: Column) -> Column:
    """The path of a chain of containers (array of struct(depth, share, path, step), outermost first): the outermost
    article, or else main, or else the innermost, from which containers around it that hold more text are taken instead."""
    of = lambda want: F.get(F.filter(chain, lambda x: F.split(x["step"], r"\.")[0] == want), 0)["path"]
    last = F.element_at(chain, -1)
    start = F.struct(last["path"].alias("path"), last["share"].alias("share"), F.lit(True).alias("on"))

    def climb(acc: Column, x: Column) -> Column:
        up = acc["on"] & (x["share"] > acc["share"] + MORE) & (x["step"] != "html")
        return F.struct(F.when(up, x["path"]).otherwise(acc["path"]).alias("path"), F.when(up, x["share"]).otherwise(acc["share"]).alias("share"), up.alias("on"))

    outwards = F.reverse(F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0))))
    return F.coalesce(of("article"), of("main"), F.aggregate(outwards, start, climb, lambda acc: acc["path"]))


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path) of pages(host, html): the path that most of a host's text stands under. Only paths that hold MOST of the
    text, over all of a host's pages, are compared; these lie within one another, so they are a short chain."""
    cast = pages.select("host", "html").mapInArrow(_vote, "host string, path long, depth int, step string, share long")
    cast = stage(cast.groupBy("host", "path").agg(F.sum("share").alias("share"), F.min("depth").alias("depth"), F.min("step").alias("step")), "html-votes")
    n = pages.groupBy("host").agg(F.count("*").alias("pages"))
    mean = cast.join(n, "host").withColumn("share", F.expr("share div pages")).where(F.col("share") >= MOST)
    return mean.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("depth", "share", "path", "step"))).alias("chain")).select("host", chosen(F.col("chain")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, text, n_chars)."""
    rows = pages.select("page_id", "url", F.coalesce(parts(F.col("url"))[0], F.lit("")).alias("host"), "html")
    paths = stage(consensus(rows), "html-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "", p) for x, p in zip(batch.column("html"), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    got = rows.join(paths, "host", "left").select("page_id", "url", "html", "path")
    return got.mapInArrow(run, rows.select("page_id", "url").schema.simpleString()[7:-1].replace(":", " ") + ", text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    """The contract of op8: one row per page."""
    return main_text(pages)
