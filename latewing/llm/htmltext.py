"""Main text of web pages by wrapper induction over the pages of each host.

A page becomes a tree of its block elements; runs of like siblings (paragraphs, list items) are one node, a slot.  A
host's pages with the same outer structure are a layout, and its most frequent tree is the layout's reference.  Every
other tree of the layout is aligned with it by simple tree matching, so slots of different pages correspond.  A block
(inside ``article`` and ``main`` elements: a whole slot) that stands in the same slot on nearly all pages of a layout is
template; blocks that vary are content.  Copies and near copies of a page count once: pages are told apart by their longest
block first and then, when their common blocks are taken away, by what is left of them, so their article is no template.
What varies but is no article is told by its element or its names: menus, headers, footers, sidebars, notices, adverts,
forms and comments.

A wrapper is one row per layout of a host: reference and template.  Trees are aligned in the tasks that read the pages,
once per distinct tree; blocks are counted by partial sums of hashes, so a host with a third of all pages costs no task
more than another.  Pages are parsed once, and their trees and blocks written; they are moved only where the wrappers are
too many to be sent to all executors.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewing.llm import shared
from latewing.llm.urlrules import url_host

#: Elements that begin a new block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
#: Elements without text of the article, whatever their names.
DROPPED = frozenset(
    "head title style script noscript template svg math iframe object canvas audio video nav footer aside form button"
    " select option textarea datalist dialog menu fieldset".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Parts of class, id and role names that mark what is no article.
MARKS = frozenset(
    "ad ads adbox advert advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist"
    " consent contentinfo complementary cookie cookies copyright dialog discussion disqus footer form gdpr header login masthead"
    " menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended"
    " recommendations related replies reply respond search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe subscription toolbar widget adbanner cookiebar cookiebanner cookienotice footernav navmenu sidenav topbar topnav".split()
)
#: Marks that hold no article wherever they stand in a name.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond related recommended recommendations".split())
#: Last parts of names of what holds the article.
GOOD = frozenset("article post entry story content main body text".split())
#: What a header belongs to if it is the article's.
OWN_HEADER = frozenset("article post entry story content".split())
#: Words before a mark in the name of a layout, not of what the mark names.
LAYOUT = frozenset("has with no without".split())
#: Elements that end an open element of the same group.
_ENDS = {t: frozenset(("p",)) for t in BLOCKS - {"html", "body"}} | {
    "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")),
    "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")),
    "option": frozenset(("option",)),
}
_SCOPE = frozenset("ul ol dl table article section div main body html nav aside form header footer blockquote button".split())
_DEPTH = 120  # deeper elements belong to the slot of their ancestor there

#: Wrappers are sent to all executors up to this size.
WRAPPER_BYTES = 32 << 20
_MAX_OPEN = 512  # elements deeper than that are not opened
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_NAMES = re.compile(r"""(?:\s|^)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])").findall


@dataclass(slots=True)
class Slot:
    label: str
    parent: int
    children: list[int] = field(default_factory=list)


#: Of several articles of a page, those shorter than this share of the longest are teasers.
TEASER = 0.2

#: Elements that may hold the whole article though their kind or name says otherwise.
WRAPPERS = frozenset("form fieldset article main".split())


@dataclass(slots=True)
class Page:
    slots: list[Slot]
    blocks: list[tuple[int, str, bool]]  # slot, text, inside the article

    def skeleton(self) -> str:
        return "|".join(f"{s.parent}:{s.label}" for s in self.slots)

    def layout(self) -> int:
        """A hash of the outer structure: the labels of the page's two upper levels."""
        outer = {i for i, s in enumerate(self.slots) if s.parent <= 0}
        return _hash("|".join(sorted({f"{s.label}" for i, s in enumerate(self.slots) if i in outer or s.parent in outer})))

    def prints(self) -> list[int]:
        """For each block the hash that is compared between pages: of its text or, inside the article, of its whole slot,
        so that a list item or a paragraph that articles share does not make it template."""
        slots: dict[int, list[str]] = {}
        for s, t, _ in self.blocks:
            slots.setdefault(s, []).append(t)
        whole = {s: _hash("\n".join(t)) for s, t in slots.items()}
        return [whole[s] if inside else _hash(t) for s, t, inside in self.blocks]


@dataclass(slots=True)
class _Block:
    slot: int
    text: str
    inside: bool  # an article or main element
    title: bool
    article: int  # the number of the outermost article element, 0 outside
    dropped: int  # the number of the element that drops it, 0 if none does


def _article(blocks: list[_Block], excused: dict[int, bool]) -> list[tuple[int, str, bool]]:
    """The blocks that may be the main text.

    An element that usually holds none but has more text than all that is kept is a wrapper, and its text stays.  If there
    are ``article`` or ``main`` elements, the text is theirs, with a title that stands before them; of several articles
    those much shorter than the longest are teasers.
    """
    sizes: dict[int, int] = {}
    for x in blocks:
        sizes[x.dropped] = sizes.get(x.dropped, 0) + len(x.text)
    wide, total = set(), sizes.get(0, 0)
    for n in sorted((n for n in sizes if n and excused[n]), key=lambda n: -sizes[n]):
        if sizes[n] > total:
            wide.add(n)
            total += sizes[n]
    kept = [x for x in blocks if not x.dropped or x.dropped in wide]
    inside = [x for x in kept if x.inside]
    if not inside:
        return [(x.slot, x.text, False) for x in kept]
    lengths: dict[int, int] = {}
    for x in inside:
        lengths[x.article] = lengths.get(x.article, 0) + len(x.text)
    longest = max((n for a, n in lengths.items() if a), default=0)
    inside = [x for x in inside if not x.article or lengths[x.article] >= TEASER * longest]
    first = next(i for i, x in enumerate(kept) if x is inside[0])
    titles = [x for x in kept[:first] if x.title] if not any(x.title for x in inside) else []
    return [(x.slot, x.text, True) for x in [*titles[-1:], *inside]]


def _mark(name: str) -> int:
    """2 if a class, id or role names what is no article, 1 if it mentions such a thing inside, else 0."""
    parts = [p.lower() for p in _PART(name)]
    marks = [i for i, p in enumerate(parts) if p in MARKS]
    if not marks or not LAYOUT.isdisjoint(parts[: marks[0]]):
        return 0
    if {parts[i] for i in marks} == {"header"} and not OWN_HEADER.isdisjoint(parts):
        return 0
    return 2 if parts[-1] in MARKS or not COMMENTS.isdisjoint(parts) else 1


def _marked(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """1 if the element seems to hold no article, 2 if it certainly holds none (what is hidden, comments), else 0; and its
    name for the tree.

    A name that ends in a mark decides (``main-menu``, ``post-share``); one with a mark further ahead does so unless
    another name of the element says that it holds the article (``content sidebar-right``).
    """
    name, marks, good, others = "", 0, False, False
    if attributes and not attributes.isspace():
        for key, value in _NAMES.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return 2, name
            if key in ("class", "id", "role") and tag not in ("html", "body"):
                words = value.split()
                name = name or (min(words, default="").lower() if key == "class" else "")
                for word in words:
                    mark = _mark(word)
                    marks = max(marks, mark)
                    others = others or (mark > 0 and not COMMENTS.isdisjoint(p.lower() for p in _PART(word)))
                    good = good or (not mark and _PART(word)[-1:] != [] and _PART(word)[-1].lower() in GOOD)
    if marks == 2 or (marks == 1 and not good):
        return 1 + others, name
    if tag == "header":
        return int(not in_article), name
    return int(tag in DROPPED), name


class _Tags:
    """The tags of a page in order, in time linear in its length whatever the markup.

    A tag ends at the first ``>`` outside quotes.  If one never would, quotes mean nothing from there on.
    """

    def __init__(self, source: str):
        self.source, self.quotes = source, True
        self.last = {mark: source.rfind(mark) for mark in (">", "-->", "]]>")}

    def _close(self, at: int) -> int:
        """Where the tag that goes on at ``at`` ends, the end of the page if it does not."""
        begin = at
        while self.quotes:
            at = _PLAIN.match(self.source, at).end()
            if at >= len(self.source):
                self.quotes = False
                break
            if self.source[at] == ">":
                return at
            after = self.source.find(self.source[at], at + 1)
            if after < 0:
                self.quotes = False
            at = after + 1
        end = self.source.find(">", begin) if begin <= self.last[">"] else -1
        return end if end >= 0 else len(self.source)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the next tag or comment; comments have no name."""
        source = self.source
        while True:
            at = source.find("<", at)
            if at < 0:
                return None
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if source.startswith(opening, at) and (closing == "-->" or at < self.last[closing]):
                    end = source.find(closing, at + len(opening)) if at < self.last[closing] else -1
                    return at, end + len(closing) if end >= 0 else len(source), False, "", ""
            closes = source.startswith("/", at + 1)
            name = _TAG_NAME.match(source, at + 1 + closes)
            if name:
                end = self._close(name.end())
                return at, end + 1, closes, name[0].lower(), source[name.end() : end]
            if closes or source[at + 1 : at + 2] in ("!", "?"):
                end = source.find(">", at) if at < self.last[">"] else -1
                return at, end + 1 if end >= 0 else len(source), False, "", ""
            at += 1


def parse(source: str) -> Page:
    """The slots and blocks of a page; never fails, whatever the markup."""
    slots = [Slot("html", -1)]
    blocks: list[_Block] = []
    # open elements: tag, slot, number of the element that drops its text, whether it is inside the article, number of that
    stack: list[tuple[str, int, int, bool, int]] = [("html", 0, 0, False, 0)]
    excused: dict[int, bool] = {}
    articles = 0
    buffer: list[str] = []
    open_tags: Counter[str] = Counter()
    unopened: Counter[str] = Counter()
    tags, at, end = _Tags(source), 0, len(source)

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                _, slot, dropped, inside, article = stack[-1]
                blocks.append(_Block(slot, text, inside, any(t == "h1" for t, *_ in stack[-3:]), article, dropped))

    def close(depth: int) -> None:
        for tag, *_ in stack[depth:]:
            open_tags[tag] -= 1
        del stack[depth:]

    while at < end:
        found = tags.next(at)
        stop = found[0] if found else end
        if stop > at and (not stack[-1][2] or excused[stack[-1][2]]):
            buffer.append(source[at:stop])
        if not found:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue
        if closing:
            if unopened[tag]:
                unopened[tag] -= 1
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0) if open_tags[tag] else 0
            if not depth or (tag not in BLOCKS and any(t in _SCOPE for t, *_ in stack[depth + 1 :])):
                continue
            if any(t in BLOCKS for t, *_ in stack[depth:]):
                flush()
            close(depth)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr") and (not stack[-1][2] or excused[stack[-1][2]]):
                buffer.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            ending = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = ending.end() if ending else end
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if tag in ("html", "body") and len(stack) == 1:
            continue
        if closes := _ENDS.get(tag):
            i = len(stack) - 1
            while i > 0 and stack[i][0] not in _SCOPE:
                if stack[i][0] in closes:
                    close(i)
                    i = len(stack)
                i -= 1
        _, slot, dropped, inside, article = stack[-1]
        marked, name = _marked(tag, attributes, inside)
        if block:
            if len(stack) < _DEPTH:
                label = f"{tag}.{name}" if name else tag
                label = label.replace("|", "")
                last = slots[slot].children[-1] if slots[slot].children else -1
                if last >= 0 and slots[last].label == label:
                    slot = last
                else:
                    slots.append(Slot(label, slot))
                    slots[slot].children.append(len(slots) - 1)
                    slot = len(slots) - 1
            inside = inside or tag in ("article", "main")
            if tag == "article" and not article:
                articles += 1
                article = articles
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        if len(stack) >= _MAX_OPEN:
            unopened[tag] += 1
            continue
        open_tags[tag] += 1
        if marked and (not dropped or excused[dropped]):
            dropped = len(excused) + 1
            excused[dropped] = marked == 1 and tag in WRAPPERS
        stack.append((tag, slot, dropped, inside, article))
    flush()
    return Page(slots, _article(blocks, excused))


def simple_tree_matching(a: list[Slot], b: list[Slot]) -> dict[int, int]:
    """Slots of a and the slots of b that they correspond to, in a greatest matching that keeps parents and order."""
    sizes: dict[tuple[int, int], int] = {}

    def table(i: int, j: int) -> list[list[int]]:
        xs, ys = a[i].children, b[j].children
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for p, x in enumerate(xs, 1):
            for q, y in enumerate(ys, 1):
                m[p][q] = max(m[p - 1][q], m[p][q - 1], m[p - 1][q - 1] + sizes.get((x, y), 0))
        return m

    # children have larger numbers than parents, so going down in number meets children first
    by_label: dict[tuple[str, int], list[int]] = {}
    depth_b = _depths(b)
    for j, slot in enumerate(b):
        by_label.setdefault((slot.label, depth_b[j]), []).append(j)
    depth_a = _depths(a)
    for i in range(len(a) - 1, -1, -1):
        for j in by_label.get((a[i].label, depth_a[i]), ()):
            sizes[i, j] = table(i, j)[-1][-1] + 1
    pairs: dict[int, int] = {}
    todo = [(0, 0)] if (0, 0) in sizes else []
    while todo:
        i, j = todo.pop()
        pairs[i] = j
        m, p, q = table(i, j), len(a[i].children), len(b[j].children)
        while p and q:
            x, y = a[i].children[p - 1], b[j].children[q - 1]
            if (x, y) in sizes and m[p][q] == m[p - 1][q - 1] + sizes[x, y]:
                todo.append((x, y))
                p, q = p - 1, q - 1
            elif m[p][q] == m[p - 1][q]:
                p -= 1
            else:
                q -= 1
    return pairs


def _depths(slots: list[Slot]) -> list[int]:
    depths = [0] * len(slots)
    for i, slot in enumerate(slots):
        depths[i] = depths[slot.parent] + 1 if slot.parent >= 0 else 0
    return depths


def _tree(skeleton: str) -> list[Slot]:
    slots: list[Slot] = []
    for part in skeleton.split("|"):
        parent, label = part.split(":", 1)
        slots.append(Slot(label, int(parent)))
        if slots[-1].parent >= 0:
            slots[slots[-1].parent].children.append(len(slots) - 1)
    return slots


def _hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _alignment(skeleton: str, reference: str, known: dict) -> list[int]:
    """For each slot of a tree the slot of the reference, -1 if none; remembered for the last trees."""
    found = known.get((skeleton, reference))
    if found is None:
        if len(known) >= 2_000:
            known.clear()
        pairs = simple_tree_matching(_tree(skeleton), _tree(reference))
        found = known[skeleton, reference] = [pairs.get(i, -1) for i in range(skeleton.count("|") + 1)]
    return found


_PARSED = "layout bigint, skeleton string, slots array<int>, texts array<string>, inside array<boolean>, prints array<bigint>"


def parsed(pages: DataFrame, folder: str) -> DataFrame:
    """(row, host) of (row, host, html) with the pages' trees and blocks, each page parsed once and written."""

    @F.arrow_udf(f"struct<{', '.join(f'{n}: {k}' for n, k in (x.split(' ') for x in _PARSED.split(', ')))}>")
    def parse_all(sources: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in shared.lean(sources):
            made = [parse(source.as_py() or "") for source in batch]
            columns = [
                pa.array([p.layout() for p in made], pa.int64()), pa.array([p.skeleton() for p in made], pa.string()),
                pa.array([[b[0] for b in p.blocks] for p in made], pa.list_(pa.int32())), pa.array([[b[1] for b in p.blocks] for p in made], pa.list_(pa.string())),
                pa.array([[b[2] for b in p.blocks] for p in made], pa.list_(pa.bool_())), pa.array([p.prints() for p in made], pa.list_(pa.int64())),
            ]
            yield pa.StructArray.from_arrays(columns, names=[x.split(" ")[0] for x in _PARSED.split(", ")])

    made = pages.withColumn("page", parse_all("html")).select(*[c for c in pages.columns if c != "html"], "page.*")
    return shared.stored(made, folder, "parsed")


def _longest(texts: list[str]) -> int:
    """A hash of the longest block: pages that share it are copies or near copies of each other."""
    return _hash(max(texts, key=lambda t: (len(t), t), default=""))


#: Least hashes that a page's varying text is told by.
_SKETCH = 9


def _sketch(texts: list[str]) -> list[int]:
    """For each of some hash functions the least hash of the text's runs of three words."""
    words = " ".join(texts).split()
    runs = np.array([_hash(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.int64).view(np.uint64)
    return [int(shared.mix64(runs ^ salt).min() >> np.uint64(1)) for salt in shared.spread(_SKETCH, 41)]


def learn_wrappers(
    pages: DataFrame, folder: str, min_pages: int = 2, min_articles: int = 10, share: float = 0.95, most: float = 0.5
) -> DataFrame:
    """``parsed`` pages -> (host, layout, reference, template): for every layout of a host that has any, the (slot of the
    reference, hash of a block's text) that are template.

    A block may be template if at least ``share`` of the layout's different pages hold it in this slot and these pages
    are at least ``min_pages``; inside ``article`` and ``main`` elements at least ``min_articles``.  Then the rest of the pages
    has the last word: near copies of a page also share most of their blocks, but what differs between them is alike.
    Pages are counted again by the text that is left (the median, over some hash functions, of the number of different
    least hashes of its word triples: versions of a text share most of them, different texts none).  A layout that has much
    fewer by that count has no template, and where fewer than ``min_articles`` are left, blocks that hold more
    than the share ``most`` of the pages' text stay.
    """
    seen = pages.groupBy("host", "layout", "skeleton").agg(F.count("*").alias("n"))
    kinds = seen.groupBy("host", "layout").agg(F.sum("n").alias("n"), F.max_by("skeleton", F.struct("n", "skeleton")).alias("reference")).where("n > 1")
    kinds = shared.stored(kinds.drop("n"), folder, "references")
    inputs = ["host", "layout", "skeleton", "slots", "texts", "inside", "prints", "reference"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in shared.lean(batches):
            rows = []
            for r in (r for at in range(0, len(batch), 200) for r in batch.slice(at, 200).to_pylist()):
                slots = _alignment(r["skeleton"], r["reference"], known)
                identity = _longest(r["texts"])
                made = {(slots[s], h, i) for s, h, i in zip(r["slots"], r["prints"], r["inside"], strict=True) if slots[s] >= 0}
                rows += [(r["host"], r["layout"], identity, *m) for m in [*made, (-1, 0, False)]]  # the last counts the page
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=["host", "layout", "identity", "slot", "hash", "inside"])

    placed = _with_wrappers(pages, kinds, "inner").select(*inputs)
    each = placed.mapInArrow(blocks, "host string, layout bigint, identity bigint, slot int, hash bigint, inside boolean").distinct()
    counts = shared.stored(each.groupBy("host", "layout", "slot", "hash", "inside").agg(F.count("*").alias("n")), folder, "counts")
    total = counts.where("slot = -1").select("host", "layout", F.col("n").alias("n_pages"))
    least = F.when(F.col("inside"), min_articles).otherwise(min_pages)
    fixed = counts.where((F.col("slot") >= 0) & (F.col("n") >= least)).join(total, ["host", "layout"]).where(F.col("n") >= share * F.col("n_pages"))
    fixed = fixed.groupBy("host", "layout").agg(F.collect_set(F.struct("slot", "hash", "inside")).alias("template"))  # at most 1 / share times a page's blocks
    wrappers = shared.stored(kinds.join(fixed, ["host", "layout"]), folder, "candidates")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in shared.lean(batches):
            rows = []
            for r in (r for at in range(0, len(batch), 200) for r in batch.slice(at, 200).to_pylist()):
                slots = _alignment(r["skeleton"], r["reference"], known)
                dropped = {(f["slot"], f["hash"]) for f in r["template"]}
                left = [t for t, s, h in zip(r["texts"], r["slots"], r["prints"], strict=True) if (slots[s], h) not in dropped]
                size = sum(map(len, r["texts"]))
                gone = 1 - sum(map(len, left)) / size if size else 0.0
                rows += [(r["host"], r["layout"], k, h, gone) for k, h in enumerate(_sketch(left))]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=["host", "layout", "k", "least", "gone"])

    left = _with_wrappers(pages, wrappers, "inner").select(*inputs, "template").mapInArrow(rest, "host string, layout bigint, k int, least bigint, gone double")
    one = left.groupBy("host", "layout", "k", "least").agg(F.sum("gone").alias("gone"), F.count("*").alias("n"))
    each = one.groupBy("host", "layout", "k").agg(F.count("*").alias("different"), (F.sum("gone") / F.sum("n")).alias("gone"))
    said = each.groupBy("host", "layout").agg(F.median("different").alias("different"), F.max("gone").alias("gone"))
    enough = (F.col("different") >= min_pages) & (F.col("different") >= 0.6 * F.col("n_pages"))
    good = said.join(total, ["host", "layout"]).where(enough & ((F.col("different") >= min_articles) | (F.col("gone") <= most)))
    inner = F.filter("template", lambda f: ~f["inside"] | (F.col("different") >= min_articles))
    chosen = wrappers.join(good, ["host", "layout"]).select("host", "layout", "reference", F.transform(inner, lambda f: F.struct(f["slot"].alias("slot"), f["hash"].alias("hash"))).alias("template"))
    return shared.stored(chosen, folder, "wrappers")


def _with_wrappers(pages: DataFrame, wrappers: DataFrame, how: str) -> DataFrame:
    """``pages`` joined with rows of (host, layout): sent to all executors if their measured size allows it."""
    size = wrappers.agg(F.sum(F.length("reference") + (F.lit(16) * F.size("template") if "template" in wrappers.columns else F.lit(0)) + 64)).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= WRAPPER_BYTES else wrappers, ["host", "layout"], how)


@F.arrow_udf(T.StringType())
def _extracted(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    known: dict = {}
    for skeletons, slots, texts, prints, references, templates in columns:
        out = []
        for skeleton, own, parts, hashes, reference, template in zip(skeletons, slots, texts, prints, references, templates, strict=True):
            parts = parts.as_py()
            if reference.is_valid:
                at = _alignment(skeleton.as_py(), reference.as_py(), known)
                fixed = {(f["slot"], f["hash"]) for f in template.as_py()}
                parts = [t for t, s, h in zip(parts, own.as_py(), hashes.as_py(), strict=True) if (at[s], h) not in fixed] or parts
            out.append("\n".join(parts))
        yield pa.array(out, pa.string())


def main_text(
    pages: DataFrame, folder: str, url: str = "url", source: str = "html", into: str = "text", min_pages: int = 2, min_articles: int = 10, share: float = 0.95
) -> DataFrame:
    """``pages`` without ``source``, with a column ``into``: the page's main text, blocks joined by line feeds.

    If a page has ``article`` or ``main`` elements, the text is theirs and a title's before them; else the body's.  A page
    whose every block is template (a host of copies) keeps them all.  Null and empty pages have an empty text; null URLs
    and those without a host share the wrappers of the empty host; layouts with fewer than ``min_pages`` different pages
    have none.  Repeated rows are extracted alike; an empty table gives an empty table.  Other columns pass through,
    whatever their names; a column of the name ``into``, in any case, is replaced.
    """
    taken = ["host", "layout", "html", "skeleton", "slots", "texts", "inside", "prints", "reference", "template"]
    (row,) = shared.free_names(taken, "row")
    keep = [c for c in pages.columns if c != source and c.lower() != into.lower()]
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    rows = parsed(pages.select(whole.alias(row), url_host(F.col(f"`{url}`")).alias("host"), F.col(f"`{source}`").alias("html")), folder)
    wrappers = learn_wrappers(rows, folder, min_pages, min_articles, share)
    both = _with_wrappers(rows, wrappers, "left")
    text = _extracted("skeleton", "slots", "texts", "prints", "reference", "template")
    return both.select(*[F.col(f"{row}.`{c}`").alias(c) for c in keep], text.alias(into))


def op3(spark, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, shared.shared_folder(spark)).withColumn("n_chars", F.char_length("text").cast("long"))
