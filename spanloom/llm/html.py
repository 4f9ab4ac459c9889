"""HTML main-text extraction by nearest-URL page differencing.

Pages of one host share their frame. Each page is paired with its nearest neighbour by URL path within the host that
isn't a copy of it, the two are aligned by the longest common subsequence of their text lines, and what they share is
taken for frame and deleted. Marks are the other evidence:

* Elements that name themselves as frame (menus, footers, adverts, forms, comments, ...) go in any case. A name or a form
  is no frame where it wraps the page: where it holds the only marked part, or most of the text of a page that marks none
  elsewhere. A name counts if its words are all of frame or of layout, so ``search-engine-history`` names nothing.
* Where a page marks its article, the marked lines stay, and so do those around it in a marked main part (a headline, an
  introduction) unless the alignment shares them. A line in the marked part goes only if the alignment shares it and all of ``EVIDENCE``
  near pages or more, no two of them copies of one another, hold it too. What lies outside stays where neither the near
  pages nor a frame hold it and it is longer than the marked text: then the mark is a teaser's.
* A pair that shares ``COPY`` of its lines is a pair of copies; lines in the named frame, and those of a third page, don't
  count for that.

Pages are dealt out by ranges of (host, path), so a host with a third of all pages is many tasks; the number of ranges
follows the bytes of the table. The ``NEAR`` pages of a host on either side of a range's edge are sent to both ranges, so that the
neighbours are the same however the ranges fall. Only the keys of those pages reach the driver.

Defined results: null html is empty and gives the empty text; a page without host and path (null or odd URL) stands in
the host of the empty name; a page alone in its host, or among copies alone, has no neighbour and loses no lines by alignment.
Repeated rows are each other's neighbours, copies in effect. Text isn't cut. Ids may be of any type. Extra columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import json
import re
from collections import Counter, deque
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import in_arrow, table

#: Share of lines in common from which two pages are copies of each other.
COPY = 0.8
#: Pages before and after a page that may tell about it.
NEAR = 4
#: Near pages of different text from which a line that all of them hold is frame inside an article too.
EVIDENCE = 4
#: Rows a batch of the pairing step sends back at once, and bytes of html to a range.
SENT, RANGE_BYTES = 256, 32 << 20

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>?""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?<![-a-zA-Z0-9_:.])([a-zA-Z_:][-a-zA-Z0-9_:.]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_WORD = re.compile(r"[a-z]+")
#: Elements whose content is not text of the page.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noframes", "noembed"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_FRAME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "math", "object", "canvas", "audio", "video", "map", "head", "fieldset", "search"}
_FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar", "note"}
#: Words of a class or id that name a part of the frame.
_FRAME_WORDS = {"nav", "navbar", "navigation", "menu", "sidebar", "footer", "ad", "ads", "advert", "adverts", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "newsletter", "subscribe", "subscription", "signup", "social", "share", "sharing", "related", "recommended", "breadcrumb", "breadcrumbs", "comment", "comments", "disqus", "respond", "popup", "modal", "overlay", "widget", "pagination", "pager", "masthead", "toolbar", "skip", "login", "search"}
#: Beginnings of such words, as in names that run words together.
_FRAME_STARTS = ("advert", "adsby", "breadcrumb", "comment", "cookie", "footer", "navbar", "newsletter", "promo", "sidebar", "sponsor")
#: Such words count outside an article only.
_OUTER_WORDS = {"header", "head", "top", "bottom"}
#: Words of layout that may stand in a name beside those of frame.
_LAYOUT_WORDS = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "center", "col", "column", "container", "content", "default", "element", "fixed", "form", "group", "head", "header", "holder", "icons", "inner", "item", "items", "label", "large", "left", "link", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "primary", "right", "row", "secondary", "section", "site", "slot", "small", "spot", "sticky", "title", "top", "unit", "wrap", "wrapper"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = {"ul", "ol", "dl", "table", "select", "tbody", "thead"}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text and "=" in text else {}


#: Frame by the tag alone that may yet wrap a whole page, as names may.
_WRAPPERS = {"form", "fieldset", "header"}
SURE, NAMED = 2, 1


def _is_frame(tag: str, attributes: dict[str, str], bare: str, in_article: bool) -> int:
    """SURE, NAMED (if it wraps nothing but a part), or 0."""
    if _is_sure(tag, attributes, bare):
        return SURE
    return NAMED * (tag in _WRAPPERS and (tag != "header" or not in_article) or bool(attributes) and _is_named(tag, attributes, in_article))


def _is_sure(tag: str, attributes: dict[str, str], bare: str) -> bool:
    if tag in _FRAME and tag not in _WRAPPERS:
        return True
    if "hidden" in bare.lower().split():
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in _FRAME_ROLES or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if "style" in attributes and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"], re.IGNORECASE):
        return True
    return False


def _is_named(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(_WORD.findall(name))
        if tag == "article":
            framed = {w for w in words if w in ("ad", "ads", "related") or w.startswith(("advert", "comment", "sponsor"))}
        else:
            framed = {w for w in words if w in _FRAME_WORDS or w.startswith(_FRAME_STARTS) or not in_article and w in _OUTER_WORDS}
        if framed and all(w in framed or w in _LAYOUT_WORDS or len(w) < 3 for w in words):
            return True
    return False


class _Open:
    """The elements open at a place of a page: tag, the innermost frame element around, and kind of part."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, frame: int, part: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in _INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, frame, part))

    def cut(self, depth: int) -> None:
        """Closes the element at that depth with all within; each element is closed once, so this is linear in all."""
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag not in _INLINE:
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def state(self, depth: int) -> tuple[int, int]:
        return self.stack[depth - 1][1:] if depth else (0, 1)

    def ended_by(self, tag: str) -> int:
        """Depth of what a new block ends: an open paragraph, or the list item before; -1: nothing."""
        if tag not in _CLOSED_BY:
            top = self.blocks[-1] if self.blocks else -1
            return top if top >= 0 and self.stack[top][0] == "p" else -1
        found = self.last(("p", *_CLOSED_BY[tag]))
        return found if found > self.last(_LISTS - _CLOSED_BY[tag]) else -1


#: The innermost frame element of a line that is surely frame.
_SURELY = -1


def lines_of(html: str) -> list[tuple[str, int]]:
    """The text lines of a page in order, one a block: (text, kind).

    Kinds: 3 in a marked article, 2 in the marked main part alone, 1 in neither, 0 in the frame.
    """
    found: list[tuple[str, int, int]] = []  # text, the innermost named element it lies in, kind
    parts: list[str] = []
    open_ = _Open()
    around = [0]  # by number of a named element, the one that it lies in; none is 0
    frame, part = 0, 1

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append((text, frame, part))
        parts.clear()

    at, size = 0, len(html)
    while at < size:
        low = html.find("<", at)
        if low < 0:
            parts.append(html[at:])
            break
        if low > at:
            parts.append(html[at:low])
        m = _TAG.match(html, low)
        if not m:  # a bare less-than sign
            parts.append("<")
            at = low + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, rest = m[1] or m[4], m[3] or m[6] or ""
        inline = tag in _INLINE
        if tag == "br":
            parts.append(" ")
        if closing:
            depth = open_.last((tag,))
            if depth >= 0:
                if not inline or open_.stack[depth][1] != open_.state(depth)[0]:
                    flush()
                open_.cut(depth)
                frame, part = open_.state(depth)
            elif not inline:
                flush()
            continue
        if tag in _RAW and not rest.endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else size
            continue
        attributes = _attributes(rest)
        if not inline:
            flush()
            depth = open_.ended_by(tag)
            if depth >= 0:
                open_.cut(depth)
                frame, part = open_.state(depth)
        if tag in _VOID or rest.endswith("/"):
            continue
        own = 0 if frame == _SURELY else _is_frame(tag, attributes, _ATTRIBUTE.sub("", rest), part > 1)
        if own and inline:
            flush()
        if own == SURE:
            frame = _SURELY
        elif own:
            around.append(frame)
            frame = len(around) - 1
        else:
            role = attributes.get("role", "").lower()
            part = max(part, 3 if "article" in (tag, role) else 2 if "main" in (tag, role) else 1)
        open_.push(tag, frame, part)
    flush()
    wraps = _wrapping(found, around)
    return [(text, part if frame >= 0 and wraps[frame] else 0) for text, frame, part in found]


def _wrapping(found: list[tuple[str, int, int]], around: list[int]) -> list[bool]:
    """Whether each named element, and all that it lies in, wrap the page.

    One that wraps holds more than half of what is marked, or of the text where nothing is marked in any element of the page.
    """
    if any(part > 1 and not frame for _, frame, part in found):
        return [True] + [False] * (len(around) - 1)
    marked, sizes = [0] * len(around), [0] * len(around)
    for text, frame, part in found:
        if frame >= 0:
            sizes[frame] += len(text)
            marked[frame] += len(text) * (part > 1)
    for i in range(len(around) - 1, 0, -1):  # an element's number is above that of the one around
        sizes[around[i]] += sizes[i]
        marked[around[i]] += marked[i]
    own, whole = (marked, marked[0]) if marked[0] else (sizes, sizes[0])
    wraps = [True]
    for i in range(1, len(around)):
        wraps.append(wraps[around[i]] and 2 * own[i] > whole)
    return wraps


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Places in ``own`` of a longest common subsequence.

    The lists are halved again and again at the place where the best runs of both halves meet; the lengths of all runs of a half
    are the bits of one number, so memory is linear in the lines, however often they repeat.
    """
    both = set(own) & set(other)
    a, b = [i for i, x in enumerate(own) if x in both], [x for x in other if x in both]
    found: set[int] = set()
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        low, high, first, last = waiting.pop()
        while low < high and first < last and own[a[low]] == b[first]:
            found.add(a[low])
            low, first = low + 1, first + 1
        while low < high and first < last and own[a[high - 1]] == b[last - 1]:
            high, last = high - 1, last - 1
            found.add(a[high])
        if low >= high or first >= last:
            continue
        if high - low == 1:
            if own[a[low]] in b[first:last]:
                found.add(a[low])
            continue
        middle = (low + high) // 2
        right = b[first:last]
        ahead = _runs([own[i] for i in a[low:middle]], right)
        behind = _runs([own[i] for i in reversed(a[middle:high])], right[::-1])
        cut = first + int(np.argmax(ahead + behind[::-1]))
        waiting += [(low, middle, first, cut), (middle, high, cut, last)]
    return found


def _runs(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``, the empty one first."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | (1 << j)
    whole = (1 << len(b)) - 1
    row = whole  # a zero where one more line of b makes the run longer
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & whole
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def nearer(path: str, before: str | None, after: str | None) -> int:
    """-1 if the neighbour before has as many leading parts of the path in common as the one after, or more; else 1; 0: none."""
    if before is None or after is None:
        return -1 if before is not None else 1 if after is not None else 0

    def common(other: str) -> int:
        n = 0
        for a, b in zip(path.split("/"), other.split("/"), strict=False):
            if a != b:
                break
            n += 1
        return n

    return -1 if common(before) >= common(after) else 1


def is_copy(own: list[int], other: list[int], third: set[int]) -> bool:
    """Whether two pages share most of their lines, apart from those of a third page; of all of them if that leaves none."""
    for skipped in (third, set()):
        a, b = ([x for x in page if x not in skipped] if skipped else page for page in (own, other))
        if a or b:
            most = max(len(a), len(b))
            return min(len(a), len(b)) >= COPY * most and (Counter(a) & Counter(b)).total() >= COPY * most
    return True


def main_text(lines: list[tuple[str, int]], *near: list[tuple[int, int]] | None) -> str:
    """The text of a page by the pages near it, the nearest first: hashed lines with their kinds."""
    own, others = hashed(lines), [x for x in near if x]
    wanted = max((kind for _, kind in lines), default=0)
    if wanted < 2:
        shared = _aligned(own, others) if wanted else set()
        return "\n\n".join(t for i, (t, kind) in enumerate(lines) if kind and i not in shared)
    shared = _aligned(own, others) if wanted == 3 and any(kind == 2 for _, kind in lines) else set()
    known, common = _evidence(own, wanted, others)
    kept = [i for i, (_, kind) in enumerate(lines) if kind == wanted and i not in common or kind == 2 < wanted and i not in shared]
    if known is not None:
        outside = [i for i, (h, kind) in enumerate(own) if kind == 1 and h not in known]
        if sum(len(lines[i][0]) for i in outside) > sum(len(lines[i][0]) for i in kept):
            kept = sorted(kept + outside)
    return "\n\n".join(lines[i][0] for i in kept)


def _aligned(own: list[tuple[int, int]], others: list[list[tuple[int, int]]]) -> set[int]:
    """Places that the page shares with the nearest other that isn't its copy."""
    plain = _plain(own)
    for k, other in enumerate(others):
        third = others[1 if k == 0 else 0] if len(others) > 1 else []
        if not is_copy(plain, _plain(other), {h for h, _ in third}):
            return shared_lines([h for h, _ in own], [h for h, _ in other])
    return set()


def _plain(page: list[tuple[int, int]]) -> list[int]:
    return [h for h, kind in page if kind]


def _part(page: list[tuple[int, int]]) -> list[int]:
    """The marked part of a page, or all outside its frame."""
    wanted = max((kind for _, kind in page), default=0)
    return [h for h, kind in page if kind and kind == wanted]


def _evidence(own: list[tuple[int, int]], wanted: int, others: list[list[tuple[int, int]]]) -> tuple[set[int] | None, set[int]]:
    """Lines that any near page of different text holds, and the places in the marked part that alignment and all such pages share.

    None and no places where there are too few such pages, or nothing to decide by them.
    """
    held = [{h for h, _ in page} for page in others]
    marked = {h for h, kind in own if kind == wanted}
    often = Counter(h for page in held for h in page & marked)
    if len(others) < EVIDENCE or (max(often.values(), default=0) < EVIDENCE and not any(kind == 1 for _, kind in own)):
        return None, set()
    parts, apart = [_part(own)], []
    for k, page in enumerate(others):
        part = _part(page)
        if not any(is_copy(part, p, set()) for p in parts):
            parts.append(part)
            apart.append(k)
    if len(apart) < EVIDENCE:
        return None, set()
    every = set.intersection(*(held[k] for k in apart))
    common: set[int] = set()
    if any(kind == wanted and h in every for h, kind in own):
        shared = shared_lines([h for h, _ in own], [h for h, _ in others[apart[0]]])
        common = {i for i in shared if own[i][1] == wanted and own[i][0] in every}
    return set.union(*(held[k] for k in apart)), common


def hashed(lines: list[tuple[str, int]]) -> list[tuple[int, int]]:
    return [(hash_line(t), kind) for t, kind in lines]


def hash_line(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _placed(pages: DataFrame) -> DataFrame:
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/]*)", 1)), r"^.*@|:\d*$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(/.*)$", 1), r"/$", "")
    return pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), F.xxhash64("page_id", "url").alias("tie"))


def _range_of(highs: list[tuple], key: Column) -> Column:
    """The first range whose last key isn't below ``key``, or the last range: a binary search among the ranges' last keys."""
    listed = F.from_json(F.lit(json.dumps([dict(zip(KEY, h, strict=True)) for h in highs])), "array<struct<host:string,path:string,tie:long>>")

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.element_at(listed, middle + 1) < key
        return F.when(s["low"] >= s["high"], s).when(below, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(highs) - 1).alias("high"))
    return F.aggregate(F.array_repeat(F.lit(0), len(highs).bit_length()), start, halve, lambda s: s["low"])


#: What pages are ordered by: the id and the whole URL break ties.
KEY = ("host", "path", "tie")


def _guests(edges: list[tuple[list, list]]) -> dict[tuple, set[int]]:
    """The ranges beside its own that a page is sent to, by the first and the last keys of all ranges."""
    guests: dict[tuple, set[int]] = {}
    for p, (lows, highs) in enumerate(edges):
        # A range of fewer pages than NEAR lists them all, so the next ones are found beyond it.
        for own, others, side in ((highs[-1], range(p + 1, len(edges)), 0), (lows[0], range(p - 1, -1, -1), 1)):
            near: list[tuple] = []
            for q in others:
                near += edges[q][side][:: 1 - 2 * side]
                if len(near) >= NEAR or near[-1][0] != own[0]:
                    break
            for key in near[:NEAR]:
                if key[0] == own[0]:
                    guests.setdefault(key, set()).add(p)
    return guests


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    placed = _placed(pages)
    if ranges is None:
        size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # The edges of the ranges: a few keys a range reach the driver.
    dealt = placed.select(*KEY).repartitionByRange(ranges, *KEY).sortWithinPartitions(*KEY).withColumn("part", F.spark_partition_id())
    sides: dict[int, tuple[list, list]] = {}
    for e in sorted(in_arrow(dealt, _edges, "part int, low boolean, place int, host string, path string, tie long").collect(), key=lambda e: (e["part"], e["place"])):
        sides.setdefault(e["part"], ([], []))[0 if e["low"] else 1].append(tuple(e[k] for k in KEY))
    edges = [sides[p] for p in sorted(sides)]
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"
    if not edges:
        return pages.limit(0).select("page_id", F.col("url").cast("string"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    sent = spark.createDataFrame([(*key, sorted(own)) for key, own in _guests(edges).items()], "host string, path string, tie long, also array<int>")
    part = _range_of([highs[-1] for _, highs in edges], F.struct(*KEY))
    # The guests are no more than 2 * NEAR keys a range.
    shared = placed.withColumn("own", part).join(F.broadcast(sent), list(KEY), "left")
    split = shared.select("page_id", "url", "html", *KEY, "own", F.explode(F.concat(F.array("own"), F.coalesce("also", F.array().cast("array<int>")))).alias("part"))
    sorted_ = split.repartitionById(len(edges), "part").sortWithinPartitions("part", *KEY, F.xxhash64("html"))

    def pair(batches):
        id_type = None

        def rows():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("page_id").type
                for r in zip(*(batch.column(c).to_pylist() for c in ("part", "own", "host", "path", "page_id", "url")), batch.column("html"), strict=True):
                    lines = lines_of(r[6].as_py() or "")
                    yield (r[0], r[2]), r[3], r[0] != r[1], r[4], r[5], lines, hashed(lines)

        out: list[tuple] = []
        for _, own in groupby(rows(), key=lambda r: r[0]):
            for before, now, after in _windows(own):
                if not now[2]:
                    side = nearer(now[1], before[-1][1] if before else None, after[0][1] if after else None)
                    # From near to far on the nearer side, then on the other.
                    near, far = (before[::-1], after) if side < 0 else (after, before[::-1])
                    text = main_text(now[5], *(r[6] for r in near[:1] + far + near[1:]))
                    out.append((now[3], now[4], text, len(text)))
                    if len(out) >= SENT:
                        yield _sent(out, id_type)
                        out = []
        if out:
            yield _sent(out, id_type)

    return in_arrow(sorted_, pair, schema)


def _sent(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    ids, urls, texts, sizes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _windows(rows):
    """Each row with up to NEAR rows before and after it."""
    held, at = [], 0  # the rows at hand, the place of the next one to be given out
    for row in rows:
        held.append(row)
        if len(held) > at + NEAR:
            yield held[:at], held[at], held[at + 1 :]
            at += 1
            if at > NEAR:
                del held[0]
                at -= 1
    for at in range(at, len(held)):
        yield held[max(0, at - NEAR) : at], held[at], held[at + 1 : at + 1 + NEAR]


def _edges(batches):
    """The first and last NEAR rows of a sorted range."""
    lows, highs = [], deque(maxlen=NEAR)
    for batch in batches:
        for key in zip(*(batch.column(c).to_pylist() for c in ("part", *KEY)), strict=True):
            if len(lows) < NEAR:
                lows.append(key)
            highs.append(key)
    rows = [(k[0], low, i, *k[1:]) for low, keys in ((True, lows), (False, highs)) for i, k in enumerate(keys)]
    if rows:
        kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "low", "place", "host", "path", "tie"])


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
