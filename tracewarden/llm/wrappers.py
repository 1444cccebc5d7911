"""Main text of web pages by wrapper induction.

The pages of a host are aligned, as trees of elements, by simple tree matching. A place of the
aligned tree whose text is constant over the pages is template, one whose text varies is a slot
for content. The content region of a host is the innermost container of its wrapper that holds
nearly all varying text; what lies outside is frame.

Tags that HTML sets aside for other things (nav, footer, form, script) hold no content. What else
an element says of itself, by its tag or by names of its author's choice, weighs in where the
region is chosen, and settles what lies inside of it.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import lean, stored

# ---- fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag on the left ends open elements on the right, up to the nearest one beyond them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that open paragraphs do not survive.
ENDS_P = BLOCKS - {"html", "head", "body", "option", "optgroup", "legend", "summary", "caption", "title"}
FRAME_TAGS = frozenset(
    "nav footer aside form button select option input textarea script style noscript template iframe svg math "
    "head title dialog menu label".split()
)
FRAME_WORDS = re.compile(
    r"(?:^|[^a-z])(?<!\bno[-_])(?<!\bhas[-_])(?<!\bwith[-_])(?<!\bhide[-_])(?<!\bwithout[-_])"
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|newsletter|"
    r"subscri\w+|sidebar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|disqus|"
    r"repl(?:y|ies)|related|share|sharing|social|popup|modal|overlay|login|signup|search|pagination|pager|toolbar|"
    r"skip|copyright|complementary|contentinfo)(?![a-z])"
)
MAIN_TAGS = frozenset({"article", "main"})
MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|articlebody|main|post-?(?:body|content)|entry-?content)(?![a-z])")
#: Elements that may be a content region as a whole.
CONTAINERS = frozenset("html body article main section div td table tbody tr center blockquote dialog details".split())

#: Where markup begins; the rest of a tag is read once, up to its end or the next sign that opens one.
OPENS = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTES = re.compile(r"(?:\"[^\"<]*+\"|'[^'<]*+'|[^'\"<>]++)*+>")
NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements deeper than this are aligned with their ancestor, unless they change what the text is.
DEPTH = 100
#: Shapes of a host that are merged in one group.
FOLD = 64
#: More children than this are told apart by their kind alone.
SIBLINGS = 40
#: A text is template at a place if this share of the page bodies there hold it, and so many at least.
MOST, LEAST_BODIES = 0.8, 5
#: A container with this share of a host's varying text, weighed by marks, is its content region.
REGION = 0.9
#: What a character counts there, by mark.
WEIGHTS = (1, 4, 8)
#: Of a region's varying text, marked main or not at all, this share must be main for marks to decide.
MAINLY = 1 / 3
#: A page with less than this share of its text in its host's region has one of its own.
STRAYS = 0.25

#: Set aside by tag; by name; marked main; none of these.
FRAME, SOFT, MAIN, PLAIN = "-", "~", "+", ""
NUMBERED = {SOFT: 0, PLAIN: 1, MAIN: 2}


def kind(tag: str, attributes: str) -> str:
    """What makes elements comparable: tag, class and id, led by what they say that they are."""
    names = " ".join(a or b or c for _, a, b, c in NAMED.findall(attributes)).lower() if attributes else ""
    names = re.sub(r"\d+", "0", names)
    if tag in FRAME_TAGS:
        mark = FRAME
    elif names and tag not in ("html", "body") and FRAME_WORDS.search(names):
        mark = SOFT
    elif tag in MAIN_TAGS or (names and tag in CONTAINERS and MAIN_WORDS.search(names)):
        mark = MAIN
    else:
        mark = PLAIN
    return f"{mark}{tag} {names}".strip()


class Element:
    """An element of a page; ``seat`` is the element of the aligned tree that stands for it."""

    __slots__ = ("kind", "tag", "children", "parent", "depth", "mark", "seat", "soft")

    def __init__(self, tag: str, kind: str, parent: Element | None):
        self.tag, self.kind, self.parent, self.children = tag, kind, parent, []
        self.depth, self.mark, self.seat, self.soft = 0, PLAIN, self, None
        if parent is not None:
            self.depth, self.mark, self.soft = parent.depth + 1, parent.mark, parent.soft
            own = kind[:1]
            if own == FRAME or self.mark != FRAME and own == SOFT:
                self.mark = own
            elif own == MAIN and (self.mark == PLAIN or self.mark == SOFT and tag in MAIN_TAGS):
                # An article stands for itself, whatever the element around it is called.
                self.mark = MAIN
            if self.mark != SOFT:
                self.soft = None
            elif self.soft is None:
                self.soft = self
            if self.depth <= DEPTH or self.mark != parent.mark:
                parent.seat.children.append(self)
            else:
                self.seat = parent.seat


def parsed(page: str) -> tuple[list[Element], list[tuple[Element, int, str]]]:
    """All elements in preorder, the root first, and every text with its element and the number of its block."""
    root = Element("", "", None)
    elements = [root]
    here, block, texts, at = root, 0, [], 0
    kinds: dict[tuple[str, str], str] = {}
    opened: dict[str, list[Element]] = {}

    def leave(upto: Element) -> None:
        nonlocal here
        while here is not upto:
            opened[here.tag].pop()
            here = here.parent

    def deepest(tags) -> int:
        return max((opened[t][-1].depth for t in tags if opened.get(t)), default=0)

    end = len(page)
    final = {sign: page.rfind(sign) for sign in (">", "-->", "]]>")}
    closes = {"<!--": "-->", "<![CDATA[": "]]>"}
    since = 0

    def said(upto: int) -> None:
        if upto > since:
            texts.append((here, block, page[since:upto]))

    while at < end:
        found = OPENS.search(page, at)
        if found is None:
            break
        start, at = found.span()
        closing, tag = found.group(1, 2)
        if tag is None:
            mark = found.group()
            sign = closes.get(mark, ">")
            if at > final[sign] and mark != "<!--":
                sign = ">"
            if at > final[sign] and mark != "<!--":
                continue
            said(start)
            at = since = page.index(sign, at) + len(sign) if at <= final[sign] else end
            continue
        if at > final[">"]:
            # Nothing closes a tag from here on; a comment may still open.
            at = page.find("<!--", start)
            if at < 0:
                break
            continue
        whole = ATTRIBUTES.match(page, at)
        stop = whole.end() if whole else page.index(">", at) + 1
        said(start)
        attributes = page[at : stop - 1]
        at = since = stop
        tag = tag.lower()
        if tag == "br":
            texts.append((here, block, " "))
        if tag in BLOCKS:
            block += 1
        if closing:
            if opened.get(tag):
                leave(opened[tag][-1].parent)
            continue
        if tag in ENDS_P and opened.get("p") and opened["p"][-1].depth > deepest(("table", "button")):
            leave(opened["p"][-1].parent)
        if tag in CLOSES:
            ended, fence = CLOSES[tag]
            floor, last = deepest(fence), None
            for rows in (opened.get(t, ()) for t in ended):
                first = bisect_right(rows, floor, key=lambda e: e.depth)
                if first < len(rows) and (last is None or rows[first].depth < last.depth):
                    last = rows[first]
            if last is not None:
                leave(last.parent)
        if tag in VOID:
            continue
        key = (tag, attributes)
        child = Element(tag, kinds.get(key) or kinds.setdefault(key, kind(tag, attributes)), here)
        elements.append(child)
        if tag in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = since = stop.end() if stop else end
            continue
        if attributes.endswith("/") and tag in RAW:
            continue
        here = child
        opened.setdefault(tag, []).append(child)
    said(end)
    return elements, texts


# ---- trees as nested tuples (kind, children), so that work on equal shapes is done once; a
# third item marks a node that stands for several neighbours of one page


def tag_of(node: tuple) -> str:
    return node[0].lstrip(MAIN + SOFT + FRAME).split(" ")[0]


class Trees:
    """Matching and merging of trees; results are kept per task, by shape."""

    def __init__(self):
        self.score = lru_cache(200_000)(self._score)
        self.merged = lru_cache(200_000)(self._merged)
        self.size = lru_cache(200_000)(self._size)
        self.places = lru_cache(50_000)(self._places)
        self.skeleton = lru_cache(50_000)(self._skeleton)
        self.located = lru_cache(50_000)(self._located)

    def _score(self, a: tuple, b: tuple) -> int:
        """Simple tree matching: nodes that can be paired, roots first, children in order."""
        if a[0] != b[0]:
            return 0
        return 1 + self._grid(a[1], b[1])[-1][-1]

    def _grid(self, xs: tuple, ys: tuple) -> list[list[int]]:
        grid = [[0] * (len(ys) + 1)]
        for x in xs:
            above, row = grid[-1], [0]
            for j, y in enumerate(ys):
                row.append(max(above[j + 1], row[j], above[j] + self.score(x, y)))
            grid.append(row)
        return grid

    def _merged(self, a: tuple, b: tuple) -> tuple:
        """One tree that both trees fit into; their roots are of one kind."""
        if a == b:
            return a
        xs, ys = a[1], b[1]
        grid = self._grid(xs, ys)
        i, j, out = len(xs), len(ys), []
        while i or j:
            fit = self.score(xs[i - 1], ys[j - 1]) if i and j else 0
            if fit and grid[i][j] == grid[i - 1][j - 1] + fit:
                out.append(self.merged(xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
            elif i and grid[i][j] == grid[i - 1][j]:
                out.append(xs[i - 1])
                i -= 1
            else:
                out.append(ys[j - 1])
                j -= 1
        return (a[0], self.squeezed(tuple(reversed(out))), *(a[2:] or b[2:]))

    def alike(self, a: tuple, b: tuple) -> bool:
        return 2 * self.score(a, b) >= max(self.size(a), self.size(b))

    def squeezed(self, children: tuple) -> tuple:
        """Neighbours of one kind as one repeated node; very many children by kind alone.

        Containers are neighbours of one kind only if half of the larger one fits the other: an
        advert beside an article stays a place of its own, whatever both are called.
        """
        runs: list[list[tuple]] = []
        for c in children:
            before = runs[-1][-1] if runs else None
            if before and before[0] == c[0] and (tag_of(c) not in CONTAINERS or self.alike(before, c)):
                runs[-1].append(c)
            else:
                runs.append([c])
        if len(runs) > SIBLINGS:
            by_kind: dict[str, list] = {}
            for c in children:
                by_kind.setdefault(c[0], []).append(c)
            runs = list(by_kind.values())
        out = []
        for members in runs:
            node = members[0]
            for other in dict.fromkeys(members[1:]):
                node = self.merged(node, other)
            out.append((*node[:2], True) if len(members) > 1 else node)
        return tuple(out)

    def _size(self, tree: tuple) -> int:
        return 1 + sum(self.size(c) for c in tree[1])

    def _places(self, children: tuple, slots: tuple) -> tuple[int, ...]:
        """For each child the slot that it fits, in order; a slot takes any number of neighbours."""
        kinds = [s[0] for s in slots]
        if len(set(kinds)) == len(kinds):
            at = {k: j for j, k in enumerate(kinds)}
            return tuple(at.get(c[0], -1) for c in children)
        best, back = [0] * len(slots), []
        for c in children:
            row, come, high, of = [], [], -(10**9), 0
            for j, s in enumerate(slots):
                if best[j] > high:
                    high, of = best[j], j
                fit = self.score(c, s)
                row.append(high + fit if fit else -(10**9))
                come.append(of)
            best = row
            back.append(come)
        j = max(range(len(slots)), key=lambda j: (best[j], -j)) if slots else -1
        if j < 0 or best[j] < 0:
            # Rows of very many siblings are kept without their order: take the best fit of all.
            fits = [[self.score(c, s) for s in slots] for c in children]
            return tuple(max(range(len(f)), key=f.__getitem__) if any(f) else -1 for f in fits)
        out = []
        for come in reversed(back):
            out.append(j)
            j = come[j]
        return tuple(reversed(out))

    def _skeleton(self, tree: tuple) -> tuple:
        """A literal tree with repeated neighbours as one."""
        return (tree[0], self.squeezed(tuple(self.skeleton(c) for c in tree[1])))

    def _located(self, tree: tuple, frame: tuple) -> tuple[int, ...]:
        """The number of the frame's node, in preorder, for every node of the tree, in preorder."""
        starts = [1]
        for s in frame[1]:
            starts.append(starts[-1] + self.size(s))
        out = [0]
        for child, j in zip(tree[1], self.places(tree[1], frame[1]), strict=True):
            if j < 0:
                out += [0] * self.size(child)
            else:
                out += [n + starts[j] for n in self.located(child, frame[1][j])]
        return tuple(out)


def shape(element: Element) -> tuple:
    """The literal tree of an element."""
    return (element.kind, tuple(shape(c) for c in element.children))


# ---- Spark


PARSED = (
    "page_id long, url string, host string, shape string, shape_id long, body long, "
    "nodes array<struct<slot:int,key:long,line:int,size:int,mark:int,title:boolean>>, "
    "texts array<struct<node:int,block:int,text:string>>"
)
NODE = pa.struct(
    [
        ("slot", pa.int32()), ("key", pa.int64()), ("line", pa.int32()),
        ("size", pa.int32()), ("mark", pa.int32()), ("title", pa.bool_()),
    ]
)
TEXT = pa.struct([("node", pa.int32()), ("block", pa.int32()), ("text", pa.string())])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Pages with the shape of their tree, what its plain elements say, and every text that may be content.

    ``nodes`` are the elements, frames by tag left out, that have text of their own: their slot, a
    hash of that text, the node in whose line an inline element stands, the text's size, their
    mark, and whether they are a title. ``texts`` name their node, or none if they are blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [one_page(trees, x or "", y or "") for x, y in zip(part["url"].to_pylist(), part["html"].to_pylist(), strict=True)]
                hosts, shapes, ids, bodies, nodes, texts = (list(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["page_id"], part["url"], pa.array(hosts), pa.array(shapes), pa.array(ids, pa.int64()),
                        pa.array(bodies, pa.int64()), pa.array(nodes, pa.list_(NODE)), pa.array(texts, pa.list_(TEXT)),
                    ],
                    names=["page_id", "url", "host", "shape", "shape_id", "body", "nodes", "texts"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(lean(run), PARSED)


def one_page(trees: Trees, url: str, page: str) -> tuple:
    elements, texts = parsed(page)
    tree = shape(elements[0])
    frame = trees.skeleton(tree)
    seats = [id(e) for e in elements if e.seat is e]
    number = dict(zip(seats, trees.located(tree, frame), strict=True))
    own, body, lines = {}, [], set()
    for at, (element, block, text) in enumerate(texts):
        if element.mark == FRAME:
            continue
        text = html.unescape(text) if "&" in text else text
        texts[at] = (element, block, text)
        own.setdefault(id(element), []).append(text)
        if element.mark != SOFT:
            body.append(text)
            if not text.isspace():
                lines.add(block)
    # An inline element in a line of other text belongs to it, whatever its name.
    spoken: dict[int, str] = {}
    for element, block, _ in texts:
        if element.soft is not None and element.soft.tag not in BLOCKS and block in lines:
            spoken[id(element)] = element.soft.parent.mark
    nodes, node, line, found = [], {}, {}, []
    for e in elements:
        if e.mark == FRAME:
            continue
        above = -1 if e.parent is None or e.tag in BLOCKS else line.get(id(e.parent), -1)
        line[id(e)] = above
        said = " ".join("".join(own.get(id(e), ())).split())
        if said:
            line[id(e)] = node[id(e)] = len(nodes)
            nodes.append(
                {
                    "slot": number[id(e.seat)],
                    "key": xxhash.xxh3_64_intdigest(said) - (1 << 63),
                    "line": above,
                    "size": len(said),
                    "mark": NUMBERED[spoken.get(id(e), e.mark)],
                    "title": e.tag == "h1",
                }
            )
    for element, block, text in texts:
        if element.mark != FRAME:
            found.append({"node": node.get(id(element), -1), "block": block, "text": text})
    text = json.dumps(frame, ensure_ascii=False)
    host = re.sub(r"^[a-z][a-z0-9+.-]*:(?=//)", "", url.strip().lower())
    host = re.split(r"[/?#]", host[2:] if host.startswith("//") else host)[0]
    return host, text, xxhash.xxh3_64_intdigest(text) - (1 << 63), xxhash.xxh3_64_intdigest(" ".join("".join(body).split())) - (1 << 63), nodes, found


def _tuple(tree: list) -> tuple:
    return (tree[0], tuple(_tuple(c) for c in tree[1]), *tree[2:])


def region(tree: tuple, weights: dict[int, float]) -> tuple[int, int]:
    """The places, from and to, of the innermost container that holds nearly all weight.

    ``weights`` are those of places, numbered in preorder. The way down ends at an element that
    is marked main, and at one of which a page has several.
    """
    sums: list[float] = []
    ends: list[int] = []

    def add(node: tuple) -> float:
        at = len(sums)
        sums.append(0.0)
        ends.append(0)
        sums[at] = weights.get(at, 0.0) + sum(add(c) for c in node[1])
        ends[at] = len(sums)
        return sums[at]

    total = add(tree)
    at, node = 0, tree
    while total > 0 and node[0][:1] != MAIN:
        start, inner = at + 1, None
        for child in node[1]:
            if len(child) == 2 and tag_of(child) in CONTAINERS and sums[start] >= REGION * total:
                inner = (start, child)
            start = ends[start]
        if inner is None:
            break
        at, node = inner
    return at, ends[at]


def _folded(shapes: list[str]) -> str:
    tools = Trees()
    trees = [_tuple(json.loads(s)) for s in shapes]
    out = trees[0]
    for tree in trees[1:]:
        out = tools.merged(out, tree)
    return json.dumps(out, ensure_ascii=False)


def wrappers(shapes: DataFrame) -> DataFrame:
    """(host, wrapper): one tree per host that all its shapes fit into.

    Shapes are merged in levels, about ``FOLD`` of a host in a group, and every level is written:
    however many shapes a host has, no task holds more of them at once.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shape_id")
        out = rows.iloc[:1][["host", "shape_id"]].copy()
        out["shape"] = _folded(list(rows["shape"]))
        return out

    schema = "host string, shape_id long, shape string"
    now = shapes.select("host", "shape_id", "shape")
    while True:
        sizes = stored(now.groupBy("host").agg(F.count("*").alias("_n")), "host-sizes")
        if (sizes.agg(F.max("_n")).first()[0] or 0) <= 1:
            return now.select("host", F.col("shape").alias("wrapper"))
        groups = F.ceil(F.col("_n") / FOLD)
        dealt = now.join(sizes, "host").withColumn("_group", F.pmod(F.xxhash64("shape_id"), groups))
        now = stored(dealt.select(*now.columns, "_group").groupBy("host", "_group").applyInPandas(fold, schema), "folds")


def slots(shapes: DataFrame, frames: DataFrame) -> DataFrame:
    """host, shape_id, slot, place: where a shape's slots lie in the host's wrapper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees()
        for batch in batches:
            out = []
            for host, shape_id, text, wrapper in zip(*(batch[c].to_pylist() for c in ("host", "shape_id", "shape", "wrapper")), strict=True):
                tree, frame = _tuple(json.loads(text)), _tuple(json.loads(wrapper))
                out += [(host, shape_id, slot, place) for slot, place in enumerate(trees.located(tree, frame))]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["host", "shape_id", "slot", "place"],
            )

    schema = "host string, shape_id long, slot int, place int"
    return shapes.join(frames, "host").select("host", "shape_id", "shape", "wrapper").mapInArrow(run, schema)


def place_counts(parsed: DataFrame, aligned: DataFrame) -> DataFrame:
    """host, place, key, n, plain, main, soft: bodies of a host that hold a text at a place, and its characters.

    A null key stands for all bodies with the place. Pages with one body count once, so neither
    copies nor the number of pages weigh.
    """
    bodies = (
        parsed.select("host", "body", F.struct("page_id", "shape_id", "nodes").alias("page"))
        .groupBy("host", "body")
        .agg(F.min_by("page", F.struct("page.page_id", "page.shape_id")).alias("page"))
        .select("host", "page.shape_id", "page.nodes")
    )
    places = aligned.groupBy("host", "shape_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "place"))), lambda s: s["place"]).alias("places")
    )
    at = lambda r: F.get("places", r["slot"])
    sized = lambda r, mark: F.when(r["mark"] == NUMBERED[mark], r["size"]).otherwise(0).cast("long")
    marks = {"plain": PLAIN, "main": MAIN, "soft": SOFT}
    met = F.transform(
        "nodes",
        lambda r: F.struct(at(r).alias("place"), r["key"].alias("key"), *[sized(r, m).alias(c) for c, m in marks.items()]),
    )
    all_of = F.transform(
        F.array_distinct(F.transform("nodes", at)),
        lambda p: F.struct(p.alias("place"), F.lit(None).cast("long").alias("key"), *[F.lit(0).cast("long").alias(c) for c in marks]),
    )
    return (
        bodies.join(places, ["host", "shape_id"])
        .select("host", F.explode(F.concat(F.array_distinct(met), all_of)).alias("m"))
        .select("host", "m.*")
        .groupBy("host", "place", "key")
        .agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in marks])
    )


def constant_texts(counts: DataFrame) -> DataFrame:
    """(host, place, key): texts that most different page bodies of the host with that place hold there.

    What is compared are counts of bodies, so the verdict does not depend on the number of
    pages, nor on how many different words a place draws from.
    """
    common = counts.filter(F.col("n") >= LEAST_BODIES)
    of = common.filter(F.col("key").isNull()).select("host", "place", F.col("n").alias("of"))
    return (
        common.filter(F.col("key").isNotNull())
        .join(of, ["host", "place"])
        .filter(F.col("n") >= MOST * F.col("of"))
        .select("host", "place", "key")
    )


def regions(counts: DataFrame, constant: DataFrame, frames: DataFrame) -> DataFrame:
    """host, low, high, mainly: the places of the host's content region, and whether its text is mostly marked main.

    Constant texts do not count. A host brings its wrapper and a number per place of it.
    """
    varying = counts.filter(F.col("key").isNotNull()).join(constant, ["host", "place", "key"], "left_anti")
    sums = [F.sum(c).alias(c) for c in ("soft", "plain", "main")]
    places = varying.groupBy("host", "place").agg(*sums)
    rows = places.groupBy("host").agg(F.collect_list(F.struct("place", "soft", "plain", "main")).alias("places")).join(frames, "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, places, wrapper in zip(*(batch[c].to_pylist() for c in ("host", "places", "wrapper")), strict=True):
                low, high, mainly = chosen(_tuple(json.loads(wrapper)), [tuple(p.values()) for p in places])
                out.append((host, low, high, mainly))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_())
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "low", "high", "mainly"]
            )

    return rows.select("host", "places", "wrapper").mapInArrow(lean(run), "host string, low int, high int, mainly boolean")


def chosen(tree: tuple, places: list[tuple[int, int, int, int]]) -> tuple[int, int, bool]:
    """The content region of a tree, from (place, soft, plain, main) characters, and whether it is mainly main."""
    weights: dict[int, float] = {}
    for place, *sizes in places:
        weights[place] = weights.get(place, 0) + sum(n * w for n, w in zip(sizes, WEIGHTS, strict=True))
    low, high = region(tree, weights)
    inside = [p for p in places if low <= p[0] < high]
    plain, main = sum(p[2] for p in inside), sum(p[3] for p in inside)
    return low, high, main > 0 and main >= MAINLY * (plain + main)


def evidence(parsed: DataFrame) -> DataFrame:
    """(host, shape_id, template, inside, mainly): what the wrapper of its host says of a shape.

    ``template`` are slots and hashes of texts that are template, ``inside`` the slots in the
    content region. Neighbours of one kind share a place: among them too, each text is judged
    for itself.
    """
    shapes = stored(parsed.groupBy("host", "shape_id").agg(F.first("shape").alias("shape")), "shapes")
    frames = stored(wrappers(shapes), "wrappers")
    aligned = stored(slots(shapes, frames), "slots")
    counts = stored(place_counts(parsed, aligned), "counts")
    constant = stored(constant_texts(counts), "constant")
    found = stored(regions(counts, constant, frames), "regions")
    template = (
        aligned.join(constant, ["host", "place"])
        .groupBy("host", "shape_id")
        .agg(F.collect_set(F.struct("slot", "key")).alias("template"))
    )
    inside = (
        aligned.join(found, "host")
        .groupBy("host", "shape_id")
        .agg(
            F.sort_array(F.collect_list(F.when((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")), F.col("slot")))).alias("inside"),
            F.first("mainly").alias("mainly"),
        )
    )
    return inside.join(template, ["host", "shape_id"], "left")


def kept_nodes(
    nodes: list[dict], shape: str, template: list[dict] | None, inside: list[int] | None, mainly: bool | None
) -> list[bool]:
    """Per node whether it is content.

    First the wrapper: template goes, unless it stands inside a line of content or in a main
    element, and so does what lies outside the content region; a page that has hardly any of
    its text there gets a region of its own. Then the marks: text of elements that are frame by
    name goes, unless the page has no other, and where a host's text is mostly main, what is
    not. The title of a page that has none inside stays.
    """
    drop = {(t["slot"], t["key"]) for t in template or ()}
    varies: list[bool] = []
    for n in nodes:
        constant = n["mark"] < 2 and (n["slot"], n["key"]) in drop
        varies.append(not constant or (n["line"] >= 0 and varies[n["line"]]))
    slots = set(inside or ())
    own = sum(n["size"] for n, v in zip(nodes, varies, strict=True) if v and n["mark"])
    held = sum(n["size"] for n, v in zip(nodes, varies, strict=True) if v and n["mark"] and n["slot"] in slots)
    if held < STRAYS * own:
        places = [
            (n["slot"], *[n["size"] * (n["mark"] == m) for m in range(3)]) for n, v in zip(nodes, varies, strict=True) if v
        ]
        low, high, mainly = chosen(_tuple(json.loads(shape)), places)
        slots = set(range(low, high))
    here = [v and n["slot"] in slots for n, v in zip(nodes, varies, strict=True)]
    marks = {n["mark"] for n, h in zip(nodes, here, strict=True) if h}
    least = 2 if mainly and 2 in marks else 1 if own else 0
    out = [h and n["mark"] >= least for n, h in zip(nodes, here, strict=True)]
    if not any(o and n["title"] for o, n in zip(out, nodes, strict=True)):
        out = [o or (v and n["title"] and n["mark"] > 0) for o, v, n in zip(out, varies, nodes, strict=True)]
    # An inline element in a line of content is content.
    for i, n in enumerate(nodes):
        out[i] = out[i] or (n["line"] >= 0 and out[n["line"]] and varies[i] and n["mark"] > 0)
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Blocks are block-level elements; white space inside one is a single space, empty ones are
    left out, and a line break joins them. Null and empty pages have an empty text. A page
    without a host is aligned with others without one. Repeated rows give a row each. Unclosed
    elements, stray end tags and cut references are read as browsers do. Other columns are not read.

    Pages are parsed once; what is read of them is written, and every later pass reads the
    columns that it needs.
    """
    parsed = stored(parsed_pages(pages), "pages")
    known = stored(evidence(parsed), "evidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = ("nodes", "texts", "shape", "template", "inside", "mainly")
            for nodes, texts, *evidence in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                kept = kept_nodes(nodes, *evidence)
                blocks = []
                for _, pieces in groupby(texts, key=lambda t: t["block"]):
                    line = " ".join("".join(t["text"] if t["node"] >= 0 and kept[t["node"]] else " " for t in pieces).split())
                    if line:
                        blocks.append(line)
                out.append("\n".join(blocks))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return (
        parsed.select("page_id", "url", "host", "shape_id", "nodes", "texts", "shape")
        .join(known, ["host", "shape_id"], "left")
        .select("page_id", "url", "nodes", "texts", "shape", "template", "inside", "mainly")
        .mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
    )
