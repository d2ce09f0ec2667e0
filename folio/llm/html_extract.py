"""HTML main text by wrapper induction over the pages of a host.

Every page is parsed once, into its blocks of text and its layout: the tree of block elements without texts, in which runs
of like siblings are one first, one middle and one last of them. A host's reference tree is merged from the layouts of its
pages, the commonest first, by partial tree alignment: nodes that the reference lacks are put in beside their matched
neighbours. Layouts of more than 1 - ``CONSTANT`` of the pages are enough, as a node on ``CONSTANT`` of all pages stands in
one of them. Every layout is aligned with the reference by simple tree matching: two nodes match if tag and class agree,
children are matched in order so that the number of matched nodes is largest.

Pages vote by their longest block, so that copies and versions of one article count once. An aligned node whose text is the
same for n of a host's v votes is template, inside the article too, if (n + 1) / (v + 2) is at least ``CONSTANT``; three
votes are the fewest that can tell. What varies is a content slot.

Elements that are boilerplate by tag, or by a class, id or role word that says what they are (``SKIPPED_WORDS``), are no
content, even if their text varies as that of menus, adverts and comments does. Words that articles use too
(``DOUBTFUL_WORDS``) are settled by the host: where the aligned slot's texts vary (no text has half of the votes), it is
content; where there are too few votes, it is boilerplate unless it holds more text than the rest of the article. Inline
elements are not judged by doubtful words. Where a page has ``article`` or ``main`` with text, only that is taken. Blocks
are runs of text between starts and ends of block elements; white space becomes one space, character references are
decoded, and blocks are joined in page order by one newline.

Null or empty html gives an empty text; cut-off tags at the end are dropped, a tag with an unclosed quote ends at its first
``>``, and raw elements that are self-closed or never closed hide nothing after their own tag (an unclosed script or style
hides the rest, which is code); formulas in ``math`` are markup; other broken markup is read as browsers do. Elements may lie
at any depth, pages may have any length. Urls without a host share the empty host. Repeated rows are extracted alike, equal
counts of layouts stand in the order of their strings; an empty table gives an empty result; other columns are ignored,
whatever their names. Only counts by (host, layout) and by (host, reference node, text hash) are shuffled, combined before.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import keep, map_rows, table
from folio.llm.url_filter import url_parts

CONSTANT = 0.8
#: Layouts that one task merges to a reference tree at once.
MERGED = 64
#: With fewer votes (n + 1) / (v + 2) cannot reach CONSTANT.
FEWEST = 3

# Element names and boilerplate words.
#: Raw elements that take room in their line; others leave no gap between the words around them.
DRAWN = frozenset("textarea iframe svg math select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select option button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
SKIPPED_TAGS = frozenset(
    "nav header footer aside form script style noscript template iframe svg math head title button select option textarea dialog menu object canvas audio video".split()
)
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead comment comments disqus cookie cookies consent notice notices newsletter subscribe share sharing social "
    "related pagination pager complementary contentinfo".split()
)
#: Words that tell the shape or place of an element, not what it is.
SHAPE_WORDS = frozenset(
    "area bar block body bottom box button buttons column container content count desktop fixed float form frame group head horizontal icon icons inline inner item items large left link links list main "
    "mobile outer panel post posts primary right row secondary section site slot small sticky tab title top unit vertical widget wrap wrapper".split()
)
DOUBTFUL_WORDS = frozenset("alert banner header modal popup promo promoted recommended search toolbar widget".split())
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|$)""", re.S)
_UNCLOSED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|$)")
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[\s_-]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "label", "children", "skipped", "main", "number", "hides", "inner", "doubt", "kept", "like")

    def __init__(self, tag: str, label: str, skipped: bool, main: bool, doubt: bool = False) -> None:
        self.tag, self.label, self.skipped, self.main, self.doubt = tag, label, skipped, main, doubt
        self.children: list[Node] = []
        self.number = 0
        #: In a layout: the children that stand for all, and the node that stands for this one.
        self.kept: list[Node] = []
        self.like: Node | None = None
        #: Whether it is boilerplate by itself, and how many plain inline elements of its tag are open inside.
        self.hides, self.inner = False, 0


def parse(html: str | None) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and each block of text with the element it stands in, in page order."""
    root = Node("", "", False, False)
    open_nodes, blocks, run = [root], [], []
    raw: dict[str, Callable[[int], int | None]] = {}
    opened: Counter[str] = Counter()

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                # Text of skipped nodes is not kept, so the run stands in the deepest node that is not skipped.
                blocks.append((next(n for n in reversed(open_nodes) if not n.skipped), text))
            run.clear()

    def close(i: int) -> None:
        opened.subtract(n.tag for n in open_nodes[i:])
        del open_nodes[i:]

    def start_node(tag: str, label: str, hides: bool, doubt: bool = False) -> None:
        above = open_nodes[-1]
        node = Node(tag, label, above.skipped or hides, above.main or tag in ("article", "main"), above.doubt or doubt)
        node.hides = hides
        above.children.append(node)
        open_nodes.append(node)
        opened[tag] += 1

    def show(text: str) -> None:
        if not open_nodes[-1].skipped:
            run.append(text)

    html = html or ""
    at, end = 0, len(html)
    while at < end:
        start = html.find("<", at)
        if start < 0:
            show(html[at:])
            break
        if start > at:
            show(html[at:start])
        m = _TOKEN.match(html, start) or _UNCLOSED.match(html, start)
        if not m:
            show("<")
            at = start + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:
            break
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if tag not in raw:
                raw[tag] = _raw_ends(html, tag)
            code = tag in ("script", "style")
            if code or not m[3].rstrip().endswith("/"):
                done = raw[tag](start)
                at = done or (end if code else html.find("<", at) if tag == "option" else at)
                at = end if at < 0 else at
            if tag in ("title", "option"):
                flush()
            elif tag in DRAWN:
                show(" ")
            continue
        if tag in INLINE:
            if tag in ("br", "img"):
                show(" ")
            if tag in VOID:
                continue
            # Of inline elements only skipped ones are nodes; they hide their text and do not end the run around them.
            own = next((i for i in range(len(open_nodes) - 1, 0, -1) if open_nodes[i].tag == tag), 0) if opened[tag] else 0
            crossed = own and any(n.tag not in INLINE for n in open_nodes[own + 1 :])
            if own and (closing or tag == "a"):
                if open_nodes[own].inner and not crossed:
                    open_nodes[own].inner -= 1
                elif not crossed:
                    close(own)
                elif tag in FORMATTING:
                    # As browsers do, blocks left open go on outside the ended element.
                    left = [n for n in open_nodes[own + 1 :] if n.tag not in INLINE]
                    close(own)
                    for n in left:
                        start_node(n.tag, n.label, n.hides)
                own = 0
            if closing:
                continue
            if own and not crossed:
                open_nodes[own].inner += 1
            elif _skipped("", m[3]) and not m[3].rstrip().endswith("/"):
                start_node(tag, f"{tag} {_words(m[3])}", True)
            continue
        flush()
        if closing:
            if opened[tag]:
                close(next(i for i in range(len(open_nodes) - 1, 0, -1) if open_nodes[i].tag == tag))
            continue
        if tag in CLOSES_P:
            for i in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[i].tag == "p":
                    close(i)
                    break
                if open_nodes[i].tag not in INLINE:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            last = next(i for i in range(len(open_nodes) - 1, -1, -1) if open_nodes[i].tag not in INLINE)
            if open_nodes[last].tag in (("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)):
                close(last)
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        start_node(tag, f"{tag} {_words(m[3])}", _skipped(tag, m[3]), _named(tag, m[3], DOUBTFUL_WORDS))
    flush()
    return root, blocks


def _raw_ends(html: str, tag: str) -> Callable[[int], int | None]:
    """For a start of the raw element ``tag``: the end of its closing tag, None if it is never closed."""
    tags = re.finditer(rf"<(/?){tag}(?=[\s/>]|$)[^>]*(?:>|$)", html, re.I)
    if tag in ("script", "style", "title", "textarea", "iframe"):
        # Their content is plain text, so the next closing tag ends them.
        ends = [(m.start(), m.end()) for m in tags if m[1]]
        starts = [a for a, _ in ends]
        return lambda at: ends[i][1] if (i := bisect_right(starts, at)) < len(ends) else None
    closed: dict[int, int] = {}
    waiting: list[int] = []
    for m in tags:
        if m[1]:
            if waiting:
                closed[waiting.pop()] = m.end()
        elif not m[0].endswith("/>"):
            waiting.append(m.start())
    return closed.get


def _words(attributes: str) -> str:
    return " ".join(v or w or x for k, v, w, x in _ATTR.findall(attributes) if k.lower() == "class") if attributes else ""


def _skipped(tag: str, attributes: str) -> bool:
    return tag in SKIPPED_TAGS or _named(tag, attributes, SKIPPED_WORDS)


def _named(tag: str, attributes: str, words: frozenset) -> bool:
    """Whether a class, id or role is named by these words alone, apart from those of shape and numbers."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for _, x, y, z in _ATTR.findall(attributes):
        for name in (x or y or z).split():
            parts = [w for w in _SPLIT.split(_HUMP.sub("-", name).lower()) if w and not w.isdigit()]
            if any(w in words for w in parts) and all(w in words or w in SHAPE_WORDS for w in parts):
                return True
    return False


def number_layout(root: Node) -> str:
    """Number the nodes by their places in the layout, like ones in the middle of a run alike; returns it as a skeleton."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += node.children
    kinds: dict[tuple, int] = {}
    kind: dict[int, int] = {}
    for node in reversed(nodes):
        kept, run, now = [], [], None
        for child in [*node.children, None]:
            if child is not None and kind[id(child)] == now:
                run.append(child)
                continue
            if len(run) > 3:
                for x in run[2:-1]:
                    x.like = run[1]
                run = [run[0], run[1], run[-1]]
            kept += run
            run, now = [child], child and kind[id(child)]
        node.kept = kept
        kind[id(node)] = kinds.setdefault((node.label, *(kind[id(c)] for c in kept)), len(kinds))
    count, out = 0, []
    walk: list[Node | None] = [root]
    while walk:
        node = walk.pop()
        if node is None:
            out.append(")")
            continue
        node.number = count
        count += 1
        out.append("(" + re.sub(r"[()]", "", node.label))
        walk.append(None)
        walk += reversed(node.kept)
    same = [(x, x.like) for x in reversed(nodes) if x.like is not None]
    while same:
        x, y = same.pop()
        x.number = y.number
        same += zip(x.kept, y.kept, strict=True)
    return "".join(out[1:-1])


def skeleton(html: str | None) -> str:
    """The tree without texts, as tags in brackets, to be matched against."""
    return write_skeleton(parse(html)[0])


def write_skeleton(root: Node) -> str:
    out: list[str] = []
    todo: list[Node | None] = root.children[::-1]
    while todo:
        node = todo.pop()
        if node is None:
            out.append(")")
            continue
        out.append("(" + re.sub(r"[()]", "", node.label))
        todo.append(None)
        todo += reversed(node.children)
    return "".join(out)


def read_skeleton(text: str) -> Node:
    root = Node("", "", False, False)
    stack, number = [root], 0
    for m in re.finditer(r"\(([^()]*)|\)", text or ""):
        if m[0] == ")":
            stack.pop()
        else:
            number += 1
            node = Node("", m[1], False, False)
            node.number = number
            stack[-1].children.append(node)
            stack.append(node)
    return root


def unnumbered(skeleton: str) -> Node:
    """The tree of a skeleton as a page's, not as a reference."""
    root = read_skeleton(skeleton)
    todo = [root]
    while todo:
        node = todo.pop()
        node.number = 0
        todo += node.children
    return root


#: Rows of a matching whose way back is held at once; those before are gone through again from the nearest row kept.
HELD_ROWS = 512


class Kinds:
    """Subtrees that are alike share a number; scores of pairs of numbers are how many of their nodes can be matched."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.of: dict[int, int] = {}
        self.scores: dict[tuple[int, int], int] = {}

    def add(self, root: Node) -> int:
        nodes, todo = [], [root]
        while todo:
            node = todo.pop()
            nodes.append(node)
            todo += node.children
        for node in reversed(nodes):
            below = tuple(self.of[id(c)] for c in node.children)
            number = self.numbers.setdefault((node.label, below), len(self.labels))
            if number == len(self.labels):
                self.labels.append(node.label)
                self.children.append(below)
                self.sizes.append(1 + sum(self.sizes[k] for k in below))
            self.of[id(node)] = number
        return self.of[id(root)]

    def score(self, a: int, b: int) -> int:
        """How many nodes of two subtrees can be matched; known for all pairs that ``prepare`` was given."""
        return self.sizes[a] if a == b else self.scores[a, b] if self.labels[a] == self.labels[b] else 0

    def middle(self, a: int, b: int) -> tuple[int, int]:
        """How many first and last children of two subtrees are alike; to match these with one another is never worse."""
        x, y = self.children[a], self.children[b]
        least = min(len(x), len(y))
        first = next((i for i in range(least) if x[i] != y[i]), least)
        last = next((i for i in range(least - first) if x[-1 - i] != y[-1 - i]), least - first)
        return first, last

    def prepare(self, a: int, b: int) -> None:
        """Score a pair, after all pairs of children that it needs."""
        pending = [(a, b, False)]
        while pending:
            a, b, ready = pending.pop()
            if a == b or (a, b) in self.scores or self.labels[a] != self.labels[b]:
                continue
            first, last = self.middle(a, b)
            x, y = (self.children[k][first : len(self.children[k]) - last] for k in (a, b))
            if not ready:
                pending.append((a, b, True))
                below: dict[str, list[int]] = {}
                for k in dict.fromkeys(y):
                    below.setdefault(self.labels[k], []).append(k)
                pending += [(i, k, False) for i in dict.fromkeys(x) for k in below.get(self.labels[i], ()) if i != k]
                continue
            alike = sum(self.sizes[k] for k in (*self.children[a][:first], *self.children[a][len(self.children[a]) - last :]))
            self.scores[a, b] = 1 + alike + (int(self._rows(x, y, 0, len(x), None)[-1][-1]) if x and y else 0)

    def _rows(self, x: tuple, y: tuple, start: int, end: int, above: np.ndarray | None, flags: np.ndarray | None = None) -> list[np.ndarray]:
        """The matching's table from row ``start`` to ``end``: every ``HELD_ROWS``-th row and the last; ``flags`` gets the way back."""
        kinds, at = np.unique(np.array(y), return_inverse=True)
        weights: dict[int, np.ndarray] = {}
        line = np.zeros(len(y) + 1, np.int64) if above is None else above
        kept = [line]
        for i in range(start, end):
            if x[i] not in weights:
                weights[x[i]] = np.array([self.score(x[i], int(k)) for k in kinds], np.int64)[at]
            new = np.zeros_like(line)
            np.maximum.accumulate(np.maximum(line[1:], line[:-1] + weights[x[i]]), out=new[1:])
            if flags is not None:
                flags[i - start] = (new[1:] == line[1:]) + 2 * (new[1:] == new[:-1]).astype(np.uint8)
            line = new
            if (i + 1 - start) % HELD_ROWS == 0 or i + 1 == end:
                kept.append(line)
        return kept

    def pairs(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of children that are matched, so that most nodes are."""
        first, last = self.middle(a, b)
        n, m = len(self.children[a]), len(self.children[b])
        found = [(i, i) for i in range(first)] + [(n - 1 - i, m - 1 - i) for i in range(last)]
        x, y = self.children[a][first : n - last], self.children[b][first : m - last]
        if x and y:
            kept = self._rows(x, y, 0, len(x), None)
            i, j = len(x), len(y)
            while i and j:
                start = (i - 1) // HELD_ROWS * HELD_ROWS
                flags = np.empty((i - start, len(y)), np.uint8)
                self._rows(x, y, start, i, kept[start // HELD_ROWS], flags)
                while i > start and j:
                    way = flags[i - 1 - start, j - 1]
                    if way & 1:
                        i -= 1
                    elif way & 2:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        found.append((first + i, first + j))
        return found


def align(page: Node, reference: Node) -> None:
    """Simple tree matching: number each node of the page after the reference node it is matched with, else 0.

    Like first and last children are matched as they are; what is between is compared by kinds of subtrees, so that equal ones
    are compared once, in a table of which only some rows are held.
    """
    if page.label != reference.label:
        return
    kinds = Kinds()
    top = kinds.add(page), kinds.add(reference)
    kinds.prepare(*top)
    todo, known = [(page, reference)], {}
    while todo:
        a, b = todo.pop()
        a.number = b.number
        pair = kinds.of[id(a)], kinds.of[id(b)]
        if pair not in known:
            known[pair] = kinds.pairs(*pair)
        todo += [(a.children[i], b.children[j]) for i, j in known[pair]]


def merge(reference: Node, page: Node) -> None:
    """Partial tree alignment: put the nodes of the page that ``reference`` lacks beside their matched neighbours."""
    nodes: list[Node] = []
    todo = [reference]
    while todo:
        node = todo.pop()
        node.number = len(nodes)
        nodes.append(node)
        todo += reversed(node.children)
    align(page, reference)
    both = [(page, reference)]
    while both:
        a, b = both.pop()
        children, at = [], 0
        for x in a.children:
            if x.number:
                y = nodes[x.number]
                upto = b.children.index(y, at) + 1
                children += b.children[at:upto]
                at = upto
                both.append((x, y))
            else:
                children.append(x)
        b.children = children + b.children[at:]


def numbers_of(layout: str, reference: Node) -> list[int]:
    """The reference node of each node of a layout, by its number; 0 for those without one."""
    page = read_skeleton(layout)
    nodes, todo = [], [page]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += reversed(node.children)
    for node in nodes:
        node.number = 0
    align(page, reference)
    return [n.number for n in nodes]


class Wrapper:
    """What a host's pages share: its reference tree, the texts constant in its slots, and doubtful slots that vary."""

    def __init__(self, reference: str = "", template: frozenset = frozenset(), varying: frozenset = frozenset()) -> None:
        self.reference, self.template, self.varying = read_skeleton(reference), template, varying
        self.known: dict[str, list[int]] = {}

    def numbers(self, layout: str) -> list[int]:
        if layout not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[layout] = numbers_of(layout, self.reference)
        return self.known[layout]

    def content(self, layout: str, blocks: list[dict]) -> str:
        """The content of a page from its layout and blocks."""
        at = self.numbers(layout) if self.template or self.varying else [0] * (1 + max((b["node"] for b in blocks), default=0))
        blocks = [b for b in blocks if not at[b["node"]] or (at[b["node"]], b["hash"]) not in self.template]
        doubtful = [b for b in blocks if b["doubt"] and at[b["node"]] not in self.varying]
        if doubtful:
            inside = any(b["inside"] for b in blocks)
            length = lambda found: sum(len(b["text"]) for b in found if b["inside"] or not inside)
            if 2 * length(doubtful) <= length(blocks):
                blocks = [b for b in blocks if not b["doubt"] or at[b["node"]] in self.varying]
        inside = any(b["inside"] for b in blocks)
        return "\n".join(b["text"] for b in blocks if b["inside"] or not inside)


def page_blocks(html: str | None) -> tuple[str, list[dict]]:
    """The layout of a page, and its blocks (node, inside, doubt, hash, text) outside boilerplate elements."""
    root, blocks = parse(html)
    layout = number_layout(root)
    return layout, [{"node": n.number, "inside": n.main, "doubt": n.doubt, "hash": _hash(t), "text": t} for n, t in blocks if not n.skipped]


def main_text(html: str | None, wrapper: Wrapper | None = None) -> str:
    """The content blocks of a page, given its host's wrapper."""
    return (wrapper or Wrapper()).content(*page_blocks(html))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


_BLOCKS = "array<struct<node: int, inside: boolean, doubt: boolean, hash: bigint, text: string>>"
_BLOCK = pa.struct([("node", pa.int32()), ("inside", pa.bool_()), ("doubt", pa.bool_()), ("hash", pa.int64()), ("text", pa.string())])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, layout, vote, blocks) of every page, kept; vote is the hash of its longest block."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [page_blocks(html) for html in b["html"]]
            longest = [max((x for x in blocks), key=lambda x: (x["inside"], len(x["text"])), default={"hash": None})["hash"] for _, blocks in found]
            yield {"page_id": b["page_id"], "url": b["url"], "host": b["host"], "layout": [x for x, _ in found], "vote": longest, "blocks": [x for _, x in found]}

    host = url_parts(F.col("url"))[0].alias("host")
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("layout", pa.string()), ("vote", pa.int64()), ("blocks", pa.list_(_BLOCK))]
    schema = f"page_id long, url string, host string, layout string, vote long, blocks {_BLOCKS}"
    return keep(map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host, "html"), run, schema, pa.schema(kinds)), "parsed")


def induce(parsed: DataFrame) -> DataFrame:
    """(host, reference, template, varying) of ``parsed_pages``: template holds slots (node, hash), varying doubtful nodes."""
    votes = keep(parsed.groupBy("host").agg(F.countDistinct("vote").alias("votes"), F.count("*").alias("pages")).where(F.col("votes") >= FEWEST), "votes")
    counted = keep(parsed.where("layout <> ''").groupBy("host", "layout").agg(F.count("*").alias("n")), "layouts")
    commonest = Window.partitionBy("host").orderBy(F.desc("n"), "layout").rowsBetween(Window.unboundedPreceding, -1)
    wanted = counted.join(votes, "host").withColumn("before", F.coalesce(F.sum("n").over(commonest), F.lit(0)))
    wanted = wanted.where(F.col("before") <= F.col("pages") - F.ceil(CONSTANT * F.col("pages")))

    def merged(batches: Iterator[dict]) -> Iterator[dict]:
        now, tree = None, Node("", "", False, False)
        for b in batches:
            out: dict = {"host": [], "place": [], "reference": []}
            for key in zip(b["host"], b["group"], b["reference"], strict=True):
                if key[:2] != now:
                    if now is not None:
                        out["host"].append(now[0]), out["place"].append(now[1]), out["reference"].append(write_skeleton(tree))
                    now, tree = key[:2], Node("", "", False, False)
                merge(tree, unnumbered(key[2]))
            yield out
        if now is not None:
            yield {"host": [now[0]], "place": [now[1]], "reference": [write_skeleton(tree)]}

    # A host's layouts are merged in groups, then what became of the groups, and so on, so that many tasks share a host.
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "layout")) - 1
    reference = wanted.select("host", rank.cast("long").alias("place"), F.col("layout").alias("reference"))
    reference = keep(reference, "layouts")
    left = (reference.agg(F.max("place")).first()[0] or 0) + 1
    while True:
        grouped = reference.withColumn("group", F.floor(F.col("place") / MERGED).cast("long"))
        grouped = grouped.repartition("host", "group").sortWithinPartitions("host", "group", "place").select("host", "group", "reference")
        kinds = pa.schema([("host", pa.string()), ("place", pa.int64()), ("reference", pa.string())])
        reference = keep(map_rows(grouped, merged, "host string, place long, reference string", kinds), "reference")
        left = -(-left // MERGED)
        if left <= 1:
            break
    reference = reference.select("host", "reference")

    def slots(batches: Iterator[dict]) -> Iterator[dict]:
        known: dict[str, Wrapper] = {}
        for b in batches:
            out: dict = {"host": [], "node": [], "hash": [], "doubt": [], "vote": []}
            for h, ref, layout, vote, nodes, hashes, doubts in zip(*(b[c] for c in ("host", "reference", "layout", "vote", "nodes", "hashes", "doubts")), strict=True):
                if h not in known:
                    if len(known) > 100:
                        known.clear()
                    known[h] = Wrapper(ref)
                at = known[h].numbers(layout)
                for node, code, doubt in {(at[n], x, d) for n, x, d in zip(nodes, hashes, doubts, strict=True) if at[n]}:
                    for c, v in (("host", h), ("node", node), ("hash", code), ("doubt", doubt), ("vote", vote)):
                        out[c].append(v)
            yield out

    fields = [("host", pa.string()), ("node", pa.int32()), ("hash", pa.int64()), ("doubt", pa.bool_()), ("vote", pa.int64())]
    asked = parsed.where("layout <> ''").join(reference, "host")
    asked = asked.select("host", "reference", "layout", "vote", F.col("blocks.node").alias("nodes"), F.col("blocks.hash").alias("hashes"), F.col("blocks.doubt").alias("doubts"))
    seen = map_rows(asked, slots, "host string, node int, hash long, doubt boolean, vote long", pa.schema(fields)).distinct()
    counted = keep(seen.groupBy("host", "node", "hash").agg(F.count("*").alias("n"), F.max("doubt").alias("doubt")), "slots")
    constant = counted.join(votes, "host").where(F.col("n") + 1 >= CONSTANT * (F.col("votes") + 2))
    constant = constant.groupBy("host").agg(F.collect_list(F.struct("node", "hash")).alias("template"))
    doubted = counted.where("doubt").groupBy("host", "node").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    # Of v texts with at most half of the votes each none is the slot's own.
    varying = doubted.where((F.col("all") >= FEWEST) & (2 * (F.col("most") + 1) <= F.col("all") + 2)).groupBy("host").agg(F.collect_list("node").alias("varying"))
    return keep(reference.join(constant, "host", "left").join(varying, "host", "left").where("template IS NOT NULL OR varying IS NOT NULL"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    parsed = parsed_pages(pages)
    wrappers = induce(parsed)

    def texts(batches: Iterator[dict]) -> Iterator[dict]:
        known: dict[str, Wrapper] = {}
        for b in batches:
            out = []
            for h, ref, slots, varying, layout, blocks in zip(*(b[c] for c in ("host", "reference", "template", "varying", "layout", "blocks")), strict=True):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = Wrapper(ref or "", frozenset((s["node"], s["hash"]) for s in slots or ()), frozenset(varying or ()))
                out.append(known[h].content(layout, blocks))
            yield {"page_id": b["page_id"], "url": b["url"], "text": out}

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    return map_rows(parsed.join(wrappers, "host", "left"), texts, "page_id long, url string, text string", kinds)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_extract": op6_html_extract}
SQL: dict[str, str] = {}
