"""Main text of web pages by wrapper induction over the pages of each host.

DOM trees of same-host pages are aligned by simple tree matching into one wrapper tree a host. A wrapper node counts
the pages that have it and that fill it, keeps the least and greatest hash of their texts, and sums up characters in all
and in links: a node whose text is one and the same on all of at least three pages is template, the others are slots.

A page's main part is found in the wrapper: from the root down to the container that holds most of what varies from page
to page and is not in links, as long as there is one; its slots, and headings beside the way, are the text. What authors
mark helps: parts that call themselves menus, adverts, comments and the like have no weight, and an article's text
counts though pages share it, since articles have copies.

Every task grows the wrappers of the hosts it meets from whole pages; wrappers of one host, at most one a task, are
merged by the same matching one after the other, first by salted host and then by host. Pages of equal shape share one
alignment.
"""

from __future__ import annotations

import html
import json
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import batches
from .shared import fresh, small_batches, stored

#: What HTML elements and common class names mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CHROME = set(
    "head nav footer aside form script style noscript template iframe svg button select textarea menu dialog object canvas audio video map "
    "frameset math datalist title".split()
)
CHROME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsors sponsored promo promos promotion sidebar sidebars "
    "sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentary respond reply replies disqus cookie "
    "cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription share sharing social related recommended "
    "recommendations widget widgets pagination pager toolbar login signup search hidden skip alert copyright".split()
)
CHROME_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTENT_WORDS = set("article entry post story content".split())
CONTAINERS = set("address article body center dd details div dl fieldset figure form header hgroup html main ol section table tbody td tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}

LEAST_SHARE = 0.6  # of a container's weight that one inner container must have to be the main part
MARKED = 4  # by how much an article outweighs other containers
RUN = 8  # longer runs of like containers are records of a list, and fold like paragraphs

#: Elements nested deeper are taken as neighbours, so that no page exhausts the stack.
DEEPEST = 150

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Link(str):
    """A piece of text inside a link."""

    __slots__ = ()


class Node:
    """A block element; ``kids`` holds nodes and pieces of text in order."""

    __slots__ = ("tag", "label", "kids", "up", "depth", "chrome", "article")

    def __init__(self, tag: str, attributes: str, up: Node | None):
        self.tag, self.kids, self.up = tag, [], up
        self.depth = up.depth + 1 if up else 0
        self.article = bool(up and up.article)
        self.chrome = tag in CHROME
        self.label = tag
        if attributes and ("=" in attributes or "hidden" in attributes):
            self._read(attributes)
        if tag == "header" and not self.article:
            self.chrome = True
        if tag in ("article", "main") and not self.chrome:
            self.article = True
        if up and up.chrome:
            self.chrome = True

    def _read(self, attributes: str) -> None:
        names: list[str] = []
        whole: set[str] = set()  # words of names that say nothing else
        own = self.tag == "article"
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                for name in value.split():
                    said = [w.lower() for w in _WORD.findall(name)]
                    names += said
                    if said and said[-1] in CHROME_WORDS and CHROME_WORDS.union(CONTENT_WORDS).issuperset(said):
                        whole |= CHROME_WORDS.intersection(said)
            elif key == "role":
                self.chrome |= value.lower() in CHROME_ROLES
                own |= value.lower() in ("main", "article")
            elif key == "itemprop":
                own |= value == "articleBody"
            elif key == "style":
                self.chrome |= "display:none" in value.replace(" ", "").lower()
            elif key == "aria-hidden":
                self.chrome |= value.lower() == "true"
            elif key == "hidden":
                self.chrome = True
        self.article |= own
        # beside words of content only a whole name tells: "sidebar" or "post-footer", but not "with-sidebar"
        found = whole if own or CONTENT_WORDS.intersection(names) else CHROME_WORDS.intersection(names)
        if found and (found - {"header"} or not (self.article or CONTENT_WORDS.intersection(names))):
            self.chrome |= self.tag not in ("html", "body", "main")
        self.label = ".".join([self.tag, *sorted(set(names))])


def parse(page: str) -> Node:
    """The tree of block elements; inline elements dissolve into text. Markup without an end is closed where it must be."""
    root = node = Node("#root", "", None)
    at, size, skip, linked = 0, len(page), 0, False
    for m in _TOKEN.finditer(page):
        start = m.start()
        if start < skip:
            continue
        if start > at:
            node.kids.append(Link(page[at:start]) if linked else page[at:start])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if tag == "a" or tag in BLOCK:
            linked = tag == "a" and not m.group(1)
        if not m.group(1):
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = skip = end.end() if end else size
            elif tag == "br" or tag == "wbr":
                node.kids.append(" " if tag == "br" else "")
            elif tag in BLOCK or tag in CHROME:
                if tag in BLOCK:
                    node = _close_for(node, tag)
                fresh = Node(tag, m.group(3), node)
                node.kids.append(fresh)
                if tag not in VOID and not m.group(3).endswith("/") and fresh.depth < DEEPEST + 100 * fresh.chrome:
                    node = fresh
            elif m.group(3) and ("class" in m.group(3) or "role" in m.group(3) or "hidden" in m.group(3)):
                fresh = Node(tag, m.group(3), node)  # an inline element that may say what it is
                if fresh.chrome and tag not in VOID and fresh.depth < DEEPEST + 100:
                    node.kids.append(fresh)
                    node = fresh
        elif tag in BLOCK or tag in CHROME or node.tag == tag:
            open_ = node
            while open_ is not None and open_.tag != tag:
                open_ = open_.up
            if open_ is not None and open_.up is not None:
                node = open_.up
            elif tag == "p":
                node.kids.append(Node("p", "", node))  # a stray end makes an empty paragraph
    if at < size:
        node.kids.append(page[at:])
    return root


def _close_for(node: Node, tag: str) -> Node:
    """Ends the elements that the start of ``tag`` ends: a paragraph, and a sibling of its own kind."""
    if node.tag == "p":
        node = node.up
    if tag in ("li", "dt", "dd", "tr", "td", "th", "option", "body"):
        same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "body": ("head",)}.get(tag, (tag,))
        while node.tag in same:
            node = node.up
    elif node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        node = node.up
    return node


def blocks(node: Node, out: list[tuple[Node, str, int]] | None = None) -> list[tuple[Node, str, int]]:
    """Texts of blocks in page order, each with its node and how much of it is in links: references decoded, white space made one space, trimmed."""
    if out is None:
        out = []
    held: list[str] = []
    for kid in node.kids:
        if isinstance(kid, str):
            held.append(kid)
        elif kid.tag in BLOCK or not kid.chrome:
            if held:
                _flush(node, held, out)
            blocks(kid, out)
        # an inline part of the page's furniture leaves the block whole
    if held:
        _flush(node, held, out)
    return out


def _flush(node: Node, held: list[str], out: list[tuple[Node, str, int]]) -> None:
    text, linked = "".join(held), sum(len(x) for x in held if type(x) is Link)
    held.clear()
    text = " ".join((html.unescape(text) if "&" in text else text).split())
    if text:
        out.append((node, text, min(linked, len(text))))


class Shape:
    """A node of a wrapper: runs of like siblings are folded into one."""

    __slots__ = ("label", "kids", "seen", "pages", "low", "high", "chars", "links")

    def __init__(self, label: str, kids: list[Shape] | None = None):
        self.label, self.kids = label, kids or []
        self.seen = self.pages = self.chars = self.links = 0
        self.low = self.high = ""

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]

    def note(self, digest: str) -> None:
        """One page fills this node with a text of this digest."""
        self.low = min(self.low, digest) if self.pages else digest
        self.high = max(self.high, digest) if self.pages else digest
        self.pages += 1

    def template(self, least: int = 3) -> bool:
        return self.pages >= least and self.low == self.high

    def packed(self) -> list:
        return [self.label, self.seen, self.pages, self.low, self.high, self.chars, self.links, [k.packed() for k in self.kids]]

    @classmethod
    def unpacked(cls, x: list) -> Shape:
        out = cls(x[0], [cls.unpacked(k) for k in x[7]])
        out.seen, out.pages, out.low, out.high, out.chars, out.links = x[1:7]
        return out

    def weight(self, marked: bool = False) -> float:
        """Characters that a page has below here and that are in slots, outside links; ``marked``: inside an article all count."""
        return self._sum(marked) / max(self.seen, 1)

    def _sum(self, marked: bool) -> int:
        marked = marked or self.tag in ("article", "main")
        own = self.chars - self.links if marked or not self.template() else 0
        return own + sum(k._sum(marked) for k in self.kids)

    def linked(self) -> bool:
        """Whether most of what stands below here is in links."""
        chars, links = self._totals()
        return 2 * links > chars

    def _totals(self) -> tuple[int, int]:
        inner = [k._totals() for k in self.kids]
        return self.chars + sum(x[0] for x in inner), self.links + sum(x[1] for x in inner)

    def preorder(self) -> list[Shape]:
        out = [self]
        for k in self.kids:
            out += k.preorder()
        return out


def folded(nodes: list[Node], label: str) -> tuple[Shape, list[list[Node]]]:
    """The shape of sibling nodes taken together, and the nodes behind each of its nodes in preorder.

    Their children fold by label, but for containers, which stay apart unless one node has more than RUN of a label.
    """
    shape = Shape(label)
    members = [nodes]
    groups: dict[tuple, list[Node]] = {}
    for n in nodes:
        kids = [k for k in n.kids if not isinstance(k, str)]
        counts: dict[str, int] = {}
        for k in kids:
            counts[k.label] = counts.get(k.label, 0) + 1
        met: dict[str, int] = {}
        for k in kids:
            apart = k.tag in CONTAINERS and k.tag != "article" and counts[k.label] <= RUN
            met[k.label] = met.get(k.label, -1) + 1
            groups.setdefault((k.label, met[k.label] if apart else 0), []).append(k)
    for (name, _), same in groups.items():
        sub, inner = folded(same, name)
        shape.kids.append(sub)
        members += inner
    return shape, members


def match(a: Shape, b: Shape, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest order-keeping match of two trees, and the matched children of the roots."""
    if a.label != b.label:
        return 0, []
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    n, m = len(a.kids), len(b.kids)
    gain = [[match(x, y, memo)[0] for y in b.kids] for x in a.kids]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + gain[i - 1][j - 1])
    pairs, i, j = [], n, m
    while i and j:
        if gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    memo[key] = best[n][m] + 1, pairs[::-1]
    return memo[key]


def align(wrapper: Shape, tree: Shape, grow: bool, memo: dict | None = None) -> list[Shape | None]:
    """The wrapper's node for each node of ``tree`` in preorder; what has none is added if ``grow``, else gets None."""
    memo = {} if memo is None else memo
    pairs = {j: wrapper.kids[i] for i, j in match(wrapper, tree, memo)[1]}
    out: list[Shape | None] = [wrapper]
    before: Shape | None = None
    for j, kid in enumerate(tree.kids):
        found = pairs.get(j)
        if found is None and grow:
            found = Shape(kid.label)
            wrapper.kids.insert(wrapper.kids.index(before) + 1 if before is not None else 0, found)
        if found is None:
            out += [None] * len(kid.preorder())
            continue
        before = found
        out += align(found, kid, grow, memo)
    return out


def merge(a: Shape, b: Shape) -> Shape:
    """Two wrappers of one host as one."""
    for own, other in zip(align(a, b, True), b.preorder(), strict=True):
        if other.pages:
            own.low = min(own.low, other.low) if own.pages else other.low
            own.high = max(own.high, other.high) if own.pages else other.high
        own.seen, own.pages, own.chars, own.links = (getattr(own, x) + getattr(other, x) for x in ("seen", "pages", "chars", "links"))
    return a


class Wrapper:
    """A host's wrapper tree, with the alignments of the page shapes it has met."""

    def __init__(self, tree: Shape | None = None):
        self.tree = tree or Shape("#root")
        self.known: dict[tuple, list[Shape | None]] = {}
        self.told: dict = {}  # of wrapper nodes, while pages are extracted

    def _weight(self, shape: Shape, marked: bool) -> float:
        key = (id(shape), marked)
        if key not in self.told:
            self.told[key] = shape.weight(marked)
        return self.told[key]

    def _linked(self, shape: Shape) -> bool:
        if id(shape) not in self.told:
            self.told[id(shape)] = shape.linked()
        return self.told[id(shape)]

    def places(self, root: Node, grow: bool) -> tuple[list[Shape | None], list[list[Node]]]:
        shape, members = folded([root], root.label)
        key = _key(shape)
        if key not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            self.known[key] = align(self.tree, shape, grow)
        return self.known[key], members

    def learn(self, root: Node) -> None:
        own: dict[int, list[tuple[str, int]]] = {}
        whole = []
        for node, text, linked in blocks(root):
            own.setdefault(id(node), []).append((text, linked))
            whole.append(text)
        places, members = self.places(root, True)
        for place, nodes in zip(places, members, strict=True):
            place.seen += 1
            held = [(n, *x) for n in nodes for x in own.get(id(n), ())]
            texts = whole if nodes[0] is root else [t for _, t, _ in held]
            if texts:
                place.note(blake2b("\n".join(texts).encode(), digest_size=8).hexdigest())
            place.chars += sum(len(t) for n, t, _ in held if not n.chrome)
            place.links += sum(x for n, _, x in held if not n.chrome)

    def extract(self, root: Node) -> str:
        """The slots of the page's main part, in page order, and headings beside the way to it.

        A host whose pages all have one text tells nothing, so nothing is template there.
        """
        places, members = self.places(root, False)
        shape_of = {id(n): place for place, nodes in zip(places, members, strict=True) for n in nodes}
        plain = self.tree.template()
        way, inside = self._main(root, shape_of, plain)
        out = []
        for node, text, _ in blocks(root):
            if not node.chrome and (id(node) in inside or node.tag in HEADINGS and id(node.up) in way) and (plain or self._content(node, shape_of)):
                out.append(text)
        return "\n".join(out)

    def _main(self, root: Node, shape_of: dict, plain: bool) -> tuple[set[int], set[int]]:
        """Nodes on the way to the main part, and all nodes in it. Nodes that one wrapper node stands for go together."""
        here, way, marked = [root], set(), False
        while True:
            kids: dict[int, list[Node]] = {}
            for n in here:
                for k in n.kids:
                    if not isinstance(k, str) and k.tag in CONTAINERS and not k.chrome and shape_of.get(id(k)) is not None:
                        kids.setdefault(id(shape_of[id(k)]), []).append(k)
            own = shape_of.get(id(here[0]))
            if own is None or not kids or marked:
                break
            weights = {}
            for place, nodes in kids.items():
                shape = shape_of[id(nodes[0])]
                heavy = plain or any(n.article for n in nodes)
                weights[place] = (self._weight(shape, heavy) * (MARKED if heavy and not plain else 1), len(weights))
            best = max(weights, key=lambda x: (weights[x][0], -weights[x][1]))
            chosen = [x for x in weights if any(n.article for n in kids[x]) and weights[x][0]] if any(n.article for n in kids[best]) else [best]
            total = max(self._weight(own, plain), sum(w for w, _ in weights.values()))
            if not weights[best][0] or sum(weights[x][0] for x in chosen) < LEAST_SHARE * total:
                break
            way.update(id(n) for n in here)
            here = [n for x in chosen for n in kids[x]]
            marked = all(n.article for n in here)
        inside: set[int] = set()
        open_ = list(here)
        while open_:
            n = open_.pop()
            inside.add(id(n))
            open_ += [k for k in n.kids if not isinstance(k, str)]
        return way, inside

    def _content(self, node: Node, shape_of: dict) -> bool:
        """Whether a block is in a slot: an article's always are; elsewhere neither template nor in a list of links."""
        if node.article:
            return True
        place = shape_of.get(id(node))
        if place is not None and place.template():
            return False
        while node is not None:
            place = shape_of.get(id(node))
            if place is not None and node.tag in ("ul", "ol", "table", "div", "section") and self._linked(place):
                return False
            node = node.up
        return True


def _key(shape: Shape) -> tuple:
    return (shape.label, *(_key(k) for k in shape.kids))


def host_of(url_col: str) -> Column:
    """The host that a URL names, in lower case; empty if it names none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


BROADCAST_BYTES = 8 << 20
_WRAPPERS = "host string, salt int, wrapper string"
_ARROW = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])
SALTS = 64


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = SALTS) -> DataFrame:
    """(host, wrapper): the wrapper of every host, of all its pages with html."""

    def grow(frames):
        def out():
            held: dict[str, Wrapper] = {}
            part = None
            for batch in frames:
                for host, page, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if host not in held and len(held) >= 5000:
                        yield from emit(held, part)
                        held = {}
                    held.setdefault(host, Wrapper()).learn(parse(page))
            yield from emit(held, part)

        def emit(held, part):
            for host, w in held.items():
                yield {"host": host, "salt": part % salts, "wrapper": json.dumps(w.tree.packed())}

        yield from batches(out(), _ARROW)

    def merged(frames):
        """Rows come sorted by host and salt; one wrapper is held at a time."""

        def out():
            key, tree = None, None
            for batch in frames:
                for host, salt, wrapper in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    other = Shape.unpacked(json.loads(wrapper))
                    if (host, salt) == key:
                        tree = merge(tree, other)
                    else:
                        if key is not None:
                            yield {"host": key[0], "salt": 0, "wrapper": json.dumps(tree.packed())}
                        key, tree = (host, salt), other
            if key is not None:
                yield {"host": key[0], "salt": 0, "wrapper": json.dumps(tree.packed())}

        yield from batches(out(), _ARROW)

    grown = pages.where(F.col(html_col).isNotNull()).select(host_of(url_col).alias("host"), F.col(html_col).alias("html"), F.spark_partition_id().alias("part")).mapInArrow(grow, _WRAPPERS)
    for keys in (["host", "salt"], ["host"]):
        grown = grown.repartition(*keys).sortWithinPartitions("host", "salt").mapInArrow(merged, _WRAPPERS)
    return grown.select("host", "wrapper")


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all by default), ``text`` and ``n_chars`` of every page, one row a row.

    A null or empty html gives an empty text; a null url belongs to the host of empty name; hosts of one or two pages
    have no template, so there only marks, links and lengths tell; repeated rows each get a row; a column of ``pages`` that
    has the name of a result, in any case, is replaced; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    names = [c for c in (keep if keep is not None else pages.columns) if c.lower() not in ("text", "n_chars")]
    wrappers = stored(induce(pages, url_col, html_col), "wrappers")
    at_host, at_html, at_wrapper = fresh(names, "_host", "_html", "_wrapper")
    inputs = pages.select(*names, host_of(url_col).alias(at_host), F.col(html_col).alias(at_html))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields[:-2]), "text string", "n_chars long"])
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        held = pages.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in wrappers.collect()})
        source = inputs.withColumn(at_wrapper, F.lit(None).cast("string"))
    else:
        held = None
        given = wrappers.select(F.col("host").alias(at_host), F.col("wrapper").alias(at_wrapper))
        source = inputs.join(given, at_host, "left").select(*names, at_host, at_html, at_wrapper)

    def run(frames):
        ready: dict[str, Wrapper] = {}
        for batch in frames:
            out = []
            for host, page, given in zip(*(batch.column(len(names) + i).to_pylist() for i in range(3)), strict=True):
                if host not in ready:
                    if len(ready) > 5000:
                        ready.clear()
                    packed = held.value.get(host) if held else given
                    ready[host] = Wrapper(Shape.unpacked(json.loads(packed)) if packed else None)
                out.append(ready[host].extract(parse(page)) if page else "")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*names, "text", "n_chars"]
            )

    return source.mapInArrow(run, schema)
