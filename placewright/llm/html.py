"""Main text of web pages by removal of site templates.

A page is parsed to a tree. Every element subtree is hashed bottom-up from its tag, attributes, text and children, and has a place:
the tags and classes from the root down to it. Spark counts, for each host, on how many pages each subtree occurs at its place, and
for each place how many pages have one there that recurs. What is template goes wherever it occurs:

* Around the main part, a subtree that recurs on ``LEAST_PAGES`` pages; and all subtrees of a place that ``MANY`` pages or more have
  and where at least ``SHARE`` of them recur: a menu or notice slot, whatever stands in it today.
* In an ``article`` or ``main`` element, a recurring subtree without paragraphs, headings, quotes, code or text outside of links, so a
  repeated article keeps its words, lists and tables.
* In a page without these, the main part is the smallest element that holds half the page's text; of it, what is in it and what holds it
  only subtrees on half of the host's pages go, copies of a page counted once.

An element whose text is all in one child is not counted apart from it.

Two things counts cannot show. Elements and roles that HTML itself sets apart from the content (``ASIDE``) and reader comments, which
differ by page, always go. At places that fewer than ``MANY`` pages of a host have, class and id names of menus, notices, adverts and
the like (``UNWANTED``) stand in for counts; on larger hosts names decide nothing there. Inside an article only names of adverts,
sharing and sign-up boxes count.

On hosts whose places counts can judge, the text is all that is left; on others it is that of the articles, else of a main element, if
the page has any. Character references are decoded, white space
in a block becomes one space, and non-empty blocks are joined in page order by an empty line.

Pages are written once in packed blocks; verdicts meet them by block, so no host's list is held anywhere, and a host's counts are
partial sums by subtree. Null, empty or text-less html gives an empty text. Repeated rows count as pages each. A null or hostless url
is a host of its own name ''. Other columns pass through. Parsing takes time in proportion to the html.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.llm.common import blocks, cut, numbers, unpacked

LEAST_PAGES, MANY, SHARE, MAIN_SHARE = 5, 40, 0.1, 0.5
BLOCK, LEVEL = 4 << 20, 5
# HTML elements by their role.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
TEXTLESS = frozenset("head script style noscript template button select textarea iframe object svg canvas title xmp noembed noframes audio video map".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
NEVER = TEXTLESS | ASIDE
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption address".split()) | INLINE
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_names = lambda words: re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)
COMMENTS = _names(r"comments?|comment-?list|replies|reply|disqus|respond")
IN_ARTICLE = _names(r"ads?|advert\w*|adsense|sponsor\w*|share|sharing|newsletter|subscri\w*|signup")
UNWANTED = _names(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|aside|footer|foot|toolbar|share|sharing|social|related|recommend\w*|pagination|pager|search|widget|skip|copyright|legal|header|head|masthead|topbar")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\s\u00a0]+")
#: Zones of a page: around its main part, in the part that holds most of its text, in an article or main element; and the page itself.
AROUND, BULK, ARTICLE, PAGE = 0, 1, 2, 3


class Node:
    __slots__ = ("tag", "attrs", "kids", "mark", "in_article", "prose", "words", "size", "place", "zone", "named")

    def __init__(self, tag: str, attrs: str, in_article: bool):
        self.tag, self.attrs, self.kids, self.mark, self.in_article, self.prose, self.words, self.size, self.place, self.zone = tag, attrs, [], 0, in_article, False, False, 0, 0, AROUND
        self.named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}


class Reader:
    """Tags of a source from left to right; no character is looked at more than a few times."""

    def __init__(self, source: str):
        self.source, self.gone = source, set()

    def find(self, what: str, at: int) -> int:
        """Like ``str.find``, but what isn't found once is never sought again."""
        if what in self.gone:
            return -1
        k = self.source.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def end_of_tag(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, which quotes may hide; -1 without one."""
        k = at
        while m := _STOP.search(self.source, k) if ">" not in self.gone else None:
            if m[0] == ">":
                return m.start()
            close = self.find(m[0], m.end())
            k = close + 1 if close >= 0 else m.end()
        self.gone.add(">")
        return -1


def parse(source: str) -> Node:
    """A tree of nodes and strings; forgiving about unclosed and stray tags."""
    root, reader, at, n = Node("#root", "", False), Reader(source), 0, len(source)
    stack, open_ = [root], {}  # open_: places in the stack of each tag

    def push(node: Node) -> None:
        open_.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def pop_to(i: int) -> None:
        while len(stack) > i:
            open_[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    blocks_open = [0]  # places of elements that are not inline, for the p that a block element ends

    while at < n:
        k = reader.find("<", at)
        if k < 0:
            stack[-1].kids.append(source[at:])
            break
        if k > at:
            stack[-1].kids.append(source[at:k])
        if source.startswith("<!--", k):
            end = reader.find("-->", k + 4)
            at = end + 3 if end >= 0 else n
            continue
        if source[k + 1 : k + 2] in ("!", "?"):
            end = reader.find(">", k + 2)
            at = end + 1 if end >= 0 else n
            continue
        closing = source.startswith("/", k + 1)
        m = _NAME.match(source, k + 1 + closing)
        end = reader.end_of_tag(m.end()) if m else -1
        if end < 0:  # no tag: a character of the text
            stack[-1].kids.append("<")
            at = k + 1
            continue
        tag, at = m[0].lower(), end + 1
        if closing:
            if open_.get(tag):
                pop_to(open_[tag][-1])
            continue
        if tag in CLOSES_P and open_.get("p"):
            while blocks_open[-1] >= len(stack):
                blocks_open.pop()
            if open_["p"][-1] >= blocks_open[-1]:  # nothing but inline elements since
                pop_to(open_["p"][-1])
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            i = last(same.split())
            if i > last(stop):
                pop_to(i)
        attrs = source[m.end() : end]
        node = Node(tag, attrs, stack[-1].in_article or tag in ("article", "main"))
        stack[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}\\s*>", re.I).search(source, at) if tag not in reader.gone else None
            if not close:
                reader.gone.add(tag)
            node.kids.append(source[at : close.start() if close else n])
            at = close.end() if close else n
            continue
        if tag not in INLINE:
            while blocks_open[-1] >= len(stack):
                blocks_open.pop()
            blocks_open.append(len(stack))
        push(node)
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents first; no recursion, so depth doesn't matter."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    return out


def hash_subtrees(root: Node) -> list[Node]:
    """Sets ``mark``, ``size``, ``place`` and ``zone`` of every node; gives the subtrees that may be template."""
    nodes = walk(root)
    for node in reversed(nodes):
        h = xxhash.xxh3_64(f"<{node.tag} {node.attrs.strip()}>")
        node.prose = node.tag in PROSE or any(k.prose for k in node.kids if isinstance(k, Node))
        node.words = node.in_article and node.tag != "a" and node.tag not in NEVER and any(k.words if isinstance(k, Node) else worded(k) for k in node.kids)
        for k in node.kids:
            if isinstance(k, Node):
                h.update(k.mark.to_bytes(8, "little"))
                node.size += k.size
            else:
                text = _SPACE.sub(" ", k).strip()
                h.update(text.encode("utf-8", "surrogatepass"))
                node.size += len(text) if node.tag not in TEXTLESS else 0
        node.mark = h.intdigest()
    has = any(x.tag in ("article", "main") for x in nodes)
    bulk, half = root, MAIN_SHARE * root.size
    while not has and (inner := next((k for k in bulk.kids if isinstance(k, Node) and k.size >= half and k.size), None)):
        bulk = inner
    around: set[int] = set()  # elements that hold the main part
    for node in nodes:
        for k in node.kids:
            if isinstance(k, Node):
                k.place = xxhash.xxh3_64_intdigest(f"{node.place} {k.tag} {k.named.get('class', '')}")
                k.zone = ARTICLE if k.in_article else BULK if not has and (node.zone == BULK or node is bulk and bulk is not root) else AROUND
    if has:
        for node in reversed(nodes):
            if node.tag in ("article", "main") or any(id(k) in around for k in node.kids if isinstance(k, Node)):
                around.add(id(node))
    else:
        node = root
        while node is not bulk:
            node = next(k for k in node.kids if isinstance(k, Node) and k.size >= half)
            node.zone = BULK
    inner = lambda x: any(isinstance(k, Node) and k.size == x.size and removable(k) for k in x.kids)  # noqa: E731  one child holds all its text and stands for it
    return [x for x in nodes if x.kids and x.size and id(x) not in around and (x.zone != BULK or x.size < root.size) and removable(x) and not inner(x)]


def worded(text: str) -> bool:
    return not (text.isspace() or not text) and ("&" not in text or bool(entities.unescape(text).strip()))


def removable(x: Node) -> bool:
    """Whether a recurring subtree may go: in an article only what holds no prose and no text but that of links."""
    return x.tag not in ("#root", "html", "body", "head", "article", "main") and not (x.in_article and (x.prose or x.words or x.tag in TEXTUAL))


def key_of(x: Node) -> int:
    """A subtree at its place, as a signed number."""
    h = xxhash.xxh3_64_intdigest(f"{x.place} {x.mark}")
    return h - (1 << 64) if h >> 63 else h


def place_of(x: Node) -> int:
    """A place as a signed number, with its zone in the two lowest bits."""
    h = x.place & ~3 | x.zone
    return h - (1 << 64) if h >> 63 else h


def unwanted(node: Node, counted: bool) -> bool:
    """By markup. ``counted``: enough pages of the host have this place for counts to judge it."""
    if node.tag in NEVER or node.tag == "header" and not node.in_article:
        return True
    a = node.named
    if not a or node.tag in ("html", "body", "article", "main"):
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    names = [a[k] for k in ("class", "id") if k in a]
    by = [COMMENTS] + [IN_ARTICLE] * node.in_article + [UNWANTED] * (not node.in_article and not counted)
    return any(p.search(x) for p in by for x in names)


def main_text(source: str | None, template: frozenset[int] = frozenset(), counted: frozenset[int] = frozenset()) -> str:
    """Text of a page, of whose subtrees those of the keys ``template`` go; ``counted`` are keys at places that counts can judge."""
    root = parse(source or "")
    may_go = {id(x) for x in hash_subtrees(root)} if template or counted else set()
    gone: set[int] = set()
    tops, mains, todo = [], [], [(root, False, False)]
    while todo:
        node, in_article, in_main = todo.pop()
        if node is not root and (id(node) in may_go and key_of(node) in template or unwanted(node, key_of(node) in counted)):
            gone.add(id(node))
            continue
        if node.tag == "article" and not in_article:
            tops.append(node)
        if node.tag == "main" and not in_main:
            mains.append(node)
        state = in_article or node.tag == "article", in_main or node.tag == "main"
        todo += [(k, *state) for k in reversed(node.kids) if isinstance(k, Node)]
    blocks_: list[str] = []
    for top in [root] if counted else tops or mains or [root]:
        blocks_ += _blocks(top, gone)
    return "\n\n".join(blocks_)


def _blocks(top: Node, gone: set[int]) -> list[str]:
    out, now = [], []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(now))).strip()
        if text:
            out.append(text)
        now.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif id(x) not in gone:
            if x.tag == "br":
                now.append(" ")
            block = x.tag not in INLINE
            if block:
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def candidates(packed: DataFrame) -> DataFrame:
    """block, page (row in its block), host, place, key, whole (in a page's main bulk the page's mark) of every subtree that may be template; and of every page a row of place ``PAGE``."""

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                t = unpacked(body)
                out: list[tuple] = []
                for page, (url, source) in enumerate(zip(t.column("url").to_pylist(), t.column("html").to_pylist())):
                    host, root = host_of(url), parse(source or "")
                    own = hash_subtrees(root)
                    whole = key_of(root)
                    out += [(block, page, host, PAGE, 0, whole), *{(block, page, host, place_of(x), key_of(x), whole if x.zone == BULK else 0) for x in own}]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["block", "page", "host", "place", "key", "whole"])

    return packed.select("block", "body").mapInArrow(run, "block long, page int, host string, place long, key long, whole long")


def templates(found: DataFrame) -> DataFrame:
    """host, key, gone (template or not) of subtrees that are template or at places that counts can judge."""
    copies = found.groupBy("host", "place", "key", "whole").agg(F.count("*").alias("n"))
    each = copies.groupBy("host", "place", "key").agg(F.sum("n").alias("n"), F.count("*").alias("unlike"))
    sizes = each.where(F.col("place") == PAGE).select("host", F.col("unlike").alias("pages"))
    each = each.where(F.col("place") != PAGE)
    places = each.groupBy("host", "place").agg(F.sum("n").alias("had"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"))
    rows, zone = each.join(places, ["host", "place"]).join(sizes, "host"), F.col("place").bitwiseAND(F.lit(3))
    often, slot = F.col("n") >= LEAST_PAGES, (zone == AROUND) & (F.col("had") >= MANY)
    gone = F.when(zone == BULK, (F.col("unlike") >= LEAST_PAGES) & (F.col("unlike") >= MAIN_SHARE * F.col("pages"))).otherwise(often | slot & (F.col("again") >= SHARE * F.col("had")))
    return rows.select("host", "key", gone.alias("gone"), slot.alias("slot")).where("gone OR slot")


def extract(pages: DataFrame, most: int = BLOCK) -> DataFrame:
    """``pages`` (with url and html) and ``text``, ``n_chars``, ``n_template`` (subtrees of templates found); html itself is kept."""
    names = [c for c in pages.columns if c not in ("text", "n_chars", "n_template")]
    packed = blocks(pages.select(*names), "html", most, LEVEL)  # written and shuffled: most of what is on disk
    found = cut(candidates(packed))
    judged = found.where(F.col("place") != PAGE).join(cut(templates(found)), ["host", "key"]).select("block", "page", "key", "gone", "slot")
    schema = T.StructType([pages.schema[c] for c in names] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_template", T.LongType())])

    def run(rows: pa.Table, judged: pa.Table) -> pa.Table:
        t, gone, counted = unpacked(rows.column("body")[0]), {}, {}
        for page, key, out, slot in zip(*(numbers(judged, c).tolist() for c in ("page", "key", "gone", "slot"))):
            if out:
                gone.setdefault(page, set()).add(key)
            if slot:
                counted.setdefault(page, set()).add(key)
        texts = [main_text(h, frozenset(gone.get(i, ())), frozenset(counted.get(i, ()))) for i, h in enumerate(t.column("html").to_pylist())]
        return pa.table([t.column(c) for c in names] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(gone.get(i, ())) for i in range(len(texts))], pa.int64())], [*names, "text", "n_chars", "n_template"])

    return packed.select("block", "body").groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "n_template")
