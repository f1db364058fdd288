"""Main-text extraction by composite text density.

The page becomes a tree. Every node has characters C, tags T, and those inside links LC, LT. Its composite density is
link-adjusted characters per tag: C/T times the logarithm, to a base that grows with the
page's link share and the node's, of (C/LC) * (T/LT). Every node sums the densities of its children; the node with the
largest sum is the core, lifted from a paragraph or a part of one to the container around it. The smallest density on the path
from the core to the body is the threshold: beside the core, subtrees on the path that reach it, and headings, belong to the text.
An article (or a main element of several) around the core bounds the text instead, and belongs whole, with the articles beside it.

Before densities are computed, elements that never hold an article (navigation, footers, asides, forms, code, media) are cut, and so are
blocks whose class, id or role names such a thing: its head noun must be the name (``site-footer``, ``comments-section``, not
``share-price`` or ``header-story``), or a qualifier that makes anything so (``related-stories``); and sections whose first heading announces
reader comments. A block that is only named after a list of links (``menu``) goes if its own density says so: if links are half of its
text, or its texts are shorter than ``PROSE`` characters a tag. A named block that holds an h1, a main element or an article stays,
and if nothing else is left on a page all of them do.

Defined results: null or empty html gives empty text; tags end where browsers end them (a quote inside an unquoted value or a name does
not open a string); broken markup is repaired as browsers do for unclosed p, li, td, tr, option, dt and dd; a script or style that is never
closed runs to the end, any other element that is never closed keeps its text; formulas and ``xmp`` keep theirs, too;
repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; those beside CODE count as empty where they are never closed.
CODE = frozenset("script style".split())
RAW = CODE | frozenset("textarea title iframe noembed noframes xmp".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu head input label fieldset datalist noscript template svg object canvas video audio select".split()) | RAW - {"xmp"}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption xmp".split())
#: What an opening tag closes, up to the nearest of the elements after the bar.
CLOSES = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
FENCES = frozenset("table td th caption button object body html".split())
#: Names in class, id or role that mark other things than the article (fixed values).
NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsor banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar side aside widget widgets menu nav navbar navigation navigate breadcrumb breadcrumbs pager pagination header masthead topbar footer foot bottombar comment comments commentlist reply replies discussion disqus respond share sharing social login search toolbar toc complementary contentinfo feedback responses guestbook".split())
#: Those among them that name a list of links: their density decides.
LISTS = frozenset("menu nav navbar navigation navigate breadcrumb breadcrumbs pager pagination header masthead topbar bottombar share sharing social toolbar toc".split())
#: Characters a tag from which such a block is running text.
PROSE = 40
#: Qualifiers that make any noun such a thing, and nouns of containers that say nothing of their own (fixed values).
QUALIFIERS = frozenset("sponsored promo promoted promotion related recommended recommendations".split())
CONTAINERS = frozenset("area author bar block body box button buttons card cards collapse column container content contents element form frame group holder inner item items left link links list meta module outer panel region right row section slot text toggle top bottom unit wrap wrapper zone".split())
#: What holds a paragraph or a part of one.
LIFT = frozenset("article body center dd details div li main section summary table tbody td tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Noise of a block that is only named after a list of links: less than that of other names.
LINKS = 0.5

# a name runs to white space, a slash, > or =; a value is quoted, or runs to white space or >; nothing is tried twice
_attribute = r"""(?>[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?+)"""
_token = re.compile(rf"<!--(?:-?>|.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>{_attribute})*+)(?:>|\Z)", re.S)
_marks = re.compile(r"""(?:^|[\s/"'])(?:class|id|role)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)""", re.I)
_hidden = re.compile(r"""(?:^|[\s/"'])hidden(?:[\s=/]|$)|display\s*:\s*none""", re.I)
_closed = re.compile(r"""(?:^|[\s/"'])/$""")
_readers = re.compile(r"(?:\d+ |reader |readers['’]? |user |your |all |leave an? |write an? |add an? |post an? )*(?:comments?|repl(?:y|ies)|responses?)(?: \(?\d+\)?)?[:.!]?", re.I)
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_space = re.compile(r"\s+")


class Node:
    __slots__ = ("chars", "kids", "link_chars", "link_tags", "noise", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, noise: float):
        #: noise: 2 by its element, 1 by its name, LINKS by the name of a list, 0 not at all.
        self.tag, self.parent, self.noise = tag, parent, noise
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.sum = 0.0


def _head_noun(name: str) -> str | None:
    """What a class, id or role names, without the containers at its end; a qualifier that decides, where there is one."""
    parts = [p.lower() for p in _parts.findall(name)]
    if found := next((p for p in parts if p in QUALIFIERS), None):
        return found
    while parts and parts[-1] in CONTAINERS and any(p not in CONTAINERS for p in parts):
        parts.pop()
    return parts[-1] if parts else None


def is_noise_name(name: str) -> bool:
    """Whether a single class, id or role names something else than the article."""
    return (noun := _head_noun(name)) in NOISE or noun in QUALIFIERS


def _inside(node: Node | None, *tags: str) -> bool:
    while node:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _noise(tag: str, attributes: str, parent: Node) -> float:
    if tag in BOILERPLATE or tag == "header" and not _inside(parent, "article", "main"):  # an article's own header holds its title
        return 2
    if not attributes or tag in ("html", "body", "main"):
        return 0
    if _hidden.search(attributes):
        return 2
    names = [n for found in _marks.finditer(attributes) for n in found[1].strip("\"'").split()]
    named = [n for n in names if is_noise_name(n) and not (n.lower().endswith("header") and _inside(parent, "article", "main"))]
    return 0 if not named else LINKS if all(_head_noun(n) in LISTS for n in named) else 1


def parse(page: str) -> Node:
    """The body of the page as a tree of nodes and texts, with implied end tags."""
    root = now = Node("body", None, 0)
    depth: dict[str, int] = {}
    ends: dict[str, list[tuple[int, int]]] = {}  # of the end tags of raw elements: looked for once a name
    at = 0

    def close(node: Node) -> Node:
        depth[node.tag] -= 1
        return node.parent

    while True:
        found = _token.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            now.kids.append(entities.unescape(text))
        if not found:
            return root
        at = found.end()
        tag = found[2] and found[2].lower()
        if not tag or tag in ("html", "body"):
            if found[0].startswith("<![CDATA["):
                now.kids.append(found[0][9:].removesuffix("]]>"))
            continue
        if found[1]:
            if depth.get(tag):
                while now.tag != tag:
                    now = close(now)
                now = close(now)
            continue
        ended = {"p"} if tag in ENDS_P else set()
        fences: set | frozenset = FENCES
        if tag in CLOSES:
            ended, fences = CLOSES[tag]
        if any(depth.get(e) for e in ended):
            node, last = now, None
            while node is not root and node.tag not in fences:
                if node.tag in ended:
                    last = node
                    if tag not in CLOSES:
                        break
                node = node.parent
            if last is not None:
                while now is not last:
                    now = close(now)
                now = close(now)
        node = Node(tag, now, _noise(tag, found[3] or "", now))
        now.kids.append(node)
        closed = bool(_closed.search(found[3] or ""))
        if tag in RAW:
            if tag not in ends:
                ends[tag] = [m.span() for m in re.finditer(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", page, re.I)]
            i = bisect.bisect_left(ends[tag], (at, 0))
            end = ends[tag][i] if i < len(ends[tag]) and not (closed and tag not in CODE) else None
            if tag == "xmp" and end:
                node.kids.append(page[at : end[0]])
            at = end[1] if end else len(page) if tag in CODE else at
        elif tag not in VOID and not closed:
            now = node
            depth[tag] = depth.get(tag, 0) + 1


def _ordered(root: Node) -> list[Node]:
    found = [root]
    for node in found:
        found += [k for k in node.kids if isinstance(k, Node) and not k.noise]
    return found


def density(node: Node, body: Node) -> float:
    """Composite density: characters per tag, times a logarithm that falls with the share of links."""
    c, t = max(node.chars, 0), max(node.tags, 1)
    if not c:
        return 0.0
    lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
    plain = max(node.chars - node.link_chars, 1)
    base = math.log(c / plain * node.link_chars + body.link_chars / max(body.chars, 1) * c + math.e)
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log1p(base)  # 1 + base: defined, too, where a page has no links


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Texts of the blocks below, in page order; without recursion, so depth is no limit."""
    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            out.append([])
        elif isinstance(item, str):
            out[-1].append(item)
        elif item.tag == "br":
            out[-1].append(" ")
        elif not item.noise or item is node:
            if item.tag in BLOCKS:
                out.append([])
                stack.append(None)
            stack += reversed(item.kids)


def _prose(node: Node) -> bool:
    """Whether a block is running text: few links, and long texts between its tags."""
    chars = tags = links = 0
    stack: list = [(node, False)]
    while stack:
        item, linked = stack.pop()
        if isinstance(item, str):
            n = len(_space.sub(" ", item).strip())
            chars, links = chars + n, links + n * linked
        elif item is node or item.noise < 1:
            tags += 1
            stack += [(k, linked or item.tag == "a") for k in item.kids]
    return 2 * links < chars and chars >= PROSE * tags


def _text(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            stack += reversed(item.kids)
    return _space.sub(" ", "".join(out)).strip()


def _settle(body: Node) -> None:
    """Settles what names leave open: blocks that hold the page's article stay, lists that are prose do, and sections that announce reader comments go."""
    every = [body]
    for node in every:
        if node.tag in HEADINGS and not node.noise and node.tag != "h1" and node.parent.tag in ("section", "div", "ol", "ul") and next((k for k in node.parent.kids if isinstance(k, Node) or k.strip()), None) is node and _readers.fullmatch(_text(node)):
            node.parent.noise = 1
        every += [k for k in node.kids if isinstance(k, Node) and k.noise < 2]
    holds: set[int] = set()
    for node in reversed(every):
        if node.noise == LINKS:
            node.noise = 0 if _prose(node) else 1
        if node.tag in ("h1", "main") or node.tag == "article" and not node.noise or id(node) in holds:
            if node.tag != "article" or not node.noise:  # a comment may be an article of its own
                node.noise = 0
                holds.add(id(node.parent))


def _measure(body: Node) -> list[Node]:
    """Counts of every node that is not noise, parents before children."""
    nodes = _ordered(body)
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.sum = 0.0
    for node in reversed(nodes):
        node.chars += sum(len(_space.sub(" ", k).strip()) for k in node.kids if isinstance(k, str))
        node.tags += 1
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        if node.parent:
            up = node.parent
            up.chars, up.tags, up.link_chars, up.link_tags = up.chars + node.chars, up.tags + node.tags, up.link_chars + node.link_chars, up.link_tags + node.link_tags
    return nodes


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by two line feeds."""
    body = parse(page or "")
    _settle(body)
    nodes = _measure(body)
    if not body.chars:  # nothing but what names call noise: take it all
        every = [body]
        for node in every:
            node.noise = 0
            every += [k for k in node.kids if isinstance(k, Node) and k.noise < 2]
        nodes = _measure(body)
    if not body.chars:
        return ""
    held = {id(n): density(n, body) for n in nodes}
    for node in nodes[1:]:
        node.parent.sum += held[id(node)]
    core = max(nodes, key=lambda n: n.sum)
    while core.tag not in LIFT:
        core = core.parent
    path = [core]
    while path[-1].parent:
        path.append(path[-1].parent)
    articles = [n for n in path if n.tag == "article"]
    semantic = articles[-1] if articles else next((n for n in path if n.tag == "main"), None)
    blocks: list[list[str]] = [[]]
    if articles:
        for node in semantic.parent.kids:
            if node is semantic or isinstance(node, Node) and node.tag == "article" and not node.noise:  # the articles beside it, in page order
                _blocks(node, blocks)
    elif semantic:
        _blocks(semantic, blocks)
    else:
        threshold = min(held[id(n)] for n in path)
        on_path = {id(n) for n in path}
        stack = [body]
        while stack:
            node = stack.pop()
            if id(node) in on_path and node is not core:
                stack += reversed([k for k in node.kids if isinstance(k, Node) and not k.noise])
            elif node is core or node.tag in HEADINGS or held[id(node)] >= threshold:
                _blocks(node, blocks)
    texts = (_space.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=kind)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
