"""HTML extraction by minimum-cut labelling of text blocks.

A page is read into text blocks with the elements around them. A linear classifier on
block features gives each block two costs, that of calling it content and that of calling
it boilerplate. They are the terminal capacities of a graph whose further edges join
neighbouring blocks and consecutive blocks of one element, the stronger the nearer they
are in the page's tree. The minimum cut labels all blocks at once; those on the content
side are joined in page order. Blocks whose own costs outweigh all their edges are fixed
first, which does not change the cut; augmenting paths settle the rest.

Comments, scripts, styles, forms' controls and the head never make blocks. Character
references are decoded, white space in a block becomes one space. Null or empty html
gives the empty text. Each page is read whole and by itself; truncated markup is closed
at the end.
"""

from __future__ import annotations

import html as references
import re
from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame

from blotter.llm.common import map_batches
from blotter.llm.registry import query, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    # A quote counts right after "=" only, and if its end ends a value; groups never give back.
    r"|<(/?)([A-Za-z][^\s/<>]*)((?>=\s*+(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))|[^<>])*+)>|[^<]+|<",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.DOTALL
)
# Element names of the markup language.
SKIPPED = frozenset(
    "script style noscript template svg math iframe object select textarea button head title "
    "canvas audio video datalist".split()
)
#: Of these, elements that may hold others of their kind.
NESTED = frozenset("template svg math object".split())
#: Of these, elements whose content is no markup: unclosed, they run to the end of the page.
RAW = frozenset("script style noscript iframe textarea".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt "
    "rp s samp small span strike strong sub sup time tt u var wbr img nobr".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_NEXT_BLOCK = re.compile(
    f"</?(?:{'|'.join(sorted(CLOSES_PARAGRAPH))}|li|td|th|tr|body|html)(?=[\\s/>])", re.IGNORECASE
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and roles around boilerplate and around content.
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog alertdialog menu "
    "menubar toolbar".split()
)
#: Words in class names and ids.
BOILER_WORDS = re.compile(
    r"(?:^|[-_\s])(?:nav\w*|menu\w*|header|foot\w*|side\w*|ads?|adv\w*|promo\w*|sponsor\w*|banner"
    r"|cookie\w*|notice\w*|consent|gdpr|popup|modal|overlay|comments?|reply|replies|respond"
    r"|discussion|related|recommend\w*|share\w*|sharing|social|breadcrumb\w*|subscri\w*|newsletter"
    r"|login|signup|register|search\w*|widget\w*|pag(?:er|ination)|copyright|legal|disclaimer"
    r"|toolbar|masthead|tags?|meta|byline|skip|hidden|alert|toc)(?=$|[-_\s\d])",
    re.IGNORECASE,
)
CONTENT_WORDS = re.compile(
    r"(?:^|[-_\s])(?:article\w*|content|main|post|entry|story|body|text|page)(?=$|[-_\s\d])",
    re.IGNORECASE,
)

#: Weights of the classifier, towards content.
BOILER_ELEMENT, CONTENT_ELEMENT, FADE = -9.0, 4.0, 0.4
PER_WORD, MOST_WORDS = 0.08, 3.0
LINKED, PROSE, BARE = -3.0, 0.6, -1.2
#: Capacities of an edge between neighbours and between blocks of one element.
NEIGHBOUR, SIBLING = 0.6, 1.2


class Element:
    __slots__ = ("tag", "mark", "depth", "parent")

    def __init__(self, tag: str, attributes: str, parent: Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.mark = _mark(tag, attributes, parent)


def _mark(tag: str, attributes: str, parent: Element | None) -> float:
    """What the element itself says: content above 0, boilerplate below."""
    mark = 0.0
    if tag in BOILER_TAGS:
        mark = BOILER_ELEMENT
    elif tag in ("article", "main"):
        mark = CONTENT_ELEMENT
    elif tag == "header":
        at = parent
        while at and at.tag not in ("article", "main"):
            at = at.parent
        mark = 0.0 if at else BOILER_ELEMENT
    if attributes.strip(" /"):
        names = {
            m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)
        }
        label = f"{names.get('class', '')} {names.get('id', '')}"
        role = names.get("role", "").lower()
        style = names.get("style", "").replace(" ", "").lower()
        if (
            role in BOILER_ROLES
            or "hidden" in names
            or names.get("aria-hidden") == "true"
            or "display:none" in style
            or label.strip()
            and tag not in ("html", "body")
            and BOILER_WORDS.search(label)
        ):
            mark = BOILER_ELEMENT
        elif mark == 0.0 and (role in ("main", "article") or CONTENT_WORDS.search(label)):
            mark = CONTENT_ELEMENT / 2
    return mark


class Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element) -> None:
        self.text, self.linked, self.element = text, linked, element


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    root = Element("html", "", None)
    at, blocks, parts = root, [], []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, linked, at))
            parts.clear()
        linked = 0

    def close(tag: str, limit: frozenset[str] = frozenset()) -> None:
        nonlocal at
        look = at
        while look is not root and look.tag != tag:
            if look.tag in limit:
                return
            look = look.parent
        if look is not root:
            at = look.parent

    position, end = 0, len(page)
    while position < end:
        m = _TOKEN.match(page, position)
        position = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                text = references.unescape(token) if "&" in token else token
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in INLINE:
                continue
            flush()
            if tag == "p" and at.tag != "p":
                continue
            close(tag)
            in_link = 0
            continue
        if tag in SKIPPED:
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            if tag not in ("svg", "math", "button", "select", "textarea"):
                flush()
            position = _skipped(page, position, tag, m[3])
            continue
        if tag == "a":
            in_link += 1
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush() if tag == "hr" else parts.append(" ")
            continue
        flush()
        in_link = 0
        if tag in CLOSES_PARAGRAPH and at.tag == "p":
            at = at.parent
        elif tag == "li":
            close("li", frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            close("dt", frozenset(("dl",)))
            close("dd", frozenset(("dl",)))
        elif tag in ("td", "th", "tr"):
            for name in ("td", "th") if tag != "tr" else ("td", "th", "tr"):
                close(name, frozenset(("table",)) if tag == "tr" else frozenset(("table", "tr")))
        if tag not in ("html", "body"):
            at = Element(tag, m[3], at)
    flush()
    return blocks


def _skipped(page: str, position: int, tag: str, attributes: str) -> int:
    """Where a page goes on after an element that is no text.

    Raw text ends at its closing tag, or with the page. Others that close themselves or
    are not closed before another of their kind begins end at the next block.
    """
    if tag in RAW:
        gone = _tags(tag, "/").search(page, position)
        return gone.end() if gone else len(page)
    if attributes.endswith("/"):
        return position
    depth, at = 1, position
    while depth:
        m = _tags(tag, "/?").search(page, at)
        if m is None or (m[1] == "" and tag not in NESTED):
            if tag in ("head", "title"):
                return position
            block = _NEXT_BLOCK.search(page, position)
            return block.start() if block else len(page)
        depth += 1 if m[1] == "" else -1
        at = m.end()
    return at


@lru_cache(maxsize=256)
def _tags(tag: str, slash: str) -> re.Pattern:
    return re.compile(f"<({slash}){re.escape(tag)}(?=[\\s/>])[^>]*>", re.IGNORECASE)


def content_score(block: Block) -> float:
    """The linear classifier: above 0 for content."""
    words = block.text.count(" ") + 1
    score = min(MOST_WORDS, PER_WORD * words)
    if block.linked > 0.5 * len(block.text):
        score += LINKED
    if block.text[-1] in ".!?…\"”»":
        score += PROSE
    if block.element.tag in ("p", "blockquote", "pre", *HEADINGS):
        score += PROSE
    weight, around, at = 1.0, False, block.element
    while at:
        if at.mark:
            score += weight * at.mark
            around |= at.mark > 0
            weight *= FADE
        at = at.parent
    return score if around else score + BARE


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(block, block, capacity): neighbours, and consecutive blocks below one element."""
    edges = [
        (i, i + 1, NEIGHBOUR / (1 + _distance(blocks[i].element, blocks[i + 1].element)))
        for i in range(len(blocks) - 1)
    ]
    before: dict[int, int] = {}
    for i, block in enumerate(blocks):
        above = block.element.parent or block.element
        if (j := before.get(id(above))) is not None:
            edges.append((j, i, SIBLING))
        before[id(above)] = i
    return edges


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]):
    """Whether each node is on the source side of the least minimum cut.

    Cutting node i off costs source[i] if it ends on the sink side and sink[i] if not,
    and each edge between the sides its capacity.
    """
    n = len(source)
    s, t = list(source), list(sink)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, capacity in edges:
        near[a][b] = near[a].get(b, 0.0) + capacity
        near[b][a] = near[b].get(a, 0.0) + capacity
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is not None:
            continue
        pull = sum(near[i].values())
        if s[i] - t[i] > pull or t[i] - s[i] >= pull:
            side[i] = s[i] - t[i] > pull
            for j, capacity in near[i].items():
                (s if side[i] else t)[j] += capacity
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if not rest:
        return side
    # Breadth-first augmenting paths between the terminals over what is not fixed.
    for i in rest:
        both = min(s[i], t[i])
        s[i] -= both
        t[i] -= both
    tiny = 1e-9
    while True:
        came: dict[int, int] = {i: -1 for i in rest if s[i] > tiny}
        queue, hit = deque(came), None
        while queue:
            i = queue.popleft()
            if t[i] > tiny:
                hit = i
                break
            for j, capacity in near[i].items():
                if capacity > tiny and j not in came:
                    came[j] = i
                    queue.append(j)
        if hit is None:
            for i in rest:
                side[i] = i in came
            return side
        path = [hit]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(t[hit], s[path[-1]], *(near[b][a] for a, b in zip(path, path[1:])))
        t[hit] -= flow
        s[path[-1]] -= flow
        for a, b in zip(path, path[1:]):
            near[b][a] -= flow
            near[a][b] += flow


def main_text(page: str) -> str:
    """The content blocks of a page, joined by one space."""
    blocks = blocks_of(page)
    scores = [content_score(b) for b in blocks]
    side = minimum_cut([max(0.0, x) for x in scores], [max(0.0, -x) for x in scores], edges_of(blocks))
    return " ".join(b.text for b, keep in zip(blocks, side) if keep)


def extract_pages(
    pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) of every row."""

    def make():
        def each(ids, urls, contents):
            for key, address, content in zip(ids, urls, contents):
                text = main_text(content) if content else ""
                yield key, address, text, len(text)

        return each

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"{id_col} {kinds[id_col]}, {url} {kinds[url]}, text string, n_chars long"
    return map_batches(pages.select(id_col, url, html), make, schema)


@query()
def op7_html_extraction(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
