"""Main text of HTML pages by minimum-cut labelling.

A page is read into blocks: runs of text between tags that start a new line. A linear classifier over a
block's surroundings (elements; class, id and role tokens) and words (length, signs, share of links) gives the
probability that it is content. Its two costs, -log p and -log(1 - p), are a block's capacities to the
terminals. Blocks that follow each other are joined by an edge, and so are neighbours of one container
(DOM proximity), so that a short paragraph goes with those around it. The minimum cut separates content from
boilerplate; it is the labelling of least cost. Blocks whose terminal capacities outweigh all their edges
are decided first (no cut does better), and a maximum flow is found for what is left.

Scripts, styles, heads and comments of the markup are no text. Character references are decoded, white space in
a block is one space, blocks are joined by one line end in page order. Null pages are empty pages; unclosed
and stray tags are passed over, and text or an element of the body ends an open head. Elements are hidden by the attributes
``hidden`` and ``aria-hidden="true"`` and by ``display: none`` or ``visibility: hidden`` in their style. Long pages are read in time
proportional to their length; only blocks that the flow has to decide take more. Rows are read one by
one, so repeated rows and null ids stay. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import table

#: Elements without text, elements that run inside a line, elements without an end.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "head", "title", "iframe", "object", "canvas", "select", "textarea", "button", "audio", "video"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is kept exactly as it is until their own end tag, whatever stands in them.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "svg", "template"}
#: Elements that may stand in a head; all others end it.
HEAD = set("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: Log odds of being content.
ELEMENT_ODDS = {"article": 4.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "header": -4.5, "h1": 1.0, "h2": 0.5, "h3": 0.5, "p": 1.0, "blockquote": 0.5, "pre": 0.5, "figcaption": 0.5, "td": 0.2, "li": -0.3}
NAME_ODDS = -9.0
#: Elements that count like a boilerplate name, so neither where they hold the article; a form not around most of the page either.
NAMING = {"aside": "layout", "menu": "layout", "dialog": "layout", "form": "form"}
#: Known names of boilerplate. A class, id or role token is one if it is such a name, alone or with words that only say which
#: part or place of it. Names of the first set may also name a layout, those of the second are lists beside the page's own text.
LAYOUT_NAMES = set(
    "banner alert notice popup modal overlay nav navs navbar navigation navlist navlinks menu menus menubar breadcrumb breadcrumbs sidebar sidebars side rail widget "
    "widgets footer masthead siteheader pageheader topbar toolbar search skip legal disclaimer copyright login signup".split()
)
LIST_NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising advertiser advertorial sponsor sponsors sponsored sponsorship promo promos promotion promotions "
    "promotional promoted cookie cookies consent gdpr subscribe subscriber subscribers subscription subscriptions newsletter newsletters share sharing social related "
    "recommend recommended recommendation recommendations more comment comments commentlist discussion disqus respond response responses reply replies pagination pager "
    "tag tags tagcloud".split()
)
BEFORE_NAMES = set("site page main top bottom left right global local primary secondary post entry article blog story user sticky fixed mobile desktop wp block td mw jp et elementor js div read".split())
AFTER_NAMES = set(
    "wrap wrapper container holder inner outer box bar area zone list link links item items block section content body button buttons btn icon icons post posts article "
    "articles story stories news title heading header text message form input field group left right top bottom main primary secondary panel row cloud toggle dropdown "
    "unit slot policy law info warning author meta to".split()
)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|body|text|main)(?=$|[\s_-])", re.I)
#: Weights of edges between blocks that follow each other, and more within one container.
ADJACENT, SIBLING = 0.5, 1.5

# A quote opens a value only after "="; nothing is tried twice, and a tag that is still open at the end of the page ends there.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")


class Element:
    """Log odds of its own, kind of boilerplate its names say, whether it is an article or main; size of its text, and of that in articles and mains."""

    __slots__ = ("above", "odds", "named", "kind", "size", "held")

    def __init__(self, above: int, odds: float = 0.0, named: str = "", kind: str = ""):
        self.above, self.odds, self.named, self.kind, self.size, self.held = above, odds, named, kind, 0, {}


class Block:
    __slots__ = ("text", "links", "odds", "parent", "element")

    def __init__(self, text: str, links: int, parent: int, element: int):
        self.text, self.links, self.odds, self.parent, self.element = text, links, 0.0, parent, element


def attributes(given: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(given):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def is_hidden(given: dict[str, str]) -> bool:
    """Whether an element's own attributes hide it."""
    if given.get("hidden", "until-found").strip().lower() != "until-found" or given.get("aria-hidden", "").strip().lower() == "true":
        return True
    style = dict(re.findall(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", given.get("style", "").lower()))
    return style.get("display") == "none" or style.get("visibility") == "hidden"


def boilerplate(token: str) -> str:
    """Kind of boilerplate that a whole token names: list, layout or none."""
    parts = re.sub(r"(site|page)[_-]+header", r"\1header", token.lower()).replace("_", "-").split("-")
    parts = [p for p in parts if p]
    places = [n for n, p in enumerate(parts) if p in LAYOUT_NAMES or p in LIST_NAMES]
    if not places or parts[0] == "tag" and len(parts) > 1 and parts[1] not in ("cloud", "list", "links"):
        return ""
    known = all(p in BEFORE_NAMES for p in parts[: places[0]]) and all(p in AFTER_NAMES or p in LAYOUT_NAMES or p in LIST_NAMES or p.isdigit() for p in parts[places[0] :])
    return "" if not known else "list" if any(p in LIST_NAMES for p in parts) else "layout"


def add_up(elements: list[Element]) -> None:
    """Turns odds of single elements into those of an element and all above it.

    Boilerplate names count neither on an article or main nor on what holds one, that is at least half of the text of
    all articles (or mains) which stand in no other; for lists, at least half of the page's text. Elements of ``NAMING`` go by the
same rule, and a form that holds half of the page's text is the page's own. Teasers and
    comments that are marked up as articles don't clear the list they stand in.
    """
    within: list[frozenset] = [frozenset()]
    for element in elements[1:]:
        outer = within[element.above]
        counts = element.kind and element.kind not in outer and not (element.kind == "article" and element.named == "list")
        within.append(outer | {element.kind} if counts else outer)
    for n in range(len(elements) - 1, 0, -1):
        element, above = elements[n], elements[elements[n].above]
        if element.kind in within[n] and element.kind not in within[element.above]:
            element.held[element.kind] = element.size
        above.size += element.size
        for kind, size in element.held.items():
            above.held[kind] = above.held.get(kind, 0) + size
    page, left_out = elements[0], [False]
    for element in elements[1:]:
        left_out.append(left_out[element.above])
        if element.kind:
            if not left_out[-1] and element.kind not in within[element.above]:  # else it says nothing more
                element.odds += ELEMENT_ODDS[element.kind]
        elif element.named:
            around = element.named == "form" and 2 * element.size >= page.size
            if not around and not any(size and 2 * size >= (page.size if element.named == "list" else page.held[kind]) for kind, size in element.held.items()):
                element.odds += NAME_ODDS
                left_out[-1] = True
        element.odds += elements[element.above].odds


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order with the log odds of their surroundings and the number of their container."""
    blocks: list[Block] = []
    elements = [Element(0)]
    open_tags: list[tuple[str, bool, int]] = [("", False, 0)]  # element, silent, number
    at, texts, links, in_link = 0, [], 0, 0

    def flush() -> None:
        nonlocal texts, links
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                number = open_tags[-1][2]
                blocks.append(Block(text, links, elements[number].above, number))
                elements[number].size += len(text)
            texts, links = [], 0

    length = len(page)
    while at < length:
        found = _TAG.search(page, at)
        stop = found.start() if found else length
        if open_tags[-1][0] == "head" and page[at:stop].strip():
            del open_tags[-1]
        if stop > at and not open_tags[-1][1]:
            part = page[at:stop]
            texts.append(part)
            if in_link:
                links += len(part)
        if not found:
            break
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        if open_tags[-1][0] == "head" and not found.group(1) and name not in HEAD:
            del open_tags[-1]
        if name in INLINE:
            if name == "a":
                in_link = 0 if found.group(1) else 1
            continue
        flush()
        if found.group(1):
            depth = next((n for n in range(len(open_tags) - 1, 0, -1) if open_tags[n][0] == name), 0)
            if depth:
                del open_tags[depth:]
            in_link = 0
        elif name in RAW and not found.group(3).endswith("/"):
            end = re.compile(f"</{re.escape(name)}[^>]*+(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else length
        elif name not in EMPTY:
            in_link = 0
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name[0] == "h" and name[1:].isdigit():
                # A new one ends the one that is still open.
                if open_tags[-1][0] == name or open_tags[-1][0] == "p":
                    del open_tags[-1]
            elif open_tags[-1][0] == "p":
                del open_tags[-1]
            _, silent, above = open_tags[-1]
            element = Element(above, named=NAMING.get(name, ""), kind=name if name in ("article", "main") else "")
            given = found.group(3)
            if given and name not in ("html", "body"):
                given = attributes(given)
                tokens = " ".join(given[n] for n in ("class", "id", "role") if given.get(n)).split()
                kinds = [boilerplate(t) for t in tokens]
                element.named = max(kinds, default="") or element.named
                if any(CONTENT_NAMES.search(t) for t, kind in zip(tokens, kinds) if not kind):
                    element.odds += 1.5
                if given.get("role", "").lower() in ("article", "main"):
                    element.kind = given["role"].lower()
                silent = silent or is_hidden(given)
            if not element.kind:
                element.odds += ELEMENT_ODDS.get(name, 0.0)
            open_tags.append((name, silent or name in SILENT, len(elements)))
            elements.append(element)
    flush()
    add_up(elements)
    for block in blocks:
        block.odds = elements[block.element].odds
    return blocks


def log_odds(block: Block) -> float:
    """The classifier: surroundings, words, signs and links."""
    size = len(block.text)
    words = block.text.count(" ") + 1
    signs = sum(block.text.count(s) for s in ".,;:!?")
    return block.odds - 0.5 + min(words, 60) / 20 + min(signs, 6) / 6 - 5.0 * block.links / size


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: True pays log(1 + e^-odds), False pays log(1 + e^odds), an edge between both its weight."""
    count = len(odds)
    # Only the difference of a block's two costs matters, which is its log odds: that is its one capacity.
    around: list[dict[int, float]] = [{} for _ in range(count)]
    for a, b, weight in edges:
        around[a][b] = around[a].get(b, 0.0) + weight
        around[b][a] = around[b].get(a, 0.0) + weight
    pull = list(odds)
    label: list[bool | None] = [None] * count
    queue = deque(range(count))
    while queue:
        n = queue.popleft()
        if label[n] is None and abs(pull[n]) >= sum(around[n].values()):
            label[n] = pull[n] > 0
            for other, weight in around[n].items():
                pull[other] += weight if label[n] else -weight
                del around[other][n]
                queue.append(other)
            around[n] = {}
    rest = [n for n in range(count) if label[n] is None]
    if rest:
        source, sink = count, count + 1
        flow: dict[int, dict[int, float]] = {n: dict(around[n]) for n in rest} | {source: {}, sink: {}}
        for n in rest:
            if pull[n] > 0:
                flow[source][n], flow[n][source] = pull[n], 0.0
            else:
                flow[n][sink], flow[sink][n] = -pull[n], 0.0
        while True:  # shortest augmenting paths
            before = {source: source}
            queue = deque([source])
            while queue and sink not in before:
                n = queue.popleft()
                for other, left in flow[n].items():
                    if left > 1e-9 and other not in before:
                        before[other] = n
                        queue.append(other)
            if sink not in before:
                break
            path, n = [], sink
            while n != source:
                path.append((before[n], n))
                n = before[n]
            least = min(flow[a][b] for a, b in path)
            for a, b in path:
                flow[a][b] -= least
                flow[b][a] += least
        for n in rest:
            label[n] = n in before
    return [bool(x) for x in label]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    edges = [(n, n + 1, ADJACENT + (SIBLING if a.parent == b.parent else 0.0)) for n, (a, b) in enumerate(zip(blocks, blocks[1:]))]
    last_in: dict[int, int] = {}
    for n, block in enumerate(blocks):  # neighbours of one container, where something stands between
        if last_in.get(block.parent, n - 1) != n - 1:
            edges.append((last_in[block.parent], n, SIBLING))
        last_in[block.parent] = n
    labels = minimum_cut([log_odds(b) for b in blocks], edges)
    return "\n".join(b.text for b, content in zip(blocks, labels) if content)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(p) for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": found, "n_chars": [len(t) for t in found]})

    rows = pages.select(F.col(key).alias("page_id"), "url", F.coalesce(F.col(page), F.lit("")).alias("html"))
    return rows.mapInPandas(texts, "page_id long, url string, text string, n_chars long")


QUERY = "op2_html_extraction"
STATEMENT = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
