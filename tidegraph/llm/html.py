"""Main-text extraction from web pages by tree scoring.

Method: a tolerant tokeniser builds the element tree. Each paragraph-like block
gives points for its length and commas to its ancestors, halved for the
grandparent and falling further above; a container's points are discounted by
its link density and weighed by what its tag, class and id say. The best
container is kept together with those siblings that score nearly as well or
are plain paragraphs with few links.

What is left out. Scripts, styles, controls and hidden elements always; menus,
sidebars and footers by their tags. A class or id says so only where it is made of
telling words and words of layout alone ("ad", "cookie-notice", "left-sidebar"):
"related-work" or "ad-hoc" does not. Outside of an article such an element goes
unless it wraps the page's article or most of its text; inside, words that only
page furniture has suffice, others ("warning", "related") need support: more links
than text, or a place behind the last paragraph. Anything else with a telling
word goes only if it is mostly links. A form goes unless it holds half of the
page's text: some pages lie in one.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one newline in page order. Nothing is
dropped by length or capped.

Defined results: null or empty html gives an empty text; a page without any
main text gives an empty text; of containers with equal scores the first in page
order is taken; unclosed and misnested tags are closed as far as the next
matching parent; very long and very deep pages are walked without recursion;
repeated rows give the same text; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
DROPPED = frozenset("script style noscript template title head button input select textarea iframe object embed svg math canvas audio video dialog label option link meta".split())
#: Parts of pages by their tags; a form may wrap a page.
PAGE_PARTS = frozenset("nav footer aside menu".split())
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
CONTAINER = frozenset("#root html body article main section div td th table tbody tr center blockquote details fieldset form dd li dl ul ol".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in class, id and role. Page furniture wherever it stands; what may be furniture, but also part of an article; words of layout.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adbox adsense adslot banner breadcrumb breadcrumbs combx comment comments commentlist cookie cookies consent disqus disclaimer foot footer gdpr "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted promotion replies reply respond share sharing shoutbox sidebar sidebars signup "
    "skyscraper social sponsor sponsored subscribe subscription taboola toolbar tooltip topbar".split()
)
DOUBTFUL = frozenset("alert community contact copyright extra header hdr login overlay privacy recommend recommended recommendations related remark response responses rss search tags teaser warning widget widgets".split())
READERS = frozenset("comment comments commentlist combx disqus replies reply respond shoutbox".split())
#: Doubtful words that mean furniture behind the last paragraph of an article.
AT_END = DOUBTFUL - {"alert", "warning", "header", "hdr", "remark"}
LAYOUT = frozenset(
    "area article bar block bottom box column container content desktop footer form frame global group holder inline inner item items left link links list main mobile module outer page panel post right row "
    "section site slot space text title top unit wrap wrapper zone".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
GOOD_WORDS = frozenset("article articlebody body content entry hentry main page post story text blog maincontent postcontent entry-content article-body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "out", "never", "words", "told", "weight", "block", "in_link", "in_article", "own", "commas", "chars", "linked", "score", "all_chars", "all_linked", "holds")

    def __init__(self, tag: str, parent: Node | None, hint: tuple = (False, frozenset(), False, 0.0)):
        self.tag, self.parent = tag, parent
        never, self.words, self.told, self.weight = hint
        self.never = never or (parent is not None and parent.never)  # whatever the page looks like
        self.children: list[Node | str] = []
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.own = self.commas = self.chars = self.linked = self.all_chars = self.all_linked = 0
        self.score = 0.0
        self.out = self.holds = False

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


def hints(tag: str, source: str) -> tuple[bool, frozenset, bool, float]:
    """Whether an element never counts; telling words of its class and id; whether one of these names consists of such and of layout alone; its weight."""
    if tag in DROPPED:
        return True, frozenset(), False, 0.0
    weight = {"article": 25.0, "main": 20.0}.get(tag, 0.0)
    if "=" not in source:
        return False, frozenset(), False, weight
    telling: set[str] = set()
    told = good = False
    for name, a, b, c in _ATTR.findall(source):
        name = name.lower()
        if name in ("class", "id", "role"):
            value = (a or b or c).lower()
            if name == "role":
                if value.strip() in BAD_ROLES:
                    return True, frozenset(), False, 0.0
                if value.strip() in ("main", "article"):
                    weight += 20
                continue
            for name_part in value.split():
                words = set(_WORDS.findall(name_part))
                good = good or name_part in GOOD_WORDS or bool(words & GOOD_WORDS)
                bad = words & (FURNITURE | DOUBTFUL)
                telling |= bad
                told = told or bool(bad) and words <= FURNITURE | DOUBTFUL | LAYOUT
    if ("hidden" in source.lower() or "display" in source.lower()) and _HIDDEN.search(source) and tag not in ("html", "body"):
        return True, frozenset(), False, 0.0
    return False, frozenset(telling), told, weight + 25.0 * good


def nearest(node: Node, tags, stop) -> Node | None:
    """``node`` or its first ancestor of one of ``tags``; None if one of ``stop`` comes before."""
    while node is not None:
        if node.tag in tags:
            return node
        if node.tag in stop:
            return None
        node = node.parent
    return None


def parse(html: str) -> list[Node]:
    """All elements in page order, the root first."""
    here = Node("#root", None)
    nodes = [here]
    at, match = 0, _TOKEN.match
    while m := match(html, at):
        at = m.end()
        token = m.group()
        if token[0] != "<" or len(token) == 1:
            here.children.append(token)
            if not here.never and (n := len(token.strip())):
                here.own += n
                here.commas += token.count(",") + token.count("\u3001") + token.count("\uff0c")
            continue
        if token[1] in "!?":
            continue
        closing = token[1] == "/"
        tag = _NAME.search(token).group().lower()
        if closing:
            # an inline end tag does not close table cells, and no end tag leaves its cell unless it ends the table
            found = nearest(here, {tag}, () if tag in ("table", "tr", "td", "th", "tbody", "body", "html") else ("td", "th"))
            if found is not None and found.parent is not None:
                here = found.parent
            continue
        if tag in CLOSES_P:
            paragraph = nearest(here, {"p"}, BLOCK - {"p"})
            if paragraph is not None:
                here = paragraph.parent
        if tag in SIBLING_ENDS:
            sibling = nearest(here, SIBLING_ENDS[tag], SCOPES[tag])
            if sibling is not None and tag == "tr" and sibling.tag != "tr":
                sibling = nearest(sibling, {"tr"}, {"table"})
            if sibling is not None:
                here = sibling.parent
        node = Node(tag, here, hints(tag, token))
        here.children.append(node)
        nodes.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not (token.endswith("/>") and tag not in BLOCK and tag != "a"):
            here = node
    return nodes


PROSE, MOST_LINKS, MOST_TEXT = 80, 0.5, 0.6


def decide(nodes: list[Node], trusting: bool = False) -> None:
    """Mark what is left out; ``trusting``: by tags alone, whatever classes, ids and forms say."""
    for node in nodes:
        node.all_chars, node.all_linked, node.holds = node.own, node.own * node.in_link, node.tag in ("article", "main") and not node.never
    for node in reversed(nodes):  # children before parents
        if node.parent is not None and not node.never:
            node.parent.all_chars += node.all_chars
            node.parent.all_linked += node.all_linked
            node.parent.holds = node.parent.holds or node.holds
    root = nodes[0]
    for node in nodes:
        node.out = node.never or (node.parent is not None and node.parent.out) or node.tag in PAGE_PARTS or (node.tag == "header" and not node.in_article)
        if not node.out and not trusting and node.parent is not None:
            node.out = furniture(node, root)


def furniture(node: Node, root: Node) -> bool:
    """Whether a form, or an element with telling words, is no part of the main text."""
    share = node.all_chars / max(root.all_chars, 1)
    if node.tag == "form":
        return share < 0.5
    if not node.words or node.tag in ("html", "body", "article", "main"):
        return False
    mostly_links = node.all_linked > MOST_LINKS * max(node.all_chars, 1)
    if not node.told:
        return mostly_links
    if node.in_article:
        return mostly_links or bool(node.words & FURNITURE) or (bool(node.words & AT_END) and behind_all_prose(node))
    wraps = node.holds or (share >= MOST_TEXT and not node.words & READERS and not root.holds)
    return not wraps


def behind_all_prose(node: Node) -> bool:
    """Whether no later sibling, nor one of a parent below the article, has a paragraph's length of text."""
    while node.parent is not None and node.tag not in ("article", "main"):
        later = False
        for other in node.parent.children:
            if other is node:
                later = True
            elif later and isinstance(other, Node) and not other.never and other.all_chars - other.all_linked >= PROSE and not other.words:
                return False
        node = node.parent
    return True


def score(nodes: list[Node]) -> Node | None:
    """Let blocks pass points up; the best container, or None if no block has text."""
    for node in nodes:
        node.chars = node.linked = 0
        node.score = 0.0
    own = {}  # text and commas of blocks with the inline elements in them, and how much is linked
    for node in nodes:
        if node.own and not node.out:
            sums = own.setdefault(id(node.block), [0, 0, 0])
            sums[0] += node.own
            sums[1] += node.commas
            sums[2] += node.own * node.in_link
    for node in reversed(nodes):
        if node.block is not node or node.out:
            continue
        text, commas, linked = own.get(id(node), (0, 0, 0))
        node.chars += text
        node.linked += linked
        if node.parent is not None:
            node.parent.block.chars += node.chars
            node.parent.block.linked += node.linked
        if not text:
            continue
        points = (1 + commas + min(text / 100, 3.0)) * (1 - linked / text)
        level = 0
        if node.tag in CONTAINER:  # text that stands in a container directly
            node.score += points
            level = 1
        up = node.parent
        while up is not None and points > 0:
            if up.block is up:
                up.score += points / (1, 2, 3 * level)[min(level, 2)]
                level += 1
                if level > 6:
                    break
            up = up.parent
    best, best_score = None, 0.0
    for node in nodes:
        if node.block is node and not node.out and node.score > 0 and node.tag in CONTAINER:
            # a word that did not suffice to leave the element out lowers its score
            final = (node.score + node.weight) * (1 - node.linked / max(node.chars, 1)) * (0.8 if node.words and not node.in_article else 1.0)
            node.score = final
            if final > best_score:
                best, best_score = node, final
    if best is not None:
        for node in best.ancestors():
            if node.tag == "article" and not node.out:
                best = node
                break
    return best


def kept(best: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    if best.parent is None or best.tag == "body":
        return [best]
    threshold = max(10.0, 0.2 * best.score)
    out = []
    for node in best.parent.children:
        if node is best:
            out.append(node)
        elif isinstance(node, Node) and not node.out and node.block is node:
            density = node.linked / max(node.chars, 1)
            if node.tag in CONTAINER:
                keep = node.score >= threshold and density < 0.3
            elif node.tag == "p":
                keep = node.chars > 80 and density < 0.25 or 0 < node.chars and density == 0 and best.tag != "article"
            else:
                keep = node.tag in HEADINGS and density < 0.3 and best.tag != "article"
            if keep:
                out.append(node)
    return out


def blocks_of(root: Node) -> list[str]:
    """Texts of the blocks below ``root``; an explicit stack, so depth has no limit."""
    out: list[str] = []
    now: list[str] = []

    def end_block():
        text = SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if text:
            out.append(text)

    stack = [(root, iter(root.children))]
    while stack:
        node, children = stack[-1]
        for child in children:
            if isinstance(child, str):
                now.append(unescape(child) if "&" in child else child)
            elif child.out:
                if child.block is child:
                    end_block()
            elif child.tag == "br":
                now.append(" ")
            else:
                if child.block is child:
                    end_block()
                stack.append((child, iter(child.children)))
                break
        else:
            stack.pop()
            if node.block is node:
                end_block()
    end_block()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    nodes = parse(html)
    for trusting in (False, True):  # where words left nothing, tags alone decide
        decide(nodes, trusting)
        best = score(nodes)
        if best is not None:
            return "\n".join(text for node in kept(best) for text in blocks_of(node))
    return ""


def extract_batches(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(h) for h in batch.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text."""
    kinds = [df.schema[c].dataType.simpleString() for c in (page_id, url)]
    rows = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(extract_batches, f"page_id {kinds[0]}, url {kinds[1]}, text string")
