"""Main text of web pages by tree scoring.

A page becomes a tree of containers with blocks of text (what stands between block-level tags). Each block passes points
for its length and commas to its container, half to the next above, a third beyond, five levels up; a container's points
are discounted by its share of linked characters. The best container is kept, widened to the article or main part around
it, with those siblings that score a fifth of it; where there is no such part, with its sibling headings, paragraphs and
containers of whole paragraphs. Unlikely containers (menus, adverts, notices, comments and the like) and lists made of links go.

A name (class, id, role) speaks against a container by its last word, or by its first or last but one where the last only says what kind of part
it is (`share-buttons`, `widget-area`). It does not where it tells a state (`has-sidebar`, `no-comments`), nor on a page of whose
unlinked text half or more stands in parts of that very name (frameworks call everything a widget), nor inside the article for a part with two
long paragraphs and few links (`related`, `social` may head a section). Names of adverts and readers' comments always count.

One pass over the tags and one over the tree: the time follows the page's length, however tags nest or stay open.

Defined cases: null and empty html give an empty text; unclosed and crossed tags close at the next fitting tag; a menu, form or
the like that is never closed is no such part; a quote that belongs to no attribute value is ignored; pages of any length are
read whole; of containers of equal worth the first counts; a page without any paragraph-like block gives all that stands in no
unlikely container; repeated pages are answered each; columns are taken by position, so other columns don't matter.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_batches, table

#: A comment, declaration or tag. Quotes hold a > only as an attribute's value; what is never closed reaches to the end.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>?", re.S)
#: Their content is never text of the page.
DROPPED = frozenset("script style noscript template iframe svg canvas audio video head title select textarea button form fieldset dialog menu nav aside footer".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: A form around a whole article is none of the article's parts: it counts as a container.
AROUND = frozenset("form fieldset".split())
BLOCKS = frozenset("html body div section article main header p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption hgroup address details summary center hr br".split()) | DROPPED
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open one of these, unless it stands outside the innermost of LIMITS.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
LIMITS = ("table", "ul", "ol", "dl", "div", "article", "section", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH_LIKE = HEADINGS | {"p", "pre"}
#: Elements that pass their points on to what holds them.
INNER = PARAGRAPH_LIKE | frozenset("li dt dd figcaption".split())
LISTS = frozenset("ul ol dl table tbody thead tr td th div section figure".split())
#: Words in class, id or role of what is no part of an article.
UNLIKELY = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discuss discussion disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pagination popup promo promos promoted promotion related replies reply share shares sharing sidebar signup skip social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
#: Of these, the ones that count however much text a part holds.
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertising promo promos promoted promotion sponsor sponsored sponsors comment comments disqus replies reply".split())
#: Words that tell a state of what they name.
STATES = frozenset("has have no not non with without is are hide hides hidden show shows enable enabled disable disabled".split())
#: Words that say what kind of part it is, so that the words before them say whose.
PART_NOUNS = frozenset("area aside bar block body box button buttons card cards center col column container content count cta element feed footer form grid group header heading icon icons image inner item items layout left link links list logo main module modal nav outer overlay panel popup post posts region right row section slot stories strip tab tabs title top bottom unit view wrap wrapper zone".split())
PAGE_HEADS = frozenset("header masthead".split())
ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"\shidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Tags whose names say nothing about a part.
WHOLE = frozenset("html body main".split())
BONUS = {"article": 25, "main": 15, "section": 3, "div": 3, "td": 2, "blockquote": 2}
LEVELS = 5
#: Mean characters of a paragraph from which on a container beside the best one is text.
LONG = 80


class Node:
    __slots__ = ("tag", "up", "bad", "article", "score", "chars", "linked", "blocks", "place", "last", "names", "head", "hidden", "plain", "long")

    def __init__(self, tag: str, up: Node | None, place: int, attributes: str = ""):
        self.tag, self.up, self.place, self.last = tag, up, place, place
        self.bad, self.article = False, None
        self.hidden = bool(attributes and tag not in WHOLE and HIDDEN.search(attributes))
        self.names, self.head = names_of(tag, attributes) if attributes and tag not in WHOLE else ((), False)
        self.score, self.chars, self.linked, self.blocks = float(BONUS.get(tag, 0)), 0, 0, 0
        #: unlinked characters, and how many long unlinked blocks they make
        self.plain, self.long = 0, 0


def names_of(tag: str, attributes: str) -> tuple[tuple[tuple[str, bool], ...], bool]:
    """The tokens of class, id and role that speak against an element, each with whether it always counts, and whether one names a
    page's head. A paragraph's or article's name counts only as a whole."""
    found, head, alone = [], False, tag in INNER or tag == "article"
    for name in ATTRIBUTE.findall(attributes):
        for token in name.strip("\"'").split():
            words = [w.lower() for w in PARTS.findall(token)]
            if not words or STATES.intersection(words) or (alone and len(words) > 1):
                continue
            signs = {words[-1], words[0], words[-2]} if len(words) > 1 and words[-1] in PART_NOUNS else {words[-1]}
            if signs & UNLIKELY:
                found.append((token.lower(), bool(signs & ALWAYS)))
            head |= not alone and bool(PAGE_HEADS.intersection((words[0], words[-1]) if len(words) < 3 else words[-1:])) and not {"article", "post", "entry", "story", "content"} & set(words)
    return tuple(found), head


def judge(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Sums up what each node holds and says which nodes are no part of an article, and which article each is in."""
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        node.blocks += 1
        if 2 * linked <= len(text):
            node.plain += len(text)
            node.long += len(text) >= LONG
    own = [node.plain for node in nodes]
    for node in reversed(nodes[1:]):
        up = node.up
        up.chars, up.linked, up.blocks, up.last = up.chars + node.chars, up.linked + node.linked, up.blocks + node.blocks, max(up.last, node.last)
        up.plain, up.long = up.plain + node.plain, up.long + node.long
    # how much text stands in parts of each name, and in all that no part which is certain to go holds
    whole, under, share = 0, defaultdict(int), defaultdict(int)
    around: list[Node] = []
    gone = -1
    for node in nodes:
        while around and around[-1].last < node.place:
            for token, _ in around.pop().names:
                under[token] -= 1
        if node.place > gone:
            if node.hidden or any(always for _, always in node.names):
                gone = node.last
            else:
                whole += own[node.place]
        if node.names:
            for token, _ in node.names:
                if not under[token] and node.place > gone:
                    share[token] += node.plain
                under[token] += 1
            around.append(node)
    for node in nodes[1:]:
        up, inside = node.up, node.up.article is not None
        rich = inside and node.long >= 2 and 4 * node.linked < node.chars
        named = any(always or not (rich or (2 * share[token] >= whole > 0)) for token, always in node.names) and (node.tag != "article" or inside)
        node.bad = up.bad or node.hidden or named or (not inside and (node.head or node.tag == "header"))
        node.article = node if up.article is None and node.tag in ("article", "main") and not node.bad else up.article


def skips(tokens: list[re.Match]) -> dict[int, int]:
    """For each start tag of a dropped part, by its place among the tokens, the place of the end tag that closes it."""
    open_, out = defaultdict(list), {}
    for k, m in enumerate(tokens):
        tag = m[2] and m[2].lower()
        if tag in DROPPED and tag not in RAW:
            if not m[1]:
                if not m[3].rstrip().endswith("/"):
                    open_[tag].append(k)
            elif open_[tag]:
                out[open_[tag].pop()] = k
    return out


def tags_of(html: str) -> list[re.Match]:
    """All tokens in order; after a tag of RAW the next is the one that ends it, or none."""
    out, at = [], 0
    ends = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
    while m := TOKEN.search(html, at):
        out.append(m)
        at = m.end()
        if m[2] and not m[1] and (tag := m[2].lower()) in RAW and not m[3].rstrip().endswith("/"):
            close = ends[tag].search(html, at)
            at = close.start() if close else len(html)
    return out


def blocks_of(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The tree's nodes, each before what it holds, and (container, text, linked characters) of each block of text in page order; dropped parts are left out."""
    nodes = [Node("#", None, 0)]
    open_: list[Node] = [nodes[0]]
    where: defaultdict[str, list[int]] = defaultdict(list)  # tag -> depths at which it is open
    out: list[tuple[Node, str, int]] = []
    text: list[str] = []
    linked, links, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append((open_[-1], words, linked))
            text.clear()
        linked = 0

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = references.unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece.strip())

    def shut(depth: int) -> None:
        while len(open_) > depth:
            where[open_.pop().tag].pop()

    tokens = tags_of(html)
    skip = skips(tokens)
    articles = list(accumulate((m[2] is not None and not m[1] and m[2].lower() in ("article", "main", "h1") for m in tokens), initial=0))
    paragraphs = list(accumulate((m[2] is not None and not m[1] and m[2].lower() == "p" for m in tokens), initial=0))
    k = 0
    while k < len(tokens):
        m = tokens[k]
        put(html[at : m.start()])
        at = m.end()
        k += 1
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in BLOCKS:
            continue
        if tag == "br":
            text.append(" ")
            continue
        close()
        if closing:
            if where[tag]:
                shut(where[tag][-1])
                links = 0
            continue
        if tag in RAW:
            links = 0
            at = tokens[k].start() if k < len(tokens) else len(html)
            if m[3].rstrip().endswith("/"):
                at = m.end()
            continue
        if tag in DROPPED:
            links = 0
            stop = skip.get(k - 1)
            if stop is not None and not (tag in AROUND and (articles[stop] > articles[k] or paragraphs[stop] - paragraphs[k] >= 3)):
                at, k = tokens[stop].end(), stop + 1
            continue
        if tag in VOID:
            continue
        if open_[-1].tag in PARAGRAPH_LIKE:
            shut(len(open_) - 1)
        if tag in ENDS:
            depth = max((where[t][-1] for t in ENDS[tag] if where[t]), default=0)
            if depth and depth > max((where[t][-1] for t in LIMITS if where[t]), default=0):
                shut(depth)
        up = open_[-1]
        where[tag].append(len(open_))
        nodes.append(Node(tag, up, len(nodes), m[3]))
        open_.append(nodes[-1])
    put(html[at:])
    close()
    return nodes, out


def density(node: Node) -> float:
    return node.linked / max(1, node.chars)


def main_text(html: str | None) -> str:
    nodes, blocks = blocks_of(html or "")
    if not blocks:
        return ""
    judge(nodes, blocks)
    scored: dict[Node, None] = {}
    holds_heading: set[Node] = set()
    for node, text, linked in blocks:
        above: Node | None = node.up if node.tag in INNER and node.up is not None else node
        if node.tag in ("h1", "h2") and not node.bad:
            holds_heading.add(above)
        commas = text.count(",")
        points = 0 if node.bad or 2 * linked > len(text) else 1 + commas + min(len(text) / 100, 3 + len(text) / 1000)
        for level in range(1, LEVELS + 1):
            if above is None:
                break
            if above.tag not in ("#", "html"):
                if not above.bad:
                    scored[above] = None
                above.score += points / level
            above = above.up
    worth = {c: c.score * (1 - density(c)) for c in scored}
    if worth:
        best = max(worth, key=lambda c: worth[c])
        whole = best.article or best
        kept = [whole] + [c for c in worth if c.up is whole.up and c is not whole and c.tag in ("article", "div", "section", "blockquote") and worth[c] >= max(BONUS.get(c.tag, 0) + 2, worth[best] / 5)]
        if whole.article is None and whole.up is not None:
            beside = [c for c in nodes[whole.up.place : whole.up.last + 1] if c.up is whole.up and not c.bad and c.chars]
            kept += [c for c in beside if (c.tag in PARAGRAPH_LIKE and density(c) <= 0.5) or (density(c) < 0.25 and (c.chars >= LONG * c.blocks or (c in holds_heading and c.place < whole.place)))]
    else:
        kept = [nodes[0]] if not blocks[0][0].bad else []
    # what is kept and what is a list of links, as stretches of the nodes' order
    change = [0] * (len(nodes) + 1)
    chosen = set(kept)
    for c in chosen:
        change[c.place] += 1
        change[c.last + 1] -= 1
    inside = list(accumulate(change))
    only_links = [False] * len(nodes)
    for node in nodes[1:]:
        only_links[node.place] = only_links[node.up.place] or (node.tag in LISTS and node not in chosen and node.blocks > 1 and density(node) > 0.5)
    return " ".join(t for node, t, linked in blocks if not node.bad and inside[node.place] and not (2 * linked > len(t) and only_links[node.place]))


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns `keep` of each page with text and n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    head = [pages.schema[c] for c in keep]
    return in_batches(pages.select(*keep, html_col), run, "text string, n_chars long", head)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
