"""Main text of web pages by wrapper induction.

Seed trees are found in rounds, until every page has one. In each, from up to `sample_pages` distinct pages of a host, of least
hash, a page that simple tree matching (Yang, 1991) finds unlike the round's seeds so far, largest first, is the seed of
another layout. All pages of the round are then aligned with their nearest seed; those that no seed matches go on to the next
round, which ends when a host has fewer than `least` distinct pages left, too few to agree on a text. So no layout is
missed, however rare it is, and a round's seeds are few. It is counted how many distinct pages have which text on which seed node. A text that `share` of the pages that have the node agree on, and at least `least` of them, is constant: template, if
these pages differ otherwise: those whose other nodes hold a fifth of the page's text or more have `least` or more longest
blocks there. So a host that serves one article, or near copies of one, under many addresses has no template. Nodes without a constant text are slots whose texts vary. On a page, a block on a template node with the template's text is left out,
all other blocks are content.

Alignment cannot tell menus, notices or comments whose texts vary. These are known by element and role, and by whole words of class
and id: a node so named is hidden unless it wraps the page's article, main element or first heading, or, where a page has
no article or main, nearly all of its text. If a page has an article (or main) element, content is what stands in it; else
it is all of the body that is neither template nor a list of links.

Beyond `dynamic` pairs of children, children of two nodes are paired in order by label and text, then by label, in place of
the best pairing; no node is left out at any size or depth.

Seeds and constants of a host in a round are bounded by that round's pages. They are joined to pages by host as a table; Spark
broadcasts it only if its size on disk is below the session's threshold, and otherwise may split hot hosts. Pages of later
rounds are kept as tables, so a page is met by its own round's seeds and those of the rounds before, one round at a time.

Null and empty html gives an empty text; null urls have no host and no template; null ids and repeated rows are kept. Only
page_id, url and html are read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.llm.common import table, written

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes plaintext".split())
_INLINE = frozenset("a img abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr rb rp rt".split())
_NEVER = frozenset("head nav footer aside script style noscript template iframe button select option input textarea svg canvas object embed audio video menu map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert menu menubar".split())
#: What is no content unless a page is built inside it.
_SOFT = frozenset("form dialog alertdialog".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|adsense|sponsor(?:ed)?|promo|banner|nav(?:bar|igation)?|menu|breadcrumbs?|side-?bar|widget|cookies?|consent|gdpr|notice|popup|modal|overlay"
    r"|comments?|replies|disqus|respond|share|sharing|social|newsletter|subscribe|signup|login|related|recommend(?:ed|ations)?|footer|masthead|pagination|pager|toolbar|skip-?link)(?:$|[\s_-])",
    re.I,
)
#: Names of reader comments, and words that may stand beside a name inside an article without making it a topic.
_COMMENTS = re.compile(r"(?:^|\s)(?:(?:reader|user)[_-])?(?:comments?|replies|reply|disqus)(?:[_-](?:list|thread|section|area|body|item|box|wrap(?:per)?|form|#))*(?=\s|$)", re.I)
_BESIDE = frozenset("box block button buttons link links list bar wrap wrapper container slot section area top bottom left right inner outer post posts article articles item items inline unit form content text main page site header global primary secondary # icons icon row col media follow us stories story reading panel group module region zone label title".split())
#: Words from which on a block counts as prose.
PROSE = 12
#: Words of classes that tell a state or an absence and name no part of the page.
_STATES = re.compile(r"(?<![\w-])(?:(?:no|not|non|without|has|have|with|is)[-_][\w-]+|[\w-]+[-_](?:open|opened|closed|enabled|disabled|allowed|on|off|active))(?![\w-])", re.I)
_CLOSED_BY = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}), "optgroup": frozenset({"option", "optgroup"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}), "tfoot": frozenset({"thead", "tbody", "tr", "td", "th"}), "body": frozenset({"head"}),
}
_SCOPE = frozenset("html body article section main div ul ol dl table td th blockquote form nav aside header footer figure".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)


#: The part of its mean size with a seed that a page of the seed's layout matches.
ALIKE = 0.5
#: Pages of which less than one part in so many varies say nothing about what is template.
VARYING = 5


class Node:
    __slots__ = ("tag", "label", "parts", "parent", "hidden", "named", "soft", "comments", "inside")

    def __init__(self, tag: str, label: str, parent: Node | None, hidden: bool):
        self.tag, self.label, self.parent, self.hidden = tag, label, parent, hidden
        self.named = False  # whether class or id name a part that is no content
        self.soft = self.comments = False  # a form or dialog; a name of reader comments
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.parts: list[Node | str] = []  # children and texts, in order


def parse(source: str) -> Node:
    """A tree of the page, forgiving as browsers are: implied ends, unclosed elements, stray end tags."""
    root = at = Node("#root", "#root", None, False)
    pos, size = 0, len(source)
    while pos < size:
        m = _TOKEN.search(source, pos)
        if m is None:
            at.parts.append(source[pos:])
            break
        if m.start() > pos:
            at.parts.append(source[pos : m.start()])
        pos = max(m.end(), m.start() + 1)
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            up = at
            while up.parent is not None and up.tag != tag and not (tag == "p" and up.tag in _SCOPE):
                up = up.parent
            if up.tag == tag and up.parent is not None:
                at = up.parent
            continue
        if at.tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            at = at.parent
        closes = _CLOSED_BY.get(tag, ())
        if tag not in _INLINE and tag not in _VOID and tag not in _RAW:
            closes = frozenset({"p"}).union(closes)
        if closes:
            up = at
            while up.parent is not None and up.tag not in closes and up.tag not in _SCOPE - closes:
                up = up.parent
            while up.tag in closes and up.parent is not None:
                at = up = up.parent
        given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if "=" in m[3] else {}
        name = f"{given.get('class', '')} {given.get('id', '')}".strip()
        hidden = tag in _NEVER or given.get("role", "").lower() in _ROLES
        if tag == "header":
            up = at
            while up is not None and up.tag not in ("article", "main"):
                up = up.parent
            hidden = hidden or up is None
        node = Node(tag, f"{tag}.{re.sub(r'[0-9]+', '#', name)}" if name else tag, at, hidden)
        plain = _STATES.sub(" ", name) if name else ""
        node.named = bool(name) and tag not in ("html", "body", "article", "main") and bool(_NAMES.search(plain)) and (not node.inside or _names_only(plain))
        node.comments = bool(name) and tag not in ("html", "body", "main") and bool(_COMMENTS.search(re.sub(r"[0-9]+", "#", plain)))
        node.soft = tag in _SOFT or given.get("role", "").lower() in _SOFT
        at.parts.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(source, pos)
            pos = end.end() if end else size
        elif tag not in _VOID and not m[3].endswith("/"):
            at = node
    _settle(root)
    return root


def _names_only(name: str) -> bool:
    """Whether a class or id is a name of what is no content, alone or beside words that tell no topic (so `social-policy` is none)."""
    parts = lambda token: [p for p in re.split(r"[_-]+", re.sub(r"[0-9]+", "#", token.lower())) if p]
    return any(_NAMES.search(t) and all(p in _BESIDE or _NAMES.search(p) for p in parts(t)) for t in name.split())


def _settle(root: Node) -> None:
    """Hide the named nodes that hold no article, main or h1, nor nine tenths of the text of a page without article and main.

    Forms and dialogs are hidden unless they hold article or main or half of the page's text; reader comments always, but
    where they hold main or nine tenths of the text.
    """
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in n.parts if isinstance(k, Node) and not k.hidden and k.tag not in _RAW]
    if not any(n.named or n.soft or n.comments for n in order):
        return
    regions: set[int] = set()
    size: dict[int, int] = {}
    holds: set[int] = set()
    for n in reversed(order):
        size[id(n)] = sum(len(k.strip()) if isinstance(k, str) else size.get(id(k), 0) for k in n.parts)
        if n.tag in ("article", "main", "h1") or any(id(k) in holds for k in n.parts):
            holds.add(id(n))
        if n.tag == "main" or n.tag == "article" and not n.comments or any(id(k) in regions for k in n.parts):
            regions.add(id(n))
    whole = any(n.tag in ("article", "main") for n in order)
    for n in order:
        if n.named and id(n) not in holds and (whole or not size[id(n)] or 10 * size[id(n)] < 9 * size[id(root)]):
            n.hidden = True
        elif n.soft and id(n) not in regions and 2 * size[id(n)] < size[id(root)]:
            n.hidden = True
        elif n.comments and 10 * size[id(n)] < 9 * size[id(root)] and not any(k.tag == "main" for k in _below(n)):
            n.hidden = True


def _below(node: Node) -> Iterator[Node]:
    stack = [k for k in node.parts if isinstance(k, Node)]
    while stack:
        n = stack.pop()
        yield n
        stack += [k for k in n.parts if isinstance(k, Node)]


def _joined(texts: list[str]) -> str:
    return " ".join(entities.unescape("".join(texts)).split())


def blocks(node: Node) -> Iterator[tuple[Node, str]]:
    """(holder, text) of every block below node, in page order; hidden subtrees have none."""
    run: list[str] = []
    holder = node
    # an explicit stack: pages may nest deeper than Python's calls
    stack: list[tuple[Node, Iterator]] = [(node, iter(node.parts))]
    while stack:
        at, parts = stack[-1]
        for part in parts:
            if isinstance(part, str):
                if not run:
                    holder = next(n for n, _ in reversed(stack) if n.tag not in _INLINE)
                run.append(part)
            elif part.hidden or part.tag in _RAW:
                if part.tag not in _INLINE and run:
                    if text := _joined(run):
                        yield holder, text
                    run = []
            else:
                if part.tag not in _INLINE and run:
                    if text := _joined(run):
                        yield holder, text
                    run = []
                stack.append((part, iter(part.parts)))
                break
        else:
            stack.pop()
            if at.tag not in _INLINE and run:
                if text := _joined(run):
                    yield holder, text
                run = []
    if run and (text := _joined(run)):
        yield holder, text


class Shape:
    """A page's tree for matching: runs of like siblings that hold no blocks are one node; texts by node."""

    __slots__ = ("label", "children", "texts", "size", "kind", "number")

    def __init__(self, label: str, children: list[Shape], texts: list[str]):
        self.label, self.children, self.texts = label, children, texts
        self.number = -1  # its place in a seed, parents first
        self.close()

    def close(self) -> None:
        """Size and kind, once the children have theirs; trees of one kind have the same labels in the same places."""
        self.size = 1 + sum(c.size for c in self.children)
        self.kind = hash((self.label, *[c.kind for c in self.children]))

    def text_hash(self) -> int | None:
        """A signed 64-bit hash of the node's own text; none without text."""
        return _hash("\n".join(self.texts)) if self.texts else None


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _inner(n: Node) -> list[Node]:
    return [k for k in n.parts if isinstance(k, Node) and not k.hidden and k.tag not in _INLINE and k.tag not in _VOID and k.tag not in _RAW]


def shape(root: Node) -> tuple[Shape, dict[int, Shape]]:
    """The shape, and the shape node of each tree node by id()."""
    of: dict[int, Shape] = {}
    texts: dict[int, list[str]] = {}
    for holder, text in blocks(root):
        texts.setdefault(id(holder), []).append(text)
    top = Shape(root.label, [], [])
    order: list[Shape] = []
    stack: list[tuple[Shape, list[Node]]] = [(top, [root])]
    while stack:
        out, nodes = stack.pop()
        order.append(out)
        out.texts = [t for n in nodes for t in texts.get(id(n), ())]
        runs: list[list[Node]] = []
        plain = False  # whether the last run's nodes hold no blocks
        for n in nodes:
            of[id(n)] = out
            for k in _inner(n):
                leaf = not _inner(k)
                if runs and leaf and plain and runs[-1][0].label == k.label:
                    runs[-1].append(k)
                else:
                    runs.append([k])
                    plain = leaf
        out.children = [Shape(r[0].label, [], []) for r in runs]
        stack += zip(out.children, runs)
    for s in reversed(order):
        s.close()
    return top, of


def _depth(s: Shape) -> int:
    deepest, stack = 0, [(s, 1)]
    while stack:
        n, d = stack.pop()
        deepest = max(deepest, d)
        stack += [(c, d + 1) for c in n.children]
    return deepest


def matched(a: Shape, b: Shape, dynamic: int = 40_000) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the most pairs of nodes with like labels that keep order and ancestry."""
    needed = 3 * min(_depth(a), _depth(b)) + 1000
    if sys.getrecursionlimit() < needed:  # calls of Python functions by Python functions take no C stack
        sys.setrecursionlimit(needed)
    return _matched(a, b, dynamic)


def _matched(a: Shape, b: Shape, dynamic: int) -> tuple[int, list[tuple[Shape, Shape]]]:
    if a.label != b.label:
        return 0, []
    if a.kind == b.kind:
        return a.size, _alike(a, b)
    n, m = len(a.children), len(b.children)
    if n * m > dynamic:
        total, out = 1, [(a, b)]
        for i, j in _in_order(a.children, b.children):
            w, pairs = _matched(a.children[i], b.children[j], dynamic)
            total += w
            out += pairs
        return total, out
    score = [[0] * (m + 1) for _ in range(n + 1)]
    found = {}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best = max(score[i - 1][j], score[i][j - 1])
            if a.children[i - 1].label == b.children[j - 1].label:
                w, pairs = found[i, j] = _matched(a.children[i - 1], b.children[j - 1], dynamic)
                best = max(best, score[i - 1][j - 1] + w)
            score[i][j] = best
    out = [(a, b)]
    i, j = n, m
    while i and j:
        held = found.get((i, j))
        if held and score[i][j] == score[i - 1][j - 1] + held[0]:
            out += held[1]
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return score[n][m] + 1, out


def _alike(a: Shape, b: Shape) -> list[tuple[Shape, Shape]]:
    """All nodes of two trees of one kind, place by place: nothing else matches as many."""
    out, stack = [], [(a, b)]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += zip(x[0].children, x[1].children)
    return out


def _in_order(a: list[Shape], b: list[Shape]) -> list[tuple[int, int]]:
    """Places of children that are paired in order: the next one with the same label and text, else the next of the label."""
    alike: dict[tuple[str, str], list[int]] = {}
    labelled: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        alike.setdefault((x.label, "\n".join(x.texts)), []).append(j)
        labelled.setdefault(x.label, []).append(j)
    out, after = [], 0
    for i, x in enumerate(a):
        for places in (alike.get((x.label, "\n".join(x.texts)), []), labelled.get(x.label, [])):
            k = bisect.bisect_left(places, after)
            # a like text far ahead would leave all between unpaired: take it only within what is left to pair
            if k < len(places) and places[k] - after <= max(8, len(b) - len(a)):
                out.append((i, places[k]))
                after = places[k] + 1
                break
    return out


def _like(seed: Shape, page: Shape, n_matched: int) -> bool:
    """Whether a seed matches a page: by half of their mean size."""
    return n_matched >= ALIKE * (seed.size + page.size) / 2


class Wrapper:
    """The layouts of a host: seed trees, whose nodes are numbered through, and their constant texts by hash."""

    def __init__(self, seeds: list[Shape], constants: set[tuple[int, int]] = frozenset()):
        self.seeds, self.constants = seeds, constants
        number = 0
        for seed in seeds:
            stack = [seed]
            while stack:
                s = stack.pop()
                s.number = number
                number += 1
                stack += reversed(s.children)

    @classmethod
    def of_sample(cls, pages: list[str]) -> Wrapper:
        """Seeds from some pages: largest first, each page that no seed matches."""
        seeds: list[Shape] = []
        for s in sorted((shape(parse(p))[0] for p in pages), key=lambda s: -s.size):
            if not any(_like(seed, s, matched(seed, s)[0]) for seed in seeds):
                seeds.append(s)
        return cls(seeds)

    def dumps(self) -> str:
        """Labels and numbers of children, parents first; texts are not kept."""
        out = []
        for seed in self.seeds:
            stack = [seed]
            while stack:
                s = stack.pop()
                out.append([s.label, len(s.children)])
                stack += reversed(s.children)
        return json.dumps(out)

    @classmethod
    def loads(cls, text: str, constants=()) -> Wrapper:
        seeds: list[Shape] = []
        open_: list[list] = []  # nodes that lack children, and how many
        for label, n in json.loads(text):
            s = Shape(label, [], [])
            if open_:
                open_[-1][0].children.append(s)
                open_[-1][1] -= 1
            else:
                seeds.append(s)
            if n:
                open_.append([s, n])
            while open_ and not open_[-1][1]:
                open_.pop()[0].close()
        return cls(seeds, set(constants))

    def aligned(self, root: Node) -> tuple[dict[int, Shape], dict[int, int], bool]:
        """The shape node of each tree node by id(), the seed node's number of each shape node by id(), and whether any seed matches.

        The nearest seed is the one with the most nodes matched among those that match, else among all.
        """
        mine, of = shape(root)
        told = [(_like(seed, mine, n), n, pairs) for seed in self.seeds for n, pairs in [matched(seed, mine)]]
        like, _, pairs = max(told, key=lambda x: x[:2], default=(False, 0, []))
        return of, {id(b): a.number for a, b in pairs}, like

    def held(self, source: str, strict: bool = False) -> list[tuple[int, int, int]] | None:
        """(seed node, hash of the text, its length) of all the page's matched nodes with text; node -1 for unmatched ones.

        None, if strict, for a page that no seed matches.
        """
        of, number, like = self.aligned(parse(source))
        if strict and not like:
            return None
        nodes = {id(s): s for s in of.values() if s.texts}
        return [(number.get(k, -1), s.text_hash(), sum(map(len, s.texts))) for k, s in nodes.items()]


def induced(pages: list[str], share: float = 0.8, least: int = 4) -> Wrapper:
    """The wrapper of these pages; wrappers() does the same over a table."""
    pages = list(dict.fromkeys(pages))
    wrapper = Wrapper.of_sample(pages)
    held = [wrapper.held(p) for p in pages]
    on_node = Counter(k for nodes in held for k, *_ in nodes)
    with_text = Counter((k, h) for nodes in held for k, h, _ in nodes)
    agreed = {(k, h) for (k, h), n in with_text.items() if k >= 0 and n >= least and n >= share * on_node[k]}
    longest = []
    for nodes in held:
        rest = [(n, h) for k, h, n in nodes if (k, h) not in agreed]
        longest.append(max(rest) if rest and VARYING * sum(n for n, _ in rest) >= sum(n for *_, n in nodes) else None)
    wrapper.constants = {x for x in agreed if len({b for b, nodes in zip(longest, held) if b and x in {(k, h) for k, h, _ in nodes}}) >= least}
    return wrapper


def _all_links(n: Node) -> bool:
    """Whether a list holds three or more links and no text beside them."""
    links, stack = 0, [n]
    while stack:
        x = stack.pop()
        if x.tag == "a":
            links += 1
            continue
        for k in x.parts:
            if isinstance(k, str):
                if k.strip():
                    return False
            elif not k.hidden:
                stack.append(k)
    return links >= 3


def main_text(source: str | None, wrapper: Wrapper | None, strict: bool = False) -> str | None:
    """The main text of one page, given its host's wrapper if it has one; None, if strict, for a page that the wrapper's seeds do not match."""
    if not source:
        return ""
    root = parse(source)
    constant: set[int] = set()
    if wrapper and (wrapper.constants or strict):
        of, number, like = wrapper.aligned(root)
        if strict and not like:
            return None
        hashes = {id(s): s.text_hash() for s in of.values()}
        constant = {node for node, s in of.items() if (number.get(id(s)), hashes[id(s)]) in wrapper.constants}
    regions = _regions(root, constant)
    if not regions:
        for n in [*_outermost(root, "ul"), *_outermost(root, "ol")]:
            n.hidden = n.hidden or _all_links(n)
    every = [b for r in (regions or [root]) for b in blocks(r)]
    kept = [t for n, t in every if id(n) not in constant]
    return " ".join(kept or ([t for _, t in every] if regions else []))


def _regions(root: Node, constant: set[int]) -> list[Node]:
    """The articles; or main, or the whole page (none), where that has more than twice their varying prose beside them.

    Such articles are teasers or comments, and are hidden.
    """
    articles, mains = _outermost(root, "article"), _outermost(root, "main")
    if not articles:
        return mains
    prose = lambda nodes: sum(len(t) for r in nodes for n, t in blocks(r) if id(n) not in constant and len(t.split()) >= PROSE)
    own = prose(articles)
    if prose(mains or [root]) <= 3 * own:
        return articles
    for n in articles:
        n.hidden = True
    return mains


def _outermost(root: Node, tag: str) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.hidden:
            continue
        if n.tag == tag:
            out.append(n)
        else:
            stack += [k for k in reversed(n.parts) if isinstance(k, Node)]
    return out


def host(url: Column) -> Column:
    """The host of an address in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def layouts(pages: DataFrame, sample_pages: int = 8, least: int = 4) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """(pages, seeds, nodes) of each round over pages(page_id, url, html): the pages that no seed of an earlier round matches, as (host, page_id, url, html, o);
    (host, seeds) of hosts with `least` or more distinct ones; (host, page, node, text, n_chars) of the pages that these match."""
    given = pages.select(host(F.col("url")).alias("host"), "page_id", "url", "html").withColumn("o", F.xxhash64("html"))
    rows, rounds = given.where("host is not null and html is not null and html <> ''"), []
    while True:
        distinct = rows.groupBy("host", "o").agg(F.min("page_id").alias("page_id"))
        # the distinct pages of least hash, of each range of hashes first, so that no task gets all of a host
        few = distinct.withColumn("r", F.row_number().over(Window.partitionBy("host", F.shiftright("o", 58)).orderBy("o"))).where(F.col("r") <= sample_pages)
        chosen = few.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("o"))).where(F.col("r") <= sample_pages)
        counted = chosen.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("host"))).where(F.col("n") >= least)
        chosen = written(counted.select(F.col("host").alias("h"), F.col("o").alias("k"), F.col("page_id").alias("i")), "sample")
        if chosen.isEmpty():
            return rounds
        sample = rows.join(chosen, (F.col("host") == F.col("h")) & (F.col("o") == F.col("k")) & F.col("page_id").eqNullSafe(F.col("i")), "left_semi").select("host", "html", "o")
        seeds = written(sample.groupBy("host").applyInPandas(_seeded, "host string, seeds string"), "seeds")
        kind = rows.schema["page_id"].dataType.simpleString()
        joined = rows.join(seeds.withColumnRenamed("host", "h"), F.col("host") == F.col("h")).select("host", "o", "html", "seeds", "page_id", "url")
        met = written(joined.mapInArrow(_met, f"host string, page long, node int, text long, n_chars int, page_id {kind}, url string, html string"), "met")
        nodes = written(met.where("node is not null").select("host", "page", "node", "text", "n_chars").distinct(), "nodes")
        rounds.append((rows, seeds, nodes))
        # a seed matches itself, so pages grow fewer
        rows = met.where("node is null and html is not null").select("host", "page_id", "url", "html", F.col("page").alias("o"))


def _seeded(group: pd.DataFrame) -> pd.DataFrame:
    one_of_each = group.drop_duplicates("o").sort_values("o")
    return pd.DataFrame({"host": [group["host"].iloc[0]], "seeds": [Wrapper.of_sample(one_of_each["html"].tolist()).dumps()]})


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each page that the seeds match, and all of each page that they do not."""
    for whole in batches:
        kept = pa.schema([("host", pa.string()), ("page", pa.int64()), ("node", pa.int32()), ("text", pa.int64()), ("n_chars", pa.int32()), ("page_id", whole.column(4).type), ("url", pa.string()), ("html", pa.string())])
        for at in range(0, whole.num_rows, 500):
            out: list[tuple] = []
            for name, o, html, known, page_id, url in zip(*(c.to_pylist() for c in whole.slice(at, 500).columns)):
                nodes = _loaded(known).held(html, strict=True)
                out += [(name, o, None, None, None, page_id, url, html)] if nodes is None else [(name, o, *x, None, None, None) for x in nodes]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 8, kept)], schema=kept)


def constants(seen: DataFrame, share: float = 0.8, least: int = 4) -> DataFrame:
    """(host, round, constants array<struct<node, text>>) of seen(host, round, page, node, text, n_chars), for hosts that have constants in a round."""
    by = ["host", "round"]
    texts = seen.where("node >= 0").groupBy(*by, "node", "text").agg(F.count(F.lit(1)).alias("n"))
    on_node = texts.groupBy(*by, "node").agg(F.sum("n").alias("n_node"), F.max(F.struct("n", "text")).alias("most"))
    agreed = on_node.where((F.col("most.n") >= least) & (F.col("most.n") >= share * F.col("n_node"))).select(*by, "node", F.col("most.text").alias("text"))
    agreed = written(agreed, "agreed")
    # what else the pages hold: of each, the longest block that is not agreed on; template are texts of pages that differ in it
    marked = seen.join(agreed.withColumn("is_agreed", F.lit(True)), [*by, "node", "text"], "left")
    other = F.col("is_agreed").isNull()
    rest = marked.groupBy(*by, "page").agg(F.max(F.when(other, F.struct("n_chars", "text"))).alias("rest"), F.sum(F.when(other, F.col("n_chars")).otherwise(0)).alias("n_rest"), F.sum("n_chars").alias("n_all"))
    pages_of = marked.where("is_agreed").join(rest.where(VARYING * F.col("n_rest") >= F.col("n_all")), [*by, "page"]).where("rest is not null")
    constant = pages_of.select(*by, "node", "text", "rest").distinct().groupBy(*by, "node", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return constant.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("constants"))


@lru_cache(maxsize=64)
def _loaded(seeds: str, constants: tuple[tuple[int, int], ...] = ()) -> Wrapper:
    return Wrapper.loads(seeds, constants)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page; none of a page that the seeds do not match, if a later round has it."""
    for whole in batches:
        for at in range(0, max(1, whole.num_rows), 500):
            b = whole.slice(at, 500)
            texts = []
            for html, seeds, constants, goes_on in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5))):
                wrapper = _loaded(seeds, tuple((c["node"], c["text"]) for c in constants or ())) if seeds else None
                text = main_text(html, wrapper, strict=True)
                texts.append(main_text(html, None) if text is None and not goes_on else text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extracted(pages: DataFrame, sample_pages: int = 8, share: float = 0.8, least: int = 4) -> DataFrame:
    """(page_id, url, text): the main text of each page."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rounds = layouts(rows, sample_pages, least)
    out, kind = [], f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
    if rounds:
        seen = reduce(DataFrame.unionByName, [nodes.withColumn("round", F.lit(i)) for i, (_, _, nodes) in enumerate(rounds)])
        known = written(constants(seen, share, least), "constants")
        last = written(known.groupBy("host").agg(F.max("round").alias("last")), "last")
    for i, (held, seeds, _) in enumerate(rounds):
        # hosts with constants in this round or a later one; pages of the others meet no seeds
        own = seeds.join(last.where(F.col("last") >= i), "host").join(known.where(F.col("round") == i).select("host", "constants"), "host", "left")
        # a written table, whose size is known, so that pages are not shuffled to meet a few wrappers
        own = written(own.select(F.col("host").alias("h"), "seeds", "constants", (F.col("last") > i).alias("goes_on")), "wrappers")
        met = held.join(own, F.col("host") == F.col("h")) if i else rows.join(own, host(F.col("url")) == F.col("h"), "left")
        out.append(met.select("page_id", "url", "html", "seeds", "constants", "goes_on").mapInArrow(_read, kind).where("text is not null"))
    if not rounds:
        none = F.lit(None)
        out = [rows.select("page_id", "url", "html", none.cast("string"), none.cast("array<struct<node:int,text:bigint>>"), F.lit(False)).mapInArrow(_read, kind)]
    return reduce(DataFrame.unionByName, out)


def op8_html(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html gives an empty text; pages without a host have no template; null ids and repeated rows are kept. An
    empty table gives no rows.
    """
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
