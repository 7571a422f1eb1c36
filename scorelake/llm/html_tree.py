"""Main text of web pages by a tree-structured graphical model.

A page becomes a DOM tree whose nodes are its elements and its runs of text. Each node has a hidden label
(boilerplate, content, or a mixture of both below it); parent-child potentials tie labels along the
tree's edges, and what is seen at a node speaks for its label: its tag, words of class and id, share of links, length, sentence ends,
place on the page, siblings of the same shape, and a heading that says nothing but what its section is, as those of comments do in many languages.
Sum-product messages go up and down once and give each text run's exact content marginal; runs above the
threshold are the main text.

The potentials are smoothed counts over labelled pages. Labelled pages are given as (html, test of a node's
text) pairs; `training_pages` makes them from a seed, and callers can give their own.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import map_batches

BOILER, CONTENT, MIXED = 0, 1, 2
THRESHOLD = 0.5
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "title", "textarea", "noscript", "iframe", "xmp")
#: Parsed like others, but nothing in them is shown.
HIDES = ("template", "svg", "object", "select")
UNSEEN = frozenset([*RAW, *HIDES, "head"])
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "dd", "dt", "li", "summary"}
#: An element of the key is closed by a start tag of the values; the search stops at the third.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
#: Start tags that end an open svg, besides those of blocks.
ENDS_SVG = BLOCK | frozenset("b big br code em embed hr i img meta nobr ruby s small span strong strike sub sup tt u var".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPLIT_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACES = re.compile(r"\s+")
#: Words of class, id and role that say what an element is for.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar tabs pager pagination skip toc sitemap menue navigationsleiste navegacion fil",
    "head": "header masthead banner branding logo hero top",
    "foot": "footer foot copyright legal bottom colophon fusszeile impressum pied mentions pie",
    "side": "sidebar side aside widget widgets related recommended recommendations popular trending more complementary rail seitenleiste randspalte barre laterale lateral",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay subscribe newsletter signup paywall promo toast message warning hinweis datenschutz anmeldung aviso",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors dfp adsense banner promotion werbung anzeige anzeigen publicite pub publicidad anuncio anuncios",
    "form": "form search login register contact input suche formular recherche formulaire buscar formulario",
    "talk": "comment comments reply replies discussion disqus respond response responses feedback thread reviews kommentar kommentare antworten diskussion commentaire commentaires avis reponses comentario comentarios opiniones respuestas commenti reacties",
    "meta": "meta byline share sharing social tags author date time credits",
    "main": "article content post entry story main body text maincontent blog news document page prose lead single",
}
#: What short texts of boilerplate say: words, in several languages.
TELLS = {
    "talk": "comments comment replies discussion kommentare kommentar antworten commentaires commentaire réponses comentarios comentario respuestas opiniones commenti reacties",
    "foot": "copyright © rights reserved rechte vorbehalten impressum droits réservés mentions derechos reservados diritti",
    "side": "related recommended popular trending ähnliche beliebt empfohlen lire aussi relacionados destacados",
    "notice": "cookies cookie newsletter abonnieren datenschutz abonnez inscrivez suscríbete consentimiento subscribe",
    "form": "search login suche anmelden recherche connexion buscar contraseña password",
    "ad": "advertisement sponsored werbung anzeige publicité publicidad anuncio",
}
_TELL_OF = {word: kind for kind in reversed(TELLS) for word in TELLS[kind].split()}
MOST_SEEN = 100_000
#: What can be a section's heading, and what is never named by its first words.
TITLES = frozenset("h2 h3 h4 h5 h6 b strong legend summary dt label caption".split())
WHOLES = frozenset("article main body html".split())
_LETTERS = re.compile(r"©|[^\W\d_]+")
_STOPS = re.compile(r"[.!?…。](?=[\s\"'”»)]|$)")
_HINT_OF = {word: kind for kind in reversed(HINTS) for word in HINTS[kind].split()}
_HINT_ORDER = {kind: i for i, kind in enumerate(("talk", "ad", "notice", "form", "side", "menu", "foot", "meta", "head", "main"))}
_HEADINGS = {f"h{i}": "h" for i in range(1, 7)}


@dataclass
class Node:
    tag: str
    parent: int
    hint: str = ""
    text: list[str] = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    block: int = 0
    stops: int = 0
    #: What its heading says it is, siblings of the same shape, and characters of the page before the node and in all.
    lead: str = ""
    alike: int = 0
    #: Whether a heading of the page's highest rank stands in it.
    heads: bool = False
    #: Whether its parent is all links as well, which then says so for both; whether it is in an article or another part of the page with such a heading.
    within: bool = False
    under: bool = False
    #: Whether the page has a heading.
    headed: bool = False
    before: int = 0
    whole: int = 0


def _lead(text: str) -> str:
    """The sort of boilerplate that a text names, if at least half of its words do so."""
    found = _LETTERS.findall(text.lower()) if len(text) <= 200 else []
    told = [_TELL_OF[w] for w in found if w in _TELL_OF]
    return told[0] if 2 * len(told) >= len(found) and told else ""


def _same_shapes(nodes: list[Node]) -> None:
    """Put into `alike` how many of its siblings have an element's tag and children's tags (0 to 3), where it has children of two tags or
    more; what has none of its own takes its parent's.
    """
    kids: list[list[str]] = [[] for _ in nodes]
    for n in nodes[1:]:
        if n.tag != "#" and (not kids[n.parent] or kids[n.parent][-1] != n.tag):
            kids[n.parent].append(n.tag)
    shapes = [(n.parent, n.tag, *sorted(set(kids[i]))) for i, n in enumerate(nodes)]
    counts = Counter(x for x in shapes if len(x) > 3)
    for i, n in enumerate(nodes):
        n.alike = min(3, counts[shapes[i]] - 1) if counts[shapes[i]] > 1 else nodes[n.parent].alike if i else 0


@lru_cache(maxsize=4096)
def _hint(attributes: str) -> str:
    found = set()
    for m in _ATTR.finditer(attributes):
        for word in _WORD.findall(_SPLIT_CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()):
            if word in _HINT_OF:
                found.add(_HINT_OF[word])
    if _HIDDEN.search(attributes):
        found.add("ad")
    return min(found, key=_HINT_ORDER.__getitem__, default="")


def parse(page: str) -> list[Node]:
    """Elements and text runs in page order, parents before children. Node 0 is the root.

    Text runs have the tag '#'; `block` numbers the block of text that a run belongs to.
    """
    nodes = [Node("html", -1)]
    stack, n_block = [0], 0
    open_: Counter = Counter()
    in_link = in_hidden = 0
    run = -1
    at, end = 0, len(page)
    lower = None

    def close_to(depth: int) -> None:
        nonlocal n_block, run, in_link, in_hidden
        for i in stack[depth:]:
            if nodes[i].tag in BLOCK:
                n_block += 1
                run = -1
            open_[nodes[i].tag] -= 1
            in_link -= nodes[i].tag == "a"
            in_hidden -= nodes[i].tag in HIDES
        del stack[depth:]

    def text(raw: str) -> None:
        nonlocal run
        if not raw or in_hidden:
            return
        shown = html.unescape(raw) if "&" in raw else raw
        if run < 0 or nodes[run].block != n_block:
            if not shown.strip():
                if run < 0 and nodes and nodes[-1].tag == "#" and nodes[-1].block == n_block:
                    nodes[-1].text.append(" ")
                return
            run = len(nodes)
            nodes.append(Node("#", stack[-1], block=n_block))
        nodes[run].text.append(shown)
        n = len(shown.strip())
        nodes[run].chars += n
        nodes[run].linked += n if in_link else 0

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br" or tag == "p" and not open_["p"]:
                run = run if tag == "br" else -1
                n_block += tag == "p"
                continue
            if not open_[tag]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                other = nodes[stack[depth]].tag
                if other == tag:
                    close_to(depth)
                    break
                if other == "template":
                    break
                if tag in HIDES:
                    continue
                if other in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "div") or (other in BLOCK and tag not in BLOCK):
                    break
            continue
        if in_hidden:
            for depth in range(len(stack) - 1, 0, -1):
                other = nodes[stack[depth]].tag
                if other == "svg" and tag in ENDS_SVG or other == "select" and (tag in BLOCK or tag in ("select", "input", "textarea")):
                    close_to(depth)
                elif other in ("template", "foreignobject"):
                    break
            if open_["svg"] and (m[3] or "").endswith("/"):
                continue
        if tag == "br" or tag == "hr":
            n_block += tag == "hr"
            if tag == "hr":
                run = -1
            elif run >= 0:
                nodes[run].text.append(" ")
            continue
        if tag == "html" or tag == "body" and open_["body"]:
            continue
        if tag in RAW:
            if lower is None:
                lower = page.lower()
            stop = lower.find(f"</{tag}", at)
            at = end if stop < 0 else (lower.find(">", stop) + 1 or end)
            continue
        if tag in VOID:
            continue
        if tag in HIDES:
            if lower is None:
                lower = page.lower()
            # A template or object that is never closed hides nothing; start tags end the other two.
            if tag == "svg" and (m[3] or "").endswith("/") or tag in ("template", "object") and lower.find(f"</{tag}", at) < 0:
                continue
        if tag in ENDS_P and open_["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == "p":
                    close_to(depth)
                    break
                if nodes[stack[depth]].tag in BLOCK:
                    break
        if tag in CLOSED_BY:
            closes, stops = CLOSED_BY[tag]
            for depth in range(len(stack) - 1, 0, -1) if any(open_[c] for c in closes) else ():
                if nodes[stack[depth]].tag in closes:
                    close_to(depth)
                elif nodes[stack[depth]].tag in stops:
                    break
        if tag in BLOCK:
            n_block += 1
            run = -1
        nodes.append(Node(tag, stack[-1], _hint(m[3] or "")))
        stack.append(len(nodes) - 1)
        open_[tag] += 1
        in_link += tag == "a"
        in_hidden += tag in HIDES
        run = -1 if tag in BLOCK else run
    so_far, titles = 0, []
    for i, node in enumerate(nodes):
        node.before = so_far
        if node.tag == "#" and node.chars:
            shown = "".join(node.text)
            node.stops = len(_STOPS.findall(shown))
            titles.append((i, so_far, _lead(shown.strip())))
            so_far += node.chars
    top = min((n.tag for n in nodes if n.tag in _HEADINGS), default="h1")
    for i in range(len(nodes) - 1, 0, -1):
        node, up = nodes[i], nodes[nodes[i].parent]
        node.whole = so_far
        up.chars += node.chars
        up.linked += node.linked
        up.stops += node.stops
        up.heads |= node.heads or node.tag == top
    nodes[0].whole = so_far
    for i, before, lead in titles:
        node, at = nodes[i], nodes[i].parent
        if not lead or nodes[at].tag == top:
            continue
        node.lead, title = lead, nodes[at].tag in TITLES
        # A heading names what it is the first text of, but neither an article nor what holds half of the page.
        while at > 0 and title and nodes[at].before == before and nodes[at].tag not in WHOLES and 2 * nodes[at].chars < so_far:
            nodes[at].lead, at = lead, nodes[at].parent
    for node in nodes:
        node.headed = nodes[0].heads
    for node in nodes[1:]:
        up = nodes[node.parent]
        node.within = up.chars > 0 and up.linked == up.chars
        # Where no heading says which part of the page is meant, it is the one with most of the text.
        meant = up.heads and up.tag != "header" if node.headed else 2 * up.chars - 2 * up.linked >= so_far and up.tag not in ("html", "body")
        node.under = up.under or up.tag in ("article", "main") or meant and up.chars < so_far
    _same_shapes(nodes)
    return nodes


def _in_head(nodes: list[Node]) -> list[bool]:
    out = [False] * len(nodes)
    for i, n in enumerate(nodes):
        out[i] = n.tag in UNSEEN or (n.parent >= 0 and out[n.parent])
    return out


def _seen(node: Node) -> tuple:
    tag = _HEADINGS.get(node.tag, node.tag)
    if tag not in _KNOWN_TAGS:
        tag = "other"
    links = 4 if node.within else 0 if not node.linked else 1 if node.linked * 4 < node.chars else 2 if node.linked * 4 < 3 * node.chars else 3
    size = min(5, max(0, node.chars.bit_length() - 2) // 2)
    stops = 0 if not node.stops else 1 if node.stops < 3 else 2
    begins = 0 if not node.before else 1 + min(3, 4 * node.before // max(1, node.whole))
    ends = node.before + node.chars == node.whole
    return tag, node.hint, links, node.lead, (size, stops), (begins, ends), (node.alike, begins > 0), (node.heads, node.under, node.headed)


#: How much each thing seen beside the tag counts. Length and place say little by themselves, and a node's say much the same as its parent's.
WEIGHTS = (1.0, 0.5, 0.4, 0.3, 0.3, 0.3, 0.6)
_KNOWN_TAGS = frozenset("# html body div p h a li ul ol nav aside footer header form article main section span b i em strong table tr td blockquote pre button label address figure figcaption dl dd dt".split())


@dataclass
class TreeModel:
    """Potentials: start[label], edges[child's tag][parent's label][label], and counts by label of tags and of
    each further thing seen, alone and with the tag; evidence() smooths the latter by the former.
    """

    start: list[float]
    edges: dict
    tags: dict
    views: list[dict]
    totals: list[int]
    smooth: float
    _memo: dict = field(default_factory=dict, repr=False)

    def evidence(self, node: Node) -> tuple[float, float, float]:
        if not node.chars:
            return 1.0, 1.0, 1.0
        seen = _seen(node)
        known = self._memo.get(seen)
        if known is None:
            tag, *values = seen
            n_tag, p = self.tags.get(tag, (0, 0, 0)), [1.0, 1.0, 1.0]
            for view, weight, value in zip(self.views, WEIGHTS, values, strict=True):
                overall, own = view.get(value, (0, 0, 0)), view.get((tag, value), (0, 0, 0))
                for k in range(3):
                    general = (overall[k] + self.smooth) / (self.totals[k] + self.smooth * 12)
                    p[k] *= ((own[k] + 2 * general) / (n_tag[k] + 2)) ** weight
            most = max(p)
            if len(self._memo) > MOST_SEEN:
                self._memo.clear()
            known = self._memo[seen] = tuple(max(x / most, 1e-6) for x in p)
        return known

    def marginals(self, nodes: list[Node]) -> list[tuple[float, float, float]]:
        """The labels' probabilities at every node, by one sweep up and one down."""
        n = len(nodes)
        up = [self.evidence(x) for x in nodes]
        belief = [list(x) for x in up]
        message: list = [None] * n
        edges = [self.edges.get(_seen(x)[0], self.edges["other"]) for x in nodes]
        for i in range(n - 1, 0, -1):
            b0, b1, b2 = belief[i]
            m = [e[0] * b0 + e[1] * b1 + e[2] * b2 for e in edges[i]]
            total = m[0] + m[1] + m[2]
            message[i] = m = [x / total for x in m]
            own = belief[nodes[i].parent]
            for k in range(3):
                own[k] *= m[k]
            total = own[0] + own[1] + own[2]
            for k in range(3):
                own[k] = max(own[k] / total, 1e-30)
        out: list = [None] * n
        first = [b * s for b, s in zip(belief[0], self.start, strict=True)]
        total = sum(first)
        out[0] = tuple(x / total for x in first)
        for i in range(1, n):
            above, e = out[nodes[i].parent], edges[i]
            # What the parent believes without this child's message.
            rest = [a / max(m, 1e-30) for a, m in zip(above, message[i], strict=True)]
            p = [belief[i][k] * (rest[0] * e[0][k] + rest[1] * e[1][k] + rest[2] * e[2][k]) for k in range(3)]
            total = p[0] + p[1] + p[2]
            out[i] = (p[0] / total, p[1] / total, p[2] / total)
        return out

    def extract(self, page: str) -> str:
        nodes = parse(page)
        p, hidden = self.marginals(nodes), _in_head(nodes)
        blocks: dict[int, list[str]] = {}
        for i, node in enumerate(nodes):
            if node.tag == "#" and not hidden[i] and p[i][CONTENT] >= THRESHOLD:
                blocks.setdefault(node.block, []).append("".join(node.text))
        made = (_SPACES.sub(" ", "".join(parts)).strip() for parts in blocks.values())
        return "\n".join(b for b in made if b)


def fit(pages: Iterable[tuple[str, Callable[[str], bool]]], smooth: float = 0.5) -> TreeModel:
    """Count labels, label pairs along edges and what is seen with each label.

    A text run's label is the test's answer for its text; an element's follows from the runs below it: all
    content, none, or both. Elements without text say nothing.
    """
    start, pairs = [smooth] * 3, {tag: [[0.0] * 3 for _ in range(3)] for tag in [*_KNOWN_TAGS, "other"]}
    tags: Counter = Counter()
    views: list[Counter] = [Counter() for _ in WEIGHTS]
    for page, is_content in pages:
        nodes = parse(page)
        below = [[0, 0] for _ in nodes]
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].tag == "#":
                below[i][is_content("".join(nodes[i].text))] += 1
            if i:
                for k in (0, 1):
                    below[nodes[i].parent][k] += below[i][k]
        label = [MIXED if no and yes else CONTENT if yes else BOILER for no, yes in below]
        for i, node in enumerate(nodes):
            if not any(below[i]):
                continue
            if i:
                pairs[_seen(node)[0]][label[node.parent]][label[i]] += 1
            else:
                start[label[0]] += 1
            tag, *values = _seen(node)
            tags[tag, label[i]] += 1
            for view, value in zip(views, values, strict=True):
                view[value, label[i]] += 1
                view[(tag, value), label[i]] += 1
    unit = lambda row: [x / sum(row) for x in row]
    general = [unit([smooth + sum(rows[a][b] for tag, rows in pairs.items() if tag != "#") for b in range(3)]) for a in range(3)]
    edges = {tag: [unit([rows[a][b] + 4 * general[a][b] for b in range(3)]) for a in range(3)] for tag, rows in pairs.items()}
    for row in edges["#"]:
        row[MIXED] = 0.0
    by_label = lambda counted: {x: tuple(counted[x, k] for k in range(3)) for x, _ in list(counted)}
    totals = [sum(n for (_, b), n in tags.items() if b == k) for k in range(3)]
    return TreeModel(unit(start), edges, by_label(tags), [by_label(v) for v in views], totals, smooth)


#: Marks the content of training pages: a text holds it or is boilerplate.
_MARK = "⁠"


def training_pages(n: int = 900, seed: int = 11) -> list[tuple[str, Callable[[str], bool]]]:
    """Labelled pages in the layouts that pages use: articles in article, main or div elements, beside every sort of boilerplate."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuv") for _ in range(rnd.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        left, made = rnd.randint(a, b), []
        while left > 0:
            made.append(words(n := min(left, rnd.randint(1, 18)), n).capitalize())
            left -= n
        return ". ".join(made)

    plain = lambda a, b: f"<p>{sentences(a, b)}.</p>" if rnd.random() < 0.6 else f"{sentences(a, b)}."
    hinted = lambda kind: rnd.choice([w for w in HINTS[kind].split() if _HINT_OF[w] == kind])
    # Half of the short texts of boilerplate say what they are; now and then content has such a word, too.
    tell = lambda kind, n: " ".join([rnd.choice(TELLS[kind].split()).capitalize(), words(0, n) if rnd.random() < 0.6 else ""]).strip() if rnd.random() < 0.6 else words(1, n + 1)

    def named(kind: str, tags: str) -> tuple[str, str]:
        tag = rnd.choice(tags.split())
        hint = f' {rnd.choice(("class", "id"))}="{hinted(kind)}"' if tag in ("div", "section", "ul", "p", "span", "ol") or rnd.random() < 0.4 else ""
        if hint and rnd.random() < (0.65 if kind == "main" else 0.25):
            hint = rnd.choice(["", f' class="{word()}"'])
        return f"<{tag}{hint}>", f"</{tag}>"

    def wrap(kind: str, tags: str, inner: str) -> str:
        a, b = named(kind, tags)
        return a + inner + b

    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rnd.randint(a, b)))
    boiler = {
        "menu": lambda: wrap("menu", "nav nav nav div ul", plain(1, 9) if rnd.random() < 0.2 else f"<ul>{links(2, 9)}</ul>" if rnd.random() < 0.7 else " | ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(5))),
        "head": lambda: wrap("head", "header header div", rnd.choice([f"<h1>{words(1, 4)}</h1>", f"<a href='/'>{words(1, 3)}</a>", f"<p>{words(2, 8)}</p>", f"<h2>{words(1, 4)}</h2><p>{words(3, 9)}</p>"])),
        "foot": lambda: wrap("foot", "footer footer footer div", rnd.choice([f"&copy; {words(1, 3)} &middot; {sentences(3, 12)}.", f"<p>{tell('foot', 4)} {rnd.randint(1995, 2026)}</p>", plain(4, 30), f"<ul>{links(2, 5)}</ul>{words(2, 5)}"])),
        "side": lambda: wrap("side", "aside aside div section", rnd.choice([f"<h3>{tell('side', 3)}</h3><ul>{links(2, 6)}</ul>", plain(5, 50), f"<h3>{tell('side', 2)}</h3><p>{words(8, 40)}.</p>"])),
        "notice": lambda: wrap("notice", "div div section", (f"<p>{tell('notice', 3)} {words(3, 20)}.</p>" if rnd.random() < 0.4 else plain(5, 40)) + (f"<button>{word()}</button>" if rnd.random() < 0.5 else "")),
        "ad": lambda: wrap("ad", "div div section aside", plain(2, 30)),
        "form": lambda: f"<form>{words(1, 4)}<label>{words(1, 3)}</label><input name=q><button>{word()}</button>{plain(3, 12)}</form>",
        "talk": lambda: wrap("talk", "section div ol", f"<h3>{tell('talk', 1)}</h3>" + "".join(wrap("talk", "div article li", f"<p>{words(3, 60)}.</p>") if rnd.random() < 0.7 else f"<p>{word().capitalize()}: {words(2, 40)}.</p>" for _ in range(rnd.randint(1, 5)))),
        "meta": lambda: wrap("meta", "div p span", words(2, 6)),
        "replies": lambda: replies(),
        "cards": lambda: f"<div><h3>{words(1, 4)}</h3><ul>" + "".join(f"<li>{words(2, 7)}</li>" for _ in range(rnd.randint(2, 6))) + "</ul></div>",
    }

    def replies() -> str:
        """Comments without a heading or a name: who, when and what, several times."""
        who, when = rnd.choice(["b", "strong", "cite", "h4", "a", "span"]), rnd.choice(["span", "time", "small", "em", "i"])
        one = lambda: f"<{who}>{words(1, 2).title()}</{who}> <{when}>{words(1, 3)} {rnd.randint(1, 30)} {words(0, 1)}</{when}>"
        tag = rnd.choice(["div", "li", "div"])
        made = "".join(f"<{tag}>{one()}<p>{sentences(3, 50)}.</p></{tag}>" for _ in range(rnd.randint(2, 6)))
        return made if tag == "div" and rnd.random() < 0.5 else f"<{'ol' if tag == 'li' else 'div'}>{made}</{'ol' if tag == 'li' else 'div'}>"

    def text(a: int, b: int) -> str:
        made = sentences(a, b)
        cut = rnd.random()
        if cut < 0.2:
            made += f' <a href="/{word()}">{_MARK}{words(1, 3)}</a> {words(1, 9)}'
        elif cut < 0.3:
            return f"<b>{_MARK}{made}<br>"
        elif cut < 0.4:
            made += f" <em>{_MARK}{words(1, 4)}</em> {words(2, 9)}"
        return _MARK + (made if rnd.random() > 0.02 else f"{rnd.choice(sorted(_TELL_OF))} {made}")

    # Articles are about comments, cookies and rights, too.
    title = lambda a, b: _MARK + (words(a, b) if rnd.random() < 0.85 else " ".join([rnd.choice(sorted(_TELL_OF)).capitalize(), words(0, 3)]).strip())

    def article() -> str:
        parts = [f"<{(h := rnd.choice(['h1', 'h1', 'h2']))}>{title(2, 9)}</{h}>"] if rnd.random() < 0.85 else []
        if parts and rnd.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(rnd.choice([0, 1, 2, 4, 7, 10, 25])):
            x = rnd.random()
            if x < 0.66:
                parts.append(f"<p>{text(1, rnd.choice([6, 20, 90, 90, 400]))}.</p>")
            elif x < 0.72:
                h = rnd.choice(["h2", "h3"])
                part = f"<{h}>{title(1, 6)}</{h}>"
                if rnd.random() < 0.4:
                    part = "".join(f"<section>{part}<p>{text(5, 90)}.</p></section>" for _ in range(rnd.randint(1, 3)))
                parts.append(part)
            elif x < 0.84:
                linked = rnd.random() < 0.5
                item = lambda: f'<a href="/{word()}">{_MARK}{words(1, 6)}</a>' if linked else _MARK + words(1, 20)  # noqa: B023, E731
                parts.append("<ul>" + "".join(f"<li>{item()}</li>" for _ in range(rnd.randint(1, 7))) + "</ul>")
            elif x < 0.88:
                parts.append(f"<blockquote><p>{text(3, 30)}</p></blockquote>")
            elif x < 0.91:
                parts.append(f"<pre>{_MARK}{words(3, 20)}</pre>")
            elif x < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{_MARK}{words(1, 4)}</td><td>{_MARK}{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(boiler[rnd.choice(["ad", "meta", "side", "form", "notice", "talk", "talk"])]())
        tag = rnd.choice(["article"] * 5 + ["main", "main"] + ["div"] * 5 + ["section"])
        inner = "".join(parts)
        if tag in ("div", "section") or rnd.random() < 0.2:
            a, b = named("main", tag)
        else:
            a, b = f"<{tag}>", f"</{tag}>"
        made = a + inner + b
        return f"<main>{made}</main>" if tag != "main" and rnd.random() < 0.2 else made

    pages = []
    for _ in range(n):
        before = [boiler[k]() for k in rnd.sample(["menu", "head", "ad", "notice", "form", "side"], rnd.randint(0, 4))]
        after = [boiler[k]() for k in rnd.sample(["foot", "talk", "side", "ad", "form", "notice", "menu", "replies", "cards"], rnd.randint(0, 5))]
        body = "".join([*before, article(), *after])
        if rnd.random() < 0.3:
            body = f'<div class="{rnd.choice(["wrapper", "container", "row", "layout"])}">{body}</div>'
        if rnd.random() < 0.06:
            body = "".join(before) + "".join(f"<p>{text(8, 60)}.</p>" for _ in range(3)) + "".join(after)
        if rnd.random() < 0.03:
            pages.append((_MARK + words(3, 60), lambda t: _MARK in t))
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{body}</body></html>", lambda t: _MARK in t))
    return pages


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    """Fitted on training_pages(), whose number is its bound."""
    return fit(training_pages())


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """pages: page_id long, url string, html string; other columns are ignored.

    Returns page_id, url, text and n_chars (its code points) for each row. Null, empty and text-free pages
    give the empty text. Broken markup is read as browsers do: what is open is closed. Pages are worked off
    one by one, so repeated rows and null ids or urls just stay; an empty table gives an empty one.
    """
    # A model is a few tables of counts, by tag and by what is seen; it is fitted once, on the driver.
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [shared.value.extract(x) if x else "" for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(pages, make, "page_id long, url string, text string, n_chars long")
