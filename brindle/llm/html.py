"""Main text of HTML pages: boosted trees over DOM nodes, decoded over the tree.

A page becomes a tree of block elements; text that stands directly in a block is a leaf. Boosted trees give each
node the probability that main text lies in it. The decoding finds the likeliest labels in which no node is kept
below a dropped one, and the text of the kept leaves is the page's text.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log1p

import numpy as np
from pyspark.sql import DataFrame

from .common import mapped, own_columns, small_batches

# Fixed values of HTML: elements without content, elements in a line of text, elements that hold no page text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
SILENT = frozenset("audio button canvas datalist head iframe map math meter noframes noscript object option progress script select style svg template textarea title video".split())
#: Start tags that end an open element of these kinds, up to the border elements.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
BORDERS = frozenset("ul ol dl table tbody thead tfoot body html article section div main aside nav form".split())
NOT_IN_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)

#: Elements that a head may hold; any other, and any text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Kinds of elements, and words in class, id and role, that are features.
TAGS = ("article main", "nav menu", "header", "footer", "aside", "form fieldset legend", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody tr td th", "section", "div", "figure figcaption", "#text", "#inline")
WORDS = (
    "article content entry main post story text body artikel inhalt beitrag contenu contenido articulo",
    "nav navbar navigation menu breadcrumb breadcrumbs links toc pagination pager tabs navi menue navegacion brotkrumen",
    "header masthead banner top logo branding topbar hdr head kopfzeile kopf entete encabezado cabecera",
    "footer foot bottom copyright legal colophon contentinfo ftr fusszeile fuss impressum pie pied piedepagina",
    "sidebar aside side widget rail related recommended complementary popular trending seitenleiste randspalte sdb barra lateral",
    "ad ads advert advertisement adsense promo promoted sponsor sponsored sponsors promotion dfp werbung anzeige anzeigen reklame publicite publicidad anuncio",
    "comment comments discussion reply replies respond disqus feedback reader cmt cmts cmnt kommentar kommentare commentaire commentaires comentario comentarios",
    "cookie cookies consent notice notification alert gdpr banner popup modal overlay warning disclaimer hinweis hinweise avis aviso",
    "share social sharing follow tags meta author byline date author-bio newsletter subscribe signup login search form teilen partager compartir suche recherche buscar",
)
TAG_OF = {t: k for k, ts in enumerate(TAGS) for t in ts.split()}
WORD_OF = {w: k for k, ws in enumerate(WORDS) for w in ws.split()}
#: Long enough to be told inside a longer word: siteheader, commentlist.
INSIDE = {w: k for w, k in WORD_OF.items() if len(w) >= 6}
#: Tags that tell by themselves what an element is.
TELLING = frozenset("article main nav menu header footer aside form".split())
NAMES = (
    [f"tag {t.split()[0]}" for t in TAGS]
    + [f"word {w.split()[0]}" for w in WORDS]
    + [f"above {t.split()[0]}" for t in TAGS[:6]]
    + [f"above word {w.split()[0]}" for w in WORDS]
    + "depth text words links tags density link_share blocks paragraphs items headings ends commas digits upper mean_block longest_block page_share parent_share place siblings before after sign deep".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|xmp|noframes)\b(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+(?:/>|>)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[a-z]+", re.I)
SPACE = re.compile(r"[\s]+")


def word_kinds(word: str) -> tuple[int, ...]:
    """Kinds of an attribute's word: its own, or else those of the words inside it, however long it is."""
    word = word.lower()
    return _short_kinds(word) if len(word) < 64 else _kinds(word)


def _kinds(word: str) -> tuple[int, ...]:
    return (WORD_OF[word],) if word in WORD_OF else tuple({k for w, k in INSIDE.items() if w in word})


_short_kinds = lru_cache(maxsize=65536)(_kinds)


class Node:
    """A block element, a leaf with text, or an element in a leaf's line whose attributes tell something (#inline)."""

    __slots__ = ("tag", "parent", "children", "words", "silent", "text", "linked", "tags", "stats", "pieces")

    def __init__(self, tag: str, parent: Node | None, words: frozenset = frozenset(), silent: bool = False):
        self.tag, self.parent, self.words, self.silent = tag, parent, words, silent
        self.children: list[Node] = []
        self.text, self.linked, self.tags = "", 0, 0
        self.pieces: list[tuple[str, Node | None]] = []  # of a leaf that has children: its text in parts
        self.stats: list[float] = []


def told(attributes: str) -> tuple[frozenset, bool]:
    """What a tag's attributes tell: kinds of words, and whether the element is hidden."""
    found, hidden = set(), False
    for a in ATTRIBUTE.finditer(attributes):
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key in ("class", "id", "role"):
            found.update(k for x in PART.findall(value) for k in word_kinds(x))
        else:
            value = SPACE.sub("", value).lower()
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and ("display:none" in value or "visibility:hidden" in value)
    return frozenset(found), hidden


def parse(page: str | None) -> Node:
    """The page's tree; it takes any string. End tags without a start are ignored, missing ones are implied."""
    root = node = Node("body", None)
    open_count: dict[str, int] = {}
    run: list[tuple[str, frozenset | None]] = []
    lines: list[list] = []  # elements of a line with attributes: name, depth, words, hidden, whether it is open
    line_open: dict[str, list[list]] = {}  # of each name, those of them that may be open, innermost last
    unseen = depth = 0
    in_link = linked = tags = 0
    at, text = 0, page or ""

    def flush() -> None:
        nonlocal linked, tags
        whole = SPACE.sub(" ", "".join([t for t, _ in run])).strip()
        if whole and not node.silent:
            leaf = Node("#text", node)
            leaf.text, leaf.linked, leaf.tags = whole, min(linked, len(whole)), tags
            node.children.append(leaf)
            if any(w for _, w in run):
                before = inside = None
                for piece, words in run:
                    if words is not before:
                        inside = Node("#inline", leaf, words) if words else None
                        if inside:
                            leaf.children.append(inside)
                        before = words
                    if inside:
                        inside.text += piece
                    leaf.pieces.append((piece, inside))
                for inside in leaf.children:
                    inside.text = SPACE.sub(" ", inside.text).strip()
        run.clear()
        linked = tags = 0

    def leave(name: str | None = None) -> None:
        """End the innermost open element of a line with that name, or all that the block's end ends."""
        nonlocal unseen
        if name is not None:
            same = line_open.get(name)
            while same and not same[-1][4]:
                same.pop()  # ended with a block
            if same:
                ended = same.pop()
                unseen -= ended[3]
                ended[4] = False
        while lines and (not lines[-1][4] or name is None and lines[-1][1] > depth):
            ended = lines.pop()  # one that is ended inside another stays until the inner one ends
            unseen -= ended[3] and ended[4]
            ended[4] = False

    def close(name: str) -> None:
        nonlocal node, in_link, depth
        while node.parent is not None:
            done = node.tag
            open_count[done] -= 1
            node = node.parent
            depth -= 1
            if done == name:
                break
        in_link = 0
        leave()

    while True:
        m = TOKEN.search(text, at)
        piece = text[at : m.start() if m else len(text)]
        if piece:
            plain = entities.unescape(piece) if "&" in piece else piece
            if node.tag == "head" and not plain.isspace():
                close("head")
            if not unseen:
                run.append((plain, lines[-1][2] if lines else None))
                if in_link:
                    linked += len(plain)
        if not m:
            break
        at = m.end()
        if m["raw"]:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{m['raw']}\b[^>]*>", re.I).search(text, at)
                at = end.end() if end else len(text)
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in INLINE:
            tags += 1
            if name == "a":
                in_link = 0 if m["end"] else 1
            if m["end"]:
                leave(name)
            elif name not in VOID and m["attributes"].strip():
                words, hidden = told(m["attributes"])
                # what an element inside doesn't tell, the one around it does
                lines.append([name, depth, words or (lines[-1][2] if lines else frozenset()), hidden, True])
                line_open.setdefault(name, []).append(lines[-1])
                unseen += hidden
            continue
        if name in ("br", "wbr"):
            run.append((" " if name == "br" else "", lines[-1][2] if lines else None))
            continue
        if node.tag == "head" and name not in IN_HEAD:
            close("head")
        if name in ("html", "body") and not node.silent:
            continue
        flush()
        if m["end"]:
            if open_count.get(name):
                close(name)
            continue
        if name in NOT_IN_P and open_count.get("p") and _near(node, "p"):
            close("p")
        for old in ENDS.get(name, ()):
            if open_count.get(old) and _near(node, old):
                close(old)
        if name in VOID or m["attributes"].endswith("/") and name in SILENT:
            continue
        words, hidden = told(m["attributes"]) if m["attributes"].strip() else (frozenset(), False)
        child = Node(name, node, words, node.silent or hidden or unseen > 0 or name in SILENT)
        node.children.append(child)
        node = child
        depth += 1
        open_count[name] = open_count.get(name, 0) + 1
    flush()
    return root


def _near(node: Node, name: str) -> bool:
    """Whether the named element is open within the nearest border."""
    while node.parent is not None:
        if node.tag == name:
            return True
        if node.tag in BORDERS:
            return False
        node = node.parent
    return False


def nodes_of(root: Node) -> list[Node]:
    """Nodes that hold text, each after its parent, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    # stats: length, words, linked, tags, blocks, paragraphs, items, headings, ends, commas, digits, upper, longest, sign, deepest
    for node in reversed(order):
        if node.tag[0] == "#":
            t = node.text
            n = len(t)
            node.stats = [n, t.count(" ") + 1, node.linked, node.tags, 1, 0, 0, 0, t.count(". ") + t.count("! ") + t.count("? ") + t.endswith((".", "!", "?")), t.count(","), sum(map(t.count, "0123456789")), sum(map(str.isupper, t)), n, "©" in t or any(x in t.lower() for x in ("(c)", "copyright", "all rights reserved")), 0]
            continue
        total = [0.0] * 15
        for c in node.children:
            s = c.stats
            if s and s[0]:
                for k in range(12):
                    total[k] += s[k]
                total[12] = max(total[12], s[12])
                total[13] = total[13] or s[13]
                total[14] = max(total[14], s[14] + 1)
        total[3] += 1
        kind = TAG_OF.get(node.tag)
        total[5] += kind == 6
        total[6] += kind == 9
        total[7] += kind == 7
        node.stats = total
    return [n for n in order if n.stats[0] and not n.silent]


def features(order: list[Node]) -> tuple[np.ndarray, list[int]]:
    """A row for each node, and its parent's place (-1 for the root)."""
    place = {id(n): k for k, n in enumerate(order)}
    width = len(NAMES)
    x = np.zeros((len(order), width), np.float32)
    parents, depths = [-1] * len(order), [0] * len(order)
    base, up, upw, rest = len(TAGS), len(TAGS) + len(WORDS), len(TAGS) + len(WORDS) + 6, len(TAGS) + 2 * len(WORDS) + 6
    whole = order[0].stats[0] if order else 1
    spots = {}  # among the children with text: their number, the place, the lengths of those beside it
    for node in order:
        mates = [c for c in node.children if c.stats[0]]
        lengths = [0.0, *(c.stats[0] for c in mates), 0.0]
        for j, c in enumerate(mates):
            spots[id(c)] = len(mates), j, lengths[j], lengths[j + 2]
    for k, node in enumerate(order):
        row, s = x[k], node.stats
        tag = TAG_OF.get(node.tag)
        if tag is not None:
            row[tag] = 1
        for w in node.words:
            row[base + w] = 1
        parent_length, siblings, at, before, after = s[0], 1, 0, 0.0, 0.0
        if node.parent is not None:
            p = place[id(node.parent)]
            parents[k], depths[k] = p, depths[p] + 1
            row[up : up + 6] = np.maximum(x[p, up : up + 6], x[p, :6])
            row[upw:rest] = np.maximum(x[p, upw:rest], x[p, base:up])
            parent_length = node.parent.stats[0]
            siblings, at, before, after = spots[id(node)]
        n = s[0]
        row[rest:] = (
            depths[k], log1p(n), log1p(s[1]), log1p(s[2]), log1p(s[3]), n / (1 + s[3]), s[2] / n, log1p(s[4]), log1p(s[5]), log1p(s[6]), log1p(s[7]),
            s[8] / (1 + s[1]), s[9] / (1 + s[1]), s[10] / n, s[11] / n, log1p(n / s[4]), log1p(s[12]), n / whole, n / parent_length, at / siblings, log1p(siblings), log1p(before), log1p(after), s[13], s[14],
        )
    return x, parents


class Boosted:
    """Gradient-boosted trees of one depth for a yes or no, by histograms."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut, self.value = np.zeros((self.rounds, inner), np.int32), np.full((self.rounds, inner), np.inf, np.float32), np.zeros((self.rounds, leaves))
        margin = np.zeros(n)
        offset = np.arange(width) * self.bins
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                cell = ((at - first)[:, None] * (width * self.bins) + offset + binned).ravel()
                size = count * width * self.bins
                sums = [np.bincount(cell, np.repeat(v, width), size).reshape(count, width, self.bins).cumsum(axis=2) for v in (g, h)]
                gt, ht = sums[0][:, :, -1:], sums[1][:, :, -1:]
                gl, hl = sums[0][:, :, :-1], sums[1][:, :, :-1]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 2) | (ht - hl < 2)] = 0
                best = gain.reshape(count, -1).argmax(axis=1)
                for node in range(count):
                    f, b = divmod(int(best[node]), self.bins - 1)
                    if gain[node, f, b] > 1e-3 and b < len(cuts[f]):
                        self.feature[r, first + node], self.cut[r, first + node] = f, cuts[f][b]
                at = 2 * at + 1 + (x[np.arange(n), self.feature[r, at]] > self.cut[r, at])
            leaf = at - inner
            self.value[r] = -self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
            margin += self.value[r, leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.zeros(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


def decode(margin: list[float], parents: list[int]) -> list[bool]:
    """The likeliest labels of nodes in which no node is kept whose parent is dropped. Parents come first."""
    keep = [-log1p(np.exp(-m)) if m > -30 else m for m in margin]
    drop = [-log1p(np.exp(m)) if m < 30 else -m for m in margin]
    for k in range(len(parents) - 1, 0, -1):
        p = parents[k]
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    out = [False] * len(parents)
    for k, p in enumerate(parents):
        out[k] = (p < 0 or out[p]) and keep[k] >= drop[k]
    return out


#: A margin that no other outweighs.
SURE = 1e6
#: Parts of a page that their tag sets apart, and elements that hold an article.
APART, ARTICLE = frozenset("nav menu footer aside".split()), frozenset("article main".split())


def set_apart(order: list[Node], parents: list[int]) -> list[bool]:
    """Nodes that a tag sets apart from the main text, however short either is.

    Menus, footers and asides are; where they hold the only article or main element, the trees decide. Beside one that
    lies in none of them, so is a header that neither holds it nor lies in it.
    """
    n = len(order)
    apart, inside, holds = [False] * n, [False] * n, [False] * n
    for k, p in enumerate(parents):
        apart[k] = order[k].tag in APART or p >= 0 and apart[p]
        inside[k] = order[k].tag in ARTICLE or p >= 0 and inside[p]
    alone = not any(node.tag in ARTICLE and not a for node, a in zip(order, apart, strict=True))
    for k in range(n - 1, -1, -1):
        holds[k] = holds[k] or order[k].tag in ARTICLE and (alone or not apart[k])
        if holds[k] and parents[k] >= 0:
            holds[parents[k]] = True
    out = [False] * n
    for k, p in enumerate(parents):
        tag = order[k].tag
        mine = tag in APART and not holds[k] or tag == "header" and not alone and not inside[k] and not holds[k]
        out[k] = mine or p >= 0 and out[p]
    return out


def chosen_text(order: list[Node], kept: list[bool]) -> str:
    """The kept leaves' texts in page order, joined by one space."""
    out, gone = [], {id(n) for n, k in zip(order, kept, strict=True) if not k and n.tag == "#inline"}
    for n, k in zip(order, kept, strict=True):
        if k and n.tag == "#text":
            out.append(n.text if not n.children else SPACE.sub(" ", "".join(t for t, inside in n.pieces if id(inside) not in gone)).strip())
    return " ".join(t for t in out if t)


# --- Training: pages made from layouts, with the main text marked -------------------------------------------------


class _Writer:
    """Makes pages of many layouts whose main text is known."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = "ba ce di fo gu ha ke li mo nu pa re si to vu wa xe yo zi cha sho the ing er en lo mé ü ñ".split()

    def words(self, low: int, high: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            out.append("".join(r.choice(self.syllables) for _ in range(r.randint(1, 4))) + r.choice(("", "", "", "", "", "", "", ",", ".", ".")))
        mode = r.random()
        text = " ".join(out).capitalize()
        return text.upper() if mode < 0.04 else text + ("." if mode < 0.85 else "")

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.r.choice((" | ", " ", " · ")).join(items)

    def named(self, tags: str, words: str, inside: str, plain: float = 0.12) -> str:
        """An element that tells what it is by its tag, its attributes, both, or (seldom) nothing."""
        r = self.r
        tag, word = r.choice(tags.split()), r.choice(words.split())
        way = r.random()
        if way < 0.35 and tag in TELLING:
            return f"<{tag}>{inside}</{tag}>"
        if way < 1 - plain:
            tag = tag if way < 0.55 else "div"
            name = r.choice((word, f"{word}-{r.choice(('box', 'wrap', 'area', 'block', 'x1'))}", f"site-{word}", f"{word} u{r.randint(1, 9)}", f"page{word}" if len(word) > 5 else word))
            return f'<{tag} {r.choice(("class", "class", "id"))}="{name}">{inside}</{tag}>'
        return f"<div>{inside}</div>"

    def mark(self, text: str) -> str:
        return f"\x02{text}\x03" if text else text

    def inline(self) -> str:
        """An element in a line: part of the text, or what its attributes tell."""
        r = self.r
        if r.random() < 0.2:
            return f"<span class='{r.choice(WORDS[0].split())}'>{self.mark(self.words(1, 12))}</span>"
        return f"<{(tag := r.choice(('span', 'small', 'a', 'b')))} class='{r.choice(' '.join((WORDS[5], WORDS[6], WORDS[7], WORDS[8])).split())}'>{self.words(1, 12)}</{tag}>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.mark(self.words(2, 12))}</h1>")
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.62:
                out.append(f"<p>{self.mark(self.words(1, r.choice((3, 12, 40, 120))))}</p>" if r.random() < 0.8 else f"<p><b>{self.mark(self.words(3, 60))}<br>")
            elif kind < 0.7:
                out.append(f"<h{r.randint(2, 4)}>{self.mark(self.words(1, 8))}</h2>")
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{self.mark(self.words(1, 14))}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.80:
                out.append(f"<p>{self.mark(self.words(1, 6))}</p><ul>" + "".join(f"<li><a href='/s{k}'>{self.mark(self.words(1, 9))}</a></li>" for k in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.83:
                out.append(f"<blockquote>{self.mark(self.words(5, 40))}</blockquote>")
            elif kind < 0.86:
                out.append("<table>" + "".join(f"<tr><td>{self.mark(self.words(1, 3))}</td><td>{self.mark(self.words(1, 6))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.965:
                out.append(f"<p>{self.mark(self.words(3, 30))} {self.inline()} {self.mark(self.words(3, 30))}</p>")
            elif kind < 0.975:
                out.append(f"<p>{self.mark(self.words(3, 20))} <a href='/x'>{self.mark(self.words(1, 3))}</a> {self.mark(self.words(3, 20))}</p>")
            else:
                out.append(self.boilerplate(("advert", "share")))
        return "".join(out)

    def boilerplate(self, kinds: tuple[str, ...]) -> str:
        kind = self.r.choice(kinds)
        w, links, named = self.words, self.links, self.named
        if kind == "menu":
            return named("nav menu", WORDS[1], links(2, 9), 0.05)
        if kind == "header":
            return named("header", WORDS[2], f"<a href='/'>{w(1, 3)}</a><p>{w(1, 9)}</p>" + (links(2, 6) if self.r.random() < 0.5 else ""), 0.03)
        if kind == "footer":
            return named("footer", WORDS[3], f"{self.r.choice(('&copy; ', '&copy; ', 'Copyright 2020 ', 'All rights reserved. ', ''))}{w(1, 20)}" + (links(1, 6) if self.r.random() < 0.5 else ""), 0.05)
        if kind == "sidebar":
            return named("aside", WORDS[4], f"<h3>{w(1, 4)}</h3>" + (links(2, 9) if self.r.random() < 0.6 else f"<p>{w(3, 60)}</p>"), 0.03)
        if kind == "advert":
            return named("div", WORDS[5], f"<p>{w(2, 30)}</p>" if self.r.random() < 0.5 else w(2, 30), 0.0)
        if kind == "comments":
            if self.r.random() < 0.3:
                return named("ol ul div", WORDS[6], "".join(f"<li class='{self.r.choice(('comment', 'reply'))}'>{w(2, 60)}</li>" for _ in range(self.r.randint(1, 5))), 0.0)
            return named("section", WORDS[6], f"<h3>{w(1, 3)}</h3>" + "".join(f"<div class='{self.r.choice(('comment', 'reply', 'c'))}'><p>{w(2, 60)}</p></div>" for _ in range(self.r.randint(1, 5))), 0.0)
        if kind == "notice":
            return named("div", WORDS[7], f"<p>{w(4, 40)}</p><a href='/ok'>{w(1, 2)}</a>" if self.r.random() < 0.6 else w(4, 40), 0.0)
        if kind == "form":
            return named("form", "form search login newsletter subscribe signup", f"<label>{w(1, 4)}</label><input name=q><p>{w(2, 14)}</p>", 0.0)
        return named("div", WORDS[8], links(1, 5), 0.0)

    def page(self) -> str:
        r = self.r
        body = self.article()
        way = r.random()
        if way < 0.3:
            body = f"<article>{body}</article>"
        elif way < 0.6:
            body = self.named("article main section div", WORDS[0], body)
        elif way < 0.85:
            inner = self.named("article section div", WORDS[0], body)
            body = self.named("main div", "main content wrap container", inner + "".join(self.boilerplate(("share", "comments", "sidebar", "form", "advert")) for _ in range(r.randint(0, 2))), 0.4)
        before = [self.boilerplate((k,)) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if r.random() < 0.4]
        after = [self.boilerplate((k,)) for k in ("comments", "sidebar", "share", "advert", "form", "notice", "footer") if r.random() < (0.6 if k == "footer" else 0.3)]
        if r.random() < 0.4:
            before = [self.boilerplate(("header", "menu"))]
        rows = "".join(before) + body + "".join(after)
        for _ in range(r.choice((0, 0, 1, 2))):
            rows = f'<div class="{r.choice(("wrap", "container", "page", "row", "outer", "layout"))}">{rows}</div>'
        return f"<html><head><title>{self.words(1, 8)}</title></head><body>{rows}</body></html>"


def examples(pages: int, seed: int) -> Iterator[tuple[list[Node], np.ndarray, list[int], np.ndarray]]:
    """Nodes, features, parents and labels of made pages: a node is labelled 1 if main text lies in it."""
    writer = _Writer(seed)
    for _ in range(pages):
        order = nodes_of(parse(writer.page()))
        label = np.zeros(len(order))
        place = {id(n): k for k, n in enumerate(order)}
        for k in range(len(order) - 1, -1, -1):
            node = order[k]
            if node.tag[0] == "#" and "\x02" in node.text:
                label[k] = 1
                node.text = node.text.replace("\x02", "").replace("\x03", "")
            if label[k] and node.parent is not None:
                label[place[id(node.parent)]] = 1
        yield order, *features(order), label


#: Made pages that the model is fitted on.
TRAINING_PAGES = 700


@lru_cache(maxsize=2)
def train(pages: int = TRAINING_PAGES, seed: int = 7) -> Boosted:
    """A model fitted on made pages; the same each time."""
    made = list(examples(pages, seed))
    x, y = np.concatenate([m[1] for m in made]), np.concatenate([m[3] for m in made])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    return Boosted().fit(x, y, weight)


def texts(pages: list[str | None], model: Boosted) -> list[str]:
    """Main texts of pages."""
    trees = [nodes_of(parse(p)) for p in pages]
    made = [features(t) for t in trees]
    margin = model.margin(np.concatenate([m[0] for m in made])) if made else np.zeros(0)
    out, at = [], 0
    for order, (x, parents) in zip(trees, made, strict=True):
        likely = np.where(set_apart(order, parents), -SURE, margin[at : at + len(x)])
        out.append(chosen_text(order, decode(likely.tolist(), parents)))
        at += len(x)
    return out


def extract(pages: DataFrame, model: Boosted | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text ('' if there is none), n_chars (code points).

    A null or empty page has no text. A row for each page, repeated rows included; other columns stay behind.
    """
    spark = pages.sparkSession
    small_batches(spark)
    kind = dict(pages.dtypes)[id_column]
    given = spark.sparkContext.broadcast(model or train())

    def rows(batches) -> Iterator[list]:
        for batch in batches:
            found = texts(batch.column(2).to_pylist(), given.value)
            yield [batch.column(0), batch.column(1), found, [len(t) for t in found]]

    return mapped(own_columns(pages, page_id=id_column, url=url_column, html=html_column), rows, f"page_id {kind}, url string, text string, n_chars bigint")
