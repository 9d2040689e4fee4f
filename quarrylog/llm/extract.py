"""Main text of web pages by a tree-structured graphical model of the DOM.

Every block element is a variable, content or not. Its own evidence is a log-linear function of its tag, the words of its class, id and
role, its text and its links; each edge gives the chances of a child's state for each state of its parent, by the child's tag. Sum-product
messages go from the leaves up and from the root down, so each element's exact marginal follows. Both kinds of weights are trained
on labelled pages by the gradient of the likelihood, which the same messages give.

Like children of one parent share their evidence: that of many alike weighs as much as that of a few, and as edges are chances, a child
without evidence tells its parent nothing. So a long list of short paragraphs does not outvote the article around it.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, schema

#: Elements without content, elements whose content is no page text, and elements that are part of a line of text. Fixed by HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template iframe object svg math canvas audio video textarea select option datalist title head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: An open paragraph ends where one of these starts; list items, cells and the like end at their own kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}

#: A quote opens a value only behind an equals sign; one that is never closed ends with its tag.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|aria-label|itemprop|hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: A slash that closes a tag, which counts in SVG and MathML only; one behind a bare value is part of it.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "names", "parent", "chars", "linked", "blocks", "label", "children", "share")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int):
        self.tag, self.names, self.parent = tag, names, parent
        self.chars = self.linked = self.children = 0
        self.blocks: list[list[str]] = []
        self.label, self.share = 0, 1.0


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() in ("hidden", "style"):
            if m[1].lower() == "hidden" or "display:none" in value.replace(" ", ""):
                found.append("hidden")
        else:
            found += (w.lower() for w in _NAME.findall(value))
    return tuple(found)


def parse(page: str) -> tuple[list[Node], list[tuple[int, list[str]]]]:
    """(the block elements in page order, each after its parent; the blocks of text as (element, pieces)).

    Tags may be unclosed or wrongly nested. A block is the text between two block boundaries, inline elements included.
    """
    nodes, blocks = [Node("html", (), -1)], []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the block element that text in them belongs to
    links, at, open_block = 0, 0, None

    def text(raw: str) -> None:
        nonlocal open_block
        if not raw:
            return
        node = stack[-1][1]
        if open_block is None or open_block[0] != node:
            if not raw.strip():
                return
            open_block = (node, [])
            blocks.append(open_block)
        value = entities.unescape(raw) if "&" in raw else raw
        open_block[1].append(value)
        n = len(value) - value.count(" ")
        nodes[node].chars += n
        nodes[node].linked += n if links else 0

    def close(depth: int) -> None:
        nonlocal links, open_block
        while len(stack) > depth:
            tag, _ = stack.pop()
            links -= tag == "a"
            if tag not in INLINE:
                open_block = None

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if tag in OPAQUE and tag not in ("head",):
            if tag not in ("svg", "math") or not _CLOSED.search(m[3]):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag in ("head", "html", "body"):
            if tag == "body":
                close(1)
            continue
        if tag in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if tag in ENDS_SAME:
            same, stop = ENDS_SAME[tag]
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in same or stack[k][0] in stop), 0)
            while depth and stack[depth][0] in same:
                close(depth)
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in same or stack[k][0] in stop), 0)
        if tag in VOID:
            if tag in INLINE:
                text(" ") if open_block else None
            else:
                open_block = None
            continue
        parent = stack[-1][1]
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, parent))
        else:
            open_block = None
            nodes[parent].children += 1
            nodes.append(Node(tag, _names(m[3]) if m[3] else (), parent))
            stack.append((tag, len(nodes) - 1))
    text(page[at:])
    _shared(nodes)
    return nodes, blocks


#: So many like children count in full.
ALIKE = 4


def _shared(nodes: list[Node]) -> None:
    """Sets the share at which each element's evidence counts, by how many children of its parent have its tag and names."""
    alike = Counter((x.parent, x.tag, x.names) for x in nodes)
    for x in nodes:
        x.share = ALIKE / max(ALIKE, alike[x.parent, x.tag, x.names])


class TreeModel:
    """Weights of hashed features, and for each kind of child the logarithms of its chances [parent 0, child 0; 0, 1; 1, 0; 1, 1]; exact
    inference by messages."""

    BITS, KINDS = 12, 64

    def __init__(self, unary: list[float] | None = None, edge: list[list[float]] | None = None):
        self.unary = unary or [0.0] * (1 << self.BITS)
        self.edge = edge or [[-log(2)] * 4 for _ in range(self.KINDS)]
        self.places: dict[str, int] = {}
        self.kinds: dict[str, int] = {}

    def _place(self, name: str) -> int:
        found = self.places.get(name)
        if found is None:
            found = zlib.crc32(name.encode()) >> 32 - self.BITS
            if len(self.places) < 100_000:
                self.places[name] = found
        return found

    def features(self, node: Node) -> list[int]:
        n, place = node.chars, self._place
        found = [place("t:" + node.tag), place("bias"), place(f"n{min(n.bit_length(), 10)}")]
        if n:
            share = 4 * node.linked // n
            found += (place(f"l{share}"), place(f"{node.tag}:l{share}"))
        for w in node.names:
            found.append(place("c:" + w[:12]))
        return found

    def kind(self, node: Node) -> int:
        found = self.kinds.get(node.tag)
        if found is None:
            found = self.kinds[node.tag] = zlib.crc32(node.tag.encode()) % self.KINDS
        return found

    def messages(self, nodes: list[Node]):
        """(log odds of content of each element, its chances jointly with its parent's state, features, kinds)."""
        unary, n = self.unary, len(nodes)
        feats = [self.features(x) for x in nodes]
        kinds = [self.kind(x) for x in nodes]
        edges = [self.edge[k] for k in kinds]
        off, on = [0.0] * n, [x.share * sum([unary[i] for i in f]) for x, f in zip(nodes, feats, strict=True)]
        up_off, up_on = [0.0] * n, [0.0] * n
        for k in range(n - 1, 0, -1):  # an element comes after its parent, so all its children have been added
            a, b, c, d = edges[k]
            x, y, p = off[k], on[k], nodes[k].parent
            u, v = _log_sum(a + x, b + y), _log_sum(c + x, d + y)
            up_off[k], up_on[k] = u, v
            off[p] += u
            on[p] += v
        joint: list = [None] * n
        for k in range(1, n):
            a, b, c, d = edges[k]
            x, y, p = off[k], on[k], nodes[k].parent
            u, v = off[p] - up_off[k], on[p] - up_on[k]  # all that the parent knows apart from this child
            t = (u + a + x, u + b + y, v + c + x, v + d + y)
            off[k], on[k] = _log_sum(t[0], t[2]), _log_sum(t[1], t[3])
            joint[k] = t
        return [y - x for x, y in zip(off, on, strict=True)], joint, feats, kinds

    def train(self, pages: list[list[Node]], passes: int = 10, rate: float = 0.25) -> TreeModel:
        """Stochastic gradient of the log-likelihood: what the labels have of each feature and edge less what the model expects."""
        order, unary = random.Random(5), self.unary
        for step in range(passes):
            r = rate / (1 + step) ** 0.5
            for nodes in order.sample(pages, len(pages)):
                odds, joint, feats, kinds = self.messages(nodes)
                for k, node in enumerate(nodes):
                    error = r * node.share * (node.label - _sigmoid(odds[k]))
                    if abs(error) > 1e-4:
                        for i in feats[k]:
                            unary[i] += error
                    if k:
                        t = joint[k]
                        total = _log_sum(_log_sum(t[0], t[1]), _log_sum(t[2], t[3]))
                        table, told = self.edge[kinds[k]], 2 * nodes[node.parent].label + node.label
                        off = [(j == told) - exp(t[j] - total) for j in range(4)]
                        for j in (0, 2):
                            both = off[j] + off[j + 1]
                            x, y = (table[i] + 0.3 * r * (off[i] - both * exp(table[i])) for i in (j, j + 1))
                            norm = _log_sum(x, y)
                            table[j], table[j + 1] = x - norm, y - norm
        return self


def _log_sum(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def _sigmoid(x: float) -> float:
    return 1 / (1 + exp(-x)) if x > -700 else 0.0


def labelled_pages(n: int = 400, seed: int = 3) -> list[str]:
    """Pages of many layouts with labels: elements of the article carry data-main, and no others do.

    They are made up here, as no table has labelled pages: the layouts vary in tags, in names of classes and ids, in which furniture
    a page has and in where it stands. Words are made of syllables.
    """
    draw = random.Random(seed)
    syllables = "ba be co da el fi ga ho in ko la me no or pa ra se ti un va wi yo za th sh er on".split()
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(draw.randint(a, b)))

    def sentence(a=5, b=18):
        return words(a, b).capitalize() + draw.choice(". . . ! ?".split())

    plain = True  # else the article is a list of words, capitals or signs, without sentences

    def odd(a, b):
        sign = draw.choice(("", "", "!!", "$$$", "%%%", " |", ","))
        return draw.choice((str, str.upper))("".join(f"{word()}{sign if draw.random() < 0.8 else ''} " for _ in range(draw.randint(a, 12 * b))))

    prose = lambda a=1, b=6: odd(a, b) if not plain else " ".join(sentence() + (f" <a href='/x'>{words(1, 3)}</a>" if draw.random() < 0.1 else "") for _ in range(draw.randint(a, b)))
    links = lambda a, b, tag="li": "".join(f"<{tag}><a href='/{word()}'>{words(1, 4)}</a></{tag}>" for _ in range(draw.randint(a, b)))

    def box(tags: str, names: str, inner: str, more: str = "") -> str:
        tag, name = draw.choice(tags.split()), draw.choice(names.split())
        how = draw.choice((f'class="{name}"', f'id="{name}"', f'class="{word()} {name}"', f'class="{name}-{draw.choice(("box", "wrap", "inner", "1"))}"'))
        if tag in ("nav", "footer", "header", "aside", "form", "article", "main") and draw.random() < 0.5:
            how = ""
        return f"<{tag} {how}{more}>{inner}</{tag}>"

    def some(p: float, make) -> str:
        return make() if draw.random() < p else ""

    def menu():
        return box("nav nav div ul", "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs", draw.choice((f"<ul>{links(2, 9)}</ul>", links(2, 9, "span"), links(2, 8, "div"))))

    def advert():
        return box("div div aside section", "ad ads advert advertisement banner promo sponsored sponsor adsbox", draw.choice((sentence(), prose(1, 2), f"<p>{sentence()}</p>", f"<a href='/b'>{words(2, 6)}</a>")))

    def side():
        return box("aside aside div section", "sidebar side widget related rail secondary popular recommended", f"<h3>{words(1, 4)}</h3>" + draw.choice((f"<ul>{links(2, 7)}</ul>", f"<p>{prose(1, 3)}</p>")))

    def notice():
        return box("div div section aside", "cookie cookies notice consent gdpr cookie-banner alert popup modal subscribe newsletter paywall", f"<p>{prose(1, 2)}</p>" + some(0.6, lambda: f"<button>{words(1, 2)}</button>"))

    def form():
        return f"<form {draw.choice(('', 'class=search', 'id=login', 'class=contact'))}>" + some(0.7, lambda: f"<label>{words(1, 4)}</label>") + "<input>" + some(0.5, lambda: f"<p>{sentence()}</p>") + f"<button>{word()}</button></form>"

    def comments():
        one = lambda: box("div div div li li li p p article", "comment reply comment-body post-comment", f"<p>{prose(1, 3)}</p>" if draw.random() < 0.7 else prose(1, 2))
        return box("section div div ol", "comments comment-list discussion responses replies reader-comments disqus", f"<h2>{words(1, 3)}</h2>" + "".join(one() for _ in range(draw.randint(1, 5))))

    def share():
        return box("div ul", "share social sharing tags meta byline author-bio", draw.choice((links(2, 5), words(2, 6))))

    def foot():
        return box("footer footer footer div", "footer site-footer bottom copyright legal colophon", draw.choice((f"&copy; {words(2, 6)} &middot; {sentence()}", f"<p>{sentence()}</p>", f"<ul>{links(2, 6)}</ul>", sentence() + f"<p>{prose(1, 2)}</p>")))

    def head():
        return box("header header div", "header site-header masthead top branding logo", draw.choice((f"<h1>{words(1, 3)}</h1>", f"<div>{words(1, 4)}</div>", words(1, 4), f"<p>{sentence()}</p>")) + some(0.4, menu))

    def article():
        nonlocal plain
        plain = draw.random() < 0.75
        short = draw.random() < 0.3
        many = short and draw.random() < 0.2  # a long list of short paragraphs
        m = " data-main=1"
        parts = [f"<{draw.choice(('h1', 'h1', 'h1', 'h2'))}{m}>{words(2, 9)}</h1>"] if draw.random() < 0.8 else []
        for _ in range(draw.randint(30, 120) if many else draw.randint(1, 12)):
            kind = draw.random() * (0.76 if many else 1)
            if kind < 0.74:
                parts.append(f"<p{m}>{some(0.1, lambda: '<b>')}{prose() if not short and draw.random() < 0.85 else words(1, 8).capitalize() + '.'}" + draw.choice(("</p>", "</p>", "</p>", "", "<br>")))
            elif kind < 0.80:
                parts.append(f"<h2{m}>{words(1, 6)}</h2>")
            elif kind < 0.85:
                parts.append(f"<ul{m}>" + "".join(f"<li{m}>{sentence() if draw.random() < 0.6 else words(1, 4)}</li>" for _ in range(draw.randint(1, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote{m}>" + draw.choice((prose(1, 2), f"<p{m}>{prose(1, 2)}</p>")) + "</blockquote>")
            elif kind < 0.90:
                parts.append(f"<pre{m}>{words(3, 20)}</pre>")
            elif kind < 0.92:
                parts.append(f"<table{m}><tr{m}><td{m}>{words(1, 3)}</td><td{m}>{words(1, 3)}</td></tr></table>")
            elif kind < 0.94:
                parts.append(f"<figure{m}><img><figcaption{m}>{sentence()}</figcaption></figure>")
            elif kind < 0.96:
                parts.append(advert())
            elif kind < 0.97:
                parts.append(share())
            elif kind < 0.98:
                parts.append(form())
            else:
                parts.append(f"<div{m}>{prose()}</div>")
        inner, plain = "".join(parts), True
        shape = draw.random()
        if shape < 0.55:
            return f"<article{draw.choice(('', ' class=post', ' class=entry', ' id=content'))}{m}>{inner}</article>"
        name = draw.choice("content article post entry main story post-content article-body entry-content text body".split())
        return f"<{draw.choice(('div', 'main', 'section'))} {draw.choice(('class', 'id'))}='{name}'{m}>{inner}</div></main></section>"

    out = []
    for _ in range(n):
        bare = 0.3 if draw.random() < 0.2 else 1  # a page with little else
        before = "".join(some(bare * p, f) for p, f in ((0.5, head), (0.7, menu), (0.25, notice), (0.4, advert), (0.2, form)))
        after = "".join(some(bare * p, f) for p, f in ((0.35, side), (0.4, comments), (0.2, share), (0.2, advert), (0.2, form), (0.15, notice), (0.8, foot)))
        lead = some(0.25, side)
        body = article()
        if draw.random() < 0.4:
            body = f"<{(t := draw.choice(('main', 'div', 'div')))} class='{draw.choice(('wrap', 'container', 'page', 'row', 'layout', word(), word(), word()))}' data-main=1>{lead}{body}{some(0.3, side)}{some(0.3, comments)}</{t}>"
        else:
            body = lead + body
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{before}{body}{after}</body></html>")
    return out


_MAIN = re.compile(r"\sdata-main=1")


def _labelled(page: str) -> list[Node]:
    """The nodes of a labelled page; the mark is read as a name and taken off again."""
    nodes, _ = parse(_MAIN.sub(" role=datamainlabel", page))
    for x in nodes:
        x.label = int("datamainlabel" in x.names)
        x.names = tuple(w for w in x.names if w != "datamainlabel")
    nodes[0].label = 1
    return nodes


_TRAINED: dict[int, tuple[list[float], list[list[float]]]] = {}


def trained(pages: int = 500) -> tuple[list[float], list[list[float]]]:
    """(feature weights, edge tables), the same in each process; trained once in it."""
    if pages not in _TRAINED:
        model = TreeModel().train([_labelled(p) for p in labelled_pages(pages)])
        _TRAINED[pages] = (model.unary, model.edge)
    return _TRAINED[pages]


def main_text(page: str | None, model: TreeModel, threshold: float = 0.5) -> str:
    """The blocks whose element is content with `threshold` probability or more, joined by blank lines."""
    nodes, blocks = parse(page or "")
    if not blocks:
        return ""
    odds, least = model.messages(nodes)[0], log(threshold / (1 - threshold))
    kept = (" ".join("".join(pieces).split()) for node, pieces in blocks if odds[node] >= least)
    return "\n\n".join(t for t in kept if t)


def extract(pages: DataFrame, weights: tuple[list[float], list[list[float]]] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; n_chars counts code points.

    Null and empty pages have an empty text. Tags may be broken; a page without tags is one block of text. Rows are taken one by one;
    other columns are ignored. Weights, a fixed 40 kB, go to the workers.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(weights or trained())

    def run(batches):
        model = TreeModel(*shared.value)
        for batch in batches:
            found = [main_text(h, model) for h in batch["html"].to_pylist()]
            yield batch_of({"page_id": (batch["page_id"], pa.int64()), "url": (batch["url"], pa.string()), "text": (found, pa.string()), "n_chars": (list(map(len, found)), pa.int64())})

    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return body.mapInArrow(run, schema(page_id="long", url="string", text="string", n_chars="long"))
