"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with runs of text as leaves.  Each node is on (it is or
holds main text) or off.  A node's own potential comes from a logistic model of its features: tag, length, links, punctuation, its share of the
page, what stands before and after it, and words of class, id and role as far as training has met them; all other names count as one
and the same, and are met in training on content and on what isn't.  A parent-child potential comes
from counted label pairs by what both hold (prose, links, little), never by names.  Sum-product messages go upward to the root and down again, which
gives each node's exact marginal, and the runs that are more likely on than off are the text.  Potentials and weights are trained here on labelled pages, made by ``labelled_pages``.

Formulas, drawings and what stands in for embedded objects are text of the block they are in.

A null or empty html, a page without text and broken or truncated markup give what text there
is, at least the empty one; rows are never merged or left out, repeated ones neither; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# fixed values: element names of HTML by how they lay out text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template select noframes".split())
#: Their content is in line, whatever elements it has: formulas and drawings.
FOREIGN = frozenset(("math", "svg"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img nobr object canvas audio video picture map slot".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul xmp".split())
#: What an opening tag closes that is still open, and where that search ends.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
HEAD = frozenset("head meta link base title script style noscript template".split())

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s>/]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(>|$)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WHITE = re.compile(r"\s+")
#: Elements whose content is text up to their own end tag, whatever stands in it.
_TEXT_ONLY = frozenset("script style textarea title noscript iframe xmp noframes".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in _TEXT_ONLY}


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    text: str = ""
    words: int = 0
    linked: int = 0
    marks: int = 0
    runs: int = 0
    main: bool = False
    #: The landmark it is in, and what the siblings before and after it hold.
    zone: str = ""
    before: str = ""
    after: str = ""
    largest: bool = False


def _names(attrs: str) -> tuple[str, ...]:
    found = []
    for key, a, b, c, bare in _ATTR.findall(attrs):
        key = (key or bare).lower()
        value = a or b or c
        if key in ("class", "id", "role", "itemprop", "aria-label"):
            found += [x.lower() for x in _NAME.findall(entities.unescape(value))]
            if key == "role":
                found.append("role:" + value.lower())
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.append("hidden")
        elif key == "data-main":
            found.append("data-main")
    return tuple(found)


def parse(page: str) -> list[Node]:
    """Elements and text runs in page order, each after its parent."""
    nodes = [Node("root", -1)]
    open_at, open_tags = [0], ["root"]
    places: dict[str, list[int]] = {}  # where each tag is open, so that no search goes through all that are
    buffer: list[str] = []
    linked, link, skip, at, here, in_head, foreign = 0, 0, "", 0, 0, False, ""

    def flush() -> None:
        nonlocal linked
        text = _WHITE.sub(" ", entities.unescape("".join(buffer))).strip() if buffer else ""
        buffer.clear()
        if text:
            nodes.append(Node("#text", open_at[-1], (), text, text.count(" ") + 1, linked, len(re.findall(r"[.!?,;:](?:\s|$)", text)), 1, zone=nodes[open_at[-1]].zone))
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text:
            buffer.append(text)
            if link:
                linked += len(text.split())

    def close(upto: int) -> None:
        for name in open_tags[upto:]:
            places[name].pop()
        del open_at[upto:], open_tags[upto:]

    def after(tag: str, start: int) -> int:
        """Where the text of such an element ends, with its end tag."""
        end = _END[tag].search(page, start)
        return end.end() if end else len(page)

    while m := _TAG.search(page, here):
        start, at, here = at, m.end(), m.end()
        tag = (m[2] or "").lower()
        if skip:
            if tag == skip and m[1]:
                skip = ""
            elif tag in _TEXT_ONLY and not m[1] and m[4] and not m[3].rstrip().endswith("/"):
                at = here = after(tag, here)
            continue
        if not in_head:
            put(page[start : m.start()])
        if foreign and tag and m[4] and tag not in RAW:
            # unclosed, it ends with the block around it
            if m[1] and (tag == foreign or tag not in INLINE and places.get(tag)):
                foreign = ""
            if not m[1] or not places.get(tag):
                continue
        if not tag or not m[4]:  # a comment, a declaration or a tag that the page's end cuts off
            continue
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            if tag == "head":
                in_head = False
            if tag in INLINE:
                if places.get(tag):  # an inline element that is a node of its own
                    flush()
                    close(places[tag][-1])
            elif places.get(tag):
                flush()
                close(places[tag][-1])
                link = 0
            elif tag == "p":
                flush()
            continue
        if tag == "head":
            in_head = True
        elif in_head and tag not in HEAD:
            in_head = False
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                if tag in _TEXT_ONLY:
                    at = here = after(tag, here)
                else:
                    skip = tag
            if tag not in ("script", "style", "template", "title", "noscript"):
                flush()
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in FOREIGN:
            foreign = "" if m[3].rstrip().endswith("/") else tag
            continue
        names = _names(m[3]) if "=" in m[3] or "hidden" in m[3] else ()
        if tag in INLINE:
            link += tag == "a"
            if not names or tag == "a" or tag in VOID:
                continue
        elif tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if tag in CLOSES_P and places.get("p"):
            close(places["p"][-1])
        if tag in SIBLINGS:
            ends, stop = SIBLINGS[tag]
            last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)
            if last(ends) > last(stop):
                close(last(ends))
        nodes.append(Node(tag, open_at[-1], names, zone=_zone(tag, names, nodes[open_at[-1]].zone)))
        open_at.append(len(nodes) - 1)
        places.setdefault(tag, []).append(len(open_tags))
        open_tags.append(tag)
        if tag == "xmp":  # its text is as it stands, tags and all
            at = here = after(tag, here)
            end = _END[tag].search(page, m.end())
            buffer.append(page[m.end() : end.start() if end else len(page)].replace("&", "&amp;"))
            flush()
            close(places[tag][-1])
    if not skip and not in_head:
        rest = page[at:]
        put(rest)
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], nodes[nodes[i].parent]
        p.words += n.words
        p.linked += n.linked
        p.marks += n.marks
        p.runs += n.runs
    _compare(nodes)
    return nodes


_ZONES = {"article": "main", "main": "main", "nav": "nav", "aside": "aside", "footer": "footer", "header": "header", "form": "form"}


def _zone(tag: str, names: tuple[str, ...], outer: str) -> str:
    """The landmark that an element is or is in; headers and footers of an article belong to it."""
    own = "main" if "role:main" in names else _ZONES.get(tag, "")
    return outer if not own or outer == "main" and own in ("header", "footer", "main") else own


def holds(n: Node) -> str:
    """What a node holds, by its words alone."""
    if not n.words:
        return "nothing"
    if 2 * n.linked > n.words:
        return "links"
    return "prose" if n.words >= 12 and n.marks else "bulk" if n.words >= 40 else "little"


def _compare(nodes: list[Node]) -> None:
    """Marks each node with what its neighbours hold, and the longest of siblings."""
    last: dict[int, Node] = {}
    top: dict[int, Node] = {}
    for n in nodes[1:]:
        if not n.words:
            continue
        h = holds(n)
        if n.parent in last:
            n.before = holds(last[n.parent])
            last[n.parent].after = h
        last[n.parent] = n
        if n.parent not in top or n.words > top[n.parent].words:
            top[n.parent] = n
    for n in top.values():
        n.largest = True


_SIGN = re.compile(r"©|®|all rights|https?://|www[.]", re.I)


def features(nodes: list[Node], i: int, known: frozenset[str]) -> list[str]:
    """Names of a node's features, all of them on or off; names of elements that aren't ``known`` are one and the same."""
    n = nodes[i]
    p = nodes[n.parent] if i else n
    kind = "t" if n.tag == "#text" else "e"
    size = min(8, n.words.bit_length())
    links = 0 if not n.words else min(4, 4 * n.linked // n.words)
    marks = 0 if not n.words else min(5, 40 * n.marks // n.words)
    names = sorted({x if x in known else "?" for x in n.names})
    held, around = holds(n), f"{n.before or '-'}/{n.after or '-'}"
    out = [f"tag={n.tag}", f"{kind}size={size}", f"{kind}links={links}", f"{kind}marks={marks}", f"{kind}long={size > 4}{links > 1}{marks > 0}"]
    out += [f"name={x}" for x in names] or [f"bare={n.tag}"]
    out += [f"{kind}zone={n.zone}{held}", f"tagzone={n.tag}/{p.zone}", f"around={held}{around}", f"in={n.tag}/{holds(p)}"]
    if kind == "t":
        out += sorted({f"of={x if x in known else '?'}" for x in p.names})
        out += [f"alone={p.runs == 1}", f"insize={p.tag}{size > 3}", f"sign={bool(_SIGN.search(n.text))}"]
    else:
        share = 8 * n.words // max(1, nodes[0].words)
        up = min((x if x in known else "?" for x in p.names), default="")
        out += [f"up={p.tag}", f"upname={up}", f"runs={min(5, n.runs.bit_length())}", f"each={min(8, (n.words // max(1, n.runs)).bit_length())}"]
        out += [f"share={share}{held}", f"largest={n.largest}{held}", f"named={'?' in names}{held}{n.largest}"]
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    #: By kind of edge, the potential of each parent's and child's state.
    pairs: dict[tuple[str, str], tuple[float, float, float, float]]
    prior: float
    #: Names of elements that training has met often enough.
    known: frozenset[str] = frozenset()


_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li".split())


def edge(nodes: list[Node], i: int) -> tuple[str, str]:
    """Kind of the edge to a node: what the parent is and holds, and what the child is and holds."""
    n, p = nodes[i], nodes[nodes[i].parent]
    child = "text" if n.tag == "#text" else ("plain " if n.tag in _PLAIN else "") + holds(n)
    return "page" if p.tag in ("root", "html", "body") else "text" if p.tag in _PLAIN else holds(p), child


def odds(model: Model, nodes: list[Node]) -> list[float]:
    """Each node's own potential, on to off."""
    out = []
    for i in range(len(nodes)):
        x = model.bias + sum([model.weights.get(f, 0.0) for f in features(nodes, i, model.known)])
        out.append(math.exp(max(-12.0, min(12.0, x))))
    return out


def marginals(model: Model, nodes: list[Node]) -> list[float]:
    """Each node's probability to be on, by messages to the root and back (of odds, on to off)."""
    own = odds(model, nodes)
    up, belief = [1.0] * len(nodes), own[:]
    pairs = [_EVEN, *(model.pairs.get(edge(nodes, i), _EVEN) for i in range(1, len(nodes)))]
    for i in range(len(nodes) - 1, 0, -1):
        p00, p01, p10, p11 = pairs[i]
        b = belief[i]
        up[i] = (p10 + p11 * b) / (p00 + p01 * b)
        j = nodes[i].parent
        belief[j] = max(1e-100, min(1e100, belief[j] * up[i]))
    belief[0] = max(1e-100, min(1e100, belief[0] * model.prior))
    out = belief[:]
    for i in range(1, len(nodes)):
        p00, p01, p10, p11 = pairs[i]
        b = out[nodes[i].parent] / up[i]  # the parent's belief without this child's message
        out[i] = belief[i] * (p01 + p11 * b) / (p00 + p10 * b)
    return [x / (1 + x) for x in out]


_EVEN = (0.9, 0.1, 0.5, 0.5)


def main_text(model: Model, page: str | None) -> str:
    nodes = parse(page or "")
    if len(nodes) == 1:
        return ""
    on = marginals(model, nodes)
    return "\n".join([n.text for n, p in zip(nodes, on, strict=True) if n.tag == "#text" and p >= 0.5])


# --- labelled pages ---

_SYLLABLES = "an be ca do er fi go hu in ka lo mi no or pa re si tu un ve wa za chi tre sou len mar ton der ist und que los las con".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def _sentence(r: random.Random, n: int) -> str:
    w = _words(r, max(1, n)).split(" ")
    w = [x + "," if r.random() < 0.08 else x for x in w]
    return (" ".join(w)).strip(",").capitalize() + r.choice("....!?")


def _prose(r: random.Random, most: int = 8) -> str:
    return " ".join(_sentence(r, r.randint(1, 18)) for _ in range(r.randint(1, most)))


def _list(r: random.Random, n: int) -> str:
    label = lambda: _words(r, r.randint(1, 3)) + r.choice(["", "", "", "", ".", ",", "!"])
    return "<ul>" + "".join(f'<li><a href="/{_words(r, 1)}">{label()}</a></li>' for _ in range(n)) + "</ul>"


def _odd(r: random.Random) -> str:
    """Names that say nothing: of grids, of style sheets, made by programs."""
    code = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    one = lambda: r.choice([f"css-{code(6)}", f"{word()}-{code(5)}", f"{word()}-{r.randint(1, 12)}", f"{word()}-{word()}-{r.randint(1, 12)}", word(), f"{word()}__{code(4)}", code(7)])
    return " ".join(one() for _ in range(r.choice([1, 1, 2, 3])))


def _block(r: random.Random, names: str, inner: str, tags: str = "div", odd: float = 0.0) -> str:
    tag = r.choice(tags.split())
    name = _odd(r) if r.random() < odd else r.choice(names.split())
    return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'


def _boilerplate(r: random.Random, where: str) -> str:
    short, prose = _sentence(r, r.randint(2, 9)), _prose(r, 3)
    top = (
        lambda: f"<nav>{_list(r, r.randint(3, 9))}</nav>",
        lambda: _block(r, "menu navbar topnav nav-menu main-menu navigation", _list(r, r.randint(3, 9)), "div nav", 0.4),
        lambda: f"<header>{r.choice([f'<h1>{_words(r, 2)}</h1>', f'<a href=/>{_words(r, 2)}</a>', f'<div class=logo>{_words(r, 2)}</div><p>{short}</p>'])}</header>",
        lambda: _block(r, "header site-header masthead top-bar page-header", f"<p>{short}</p>", "div header"),
        lambda: _block(r, "top top-bar header masthead bar", f"<b>{_words(r, r.randint(1, 3))}</b>" + "".join(f' {r.choice("|-/")} <a href="/{i}">{_words(r, 1)}</a>' for i in range(r.randint(2, 5))), "div p", 0.3),
        lambda: f'<header class="{_odd(r)}">{_list(r, r.randint(2, 6))}</header>',
        lambda: _block(r, "breadcrumb breadcrumbs crumbs", " &gt; ".join(f'<a href="/">{_words(r, 1)}</a>' for _ in range(3)), "div nav", 0.4),
    )
    any_where = (
        lambda: _block(r, "ad ads advert sponsored promo notice cookie-notice newsletter share", short, "p p div li"),
        lambda: _block(r, "ad ads advert advertisement ad-box banner sponsored sponsor promo promotion ad-slot", r.choice([short, prose, f"<p>{prose}</p>", f'<a href="/x">{short}</a>']), "div div aside section"),
        lambda: _block(r, "cookie cookie-notice notice consent gdpr alert cookie-banner site-notice message", r.choice([f"<p>{prose}</p>", short, prose]) + r.choice(["", f"<button>{_words(r, 1)}</button>"]), "div section aside"),
        lambda: _block(r, "popup modal overlay newsletter subscribe newsletter-signup signup", f"<h3>{_words(r, 3)}</h3><p>{prose}</p><form><input name=e><button>{_words(r, 1)}</button></form>"),
        lambda: f"<form action=/s><label>{_words(r, 2)}</label><input name=q><p>{short}</p><button>{_words(r, 1)}</button></form>",
        lambda: _block(r, "share social social-share share-buttons tools toolbar tags tag-list pagination pager", " ".join(f'<a href="#">{_words(r, 1)}</a>' for _ in range(4)), "div ul p", 0.3),
    )
    side = (
        lambda: f"<aside>{r.choice([_list(r, 5), f'<h3>{_words(r, 2)}</h3><p>{prose}</p>', f'<p>{short}</p>'])}</aside>",
        lambda: _block(r, "sidebar side-bar widget widgets sidebar-right related related-posts recommended popular more-stories teaser", f"<h3>{_words(r, 2)}</h3>" + r.choice([_list(r, 5), f"<p>{prose}</p>"]), "div aside section"),
    )
    comments = "".join(_block(r, "comment reply comment-body", f"<b>{_words(r, 1)}</b><p>{_prose(r, 3)}</p>", "div li article section") for _ in range(r.randint(1, 4)))
    bottom = (
        lambda: f"<footer>&copy; {_words(r, 1)}.example.com &middot; {short}</footer>",
        lambda: f'<footer class="{_odd(r)}"><div>{short}</div>{_list(r, r.randint(0, 5))}</footer>',
        lambda: f'<div class="{_odd(r)}"><p>&copy; {r.randint(1990, 2030)} {_words(r, 2)}. All rights reserved.</p></div>',
        lambda: _block(r, "footer site-footer bottom copyright legal page-footer foot", f"<p>&copy; {_words(r, 2)}. {short}</p>" + r.choice(["", _list(r, 4)]), "div footer"),
        lambda: f"<footer><p>{prose}</p>{_list(r, 3)}</footer>",
        lambda: _block(r, "comments comment-list discussion responses comment-section reader-comments", f"<h3>{_words(r, 2)}</h3>{comments}", "div section ol"),
    )
    return r.choice({"top": top + any_where, "side": side + any_where, "bottom": bottom + side + any_where, "in": any_where + side[1:]}[where])()


def _aside_of_text(r: random.Random, mark: str) -> str:
    """What stands beside paragraphs and is main text all the same."""
    name = lambda x: r.choice([*x.split(), _odd(r)])
    link = lambda: f'<a href="/{_words(r, 1)}">{_words(r, r.randint(1, 5))}</a>'
    return r.choice([
        lambda: f'<p class="{name("lead footnote caption intro note source")}" {mark}>{_sentence(r, r.randint(3, 18))}</p>',
        lambda: f'<section class="{name("note box excursus details chapter")}"><p {mark}>{_prose(r, 5)}</p></section>',
        lambda: f'<div class="{name("note box example")}"><h3 {mark}>{_words(r, 3)}</h3><p {mark}>{_prose(r, 4)}</p></div>',
        lambda: "<ul>" + "".join(f"<li {mark}>{link()}</li>" for _ in range(r.randint(1, 4))) + "</ul>",
        lambda: f"<p {mark}>{_sentence(r, 8)}</p><ul>" + "".join(f"<li {mark}>{link()}</li>" for _ in range(r.randint(2, 4))) + f"</ul><p {mark}>{_prose(r, 3)}</p>",
        lambda: f'<ul class="{_odd(r)}">' + "".join(f"<li {mark}>{_sentence(r, r.randint(2, 14))}</li>" for _ in range(r.randint(2, 6))) + "</ul>",
        lambda: f"<figure><img src=x><figcaption {mark}>{_sentence(r, r.randint(3, 12))}</figcaption></figure>",
        lambda: f"<dl><dt {mark}>{_words(r, 2)}</dt><dd {mark}>{_sentence(r, 9)}</dd></dl>",
        lambda: f"<xmp {mark}>{_words(r, 12)}</xmp>",
    ])()


def _main(r: random.Random) -> str:
    """The article; what is main text in it is marked by data-main."""
    mark, bare = "data-main=1", r.random() < 0.2
    if r.random() < 0.06:  # next to nothing
        text = r.choice([_sentence(r, r.randint(1, 9)), f'{_words(r, r.randint(1, 3)).capitalize()} <a href="/x">{_words(r, r.randint(1, 2))}</a>.', _words(r, r.randint(1, 4))])
        return f"<{(t := r.choice(['article', 'main']))}>{r.choice(['', f'<h1 {mark}>{_words(r, 3)}</h1>'])}<p {mark}>{text}</p></{t}>"
    parts = [r.choice([f"<h1 {mark}>{_words(r, r.randint(2, 9))}</h1>", f"<h1 {mark}>{_sentence(r, r.randint(1, 8))}</h1>", f"<h2 {mark}>{_words(r, 5)}</h2>", ""])]
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
        kind = r.random()
        text = _words(r, r.choice([1, 20, 90, 300, 900])) if bare else _prose(r, r.choice([1, 2, 5, 8]))
        if r.random() < 0.12:  # links, down to a paragraph of little else
            text = r.choice([f'{text} <a href="/x">{_words(r, r.randint(1, 4))}</a> {_prose(r, 1)}', f'{_words(r, r.randint(1, 4))} <a href="/x">{_words(r, r.randint(1, 5))}</a>.', f'<a href="/x">{_sentence(r, r.randint(2, 9))}</a>'])
        elif r.random() < 0.04:
            text += r.choice([f" <math><mi>{_words(r, 1)}</mi><mo>=</mo></math> {_words(r, 3)}", f" <svg><text>{_words(r, 2)}</text></svg>", f" <object>{_words(r, 4)}</object>"])
        if kind < 0.7:
            parts.append(f"<p {mark}>{text}</p>")
        elif kind < 0.78:
            parts.append(f"<p {mark}><b>{text}<br>")
        elif kind < 0.83:
            parts.append(f"<h{(k := r.randint(2, 4))} {mark}>{_words(r, r.randint(1, 6))}</h{k}>")
        elif kind < 0.88:
            parts.append("<ul>" + "".join(f"<li {mark}>{_sentence(r, r.randint(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.91:
            parts.append(f"<blockquote {mark}>{text}</blockquote>")
        elif kind < 0.93:
            parts.append(f"<pre {mark}>{_words(r, 9)}</pre>")
        elif kind < 0.96:
            parts.append("<table>" + "".join(f"<tr><td {mark}>{_words(r, 2)}</td><td {mark}>{_sentence(r, 4)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            parts.append(f'<div {mark}>{_sentence(r, 9)} <a href="/x">{_words(r, 2)}</a> {_prose(r, 2)}</div>')
        if r.random() < 0.13:
            parts.append(_boilerplate(r, "in"))
        if r.random() < 0.18:
            parts.append(_aside_of_text(r, mark))
    first = r.random()
    if parts[0] and first < 0.3:  # a header of the article's own
        by = r.choice(["", f"<p {mark}>{_words(r, 4)}</p>", f'<div class="byline" {mark}>{_words(r, 3)}</div>', f"<time {mark}>{_words(r, 3)}</time>"])
        parts[0] = f"<header{r.choice(['', f' class={_words(r, 1)}'])}>{parts[0]}{by}</header>"
    elif first < 0.45:
        parts.insert(1, f'<{(t := r.choice(["p", "div"]))} class="{r.choice(["byline", "author", "date", "dateline", "meta", "lead", "intro", "summary", _odd(r)])}" {mark}>{r.choice([_words(r, 3), _sentence(r, 12)])}</{t}>')
    inner = "".join(parts)
    if r.random() < 0.2:  # parts in holders of their own
        half = len(parts) // 2
        wrap = lambda x: f'<{(t := r.choice(["div", "section"]))}{r.choice(["", f" class={chr(34)}{_odd(r)}{chr(34)}"])}>{"".join(x)}</{t}>'
        inner = wrap(parts[:half]) + wrap(parts[half:]) if half else wrap(parts)
    kind = r.random()
    if r.random() < 0.4:  # no name or tag tells
        inner = f"<div>{inner}</div>" if r.random() < 0.2 else inner
        return f'<{(t := r.choice(["div", "div", "div", "section"]))}{r.choice(["", f" class={chr(34)}{_odd(r)}{chr(34)}", f" id={chr(34)}{_odd(r)}{chr(34)}"])}>{inner}</{t}>'
    if kind < 0.4:
        return f"<article>{inner}</article>"
    if kind < 0.5:
        return f"<main>{inner}</main>"
    if kind < 0.6:
        return f'<main><article class="{r.choice(["post", "entry", "story"])}">{inner}</article></main>'
    if kind < 0.7:
        return f'<div role="main">{inner}</div>'
    return _block(r, "content main main-content article post post-content entry-content story article-body body-text text page-content post-body", inner, "div section div")


def labelled_pages(n: int, seed: int = 7) -> Iterator[str]:
    """Pages of many layouts, whose elements with main text have the attribute data-main."""
    r = random.Random(seed)
    for _ in range(n):
        some = lambda where, most: "".join(_boilerplate(r, where) for _ in range(r.randint(0, most)))
        middle = some("side", 1) * (r.random() < 0.3) + _main(r) + some("side", 2)
        if r.random() < 0.4:
            middle = f'<div class="{r.choice(["wrapper", "container", "page", "row", "layout", "site", "wrap", _odd(r), _odd(r)])}">{middle}</div>'
        if r.random() < 0.1:  # laid out by a table
            links = r.choice(["<br>", " ", "<p>"]).join(f'<a href="/{i}">{_words(r, 1)}</a>' for i in range(r.randint(2, 8)))
            cell = f'<td class="{r.choice(["sidebar", "menu", "nav", "side", _odd(r)])}">{links}</td>'
            body = f'<td{r.choice(["", " class=main", " class=content", f" id={_words(r, 1)}"])}>{_main(r)}</td>'
            middle = f"<table><tr>{r.choice([cell + body, body + cell])}</tr></table>"
        page = f"<html><head><title>{_words(r, 4)}</title></head><body>{some('top', 3)}{middle}{some('bottom', 3)}"
        yield page + r.choice(["</body></html>", "</body></html>", ""])


#: How often training has to meet a name to know it.
OFTEN = 6
#: Names of up to three letters that can be known; what else is that short is a part of a code.
_SHORT = ("ad", "ads", "nav", "tag", "bar", "top", "box")


@functools.lru_cache(1)
def train(n: int = 2400, seed: int = 7, steps: int = 7, ridge: float = 0.3) -> Model:
    """Node weights by regularised logistic regression, edge potentials by counted pairs."""
    rows: dict[tuple[str, ...], list[int]] = {}  # off and on, of nodes with the same features
    pairs: dict[tuple[str, str], np.ndarray] = {}
    trees = [parse(page) for page in labelled_pages(n, seed)]
    met = Counter(x for nodes in trees for node in nodes for x in set(node.names))
    known = frozenset(x for x, k in met.items() if k >= OFTEN and x != "data-main" and (len(x) > 3 and x.isalpha() or x in _SHORT or ":" in x))
    for nodes in trees:
        for node in nodes:
            node.main = node.tag != "#text" and "data-main" in node.names
        for node in nodes[1:]:
            if node.tag == "#text":
                node.main = nodes[node.parent].main
        state = [node.main for node in nodes]
        for node in nodes:
            node.names = tuple(x for x in node.names if x != "data-main")
        for i in range(len(nodes) - 1, 0, -1):
            state[nodes[i].parent] |= state[i]
        for i in range(1, len(nodes)):
            pairs.setdefault(edge(nodes, i), np.array([[1, 0.01], [1, 1]]))[int(state[nodes[i].parent]), int(state[i])] += 1
        for i, on in enumerate(state):
            rows.setdefault(tuple(features(nodes, i, known)), [0, 0])[int(on)] += 1
    names = sorted({f for r in rows for f in r})
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r]] = 1
    x[:, -1] = 1
    off, on = np.array(list(rows.values()), np.float64).T
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ ((on + off) * p - on).astype(np.float32) + ridge * w
        h = (x * ((on + off) * p * (1 - p)).astype(np.float32)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    base = math.log(on.sum() / off.sum())
    # the nodes' part is a likelihood: its odds without the odds of the classes
    given = {k: tuple((v / v.sum(1, keepdims=True)).ravel().tolist()) for k, v in pairs.items()}
    return Model(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]) - base, given, 1.0, known)


def html_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(model, h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
