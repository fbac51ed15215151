"""Main-text extraction by a tree-structured graphical model.

A page is parsed into a tree whose inner nodes are block elements and whose leaves are text blocks.
Each node is content or not.  Its own evidence (tag, class and id words, what the elements around it are
named, block length, share of link text, sentence ends) is a product of trained likelihoods; parent and child are coupled by trained
transition potentials.  Sum-product messages passed up and then down the tree give each leaf's exact
marginal, and leaves that are more likely content than not are kept in page order.

As browsers do, a page without a body gets one (here called a fragment), so a bare text is a node with a text in it.

The potentials are counted on labelled pages, written by ``labelled_pages`` from a fixed seed, with
add-one smoothing; nothing is learned from the pages to be extracted.

Defined results: null or empty html -> empty text; unclosed and misnested elements are closed as
browsers close them, roughly; an element without text of its own (a button, an image) whose end tag is missing ends at the next block,
and a head without end tag at the first tag or text that can't be in one; comments, scripts, styles, form fields and markup never give text;
character references are decoded and white space in a block becomes one space.  Repeated rows are
extracted alike; input columns named as an output column are replaced.
"""

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

BLOCKS = frozenset("html body article main section div nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption address details summary dialog menu hgroup center search".split())
#: Their contents are never text.
SILENT = frozenset("script style noscript template head title svg annotation annotation-xml iframe object select textarea button option canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag on the left closes an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role values, by what they name (fixed values).
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc topbar toolbar sitemap",
    "header": "header masthead banner branding logo site-header hero",
    "footer": "footer foot colophon copyright bottom legal contentinfo",
    "side": "sidebar side aside widget widgets rail related recommended popular trending complementary more right rightcol leftcol",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted teaser outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall toast disclaimer warning",
    "form": "form search login signup signin contact",
    "social": "share sharing social follow tweet like likes",
    "comment": "comment comments reply replies discussion disqus respond responses thread",
    "content": "article content post entry story main text body page-content article-body entry-content post-content richtext prose",
}
_NAME_OF = {w: k for k, v in NAMES.items() for w in v.split()}
#: Words that also count at the beginning or end of a longer word, like commentlist; the longest first.
_STEMS = sorted((w for w in _NAME_OF if len(w) > 4 and "-" not in w), key=lambda w: (-len(w), w))
_PARTS = re.compile(r"[-_\d]+|(?<=[a-z])(?=[A-Z])")
#: What page furniture is called by its tag alone.
_TAG_KIND = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "side", "form": "form", "search": "form", "dialog": "notice"}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Besides blocks, tags that end an open silent element.
_BREAKS = frozenset("option optgroup select datalist hr head".split())
_OF_HEAD = frozenset("base basefont bgsound link meta".split())
_BODY = re.compile(r"<body\b", re.I)
#: Begins labelled pages whose text is not in an element.
_FRAGMENT = '<!--data-y="1"-->'
_LABEL = re.compile(r"data-y=\"([01])\"")
_END = re.compile(r"[.!?…:;]['\"”»)]*$")


class Node:
    __slots__ = ("tag", "names", "label", "up", "kids", "text", "links", "index", "under")

    def __init__(self, tag, names, label, up):
        self.tag, self.names, self.label, self.up, self.kids, self.text, self.links = tag, names, label, up, [], None, 0
        #: the page furniture that it is inside of: the innermost kind, by names or tag, of the elements around it
        self.under = "none"
        if up is not None:
            own = [_TAG_KIND[up.tag]] if up.tag in _TAG_KIND else []
            own = [k for k in sorted(up.names) if k != "content"] or own
            self.under = own[0] if own and up.tag != "html" and up.tag != "body" else up.under


@lru_cache(maxsize=10_000)
def _kind(word: str) -> str | None:
    """What a class or id word names: the whole word, else its parts, among which page furniture counts before content; a header or footer of
    an article or a post is content."""
    if whole := _NAME_OF.get(word.lower()):
        return whole
    found = []
    for part in filter(None, _PARTS.split(word)):
        low = part.lower()
        kind = _NAME_OF.get(low) or next((_NAME_OF[w] for w in _STEMS if low.startswith(w) or low.endswith(w)), None)
        found += [kind] if kind else []
    if not found or found[0] == "content" and set(found) <= {"content", "header", "footer"}:
        return found[0] if found else None
    return next(k for k in found if k != "content")


def _kinds(attributes: str) -> frozenset:
    words = (word for m in _NAMED.finditer(attributes) for word in (m[1] or m[2] or m[3] or "").split())
    return frozenset(k for k in map(_kind, words) if k)


def _raw_end(html: str, tag: str, i: int) -> int:
    """Where the end tag of a raw element is over; -1 if there is none."""
    m = re.compile(rf"</{tag}\b", re.I | re.A).search(html, i)
    return html.find(">", m.end()) + 1 or -1 if m else -1


def _tokens(html: str) -> list[tuple]:
    """(start, end, tag, is an end tag, attributes) of each tag in order; what gives no text, like comments and the
    contents of scripts, has no tag name.  The time is linear: every search goes on where the last one ended, or is the last one."""
    out, quoted, i, open_raw, n = [], True, 0, set(), len(html)
    while (j := html.find("<", i)) >= 0:
        if html.startswith("<!--", j):
            k = html.find("-->", j + 4)
            i = n if k < 0 else k + 3
            out.append((j, i, "", False, ""))
            continue
        if html[j + 1:j + 2] in ("!", "?"):
            k = html.find(">", j)
            i = n if k < 0 else k + 1
            out.append((j, i, "", False, ""))
            continue
        m = _NAME.match(html, j)
        if not m:
            i = j + 1
            continue
        k = m.end()
        while quoted:  # to the first > that no quotes hold
            k = _PLAIN.match(html, k).end()
            if k < n and html[k] == ">":
                break
            k = html.find(html[k], k + 1) + 1 if k < n else 0
            quoted = k > 0  # a quote or the tag stays open: read the rest of the page without quotes
        if not quoted and (k := html.find(">", m.end())) < 0:
            break  # no tag ends any more
        more, i, end, tag = html[m.end():k], k + 1, m[1] == "/", m[2].lower()
        if tag in RAW and not end and not more.endswith("/"):
            k = -1 if tag in open_raw else _raw_end(html, tag, i)
            if k < 0:  # never closed: up to the body, else up to the end
                open_raw.add(tag)
                body = _BODY.search(html, i)
                i = body.start() if body else n
            else:
                i = k
            tag = ""
        out.append((j, i, "" if tag in RAW else tag, end, more))
    return out


class _Open:
    """Open elements; where the last one of each tag is, is known without a search."""

    def __init__(self, *tags: str):
        self.tags, self.at = [], defaultdict(list)
        for t in tags:
            self.push(t)

    def push(self, tag: str) -> None:
        self.at[tag].append(len(self.tags))
        self.tags.append(tag)

    def pop(self, upto: int) -> None:
        while len(self.tags) > upto:
            self.at[self.tags.pop()].pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost element of these tags, -1 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def _extents(tokens: list[tuple]) -> dict[int, int]:
    """Start of a silent element -> where it ends: behind its end tag; or, if that is left out, at the next tag of a
    block or form element, so that an open element takes no more than its own line of text along."""
    out: dict[int, int] = {}
    stack, starts = _Open(), []
    loose: list[int] = []  # silent elements that have met no block tag yet

    for j, i, tag, end, more in tokens:
        silent = tag in SILENT and tag != "head"
        if tag in BLOCKS or tag in _BREAKS:
            for k in loose:
                out[k] = j
            loose = []
        if not end:
            if tag == "body":
                stack.pop(0)
            elif tag in ("option", "button") and (k := stack.last(tag)) >= 0:  # a new one closes an open one
                stack.pop(k)
            del starts[len(stack.tags):]
            if tag in BLOCKS or silent and not more.endswith("/"):
                stack.push(tag)
                starts.append(j)
                if silent:
                    loose.append(j)
        elif (k := stack.last(tag)) >= 0 and (tag == "object" or stack.last("object") < k) and (tag != "p" or stack.last(*SILENT) < k):
            if silent:
                out[starts[k]] = i
                while loose and loose[-1] >= starts[k]:
                    loose.pop()
            stack.pop(k)
            del starts[k:]
    return out


def parse(html: str) -> list[Node]:
    """Nodes of the page in document order, parents first; leaves have text."""
    root = Node("root", frozenset(), 0, None)
    nodes, stack, held, linked = [root], [root], [], 0
    head, link, i, n = False, 0, 0, len(html)
    opened, bodied = _Open("root"), False

    def embody():
        """The body that is left out, when something comes that must be in one."""
        nonlocal bodied
        if not bodied and stack[-1].tag in ("root", "html"):
            node = Node("fragment", frozenset(), int(html.startswith(_FRAGMENT)), stack[-1])
            stack[-1].kids.append(node)
            nodes.append(node)
            stack.append(node)
            opened.push("body")
            bodied = True

    def flush():
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                embody()
                leaf = Node("text", frozenset(), stack[-1].label, stack[-1])
                leaf.text, leaf.links = text, linked / max(1, len(text))
                stack[-1].kids.append(leaf)
                nodes.append(leaf)
        held, linked = [], 0

    def say(raw: str):
        nonlocal linked, head
        if head and raw.strip(" \t\n\f\r"):
            head = False
        if not head and raw:
            text = unescape(raw)
            held.append(text)
            if link:
                linked += len(text)

    def close(upto: int):
        flush()
        del stack[upto:]
        opened.pop(upto)

    tokens = _tokens(html)
    extent = _extents(tokens) if any(t[2] in SILENT and t[2] != "head" for t in tokens) else {}
    for j, after, tag, end, attributes in [*tokens, (n, n, "", False, "")]:
        if j < i:
            continue  # within a silent element
        say(html[i:j])
        i = after
        if not tag:
            continue
        if tag == "head":
            head = not end and len(nodes) == 1 + sum(x.tag == "html" for x in nodes[1:2])
            continue
        if head:
            if tag in _OF_HEAD or end and tag not in ("body", "html", "br"):
                continue
            head = False  # it was left open
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                held.append(" ")
            continue
        if tag in SILENT:
            if not end and not attributes.endswith("/"):
                i = extent.get(j, n)
            continue
        if tag == "a":
            link = 0 if end else 1
            continue
        if tag not in BLOCKS:
            continue
        if end:
            if (at := opened.last(tag)) > 0:
                close(at)
            else:
                flush()
            link = 0
            continue
        if stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            close(len(stack) - 1)
        elif tag in CLOSES:
            if (at := opened.last(*CLOSES[tag])) > opened.last("ul", "ol", "dl", "table"):
                close(at)
        flush()
        if tag == "body":
            if bodied:
                continue
            bodied = True
        elif tag != "html":
            embody()
        label = _LABEL.search(attributes) if "data-y" in attributes else None
        node = Node(tag, _kinds(attributes) if attributes else frozenset(), int(label[1]) if label else stack[-1].label, stack[-1])
        stack[-1].kids.append(node)
        nodes.append(node)
        stack.append(node)
        opened.push(tag)
    flush()
    for k, x in enumerate(nodes):
        x.index = k
    return nodes


def features(x: Node) -> list[str]:
    """Kinds of evidence: an inner node's tag and what its names say, a leaf's looks, and what furniture a node is inside of."""
    if x.text is None:
        return [f"tag={x.tag}", f"under={x.under}", *[f"name={k}" for k in sorted(x.names) or ["none"]]]
    words = x.text.count(" ") + 1
    size = "1" if words < 4 else "2" if words < 10 else "3" if words < 25 else "4"
    return [f"under={x.under}", f"leaf={size},{'0' if x.links == 0 else '1' if x.links < 0.5 else '2'},{bool(_END.search(x.text))}"]


class Model:
    """Log likelihoods of features by state and log transitions by (parent state, inner or leaf)."""

    def __init__(self, pages: list[str]):
        seen, total, moves = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [1.0, 1.0])
        for page in pages:
            for x in parse(page):
                found = features(x)
                for f in found:
                    seen[f][x.label] += 1
                for kind in {f.split("=")[0] for f in found}:
                    total[kind][x.label] += 1
                if x.up is not None:
                    moves[x.up.label, x.text is None][x.label] += 1
        self.odds = {f: tuple(math.log(v[s] / (total[f.split("=")[0]][s] + 2)) for s in (0, 1)) for f, v in seen.items()}
        self.moves = {k: tuple(math.log(x / sum(v)) for x in v) for k, v in moves.items()}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for every node."""
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        n = len(nodes)
        own = []
        for x in nodes:
            got = [self.odds[f] for f in features(x) if f in self.odds]
            own.append((sum(g[0] for g in got), sum(g[1] for g in got)))
        up: list = [None] * n  # message to the parent
        belief = [list(o) for o in own]  # own evidence and that of the subtree
        for k in range(n - 1, 0, -1):
            x = nodes[k]
            to = self.moves
            inner = x.text is None
            up[k] = tuple(add(belief[k][0] + to[s, inner][0], belief[k][1] + to[s, inner][1]) for s in (0, 1))
            p = belief[x.up.index]
            p[0] += up[k][0]
            p[1] += up[k][1]
        out = [0.0] * n
        full = [None] * n
        full[0] = (belief[0][0], -1e9)  # the page as a whole is not content
        for k in range(1, n):
            x = nodes[k]
            inner, whole = x.text is None, full[x.up.index]
            rest = (whole[0] - up[k][0], whole[1] - up[k][1])  # the parent's belief without this child
            full[k] = tuple(belief[k][s] + add(rest[0] + self.moves[0, inner][s], rest[1] + self.moves[1, inner][s]) for s in (0, 1))
            top = max(full[k])
            full[k] = (full[k][0] - top, full[k][1] - top)
            d = full[k][0] - full[k][1]
            out[k] = 1 / (1 + math.exp(d)) if d < 700 else 0.0
        return out


def labelled_pages(count: int = 300, seed: int = 7) -> list[str]:
    """Pages with data-y labels: semantic, plain and bare layouts, with and without each kind of page furniture."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(say(3, 14).capitalize() + "." for _ in range(r.randint(1, 6)))
    links = lambda k: "<ul>" + "".join(f"<li><a href='/x'>{say(1, 3)}</a></li>" for _ in range(k)) + "</ul>"
    inner = {
        "p": lambda: f"<p>{prose()}</p>", "short": lambda: f"<p>{say(1, 3)}{r.choice(['.', ''])}</p>", "h": lambda: f"<h{r.choice('1234')}>{say(1, 8)}</h2>",
        "linked": lambda: f"<p>{say(4, 12)} <a href='/y'>{say(1, 4)}</a> {say(2, 12)}.</p>", "list": lambda: f"<ul>{''.join(f'<li>{say(1, 10)}{r.choice(chr(46) + chr(59) + chr(32))}</li>' for _ in range(r.randint(1, 5)))}</ul>",
        "quote": lambda: f"<blockquote><p>{prose()}</p></blockquote>", "pre": lambda: f"<pre>{say(3, 20)}</pre>", "figure": lambda: f"<figure><figcaption>{say(3, 10)}.</figcaption></figure>",
        "table": lambda: f"<table><tr><th>{word()}</th><td>{say(1, 5)}</td></tr></table>", "section": lambda: f"<section><h2>{say(2, 5)}</h2><p>{prose()}</p></section>", "div": lambda: f"<div><p>{prose()}</p></div>", "bare": lambda: f"<div>{prose()}</div>",
    }
    weights = [10, 3, 3, 3, 5, 1, 1, 1, 1, 2, 2, 1]
    names = {k: v.split() for k, v in NAMES.items()}
    zero, one = ' data-y="0"', ' data-y="1"'

    def junk(kind: str, semantic: bool) -> str:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "div") if semantic else "div"
        if kind == "comment" and r.random() < 0.5:
            tag = r.choice(["section", "div", "ul"])
        name = r.choice(names[kind])
        if r.random() < 0.3:
            name = r.choice(["{}-list", "{}-area", "{}_box", "block-{}", "{}-1", "page-{}", "post-{}"]).format(name) if kind not in ("header", "footer") else f"site-{name}"
        attr = "" if semantic and tag not in ("div", "section", "ul") and r.random() < 0.6 else f' {r.choice(["class", "id"])}="{name}"'
        body = {
            "menu": lambda: links(r.randint(3, 8)), "header": lambda: f"<h1><a href='/'>{say(1, 3)}</a></h1><p>{say(2, 6)}</p>" if r.random() < 0.6 else links(4),
            "footer": lambda: f"<p>&copy; {say(1, 4)}</p>{links(3)}" if r.random() < 0.6 else f"{say(2, 8)}.", "side": lambda: f"<{(h := r.choice(["h2", "h3", "h3", "h4"]))}>{say(1, 3)}</{h}>{links(5)}" if r.random() < 0.6 else f"<{(h := r.choice(["h2", "h3", "h3", "h4"]))}>{say(1, 3)}</{h}><p>{prose()}</p>",
            "advert": lambda: f"<p>{prose()}</p>" if r.random() < 0.5 else prose(), "notice": lambda: f"<p>{prose()} <a href='/c'>{word()}</a></p>" if r.random() < 0.7 else prose(),
            "form": lambda: f"<p>{say(2, 7)}</p><label>{word()}</label><input name='q'>", "social": lambda: links(3),
            "comment": lambda: f"<{(h := r.choice(["h2", "h3", "h3", "h4"]))}>{say(1, 3)}</{h}>" + "".join(f'<{c} class="{r.choice(["comment", "reply", "x"])}"><p>{prose()}</p></{c}>' for c in [r.choice(["div", "li", "article"])] * r.randint(1, 3)),
        }[kind]()
        return f"<{tag}{attr}{zero}>{body}</{tag}>"

    out = []
    for k in range(count):
        semantic = k % 3 != 0
        before = [junk(x, semantic) for x in ("header", "menu", "advert", "notice") if r.random() < 0.6]
        after = [junk(x, semantic) for x in ("side", "comment", "social", "advert", "form", "notice", "footer") if r.random() < 0.5]
        body = [inner[x]() for x in r.choices(list(inner), weights, k=r.randint(2, 14))]
        if r.random() < 0.8:
            body.insert(0, f"<h1>{say(2, 10)}</h1>")
        for x in ("advert", "social", "side", "comment"):
            if r.random() < 0.15:
                body.insert(r.randint(1, len(body)), junk(x, semantic))
        tag = r.choice(["article", "article", "main", "section"]) if semantic else "div"
        attr = f' class="{r.choice(names["content"])}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        if k % 4 == 1:  # bare: the body, or elements without names in it, hold the text
            for _ in range(r.choice([0, 0, 1, 2])):
                body = [f"<div>{''.join(body)}</div>"]
            few = r.random() < 0.5
            if r.random() < 0.6:  # nothing but a text
                body, few = [r.choice([prose, lambda: say(1, 9)])()], False
            page = f"{''.join(before[:1] * few)}{''.join(body)}{''.join(after[:2] * few)}"
            out.append(_FRAGMENT + page if k % 8 == 1 else f"<html><head><title>{say(2, 5)}</title></head><body{one}>{page}</body></html>")
            continue
        main = f"<{tag}{attr}{one}>{''.join(body)}</{tag}>"
        if r.random() < 0.3:
            main = f"<div>{main}</div>"
        out.append(f"<html><head><title>{say(2, 5)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>")
    return out


@lru_cache(maxsize=1)
def model() -> Model:
    return Model(labelled_pages())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    nodes = parse(html)
    if len(nodes) == 1:
        return ""
    p = model().marginals(nodes)
    return "\n".join(x.text for x, y in zip(nodes, p) if x.text is not None and y > 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with text and n_chars (code points)."""
    added = ["text", "n_chars"]
    pages = without(pages, added)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h) for h in batch], dtype="object")

    get = F.pandas_udf(texts, "string")
    return pages.withColumn("text", get(F.col("html"))).withColumn("n_chars", F.length("text").cast("long"))
