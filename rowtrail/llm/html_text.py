"""HTML extraction: gradient-boosted trees score DOM nodes, a tree-wise decoding keeps a consistent set of them.

The trees are ``pyspark.ml`` GBTs fitted on nodes of generated pages whose main text is known.  A page is parsed,
scored and decoded within its own row, so extraction is one narrow pass.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Elements whose text is never shown, what may stand in a head, void elements, elements that stay inside
#: a line of text.
HIDDEN = {"script", "style", "head", "template"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "script", "style", "template", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mrow", "mi", "mo", "mn", "ms", "mtext", "msup", "msub", "mfrac", "msqrt", "svg", "object", "map", "canvas", "audio", "video"}
#: Elements whose start ends an open paragraph, and those that end an open element of their kind.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "body", "html"}
#: Groups of tags and of attribute tokens that are features.
TAGS = [{"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl"}, {"div"}, {"section"}, {"article"}, {"main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "button", "label", "select", "option", "textarea", "fieldset", "legend"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"blockquote", "pre", "figure", "figcaption"}, {"body"}]
TOKENS = [
    {"article", "content", "post", "entry", "story", "main", "body", "text", "page", "prose"},
    {"nav", "navigation", "menu", "navbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip"},
    {"header", "masthead", "banner", "logo", "topbar", "branding"},
    {"footer", "copyright", "legal", "bottom", "colophon", "contentinfo", "credits"},
    {"sidebar", "aside", "widget", "related", "rail", "recommended", "complementary", "trending", "more", "popular"},
    {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "subscription", "announcement", "message", "warning", "privacy", "paywall"},
    {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "advertorial"},
    {"comment", "comments", "reply", "replies", "disqus", "respond", "discussion", "commentlist", "reader", "readers", "feedback"},
    {"form", "search", "login", "signup", "register", "contact"},
    {"share", "social", "follow", "sharing", "tags", "tools", "toolbar", "print"},
]
ABOVE = [{"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "button", "label", "select"}, {"article", "main"}]
#: Bytes of pages that a task parses at a time; one longer page is alone.
PAGE_BYTES = 1 << 19
N_FEATURES = 1 + len(TAGS) + 2 * len(TOKENS) + len(ABOVE) + 12


#: What closes a comment and the two kinds of marked sections, and the keywords of those.
_CLOSING = {"comment": re.compile(r"--!?\s*>"), "marked": re.compile(r"]\s*]\s*>"), "condition": re.compile(r"]\s*>")}
_SECTION = re.compile(r"<!\[\s*([a-zA-Z][-_.a-zA-Z0-9]*)")
_KINDS = {**dict.fromkeys(("temp", "cdata", "ignore", "include", "rcdata"), "marked"), **dict.fromkeys(("if", "else", "endif"), "condition")}


class Dom(HTMLParser):
    """Blocks and lines of text of one page, as flat lists in page order; bounded by the page, whatever its nesting."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.depth, self.tokens, self.text, self.linked = ["#root"], [-1], [0], [frozenset()], [None], [0]
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.open: dict[str, list[int]] = {}  # depths in the stack at which a tag is open
        self.line: list[str] = []
        self.links = self.in_link = self.hidden = 0
        self.last: dict[str, tuple[int, int]] = {}  # of each kind of mark: length of what was searched, where its last one ends

    def whole(self, html: str) -> None:
        """Parse a whole page.  What follows the last ``>`` can't be markup any more and is text."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        self.handle_data(unescape(html[end:]))

    def closes(self, kind: str, i: int) -> bool:
        """Whether a mark of the kind ends behind i: known from one search for the last, so many openers stay cheap."""
        data = self.rawdata
        if self.last.get(kind, (-1, 0))[0] != len(data):
            self.last[kind] = (len(data), max((m.end() for m in _CLOSING[kind].finditer(data)), default=0))
        return self.last[kind][1] > i

    def parse_comment(self, i: int, report: int = 1) -> int:
        return super().parse_comment(i, report) if self.closes("comment", i + 4) else -1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections of unknown kinds, or without an end, are text."""
        name = _SECTION.match(self.rawdata, i)
        kind = _KINDS.get(name[1].lower()) if name else None
        return super().parse_marked_section(i, report) if kind and self.closes(kind, i + 3) else -1

    def node(self, tag: str, tokens: frozenset, text: str | None = None, linked: int = 0) -> int:
        at = self.stack[-1][1]
        self.tag.append(tag)
        self.parent.append(at)
        self.depth.append(self.depth[at] + 1)
        self.tokens.append(tokens)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def flush(self) -> None:
        """End the line of text: it becomes a leaf of the block that is open."""
        if self.line:
            text = " ".join("".join(self.line).split())
            if text:
                self.node("#text", frozenset(), text, self.links)
        self.line, self.links = [], 0

    def close_to(self, depth: int) -> None:
        for tag, _ in self.stack[depth:]:
            self.open[tag].pop()
            self.in_link -= tag == "a"
            self.hidden -= tag in HIDDEN
        if any(tag not in INLINE for tag, _ in self.stack[depth:]):
            self.flush()
        del self.stack[depth:]

    def find(self, wanted: set[str] | frozenset, stop: set[str]) -> int:
        """Depth of the innermost open element of a wanted tag, not looking past ``stop``; 0 if none."""
        innermost = lambda tags: max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        k = innermost(wanted)
        return k if k and k >= innermost(stop) else 0

    def enter(self, tag: str, at: int) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, at))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD and self.open.get("head"):  # its end tag may be left out
            self.close_to(self.open["head"][0])
        if tag in VOID:
            if tag == "br":
                self.line.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in ENDS_P and (k := self.find({"p"}, SCOPE | {"div", "section", "article", "td", "li"})):
            self.close_to(k)
        if tag in SIBLING and (k := self.find(SIBLING[tag], SCOPE)):
            self.close_to(k)
        if tag in INLINE:
            self.in_link += tag == "a"
            self.enter(tag, self.stack[-1][1])
            return
        self.flush()
        self.hidden += tag in HIDDEN
        words = " ".join(str(v) for k, v in attrs if v and k in ("class", "id", "role", "aria-label", "itemprop"))
        named = frozenset(re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower().replace("_", " ").replace("-", " ").split())
        self.enter(tag, self.node(tag, named))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if k := self.find({tag}, {"body", "html"} if tag not in ("body", "html") else set()):
            self.close_to(k)

    def handle_data(self, data: str) -> None:
        if not self.hidden and data:
            self.line.append(data)
            if self.in_link:
                self.links += len(data)


def parse(html: str | None) -> Dom:
    dom = Dom()
    if html:
        dom.whole(html)
    dom.close_to(1)
    dom.flush()
    return dom


def node_features(dom: Dom) -> np.ndarray:
    """One row a node: kind, depth, subtree text, link and tag density, siblings, and tokens of it and of those above."""
    n = len(dom.tag)
    parent, depth = np.array(dom.parent), np.array(dom.depth, float)
    leaf = np.array([t is not None for t in dom.text])
    own = np.array([len(t) if t else 0 for t in dom.text], float)
    marks = np.array([sum(map(t.count, ".,;:!?")) if t else 0 for t in dom.text], float)
    size, links, dots, nodes, texts = own.copy(), np.minimum(np.array(dom.linked, float), own), marks, np.ones(n), leaf.astype(float)
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        size[p] += size[i]
        links[p] += links[i]
        dots[p] += dots[i]
        nodes[p] += nodes[i]
        texts[p] += texts[i]
    kids, place = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        place[i] = kids[parent[i]]
        kids[parent[i]] += 1
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = leaf
    for k, tags in enumerate(TAGS):
        x[:, 1 + k] = [t in tags for t in dom.tag]
    a = 1 + len(TAGS)
    b = a + len(TOKENS)
    c = b + len(TOKENS)
    for k, words in enumerate(TOKENS):
        x[:, a + k] = [not words.isdisjoint(t) for t in dom.tokens]
    for k, tags in enumerate(ABOVE):
        x[:, c + k] = [t in tags for t in dom.tag]
    for i in range(1, n):  # what stands above holds for what stands below
        p = parent[i]
        x[i, b:c] = np.maximum(x[p, b:c], x[i, a:b])
        x[i, c : c + len(ABOVE)] = np.maximum(x[p, c : c + len(ABOVE)], x[i, c : c + len(ABOVE)])
    d = c + len(ABOVE)
    up = np.maximum(parent, 0)
    x[:, d] = depth
    x[:, d + 1] = np.log1p(size)
    x[:, d + 2] = links / np.maximum(size, 1)
    x[:, d + 3] = size / max(size[0], 1)
    x[:, d + 4] = np.log1p(nodes)
    x[:, d + 5] = np.log1p(size / np.maximum(texts, 1))
    x[:, d + 6] = np.log1p(kids[up])
    x[:, d + 7] = place / np.maximum(kids[up], 1)
    x[:, d + 8] = dots / np.maximum(size, 1)
    x[:, d + 9] = size / np.maximum(size[up], 1)
    x[:, d + 10] = links[up] / np.maximum(size[up], 1)
    x[:, d + 11] = np.log1p(texts)
    return x


def decode(parent: list[int], score: np.ndarray) -> np.ndarray:
    """The set of nodes of the largest summed log-odds in which a kept node's ancestors are all kept.

    Bottom-up, a node is worth its score and what its children are worth, if that is over 0; top-down, a node stays
    if its parent stays and it is worth something.  So no descendant of a dropped node is ever kept.
    """
    worth = score.astype(float).copy()
    for i in range(len(parent) - 1, 0, -1):
        if worth[i] > 0:
            worth[parent[i]] += worth[i]
    kept = np.zeros(len(parent), bool)
    kept[0] = worth[0] > 0
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and worth[i] > 0
    return kept


# ---------------------------------------------------------------- training pages


def training_page(seed: int) -> list[tuple[str, int]]:
    """A generated page as (markup, label) pieces in order; label 1 for main text.  The same seed, the same page."""
    r = random.Random(seed)
    syllables = "an be co da el fi go ha in jo ka le mo na or pa qu re si ta un ve wi yo ze éa ßi ñu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def prose(a: int, b: int) -> str:
        return " ".join(phrase(2, 14).capitalize() + r.choice([".", ".", ".", "?", "!"]) for _ in range(r.randint(a, b)))

    out: list[tuple[str, int]] = []
    put = lambda markup, label=0: out.append((markup, label))
    attr = lambda *names: f' {r.choice(["class", "id", "class"])}="{r.choice(names)}"'

    def links(n: int) -> None:
        tag = r.choice(["ul", "ol", "div"])
        put(f"<{tag}>")
        for _ in range(n):
            text = f'<a href="/{word()}">{phrase(1, 4)}</a>'
            put(f"<li>{text}</li>" if tag != "div" else text + " ")
        put(f"</{tag}>")

    def boxed(tag: str, names: tuple[str, ...], body) -> None:
        put(f"<{tag}{attr(*names) if r.random() < 0.75 or tag == 'div' else ''}>")
        body()
        put(f"</{tag}>")

    def small() -> None:
        put(f"<p>{prose(1, 2)}</p>" if r.random() < 0.5 else prose(1, 2))

    def comments() -> None:
        if r.random() < 0.6:
            put(f"<h3>{phrase(1, 3)}</h3>")
        for _ in range(r.randint(1, 6)):
            tag = r.choice(["div", "li", "article", "p"])
            put(f"<{tag}{attr('comment', 'comment-body', 'reply', 'user-comment') if r.random() < 0.7 else ''}>{prose(1, 4)}</{tag}>")

    def form() -> None:
        put(f'<form{attr("search", "newsletter-form", "contact", "login") if r.random() < 0.5 else ""}><label>{phrase(1, 4)}</label><input name="q">')
        if r.random() < 0.5:
            put(f"<p>{prose(1, 1)}</p>")
        put(f"<select><option>{word()}</option><option>{word()}</option></select><button>{word()}</button></form>")

    navigation = lambda: boxed(*r.choice([("nav", ("nav", "menu", "main-menu")), ("div", ("menu", "navbar", "breadcrumbs", "top-nav"))]), lambda: links(r.randint(3, 9)))
    advert = lambda: boxed(r.choice(["div", "div", "aside", "section"]), ("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box"), small)
    notice = lambda: boxed(r.choice(["div", "section", "p", "aside"]), ("cookie-notice", "consent", "notice", "alert", "newsletter", "privacy-banner", "subscribe"), lambda: put(prose(1, 2)))
    sidebar = lambda: boxed(*r.choice([("aside", ("sidebar", "widget", "related")), ("div", ("sidebar", "related", "right-rail", "widget"))]), lambda: (put(f"<h3>{phrase(1, 3)}</h3>"), small(), links(r.randint(2, 6))))
    discussion = lambda: boxed(r.choice(["section", "div", "div", "ol"]), ("comments", "comment-list", "discussion", "reader-comments", "responses-replies"), comments)
    share = lambda: boxed("div", ("share", "social", "sharing-tools"), lambda: links(r.randint(2, 4)))
    extras = [advert, notice, share, form, sidebar, navigation]

    def article() -> None:
        if r.random() < 0.75:
            put(f"<h1>{phrase(2, 8)}</h1>", 1)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            kind = r.random()
            if kind < 0.62:
                put(f"<p>{prose(1, 6)}</p>", 1)
            elif kind < 0.68:
                put(f"<p><b>{phrase(3, 9)}.<br>", 1)
            elif kind < 0.76:
                put(f"<p>{phrase(1, 4)}.</p>", 1)
            elif kind < 0.82:
                put(f"<h2>{phrase(1, 5)}</h2>", 1)
            elif kind < 0.87:
                put(f"<blockquote>{prose(1, 3)}</blockquote>", 1)
            elif kind < 0.91:
                put("<ul>" + "".join(f"<li>{prose(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", 1)
            elif kind < 0.94:
                put(f'<p>{phrase(3, 8)} <a href="/x">{phrase(1, 3)}</a> {prose(1, 2)}</p>', 1)
            else:
                r.choice(extras)()

    put(f"<html><head><title>{phrase(1, 5)}</title><style>p{{}}</style><script>f()</script></head><body>")
    if r.random() < 0.25:
        notice()
    if r.random() < 0.5:
        boxed(r.choice(["header", "header", "div"]), ("header", "masthead", "site-header"), lambda: (put(r.choice([f"<h1>{phrase(1, 3)}</h1>", f"<p>{phrase(1, 5)}</p>", phrase(1, 4)])), navigation() if r.random() < 0.5 else None))
    for piece in r.sample([navigation, advert, notice, form, sidebar], r.randint(1, 4)):
        piece()
    wraps = r.choice([[], [], ["<main>"], ['<div id="content">'], ['<div class="container">', "<main>"], ['<div class="wrapper">']])
    inner = r.choice(["<article>", "<article>", "<article>", '<article class="post">', '<div class="article-body">', '<div class="entry-content">', '<section class="story">', '<div class="post-text">'])
    for w in [*wraps, inner]:
        put(w)
    article()
    if r.random() < 0.2:
        discussion()
    put(f"</{inner[1:].split()[0].rstrip('>')}>")
    for piece in r.sample([share, advert, sidebar, discussion, form, notice], r.randint(0, 3)):
        piece()
    for w in reversed(wraps):
        put(f"</{w[1:].split()[0].rstrip('>')}>")
    if r.random() < 0.35:
        sidebar()
    if r.random() < 0.3:
        discussion()
    boxed(*r.choice([("footer", ("footer", "site-footer")), ("div", ("footer", "legal", "copyright"))]), lambda: (put(f"&copy; {phrase(1, 3)} &middot; {prose(1, 2)}"), links(r.randint(2, 5)) if r.random() < 0.4 else None))
    put("</body></html>")
    return out


def labelled_nodes(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a training page's nodes: a leaf's label is its piece's, a block's whether it holds main text."""
    dom, truth = Dom(), []
    for markup, label in training_page(seed):
        dom.feed(markup)
        dom.flush() if markup.startswith("<") and not markup.startswith("<a") else None
        truth += [label] * (len(dom.tag) - 1 - len(truth))
    dom.close()
    dom.close_to(1)
    dom.flush()
    y = np.array([0, *truth, *[0] * (len(dom.tag) - 1 - len(truth))])
    leaf = np.array([t is not None for t in dom.text])
    y = y * leaf
    for i in range(len(y) - 1, 0, -1):
        y[dom.parent[i]] |= y[i]
    return node_features(dom), y


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = zip(*(labelled_nodes(s) for s in batch.column("id").to_pylist()))
        rows = np.concatenate(x)
        flat = pa.array(rows.ravel(), pa.float64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * N_FEATURES, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([lists, pa.array(np.concatenate(y).astype(float))], names=["x", "label"])


def train(spark: SparkSession, pages: int = 1000, trees: int = 20, depth: int = 5) -> list:
    """The fitted trees as nested tuples (feature, threshold, left, right) or leaves, each with its weight."""
    rows = spark.range(0, pages, 1, 4).mapInArrow(_training_rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").persist()
    try:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=7).fit(rows)
    finally:
        rows.unpersist()
    return list(zip(model.treeWeights, (tree_of(t.toDebugString) for t in model.trees)))


def tree_of(text: str):
    """A tree from its printed form: an If line, the left part, an Else line, the right part, or a Predict line."""
    lines = iter([x.strip() for x in text.splitlines() if x.strip().startswith(("If", "Else", "Predict"))])

    def read():
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, threshold = re.search(r"feature (\d+) <= ([-\d.eE]+)", line).groups()
        left = read()
        next(lines)
        return int(feature), float(threshold), left, read()

    return read()


def log_odds(trees: list, x: np.ndarray) -> np.ndarray:
    def value(t) -> np.ndarray | float:
        return t if isinstance(t, float) else np.where(x[:, t[0]] <= t[1], value(t[2]), value(t[3]))

    return 2 * sum(w * value(t) for w, t in trees) + np.zeros(len(x))


def main_texts(pages: list[str | None], trees: list) -> list[str]:
    """The main text of each page, scored together."""
    doms = [parse(p) for p in pages]
    scores, at, texts = log_odds(trees, np.concatenate([node_features(d) for d in doms])), 0, []
    for d in doms:
        kept = decode(d.parent, scores[at : at + len(d.tag)])
        at += len(d.tag)
        texts.append(" ".join(t for t, k in zip(d.text, kept) if k and t is not None))
    return texts


def _extractor(trees: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "html", PAGE_BYTES):  # so many bytes' nodes have features at a time
                texts = main_texts(part.column("html").to_pylist(), trees)
                rest = [n for n in part.schema.names if n != "html"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, trees: list) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page's whole html.

    White space inside a block becomes one space, blocks are joined by one.  Null or empty html, and pages without
    main text, give an empty text; repeated rows are extracted each; extra columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extractor(trees), "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(spark))
