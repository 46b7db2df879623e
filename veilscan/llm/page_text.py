"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks: runs of text between block-level tags, each with its open ancestors.
Every block is article text or not; the field scores a block by its ancestors' tags, class and id
words and by the look of its text, and a pair of neighbours by their labels.  It is trained by
stochastic gradients of the likelihood on labelled pages, whose layouts are stated below, and decoded
by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import slices

# Elements by how they shape text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SILENT = ("script", "style", "noscript", "template", "textarea", "select", "svg", "title", "iframe",
          "object", "math", "datalist")
#: A new one ends an open one of the same kind.
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                 "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: How far up an element closes another one of its kind.
BARRIERS = frozenset("ul ol dl table div section article aside nav main header footer form body".split())

#: Elements of another vocabulary, which a slash at the end of their tag closes.
FOREIGN = ("svg", "math")

# Attributes by the states of the HTML tokenizer: unquoted values may hold quotes, and a quote that
# nothing closes goes on to the end of the page.
_BLANK = r"[\t\n\f\r ]"
_VALUE = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\t\n\f\r >\"'][^\t\n\f\r >]*+)"
_NAME = r"(?:=[^\t\n\f\r />=]*+|[^\t\n\f\r />=]++)"
_ATTRIBUTES = rf"(?:{_BLANK}++|/(?!>)|{_NAME}(?:{_BLANK}*+={_BLANK}*+{_VALUE}?+)?+)*+"
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_BLANK}*+={_BLANK}*+({_VALUE}))?+")
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?:{'|'.join(FOREIGN)})(?=[\t\n\f\r />]){_ATTRIBUTES}/>"
    rf"|<({'|'.join(SILENT)})(?=[\t\n\f\r />]){_ATTRIBUTES}/?(?:>|\Z)"
    r".*?(?:</\1(?=[\t\n\f\r />])[^>]*+(?:>|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^\t\n\f\r />]*+)({_ATTRIBUTES})(/?)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|([^<]++|<)",
    re.S | re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """An open element; its ancestors are a linked list, which blocks share."""

    __slots__ = ("tag", "parent", "fresh", "leaf")

    def __init__(self, tag: str, parent: Node | None, fresh: tuple[str, ...]):
        self.tag, self.parent = tag, parent
        #: Features of this element that none of its ancestors has.
        self.fresh = fresh
        self.leaf = tag if tag not in INLINE else parent.leaf if parent else "body"


@dataclass
class Block:
    text: str
    node: Node | None
    links: float


def _split_names(attributes: str) -> list[str]:
    """Class, id and role words of an element, ascending; camel case and joined words are split."""
    found = " ".join(
        value.strip("\"'") for name, value in _ATTRIBUTE.findall(attributes)
        if name.lower() in ("class", "id", "role")) if attributes else ""
    if not found:
        return []
    found = re.sub(r"([a-z])([A-Z])", r"\1 \2", html.unescape(found)).lower()
    return sorted(set(_WORDS.findall(found)))


class _Open:
    """The open elements.  Each step takes time by what it opens or closes, not by the depth."""

    def __init__(self):
        self.stack: list[tuple[Node, list[str]]] = []
        self.places: dict[str, list[int]] = {}
        self.counts: dict[str, int] = {}

    @property
    def node(self) -> Node | None:
        return self.stack[-1][0] if self.stack else None

    def last(self, tags: Iterable[str]) -> int:
        """How deep the innermost open one of these elements is, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, names: list[str]) -> None:
        features = [f"named {word}" for word in names]
        if tag not in ("html", "body"):
            features.append(f"in {tag}")
        fresh = tuple(f for f in features if not self.counts.get(f))
        for f in features:
            self.counts[f] = self.counts.get(f, 0) + 1
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((Node(tag, self.node, fresh), features))

    def close(self, depth: int) -> None:
        """Closes the element at this depth and all in it."""
        while len(self.stack) > depth:
            node, features = self.stack.pop()
            self.places[node.tag].pop()
            for f in features:
                self.counts[f] -= 1


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of a whole page in page order, white space joined, character references decoded.

    A slash at the end of a tag closes the element, as pages written as XHTML mean it.
    """
    elements = _Open()
    blocks: list[Block] = []
    parts: list[str] = []
    linked = 0
    opened: Node | None = None

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, opened, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    for token in _TOKEN.finditer(page):
        silent, closing, tag, attributes, slash, text = token.groups()
        if text is not None:
            text = html.unescape(text)
            if not parts and not text.isspace():
                opened = elements.node
            if parts or not text.isspace():
                parts.append(text)
                if elements.places.get("a"):
                    linked += len(text.strip())
            continue
        if tag is None:
            if silent and silent.lower() not in INLINE and parts:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag not in INLINE:
            end()
        elif tag == "br" and parts:
            parts.append(" ")
        if closing:
            at = elements.last([tag])
            if at >= 0:
                elements.close(at)
        elif tag not in VOID and not slash:
            ends = CLOSES_ITSELF.get(tag)
            # Any block ends an open paragraph.
            ends = ends if ends or tag in INLINE else {"p"}
            at = elements.last(ends or ())
            if at > elements.last(BARRIERS):
                elements.close(at)
            elements.push(tag, _split_names(attributes))
    end()
    return blocks


def _ancestor_features(node: Node | None) -> list[str]:
    found = [f"leaf {node.leaf if node else 'body'}", "any"]
    while node:
        found += node.fresh
        node = node.parent
    return found


def _text_features(block: Block) -> list[str]:
    text = block.text
    size = len(text)
    return [
        f"size {min(8, size.bit_length() - 1)}",
        f"links {0 if not block.links else 1 if block.links < 0.5 else 2}",
        "sentence" if text[-1] in ".!?…\"'”)" else "no sentence",
        f"commas {min(3, text.count(',') + text.count('. '))}",
        "sign" if text[0] in "©|»•" else "no sign",
    ]


@dataclass
class Field:
    """Weights of a block's features for the label 1, of neighbouring labels and of the first."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def features(self, block: Block) -> list[str]:
        return _ancestor_features(block.node) + _text_features(block)

    def scores(self, blocks: list[Block]) -> list[float]:
        """Scores of label 1; what ancestors weigh is added up once for each element."""
        known: dict[Node | None, float] = {None: 0.0}
        found = []
        for block in blocks:
            chain, node = [], block.node
            while node not in known:
                chain.append(node)
                node = node.parent
            total = known[node]
            for node in reversed(chain):
                total = known[node] = total + sum(self.weights.get(f, 0.0) for f in node.fresh)
            leaf = block.node.leaf if block.node else "body"
            found.append(total + sum(
                self.weights.get(f, 0.0) for f in (f"leaf {leaf}", "any", *_text_features(block))))
        return found

    def viterbi(self, scores: list[float]) -> list[int]:
        """The best labels for the blocks' scores of label 1 (label 0: zero)."""
        (aa, ab), (ba, bb) = self.pairs.tolist()
        off, on = self.first.tolist()
        back = []
        for i, score in enumerate(scores):
            if i:
                from_off, from_on = off, on
                stay = from_off + aa >= from_on + ba
                go = from_off + ab > from_on + bb
                off = from_off + aa if stay else from_on + ba
                on = from_off + ab if go else from_on + bb
                back.append((0 if stay else 1, 0 if go else 1))
            on += score
        labels = [int(on > off)] if scores else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.3,
            decay: float = 1e-4, seed: int = 3) -> Field:
        """Gradient ascent on the log likelihood, page by page, with per-weight step sizes."""
        order = random.Random(seed)
        known = [([self.features(b) for b in blocks], labels) for blocks, labels in pages if blocks]
        size: dict[str, float] = {}
        pair_size, first_size = np.full((2, 2), 1e-6), np.full(2, 1e-6)
        for _ in range(epochs):
            order.shuffle(known)
            for rows, labels in known:
                single, pairs = self._marginals([sum(self.weights.get(f, 0.0) for f in r) for r in rows])
                for row, label, chance in zip(rows, labels, single[:, 1]):
                    for name in row:
                        old = self.weights.get(name, 0.0)
                        slope = label - chance - decay * old
                        size[name] = size.get(name, 1e-6) + slope * slope
                        self.weights[name] = old + rate * slope / size[name] ** 0.5
                slope = -pairs
                for a, b in zip(labels, labels[1:]):
                    slope[a, b] += 1
                pair_size += slope * slope
                self.pairs = self.pairs + rate * slope / np.sqrt(pair_size)
                slope = -single[0]
                slope[labels[0]] += 1
                first_size += slope * slope
                self.first = self.first + rate * slope / np.sqrt(first_size)
        return self

    def _marginals(self, scores: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Chances of each block's labels, and expected counts of neighbouring labels."""
        node = np.stack([np.zeros(len(scores)), np.array(scores)], 1)
        node[0] += self.first
        forward, backward = np.empty_like(node), np.zeros_like(node)
        forward[0] = node[0]
        for i in range(1, len(node)):
            forward[i] = node[i] + np.logaddexp.reduce(forward[i - 1][:, None] + self.pairs, axis=0)
        for i in range(len(node) - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.pairs + node[i + 1] + backward[i + 1], axis=1)
        total = np.logaddexp.reduce(forward[-1])
        single = np.exp(forward + backward - total)
        pairs = np.zeros((2, 2))
        if len(node) > 1:
            joint = (forward[:-1, :, None] + self.pairs + (node + backward)[1:, None, :]) - total
            pairs = np.exp(joint).sum(0)
        return single, pairs


# Layouts of labelled pages.  A frame holds an article's parts; all else is not article text.
ARTICLE_FRAMES = [
    "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>",
    '<div class="content">{}</div>', '<div id="content"><div class="post">{}</div></div>',
    '<div class="article-body">{}</div>', '<section class="story"><div class="entry-content">{}</div></section>',
    '<div id="main"><div class="text">{}</div></div>', '<div role="main">{}</div>', "<div>{}</div>",
    '<article class="post"><div class="body">{}</div></article>',
    "<table><tr><td>{}</td></tr></table>",
]
ARTICLE_PARTS = [
    "<p>{long}</p>", "<p>{long}</p>", "<p>{long}</p>", "<p>{short}</p>", "<h2>{title}</h2>", "<h3>{title}</h3>",
    "<p><b>{long}<br><p>{long}</p>", "<ul><li>{short}</li><li>{long}</li><li>{words}</li></ul>",
    "<ol><li>{long}</li><li>{words}</li></ol>",
    "<blockquote>{long}</blockquote>", "<blockquote><p>{short}</p></blockquote>", "<pre>{short}</pre>",
    '<p>{short} <a href="/x">{words}</a> {long}</p>', "<p><em>{short}</em></p>", "<p>{words}</p>",
    "<figure><img src=x><figcaption>{short}</figcaption></figure>", "{long}<br><br>{short}",
    "<table><tr><th>{words}</th><th>{words}</th></tr><tr><td>{words}</td><td>{short}</td></tr></table>",
    "<dl><dt>{words}</dt><dd>{short}</dd></dl>", "<div>{long}</div>", "<section><h2>{title}</h2><p>{long}</p></section>",
]
BEFORE = [
    "<header><h1>{words}</h1><p>{short}</p></header>", '<div class="header">{words}</div>',
    '<div id="masthead"><a href="/">{words}</a></div>', '<div class="top-bar">{words}</div>',
    "<nav><ul><li><a href=/a>{words}</a></li><li><a href=/b>{words}</a></li><li><a href=/c>{words}</a></li></ul></nav>",
    '<ul class="menu"><li><a href=/a>{words}</a></li><li><a href=/b>{words}</a></li></ul>',
    '<div id="navigation"><a href=/a>{words}</a> | <a href=/b>{words}</a></div>',
    '<div class="navbar"><p><a href=/a>{words}</a></p></div>', '<div class="breadcrumbs"><a href=/a>{words}</a> / {words}</div>',
    '<div class="cookie-notice"><p>{short}</p><button>{words}</button></div>', '<div class="cookie-banner">{long}</div>',
    '<div id="gdpr-consent"><p>{long}</p></div>', '<div class="notice">{short}</div>', '<div class="alert" role="alert">{long}</div>',
    '<div role="banner">{words}</div>', '<div role="navigation"><a href=/a>{words}</a></div>',
    '<form action="/search"><label>{words}</label><input name=q><button>{words}</button></form>',
    '<div class="search"><form><p>{words}</p></form></div>',
]
ANYWHERE = [
    '<div class="ad">{short}</div>', '<div class="ad">{long}</div>', '<div class="ads"><p>{short}</p></div>',
    '<div class="advert">{long}</div>', '<div class="advertisement"><a href=/x>{short}</a></div>',
    '<div class="sponsored"><p>{long}</p></div>', '<div class="promo">{short}</div>', '<aside class="ad">{short}</aside>',
    '<aside>{long}</aside>', "<aside><h3>{words}</h3><ul><li><a href=/a>{words}</a></li></ul></aside>",
    '<div class="newsletter"><p>{long}</p><form><input><button>{words}</button></form></div>',
    '<div class="subscribe">{short}</div>', '<div class="share"><a href=/x>{words}</a> <a href=/y>{words}</a></div>',
    '<div class="social-share">{words}</div>', '<div class="related"><h3>{words}</h3><p><a href=/x>{short}</a></p></div>',
    '<div class="sidebar"><p>{long}</p><p>{short}</p></div>', '<div id="sidebar"><h4>{words}</h4><p>{short}</p></div>',
    '<div class="widget"><p>{short}</p></div>', "<form><p>{short}</p><p>{long}</p><input type=submit></form>",
    '<div class="popup">{long}</div>', '<div class="modal"><p>{long}</p></div>', '<div class="banner">{short}</div>',
    '<div class="notice"><p>{long}</p></div>', '<p class="notice">{long}</p>', '<p class="ad">{short}</p>',
    '<div class="hatnote">{short}</div>', '<div class="disclaimer"><p>{long}</p></div>', '<p class="disclaimer">{short}</p>',
    '<div class="notification">{long}</div>', '<div class="hinweis"><p>{short}</p></div>', '<div class="anzeige">{long}</div>',
]
AFTER = [
    '<section class="comments"><h2>{words}</h2><div class="comment"><p>{long}</p></div><div class="comment"><p>{short}</p></div></section>',
    '<div id="comments"><p>{long}</p><p>{long}</p></div>', '<ol class="comment-list"><li><p>{long}</p></li><li><p>{short}</p></li></ol>',
    '<section id="comments"><article class="comment"><p>{long}</p></article><article class="comment"><p>{long}</p></article></section>',
    '<div class="reader-comments"><ul><li>{long}</li><li>{short}</li></ul></div>', '<div class="discussion"><div class="reply">{long}</div></div>',
    '<div id="disqus_thread"><p>{long}</p><p>{short}</p></div>', '<section class="kommentare"><p>{long}</p><p>{short}</p></section>',
    '<div class="commentaires"><p>{long}</p></div>', '<div id="comentarios"><p>{long}</p><p>{short}</p></div>',
    '<div class="responses"><blockquote>{long}</blockquote></div>', '<ul class="reviews"><li>{long}</li></ul>',
    '<footer>&copy; {words} &middot; {short}</footer>', "<footer><p>{long}</p><ul><li><a href=/x>{words}</a></li></ul></footer>",
    '<div class="footer">&copy; {short}</div>', '<div id="footer"><p>{short}</p></div>', '<div role="contentinfo">{words}</div>',
    '<div class="pagination"><a href=/x>{words}</a></div>', '<div class="copyright">{short}</div>', '<div class="legal"><p>{long}</p></div>',
]


#: Share of the layouts around an article whose names are replaced by invented words in training.
UNNAMED = 0.3

#: Private characters that tell text of the two kinds apart while a page is made.
OUTSIDE, INSIDE = "\ue000", "\ue001"


def labelled_pages(number: int = 600, seed: int = 5, use: Callable[[str], bool] = lambda layout: True,
                   unnamed: float = 0.0) -> list[tuple[list[Block], list[int]]]:
    """Pages of the layouts above with invented words, and their blocks' labels.

    ``use`` chooses layouts around the article, so that whole families can be held out.
    """
    chance = random.Random(seed)
    before, anywhere, after = ([x for x in kind if use(x)] for kind in (BEFORE, ANYWHERE, AFTER))

    def words(least: int, most: int) -> str:
        return " ".join("".join(chance.choice("aeiourstnlmdé") for _ in range(chance.randint(2, 9)))
                        for _ in range(chance.randint(least, most)))

    def fill(layout: str, mark: str) -> str:
        kinds = {"{long}": (12, 90), "{short}": (4, 14), "{title}": (2, 9), "{words}": (1, 3)}

        def made(m: re.Match) -> str:
            text = mark + words(*kinds[m[0]]).capitalize()
            if m[0] in ("{long}", "{short}") and chance.random() < 0.85:
                text = re.sub(r" (?=\w+ \w+ \w+$)", ", ", text) + chance.choice("....!?")
            return text

        return re.sub(r"\{\w+\}", made, layout)

    def around(layout: str) -> str:
        """Some have names that no other page has: then the text and its place have to tell."""
        if chance.random() < unnamed:
            layout = re.sub(r'(?<=class=")[^"]*|(?<=id=")[^"]*', lambda m: words(1, 1), layout)
        return fill(layout, OUTSIDE)

    def some(layouts: list[str], most: int) -> str:
        return "".join(around(chance.choice(layouts)) for _ in range(chance.randint(0, most)))

    pages = []
    for _ in range(number):
        inside = [fill(chance.choice(["<h1>{title}</h1>", "<h1>{short}</h1>", "<header><h1>{title}</h1></header>", ""]), INSIDE)]
        for _ in range(chance.choice([0, 1, 2, 3, 5, 8, 12])):
            if chance.random() < 0.08:
                inside.append(around(chance.choice(anywhere)))
            inside.append(fill(chance.choice(ARTICLE_PARTS), INSIDE))
        frame = chance.choice([*ARTICLE_FRAMES, *ARTICLE_FRAMES[:1] * 4])
        page = (some(before, 3) + some(anywhere, 2) + frame.replace("{}", "".join(inside))
                + some(anywhere, 2) + some(after, 3))
        if chance.random() < 0.9:
            page = f"<html><body>{page}</body></html>"
        blocks, labels = leaf_blocks(page), []
        for block in blocks:
            labels.append(int(INSIDE in block.text))
            block.text = block.text.replace(OUTSIDE, "").replace(INSIDE, "") or "x"
        pages.append((blocks, labels))
    return pages


def train(number: int = 600, use: Callable[[str], bool] = lambda layout: True) -> Field:
    return Field().fit(labelled_pages(number, use=use, unnamed=UNNAMED))


def main_text(page: str, field_: Field) -> str:
    blocks = leaf_blocks(page)
    labels = field_.viterbi(field_.scores(blocks))
    return "\n".join(b.text for b, label in zip(blocks, labels) if label)


def extract(pages: DataFrame, field_: Field, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the main text of the whole ``html``.

    Null and empty pages, and pages without article text, have an empty text.  Broken markup (open
    tags at the end, tags that nothing opened) is read as browsers roughly do.  A column named
    ``text`` is replaced; other columns pass.
    """
    kept = [c for c in pages.columns if c != text]
    shared = pages.sparkSession.sparkContext.broadcast(field_)  # of the layouts' size
    at = kept.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([main_text(x.as_py() or "", shared.value) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*kept, text])

    fields = ", ".join(f"`{n}` {t}" for n, t in pages.select(*kept).dtypes)
    return pages.select(*kept).mapInArrow(run, f"{fields}, `{text}` string")


def with_length(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.withColumn("n_chars", F.length(text).cast("long"))
