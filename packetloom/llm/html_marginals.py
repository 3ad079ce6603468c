"""Main text of web pages by a tree-structured graphical model.

The elements of a page's tree are binary variables: main text or not. Each has a potential from its own features, each
parent-child pair one from the child's tag. Sum-product messages, once up and once down the tree, give exact marginals;
text is kept where its element's marginal is above one half. The potentials are fitted by gradient steps on the
likelihood of labelled pages, whose gradient needs the same marginals.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from packetloom.llm.common import table_of, text_batches

TRAINING_PAGES, TRAINING_ROUNDS = 480, 10  # labelled pages; how often each is seen

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(?P<text>[^<]+|<)", re.S
)
HINTS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
# Elements whose text is never shown as part of a page's text.
SILENT = RAW | frozenset("head template svg math object select button canvas audio video datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS_P = BLOCKS - {"caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "html", "body"} | {"hr"}


class Page:
    """A page's elements in order, their parents, and the pieces of text with their element and block."""

    __slots__ = ("tags", "parents", "hints", "pieces", "own", "linked")

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.hints = ["html"], [-1], [()]
        self.pieces: list[tuple[int, int, str]] = []  # (element, block number, text)
        self.own, self.linked = [0], [0]  # characters right in the element, and of those in links
        stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # (tag, element, silent)
        block, links, at, end = 0, 0, 0, len(source)
        find = TOKEN.match
        while at < end:
            token = find(source, at)
            at = token.end() if token else at + 1
            if token is None:
                continue
            text = token["text"]
            if text is not None:
                _, element, silent = stack[-1]
                if not silent:
                    text = html.unescape(text)
                    self.pieces.append((element, block, text))
                    size = len(text.strip())
                    self.own[element] += size
                    if links:
                        self.linked[element] += size
                continue
            tag = token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if token["end"]:
                if any(t == tag for t, _, _ in stack[1:]):
                    while stack[-1][0] != tag:
                        links -= stack.pop()[0] == "a"
                    links -= stack.pop()[0] == "a"
                if tag in BLOCKS or tag == "br":
                    block += 1
                continue
            if tag in ("html", "body") and tag in (t for t, _, _ in stack[1:]):
                continue
            if tag in ENDS_P:
                links -= _close(stack, {"p"}, {"table", "td", "th", "button", "caption"})
            if tag in CLOSES:
                links -= _close(stack, *CLOSES[tag])
            if tag == "body" or (stack[-1][0] == "head" and tag in BLOCKS):
                links -= _close(stack, {"head"}, set())
            if tag in BLOCKS or tag in ("br", "hr"):
                block += 1
            if tag in VOID:
                continue
            silent = stack[-1][2] or tag in SILENT
            rest = token["rest"]
            words = ()
            if rest and not silent:
                words = tuple(w for m in HINTS.finditer(rest) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower()))
                if HIDDEN.search(rest):
                    words += ("hidden",)
            element = stack[-1][1]
            if not silent and (tag in BLOCKS or words):
                element = len(self.tags)
                self.tags.append(tag)
                self.parents.append(stack[-1][1])
                self.hints.append(words)
                self.own.append(0)
                self.linked.append(0)
            if tag in RAW:
                # up to the end tag, whatever stands between
                close = RAW_ENDS[tag].search(source, at)
                at = close.start() if close else end
                found = source.find(">", at)
                at = end if found < 0 else found + 1
                continue
            links += tag == "a"
            stack.append((tag, element, silent))

    def text(self, marginals: list[float]) -> str:
        blocks: dict[int, list[str]] = {}
        for element, block, text in self.pieces:
            if marginals[element] > 0.5:
                blocks.setdefault(block, []).append(text)
        joined = (" ".join("".join(parts).split()) for parts in blocks.values())
        return " ".join(b for b in joined if b)

    def features(self) -> list[list[str]]:
        n = len(self.tags)
        size, linked = list(self.own), list(self.linked)
        for k in range(n - 1, 0, -1):
            size[self.parents[k]] += size[k]
            linked[self.parents[k]] += linked[k]
        found = []
        for k, (tag, words) in enumerate(zip(self.tags, self.hints, strict=True)):
            share = linked[k] * 4 // max(size[k], 1)
            kind = "root" if tag in ("html", "body") else "box"
            found.append([f"tag {tag}", f"{kind} size {min(size[k], 1024).bit_length() // 2}", f"links {share}", f"{tag} links {share}", *(f"word {w}" for w in words)])
        return found


def _close(stack: list[tuple[str, int, bool]], tags: set[str], borders: set[str]) -> int:
    """Close the nearest open element of ``tags`` unless one of ``borders`` is nearer; returns how many links were closed."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in tags:
            links = sum(t == "a" for t, _, _ in stack[k:])
            del stack[k:]
            return links
        if stack[k][0] in borders:
            return 0
    return 0


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


class TreeModel:
    """Weights of features and of parent-child pairs; see :meth:`marginals`."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        #: child's tag ("" for all) -> log potentials of (parent, child) = 00, 01, 10, 11
        self.edges: dict[str, list[float]] = {"": [0.5, -0.5, -0.5, 0.5]}

    def edge(self, tag: str) -> list[float]:
        own = self.edges.get(tag)
        base = self.edges[""]
        return base if own is None else [a + b for a, b in zip(base, own, strict=True)]

    def messages(self, page: Page, features: list[list[str]]) -> tuple[list[float], list[float], list[list[float]], list[float]]:
        """(belief from below, total belief, potentials to the parent, parent's belief without the child), all log-odds but the potentials."""
        n, weights, parents = len(page.tags), self.weights, page.parents
        below = [sum(weights.get(f, 0.0) for f in fs) for fs in features]
        pairs = [self.edge(t) for t in page.tags]
        up = [0.0] * n
        for k in range(n - 1, 0, -1):  # children stand behind their parents
            p00, p01, p10, p11 = pairs[k]
            up[k] = _log_sum(p10, p11 + below[k]) - _log_sum(p00, p01 + below[k])
            below[parents[k]] += up[k]
        total, cavity = list(below), [0.0] * n
        for k in range(1, n):
            p00, p01, p10, p11 = pairs[k]
            cavity[k] = total[parents[k]] - up[k]
            total[k] += _log_sum(p01, p11 + cavity[k]) - _log_sum(p00, p10 + cavity[k])
        return below, total, pairs, cavity

    def marginals(self, page: Page) -> list[float]:
        """Probability of main text of every element."""
        return [_sigmoid(t) for t in self.messages(page, page.features())[1]]

    def fit(self, pages: list[tuple[Page, list[int]]], rounds: int = TRAINING_ROUNDS, rate: float = 0.3) -> TreeModel:
        """Adaptive gradient steps, page by page, on the exact log-likelihood."""
        prepared = [(page, labels, page.features()) for page, labels in pages]
        seen: dict[str, float] = {}
        seen_edges: dict[str, list[float]] = {}
        for _ in range(rounds):
            for page, labels, features in prepared:
                below, total, pairs, cavity = self.messages(page, features)
                for k, fs in enumerate(features):
                    error = labels[k] - _sigmoid(total[k])
                    for f in fs:
                        seen[f] = seen.get(f, 1e-2) + error * error
                        self.weights[f] = self.weights.get(f, 0.0) * 0.9995 + rate * error / math.sqrt(seen[f])
                for k in range(1, len(labels)):
                    p00, p01, p10, p11 = pairs[k]
                    logs = [p00, p01 + below[k], p10 + cavity[k], p11 + cavity[k] + below[k]]
                    top = max(logs)
                    odds = [math.exp(x - top) for x in logs]
                    whole = sum(odds)
                    for tag in ("", page.tags[k]):
                        own = self.edges.setdefault(tag, [0.0] * 4)
                        sums = seen_edges.setdefault(tag, [1e-2] * 4)
                        for j in range(4):
                            error = (2 * labels[page.parents[k]] + labels[k] == j) - odds[j] / whole
                            sums[j] += error * error
                            own[j] = own[j] * 0.9995 + rate * error / math.sqrt(sums[j])
        return self


# Words in classes and ids, for the labelled pages.
MAIN_WORDS = "article content post entry main story text body page prose document copy".split()
SIDE_WORDS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar links pagination pager toc tabs".split(),
    "header": "header masthead banner top branding logo site".split(),
    "footer": "footer bottom copyright legal colophon imprint".split(),
    "aside": "sidebar aside widget related recommended popular trending rail secondary teaser".split(),
    "notice": "cookie notice consent gdpr alert modal popup overlay message hidden disclaimer".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adbox banner commercial".split(),
    "form": "form search newsletter subscribe signup login contact register".split(),
    "comments": "comments comment reply replies discussion respond reviews thread disqus".split(),
    "share": "share social sharing follow buttons tools meta author byline tags".split(),
}


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Pages of many layouts; with each, whether its elements are main text, in the order of :class:`Page`.

    Main parts carry ``data-main`` while they are made, which tells the label of every element below them.
    """
    draw = random.Random(seed)

    def words(least: int, most: int) -> str:
        return " ".join("".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(least, most)))

    def links(tag: str) -> str:
        items = "".join(f"<li><a href='#'>{words(1, 3)}</a></li>" for _ in range(draw.randint(2, 8)))
        return draw.choice([f"<ul>{items}</ul>", f"<ol>{items}</ol>", " ".join(f"<a href='#'>{words(1, 2)}</a>" for _ in range(draw.randint(2, 6)))])

    def named(tag: str, kinds: list[str], inner: str) -> str:
        name = draw.choice(kinds)
        name = draw.choice([name, f"{name}-{draw.choice(['box', 'area', 'wrap', 'container', 'block', 'list', 'inner'])}", f"{draw.choice(['site', 'the', 'main', 'js'])}-{name}"]) if draw.random() < 0.6 else name
        return f"<{tag} {draw.choice(['class', 'class', 'id'])}=\"{name}\">{inner}</{tag}>"

    def side(kind: str) -> str:
        inner = {
            "nav": lambda: links("nav"),
            "header": lambda: f"<{(h := draw.choice(['h1', 'h2', 'p', 'div']))}>{words(1, 5)}</{h}>" + draw.choice(["", links("header")]),
            "footer": lambda: f"<p>&copy; {words(2, 12)}</p>" + draw.choice(["", links("footer")]) if draw.random() < 0.6 else f"&copy; {words(3, 15)}",
            "aside": lambda: f"<h3>{words(1, 4)}</h3>" + draw.choice([links("aside"), f"<p>{words(5, 30)}</p>"]),
            "notice": lambda: draw.choice([f"<p>{words(5, 25)}</p>", words(5, 25)]) + draw.choice(["", "<a href='#'>ok</a>"]),
            "ad": lambda: draw.choice([words(3, 20), f"<p>{words(3, 20)}</p>", f"<a href='#'>{words(2, 8)}</a>"]),
            "form": lambda: f"<label>{words(1, 3)}</label><input>" + draw.choice(["", f"<p>{words(3, 15)}</p>"]),
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(draw.choice([f"<div class='comment'><p>{words(3, 40)}</p></div>", f"<li>{words(3, 30)}</li>"]) for _ in range(draw.randint(1, 4))),
            "share": lambda: links("share"),
        }[kind]()
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if own and draw.random() < 0.6:
            return f"<{own}>{inner}</{own}>" if draw.random() < 0.6 else named(own, SIDE_WORDS[kind], inner)
        return named(draw.choice(["div", "section", "aside" if kind in ("ad", "notice") else "div"]), SIDE_WORDS[kind], inner)

    def paragraph() -> str:
        size = (1, 120) if draw.random() < 0.8 else (1, 4)
        inner = words(*size)
        if draw.random() < 0.3:
            inner += f" <a href='#'>{words(1, 4)}</a> " + words(1, 20)
        if draw.random() < 0.05:
            inner = f"<a href='#'>{words(1, 8)}</a>"
        return draw.choice([f"<p>{inner}</p>"] * 5 + [f"<p>{inner}", f"<blockquote>{inner}</blockquote>", f"<blockquote><p>{inner}</p></blockquote>", f"<div>{inner}</div>"])

    def body() -> str:
        parts = [f"<h1>{words(1, 9)}</h1>"] if draw.random() < 0.85 else []
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 9, 20])):
            parts.append(paragraph())
            pick = draw.random()
            if pick < 0.1:
                parts.append(f"<h{(h := draw.randint(2, 4))}>{words(1, 6)}</h{h}>")
            elif pick < 0.16:
                parts.append("<ul>" + "".join(f"<li>{words(1, 15)}</li>" for _ in range(draw.randint(1, 5))) + "</ul>")
            elif pick < 0.19:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(draw.randint(1, 3))) + "</table>")
            elif pick < 0.22:
                parts.append(f"<pre>{words(2, 20)}</pre><figure><figcaption>{words(2, 9)}</figcaption></figure>")
            elif pick < 0.32:
                parts.append(f"<side>{side(draw.choice(['ad', 'share', 'aside', 'form', 'notice', 'comments']))}</side>")
        if draw.random() < 0.25:  # many short ones, lists as well
            tag = draw.choice(["p", "p", "p", "div", "li", "blockquote"])
            parts += [f"<{tag}>{words(1, draw.choice([2, 4, 9]))}</{tag}>" for _ in range(draw.choice([5, 15, 40, 90]))]
        if not parts or draw.random() < 0.1:
            parts.append(words(3, 60))
        return "".join(parts)

    pages = []
    for _ in range(count):
        before = [side(k) for k in ("header", "nav", "notice", "ad", "form") if draw.random() < 0.45]
        behind = [side(k) for k in ("comments", "aside", "ad", "share", "form", "footer", "notice") if draw.random() < 0.4]
        if draw.random() < 0.5:
            before.append(side("nav"))
        inner = body()
        shape = draw.random()
        if shape < 0.45:
            main = f"<article data-main>{inner}</article>"
        elif shape < 0.6:
            main = f"<main data-main>{inner}</main>" if draw.random() < 0.5 else f"<main data-main><article>{inner}</article></main>"
        elif shape < 0.95:
            name = draw.choice(MAIN_WORDS)
            main = f"<{(t := draw.choice(['div', 'section', 'article']))} data-main {draw.choice(['class', 'id'])}=\"{draw.choice([name, name + '-' + draw.choice(MAIN_WORDS), 'main-' + name])}\">{inner}</{t}>"
        else:
            main = f"<div data-main>{inner}</div>"
        if draw.random() < 0.3:
            main = f"<div class=\"{draw.choice(['wrapper', 'container', 'row', 'layout', 'outer'])}\">{main}{behind.pop(0) if behind and draw.random() < 0.5 else ''}</div>"
        pages.append(f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{main}{''.join(behind)}</body></html>")
    return [(re.sub(r" data-main|</?side>", "", p), _labels(p)) for p in pages]


def _labels(marked: str) -> list[bool]:
    """Labels of a page's elements: below ``data-main`` and not below ``side``."""
    # the marks become class words that the reader of pages sees, and are taken off again
    page = Page(re.sub(r"<(\w+) data-main", r'<\1 id="xxmain"', marked).replace("<side>", '<div id="xxside">').replace("</side>", "</div>"))
    state, labels = [False], [False]
    for tag, parent, hints in zip(page.tags[1:], page.parents[1:], page.hints[1:], strict=True):
        inside = False if "xxside" in hints else state[parent] or "xxmain" in hints
        state.append(inside)
        if "xxside" not in hints:
            labels.append(inside)
    return labels


def trained_model(count: int = TRAINING_PAGES, seed: int = 7, rounds: int = TRAINING_ROUNDS) -> TreeModel:
    return TreeModel().fit([(Page(p), [int(x) for x in labels]) for p, labels in labelled_pages(count, seed)], rounds)


@cache
def _default_model() -> TreeModel:
    return trained_model()


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text): the main text of every whole page; blocks joined by one space, white space made one space.

    A null or empty html gives an empty text; repeated rows are answered each; null ids and urls stay null; other
    columns are not read. Elements are read in one pass without recursion, so depth is no matter; unclosed elements end
    with the page. ``model``: by default one fitted on the driver on the generated labelled pages.
    """
    model = model or _default_model()
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = []
                for _, sources in text_batches([part.select(["page_id", "html"])]):
                    for source in sources:
                        page = Page(source)
                        texts.append(page.text(model.marginals(page)))
                yield table_of(out, part.column(0).cast(pa.int64()), part.column(1), texts)

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id bigint, url string, text string")
