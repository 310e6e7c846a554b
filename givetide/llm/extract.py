"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from givetide.llm.common import about
from givetide.llm.dom import Node, features, parse
from givetide.sources.warehouse import settle

#: Pages whose sentences fill the training pages (about), training pages, and size of the model.
SAMPLE_PAGES = 200
TRAINING_PAGES = 700
TREES = 20
DEPTH = 5

KEPT, DROPPED = "keep", "drop"


class PageMaker:
    """Makes labelled training pages of many layouts; every marked element says whether it is main text.

    There are no labelled pages, so the layouts state what is main text: the article's headings, paragraphs, lists,
    tables and quotes, and nothing of what stands around or between.
    """

    def __init__(self, sentences: list[str], seed: int):
        self.random, self.sentences = random.Random(seed), sentences

    def pick(self, *options: str) -> str:
        return self.random.choice(options)

    def chance(self, p: float) -> bool:
        return self.random.random() < p

    def sentence(self) -> str:
        return self.pick(*self.sentences) if self.sentences else "Words of a page."

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.random.randint(low, high)))

    def short(self) -> str:
        return " ".join(self.sentence().split()[: self.random.randint(1, 4)])

    def named(self, tags: str, words: str, often: float = 0.9) -> tuple[str, str]:
        """A tag, and attributes of which one or two of the words are part."""
        tag = self.pick(*tags.split())
        if not self.chance(often):
            return tag, ""
        name = self.pick(*words.split())
        shape = self.pick('class="{0}"', 'id="{0}"', 'class="{0} {1}"', 'class="site-{0}"', 'class="{0}-{2}" id="{2}-{0}"', 'role="{0}"', "class={0}")
        return tag, " " + shape.format(name, self.pick("wide", "col-4", "left", "box"), self.pick("wrap", "container", "inner", "block"))

    def element(self, label: str, tags: str, words: str, inside: str, often: float = 0.9) -> str:
        tag, attributes = self.named(tags, words, often)
        return f'<{tag}{attributes} data-truth="{label}">{inside}</{tag}>'

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/{i}">{self.short()}</a>' for i in range(self.random.randint(low, high))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.chance(0.7) else self.pick(" | ", " ").join(items)

    def menu(self) -> str:
        return self.element(DROPPED, "nav nav div ul header", "nav menu navbar navigation breadcrumb topnav", self.links(), 0.6) if self.chance(0.8) else f'<nav data-truth="drop">{self.links()}</nav>'

    def header(self) -> str:
        inside = self.pick(f"<h1>{self.short()}</h1>", f"<div>{self.short()}</div>", f"<p>{self.sentence()}</p>", "") + (self.menu() if self.chance(0.6) else "")
        return self.element(DROPPED, "header header div", "header masthead banner topbar branding logo", inside + self.short())

    def footer(self) -> str:
        inside = self.pick("&copy; 2024 ", "&copy; ", "Contact ", "") + self.pick(self.short(), self.sentence(), f"<p>{self.sentence()}</p>{self.links(2, 4)}", f"example.org &middot; {self.sentence()}")
        return self.element(DROPPED, "footer footer div section", "footer copyright legal bottom colophon", inside)

    def aside(self) -> str:
        inside = f"<h3>{self.short()}</h3>" * self.chance(0.5) + self.pick(self.links(), f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2))
        return self.element(DROPPED, "aside aside div section", "sidebar widget related rail recommended trending popular more", inside)

    def notice(self) -> str:
        inside = self.pick(self.prose(1, 2), f"<p>{self.prose(1, 3)}</p><button>{self.short()}</button>", f"<p>{self.sentence()}</p>{self.links(1, 2)}")
        return self.element(DROPPED, "div div section p", "cookie cookies consent notice popup modal gdpr alert cookie-notice cookie-banner privacy-notice overlay announcement", inside)

    def advert(self) -> str:
        return self.element(DROPPED, "div div div section aside p", "ad ads advert advertisement sponsored promo ad-slot sponsor", self.pick(self.sentence(), f"<p>{self.prose(1, 2)}</p>", f'<a href="/x">{self.prose(1, 2)}</a>'))

    def form(self) -> str:
        inside = self.pick(f"<label>{self.short()}</label><input type=text>", f"<p>{self.sentence()}</p><input name=mail><button>{self.short()}</button>", f"<fieldset>{self.sentence()}<input></fieldset>")
        if self.chance(0.7):
            return f'<form data-truth="drop" action="/s"{self.pick("", " class=search", " id=subscribe")}>{inside}</form>'
        return self.element(DROPPED, "div section", "newsletter subscribe signup login search-form subscription", inside)

    def comments(self) -> str:
        one = lambda: self.element(DROPPED, "div li article p section", "comment reply comment-body comment-text", self.pick(f"<p>{self.prose(1, 4)}</p>", f"<b>{self.short()}</b> {self.prose(1, 3)}"))
        inside = f"<h3>{self.short()}</h3>" * self.chance(0.6) + "".join(one() for _ in range(self.random.randint(1, 5))) + (self.form() if self.chance(0.3) else "")
        return self.element(DROPPED, "div section ol aside", "comments discussion respond replies disqus reader-comments comment-list feedback", inside)

    def share(self) -> str:
        return self.element(DROPPED, "div ul p", "share social sharing follow tags", self.links(2, 5))

    def paragraph(self) -> str:
        p = self.prose(1, 6)
        kind = self.random.random()
        if kind < 0.6:
            return f"<p>{p}</p>"
        if kind < 0.7:
            return f"<p><b>{self.sentence()}<br>" if self.chance(0.5) else f"<p>{p}"
        if kind < 0.8:
            return f'<p>{p} <a href="/y">{self.short()}</a> {self.sentence()}</p>'
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(self.random.randint(2, 5))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{self.pick(p, f'<p>{p}</p>')}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.short()}</td><td>{self.short()}</td></tr>" for _ in range(self.random.randint(2, 4))) + "</table>"
        if kind < 0.97:
            return f"<h2>{self.short()}</h2><p>{p}</p>"
        return f"<div>{p}</div>" if self.chance(0.7) else f"<pre>{p}</pre>"

    def article(self) -> str:
        parts = [f"<h1>{self.pick(self.short(), self.sentence())}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.random.expovariate(0.18)) + (0 if parts and self.chance(0.1) else 1)):
            parts.append(self.paragraph())
            if self.chance(0.06):
                parts.append(self.pick(self.advert(), self.aside(), self.share(), self.notice(), self.form()))
        tag, attributes = self.named("article article article main div section", "content article post entry main body story text", 0.5)
        if tag in ("div", "section") and not attributes:
            attributes = f' class="{self.pick("content", "post", "entry", "article-body", "story")}"'
        inside = "".join(parts)
        if self.chance(0.08):
            inside += self.comments()
        return f'<{tag}{attributes} data-truth="keep">{inside}</{tag}>'

    def page(self) -> str:
        around = lambda makers, p: "".join(make() for make in makers if self.chance(p))
        before = around([self.notice, self.header, self.menu, self.advert, self.aside, self.form], 0.4)
        after = around([self.share, self.comments, self.aside, self.advert, self.form, self.notice, self.footer, self.menu], 0.4)
        middle = self.article()
        if self.chance(0.3):
            tag = self.pick("div", "main", "section")
            middle = f"<{tag}{self.pick('', ' id=main', ' class=wrapper', ' class=container')}>{around([self.advert, self.aside, self.menu], 0.2)}{middle}{around([self.comments, self.aside, self.share], 0.3)}</{tag}>"
        return f"<!DOCTYPE html><html><head><title>{self.short()}</title></head><body data-truth=drop>{before}{middle}{after}</body></html>"


def labels_of(nodes: list[Node]) -> list[float]:
    """1 where main text stands in the subtree: a text block by its own marker, an element by any of its blocks."""
    out = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].tag == "#text" and nodes[i].truth == KEPT:
            out[i] = 1.0
        if out[i] and nodes[i].parent >= 0:
            out[nodes[i].parent] = 1.0
    return out


class Trees:
    """Boosted regression trees as flat arrays, applied to many nodes at once."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], weights: list[float]):
        self.trees = [tuple(np.array(c) for c in zip(*t, strict=True)) for t in trees]
        self.weights = weights

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                down = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
                at = np.where(feature[at] >= 0, down, at)
            total += weight * value[at]
        return total


def _flat(node) -> list[tuple[int, float, int, int, float]]:
    """A tree of Spark's model as rows (feature or -1, threshold, left, right, value)."""
    rows: list[tuple[int, float, int, int, float]] = []

    def walk(n) -> int:
        at = len(rows)
        rows.append((-1, 0.0, at, at, float(n.prediction())))
        if n.subtreeDepth():
            split = n.split()
            left, right = walk(n.leftChild()), walk(n.rightChild())
            rows[at] = (split.featureIndex(), float(split.threshold()), left, right, float(n.prediction()))
        return at

    walk(node)
    return rows


def train(spark: SparkSession, pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", trees: int = TREES, training: int = TRAINING_PAGES) -> Trees:
    """Fit the node classifier on ``training`` made pages, filled with sentences of about ``SAMPLE_PAGES`` pages."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    chosen = about(pages.filter(F.col(html_col).isNotNull()), SAMPLE_PAGES, pages.count(), id_col, html_col)

    def cut(batches):
        for batch in batches:
            found = sorted({n.text for page in batch.column("page").to_pylist() for n in parse(page) if n.tag == "#text" and 10 < len(n.text) < 400})
            yield pa.RecordBatch.from_pydict({"text": pa.array(found, pa.string())})

    sentences = sorted(r[0] for r in chosen.select(F.col(html_col).cast("string").alias("page")).mapInArrow(cut, "text string").distinct().limit(50_000).collect())

    def make(batches):
        for batch in batches:
            rows, y = [], []
            for seed in batch.column("id").to_pylist():
                nodes = parse(PageMaker(sentences, seed).page())
                rows += features(nodes)
                y += labels_of(nodes)
            yield pa.RecordBatch.from_pydict({"x": rows, "label": y}, schema=pa.schema([("x", pa.list_(pa.float64())), ("label", pa.float64())]))

    nodes = settle(spark.range(0, training, 1, 6).mapInArrow(make, "x array<double>, label double"))
    model = GBTClassifier(maxIter=trees, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(nodes.select(array_to_vector("x").alias("features"), "label"))
    return Trees([_flat(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The likeliest labels in which whatever stands below a dropped node is dropped.

    Upward, each node learns what its subtree is worth if it is kept, each child then free, and if it is dropped
    whole; downward, the better of the two is taken. The page itself is kept.
    """
    yes = -np.logaddexp(0, -2 * margin)
    no = -np.logaddexp(0, 2 * margin)
    keep, drop = yes.tolist(), no.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


def main_text(spark: SparkSession, pages: DataFrame, model: Trees | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, its blocks in page order joined by a line end.

    Null and empty pages, and pages in which nothing is main text, have an empty text. Scripts, styles, comments of
    the markup, forms' fields and the head are never text; an unclosed one of them ends with the page. Character
    references are decoded and white space within a block becomes one space. Equal rows get equal results, null ids
    and urls stay null. Whole pages are read, however long. An empty table gives no rows. Other columns are ignored.
    """
    model = model or train(spark, pages, id_col=id_col, html_col=html_col)

    def extract(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                parsed = [parse(page) if page else [] for page in part.column("html").to_pylist()]
                rows = [r for nodes in parsed for r in features(nodes)] if any(parsed) else []
                margin = model.margin(np.array(rows)) if rows else np.zeros(0)
                texts, at = [], 0
                for nodes in parsed:
                    kept = decode(nodes, margin[at : at + len(nodes)]) if nodes else []
                    at += len(nodes)
                    texts.append("\n".join(n.text for n, k in zip(nodes, kept, strict=True) if k and n.text))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extract, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
