"""Main text of web pages: flat text blocks, judged by a decision tree.

A page becomes a flat list of text blocks. Each has its number of words and its link density, those of
its neighbours, and what its open elements say (tags and names of classes). A decision tree, trained
here on a small table of labelled blocks, keeps or drops every block by these numbers alone. The names
of an article's own classes do not count against it, nor do those of what surrounds a ``main`` element.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vigilseries.llm.samples import LABELLED
from vigilseries.llm.text import column, row_struct

# Elements that begin and end a block, that hold no text, that close themselves (fixed values).
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = set("script style noscript template svg head title iframe object canvas math".split())
RAW = set("script style textarea title noscript iframe".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set("nav aside footer form menu dialog button select option fieldset label".split())
STORY = set("article main".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|side-?bar\w*|side|foot\w*|head|header|mast\w*|banner\w*|ads?|advert\w*|"
    r"sponsor\w*|promo\w*|comment\w*|discuss\w*|repl(?:y|ies)|disqus\w*|respond|cookie\w*|consent\w*|notice\w*|"
    r"gdpr|alert\w*|popup\w*|modal\w*|overlay\w*|share\w*|social\w*|related\w*|recommend\w*|crumbs?|"
    r"breadcrumbs?|newsletter\w*|subscri\w*|signup|login\w*|search\w*|pagination|pager|tags?|widget\w*|"
    r"toolbar\w*|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)
# Names that say what a page has or is in, not what the element is; names of single remarks (fixed values).
STATES = re.compile(r"(?<!\S)(?:has|with|no|without|is)-\S+", re.I)
REMARKS = re.compile(r"(?<!\S)(?:comments?|repl(?:y|ies)|comment-\d+|related|teaser)(?!\S)", re.I)
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|"
    r"<[!?][^>]*(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ROLE = re.compile(r"\brole\s*=\s*[\"']?([\w-]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# A paragraph or item that is still open ends where the next of its kind, or any block, begins.
ENDS = {
    "p": BLOCKS,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}


@dataclass(frozen=True)
class _Open:
    """An open element, and what it or any element around it is."""

    tag: str = ""
    furniture: bool = False
    story: bool = False
    silent: bool = False
    linked: bool = False
    heading: bool = False
    item: bool = False
    hidden: bool = False


HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    story: bool
    heading: bool
    item: bool


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; markup may be broken or end anywhere."""
    found: list[Block] = []
    stack = [_Open()]
    number: dict[str, int] = {}  # of open elements by tag
    text: list[str] = []
    links: list[str] = []

    def close_block() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            top, linked = stack[-1], len(html.unescape("".join(links)).split())
            found.append(
                Block(" ".join(words), len(words), linked, top.furniture, top.story, top.heading, top.item)
            )
        text.clear()
        links.clear()

    def close_from(k: int) -> None:
        for element in stack[k:]:
            number[element.tag] -= 1
        del stack[k:]

    def add(part: str) -> None:
        if part and not stack[-1].silent:
            text.append(part)
            if stack[-1].linked:
                links.append(part)

    at, end = 0, len(page)
    while at < end:
        token = TOKEN.search(page, at)
        add(page[at : token.start() if token else end])
        if not token:
            break
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            if tag in BLOCKS or tag in SILENT:
                close_block()
            if number.get(tag):
                close_from(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            continue
        if tag == "br":
            add(" ")
        if tag in BLOCKS or tag in SILENT:
            close_block()
        if tag in VOID or token["rest"].rstrip().endswith("/"):
            continue
        if tag in ENDS.get(stack[-1].tag, ()):
            close_from(len(stack) - 1)
        elif tag in BLOCKS and number.get("p"):  # a paragraph ends even under inline elements
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in BLOCKS)
            if stack[k].tag == "p":
                close_from(k)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            stop = close.start() if close else end
            if tag not in SILENT:
                add(page[at:stop])
            at = close.end() if close else end
            continue
        names = " ".join(x for m in NAMES.findall(token["rest"]) for x in m if x)
        role = ROLE.search(token["rest"])
        top = stack[-1]
        hidden = bool(HIDDEN.search(token["rest"]))
        centre = tag == "main" or bool(role and role[1].lower() == "main")
        # Names on the story itself are topics and settings; on a page around it likewise.
        if tag == "article":
            named = bool(REMARKS.search(names))
        else:
            named = tag not in ("body", "html") and bool(NAMED.search(STATES.sub("", names)))
        furniture = (
            tag in FURNITURE
            or (tag == "header" and not top.story)
            or (named and not centre)
            or bool(role and role[1].lower() in ROLES)
            or hidden
        )
        story = tag in STORY or centre
        number[tag] = number.get(tag, 0) + 1
        stack.append(
            _Open(
                tag, furniture or (top.furniture and not (centre and not top.hidden)), top.story or story, top.silent or tag in SILENT,
                top.linked or tag == "a", top.heading or tag in HEADINGS, top.item or tag == "li",
                top.hidden or hidden,
            )
        )
    close_block()
    return found


FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after",
    "furniture", "story", "heading", "item", "page_has_story",
)


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block; outside the page there is nothing."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    density = np.array([b.linked / b.words for b in found], float)
    has_story = float(any(b.story and not b.furniture for b in found))
    flags = np.array([[b.furniture, b.story, b.heading, b.item] for b in found], float).reshape(n, 4)

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n)
        if by > 0:
            out[by:] = x[:-by]
        else:
            out[:by] = x[-by:]
        return out

    columns = [words, density, moved(words, 1), moved(density, 1), moved(words, -1), moved(density, -1)]
    return np.column_stack([*columns, flags, np.full(n, has_story)])


@dataclass
class Tree:
    """Inner nodes test ``x[feature] <= border``: left, else right; leaves carry a label."""

    feature: list[int]
    border: list[float]
    left: list[int]
    right: list[int]
    label: list[bool]

    def keep(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if self.feature[node] < 0:
                out[rows] = self.label[node]
                continue
            low = x[rows, self.feature[node]] <= self.border[node]
            waiting += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out


def _gini(positive: float, n: float) -> float:
    return 2 * positive * (n - positive) / n if n else 0.0


def train(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """A classification tree by Gini impurity; of equal splits the first feature's lowest wins."""
    tree = Tree([], [], [], [], [])

    def grow(rows: np.ndarray, level: int) -> int:
        node = len(tree.feature)
        for values, value in (
            (tree.feature, -1), (tree.border, 0.0), (tree.left, -1), (tree.right, -1),
            (tree.label, bool(y[rows].sum() * 2 > len(rows))),
        ):
            values.append(value)
        whole = _gini(y[rows].sum(), len(rows))
        best = (whole - 1e-9, -1, 0.0)
        if level < depth and whole > 0:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                values, hits = x[order, f], np.cumsum(y[order])
                for k in np.flatnonzero(values[1:] > values[:-1]) + 1:
                    if least <= k <= len(rows) - least:
                        cost = _gini(hits[k - 1], k) + _gini(hits[-1] - hits[k - 1], len(rows) - k)
                        if cost < best[0]:
                            best = (cost, f, (values[k - 1] + values[k]) / 2)
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            tree.feature[node], tree.border[node] = best[1], best[2]
            tree.left[node] = grow(rows[low], level + 1)
            tree.right[node] = grow(rows[~low], level + 1)
        return node

    grow(np.arange(len(y)), 0)
    return tree


def labelled_table(pages: list[str] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages; a block's text starts with ``+`` if
    it belongs to the main text, else with ``-``."""
    xs, ys = [], []
    for page in pages:
        found = blocks(page)
        xs.append(features(found))
        ys += [b.text.startswith("+") for b in found]
    return np.vstack(xs), np.array(ys, float)


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.keep(features(found))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extracted(pages: DataFrame, html_column: str = "html", tree: Tree | None = None) -> DataFrame:
    """``row`` (all columns of ``pages`` but the markup) and ``text``, for every row.

    A null or empty page has an empty text, as has one without a block that is kept. Repeated pages
    are treated alike; an empty table gives an empty result.
    """
    tree = tree or train(*labelled_table())
    others = tuple(c for c in pages.columns if c != html_column)
    chosen = pages.select(row_struct(pages.select(*[column(c) for c in others])).alias("row"), column(html_column).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = [main_text(page, tree) for page in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.string())], ["row", "text"]
                )

    return chosen.mapInArrow(
        extract, T.StructType([chosen.schema["row"], T.StructField("text", T.StringType())])
    )
