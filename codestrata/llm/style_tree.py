"""Main text of pages by a site style tree.

The block elements of all pages of a host are merged by their path. A node's
presentation importance is the entropy of the child sequences it is seen with,
its content importance one minus the mean entropy of its texts over the pages.
Branches of low importance are removed from every page of the host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from codestrata.session import stage

#: Weight of a node's children in its importance is DAMPING to the power of its child sequences.
DAMPING = 0.9
#: Branches below this importance go; nodes on fewer pages are kept.
LEAST_IMPORTANCE, LEAST_PAGES = 0.25, 5
#: Steps of a path; deeper elements count as their ancestor of this depth.
DEEPEST = 40

# Element names by what HTML makes of them.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_NO_TEXT = frozenset(
    "aside button canvas audio video dialog datalist footer form iframe map math menu nav noscript object script select style svg "
    "template textarea title".split()
)
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist")),
}
_HIDDEN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar tooltip".split())
#: Words in class or id that mark what is not the article.
_NOISE_WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall nav navbar navigation "
    "menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars widget widgets related recommended recommendations share "
    "sharing social footer header masthead topbar toolbar comment comments commentlist disqus respond replies login skiplink".split()
)
_QUALIFIERS = frozenset("no has with without".split())

_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^>]*>))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    path: str
    text: str
    noise: bool


@dataclass
class Page:
    """Text blocks in page order, and the child sequence of every block element by path."""

    blocks: list[Block] = field(default_factory=list)
    children: list[tuple[str, str]] = field(default_factory=list)


class _Node:
    __slots__ = ("tag", "path", "noise", "inside", "depth", "below")

    def __init__(self, tag: str, path: str, noise: int, inside: bool, depth: int):
        self.tag, self.path, self.noise, self.inside, self.depth = tag, path, noise, inside, depth
        self.below: list[str] = []


def _role(tag: str, attributes: str, inside: bool) -> tuple[int, str]:
    """How sure an element is noise (0 no, 1 by its names, 2 by its kind), and its step in the path."""
    step, noise = tag, 2 if tag in _NO_TEXT or (tag == "header" and not inside) else 0
    if not attributes.strip():
        return noise, step
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = _WORD.findall(_CAMEL.sub(" ", names).lower()) if names != " " else []
    if words:
        step = f"{tag}.{'.'.join(words[:6])}"
        marked = _NOISE_WORDS.intersection(words)
        if inside:
            marked -= {"header"}
        if marked and not _QUALIFIERS.intersection(words) and tag not in ("html", "body", "main"):
            noise = max(noise, 1)
    if (
        "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _HIDDEN_ROLES
        or "display:none" in found.get("style", "").replace(" ", "").lower()
    ):
        noise = 2
    return noise, step


def parse(html: str | None) -> Page:
    """Blocks of a page. Unclosed and stray tags are borne as browsers do, roughly."""
    page = Page()
    if not html:
        return page
    root = _Node("#root", "", 0, False, 0)
    stack, blocks = [root], [root]
    open_: dict[str, int] = {}
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                at = blocks[-1]
                page.blocks.append(Block(at.path, joined, at.noise > 0))
            text.clear()

    def add(some: str) -> None:
        # noise inside a line of text leaves a gap
        text.append(" " if stack[-1].noise and not blocks[-1].noise else some)

    def pop() -> None:
        node = stack.pop()
        open_[node.tag] -= 1
        if blocks[-1] is node:
            blocks.pop()
            page.children.append((node.path, ",".join(node.below)))

    def close(tag: str) -> None:
        while stack[-1].tag != tag:
            pop()
        pop()

    at, last = 0, html.rfind(">") + 1  # no tag ends after it
    while True:
        m = _TAG.search(html, at, last) if at < last else None
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag, ends = m[3].lower(), bool(m[2])
        if tag == "br":
            text.append(" ")
            continue
        block = tag in _BLOCK
        if ends:
            if block:
                flush()
            if open_.get(tag):
                close(tag)
            continue
        if block:
            flush()
            if open_.get("p") and tag not in ("html", "head", "body"):
                close("p")
            if tag in _CLOSES:
                ended, limits = _CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in limits:
                        break
                    if stack[i].tag in ended.split():
                        while len(stack) > i:
                            pop()
                        break
            if tag == "body" and open_.get("head"):
                close("head")
        parent = stack[-1]
        noise, step = _role(tag, m[4] or "", parent.inside)
        if tag == "main" and parent.noise == 1 or tag == "article" and parent.noise == 1 and not noise and not parent.inside:
            noise = 0
        else:
            noise = max(noise, parent.noise)
        if block:
            blocks[-1].below.append(step)
        if tag in _VOID or tag == "hr":
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = len(html) if end is None else end.start()
            if end is not None:
                closing = html.find(">", at)
                at = len(html) if closing < 0 else closing + 1
            continue
        depth = parent.depth + block
        path = f"{blocks[-1].path}>{step}" if block and depth <= DEEPEST else blocks[-1].path
        node = _Node(tag, path, noise, parent.inside or tag in ("article", "main"), depth)
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
        if block:
            blocks.append(node)
    flush()
    while len(stack) > 1:
        pop()
    return page


def protected(path: str) -> bool:
    """Whether a path lies in what the page itself calls its article or main part."""
    return any(s.split(".")[0] in ("article", "main") for s in path.split(">"))


def host_of(url: str | None) -> str:
    """Host of a url, lower case; empty without one."""
    rest = (url or "").split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].lower()


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: host, path, kind (0 child sequence, 1 text, 2 page), feature, n and n log n over pages."""
    for b in batches:
        seen: dict[tuple[str, str, int, int], list[float]] = {}
        for url, html in zip(b.column("url").to_pylist(), b.column("html")):
            page, host = parse(html.as_py()), host_of(url)
            own: dict[tuple[str, str, int, int], int] = {}
            for path, below in page.children:
                own[host, path, 2, 0] = 1
                if below:
                    key = (host, path, 0, xxhash.xxh64_intdigest(below) >> 1)
                    own[key] = own.get(key, 0) + 1
            for block in page.blocks:
                key = (host, block.path, 1, xxhash.xxh64_intdigest(block.text) >> 1)
                own[key] = own.get(key, 0) + 1
            for key, n in own.items():
                s = seen.setdefault(key, [0, 0.0])
                s[0] += n
                s[1] += n * log(n)
        keys = list(zip(*seen)) or [[], [], [], []]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(k, t) for k, t in zip(keys, kinds)), pa.array([int(v[0]) for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.float64())],
            ["host", "path", "kind", "feature", "n", "nlogn"],
        )


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every node of every host's style tree."""
    rows = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        _observed, "host string, path string, kind int, feature long, n long, nlogn double"
    )
    features = rows.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("nlogn").alias("nlogn"))

    def when(kind: int, value):
        return F.sum(F.when(F.col("kind") == kind, value))

    nodes = stage(features.groupBy("host", "path").agg(
        F.coalesce(when(2, F.col("n")), F.lit(1)).alias("pages"),
        F.coalesce(when(0, F.lit(1)), F.lit(0)).alias("sequences"),
        F.coalesce(when(0, F.col("n")), F.lit(0)).alias("drawn"),
        F.coalesce(when(0, F.col("n") * F.log("n")), F.lit(0.0)).alias("drawn_log"),
        F.coalesce(when(1, F.lit(1)), F.lit(0)).alias("texts"),
        F.coalesce(when(1, F.log("n") - F.col("nlogn") / F.col("n")), F.lit(0.0)).alias("spread"),
    ))
    own = F.when(F.col("pages") > 1, F.col("spread") / F.log("pages")).otherwise(0.0)
    steps = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), ">"))
    branch = (
        nodes.filter("texts > 0").select("host", F.explode(above).alias("path"), own.alias("spread"), "texts")
        .groupBy("host", "path").agg((1 - F.sum("spread") / F.sum("texts")).alias("content"))
    )
    drawn = F.when(F.col("drawn") > 1, (F.log("drawn") - F.col("drawn_log") / F.col("drawn")) / F.log("drawn")).otherwise(1.0)
    weight = F.pow(F.lit(DAMPING), F.col("sequences"))
    return nodes.join(branch, ["host", "path"]).select(
        "host", "path", "pages", ((1 - weight) * drawn + weight * F.col("content")).alias("importance")
    )


def extract(
    pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``.

    Menus, page headers and footers, sidebars, notices, adverts, forms, scripts
    and comments that name themselves by element, role, class or id have no
    importance; what lies in an article or main element is not judged by
    entropy; all other branches are kept if their importance on their host is
    ``least`` or more, or if fewer than ``least_pages`` pages have them. Null and
    empty html give an empty text, null urls share the empty host, repeated rows
    are extracted alike, an empty table gives an empty result; only page_id, url
    and html are read. Character references are decoded, white space inside a
    block is one space, blocks are joined by two line ends.
    """
    low = stage(
        importance(pages).filter((F.col("importance") < least) & (F.col("pages") >= least_pages))
        .groupBy("host").agg(F.collect_list("path").alias("removed"))
    )
    rest = F.element_at(F.split(F.coalesce(F.col("url").cast("string"), F.lit("")), "://", 2), -1)
    named = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
        F.lower(F.substring_index(F.element_at(F.split(rest, "[/?#]", 2), 1), "@", -1)).alias("host"),
    ).join(low, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for html, removed in zip(b.column("html"), b.column("removed").to_pylist()):
                gone = set(removed or ())
                kept: dict[str, bool] = {}
                out = []
                for block in parse(html.as_py()).blocks:
                    if block.noise:
                        continue
                    good = kept.get(block.path)
                    if good is None:
                        parts = block.path.split(">")
                        good = not gone or protected(block.path) or not any(">".join(parts[:k]) in gone for k in range(1, len(parts) + 1))
                        kept[block.path] = good
                    if good:
                        out.append(block.text)
                texts.append("\n\n".join(out))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
                ["page_id", "url", "text", "n_chars"],
            )

    return named.select("page_id", "url", "html", "removed").mapInArrow(run, "page_id long, url string, text string, n_chars long")
