"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its path from the root (tag names, a
div, section or span with its first class or id). Nodes below elements that are never
article text by their tag or by a role, class or id that is one of a few names are left
out at once. A name that only holds such a word (``related-work``) weighs but doesn't
decide: its paths are steps of their own, and stay only if their ratios, halved, are over
the threshold. For each path the
text length, the punctuation, the text inside links and the number of nodes are
summed; length and punctuation for each node are the two ratios. The ratios are
smoothed over similar paths (a path's weight halves with each step from one to the
other), fused by their product, and thresholded by their standard deviation over the
page. Paths over the threshold are seeds; their text is added up at all elements around
them, and the lowest container that holds nearly all of it is the article's. All of its
paths are content but blocks of links, so that a short paragraph, a list or a heading
isn't lost; where that is the whole page, only its parts that hold seeds.

Paths are nodes of a tree; smoothing and sums go up and down it once, so that the work is
linear in the page whatever its depth.

A block element begins and ends a block; ``br`` counts as white space. Character
references are decoded; white space is that of ASCII, so a no-break space stays.

Defined cases: null or empty html, or no article: empty text; broken markup: open
elements end with their parent, stray end tags are ignored, a document may stop
anywhere; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verspan.llm.common import map_texts, table

# HTML's element kinds, and names that mark what is not article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea menu dialog title".split())
NOISE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottombar comment comments commentlist replies reply respond discussion disqus share sharing social related recommended widget login signup pagination pager complementary contentinfo search".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead")}
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}
SCOPE = frozenset("html body article main section div td th ul ol dl table aside nav footer header form blockquote".split())
#: Elements that can be an article's; sections, lists, tables and quotes are parts of one.
CONTAINERS = frozenset("html body main article div td".split())
#: The share of the seeds' text that the article's element holds.
NEARLY_ALL = 0.9
#: What a name that holds a noise word leaves of a path's score.
DOUBT = 0.5
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(>|$|(?=<))", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_WHITE = re.compile(r"[ \t\n\x0b\x0c\r]+")


class Paths:
    """The tree of paths: for each its parent, step, tag, depth, the path of the block around it and whether a name speaks against it."""

    def __init__(self):
        self.parent, self.tag, self.depth, self.block, self.doubtful, self._known = [0], [""], [0], [0], [False], {}

    def child(self, parent: int, step: str, tag: str) -> int:
        known = self._known.get((parent, step))
        if known is None:
            known = self._known[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.depth.append(self.depth[parent] + 1)
            self.block.append(known if tag in BLOCK else self.block[parent])
            self.doubtful.append(self.doubtful[parent] or step.endswith("?"))
        return known


class Node:
    """A text node: its block's number, path, text and whether it is in a link."""

    __slots__ = ("block", "link", "path", "text")

    def __init__(self, block: int, path: int, text: str, link: bool):
        self.block, self.path, self.text, self.link = block, path, text, link


def _step(tag: str, attrs: str, within_article: bool) -> tuple[str, bool]:
    """(path step, whether the element is noise); the step of an element whose names only hold a noise word ends with ``?``."""
    noise, doubtful = tag in NOISE or tag == "header" and not within_article, False
    step = tag
    if attrs and "=" in attrs:
        for name, value in _ATTR.findall(attrs):
            value = value.lower()
            words = _WORD.findall(value)
            if words and tag in ("div", "section", "span", "ul", "table") and step == tag:
                step = f"{tag}.{words[0]}"
            if tag not in ("html", "body", "article", "main"):
                if not NOISE_NAMES.isdisjoint(value.strip("\"'").split()):
                    noise = True
                elif not NOISE_NAMES.isdisjoint(words):
                    doubtful = True
    return step + "?" * doubtful, noise


def text_nodes(page: str) -> tuple[list[Node], Paths]:
    """Text nodes outside noise, in page order, and their paths."""
    out: list[Node] = []
    paths = Paths()
    stack: list[tuple[str, int, bool]] = []  # tag, path, noise
    open_tags: dict[str, int] = {}
    noisy, block, at, size, path = 0, 0, 0, len(page), 0

    def pop(k: int) -> None:
        nonlocal noisy, block, path
        for tag, _, noise in stack[k:]:
            noisy -= noise
            open_tags[tag] -= 1
            block += tag in BLOCK
        del stack[k:]
        path = stack[-1][1] if stack else 0

    def close_open(tags: tuple[str, ...]) -> None:
        if not any(open_tags.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                pop(k)
                return
            if stack[k][0] in SCOPE:
                return

    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at and not noisy:
            text = page[at:end]
            out.append(Node(block, path, " " if text.isspace() else text, open_tags.get("a", 0) > 0))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if open_tags.get(tag):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
            if tag in BLOCK:
                block += 1
            continue
        if tag in BLOCK:
            block += 1
            if tag in CLOSES_P:
                close_open(("p",))
            if tag in CLOSES:
                close_open(CLOSES[tag])
        if tag in VOID:
            if tag == "br" and not noisy:
                out.append(Node(block, path, " ", open_tags.get("a", 0) > 0))
            continue
        if tag in RAW:
            found = re.compile(f"</{tag}", re.I).search(page, at)
            stop = page.find(">", found.end()) if found else -1
            at = stop + 1 if stop >= 0 else size
            continue
        step, noise = _step(tag, m[3], bool(open_tags.get("article") or open_tags.get("main")))
        path = paths.child(path, step, tag)
        stack.append((tag, path, noise))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        noisy += noise
    return out, paths


def smoothed(own: dict[int, float], paths: Paths) -> list[float]:
    """For each path the sum over all paths of their value, halved with each step from one to the other.

    below[v] is that sum over what lies at or below v, seen from v; around[v] over all other paths.
    """
    n = len(paths.parent)
    below, around = [0.0] * n, [0.0] * n
    for v, x in own.items():
        below[v] = x
    for v in range(n - 1, 0, -1):  # parents come before their children
        below[paths.parent[v]] += below[v] / 2
    for v in range(1, n):
        p = paths.parent[v]
        around[v] = (around[p] + below[p]) / 2 - below[v] / 4
    return [a + b for a, b in zip(below, around)]


def fused_ratios(sums: dict[int, list[float]], paths: Paths) -> np.ndarray:
    """The score of each path: smoothed length times smoothed punctuation, less what is links."""
    weight = smoothed(dict.fromkeys(sums, 1.0), paths)
    length = smoothed({p: s[0] / s[2] for p, s in sums.items()}, paths)
    punctuation = smoothed({p: (1 + s[1]) / s[2] for p, s in sums.items()}, paths)
    return np.array([length[p] / weight[p] * (punctuation[p] / weight[p]) * (1 - s[3] / max(s[0], 1)) for p, s in sums.items()])


def content_paths(nodes: list[Node], paths: Paths) -> set[int]:
    """Paths whose nodes are article text."""
    sums: dict[int, list[float]] = {}
    for n in nodes:
        if n.text != " ":
            s = sums.setdefault(n.path, [0, 0, 0, 0])
            k = len(n.text.strip())
            s[0] += k
            s[1] += len(PUNCTUATION.findall(n.text))
            s[2] += 1
            s[3] += k if n.link else 0
    if not sums:
        return set()
    fused = fused_ratios(sums, paths) * np.array([DOUBT if paths.doubtful[p] else 1.0 for p in sums])
    threshold = min(fused.std(), fused.max())
    over = {p for p, ok in zip(sums, fused >= threshold) if ok}
    seeds = {p for p in over if not paths.doubtful[p]} or over
    # text of the seeds at every container around them; a cell with text of its own is data, not a container
    size = len(paths.parent)
    direct, held = [0.0] * size, [0.0] * size
    for p in seeds:
        direct[paths.block[p]] += sums[p][0]
    for v in range(size - 1, -1, -1):
        held[v] += direct[v]
        if v:
            held[paths.parent[v]] += held[v]
    around = [v for v in range(size) if not v or paths.tag[v] in CONTAINERS]
    weight = {v: held[v] - direct[v] * (paths.tag[v] == "td") for v in around}
    root = max((v for v in around if weight[v] >= NEARLY_ALL * held[0]), key=lambda v: (paths.depth[v], weight[v]))
    above, v = {root}, root
    while v:
        v = paths.parent[v]
        above.add(v)
    page = all(paths.tag[v] in ("", "html", "body") for v in above)
    part = [0] * size  # for what lies below the root: the root's child that it is in
    for v in range(1, size):
        p = paths.parent[v]
        part[v] = v if p == root and v != root else part[p]
    # a block that is mostly links isn't text, a link within a sentence is
    links: dict[int, list[float]] = {}
    for p, s in sums.items():
        own = links.setdefault(paths.block[p], [0, 0])
        own[0], own[1] = own[0] + s[0], own[1] + s[3]

    def content(p: int) -> bool:
        if p != root and not part[p] or page and p != root and paths.tag[part[p]] in CONTAINERS and not held[part[p]]:
            return False
        if paths.doubtful[p] and not paths.doubtful[root] and p not in over:
            return False
        own = links[paths.block[p]]
        return own[1] <= 0.5 * own[0]

    title = lambda p: paths.tag[p] == "h1" and paths.parent[p] in above  # noqa: E731  above the text, in an element around it
    return {p for p in sums if title(p) or content(p)}


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, paths = text_nodes(page)
    keep = content_paths(nodes, paths)
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if n.path in keep:
            blocks.setdefault(n.block, []).append(n.text)
    done = (_WHITE.sub(" ", html_lib.unescape("".join(b))).strip(" ") for b in blocks.values())
    return "\n".join(t for t in done if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 500):
            own = b.slice(s, 500)
            found = [main_text(h) for h in own.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return map_texts(rows, _extract, "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
