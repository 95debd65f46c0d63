"""Operator 13: the main text of pages, content and boilerplate parted by a minimum cut.

A page becomes blocks of text (blocks.py). Blocks whose markup leaves no doubt (menus,
footers, adverts, comments, hidden parts) are out; every other block is a node. A logistic
classifier of its text and what its markup says give the cost of either label, which are the
capacities to the two terminals. Neighbours in page order and in the tree are joined by
edges that weigh less the farther apart they lie in the tree. The maximum flow's cut labels
all blocks at once.

The classifier is fitted on all pages: a block is one of a fixed grid of feature cells, and
the cells' counts, by label, are all that the fit needs. Blocks inside article or main
elements count as content, blocks beyond doubt as boilerplate, others for neither. The fit
is drawn towards PRIOR, which alone decides where pages have no such markup. Pages stay
where they are: one pass counts cells, one labels; nothing is shuffled but counts.

Defined results: null or empty html, and pages without main text, give '' and 0; white space
is what Unicode calls so, no-break spaces included; repeated rows, also of one page_id, each
get a row; an empty table gives none; other columns are never looked at. Elements deeper
than 512 are flattened; an unclosed attribute or comment ends the page, as in browsers.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import HEADINGS, Block, blocks
from .shared import batches, bound_batches, strings

#: Upper ends of the word counts, shares of linked characters and sentence ends of a feature's cells.
WORD_ENDS, LINK_ENDS, STOP_ENDS = (2, 5, 11, 24, 59), (0.0, 0.25, 0.6), (0, 1)
PROSE, ITEMS, CELLS = frozenset(["", *"p blockquote pre figcaption".split()]), frozenset("li dd dt".split()), frozenset("td th caption".split())
STOPS = re.compile(r"[.!?…。！？](?=\s|[\"'”’»)]|$)")
PHRASES = (
    "©", "(c) 19", "(c) 20", "copyright", "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "subscribe", "newsletter", "sign up", "sign in", "log in", "login",
    "advertis", "sponsored", "share this", "share on", "follow us", "read more", "skip to",
)
#: Log odds of content before anything is learned, a weight for each cell of each feature.
PRIOR = {
    "words": (-2.0, -1.2, -0.4, 0.4, 1.2, 2.0),
    "links": (0.3, -0.2, -1.5, -3.0),
    "stops": (-0.5, 0.5, 0.9),
    "kind": (0.8, 1.0, -0.4, -0.4, -0.2),  # prose, heading, item, table cell, other
    "phrase": (0.0, -2.5),
}
SIZES = tuple(map(len, PRIOR.values()))
#: What markup adds to the log odds; what blocks of which nothing is said get on pages with article elements, and on pages without any said content.
SAYS, UNSAID, UNMARKED = {"article": 4.0, "content": 2.0, "": 0.0, "shell": -8.0}, -2.5, 0.7
#: The text's log odds stay within this, a fit's rows weigh so much a label, and its weights are held to PRIOR so strongly.
BOUND, FIT_WEIGHT, HOLD = 4.0, 200.0, 20.0
#: Weight of an edge between siblings, halved for each further step in the tree; parts of one that capacities are rounded to.
SMOOTH, STEPS, UNIT = 1.0, 2, 1_000


def cell(block: Block) -> int:
    """The feature cell of a block, numbered over the grid of SIZES."""
    words, stops = len(block.text.split()), len(STOPS.findall(block.text))
    share = min(1.0, block.linked / len(block.text))
    low = block.text.lower()
    kind = 0 if block.tag in PROSE else 1 if block.tag in HEADINGS else 2 if block.tag in ITEMS else 3 if block.tag in CELLS else 4
    at = 0
    for size, value in zip(SIZES, (sum(words > e for e in WORD_ENDS), sum(share > e for e in LINK_ENDS), sum(stops > e for e in STOP_ENDS), kind, any(x in low for x in PHRASES))):
        at = at * size + value
    return at


GRID = np.array(list(product(*map(range, SIZES))))
#: One row a cell, one column a weight.
DESIGN = np.hstack([np.eye(n)[GRID[:, i]] for i, n in enumerate(SIZES)])


def fit(content: np.ndarray, boilerplate: np.ndarray) -> np.ndarray:
    """Log odds of content for every cell, from how many blocks of each label lie in it."""
    prior = np.concatenate([np.array(v) for v in PRIOR.values()])
    total = content.sum(), boilerplate.sum()
    if not all(total):
        return DESIGN @ prior
    # both labels weigh the same, at every size
    good, bad = content * (FIT_WEIGHT / total[0]), boilerplate * (FIT_WEIGHT / total[1])
    weights = prior.copy()
    for _ in range(50):  # Newton's method; the prior keeps the curvature positive
        p = 1 / (1 + np.exp(-(DESIGN @ weights)))
        slope = DESIGN.T @ (good - (good + bad) * p) - HOLD * (weights - prior)
        curve = DESIGN.T @ (((good + bad) * p * (1 - p))[:, None] * DESIGN) + HOLD * np.eye(len(prior))
        step = np.linalg.solve(curve, slope)
        weights += step * min(1.0, 2.0 / np.abs(step).max(initial=1e-9))
        if np.abs(step).max() < 1e-10:
            break
    return DESIGN @ weights


def cell_counts(pages: DataFrame) -> DataFrame:
    """cell, content, boilerplate: blocks of all pages that markup labels."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches(source):
            counts.update((cell(x), x.says != "outer") for html in strings(b, "html") for x in blocks(html) if x.says in ("outer", "article", "content"))
        cells = sorted({c for c, _ in counts})
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *(pa.array([counts[c, label] for c in cells], pa.int64()) for label in (True, False))], names=["cell", "content", "boilerplate"])

    rows = pages.select(F.col("`html`").cast("string").alias("html")).mapInArrow(run, "cell long, content long, boilerplate long")
    return rows.groupBy("cell").agg(F.sum("content").alias("content"), F.sum("boilerplate").alias("boilerplate"))


def trained(pages: DataFrame) -> np.ndarray:
    """The classifier: log odds of each cell. At most one row a cell of the fixed grid reaches the driver."""
    counts = np.zeros((2, len(GRID)))
    for r in cell_counts(pages).collect():
        counts[:, r.cell] = r.content, r.boilerplate
    return fit(*counts)


def smoothness(nodes: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (i, j, weight): neighbours in page order, and a block with the last one before it under the same parent."""
    edges, last = [], {}
    for j, block in enumerate(nodes):
        parent = block.path[:-1]
        near = {j - 1} if j else set()
        if parent in last:
            near.add(last[parent])
        for i in near:
            other = nodes[i].path
            common = next((k for k, (x, y) in enumerate(zip(other, block.path)) if x != y), min(len(other), len(block.path)))
            beyond = max(0, len(other) + len(block.path) - 2 * common - STEPS)
            if weight := round(UNIT * SMOOTH * 0.5**beyond):
                edges.append((i, j, weight))
        last[parent] = j
    return edges


def cut_labels(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling of least cost: a node that is left out costs its gain if above 0, one that is kept its loss, a parted edge its weight.

    A node whose gain or loss is no less than all its open edges together has that label in
    some minimum cut: it is settled at once, and its edges become its neighbours' gains. The
    flow decides the rest.
    """
    gain, label = list(gain), [None] * len(gain)
    around: list[list[tuple[int, int]]] = [[] for _ in gain]
    for i, j, w in edges:
        around[i].append((j, w))
        around[j].append((i, w))
    open_weight = [sum(w for _, w in x) for x in around]
    queue = deque(range(len(gain)))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(gain[i]) < open_weight[i]:
            continue
        label[i] = gain[i] >= 0
        for j, w in around[i]:
            if label[j] is None:
                gain[j] += w if label[i] else -w
                open_weight[j] -= w
                queue.append(j)
    rest = [i for i, x in enumerate(label) if x is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        for i, kept in zip(rest, _source_side([gain[i] for i in rest], [(at[i], at[j], w) for i, j, w in edges if i in at and j in at])):
            label[i] = kept
    return label


def _source_side(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side of the minimum cut, by shortest augmenting paths in layers."""
    source, sink = len(gain), len(gain) + 1
    heads: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room = [], []

    def join(i: int, j: int, there: int, back: int) -> None:
        heads[i].append(len(to))
        heads[j].append(len(to) + 1)
        to.extend((j, i))
        room.extend((there, back))

    for i, g in enumerate(gain):
        join(source, i, g, 0) if g > 0 else join(i, sink, -g, 0)
    for i, j, w in edges:
        join(i, j, w, w)
    while True:
        layer = [-1] * (sink + 1)
        layer[source], line = 0, deque([source])
        while line:
            i = line.popleft()
            for e in heads[i]:
                if room[e] and layer[to[e]] < 0:
                    layer[to[e]] = layer[i] + 1
                    line.append(to[e])
        if layer[sink] < 0:
            return [x >= 0 for x in layer[: len(gain)]]
        upto, path, i = [0] * (sink + 1), [], source
        while True:
            if i == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not room[e])
                i = to[path[k] ^ 1]
                del path[k:]
            while upto[i] < len(heads[i]) and not (room[e := heads[i][upto[i]]] and layer[to[e]] == layer[i] + 1):
                upto[i] += 1
            if upto[i] < len(heads[i]):
                path.append(heads[i][upto[i]])
                i = to[path[-1]]
            elif path:
                i = to[path.pop() ^ 1]
                upto[i] += 1
            else:
                break


def gains(nodes: list[Block], odds: np.ndarray) -> list[int]:
    """What labelling each block content gains over boilerplate, in parts of UNIT."""
    said = {b.says for b in nodes}
    unsaid = UNSAID if "article" in said else 0.0 if "content" in said else UNMARKED
    return [round(UNIT * (max(-BOUND, min(BOUND, float(odds[cell(b)]))) + SAYS[b.says] + (0.0 if b.says else unsaid))) for b in nodes]


def page_text(html: str, odds: np.ndarray) -> str:
    """The main text of one page."""
    nodes = [b for b in blocks(html) if b.says != "outer"]
    return "\n".join(b.text for b, kept in zip(nodes, cut_labels(gains(nodes, odds), smoothness(nodes))) if kept)


def main_text(pages: DataFrame, odds: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; trained on the same pages unless odds are given."""
    bound_batches(pages.sparkSession)
    odds = trained(pages) if odds is None else odds

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            texts = [page_text(html, odds) for html in strings(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.col("`html`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op13_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = {
    # what the cut must find on pages of this table's make, said without it: all of the one article element, its few character references decoded
    "op13_main_text": r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') as body from pages),
l as (select page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)) as parts from a),
t as (select page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g'))), lambda x: x <> '') as parts from l)
select page_id, url, array_to_string(parts, chr(10)) as text, length(array_to_string(parts, chr(10))) as n_chars from t"""
}
