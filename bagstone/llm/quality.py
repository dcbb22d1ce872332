"""Quality classifier: histogram gradient-boosted trees over document statistics.

Executors compute a few dozen statistics per text in one pass. The fit takes at
most `MAX_LABELLED` labelled rows (those with the smallest hash of the id) to
the driver as statistics, bins every statistic by quantiles into at most `BINS`
bins, and grows depth-limited trees on gradient histograms. The finished forest
is a set of arrays (feature, threshold, left child, value) that numpy walks for
a whole batch at once, level by level.

Only the text feeds a score. Rows whose crc32 of the id, as text, modulo
`FOLDS` is 0 are held out of every fit.

Defined cases: null and empty texts have all statistics zero and are scored
like any other. Null labels, and labels of missing documents, are not used;
repeated labels count once each. Without both classes every score is the share
of good labels, or 0.5 without labels. A null id is not held out. Repeated rows
give one result row each. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagstone.llm.common import text_bytes

MAX_LABELLED = 12_000
FOLDS = 5
GOOD_FROM = 0.3
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
L2 = 1.0
MIN_CHILD = 4.0

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "max_word", "upper", "lower", "digit", "blank", "high",
    "punct", "exclaim", "pipe", "symbol", "distinct_words", "distinct_lines", "top_word", "same_as_before",
    "upper_words", "mark_words", "mean_line", "commas", "stops", "upper_runs", "entropy",
)
_CLASS = np.zeros((256, 12))


def _classes() -> None:
    groups = [range(65, 91), range(97, 123), range(48, 58), b" \t\n\r\x0b\x0c", range(128, 256), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"!", b"|", b"#$%&*<>@\\^_{}~", b",;", b".?"]
    for k, group in enumerate(groups):
        _CLASS[list(group), k] = 1


_classes()
_SQUEEZE = bytes.maketrans(bytes(range(65, 91)), b"A" * 26)


def statistics(text: bytes) -> list[float]:
    """The values of STATISTICS for a text in UTF-8."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts @ _CLASS / n
    words, lines = text.split(), text.split(b"\n")
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[bytes, int] = {}
    get = seen.get
    for x in words:
        seen[x] = get(x, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    upper = sum(map(bytes.isupper, words))
    marked = sum(not x[-1:].isalnum() and x[-1] < 128 for x in words)
    nonzero = counts[counts > 0] / n
    runs = text.translate(_SQUEEZE).count(b"AAA")
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean() if len(words) else 0.0, float(lengths.max()) if len(words) else 0.0,
        *share[:9], len(seen) / w, len(set(lines)) / len(lines), max(seen.values(), default=0) / w, repeats / w,
        upper / w, marked / w, n / len(lines), share[9], share[10], runs / w, float(-(nonzero * np.log(nonzero)).sum()),
    ]


def _table(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Forest:
    """Trees flattened into (trees, nodes) arrays in heap order; a leaf leads
    to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feature, threshold, left, value in zip(self.feature, self.threshold, self.left, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                step = left[node]
                node = np.where(step > 0, step + (x[at, feature[node]] > threshold[node]), node)
            margin += value[node]
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, bins: int = BINS) -> Forest:
    """Second-order boosting of the logistic loss on binned columns."""
    nodes = (1 << (DEPTH + 1)) - 1
    shape = (trees if len(y) and 0 < y.mean() < 1 else 0, nodes)
    forest = Forest(np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape), 0.0)
    if not len(y):
        return forest
    p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    forest.base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(x.shape[1])[None, :] * bins
    margin = np.full(len(y), forest.base)
    for t in range(shape[0]):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        for at in range(nodes):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            gs, hs = g[rows], h[rows]
            total_g, total_h = gs.sum(), hs.sum()
            forest.value[t, at] = RATE * total_g / (total_h + L2)
            if 2 * at + 2 >= nodes:
                continue
            cells = flat[rows].ravel()
            k = x.shape[1]
            hist_g = np.bincount(cells, np.repeat(gs, k), k * bins).reshape(k, bins).cumsum(1)[:, :-1]
            hist_h = np.bincount(cells, np.repeat(hs, k), k * bins).reshape(k, bins).cumsum(1)[:, :-1]
            right_g, right_h = total_g - hist_g, total_h - hist_h
            gain = hist_g**2 / (hist_h + L2) + right_g**2 / (right_h + L2) - total_g**2 / (total_h + L2)
            gain[(hist_h < MIN_CHILD) | (right_h < MIN_CHILD)] = -1
            f, b = divmod(int(gain.argmax()), bins - 1)
            if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                continue
            forest.feature[t, at], forest.threshold[t, at], forest.left[t, at] = f, edges[f][b], 2 * at + 1
            node[rows] = 2 * at + 1 + (binned[rows, f] > b)
        margin += forest.value[t][node]
    return forest


def held_out(id_column: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in _table(batch)], pa.binary())], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fits on the driver from at most max_labelled rows of statistics."""
    usable = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("quality").cast("int").alias("y"))
    some = usable.where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i"), folds)).orderBy(F.xxhash64("i"), "i", "y").limit(max_labelled)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), text_bytes(text_col).alias("body"))
    # at most max_labelled small rows, even where documents share an id
    found = rows.join(F.broadcast(some), "i").select("y", "body").mapInArrow(_numbers, "y int, x binary")
    got = found.orderBy(F.xxhash64("x"), "x", "y").limit(max_labelled).toArrow()
    if not got.num_rows:
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = np.stack([np.frombuffer(v.as_py(), np.float64) for v in got.column("x")])
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the same forest in whatever order the rows came
    return grow(x[order], y[order])


def _kernel(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(_table(batch)))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", good_from: float = GOOD_FROM) -> DataFrame:
    """A row per input row: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    scored = rows.mapInArrow(_kernel(forest), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= good_from).cast("int").alias("predicted"))
