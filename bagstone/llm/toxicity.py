"""Toxicity severity by cumulative-link ordinal regression.

Model: P(grade > k) = sigmoid(w.x - b_k) for ordered thresholds b_0 < b_1 < ...
with one weight vector w for all of them; the score of a text is the expected
severity, the sum of those probabilities. w and b maximise the likelihood of the
rows' grades, P(grade = k) = P(grade > k - 1) - P(grade > k), less a quadratic
penalty on w; toxic rows weigh as much as clean ones in all, so severities are
those of a corpus that is half toxic. x is sparse: for each feature that a text has its log-odds in the
fit, so that one telling word moves a text further than many that tell little;
features are its words and their first four and five bytes, hashed. A text is
rejected from the expected severity on that parts the fit's toxic rows from its
clean ones best, the two classes weighing the same; a text without features
never is. Its grade is 0 then, and else the likeliest of the others.

Training: labels say toxic or not. The fit uses at most `MAX_LABELLED` labelled
rows, those with the smallest hash of the id, and keeps the `MAX_FEATURES`
features of the largest log-odds among those that enough rows have. Toxic rows
are graded by how many different features they have that only toxic rows have:
grade 1 below the first cut, up to 3 from the second on. Thus the grades are
weakly supervised, and the line between 0 and 1 is the label's own.

Defined cases: null and empty texts have no features and the severity of the
thresholds alone, near 0, and are never rejected. Labels that are null, or of documents that are
missing, are not used; repeated labels of a row count once each. Without both
classes among the labels every severity is 0. Repeated rows give one result row
each. ``score`` reads only the id and text columns; ``drop_toxic`` returns all
columns whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagstone.llm.common import text_bytes

MAX_LABELLED = 8_000
MAX_FEATURES = 4_096
MIN_ROWS = 4
#: A word gives up to three features.
GRADE_CUTS = (4, 10)
_STRIP = bytes(b for b in range(128) if not chr(b).isalnum())


def words_of(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


def features_of(words: set[bytes]) -> set[bytes]:
    return words | {w[:4] + b"\x00" for w in words if len(w) > 4} | {w[:5] + b"\x01" for w in words if len(w) > 5}


@dataclass
class Model:
    """weights: hash of a feature -> weight; thresholds ascend; a severity of
    at least reject_from is too much."""

    weights: dict[int, float]
    thresholds: np.ndarray
    reject_from: float = float("inf")

    def expected(self, eta: float) -> np.ndarray:
        """The probabilities of being over each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - eta, -50, 50)))

    def severity(self, text: bytes) -> tuple[float, int]:
        """Expected severity and the likeliest grade over 0."""
        if not len(self.thresholds):
            return 0.0, 0
        found = self.weights.keys() & set(map(zlib.crc32, features_of(set(words_of(text)))))
        # in one order, as the sum's last digits depend on it
        eta = sum(sorted(self.weights[h] for h in found))
        over = self.expected(eta)
        share = np.diff(np.concatenate([1 - over, [1.0]]))
        return float(over.sum()), 1 + int(share.argmax())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            hashes = set(map(zlib.crc32, features_of(set(words_of(text.as_py())))))
            rows.append((toxic, np.array(sorted(hashes), np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["toxic", "hashes"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the driver from at most max_labelled rows; the features come
    from the executors as hashes, never as texts."""
    usable = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)")
    some = usable.orderBy(F.xxhash64("i"), "i", "y").limit(max_labelled)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), text_bytes(text_col).alias("body"))
    # at most max_labelled small rows, even where documents share an id
    joined = rows.join(F.broadcast(some), "i").select("body", "y")
    found = joined.mapInArrow(_extract, "toxic int, hashes binary")
    got = found.orderBy(F.xxhash64("hashes"), "hashes", "toxic").limit(max_labelled).toArrow().to_pydict()
    # in one order, whatever order the rows came in
    pairs = sorted(zip(got["toxic"], got["hashes"], strict=True))
    del got
    toxic = np.array([y for y, _ in pairs], bool)
    if not toxic.any() or toxic.all():
        return Model({}, np.zeros(0))
    hashes = [np.frombuffer(h, np.uint32) for _, h in pairs]
    row = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
    feature, column = np.unique(np.concatenate(hashes), return_inverse=True)
    in_toxic = np.bincount(column[toxic[row]], minlength=len(feature))
    in_clean = np.bincount(column[~toxic[row]], minlength=len(feature))
    odds = np.log((in_toxic + 0.5) / (toxic.sum() + 1)) - np.log((in_clean + 0.5) / ((~toxic).sum() + 1))
    frequent = np.flatnonzero(in_toxic + in_clean >= MIN_ROWS)
    chosen = frequent[np.argsort(-np.abs(odds[frequent]), kind="stable")[:max_features]]
    only_toxic = np.zeros(len(feature), bool)
    only_toxic[chosen[(in_clean[chosen] == 0) & (in_toxic[chosen] >= MIN_ROWS)]] = True
    variety = np.bincount(row[only_toxic[column]], minlength=len(hashes))
    grade = np.where(toxic, 1 + np.searchsorted(GRADE_CUTS, variety, "right"), 0)
    place = np.full(len(feature), -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    keep = place[column] >= 0
    weights, thresholds = _descend(row[keep], place[column][keep], grade, np.abs(odds[chosen]))
    model = Model({int(feature[c]): float(w) for c, w in zip(chosen, weights, strict=True) if w}, thresholds)
    eta = np.bincount(row[keep], weights=weights[place[column][keep]], minlength=len(hashes))
    model.reject_from = float(model.expected(_cut(eta, toxic)).sum())
    return model


def _cut(eta: np.ndarray, toxic: np.ndarray) -> float:
    """Where the rates of both errors add up to least. Of that gap a quarter is
    left to the clean side, as toxic texts with one telling word lie further
    down than those of the fit. Over 0, the value without features."""
    order = np.argsort(eta, kind="stable")
    x, y = eta[order], toxic[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / y.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(~y)]) / (~y).sum()
    gap = np.concatenate([[True], x[1:] > x[:-1], [True]])
    at = int(np.argmin(np.where(gap, missed + wrong, 9)))
    low, high = x[max(at - 1, 0)], x[min(at, len(x) - 1)]
    return max(low + (high - low) / 4, 1e-6)


def _balanced(grade: np.ndarray) -> np.ndarray:
    toxic = grade > 0
    return np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))


def _loss(w: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray, grade: np.ndarray, weight: np.ndarray, scale: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log-likelihood of the grades under the ordered
    thresholds b, plus l2/2 of w's square, and its gradients by w and b."""
    rows, each, at = len(grade), scale[column], np.arange(len(grade))
    eta = np.bincount(row, weights=w[column] * each, minlength=rows)
    # over[k] = P(grade > k - 1): 1 at first, 0 at last
    over = np.ones((rows, len(b) + 2))
    over[:, 1:-1] = 1 / (1 + np.exp(np.clip(b[None, :] - eta[:, None], -50, 50)))
    over[:, -1] = 0
    high, low = over[at, grade], over[at, grade + 1]
    share = np.maximum(high - low, 1e-12)
    by_eta = (high + low - 1) * weight
    gb = np.zeros(len(b) + 2)
    np.add.at(gb, grade, high * (1 - high) / share * weight)
    np.add.at(gb, grade + 1, -low * (1 - low) / share * weight)
    gw = np.bincount(column, weights=by_eta[row] * each, minlength=len(scale)) + l2 * w
    return float(-np.log(share) @ weight + l2 / 2 * (w @ w)), gw, gb[1:-1]


def _descend(row: np.ndarray, column: np.ndarray, grade: np.ndarray, scale: np.ndarray, rounds: int = 400, l2: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest penalised likelihood, by Adam; the
    gaps between thresholds are exponentials, so they stay in order."""
    levels, columns = int(grade.max()), len(scale)
    raw, w = np.concatenate([[2.0], np.full(levels - 1, -0.5)]), np.zeros(columns)
    weight, m, v = _balanced(grade), np.zeros(columns + levels), np.zeros(columns + levels)
    for step in range(1, rounds + 1):
        _, gw, gb = _loss(w, _ordered(raw), row, column, grade, weight, scale, l2)
        # the chain through the running sum of the gaps
        tail = np.cumsum(gb[::-1])[::-1]
        g = np.concatenate([gw, tail[:1], tail[1:] * np.exp(raw[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, raw = w - move[:columns], raw - move[columns:]
    return w * scale, _ordered(raw)


def _ordered(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def _kernel(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.severity(t.as_py()) for t in batch.column(1)]
            grades = [g if s >= least else 0 for s, g in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(grades, pa.int32())], ["doc_id", "severity", "grade"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_from: float | None = None) -> DataFrame:
    """A row per input row: doc_id, severity, grade, rejected."""
    least = model.reject_from if reject_from is None else reject_from
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(_kernel(model, least), "doc_id long, severity double, grade int").withColumn("rejected", F.col("severity") >= least)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject_from: float | None = None) -> DataFrame:
    """docs without the rejected ones; no shuffle."""
    least = model.reject_from if reject_from is None else reject_from

    @F.arrow_udf(T.DoubleType())
    def severity(body):
        return pa.array([model.severity(t.as_py())[0] for t in body], pa.float64())

    return docs.where(severity(text_bytes(text_col)) < least)
