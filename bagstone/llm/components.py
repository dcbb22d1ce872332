"""Connected components of an edge table by random contraction.

Each round every node joins the neighbour that comes first in an order drawn
for that round, and the graph shrinks to the chosen nodes. All steps are
aggregations of fixed size per key and joins against one row per key, so a node
with very many edges needs no large task, and nothing is gathered on the
driver. Long chains shrink geometrically because the order changes each round.
Once at most `LAST` edges are left, a fixed number, one task finishes them.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagstone.llm.common import discard, materialise

#: Edges that one task finishes: 8 MB of node numbers.
LAST = 500_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label (the smallest node) for the edges of the whole table."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    nodes, place = np.unique(np.concatenate([*(a for a, _ in parts), *(b for _, b in parts)]), return_inverse=True)
    left, right = np.split(place, 2)
    label = np.arange(len(nodes))
    while True:
        # both ends of an edge take the lesser label, then each label that of its own node
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(nodes[label[at : at + (1 << 16)]])], ["node", "label"])


def connected(edges: DataFrame, seed: int = 7, max_rounds: int = 200, last: int | None = None) -> DataFrame | None:
    """edges: columns a, b (long), any direction, loops and repeats allowed.

    Returns node, label: one label for each component, for nodes that have an
    edge to another node; None where there is none.
    """
    last = LAST if last is None else last
    draw = random.Random(seed)
    one_way = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    graph = materialise(one_way, "edges")
    labels = None
    for _ in range(max_rounds):
        n = graph.count()
        if n <= last:
            done = materialise(graph.repartition(1).mapInArrow(_finish, "node long, label long"), "labels") if n else None
            discard(graph)
            if done is None or labels is None:
                return labels if done is None else done
            return _moved(labels, done.select(F.col("node").alias("label"), F.col("label").alias("p")), done)
        key = F.lit(draw.getrandbits(63))
        both = graph.unionAll(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.least(F.min(F.col("b").bitwiseXOR(key)), F.col("a").bitwiseXOR(key)).bitwiseXOR(key)
        chosen = materialise(both.groupBy("a").agg(best.alias("p")), "chosen")
        to = lambda c, p: chosen.select(F.col("a").alias(c), F.col("p").alias(p))  # noqa: E731, B023
        moved = graph.join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y")
        after = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if labels is None:
            labels = chosen.select(F.col("a").alias("node"), F.col("p").alias("label"))
            labels._scratch_path = chosen._scratch_path
        else:
            labels = _moved(labels, to("label", "p"), chosen)
        discard(graph)
        graph = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _moved(labels: DataFrame, step: DataFrame, *used: DataFrame) -> DataFrame:
    """labels with each label's own label."""
    out = materialise(labels.join(step, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
    discard(labels, *used)
    return out
