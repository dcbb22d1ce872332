"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Words are runs of digits, letters and anything beyond ASCII, after lower-casing
A-Z. Every `size` consecutive words of a benchmark item are a window; a shorter
item is one window. A document is scanned once: its words become numbers of the
benchmark's vocabulary, runs of known words long enough for a window are hashed
as a rolling polynomial, and each hash that is in the set is verified word by
word. Words inside a verified window are hit.

The set is broadcast in blocks of at most `block_words` words of items, a fixed
size. A longer item is cut into parts that share their edges' windows, so no
block is larger. A larger benchmark takes more passes over the documents, each
written before the next begins, so that a task runs one scan and the driver
holds one block whatever the benchmark's size; each pass adds its spans and
items to those of the pass before.

Defined cases: a null or empty text has no words and no hits; so has an item
without words, which is never found. Items with equal texts count once each.
Repeated rows give one result row each. An empty benchmark leaves everything
clean; an item without an id is not used. Only the id and text columns of either table are read by ``scan``; the
filters return all columns whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagstone.llm.common import discard, fresh, materialise, text_bytes

SIZE = 10
BLOCK_WORDS = 2_000_000
#: Windows of a text that are hashed at a time.
_BLOCK = 1 << 16
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class WindowSet:
    """The windows of some items, ready to scan documents with."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = SIZE):
        self.vocab: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text))
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                owners = self.windows.setdefault(ids[at : at + size], [])
                if item not in owners:
                    owners.append(item)
        lengths = sorted({len(w) for w in self.windows})
        self.hashes = {n: np.unique(self._hash(np.array([w for w in self.windows if len(w) == n], np.uint64))) for n in lengths}

    @staticmethod
    def _hash(columns: np.ndarray) -> np.ndarray:
        """Polynomial hash of rows of word numbers, modulo 2^64."""
        total = np.zeros(len(columns), np.uint64)
        for k in range(columns.shape[1]):
            total = total * _BASE + columns[:, k]
        return total

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit spans [from, to) in words, items found. The
        windows of a text are held in blocks, however long it is."""
        words = words_of(text)
        if not words or not self.windows:
            return len(words), [], set()
        known = self.vocab.get
        ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        # reach[i]: known words in a row from i on
        stop = np.where(ids == 0, np.arange(len(ids)), len(ids))
        reach = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(ids))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for n, hashes in self.hashes.items():
            starts = np.flatnonzero(reach >= n)
            if not len(starts):
                continue
            for low in range(0, len(starts), _BLOCK):
                some = starts[low : low + _BLOCK]
                rows = ids[some[:, None] + np.arange(n)[None, :]]
                hit = np.isin(self._hash(rows.astype(np.uint64)), hashes)
                for at, row in zip(some[hit].tolist(), rows[hit].tolist(), strict=True):
                    owners = self.windows.get(tuple(row))
                    if owners:
                        if spans and at <= spans[-1][1] and at >= spans[-1][0]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], at + n))
                        else:
                            spans.append((at, at + n))
                        items.update(owners)
        return len(words), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _parts(words: list[bytes], size: int, most: int) -> Iterator[list[bytes]]:
    """words in parts of at most `most`, and of `size` at least, that share
    size - 1 words, so every window is in one of them."""
    most = max(most, size)
    for at in range(0, max(len(words) - size + 1, 1), most - size + 1):
        yield words[at : at + most]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size; the driver holds one block and one
    item at a time."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), text_bytes(text_col).alias("t")).where("i IS NOT NULL")
    block, held = [], 0
    for item, text in rows.toLocalIterator():
        for part in _parts(words_of(bytes(text)), size, block_words):
            if block and held + len(part) > block_words:
                yield block
                block, held = [], 0
            block.append((item, b" ".join(part)))
            held += len(part)
    yield block


_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SPANS = "array<struct<a:long,b:long>>"
_FOUND = "n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def _kernel(items: list[tuple[str, bytes]], size: int, first: bool, last: bool):
    """One pass. Later passes add to the spans and items of the earlier ones;
    all but the last hand the text on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(items, size)
        for batch in batches:
            found = [windows.scan(t.as_py()) for t in batch.column("body")]
            spans, owners = [s for _, s, _ in found], [i for _, _, i in found]
            if not first:
                spans = [merged([*s, *((x["a"], x["b"]) for x in old)]) for s, old in zip(spans, batch.column("spans").to_pylist(), strict=True)]
                owners = [i.union(old) for i, old in zip(owners, batch.column("items").to_pylist(), strict=True)]
            columns = {"doc_id": batch.column("doc_id")} | ({} if last else {"body": batch.column("body")})
            columns |= {"n_words": pa.array([n for n, _, _ in found], pa.int64())}
            columns |= {"spans": pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], _SPAN), "items": pa.array([sorted(i) for i in owners], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per input row: doc_id, n_words, spans (of hit words), items."""
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    for block, first, last in _marked(_blocks(benchmark, item_col, item_text_col, size, block_words)):
        after = out.mapInArrow(_kernel(block, size, first, last), "doc_id long, " + "body binary, " * (not last) + _FOUND)
        out = _next(out, after, first, last)
    return out


def _marked(blocks: Iterator[list]) -> Iterator[tuple[list, bool, bool]]:
    """Each block, and whether it is the first and the last."""
    block, first = next(blocks), True
    while block is not None:
        after = next(blocks, None)
        yield block, first, after is None
        block, first = after, False


def _next(before: DataFrame, after: DataFrame, first: bool, last: bool) -> DataFrame:
    """What the next pass reads: a written table, in place of the one that the
    pass before wrote."""
    if last:
        return after
    out = materialise(after, "pass")
    if not first:
        discard(before)
    return out


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s.b - s.a)
    return scan(docs, benchmark, **how).select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def _tester(items: list[tuple[str, bytes]], size: int):
    held: list[WindowSet] = []

    @F.arrow_udf(T.BooleanType())
    def hit(body):
        if not held:
            held.append(WindowSet(items, size))
        return pa.array([bool(held[0].scan(t.as_py())[1]) for t in body], pa.bool_())

    return hit


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without those that hold a window of any item; no shuffle."""
    out = docs
    for items, first, last in _marked(_blocks(benchmark, item_col, item_text_col, size, block_words)):
        out = _next(out, out.where(~_tester(items, size)(text_bytes(text_col))), first, last)
    return out


def _cutter():
    @F.arrow_udf(T.StringType())
    def without(body, spans):
        def one(t: bytes, hit: list) -> str:
            at = [m.span() for m in _WORD.finditer(t.lower())] if hit else []
            out, last = [], 0
            for a, b in sorted((x["a"], x["b"]) for x in hit):
                out.append(t[last : at[a][0]])
                last = at[b - 1][1]
            return b"".join([*out, t[last:]]).decode("utf-8", "replace")

        return pa.array([one(t.as_py(), hit) for t, hit in zip(body, spans.to_pylist(), strict=True)], pa.string())

    return without


def _spotter(items: list[tuple[str, bytes]], size: int):
    held: list[WindowSet] = []

    @F.arrow_udf(_SPANS)
    def hits(body, old):
        if not held:
            held.append(WindowSet(items, size))
        both = [merged([*held[0].scan(t.as_py())[1], *((x["a"], x["b"]) for x in was)]) for t, was in zip(body, old.to_pylist(), strict=True)]
        return pa.array([[{"a": a, "b": b} for a, b in s] for s in both], _SPAN)

    return hits


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the hit words, and what lies between them, cut from the text.
    Spans of all blocks are found in the text as it was, then cut at once; a
    null text stays null."""
    text, kept = F.col(f"`{text_col}`"), fresh("spans", docs)
    out = docs.withColumn(kept, F.array().cast(_SPANS))
    for items, first, last in _marked(_blocks(benchmark, item_col, item_text_col, size, block_words)):
        out = _next(out, out.withColumn(kept, _spotter(items, size)(text_bytes(text_col), kept)), first, last)
    return out.withColumn(text_col, F.when(F.size(kept) > 0, _cutter()(text_bytes(text_col), kept)).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))
