"""Packing: concatenate and cut.

Pass one tokenises each partition once and writes, per document, its ids and
its offset within the partition; the partitions' token totals are added up to
give every partition its global offset. Pass two cuts the stream into windows
of fixed length: a document that crosses a window's end gives one record for
each window it touches, so a window is the records that carry its number.
Every sequence is full but the last one.

What the driver holds is one number for each partition of the token table.

Defined cases: a null text is empty and gives the closing id alone. Repeated
rows are packed once each. A null id stays null. An empty table gives no
pieces. Only the id and text columns are read. The order of documents is that
of the partitions read; any order is a valid packing.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagstone.llm.common import materialise
from bagstone.llm.tokens import VOCABULARY, encoder

SEQUENCE = 1024
END_ID = 0
#: Bytes of ids in one batch of output.
_FLUSH = 4 << 20
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenise(vocabulary: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at, rows, size = encoder(vocabulary), TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), end_id], "<u4")
                rows.append((doc_id.as_py(), part, at, len(ids), ids.tobytes()))
                at += len(ids)
                size += 4 * len(ids)
                if size > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def token_table(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Written table: doc_id, part, at (offset in the part), n, ids (<u4)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    return materialise(rows.mapInArrow(_tokenise(vocabulary, end_id), "doc_id long, part long, at long, n long, ids binary"), "tokens")


def part_offsets(tokens: DataFrame) -> dict[int, int]:
    """Prefix sums over the parts' totals: part -> its global offset."""
    totals = dict(tokens.groupBy("part").agg(F.sum("n")).collect())
    parts = sorted(totals)
    return dict(zip(parts, itertools.accumulate((totals[p] for p in parts), initial=0), strict=False))


def _cut(offsets: dict[int, int], length: int, with_ids: bool):
    types = [pa.int64()] * 7 + [pa.binary()] * with_ids
    names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, part, at, n, ids in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                first, data = offsets[part] + at, memoryview(ids.as_py())
                start = 0
                while start < n:
                    window, offset = divmod(first + start, length)
                    took = min(n - start, length - offset)
                    piece = data[4 * start : 4 * (start + took)]
                    rows.append((doc_id, start, took, zlib.crc32(piece), n, window, offset, *[bytes(piece)] * with_ids))
                    start += took
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def cut(tokens: DataFrame, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Boundary records of a token table; with_ids adds each piece's ids."""
    if length < 1:
        raise ValueError("a sequence has at least one token")
    schema = _PIECES + ", ids binary" * with_ids
    return tokens.select("doc_id", "part", "at", "n", "ids").mapInArrow(_cut(part_offsets(tokens), length, with_ids), schema)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    return cut(token_table(docs, vocabulary, id_col, text_col, end_id), length, with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """Pieces with ids -> one row per sequence: sequence_id, n_tokens, ids.
    A group holds at most one window's ids."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
