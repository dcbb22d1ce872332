"""Token-count rollups kept up to date by signed deltas.

An event is an insert, a delete or a revision of one document under one
tokenizer version. Its signed form adds to totals: an insert +1 document and
+tokens, a delete the opposite, a revision the difference of its token counts
(and, where source or language changed, a removal from the old group and an
addition to the new one). A batch of events becomes one small table of sums by
(source, lang, tokenizer), committed under the batch's name; totals are the
sums over committed batches, so a batch never rereads older documents.

Commits are idempotent: a batch is written aside, then renamed to
``batch=<name>``. A rename onto an existing batch fails, the late copy is
deleted, and the first commit stands; a retried or repeated batch therefore
counts once. ``compact`` folds the batches so far into one; a marker written
with it names what it replaces, and readers skip those. It deletes nothing, as
totals read earlier may still be at the old folders; ``vacuum`` does, once no
such reader is left.

Defined cases: null text counts as empty, 0 tokens; a null source, language or
version is a group of its own; null counts are 0. Repeated rows of one batch
are separate events and count each. Deltas add up in any order: a delete that
comes before its insert, or without one, gives negative totals, which stay
visible until the insert is committed. Groups whose sums are all zero are left
out of the totals. An empty batch commits and changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagstone.llm.common import delete_path
from bagstone.llm.tokens import VOCABULARY, encoder

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens"]
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            counts = pa.array([len(encode(t.as_py())) for t in batch.column("body")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), counts], ["doc_id", "source", "lang", "tokens"])

    return run


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """A row per input row: doc_id, source, lang, tokenizer, tokens."""
    c = lambda name: F.col(f"`{name}`")
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), c(source_col).cast("string").alias("source"), c(lang_col).cast("string").alias("lang"), F.coalesce(c(text_col), F.lit("")).alias("body"))
    out = rows.mapInArrow(_count(vocabulary), "doc_id long, source string, lang string, tokens long")
    return out.withColumn("tokenizer", F.lit(vocabulary.rsplit("/", 1)[-1]))


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*GROUP, F.lit(sign).cast("long").alias("documents"), (F.coalesce("tokens", F.lit(0)) * sign).cast("long").alias("tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    """rows: source, lang, tokenizer, tokens."""
    return _signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    return _signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed deltas of documents whose counts or groups changed; old and new
    hold the same documents."""
    return _signed(old, -1).unionByName(_signed(new, 1))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS))


def _not_zero() -> Column:
    return (F.col("documents") != 0) | (F.col("tokens") != 0)


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _folder(self, batch: str) -> str:
        """Any name gives a safe folder; different names never share one."""
        return f"batch={hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def committed(self, batch: str) -> bool:
        return self._fs().exists(self._path(self._folder(batch))) or self._folder(batch) in self._replaced()

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds signed deltas; False where the batch was committed before."""
        return not self.committed(batch) and self._publish(self._folder(batch), deltas, [])

    def _publish(self, folder: str, deltas: DataFrame, replaces: list[str]) -> bool:
        fs, aside = self._fs(), f"_aside-{uuid.uuid4().hex}"
        _sums(deltas).where(_not_zero()).repartition(1).write.parquet(f"{self.root}/{aside}/sums")
        if replaces:
            out = fs.create(self._path(f"{aside}/replaces.json"), True)
            out.write(bytearray(json.dumps(replaces).encode()))
            out.close()
        target = self._path(folder)
        # a rename onto a folder would move into it, so that is looked for first
        done = not fs.exists(target) and fs.rename(self._path(aside), target)
        if not done:
            delete_path(self.spark, f"{self.root}/{aside}")
        elif fs.exists(self._path(f"{folder}/{aside}")):  # another commit was faster
            delete_path(self.spark, f"{self.root}/{folder}/{aside}")
            done = False
        return bool(done)

    def _folders(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path("")) if s.getPath().getName().startswith("batch="))

    def _replaced(self) -> set[str]:
        fs, out = self._fs(), set()
        for folder in self._folders():
            mark = self._path(f"{folder}/replaces.json")
            if fs.exists(mark):
                text = "".join(r[0] for r in self.spark.read.text(f"{self.root}/{folder}/replaces.json").collect())
                out |= set(json.loads(text))
        return out

    def _live(self) -> list[str]:
        replaced = self._replaced()
        return [f for f in self._folders() if f not in replaced]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all batches."""
        live = [f"{self.root}/{f}/sums" for f in self._live()]
        rows = self.spark.read.schema(_SCHEMA).parquet(*live) if live else self.spark.createDataFrame([], _SCHEMA)
        return _sums(rows).where(_not_zero())

    def compact(self, name: str) -> bool:
        """Folds the live batches into one; their names stay known."""
        live, known = self._live(), self._replaced()
        if len(live) < 2:
            return False
        rows = self.spark.read.schema(_SCHEMA).parquet(*(f"{self.root}/{f}/sums" for f in live))
        return self._publish(self._folder(name), rows, sorted(known | set(live)))

    def vacuum(self) -> None:
        """Deletes the folders that a compaction has replaced."""
        for folder in self._replaced() & set(self._folders()):
            delete_path(self.spark, f"{self.root}/{folder}")
