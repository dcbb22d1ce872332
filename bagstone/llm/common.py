"""Shared helpers: table access, scratch tables, text bytes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_bytes(c: str = "text") -> Column:
    """The text as UTF-8 bytes, empty for null: spares Python the decoding."""
    return F.coalesce(F.col(f"`{c}`"), F.lit("")).cast("binary")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir.

    Without that setting a local session gets a temporary folder; a cluster
    is refused, since its executors don't share local disks.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='bagstone-')}"
        _roots[app] = f"{base.rstrip('/')}/scratch-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_clean_quietly, spark)
    return _roots[app]


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this application. Results that still
    read them must have been written before."""
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root:
        delete_path(spark, root)


def _clean_quietly(spark: SparkSession) -> None:
    try:
        clean_scratch(spark)
    except Exception:  # the JVM is gone at interpreter exit; the folder stays
        pass


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back.

    Cuts the lineage in a way that outlives lost executors, and gives the
    planner file sizes to choose joins by.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


#: Rows of a small table that may be broadcast; of more the planner decides.
FEW = 250_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A written table of short rows, marked for broadcast if it has at most
    that many of them."""
    return F.broadcast(df) if df.count() <= most else df


def lookup(rows: DataFrame, found: DataFrame, key: str, share: int = 1000, least: int = 1000) -> DataFrame:
    """rows with the columns that found has for their key, which it has one row
    for. Both are written tables. Keys with over a thousandth of the rows, so a
    thousand at most, come by broadcast, and their rows are dealt out evenly for
    the rest of the join: no task gets a hot key."""
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(least, rows.count() // share)).select(key)
    heavy = found.join(F.broadcast(hot), key, "left_semi")
    if heavy.isEmpty():
        return rows.join(found, key)
    names = [c for c in found.columns if c != key]
    at, own = fresh("at", rows, found), fresh("own", rows, found)
    heavy = materialise(heavy.select(key, F.struct(*(F.col(f"`{c}`") for c in names)).alias(own)), "heavy")
    marked = rows.join(F.broadcast(heavy), key, "left").withColumn(at, F.when(F.col(own).isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns).cast("string").cast(rows.schema[key].dataType)))
    other = found.select(F.col(key).alias(at), F.struct(*(F.col(f"`{c}`") for c in names)).alias(f"{own}_"))
    joined = marked.join(other, at, "left").withColumn(own, F.coalesce(own, f"{own}_"))
    return joined.select(*rows.columns, *(F.col(own).getField(c).alias(c) for c in names))


def drop_keys(docs: DataFrame, own_id: Column, own_digest: Column, judged: DataFrame) -> DataFrame:
    """docs without the rows whose id and digest judged says don't stay, and
    with one of those that share both. judged: doc_id, digest, times, stays, a
    row for each of them. Few rows to drop come by broadcast, and the texts are
    not moved; more are met by id and digest."""
    i, null, digest = (fresh(c, docs) for c in ("id", "null", "digest"))
    keys = judged.select(F.coalesce("doc_id", F.lit(0)).alias(i), F.col("doc_id").isNull().alias(null), F.col("digest").alias(digest), "times", "stays")
    keys = materialise(keys.where("NOT stays OR times > 1"), "decided")
    marked = docs.withColumns({i: F.coalesce(own_id, F.lit(0)), null: own_id.isNull(), digest: own_digest})
    at = [i, null, digest]
    gone, often = few(keys.where("NOT stays").select(*at)), few(keys.where("stays").select(*at))
    left = marked.join(gone, at, "left_anti")
    if not keys.where("stays").isEmpty():
        left = left.join(often, at, "left_anti").unionAll(left.join(often, at, "left_semi").dropDuplicates(at))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What is written meanwhile goes to Python in batches of about so many
    bytes: for rows that hold a whole group each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*frames: DataFrame | None) -> None:
    """Deletes scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete_path(df.sparkSession, path)
