"""Exact dedup by skew-safe combining, in DataFrame functions only.

Copies are merged three times: within each task (Spark's partial aggregation),
within (digest, salt) groups, and over the salts. Every stage groups by the
digest and the full normalised text, so equal digests of different texts are
never merged. No stage gathers the members of a group: each keeps the smallest
id and a count, whatever the group's size. Rows find their group again by the
digest, which then stands for the content: it is made sure first that no two
different texts share one. Those that do (none are known for SHA-256) are met
by their whole content instead. Hot digests reach their rows by a broadcast of
at most a thousand groups, so no task gets all rows of one.

Defined cases: a null text counts as empty and all empty texts are one group;
white space is collapsed, not trimmed. A null id takes part but wins only where
all ids of the group are null. Repeated rows (same id, same text) count once
each in group_size and are all marked as kept in ``assign``; ``drop_copies``
leaves one of them. Only the id and text columns are read by ``assign``;
``drop_copies`` returns all columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagstone.llm.common import drop_keys, few, fresh, lookup, materialise

#: White space of the contract: blank and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
DEFAULT_SALTS = 16


def normalised(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " ")


def sha256(body: Column) -> Column:
    """SHA-256. Said not to be null, or joins would compute it again to test
    that."""
    return F.coalesce(F.unhex(F.sha2(body, 256)), F.lit(b""))


Digest = Callable[[Column], Column]


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("body"))
    return rows.withColumn("digest", digest(F.col("body")))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = DEFAULT_SALTS, digest: Digest = sha256) -> DataFrame:
    """One row per distinct text: digest, body, keep_id, group_size."""
    if salts < 1:
        raise ValueError("salts must be at least 1")
    salted = (
        _keyed(docs, id_col, text_col, digest)
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "salt", "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Digest) -> tuple[DataFrame, DataFrame | None]:
    """A row per input row: id, digest, keep_id, group_size; and the digests
    that several texts share, if any."""
    every = winners(docs, id_col, text_col, salts, digest)
    best = materialise(every.select("digest", "keep_id", "group_size"), "winners")
    rows = materialise(_keyed(docs, id_col, text_col, digest).select("id", "digest"), "digests")
    clash = best.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    if clash.isEmpty():
        return lookup(rows, best, "digest"), None
    clash = few(materialise(clash, "clash"))
    alone = materialise(rows.join(clash, "digest", "left_anti"), "alone")
    by_digest = lookup(alone, materialise(best.join(clash, "digest", "left_anti"), "single"), "digest")
    whole = _keyed(docs, id_col, text_col, digest).join(clash, "digest", "left_semi")
    by_content = whole.join(every.join(clash, "digest", "left_semi"), ["digest", "body"])
    return by_digest.unionByName(by_content.drop("body")), clash


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = DEFAULT_SALTS, digest: Digest = sha256) -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    found, _ = _grouped(docs, id_col, text_col, salts, digest)
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = DEFAULT_SALTS, digest: Digest = sha256) -> DataFrame:
    """docs without copies: of equal texts one row with the smallest id stays."""
    found, clash = _grouped(docs, id_col, text_col, salts, digest)
    own, text = F.col(f"`{id_col}`"), normalised(F.col(f"`{text_col}`"))
    decided = found.groupBy(F.col("id").alias("doc_id"), "digest").agg(F.count(F.lit(1)).alias("times"), F.first(F.col("id").eqNullSafe(F.col("keep_id"))).alias("stays"))
    if clash is None:
        return drop_keys(docs, own.cast("long"), digest(text), decided)
    at, body = fresh("digest", docs), fresh("body", docs)
    marked = docs.withColumns({at: digest(text), body: text})
    some = clash.select(F.col("digest").alias(at))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = drop_keys(marked.join(some, at, "left_anti").select(*columns), own.cast("long"), digest(text), decided.join(clash, "digest", "left_anti"))
    best = winners(docs, id_col, text_col, salts, digest).select(F.col("digest").alias(at), F.col("body").alias(body), F.col("keep_id").alias(fresh("keep", docs)))
    held = marked.join(some, at, "left_semi").join(best, [at, body]).where(own.eqNullSafe(F.col(fresh("keep", docs))))
    return rest.unionAll(held.dropDuplicates([at, body]).select(*columns))
