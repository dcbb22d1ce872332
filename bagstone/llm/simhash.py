"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint: per word shingle a 64-bit XXH64; a bit is set where over half the
shingles, repeats included, set it. Fingerprints are put into 2^(radius+1)-1
tables. Bit position i has a vector m(i) over GF(2), radius+1 long and not zero;
the table of the non-zero vector v keeps the positions with <m(i), v> = 1. Any
`radius` positions span less than the whole space, so some v is orthogonal to
all of them, and every pair within the radius meets in a bucket of that table.

All links come from those buckets (`meet`, any radius). A bucket of one is done.
One of at most `CAP` members is compared whole in one task, so what a task
holds is bounded. A larger one is split by such masks over the bits that its
members may still differ in, again and again: each step takes about half of
those bits and keeps every pair within the radius together in some part. Nothing
is capped or dropped. A bucket gives a chain for each of its components, not its
pairs, so no node gets many edges by a bucket's size.

Edited copies (`wide`, `similarity`; the pipeline's stage uses them): their
shingles, and so the fingerprints above, differ in too many bits. So a second
fingerprint, over the distinct single words, which an edit moves less, is put
into the tables of radius `wide`, and a pair of texts within that radius is a
link if the sets of their five-word shingles have a Jaccard similarity of at
least 0.8, computed from all shingles of the whole texts. Two things spare work
and lose nothing: counts of the shingles' hashes in 128 cells bound the
similarity from above, and pairs that are in one component already need no
test. First each bucket gives the pairs that would connect its components, most
similar ones first; then all pairs that are still in different components. The
sets of a bucket's texts go to the pairs' block once, not to each pair. A bucket
of more than `CAP` texts, which may have few fingerprints, is compared block by
block.

Defined cases: null and empty texts, or texts without words, have fingerprint
zero and are linked like any other. Fewer words than a shingle: the whole
sequence is one shingle. Repeated rows give one result row each. An empty table
gives no rows. Only the id and text columns are read by ``assign``; other
columns may have any name. A null id takes no part in the smallest id, unless
all ids of the component are null.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagstone.llm.common import batches_of, drop_keys, few, lookup, materialise, text_bytes
from bagstone.llm.components import connected

BITS = 64
SEED = 42
SIMILAR_SIZE = 5
#: Members of a bucket that are compared in one task.
CAP = 2048
#: Cells of the counts that bound a similarity.
CELLS = 128
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Which of 8 bits each byte value has set.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BLOCK = 1 << 16
#: Texts whose shingle sets are held at a time.
_ROWS = 256
#: Bytes of shingle sets that a block of pairs needs.
_SETS = 4 << 20


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), _BLOCK):
        byte = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8) + _COLUMN
        ones += np.bincount(byte.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(ones.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, size: int = 3) -> int:
    """The 64-bit fingerprint of a text in UTF-8; bytes.lower and bytes.split
    treat exactly A-Z and the six ASCII white-space characters."""
    return _fingerprint(text.lower().split(), size)


def _fingerprint(words: list[bytes], size: int) -> int:
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - size + 1
    h, spans = xxhash.xxh64_intdigest, zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)
    return _majority(np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def _word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and those of the distinct words."""
    own = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    return np.fromiter(map(own.__getitem__, words), np.uint64, len(words)), np.fromiter(own.values(), np.uint64, len(own))


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of the shingles, ascending, from the words' hashes."""
    n = max(1, len(hashes) - size + 1) if len(hashes) else 0
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(hashes))):
        total = total * _BASE + hashes[k : k + n]
    return np.unique(total)


def shingles(text: bytes, size: int = SIMILAR_SIZE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    return _shingles(_word_hashes(text.lower().split())[0], size)


def word_fingerprint(text: bytes) -> int:
    """The fingerprint over the distinct words of a text."""
    distinct = _word_hashes(text.lower().split())[1]
    return _majority(distinct) if len(distinct) else 0


def cells(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes lie in each cell, 255 for more."""
    return np.minimum(np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays of distinct hashes; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _differ_most(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """The most hashes that two sets of together so many members may differ in
    to be as similar as asked."""
    return sizes * (1 - similarity) / (1 + similarity) + 1e-9


def _kernel(size: int, keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                body = text.as_py()
                words = body.lower().split()
                row = [_signed(_fingerprint(words, size))]
                if keyed:
                    each, distinct = _word_hashes(words)
                    sets = _shingles(each, SIMILAR_SIZE)
                    row += [hashlib.sha256(body).digest(), _signed(xxhash.xxh64_intdigest(body, SEED)), _signed(_majority(distinct)) if words else 0, len(sets), cells(sets).tobytes()]
                rows.append(row)
            names, kinds = zip(("fp", pa.int64()), ("digest", pa.binary()), ("tid", pa.int64()), ("near", pa.int64()), ("n", pa.int64()), ("cells", pa.binary()), strict=True)
            columns = {"doc_id": batch.column(0)} | {name: pa.array([r[k] for r in rows], kinds[k]) for k, name in enumerate(names[: 6 if keyed else 1])}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def text_digest(text_col: str = "text") -> Column:
    """SHA-256 of the text, as `fingerprints` has it."""
    return F.unhex(F.sha2(text_bytes(text_col), 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, keyed: bool = False) -> DataFrame:
    """doc_id and fp (the unsigned value in a signed long) for every row; keyed
    adds digest (SHA-256), tid (XXH64) of the text, near (the fingerprint of the
    distinct words), n and cells of its five-word shingles."""
    if size < 1:
        raise ValueError("a shingle has at least one word")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(_kernel(size, keyed), "doc_id long, fp long" + ", digest binary, tid long, near long, n long, cells binary" * keyed)


# buckets


def covering_masks(radius: int, places: list[int] | None = None) -> list[int]:
    """The 2^(radius+1)-1 bit masks of the tables, over those bit places. With
    more places than the radius every mask has one of them at least."""
    places = list(range(BITS)) if places is None else places
    dims = (1 << (radius + 1)) - 1
    others = [v for v in range(1, dims + 1) if v & (v - 1)]
    random.Random(radius).shuffle(others)
    vectors = [1 << k for k in range(radius + 1)] + others
    return [sum(1 << place for i, place in enumerate(places) if (vectors[i % dims] & v).bit_count() % 2) for v in range(1, dims + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(radius: int):
    """Members of a bucket dealt into parts, by masks over the bits that the
    bucket leaves free, and the bits that each part leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            rows = []
            for bucket, used, fp in zip(*(batch.column(c).to_pylist() for c in ("bucket", "used", "fp")), strict=True):
                if used not in known:
                    known[used] = covering_masks(radius, [b for b in range(BITS) if not used >> b & 1])
                for t, mask in enumerate(known[used]):
                    part = xxhash.xxh64_intdigest(f"{bucket},{t},{fp & mask}", SEED)
                    rows.append((_signed(part), _signed(used % (1 << BITS) | mask), fp))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", "used", "fp"])

    return run


def meet(fps: DataFrame, radius: int, cap: int | None = None) -> DataFrame:
    """bucket, fp: groups of bounded size, one of which each two of the distinct
    fingerprints (column fp) within the radius share."""
    cap = cap or CAP
    tables = F.array(*(F.struct(F.lit(_signed(m)).alias("used"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("bucket")) for t, m in enumerate(covering_masks(radius))))
    dealt = fps.select("fp", F.explode(tables).alias("x")).select("x.bucket", "x.used", "fp")
    # as many as so few bits allow are no more than the cap, or than 2^radius
    least = max(radius, cap.bit_length() - 1)
    out = None
    while True:
        counted = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
        shared = materialise(counted.where("n > 1"), "shared")
        # most shared buckets have two members, which are known by now
        two = shared.where("n = 2").select("bucket", F.explode(F.array("lo", "hi")).alias("fp"))
        crowded = few(materialise(shared.where("n > 2").select("bucket", "n"), "crowded"))
        members = materialise(dealt.join(crowded, "bucket"), "members")
        fits = (F.col("n") <= cap) | (F.bit_count(F.bitwise_not("used")) <= least)
        small = two.unionAll(members.where(fits).select("bucket", "fp"))
        out = small if out is None else out.unionAll(small)
        large = members.where(~fits).select("bucket", "used", "fp")
        if large.isEmpty():
            return out
        dealt = materialise(large.mapInArrow(_split(radius), "bucket long, used long, fp long"), "parts")


def _chains(radius: int):
    """For each bucket the edges of a chain through each component of its
    members, where those within the radius are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for members in batch.column(0):
                fps = np.unique(members.values.to_numpy()).view(np.uint64)
                left = np.ones(len(fps), bool)
                for at in range(len(fps)):
                    if not left[at]:
                        continue
                    todo, found = [at], []
                    left[at] = False
                    while todo:
                        k = todo.pop()
                        found.append(k)
                        close = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[k]) <= radius))
                        left[close] = False
                        todo += close.tolist()
                    chain = fps[np.sort(found)].view(np.int64).tolist()
                    edges += zip(chain, chain[1:], strict=False)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = 2, cap: int | None = None) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that connect the
    same sets as all pairs within the radius do."""
    if radius < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    groups = meet(fps.select("fp"), radius, cap).groupBy("bucket").agg(F.collect_list("fp").alias("fps"))
    return groups.select("fps").mapInArrow(_chains(radius), "a long, b long").distinct()


# edited copies


def _connected_first(order: np.ndarray, left: np.ndarray, right: np.ndarray, nodes: int, joins=None) -> list[int]:
    """The positions of those pairs, in that order, that join two components;
    joins: whether a pair does count."""
    top, chosen, apart = list(range(nodes)), [], nodes

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for at in order.tolist():
        a, b = root(left[at]), root(right[at])
        if a != b and (joins is None or joins(at)):
            top[a] = b
            chosen.append(at)
            apart -= 1
            if apart == 1:
                break
    return chosen


def _candidates(radius: int, similarity: float, spanning: bool, room: int):
    """For each bucket the pairs x, y of texts in different homes that may be
    as similar as asked, and a block of pairs whose sets fit a task; spanning:
    only as many as would connect the homes, the likeliest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = group.values.flatten()
                tid, near, n = (flat[k].to_numpy(zero_copy_only=False) for k in range(3))
                homes = np.unique(flat[3].to_numpy(zero_copy_only=False), return_inverse=True)[1]
                if homes.max(initial=0) == 0:
                    continue
                near = near.view(np.uint64)
                counts = np.frombuffer(b"".join(flat[4].to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
                found = []
                for at in range(len(tid) - 1):
                    rest = slice(at + 1, None)
                    close = at + 1 + np.flatnonzero((np.bitwise_count(near[rest] ^ near[at]) <= radius) & (homes[rest] != homes[at]))
                    differ = np.abs(counts[close] - counts[at]).sum(1)
                    keep = differ <= _differ_most(n[close] + n[at], similarity)
                    close, share = close[keep], differ[keep] / np.maximum(n[close] + n[at], 1)[keep]
                    found.append((np.full(len(close), at, np.int32), close.astype(np.int32), share.astype(np.float32)))
                i, j, share = (np.concatenate(c) for c in zip(*found, strict=True))
                if spanning:
                    chosen = _connected_first(np.argsort(share, kind="stable"), homes[i], homes[j], int(homes.max()) + 1)
                    i, j = i[chosen], j[chosen]
                if len(i):
                    yield _in_blocks(bucket, tid, n, i, j, room)

    return run


def _in_blocks(bucket: int, tid: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, room: int) -> pa.RecordBatch:
    """block, x, y: the sets that the pairs of a block need are of bounded
    size, but for a text that alone is larger."""
    parts = int(n[np.unique(np.concatenate([i, j]))].sum()) * 8 // room + 1
    part = tid.view(np.uint64) % np.uint64(parts)
    low, high = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
    block = (np.uint64(bucket % (1 << 64)) ^ (low * np.uint64(parts) + high) * _BASE).view(np.int64)
    x, y = np.minimum(tid[i], tid[j]), np.maximum(tid[i], tid[j])
    return pa.RecordBatch.from_arrays([pa.array(block), pa.array(x), pa.array(y)], ["block", "x", "y"])


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                bodies = [t.as_py() for t in batch.column(1).slice(at, _ROWS)]
                fps = pa.array([_signed(fingerprint(t, size)) for t in bodies], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, _ROWS), fps, pa.array([shingles(t).tobytes() for t in bodies], pa.binary())], ["tid", "fp", "hashes"])

    return run


def _verify(similarity: float):
    """For each block of pairs edges a, b of fingerprints that connect what the
    similar ones of them do; a pair that is connected already is not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, group in zip(batch.column(0), batch.column(1), strict=True):
                tid, fp, hashes = group.values.flatten()
                tid, fp = tid.to_numpy(), fp.to_numpy()
                sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in hashes]
                places: dict[int, list[int]] = {}
                for k, t in enumerate(tid.tolist()):
                    places.setdefault(t, []).append(k)
                x, y = (c.to_numpy().tolist() for c in pairs.values.flatten())
                # texts that share a tid are all compared
                both = [(a, b) for p, q in zip(x, y, strict=True) for a in places.get(p, ()) for b in places.get(q, ())]
                left, right = (np.array([p[k] for p in both], np.int64) for k in (0, 1))
                alike = lambda at: jaccard(sets[left[at]], sets[right[at]]) >= similarity  # noqa: E731, B023
                chosen = _connected_first(np.arange(len(both)), left, right, len(sets), alike)
                if chosen:
                    yield pa.RecordBatch.from_arrays([pa.array(fp[left[chosen]]), pa.array(fp[right[chosen]])], ["a", "b"])

    return run


def similar(docs: DataFrame, text_col: str, size: int, pairs: DataFrame, similarity: float) -> DataFrame:
    """Edges a, b of fingerprints that connect what those pairs x, y of texts
    (by tid) do whose whole sets of shingles are as similar as asked. A text's
    set goes once to each block that has a pair with it."""
    own = materialise(pairs.groupBy("x", "y").agg(F.min("block").alias("block")), "blocks")
    needed = materialise(own.select("block", F.explode(F.array("x", "y")).alias("tid")).distinct(), "needed")
    wanted = few(materialise(needed.select("tid").distinct(), "wanted"))
    bodies = docs.select(text_bytes(text_col).alias("body")).select(F.xxhash64("body").alias("tid"), "body").join(wanted, "tid", "left_semi")
    every = bodies.mapInArrow(_shingle_sets(size), "tid long, fp long, hashes binary")
    # one row for each text, and for each of those that share a tid
    sets = materialise(every.groupBy("tid", "fp", F.xxhash64("hashes").alias("check")).agg(F.first("hashes").alias("hashes")).drop("check"), "sets")
    groups = needed.join(sets, "tid").groupBy("block").agg(F.collect_list(F.struct("tid", "fp", "hashes")).alias("group"))
    asked = own.groupBy("block").agg(F.collect_list(F.struct("x", "y")).alias("pairs"))
    with batches_of(docs.sparkSession, _SETS):
        return materialise(asked.join(groups, "block").select("pairs", "group").mapInArrow(_verify(similarity), "a long, b long").distinct(), "similar")


def _texts_that_meet(texts: DataFrame, wide: int, cap: int | None) -> DataFrame:
    """bucket, tid: groups of bounded size, one of which each two texts share
    whose word fingerprints are within the radius, or equal."""
    cap = cap or CAP
    distinct = materialise(texts.groupBy("near").agg(F.count(F.lit(1)).alias("n")), "nears")
    twins = distinct.where("n > 1").select(F.xxhash64(F.lit("equal"), "near").alias("bucket"), F.col("near").alias("fp"))
    places = materialise(meet(distinct.select(F.col("near").alias("fp")), wide, cap).unionAll(twins), "places")
    members = materialise(places.join(texts.select(F.col("near").alias("fp"), "tid"), "fp").select("bucket", "tid"), "met")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    large = few(materialise(sizes, "large"))
    if large.isEmpty():
        return members
    # each block of a large one meets each other block
    blocks = F.ceil(F.col("n") / cap).cast("long")
    own = F.pmod(F.xxhash64("tid", "bucket"), blocks)
    both = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.xxhash64("bucket", F.least(own, other), F.greatest(own, other)))
    parts = members.join(large, "bucket").select(F.explode(both).alias("bucket"), "tid")
    return materialise(members.join(large, "bucket", "left_anti").unionAll(parts), "blocks")


def wide_links(docs: DataFrame, text_col: str, size: int, owned: DataFrame, fps: DataFrame, edges: DataFrame, wide: int, similarity: float, cap: int | None = None) -> DataFrame:
    """edges (a, b, of fingerprints) and those of similar texts whose word
    fingerprints are within `wide` bits: together they connect what all such
    links do. owned: as `fingerprints` gives it; fps: the distinct fp."""
    texts = materialise(owned.select("tid", "near", "fp", "n", "cells").distinct(), "texts")
    members = _texts_that_meet(texts, wide, cap)
    for spanning in (True, False):
        labels = connected(edges)
        home = fps.select("fp", F.col("fp").alias("home"))
        if labels is not None:
            home = fps.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("home"))
        known = materialise(texts.join(materialise(home, "homes"), "fp"), "known")
        placed = members.join(known, "tid").groupBy("bucket").agg(F.collect_list(F.struct("tid", "near", "n", "home", "cells")).alias("group"), F.min("home").alias("lo"), F.max("home").alias("hi"))
        with batches_of(docs.sparkSession, _SETS):
            pairs = materialise(placed.where("lo < hi").select("bucket", "group").mapInArrow(_candidates(wide, similarity, spanning, _SETS), "block long, x long, y long"), "pairs")
        if pairs.isEmpty():
            break
        edges = materialise(edges.union(similar(docs, text_col, size, pairs, similarity)), "edges")
    return edges


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, radius: int, wide: int | None, similarity: float, keyed: bool) -> DataFrame:
    """A row per input row: doc_id, fp, the digest where it is asked for, root
    (one fingerprint for each component) and component_id."""
    owned = materialise(fingerprints(docs, id_col, text_col, size, keyed or wide is not None), "fingerprints")
    fps = materialise(owned.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges = materialise(links(fps, radius), "near")
    if wide is not None:
        edges = wide_links(docs, text_col, size, owned, fps, edges, wide, similarity)
    labels = connected(edges)
    if labels is None:
        home = fps.select("fp", F.col("fp").alias("root"), F.col("rep").alias("component_id"))
    else:
        linked = labels.select(F.col("node").alias("fp"), F.col("label").alias("root"))
        first = materialise(linked.join(fps, "fp").groupBy("root").agg(F.min("rep").alias("least")), "first")
        member = materialise(linked.join(first, "root").select("fp", "root", "least"), "member")
        joined = fps.join(member, "fp", "left")
        home = materialise(joined.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id")), "home")
    return lookup(owned.select("doc_id", "fp", *["digest"] * keyed), home, "fp")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, wide: int | None = None, similarity: float = 0.8) -> DataFrame:
    """A row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    made = _grouped(docs, id_col, text_col, size, radius, wide, similarity, False)
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, wide: int | None = None, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component: of the smallest id, and where texts
    of one component share that id, of the smallest digest. Rows of different
    components stay whatever their ids."""
    made = _grouped(docs, id_col, text_col, size, radius, wide, similarity, True)
    rows = materialise(made.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times"), F.first("root").alias("root")), "keys")
    # a null id comes last
    best = materialise(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("best")), "best")
    judged = lookup(rows, best, "root").select("doc_id", "digest", "times", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))).alias("stays"))
    return drop_keys(docs, F.col(f"`{id_col}`").cast("long"), text_digest(text_col), judged)
