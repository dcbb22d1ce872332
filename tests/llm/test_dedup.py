"""Exact and near dedup against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bagstone.llm import common, components, exact_dedup, simhash


def first(ids):
    return min((i for i in ids if i is not None), default=None)


def test_exact_groups(docs, rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = []
    for r in rows:
        n = norm(r[1])
        keep = first(groups[n])
        want.append((r[0], keep, len(groups[n]), r[0] == keep, hashlib.sha256(n.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.assign(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for salts in (1, 3):
        assert sorted(map(tuple, exact_dedup.assign(docs, salts=salts).collect()), key=repr) == sorted(want, key=repr)


def test_exact_copies_dropped(docs, rows, empty):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for how in ({}, {"digest": weak}):
        left = exact_dedup.drop_copies(docs, **how)
        assert left.columns == docs.columns
        kept = [norm(r["text"]) for r in left.collect()]
        assert len(kept) == len(set(kept)) and set(kept) == {norm(r[1]) for r in rows}
        whole = {tuple(r) for r in docs.collect()}
        assert all(tuple(r) in whole for r in left.collect())
    assert exact_dedup.assign(empty).count() == 0 and exact_dedup.drop_copies(empty).columns == empty.columns


def weak(body):
    """Texts of one length share it."""
    return F.length(body).cast("string").cast("binary")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.sampled_from(["a", "b", "a  b", "a\tb", "", None, "c c"])), max_size=12), clash=st.booleans())
def test_exact_dedup_of_any_rows(spark, rows, clash):
    """Digests of different texts may be equal: content decides."""
    how = {"digest": weak} if clash else {}
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.assign(df, **how).collect()]
    want = [(i, first(groups[norm(t)]), len(groups[norm(t)]), i == first(groups[norm(t)])) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    left = [(r["doc_id"], norm(r["text"])) for r in exact_dedup.drop_copies(df, **how).collect()]
    assert sorted(left, key=repr) == sorted(((first(ids), t) for t, ids in groups.items()), key=repr)


def test_hot_groups_are_dealt_out(spark, monkeypatch):
    """A third of all rows share one text."""
    rows = [(k, "hot" if k % 3 == 0 else f"text {k % 40}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r["doc_id"]: tuple(r) for r in exact_dedup.assign(df).collect()}
    joined = common.lookup
    monkeypatch.setattr(exact_dedup, "lookup", lambda *a: joined(*a, share=10, least=1))
    monkeypatch.setattr(simhash, "lookup", lambda *a: joined(*a, share=10, least=1))
    assert {r["doc_id"]: tuple(r) for r in exact_dedup.assign(df).collect()} == want and want[3][1:3] == (0, 200)
    near = {r["doc_id"]: r["component_id"] for r in simhash.assign(df).collect()}
    assert {near[k] for k in range(0, 600, 3)} == {0} and near[1] == 1 and near[41] == 1
    assert simhash.drop_near(df).count() == len(set(near.values()))
    monkeypatch.setattr(common, "FEW", 0)
    assert exact_dedup.drop_copies(df).count() == len({t for _, t in rows})


def brute_fingerprint(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius):
    """points: (id, fingerprint) -> the smallest id that each can reach."""
    parent = list(range(len(points)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(points)):
        for b in range(a):
            if (points[a][1] ^ points[b][1]).bit_count() <= radius:
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(points)):
        groups.setdefault(find(k), []).append(points[k][0])
    return [first(groups[find(k)]) for k in range(len(points))]


@pytest.mark.parametrize("size", [1, 3, 5])
def test_fingerprints(rows, size):
    for r in rows:
        if len(r[1] or "") < 300_000:
            assert simhash.fingerprint((r[1] or "").encode(), size) == brute_fingerprint(r[1], size)


def test_near_groups(docs, rows, empty):
    points = [(r[0], simhash.fingerprint((r[1] or "").encode())) for r in rows]
    want = [(p[0], f"{p[1]:016x}", c) for p, c in zip(points, brute_components(points, 2), strict=True)]
    assert sorted(map(tuple, simhash.assign(docs).collect()), key=repr) == sorted(want, key=repr)
    assert simhash.assign(empty).count() == 0
    left = simhash.drop_near(docs)
    assert left.columns == docs.columns
    assert simhash.assign(docs, wide=5).count() == len(rows) and simhash.assign(empty, wide=5).count() == 0
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted({c for _, _, c in want}, key=str)


@pytest.mark.parametrize(("radius", "places"), [(1, 64), (2, 64), (3, 64), (4, 64), (5, 64), (2, 28), (5, 32), (5, 16), (2, 3)])
def test_masks_cover_every_pair(radius, places):
    draw = random.Random(radius)
    bits = sorted(draw.sample(range(64), places))
    masks = simhash.covering_masks(radius, bits)
    assert len(masks) == 2 ** (radius + 1) - 1 and all(masks) and all(m < 1 << 64 for m in masks)
    for _ in range(2000):
        diff = sum(1 << b for b in draw.sample(bits, radius))
        assert any(not diff & m for m in masks)


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def drifting(seed, chains=12):
    draw, fps = random.Random(seed), set()
    for _ in range(chains):
        fp = draw.getrandbits(64)
        for _ in range(12):
            fps.add(fp)
            for b in draw.sample(range(64), draw.choice([1, 1, 2, 3])):
                fp ^= 1 << b
    return sorted(fps)


def same_sets(labels, values, want):
    found = {r["node"]: r["label"] for r in labels.collect()} if labels else {}
    ours = {}
    for v, w in zip(values, want, strict=True):
        ours.setdefault(found.get(v, v), set()).add(w)
    return all(len(v) == 1 for v in ours.values()) and len(ours) == len(set(want))


@pytest.mark.parametrize(("radius", "cap"), [(0, None), (1, None), (2, None), (2, 4), (3, None), (5, None), (5, 6)])
def test_links_connect_the_same_sets(spark, radius, cap):
    values = [signed(f) for f in drifting(5)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in values], "fp long"), radius, cap)
    assert same_sets(components.connected(edges), values, brute_components([(f, f % (1 << 64)) for f in values], radius))


@pytest.mark.parametrize("radius", [2, 5])
def test_large_buckets_are_split(spark, radius):
    """A family of fingerprints that share most of their bits: every pair
    within the radius is in some group, and no group is over the bound."""
    draw, family = random.Random(3), random.Random(4).getrandbits(64)
    fixed = sum(1 << b for b in draw.sample(range(64), 50))
    fps = sorted({family & fixed | draw.getrandbits(64) & ~fixed for _ in range(400)} | set(drifting(1, 3)))
    groups = {}
    for r in simhash.meet(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), radius, 64).collect():
        groups.setdefault(r["bucket"], set()).add(r["fp"])
    assert max(map(len, groups.values())) <= 64
    met = {frozenset(p) for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
    want = {frozenset((signed(a), signed(b))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= radius}
    assert want <= met


def brute_shingles(text, size=5):
    words = text.lower().split()
    return {" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute_jaccard(a, b):
    x, y = brute_shingles(a), brute_shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


@settings(max_examples=60, deadline=None)
@given(a=st.text(alphabet="ab cd ", max_size=60), b=st.text(alphabet="ab cd ", max_size=60))
def test_similarity_is_exact_and_bounded(a, b):
    x, y = (simhash.shingles(t.encode()) for t in (a, b))
    assert simhash.jaccard(x, y) == pytest.approx(brute_jaccard(a, b))
    differ = len(np.setxor1d(x, y))
    assert np.abs(simhash.cells(x).astype(int) - simhash.cells(y)).sum() <= differ
    assert (simhash.jaccard(x, y) >= 0.8) <= (differ <= simhash._differ_most(np.array(len(x) + len(y)), 0.8))


def brute_near(texts, wide, similarity):
    """component of each text by the stage's definition of a link."""
    fps, words = [simhash.fingerprint(t.encode()) for t in texts], [simhash.word_fingerprint(t.encode()) for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 or ((words[a] ^ words[b]).bit_count() <= wide and brute_jaccard(texts[a], texts[b]) >= similarity):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))]


def edited_copies(seed, families=30, most=4):
    draw, texts, groups = random.Random(seed), [], []
    words = [f"word{k}" for k in range(5000)]
    for g in range(families):
        base = draw.choices(words, k=draw.choice([40, 150, 300]))
        for c in range(1 + g % most):
            copy = list(base)
            for k in draw.sample(range(len(base)), min(len(base), c * draw.choice([1, 1, 4]))):
                copy[k] = draw.choice(words)
            texts.append(" ".join(copy))
            groups.append(g)
    return texts, groups


@pytest.mark.parametrize("cap", [2048, 8])
def test_edited_copies_are_those_of_brute_force(spark, monkeypatch, cap):
    """With groups of texts that share their words, and buckets over the cap."""
    monkeypatch.setattr(simhash, "CAP", cap)
    if cap < 100:
        monkeypatch.setattr(simhash, "_SETS", 4000)
    texts, groups = edited_copies(8)
    draw, many = random.Random(2), [f"w{k}" for k in range(60)]
    for _ in range(30):  # the same words in other orders, some of them alike
        draw.shuffle(many)
        texts += [" ".join(many), " ".join([*many[1:], many[0]])]
    base = draw.choices(many, k=400)
    for k in range(40):  # a family, all near one text
        texts.append(" ".join([*base[: 10 * k], f"new{k}", *base[10 * k + 1 :]]))
    want = brute_near(texts, 5, 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.assign(docs, wide=5).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in simhash.drop_near(docs, wide=5).collect()) == sorted(set(want))
    narrow = {r["doc_id"]: r["component_id"] for r in simhash.assign(docs).collect()}
    assert len(set(narrow.values())) > len(set(want))
    # most copies of a similarity of 0.8 or more are found
    alike = [(a, b) for a, b in itertools.combinations(range(len(groups)), 2) if groups[a] == groups[b] and brute_jaccard(texts[a], texts[b]) >= 0.8]
    assert sum(got[a] == got[b] for a, b in alike) >= 0.9 * len(alike) > 20


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 7)), max_size=9))
def test_drop_near_of_any_rows(spark, rows):
    """Null and repeated ids: the rows that stay are those of brute force."""
    pool, _ = edited_copies(3, families=3, most=3)
    pool = [*pool, "", pool[0].upper()]
    rows = [(i, pool[k]) for i, k in rows]
    texts = [t for _, t in rows]
    groups = {}
    for (i, t), root in zip(rows, brute_near(texts, 5, 0.8), strict=True):
        groups.setdefault(root, []).append((i is None, i, hashlib.sha256(t.encode()).digest(), t))
    want = [(min(g)[1], min(g)[3]) for g in groups.values()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in simhash.drop_near(df, wide=5).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_drop_near_keeps_texts_that_share_an_id(spark):
    """Null and repeated ids with entirely different texts."""
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3].upper()), (8, texts[4]), (9, texts[4]), (None, texts[4])]
    left = simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r["doc_id"], r["text"].lower()) for r in left), key=str)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4])], key=str)


def test_a_large_near_group_is_one(spark):
    """One base text with one word changed in each of many copies."""
    draw = random.Random(4)
    base = [f"word{k}" for k in range(400)]
    rows = []
    for i in range(500):
        copy = list(base)
        copy[draw.randrange(400)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    got = simhash.assign(spark.createDataFrame(rows, "doc_id long, text string"), wide=5).groupBy("component_id").count().collect()
    assert max(r["count"] for r in got) > 450


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(edges=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14), last=st.sampled_from([0, 3, 1000]))
def test_components(spark, edges, last):
    labels = components.connected(spark.createDataFrame(edges, "a long, b long"), last=last)
    got = {r["node"]: r["label"] for r in labels.collect()} if labels else {}
    reach = {n: {n} for e in edges for n in e}
    for _ in range(15):
        for a, b in edges:
            both = reach[a] | reach[b]
            for n in both:
                reach[n] = both
    alone = {n for n, r in reach.items() if len(r) == 1}
    assert set(got) == set(reach) - alone
    assert all((got[a] == got[b]) == (b in reach[a]) for a in got for b in got)


@pytest.mark.parametrize("last", [0, 100, 10_000])
def test_a_long_chain_and_a_hub(spark, last):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = components.connected(spark.createDataFrame(edges, "a long, b long"), last=last).collect()
    assert len(got) == 601 and len({r["label"] for r in got}) == 2
