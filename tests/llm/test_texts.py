"""Packing, token counts, decontamination, licences against brute force."""

import base64
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bagstone.llm import decontam, licenses, packing, tokencounts, tokens

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_library(rows, exact):
    encode = tokens.encoder()
    for text in [*(r[1] or "" for r in rows), "a <|endoftext|> b", "<|endoftext|>"]:
        assert encode(text) == exact(text)


def test_special_tokens_are_read_from_the_file():
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        found = Tokenizer.from_file(public.path(name)).get_added_tokens_decoder().values()
        assert sorted(tokens._special(public.path(name))) == sorted(t.content for t in found) != []


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="aA1 .,\n\t'\u00e9\u4e2d\U0001f600<|>endoftext", max_size=80)))
def test_encoder_equals_the_library_on_any_text(text, exact):
    assert tokens.encoder()(text) == exact(text)


@pytest.mark.parametrize("length", [7, 1024])
def test_packing(docs, rows, exact, length):
    pieces = packing.pack(docs, length=length, with_ids=True).collect()
    by_place = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    # gapless: every sequence but the last one is full
    place = 0
    for p in by_place:
        assert (p["sequence_id"], p["offset"]) == divmod(place, length) and 0 < p["length"] <= length - p["offset"]
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        place += p["length"]
    # the stream is the documents, one after the other
    stream, at = np.frombuffer(b"".join(p["ids"] for p in by_place), "<u4").tolist(), 0
    found = []
    for p in by_place:
        if p["start"] == 0:
            found.append((p["doc_id"], tuple(stream[at : at + p["doc_tokens"]])))
        at += p["length"]
    want = [(r[0], (*exact(r[1] or ""), 0)) for r in rows]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_sequences(docs):
    pieces = packing.pack(docs, with_ids=True)
    whole = packing.sequences(pieces).collect()
    total = sum(p["length"] for p in pieces.collect())
    assert sum(w["n_tokens"] for w in whole) == total and all(len(w["ids"]) == 4 * w["n_tokens"] for w in whole)
    assert sorted(w["n_tokens"] for w in whole)[1:] == [1024] * (len(whole) - 1)


def test_packing_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_token_rollup(spark, docs, rows, exact, empty, tmp_path):
    roll = tokencounts.Rollup(spark, f"file://{tmp_path}/roll")
    counted = tokencounts.counted(docs)
    totals = lambda: {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in roll.totals().collect()}
    want = {}
    for r in rows:
        n, t = want.get((r[3], r[2]), (0, 0))
        want[(r[3], r[2])] = (n + 1, t + len(exact(r[1] or "")))
    assert roll.totals().count() == 0
    assert roll.commit("first", tokencounts.inserts(counted)) and totals() == want
    assert not roll.commit("first", tokencounts.inserts(counted)) and totals() == want
    gone = counted.where("doc_id < 3")
    assert roll.commit("2nd / batch", tokencounts.deletes(gone))
    assert roll.commit("back", tokencounts.inserts(gone)) and totals() == want
    # a revision moves documents between groups and changes counts
    new = gone.selectExpr("doc_id", "'other' AS source", "lang", "tokens + 1 AS tokens", "tokenizer")
    assert roll.commit("revised", tokencounts.revisions(gone, new))
    moved = totals()
    assert moved[("other", "en")] == (3, sum(len(exact(r[1] or "")) for r in rows[:3]) + 3)
    assert roll.compact("folded") and totals() == moved
    assert not roll.commit("first", tokencounts.inserts(counted)) and totals() == moved
    assert roll.commit("nothing", tokencounts.inserts(tokencounts.counted(empty))) and totals() == moved
    # totals read before a compaction are not cut off by it, nor by a later one
    before = roll.totals()
    assert roll.compact("again") and totals() == moved
    assert {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in before.collect()} == moved
    roll.vacuum()
    assert totals() == moved and len(roll._folders()) == 1 and not roll.compact("once more")
    assert not roll.commit("first", tokencounts.inserts(counted)) and not roll.commit("folded", tokencounts.inserts(counted))


def test_deltas_add_up_in_any_order(spark, docs, tmp_path):
    """A delete without an insert is negative until the insert comes."""
    roll = tokencounts.Rollup(spark, f"file://{tmp_path}/early")
    some = tokencounts.counted(docs).where("doc_id = 0")
    n = some.first()["tokens"]
    assert roll.commit("out", tokencounts.deletes(some))
    assert [(r["documents"], r["tokens"]) for r in roll.totals().collect()] == [(-1, -n)] and n > 0
    assert roll.commit("in", tokencounts.inserts(some)) and roll.totals().count() == 0


def test_token_count_query(spark, tmp_path):
    """The registered query, counted by hand."""
    import tiktoken

    from bagstone.llm import queries

    texts = ["a  b\n\nc", "", None, "Une phrase  très longue " * 50, "toxic   words", "toxic again", "a  b\n\nc", "<|endoftext|>  x"]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}") for k, t in enumerate(texts)] + [(5, "toxic again", "en", "s0"), (None, "no  id", "en", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1), (5, 1), (5, 1), (6, 0), (99, 1), (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    one = lambda t: len(tokens.encoder()(t or ""))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    multi = tiktoken.Encoding("multi", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t, lang, source in rows:
        if i in (4, 5):
            continue
        flat = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        for version, n in (("byte_bpe_50k.json", one(flat)), ("byte_bpe_multi_50k.tiktoken", len(multi.encode_ordinary(t or "")))):
            d, s = want.get((source, lang, version), (0, 0))
            want[(source, lang, version)] = (d + 1, s + n)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in queries.op6_token_counts(spark, f"file://{tmp_path}").collect()}
    assert got == want


ITEMS = [(1, "quick brown fox jumps over the lazy dog again and"), (2, "one"), (10, "One"), (3, None), (4, ""), (5, "lazy dog again"), (6, " ".join(f"w{k}x{k}" for k in range(100, 125))), (None, "text")]


@pytest.mark.parametrize("block_words", [10**6, 1, 12])
def test_decontamination(spark, docs, rows, empty, block_words):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = {}
    for i, t in ITEMS:
        w = pattern.findall(low(t))
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for r in rows:
        w, hit, items = pattern.findall(low(r[1])), set(), set()
        for n, k in itertools.product(sorted({len(x) for x in windows}), range(len(w))):
            if tuple(w[k : k + n]) in windows and k + n <= len(w):
                hit.update(range(k, k + n))
                items |= windows[tuple(w[k : k + n])]
        want.append((r[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    got = decontam.report(docs, bench, block_words=block_words).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    left = decontam.drop_contaminated(docs, bench, block_words=block_words)
    assert left.columns == docs.columns and left.count() == sum(not r[5] for r in want)
    # one scan for each stage, whatever the number of blocks
    for df in (decontam.report(docs, bench, block_words=block_words), left):
        assert len(re.findall("MapInArrow|ArrowEvalPython", df._jdf.queryExecution().executedPlan().toString())) == 1
    # shorter items may join across a cut, so only the long ones are sure to be gone
    long_only = bench.where("item_id IN (1, 6)")
    cut = decontam.cut_spans(docs, long_only, block_words=block_words)
    assert cut.columns == docs.columns and decontam.report(cut, long_only).where("contaminated").count() == 0
    marks = [r for r in want if r[0] not in (None, 14)]
    texts = {r[0]: r[1] for r in rows}
    hit = {r["doc_id"] for r in decontam.report(docs, long_only).where("contaminated").collect()}
    assert hit and all(r["text"] == texts[r["doc_id"]] for r in cut.collect() if r["doc_id"] in {m[0] for m in marks} - hit)
    assert decontam.cut_spans(docs, empty.selectExpr("doc_id AS item_id", "text")).where("text IS NULL").count() == sum(r[1] is None for r in rows)


def test_long_items_and_texts_in_blocks(spark, monkeypatch):
    """Parts of an item keep every window; windows of a text are hashed in
    blocks."""
    words = [f"w{k % 37}" for k in range(500)]
    for most in (1, 10, 13, 100, 1000):
        parts = list(decontam._parts(words, 10, most))
        assert all(10 <= len(p) <= max(most, 10) for p in parts)
        assert {tuple(p[k : k + 10]) for p in parts for k in range(len(p) - 9)} == {tuple(words[k : k + 10]) for k in range(491)}
    assert list(decontam._parts(words[:4], 10, 2)) == [words[:4]] and list(decontam._parts([], 10, 2)) == [[]]
    windows = decontam.WindowSet([("a", " ".join(words[:30]).encode()), ("b", b"w3")])
    whole = windows.scan(" ".join(words).encode())
    monkeypatch.setattr(decontam, "_BLOCK", 7)
    assert windows.scan(" ".join(words).encode()) == whole and whole[1][:2] == [(0, 30), (37, 67)]


def test_decontamination_of_nothing(docs, empty, rows):
    bench = empty.selectExpr("doc_id AS item_id", "text")
    assert decontam.report(docs, bench).where("NOT contaminated").count() == len(rows)
    assert decontam.report(empty, bench).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """The MIT License (MIT)

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License as published
by the Free Software Foundation; either version 2 of the License, or (at
your option) any later version."""


def behind(mark, text, close=""):
    return "\n".join(f"{mark} {line}{close}".rstrip() for line in text.split("\n"))


LICENSED = [
    (1, "Licensed under the Apache License, Version 2.0.\nsome words", "Apache-2.0", 1, 0),
    (2, MIT, "MIT", 1, 0),
    (3, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "MIT,CC-BY-NC-4.0", 2, 0),
    (4, "All rights reserved.\nThis program is free software;", "", 0, 2),
    (5, None, "", 0, 0),
    (6, "Licensed under CC BY 4.0.\n" * 3, "CC-BY-4.0", 3, 0),
    (7, "", "", 0, 0),
    (8, "# " * 300 + "Licensed under the Apache License, Version 2.0", "Apache-2.0", 1, 0),
    (9, behind("#", APACHE), "Apache-2.0", 1, 0),
    (10, "/*\n" + behind(" *", APACHE) + "\n */\nint main() { return 0; }", "Apache-2.0", 1, 0),
    (11, behind("//", GPL3), "GPL-3.0-or-later", 1, 0),
    (12, behind("/*", GPL2, " */"), "GPL-2.0-or-later", 1, 0),
    (13, BSD, "BSD-2-Clause", 1, 0),
    (14, BSD + ENDORSE, "BSD-3-Clause", 1, 0),
    (15, BSD.replace("\n", "\r\n"), "BSD-2-Clause", 1, 0),
    (16, MIT + "\n\n" + GPL3, "GPL-3.0-or-later,MIT", 2, 0),
    (17, "lorem ipsum " * 50_000 + "\n" + APACHE + "\n\n" + "dolor " * 50_000, "Apache-2.0", 1, 0),
    (18, "It is not released under the MIT License, nor licensed under CC BY 4.0 as such", "", 0, 0),
    (19, " ".join(MIT.replace("Person", "Person.").split()), "MIT", 1, 0),
    (20, "SOFTWARE licença permission \U0001f600 version", "", 0, 0),
    (20, "Released under the MIT License", "MIT", 1, 0),
    (20, "Released under the MIT License", "MIT", 1, 0),
    (None, "the licensed wizard under the tree", "", 0, 0),
]


def test_licences(spark, docs, empty, rows):
    df = spark.createDataFrame([r[:2] for r in LICENSED], "doc_id long, text string")
    got = [(r["doc_id"], r["licences"], r["n_matches"], r["n_unmatched"]) for r in licenses.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(r[0], *r[2:]) for r in LICENSED], key=str)
    assert licenses.scan(empty).count() == 0
    assert sorted(map(tuple, licenses.scan(docs).collect()), key=repr) == sorted([(r[0], "", "", 0, 0) for r in rows], key=repr)


def test_licence_tables():
    """What the scan relies on: sentences are in normal form and have a hint."""
    for s in licenses.SENTENCES:
        assert re.fullmatch(r"[a-z0-9][a-z0-9.-]*( [a-z0-9][a-z0-9.-]*)*", s) and any(h in w for h in licenses.HINTS for w in s.split())
    assert {i for _, run in licenses.RULES for i in run} <= set(licenses.SENTENCES.values())


def test_licences_equal_the_sql(spark):
    """The SQL joins runs of lines instead of searching a pattern."""
    duckdb = pytest.importorskip("duckdb")
    texts = [(k, r[1]) for k, r in enumerate(LICENSED) if r[0] != 17]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    want = con.execute(licenses.oracle())
    names, want = [d[0] for d in want.description], want.fetchall()
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
