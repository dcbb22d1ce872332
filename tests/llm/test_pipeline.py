"""The corpus pipeline against planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    draw = random.Random(6)
    words = [f"word{k}" for k in range(3000)]
    bad = ["vile", "nasty", "hateful", "cursed", "rotten"]
    text = lambda n: " ".join(draw.choices(words, k=n))
    bench = [text(20) for _ in range(10)]
    docs = {k: text(draw.randint(30, 300)) for k in range(300)}
    for k in range(0, 300, 6):
        docs[k] = f"{docs[k]} {' '.join(draw.choices(bad, k=4))}"
    clean = [k for k in range(300) if k % 6]
    copies = {1000 + k: docs[k].replace(" ", "\n ", 3) for k in clean[:20]}
    near = {2000 + k: docs[k] + " end" for k in clean[20:40]}
    leaks = {3000 + k: f"{text(50)} {bench[k]} {text(50)}" for k in range(10)}
    odd = {4000: None, 4001: "", 4002: text(20000)}
    every = docs | copies | near | leaks | odd
    # texts without an id, and texts that share one: all different, so all stay
    apart = random.Random(1)
    others = [(i, " ".join(apart.choices(words, k=n))) for i, n in ((None, 80), (None, 90), (4003, 70), (4003, 60))]
    rows = [(i, t, "en", "src", len(t or ""), "extra") for i, t in [*every.items(), *others]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = frame.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        frame = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == columns
            kept = frame.collect()
            assert {(i, t) for i, t in others} <= {(r["doc_id"], r["text"]) for r in kept}
            left[name] = {r["doc_id"]: r["text"] for r in kept if r["doc_id"] not in (None, 4003)}
    after = list(left.values())
    assert set(every) - set(after[0]) == {k for k in docs if k % 6 == 0}
    assert set(after[0]) - set(after[1]) == {*copies, 4001}
    gone = set(after[1]) - set(after[2])
    # a word more moves a short text's fingerprint far
    assert gone <= set(near) and len(gone) > 15
    assert set(after[2]) - set(after[3]) == set(leaks)
    assert all(after[3][i] == every[i] for i in after[3])
    every_piece = frame.collect()
    pieces = [p for p in every_piece if p["doc_id"] not in (None, 4003)]
    assert len({(p["doc_id"], p["doc_tokens"]) for p in every_piece}) == len({p["doc_id"] for p in pieces}) + len(others)
    assert {p["doc_id"] for p in pieces} == set(after[3])
    whole = {}
    for p in pieces:
        whole[p["doc_id"]] = whole.get(p["doc_id"], 0) + p["length"]
    assert all(whole[p["doc_id"]] == p["doc_tokens"] for p in pieces)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(every_piece)
