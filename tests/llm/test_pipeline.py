import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: (" ".join(rng.choice(words) for _ in range(n)) + ".").capitalize()
    item = prose(40)
    docs = [(i, prose(120), "en", f"src{i % 4}", 0) for i in range(200)]
    docs += [(200 + i, docs[i][1], "en", "src1", 0) for i in range(30)]  # copies
    docs += [(300 + i, f"{prose(50)} {item} {prose(50)}", "en", "src2", 0) for i in range(20)]  # leaks
    docs += [(400 + i, " ".join(rng.choice(words).upper() + "!!" for _ in range(100)), "en", "src3", 0) for i in range(40)]  # junk
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, int(i < 400), 0) for i, *_ in docs if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = out.columns
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == before
        left.append({r["doc_id"] for r in out.select("doc_id").collect()})
    assert left[0] == {i for i in range(230)} | set(range(300, 320))
    assert left[1] == set(range(200)) | set(range(300, 320))
    assert left[2] == set(range(200))
    assert left[3] <= left[2] and left[4] == left[3]
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() == out.count() and set(rows.columns) >= {"doc_id", "shard", "slot"}
