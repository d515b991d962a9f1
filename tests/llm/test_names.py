"""Names of the operators' own columns as columns of the documents, null ids and texts, and hashes that texts are told apart by."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from anemos.llm import decontaminate, mixing, quality, sharding, simhash, warc
from anemos.llm._common import Aside, free_name

OWN = """held own_id own_text id block aside _aside _size _crc _idh _id _n0 _s0 _bucket _here _before _count shard slot size text_crc32 quality_score _quality_score score
mix_size mix_source_size mix_target mix_times mix_taken mix_shards mix_time mix_shard mix_order mix_k mix_b1 mix_b2 mix_drawn mix_hit mix_ends component first node fp cell low high label
source_size target b1 b2 grp of bounds h0 h1 bands tile_i tile_j""".split()


def clashing(spark):
    rows = [(i, f"text number {i} " + " ".join(f"w{(i * 7 + k) % 50}" for k in range(30)), "en", f"s{i % 3}", 100) for i in range(60)]
    rows += [(None, "no id at all", "en", "s0", 3), (70, None, None, None, None), (71, "", "en", "s1", 0), (None, None, None, None, None), (5, rows[5][1], "en", "s2", 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in OWN])


def held(df, columns):
    rows = df.collect()
    for r in rows:
        for c in columns:
            assert r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}", c
    return rows


def test_columns_pass_whatever_their_names(spark):
    df = clashing(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "a benchmark passage that stands nowhere in these documents, as far as one can tell from here, and it is long enough")], "item_id long, text string")
    for out in (decontaminate.decontaminate(df, items), mixing.draw_mix(df), quality.quality_filter(df, labels, 0.0), simhash.simhash_dedup(df, similarity=0.8)):
        assert out.columns == df.columns
        assert len(held(out, OWN)) > 20
    shards = sharding.kd_shards(df, 4)
    assert set(shards.columns) == set(df.columns) and len(held(shards, [c for c in OWN if c not in ("size", "text_crc32", "shard", "slot")])) == df.count()
    assert sharding.kd_shards(df, 4, keep=["doc_id", "_bucket"]).columns == ["doc_id", "_bucket", "size", "text_crc32", "shard", "slot"]


def test_stages_with_null_ids_and_clashing_names(spark, tmp_path):
    df = clashing(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a passage that is nowhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held(docs, OWN)
    assert corpus_pipeline.shards(spark, docs, str(tmp_path)).count() == docs.count() > 40


def test_names_that_are_free(spark):
    assert free_name(["A", "_a"], "a") == "__a" and free_name([], "a") == "a"
    df = spark.createDataFrame([(1, 2, 3)], "a int, `b.c` int, aside int")
    aside = Aside(df, ["a"])
    assert aside.docs.columns == ["a", "_aside"] and aside.docs.select(*aside.back()).collect() == df.collect()


def test_texts_that_polynomial_hashes_confuse_stay_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, "something else", f"{word} one two three four", f"{other} one two three four"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.simhash_dedup(df, similarity=0.8).collect()) == [1, 2, 3, 4, 5]


def test_revisits_name_a_record_of_the_archive(spark, tmp_path):
    page = "<p>" + "same content " * 3000 + "</p>"
    rows = [(4, page), (2, page), (2, page), (9, page), (None, page), (7, "x" * 99), (8, "x" * 99), (5, "own " * 50)]
    warc.write_warc(spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string"), str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w")).collect()
    names = [r["record_id"] for r in records]
    refers = [r["refers_to"] for r in records if r["type"] == "revisit"]
    assert len(set(names)) == len(names) and len(refers) == 3 and set(refers) <= {r["record_id"] for r in records if r["type"] == "response"}
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r["complete"] for r in got)
    assert sorted((r["page_id"] or "", r["record_type"], r["refers_to"]) for r in got) == [("", "revisit", "2"), ("2", "response", None), ("2", "response", None), ("4", "revisit", "2"), ("5", "response", None), ("7", "response", None), ("8", "response", None), ("9", "revisit", "2")]
