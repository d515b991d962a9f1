import gzip
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anemos.llm import decontaminate, language, mixing, quality, sharding, warc

EDGE = [(1, None), (2, ""), (3, " \n"), (4, "word " * 40000), (5, "x")]
DOCS = "doc_id long, text string"


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(1)
    rows = [(i, "t" * int(rng.paretovariate(0.9) * 10 % 4000), rng.choice(["en", "fr", None]), i % 7) for i in range(3000)]
    rows += [(5000 + i, "copy of one text", "en", 3) for i in range(1500)] + [(9000, None, None, None), (9001, "", "en", 0), (9001, "", "en", 0), (None, "q", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumn("shard", F.lit("clash"))
    for shards in (8, 5):
        got = sharding.kd_shards(df, shards).toPandas()
        assert len(got) == len(rows)
        size = got.groupby("shard")["size"].sum()
        assert len(size) == shards and size.max() / size.min() < 1.06
        assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
        assert (got["text_crc32"] == [zlib.crc32((t or "").encode()) for t in got["text"]]).all()
    assert sharding.kd_shards(df.where("false"), 8).count() == 0
    total = sum(len(r[1] or "") + 1 for r in rows)
    assert sharding.kd_shards(df, None, total // 3).select("shard").distinct().count() in (3, 4)
    again = sharding.kd_shards(df.repartition(9), 8, keep=["doc_id"])
    assert not again.exceptAll(sharding.kd_shards(df, 8, keep=["doc_id"])).count()


def test_sharding_is_native(spark):
    plan = sharding.kd_shards(spark.createDataFrame(EDGE, DOCS), 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest} | {s: 3 * sizes[s] for s in capped}
        over = {s for s in rest if t[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "b", "b", "b", "c", None, "z"])) for i in range(4000)]
    rows += [(9000, None, "a"), (9001, "", "only-empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_size", F.lit("clash")).withColumn("full", F.lit(1))
    got = mixing.mix_sources(df).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    got["source"] = got["source"].where(got["source"].notna(), None)
    for s, t in want.items():
        part = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert part["mix_target"].iloc[0] == pytest.approx(t) and part["mix_source_size"].iloc[0] == sizes[s]
        assert t - 60 <= part["mix_taken"].sum() <= t + 1e-6
    assert (got["mix_taken"] <= 3 * got["mix_size"]).all()
    again = mixing.mix_sources(df.repartition(7)).select("doc_id", "mix_taken", F.col("mix_shards").cast("string"))
    assert not again.exceptAll(mixing.mix_sources(df).select("doc_id", "mix_taken", F.col("mix_shards").cast("string"))).count()
    drawn = mixing.draw_mix(df)
    assert drawn.count() == got["mix_times"].sum() and drawn.columns == df.columns  # mix_size of the table too
    assert mixing.mix_sources(df.where("false")).count() == 0


def test_split_tree_is_exact():
    units = np.array([17, 0, 5, 101])
    parts = mixing.split_tree(units, 7, np.random.default_rng(0))
    assert (parts.sum(0) == units).all() and parts.sum(1).max() - parts.sum(1).min() <= 1 + math.ceil(math.log2(7))


def edit_near(region, text, budget):
    cost = [0] * (len(text) + 1)
    for i, c in enumerate(region, 1):
        before, cost[0] = cost[0], i
        for j in range(1, len(text) + 1):
            before, cost[j] = cost[j], min(cost[j] + 1, cost[j - 1] + 1, before + (text[j - 1] != c))
    return min(cost) <= budget


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    items = [(0, prose(40)), (1, prose(12)), (2, "tiny"), (3, None), (4, "")]

    def edited(text, n):
        t = list(text)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["x"], [t[k], "y"]])
        return "".join(t)

    docs = [(i, f"{prose(20)} {edited(items[i % 2][1], i // 4)} {prose(20)}") for i in range(40)]
    docs += [(100 + i, prose(60)) for i in range(20)] + [(200, items[0][1].upper().replace(" ", ", ")), *[(300 + i, t) for i, t in EDGE], (0, docs[0][1])]
    df = spark.createDataFrame(docs, DOCS).withColumn("regions", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    index = decontaminate.build_index(pa.array([t for _, t in items if t]))
    norm = lambda t: decontaminate.normalised(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tobytes()
    want = set()
    for i, t in docs:
        if t and len(t) < 5000:
            for k in range(len(index.item)):
                region = index.text[index.start[k] : index.start[k] + index.size[k]].tobytes()
                if edit_near(region, norm(t), index.edits[k]):
                    want.add((i, int(index.item[k])))
    assert got == want and (200, 0) in got and len({i for i, _ in got}) > 15
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0
    assert decontaminate.contaminated(df.where("false"), bench).count() == 0
    split = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, part_bytes=10).collect()}
    assert split == got


def test_language(spark):
    rng = random.Random(5)
    words = {"en": "the of and thing water house with".split(), "de": "der die und für wörter straße nicht".split(), "fr": "le la où être garçon très avec".split()}
    docs = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(5, 60))), k) for i in range(300) for k in [rng.choice(list(words))]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    net = language.fit_language(df.where("doc_id % 4 <> 2"), steps=120)
    again = language.fit_language(df.where("doc_id % 4 <> 2").repartition(5), steps=120)
    assert all((a == b).all() for a, b in zip(net.weights(), again.weights()))
    got = language.detect_language(df.where("doc_id % 4 = 2").withColumn("score", F.lit("clash")), net).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    edge = {r["doc_id"]: r for r in language.detect_language(spark.createDataFrame([*EDGE, (6, "12 ?!")], DOCS), net).collect()}
    assert [edge[i]["lang_pred"] for i in (1, 2, 3, 6)] == ["und"] * 4 and edge[4]["lang_pred"] in words
    assert {r["lang_pred"] for r in language.detect_language(df.limit(2), language.fit_language(df.where("false"))).collect()} == {"und"}


def test_language_gradient():
    rng = np.random.default_rng(0)
    net = language.ByteGRU.start(["a", "b"], 3, rng)
    net.table, net.turn = [w.astype(float) for w in net.table], [w.astype(float) for w in net.turn]
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    x, y = rng.integers(97, 103, (9, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = net.gradient(x, y)
    for w, g in zip(net.weights(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = w[i], 1e-2
        w[i] = old + e
        high = net.gradient(x, y)[0]
        w[i] = old - e
        low = net.gradient(x, y)[0]
        w[i] = old
        assert (high - low) / (2 * e) == pytest.approx(g[i], rel=1e-2)


def test_language_of_a_text_does_not_depend_on_its_neighbours():
    net = language.ByteGRU.start(["a", "b"], 4, np.random.default_rng(1))
    texts = [b"abc", b"x" * 300, b"hello world " * 30]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    alone = [net.classify(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(net.classify(buf, offs), alone, atol=1e-5)


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice("the quick brown fox jumps over a lazy dog".split()) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join(rng.choice("the quick brown fox".split()).upper() + "!!%%" for _ in range(60))
    docs = [(i, bad() if i % 5 == 0 else good()) for i in range(400)]
    df = spark.createDataFrame([*docs, *[(1000 + i, t) for i, t in EDGE]], DOCS).withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(0, 400, 2)] + [(7777, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit_quality(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(df, model).collect()}
    assert all((got[i] >= 0.3) == (i % 5 != 0) for i in range(1, 400, 2)) and got[1001] == pytest.approx(0.8, abs=0.01)
    kept = quality.quality_filter(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(400) if i % 5}
    assert quality.quality_filter(df, labels.where("false")).count() == df.count()
    assert quality.quality_filter(df.where("false"), labels).count() == 0


def test_quality_is_fitted_with_one_matrix_on_the_driver(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    df = spark.createDataFrame([(i, " ".join(rng.sample(words, 800))) for i in range(600)], DOCS).repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    tracemalloc.start()
    model = quality.fit_quality(df, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.vectors.shape == (600, 48) and peak < 2 * 600 * quality.TERMS * 4  # the counts of all labelled documents, as float32


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 30000
    rows = [(1, "http://a/ b\r\nX: y", "x" * 500), (2, None, "x" * 500), (3, "http://c", "short"), (4, "http://d", "short"), (5, "http://e", None), (6, "http://f", ""), (7, "http://g", big), (8, "http://h", "WARC/1.1\r\n\r\n0\r\n\r\n" * 40), (8, "http://h", "WARC/1.1\r\n\r\n0\r\n\r\n" * 40), (9, "http://i", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("first", F.lit(0))
    warc.write_warc(df, str(tmp_path / "w"))
    got = sorted((int(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["complete"], bytes(r["payload"]).decode() if r["payload"] is not None else None) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    want = []
    for i, _, html in rows:
        first = min(j for j, _, h in rows if h == html) if html and len(html.encode()) >= 100 else i
        want.append((i, "revisit" if first != i else "response", str(first) if first != i else None, len((html or "").encode()), True, (html or "") if first == i else None))
    assert got == sorted(want, key=lambda x: x[:2])
    assert warc.read_records(spark, str(tmp_path / "w")).where("segment > 3").count() > 0
    warc.write_warc(df.where("false"), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_warc_files_are_few_however_rows_are_dealt(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"http://x/{i}", "same" * 50 if i % 3 else f"<p>{i}</p>") for i in range(300)], "page_id long, url string, html string")
    deal = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *cols: deal(self, max(40, n), *cols))
    warc.write_warc(df, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("part-*"))) <= spark.sparkContext.defaultParallelism
    got = {int(r["page_id"]): (r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "w")).where("complete").collect()}
    assert got == {i: ("revisit", "1") if i % 3 and i > 1 else ("response", None) for i in range(300)}


def test_warc_pages_without_id(spark, tmp_path):
    rows = [(None, "u", "x" * 300), (None, "u", "x" * 300), (5, "u", "x" * 300), (None, "u", "y" * 300), (None, "u", "y" * 300), (None, None, None)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = sorted((r["page_id"] or "", r["record_type"], r["refers_to"] or "", r["payload_bytes"], r["complete"]) for r in warc.read_warc(spark, str(tmp_path / "w"), payloads=False).collect())
    assert got == [("", "response", "", 0, True), ("", "response", "", 300, True), ("", "response", "", 300, True), ("", "revisit", "5", 300, True), ("", "revisit", "5", 300, True), ("5", "response", "", 300, True)]


def test_warc_of_others(spark, tmp_path):
    """Files of one member a record, broken headers, records cut short, revisits of nothing."""
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    record = lambda kind, head, block, n=None: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{head.split(':')[-1]}>\r\n{head}\r\nContent-Length: {len(block) if n is None else n}\r\n\r\n".encode() + block + b"\r\n\r\n"
    digest = lambda body: f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}"
    records = [
        record("warcinfo", "X: 1", b"software: x"),
        record("response", digest(b"one"), http + b"one"),
        record("response", digest(b"two"), http + b"two", "many"),
        record("response", "WARC-Segment-Number: first", http + b"three"),
        record("revisit", f"WARC-Refers-To: <urn:page:77>\r\n{digest(b'gone')}", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n"),
        record("response", digest(b"four"), http + b"four", 900),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records[:2]))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records))[:-40])
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sum(r["complete"] for r in got) >= 2 and all(bytes(r["payload"]) == b"one" for r in got if r["complete"])
    assert sum(not r["complete"] for r in got) >= 4


def test_warc_finds_missing_segments(spark):
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    rows = [("<urn:page:1:u>", "response", None, 1, None, None, "sha256:0", None, True, block[:10]), ("x", "continuation", "<urn:page:1:u>", 3, len(block), None, None, None, True, block[10:])]
    out = warc.reassemble(spark.createDataFrame(rows, warc.PARSED)).first()
    assert out["whole"] is False
    assert warc.unchunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000 and warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None


def test_partial_passages_at_any_offset(spark):
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n)).replace("  ", "qz")
    item = "x" + prose(398) + "y"
    docs = [(k, f"{prose(70)}.{item[k : k + 130]}.{prose(70)}") for k in range(0, 270, 9)] + [(1000 + k, f"{prose(70)}.{item[k : k + 100]}.{prose(70)}") for k in range(3, 300, 7)]
    for k in range(5, 295, 13):  # six edits at once, a letter each put in, left out and replaced
        t = list(item[k : k + 100])
        for e, at in enumerate(sorted(rng.sample(range(10, 90, 9), 6), reverse=True)):
            t[at : at + 1] = [[t[at], "0"], [], ["9"]][e % 3]
        docs.append((2000 + k, f"{prose(70)}.{''.join(t)}.{prose(70)}"))
    clean = [(3000 + k, f"{prose(70)}.{item[k : k + 60]}.{prose(70)}") for k in range(0, 300, 50)]
    df = spark.createDataFrame(docs + clean, DOCS)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {i for i, _ in docs}
    assert all(got[i]["edits"] == 0 for i in got if i < 2000) and all(0 < got[i]["edits"] <= 6 for i in got if i >= 2000)
    assert all(got[k]["regions"] >= 31 and got[k]["of_regions"] == 301 for k in range(0, 270, 9))


def test_repetitive_items_and_texts_in_pieces(spark, monkeypatch):
    """A word said over and over, in the item and in the text: as many pairs of equal q-grams as the product of both."""
    rng = random.Random(3)
    prose = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))
    many = "spam " * 2000
    index = decontaminate.build_index(pa.array([many, many[:500] + prose + many[:500]]))
    assert len(index.post_off) < 4000  # regions with the same bytes have their postings once
    for hits in (decontaminate.HITS, 1 << 18):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        for text, want in ((many * 4, {0, 1}), (prose, {1}), (many[:60] + "0123456789" * 5, set())):
            buf = np.frombuffer(text.encode(), np.uint8)
            _, seg, edits = decontaminate.find_regions(buf, np.array([0, len(buf)]), index)
            assert set(np.searchsorted(np.cumsum(index.regions), seg, side="right")) == want and not (edits > 6).any()
    got = decontaminate.contaminated(spark.createDataFrame([(1, many * 4)], DOCS), spark.createDataFrame([(1, many)], "item_id long, text string")).first()
    assert got["regions"] == got["of_regions"] == 2000 * 5 - 1 - 99


def test_short_items_have_their_whole_budget(spark):
    items = [(1, "Paris!"), (2, "a red, red rose"), (3, "seventeen letters"), (4, "thirty-five characters, two mistakes"), (5, "..."), (6, None)]
    docs = [(1, "in PARIS, then"), (2, "parisian"), (3, "A red red rose."), (4, "a red bed rose"), (5, "so seventeen leters it is"), (6, "sevnteen leters"), (7, "the thirty five charcters two mistaks here"), (None, "in paris"), (None, "elsewhere"), (8, None)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 1), (None, 1), (3, 2), (5, 3), (7, 4)}
    left = decontaminate.decontaminate(df, bench).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, "elsewhere"), (2, "parisian"), (4, "a red bed rose"), (6, "sevnteen leters"), (8, "")]


def test_units_of_sources_are_split_among_shards(spark):
    units = [(f"s{i}" if i else None, (i * 37) % 50) for i in range(3000)]
    got = mixing.shard_bounds(spark.createDataFrame(units, "source string, n long"), 7, "mix:").collect()
    assert {r["of"]: r["bounds"][-1] for r in got} == dict(units) and all(len(r["bounds"]) == 7 and list(r["bounds"]) == sorted(r["bounds"]) for r in got)
    total = sum(n for _, n in units)
    ends = [sum(r["bounds"][k] for r in got) for k in range(7)]
    assert all(abs(b - a - total / 7) <= 3 for a, b in zip([0, *ends], ends))
