import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anemos.llm import search as module
from anemos.llm.search import BITS, add_slices, bitmaps, build_index, search, top_places, weighted


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counted = [(i, Counter(split(t))) for i, t in docs]
    big_n, big_l = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    terms = defaultdict(set)
    for i, text in items:
        terms[i].update(split(text))
    out = []
    for item, asked in terms.items():
        found = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * big_n) // big_l if big_l else 0
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in asked if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def table(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Éclair", "Łódź", "x" * 300]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for i in range(500)]
    docs += [(2000 - i, "five COPIES of one text, w150") for i in range(25)]  # ties beyond k
    docs += [(3000, None), (3001, ""), (3002, " -.- "), (3003, "w1 w2 " * 30_000), (None, "w150 w151"), (9, docs[9][1]), (9, "another w151")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(40)]
    return docs, items + [(100, "copies of one"), (101, None), (102, "unheard"), (None, "w151 w150 w150"), (5, "w199"), (103, "w0")]


@pytest.mark.parametrize("k,bytes_,items_", [(10, 1 << 20, 512), (1, 2000, 7), (30, 4096, 1)])
def test_equals_brute_force(spark, monkeypatch, k, bytes_, items_):
    monkeypatch.setattr(module, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(module, "ITEMS", items_)
    docs, items = table(k)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for name in ("block", "term", "ids", "no", "item", "score", "rank", "at"):  # clashing names
        df = df.withColumn(name, F.lit(777))
    got = search(build_index(df), spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def test_empty_tables_and_text_ids(spark):
    docs, items = table(3)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert search(build_index(d.where("false")), q).count() == 0
    assert search(build_index(d), q.where("false")).count() == 0
    named = d.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("name"), F.col("text").alias("body"))
    got = search(build_index(named, "name", "body"), q, 5, id_col="name")
    assert sorted(((r[0], r[1], int(r[2][1:]) if r[2] else None, r[3]) for r in got.collect()), key=repr) == brute(docs, items, 5)


def test_index_holds_every_term_of_every_document(spark):
    docs, _ = table(4)
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    want = Counter(w for _, t in docs for w in set(split(t)))
    assert {bytes(r["term"]).decode(): r["n"] for r in index.rows.where("term is not null").groupBy("term").agg(F.sum("df").alias("n")).collect()} == dict(want)
    assert (index.docs, index.words) == (sum(bool(split(t)) for _, t in docs), sum(len(split(t)) for _, t in docs))
    assert index.rows.agg(F.sum(F.size("ids"))).where("true").first()[0] >= len(docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << BITS) - 1), min_size=1, max_size=30), min_size=1, max_size=8))
def test_bitmaps_hold_their_values(lists):
    count = np.array([len(x) for x in lists])
    bits, bounds = bitmaps(np.concatenate(lists).astype(np.int64), np.repeat(np.arange(len(lists)), count), count)
    for values, lo, hi in zip(lists, bounds, bounds[1:]):
        planes = np.unpackbits(bits[lo:hi].reshape(BITS, -1), axis=1, bitorder="little", count=len(values)).astype(np.int64)
        assert (planes << np.arange(BITS)[:, None]).sum(0).tolist() == values


def sliced(values, slices):
    out = np.zeros((slices, -(-len(values) // 64)), np.uint64)
    for i, v in enumerate(values):
        for j in range(slices):
            out[j, i // 64] |= np.uint64((v >> j & 1) << i % 64)
    return out


def whole(slices, n):
    return [sum(int(slices[j, i // 64] >> np.uint64(i % 64) & np.uint64(1)) << j for j in range(len(slices))) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_carry_arithmetic(data):
    n = data.draw(st.integers(1, 150))
    a = data.draw(st.lists(st.integers(0, 1 << 20), min_size=n, max_size=n))
    b = data.draw(st.lists(st.integers(0, 1 << 12), min_size=n, max_size=n))
    shift = data.draw(st.integers(0, 5))
    acc = sliced(a, 22)
    add_slices(acc, np.arange(acc.shape[1]), sliced(b, 13), shift)
    assert whole(acc, n) == [x + (y << shift) for x, y in zip(a, b)]
    weight = np.array(data.draw(st.lists(st.integers(0, 20_000), min_size=acc.shape[1], max_size=acc.shape[1])))
    assert whole(weighted(sliced(b, 13), weight), n) == [y * int(weight[i // 64]) for i, y in enumerate(b)]
    k = data.draw(st.integers(1, 12))
    best = top_places(sliced(b, 13)[:, None, :], k)[0]
    want = sorted((i for i in range(n) if b[i]), key=lambda i: (-b[i], i))[:k]
    assert sorted(best.tolist()) == sorted(want)
