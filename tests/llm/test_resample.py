import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anemos.llm.resample import importance, resample
from anemos.llm._common import crc32s


def brute(docs, target, percent, longest, buckets, least):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def counted(text):
        w = split(text)
        return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1))

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(counted(text))
    for text in target:
        t.update(counted(text))
    big_s, big_t, rows = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        c = counted(text)
        n = sum(c.values())
        gained = sum(k * math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b, k in c.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = gained // n if n else 0
        rows.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(split(text)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: sum(r[4] for r in rows) * percent // 100]
    rank = {}
    for k, r in enumerate(order, 1):
        rank.setdefault(r[:4], []).append(k)
    return sorted((r[:4] + (rank[r[:4]].pop(0) if rank.get(r[:4]) and r[4] else None,) for r in rows), key=repr)


def table(rng):
    words = [f"W{i}" for i in range(60)] + ["Éclair", "naïve", "x" * 200, "don't", "a-b"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " .,;"), (1003, "long " * 60_000), (None, "w1 " * 30), (7, rows[7][1]), (7, "another text " * 15), (1004, "w" * 100_000)]
    return rows, [" ".join(rng.choices(words[:9], k=30)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("longest,percent,buckets", [(1, 10, 10_000), (2, 50, 97), (3, 100, 1)])
def test_equals_brute_force(spark, longest, percent, buckets):
    rows, target = table(random.Random(longest))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in ("id", "slice", "grp", "words", "rank", "score", "__at", "part"):  # clashing names
        df = df.withColumn(name, F.lit(777))
    got = importance(df, spark.createDataFrame([(x,) for x in target], "text string"), percent, longest, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, percent, longest, buckets, 20)


def test_empty_tables(spark):
    rows, target = table(random.Random(5))
    df, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance(df.where("false"), none).count() == 0
    assert sorted(map(tuple, importance(df, none).collect()), key=repr) == brute(rows, [], 10, 1, 10_000, 20)


def test_text_ids_and_whole_rows(spark):
    rows, target = table(random.Random(6))
    df = spark.createDataFrame([(None if i is None else f"n{i}", t, k) for k, (i, t) in enumerate(rows)], "name string, body string, k int")
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    scored = importance(df, goal, 20, id_col="name", text_col="body")
    drawn = {r["name"] for r in scored.collect() if r["rank"]} - {None}
    kept = resample(df, goal, 20, id_col="name", text_col="body")
    assert kept.columns and {r["name"] for r in kept.collect()} == drawn and kept.count() == sum(f"n{i}" in drawn for i, _ in rows)


def test_a_crowded_group_is_parted(spark, monkeypatch):
    from anemos.llm import resample as module

    monkeypatch.setattr(module, "PART_BYTES", 64)
    rows, target = table(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, importance(df, spark.createDataFrame([(x,) for x in target], "text string")).collect()), key=repr) == brute(rows, target, 10, 1, 10_000, 20)


def test_refuses_what_has_no_meaning(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    for bad in ({"percent": 101}, {"longest": 0}, {"buckets": 0}):
        with pytest.raises(ValueError):
            importance(df, df, **bad)


def test_checksums():
    parts = [b"", b"a", b"abc" * 30, bytes(range(256)) * 3, b"x" * 64, b"y" * 65]
    buf, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    assert crc32s(buf, ends - [len(p) for p in parts], ends).tolist() == [zlib.crc32(p) for p in parts]
