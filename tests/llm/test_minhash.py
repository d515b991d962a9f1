import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa

from anemos.llm import minhash
from anemos.llm._common import labels_of

EDGE = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one"), (9005, "One"), (9006, "a b c d e"), (9006, "a b c d e"), (9007, "word " * 30000)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_shared_counts_against_brute_force():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 60))) for _ in range(30)]
    shared, size = minhash.shared_counts(pa.array([x.tolist() for x in sets], pa.list_(pa.int64())), width=16)
    assert size.tolist() == [len(x) for x in sets]
    assert all(shared[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_near_duplicate_stage_in_crowds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 2)
    test_near_duplicate_stage_against_brute_force(spark, tmp_path)


def test_near_duplicate_stage_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    common = " ".join(rng.choice(words) for _ in range(30))
    docs = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([12, 40, 150, 600]))]
        docs.append((10 * i, " ".join(base)))
        for k in range(1, 5):  # each replaced word takes five shingles with it
            near = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) * k // 180)):
                near[at] = rng.choice(words)
            docs.append((10 * i + k, "\n ".join(near).upper()))
        docs.append((10 * i + 6, f"{common} {' '.join(base[: len(base) // 2])}"))
    docs += EDGE
    text = {}
    for i, t in docs:
        text[i] = shingles(t)
    ids = sorted(text)
    j = np.array([[len(text[a] & text[b]) / len(text[a] | text[b]) for b in ids] for a in ids])
    root = labels_of(j >= 0.8 - 1e-12)
    planted = np.triu((j >= 0.8) & (j < 0.95), 1).sum()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()}
    assert planted > 50 and got == {ids[k] for k in range(len(ids)) if root[k] == k}
    assert corpus_pipeline.near_duplicates(spark, df.where("false"), str(tmp_path)).count() == 0


def test_no_near_duplicate_is_left_out(spark, tmp_path):
    """Pairs at Jaccard 0.8 that share none of 32 bands of four MinHashes."""
    pairs = [("ojek kqdw eoge sxhd ldxz zpmd opbc dppy tqma bpqz kqah xtlf", "hgrb", "ewpx"), ("fbgr owxz sgaz ovqr eene camq lhru frhm zuji yhlc zyme gbmg", "meug", "ebar")]
    docs = [(2 * i + k, f"{p[0]} {p[1 + k]}") for i, p in enumerate(pairs) for k in (0, 1)] + [(9, "quite another text")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2, 9]


def test_first_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(8)
    for n in (1, 2, 4, 5, 9, 10, 45, 400):
        for lost in range(0, n // 5 + 1):
            union = rng.integers(0, 1 << 63, n + lost, dtype=np.uint64)
            a, b = np.sort(union[:n]), np.sort(union[lost:])
            counts = rng.integers(0, 4, 1 << minhash.BUCKET_BITS)
            if (n - lost) * 1.8 >= 0.8 * 2 * n - 1e-9:
                first, ends = minhash.prefixes(np.concatenate([a, b]), np.array([0, n, 2 * n]), counts, 0.8)
                assert set(first[: ends[1]]) & set(first[ends[1] :])
