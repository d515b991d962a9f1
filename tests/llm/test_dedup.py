import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from anemos.llm import lines, suffix
from anemos.llm._common import labels_of, tiles
from anemos.llm.neardup_vectors import calibrated_count, collision_rate, lists_needed, vector_groups
from anemos.llm.simhash import near_fingerprints, simhash_dedup, simhash_groups

EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "a b c d e"), (6, "a b c d e"), (7, "word " * 30000)]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    rows = []
    for i in range(300):
        v = base[i % 60] + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.08, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [1.0] * 15 + [None], 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [1e38] * 16, 0), (908, [1.0] * 16, 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit("clash")).withColumn("id", F.lit(0))
    got = {r["vec_id"]: r for r in vector_groups(df, most=32).collect()}
    assert (got[None]["n_links"], got[None]["component_id"]) == (0, None)
    use = [r for r in rows if r[1] and None not in (r[0], r[2]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    near = np.zeros((len(use),) * 2, bool)
    for i, a in enumerate(use):
        for j, b in enumerate(use):
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                near[i, j] = (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= 0.98
    label = labels_of(near)
    assert len(got) == len(rows)
    for i, r in enumerate(use):
        assert (got[r[0]]["n_links"], got[r[0]]["component_id"]) == (near[i].sum(), use[label[i]][0])
    for i in (900, 901, 902, 903, 904):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert vector_groups(df.where("false")).count() == 0


def test_calibration_misses_as_few_as_asked():
    rng = np.random.default_rng(1)
    for p in (0.3, 0.6):
        lists = lists_needed(p, 2, 1e-3)
        assert (rng.binomial(lists, p, 40000) < 2).mean() <= 2e-3 and calibrated_count(lists, p, 1e-3) >= 2


def test_vectors_at_the_threshold_collide_as_often_as_simulated():
    assert 0.4 < collision_rate(64, 0.98, 2, 2 * 0.2 / 8, 3) < collision_rate(64, 0.98, 1, 2 * 0.2 / 8, 3) < 0.9


def test_vectors_at_the_threshold_are_all_found(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98005 * x + np.sqrt(1 - 0.98005**2) * z
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]
    got = vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).where("n_links = 1 AND component_id = vec_id % 1500").count()
    assert got == 3000


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_on_edge_cases(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(-1))
    got = simhash_groups(df).collect()
    assert len(got) == len(EDGE)
    want = {i: fingerprint(t) for i, t in EDGE}
    assert all(int(r["fingerprint"], 16) == want[r["doc_id"]] for r in got)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert sorted(r["doc_id"] for r in simhash_dedup(df).collect()).count(6) == 2
    assert simhash_groups(df.where("false")).count() == 0 and simhash_dedup(df.where("false")).columns[:2] == ["doc_id", "text"]


def test_fingerprint_links_connect_all_near_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    for _ in range(6):
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        x = np.unique(np.concatenate([x, y[:60]]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for most in (1024, 8):
        links = np.zeros((len(x),) * 2, bool)
        at = {int(v): i for i, v in enumerate(x.view(np.int64))}
        for r in near_fingerprints(df, 4, most).collect():
            links[at[r["a"]], at[r["b"]]] = links[at[r["b"]], at[r["a"]]] = True
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
        assert (labels_of(links) == labels_of(near)).all()


def brute_repeats(docs, length, keep):
    data = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(t[k : k + length] for _, t in data for k in range(len(t) - length + 1))
    seen, out = set(), {}
    for i, t in sorted(data):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if count[w] > 1 if keep == "none" else w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = [word(90), word(60), "ab" * 50]
    docs = [(i, word(30) + shared[i % 3] + word(25) + shared[(i * 7) % 3][: 40 + i % 30]) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "x"), (103, shared[0]), (104, "z" * 500), (105, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("doc", F.lit("clash"))
    for keep in ("none", "first"):
        for most in (4096, 1):
            got = {r["doc_id"]: tuple(r[1:5]) + (bytes(r["kept"]),) for r in suffix.remove_repeats(df, length=40, gram=12, keep=keep, most=most).collect()}
            assert got == brute_repeats(docs, 40, keep)
    assert suffix.remove_repeats(df.where("false"), length=40, gram=12).count() == 0


def test_repeats_of_rows_without_id(spark):
    text = "abcdefghij" * 10
    got = suffix.remove_repeats(spark.createDataFrame([(None, text), (1, text), (None, text), (None, "short"), (None, None)], "doc_id long, text string"), length=40, gram=12).collect()
    assert sorted((r["doc_id"] is None, r["n_bytes"], r["n_removed"]) for r in got) == [(False, 100, 100), (True, 0, 0), (True, 5, 0), (True, 100, 100), (True, 100, 100)]


def test_long_texts_in_turns(spark, monkeypatch):
    rng = np.random.default_rng(6)
    part = "".join(rng.choice(list("abcde"), 300))
    docs = [(1, "".join(rng.choice(list("abcde"), 700)) + part + "".join(rng.choice(list("abcde"), 333)) + part), (2, part[:150])]
    buf = np.frombuffer(docs[0][1].encode(), np.uint8)
    whole = suffix.anchors(buf, np.array([0, len(buf)]), 40, 12)
    assert len(whole[0])
    monkeypatch.setattr(suffix, "TURN", 64)
    got = {r["doc_id"]: tuple(r[1:5]) + (bytes(r["kept"]),) for r in suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=40, gram=12).collect()}
    assert got == brute_repeats(docs, 40, "none")


def test_longest_previous_factors_against_brute_force():
    rng = np.random.default_rng(3)
    for letters in ("ab", "abcd"):
        text = "".join(rng.choice(list(letters), 200))
        order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
        common = lambda i, j: next((k for k in range(len(text)) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or i + k >= len(text) or j + k >= len(text)), len(text))
        shared = np.array([0] + [common(order[k - 1], order[k]) for k in range(1, len(order))])
        want = [max([common(i, j) for j in range(i)], default=0) for i in order]
        assert suffix.longest_previous_factors(order, shared).tolist() == want


def test_lines(spark):
    long = " ".join(f"word{i}" for i in range(50))
    near = long.replace("word7 ", "other ")
    docs = [(1, f"{long}\nfirst only\n---"), (2, f"{near}\nsecond only here"), (3, f"FIRST only\n{long.upper()}\n\n---"), (4, None), (5, ""), (6, "\n\n"), (7, "totally different words in this line"), (None, "first only\nno id"), (None, f"no id\n{long}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("pos", "n_lines", "gone_doc", "gone_lines", "block")})
    out = lines.dedup_lines(df)
    rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()]
    got = {r[0]: r[1:] for r in rows if r[0] is not None}
    kept = [line for r in rows if r[1] for line in r[1].split("\n") if line.strip()]
    assert len(kept) == 6 and {"---", "second only here", "totally different words in this line", "no id"} <= set(kept)
    assert sum(r[3] for r in rows) == 7 and got[4] == (None, 0, 0) and got[5] == ("", 1, 0) and got[6] == ("\n\n", 3, 0) and got[7][2] == 0
    assert out.columns == df.drop("n_lines").columns + ["n_lines", "n_removed"]
    assert lines.dedup_lines(df.where("false")).count() == 0


def test_line_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b\nc d")], "doc_id long, text string")
    plan = lines.marked_lines(df, "doc_id", "text")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_blocks_of_lines_are_shuffled_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, [i // 2, 100 + i]) for i in range(20)], "id long, blocks array<int>")
    rows.write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(lines, "stored", lambda df, *_: df)
    got = lines.shared_blocks(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(tuple(r) for r in got.collect()) == [(i // 2, i, 2) for i in range(20)]
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_tiles_of_crowded_blocks_miss_no_pair(spark, monkeypatch):
    monkeypatch.setattr(lines, "_linked", lambda pairs, *_: pairs.select("ma.id", "mb.id").distinct())
    sizes = {1: 2, 2: 8, 3: 9, 4: 40}
    rows = [(b, 100 * b + i, n, 100 * b + i, 5, 0, 0, 0) for b, n in sizes.items() for i in range(n)]
    left = spark.createDataFrame(rows, "block int, id long, lines long, part long, size int, fp long, b0 long, b1 long")
    got = lines.all_links(left, None, 0.8, most=8).collect()
    assert sorted(tuple(r) for r in got) == sorted((100 * b + i, 100 * b + j) for b, n in sizes.items() for i in range(n) for j in range(i + 1, n))
    seen = []
    monkeypatch.setattr(lines, "tiles", lambda rows, *a: seen.append(rows.count()) or tiles(rows, *a))
    lines.all_links(left, None, 0.8, most=8)
    assert seen == [49]


def test_line_fingerprints(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("abcdefgh"), n))) for i, n in enumerate((1, 2, 127, 128, 129, 700, 20000))]
    got = {r["id"]: r["fp"] & (2**64 - 1) for r in lines.simhashes(spark.createDataFrame(rows, "id long, codes string")).collect()}
    known = {r["w"]: r["x"] & (2**64 - 1) for r in spark.createDataFrame([(c,) for c in "abcdefgh"], "w string").select("w", F.xxhash64("w").alias("x")).collect()}
    for i, codes in rows:
        h = [known[w] for w in codes]
        assert got[i] == sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_against_brute_force(spark):
    """All pairs, with no blocks: lines of 2 to 60 words with words replaced, put in and left out, up to the threshold and beyond."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(2000)]
    found = []
    for _ in range(70):
        base = [str(w) for w in rng.choice(words, rng.choice([3, 5, 8, 12, 20, 60]))]
        found.append(base)
        for _ in range(3):
            w = list(base)
            for _ in range(rng.integers(0, len(base) // 4 + 2)):
                k = int(rng.integers(0, len(w)))
                w[k : k + 1] = [[str(rng.choice(words))], [w[k], str(rng.choice(words))], []][rng.integers(0, 3)] if len(w) > 1 else w[k : k + 1]
            found.append(w)
        typo = list(base)
        typo[0] = typo[0][:-1] + "z"
        found.append(typo)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(found)], "doc_id long, text string")
    near = np.zeros((len(found),) * 2, bool)
    for i, a in enumerate(found):
        for j in range(i):
            b, longer = found[j], max(len(a), len(found[j]))
            if a == b or min(len(a), len(b)) >= 0.8 * longer and edits(a, b) <= 0.2 * longer + 1e-9:
                near[i, j] = near[j, i] = True
            elif longer <= 12 and i // 5 == j // 5:
                s, t = " ".join(a), " ".join(b)
                near[i, j] = near[j, i] = edits(s, t) <= 0.2 * max(len(s), len(t)) + 1e-9
    root = labels_of(near)
    want = {i for i in range(len(found)) if root[i] != i}
    got = {r["doc"]["id"] for r in lines.repeated_lines(df).select("doc").collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 100


def test_lines_in_portions_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(lines, "PAIRS_AT_ONCE", 100)
    test_lines_against_brute_force(spark)


def edited(base, kind, words, rng):
    """base with words replaced, put in, left out or all of these, as many as similarity 0.8 allows."""
    out, n = list(base), len(base)
    if kind == "replaced":
        for at in rng.choice(n, n // 5, replace=False):
            out[at] = str(rng.choice(words))
    elif kind == "put in":
        for _ in range(n // 4):
            out.insert(int(rng.integers(0, len(out) + 1)), str(rng.choice(words)))
    elif kind == "left out":
        out = [base[i] for i in sorted(rng.choice(n, n - n // 5, replace=False))]
    else:
        for _ in range(n // 5):
            at = int(rng.integers(0, len(out)))
            out[at : at + 1] = [[str(rng.choice(words))], [out[at], str(rng.choice(words))], []][rng.integers(0, 3)]
    return out


def test_line_recall_at_the_threshold(spark):
    """Nine tenths of the pairs at similarity 0.8 are found, whatever the length and the kind of edit."""
    rng = np.random.default_rng(4)
    words = list({"".join(rng.choice(list("abcdefghij"), rng.integers(4, 9))) for _ in range(6000)})
    cases = [(n, kind) for n in (5, 10, 13, 20, 24, 28, 35, 40, 50, 120) for kind in ("replaced", "put in", "left out", "mixed")]
    each, docs = 100, []
    for k in range(each * len(cases)):
        n, kind = cases[k % len(cases)]
        base = [str(w) for w in rng.choice(words, n, replace=False)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited(base, kind, words, rng)))]
    got = [r["doc"]["id"] for r in lines.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc").collect()]
    found = np.bincount([i // 2 % len(cases) for i in got], minlength=len(cases))
    assert all(i % 2 for i in got) and found.min() >= 0.9 * each, dict(zip(cases, found))


def test_no_pair_of_lines_at_the_threshold_is_left_out(spark):
    """Every pair at word similarity 0.8 is found, whatever the length and the kind of edit, also where edits stand five words apart and leave no run of five."""
    rng = np.random.default_rng(6)
    words = list({"".join(rng.choice(list("abcdefghij"), rng.integers(4, 9))) for _ in range(6000)})
    common = words[:40]
    docs, k = [], 0
    for n in (5, 6, 9, 10, 14, 19, 20, 21, 24, 29, 40, 44, 75, 120):
        for kind in ("replaced", "put in", "left out", "mixed", "spread"):
            for _ in range(8):
                base = [str(rng.choice(common if rng.random() < 0.5 else words)) for _ in range(n - 1)] + [f"own{k}"]
                rng.shuffle(base)
                other = [f"new{k}" if kind == "spread" and i % 5 == 4 else w for i, w in enumerate(edited(base, kind, words, rng) if kind != "spread" else base)]
                if base != other and min(len(base), len(other)) >= 0.8 * max(len(base), len(other)) and edits(base, other) <= 0.2 * max(len(base), len(other)) + 1e-9:
                    docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
                    k += 1
    got = {r["doc"]["id"] for r in lines.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc").collect()}
    assert k > 480 and not {i for i, _ in docs if i % 2} - got


def test_order_of_blocks_changes_no_result(spark, monkeypatch):
    """What lines.frequencies learns, and from how many documents, only orders blocks."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    docs = []
    for k in range(40):
        base = [str(w) for w in rng.choice(words, rng.choice([4, 9, 20, 44]))]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited(base, "mixed", words, rng)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = []
    for classes in (None, rng.integers(0, 60, lines.BUCKETS)):
        if classes is not None:
            monkeypatch.setattr(lines, "frequencies", lambda *_: F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>"))  # noqa: B023
        found.append({r["doc"]["id"] for r in lines.repeated_lines(df).select("doc").collect()})
    assert found[0] == found[1] and len(found[0]) > 30
