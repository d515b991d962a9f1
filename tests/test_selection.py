import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from anemos.functions.aggs import aggregate, fold, python_aggregate
from anemos.operators import quantile as Q
from anemos.operators.asof import asof
from anemos.operators.period import average_by_period


@pytest.mark.parametrize("most", [3, 50, 100_000])
def test_quantiles_equal_numpy(spark, most, monkeypatch):
    rng = random.Random(most)
    rows = [("skewed", rng.choice([1.5, 1.5, 1.5, rng.paretovariate(0.3)])) for _ in range(4000)] + [("wide", rng.uniform(-1e300, 1e300)) for _ in range(700)]
    rows += [("one", 7.0), ("none", None), (None, 1.0), (None, 4.0)] + [("hot", 2.0)] * 3000 + [("hot", float(i)) for i in range(300)]
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.987, "e": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").withColumn("w", F.lit(3)).withColumn("t", F.lit(4))
    got = {r["g"]: [r[x] for x in shares] for r in Q.group_quantiles(df, ["g"], "v", shares, most).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g] == pytest.approx([float(np.quantile(np.array(values), p)) for p in shares.values()], rel=1e-9)


def test_quantiles_at_the_edges(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert Q.group_quantiles(df, [], "v", {"p": 0.9}).first()["p"] == pytest.approx(3.7)
    assert Q.group_quantiles(df.where("false"), [], "v", {"p": 0.9}).count() == 0
    with pytest.raises(ValueError):
        Q.group_quantiles(df, [], "v", {"p": 90})


def test_no_buffer_of_selection_grows_with_rows(spark):
    plan = Q.group_quantiles(spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v")), ["g"], "v", {"p": 0.5}, most=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan and "collect_list" not in plan and "collect_set" not in plan


def test_python_aggregates(spark):
    start = datetime(2020, 1, 1)
    df = spark.createDataFrame([(start + timedelta(hours=i), None if i % 7 == 0 else float(i * i % 101)) for i in range(24 * 9)], "ts timestamp_ntz, v double")
    by_python = average_by_period(df, "1D", ["v"], method=python_aggregate(lambda v: v.mean() + 2 * v.std()), return_coverage=True)
    by_column = average_by_period(df, "1D", ["v"], method=lambda c: F.avg(c) + 2 * F.stddev_samp(c), return_coverage=True)
    for a, b in zip(by_python.orderBy("ts").collect(), by_column.orderBy("ts").collect()):
        assert a["v"] == pytest.approx(b["v"]) and a["v_coverage"] == b["v_coverage"]
    none = spark.createDataFrame([(1, None)], "k int, v double").groupBy("k").agg(aggregate(python_aggregate(lambda v: v.max()), F.col("v")).alias("v"))
    assert none.first()["v"] is None


@pytest.mark.parametrize("most", [2, 1000])
def test_folded_states(spark, most):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), i % 3, None if i % 11 == 0 else rng.random()) for i in range(900)] + [("empty", 0, None)]
    got = fold(spark.createDataFrame(rows, "k string, j int, v double").repartition(7), ["k", "j"], "v", lambda: (None, None), lambda s, v: s if not len(v) else (v.min() if s[0] is None else min(s[0], v.min()), v.max() if s[1] is None else max(s[1], v.max())),
               lambda a, b: tuple(y if x is None else x if y is None else f(x, y) for f, x, y in zip((min, max), a, b)), lambda s: None if s[0] is None else float(s[1] - s[0]), most=most)
    want = {}
    for k, j, v in rows:
        want.setdefault((k, j), []).append(v)
    want = {k: [x for x in v if x is not None] for k, v in want.items()}
    assert {(r["k"], r["j"]): r["value"] for r in got.collect()} == {k: pytest.approx(max(v) - min(v)) if v else None for k, v in want.items()}


def test_folds_of_many_groups_are_updated_once_a_group(spark):
    """Rows of 5,000 groups that lie in any order: update() sees a group's rows together, not a few in each of the input's partitions."""
    calls = spark.sparkContext.accumulator(0)

    def update(state, v):
        calls.add(1)
        return state + float(v.sum())

    df = spark.range(0, 50_000, 1, 10).select((F.col("id") * 7919 % 5000).alias("k"), F.lit(2.0).alias("v"))
    got = fold(df, ["k"], "v", lambda: 0.0, update, lambda a, b: a + b, lambda s: s).collect()
    assert len(got) == 5000 and {r["value"] for r in got} == {20.0} and calls.value < 10_000


def brute(left, right, direction, within):
    out = []
    for i, t, k in left:
        hit = None
        if t is not None and k is not None:
            mine = [(rt, rv) for rt, rk, rv in right if rk == k and rt is not None]
            before = max((r for r in mine if r[0] <= t), key=lambda r: (r[0], r[1] is not None, r[1] or 0), default=None)
            after = max((r for r in mine if r[0] >= t), key=lambda r: (-r[0].timestamp(), r[1] is not None, r[1] or 0), default=None)
            hit = before if direction == "backward" else after if direction == "forward" else after if before is None or (after and after[0] - t < t - before[0]) else before
            if hit and within and abs(hit[0] - t) > within:
                hit = None
        out.append((i, t, k, *(hit or (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("within", [None, "5 hours"])
def test_asof_equals_brute_force(spark, direction, within):
    rng = random.Random(len(direction))
    when = lambda: datetime(2020, 1, 1) + timedelta(hours=rng.choice([rng.randint(0, 30), rng.randint(0, 2000)]))
    left = [(i, when(), rng.choice("ab")) for i in range(300)] + [(900, None, "a"), (901, when(), None), (902, when(), "unknown"), (903, datetime(2019, 1, 1), "a"), (904, datetime(2030, 1, 1), "b")]
    right = [(when(), rng.choice("ab"), float(rng.randint(0, 5))) for _ in range(120)] + [(None, "a", 1.0), (datetime(2020, 1, 2), "a", None), (datetime(2020, 1, 2), None, 1.0)]
    a, b = spark.createDataFrame(left, "i int, ts timestamp_ntz, k string"), spark.createDataFrame(right, "ts timestamp_ntz, k string, i double")
    got = asof(a, b, ["k"], direction, within)
    assert got.columns == ["i", "ts", "k", "ts_right", "i_right"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right, direction, timedelta(hours=5) if within else None)


def test_asof_without_rows_or_keys(spark):
    a = spark.createDataFrame([(1, datetime(2020, 1, 5))], "i int, ts timestamp_ntz")
    b = spark.createDataFrame([(datetime(2020, 1, 1), 2.0), (datetime(2020, 1, 3), 3.0)], "ts timestamp_ntz, v double")
    assert asof(a, b).first()["v"] == 3 and asof(a, b.where("false")).first()["v"] is None and asof(a.where("false"), b).count() == 0
    assert asof(a, b, direction="forward").first()["v"] is None
    with pytest.raises(ValueError):
        asof(a, b, direction="sideways")
