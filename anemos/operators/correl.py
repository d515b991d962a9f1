"""Correlation of a target with a reference and long-term prediction. Fits are aggregates; parameters are small tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anemos.functions.bins import sector
from anemos.functions.scalar import veer, wrap
from anemos.functions.timeaxis import bounds, micros_between, resolution, shift
from anemos.functions.aggs import Aggregate
from anemos.operators.period import average_by_period, merge_by_period, momm, overlap_start
from anemos.operators.record import FitRecord, watched


def renamed_apart(names: list[str], others: list[str], suffix: str = "_1") -> list[str]:
    """names, all with the suffix if any of them is among others."""
    return [n + suffix for n in names] if set(names) & set(others) else list(names)


def set_apart(ref: DataFrame, target: DataFrame, suffix: str = "_ref", ts: str = "ts") -> DataFrame:
    """ref with the columns renamed that target has too."""
    return ref.withColumnsRenamed({c: c + suffix for c in ref.columns if c != ts and c in target.columns})


def merge_references(refs: list[DataFrame], ts: str = "ts") -> DataFrame:
    """The references' columns side by side at the timestamps that all have; a name that several have gets _0, _1, ... in their order."""
    names = [c for r in refs for c in r.columns if c != ts]
    count: dict[str, int] = {}
    out = None
    for r in refs:
        new = {}
        for c in r.columns:
            if c != ts and names.count(c) > 1:
                new[c] = f"{c}_{count.get(c, 0)}"
                count[c] = count.get(c, 0) + 1
        r = r.withColumnsRenamed(new)
        out = r if out is None else out.join(r, ts)
    return out


def _r2(y: Column, predicted: Column) -> Column:
    return 1 - F.try_divide(F.sum((y - predicted) * (y - predicted)), F.count(y) * F.var_pop(y))


def ols(data: DataFrame, x: str, y: str, through_origin: bool = False, by: list[str] | None = None, record: FitRecord | None = None) -> DataFrame:
    """(by..., slope, offset, n) of least squares; groups of one row have none. A record is told of the rows in the same pass."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = watched(record, data, both, [x, y], method="ordinary least squares", through_origin=through_origin, by=by).where(both)
    if through_origin:
        slope, offset = F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))), F.lit(0.0)
    else:
        slope, offset = F.regr_slope(F.col(y), F.col(x)), F.regr_intercept(F.col(y), F.col(x))
    n = F.count(F.lit(1))
    return rows.groupBy(*(by or [])).agg(F.when(n > 1, slope).alias("slope"), F.when(n > 1, offset).alias("offset"), n.alias("n"))


def ols_by_sector(data: DataFrame, x: str, y: str, direction: str, sectors: int = 12, through_origin: bool = False) -> DataFrame:
    """(sector, slope, offset, n, r2)."""
    rows = data.where(F.col(direction).isNotNull()).withColumn("sector", sector(F.col(direction), sectors))
    params = ols(rows, x, y, through_origin, ["sector"])
    fitted = rows.join(F.broadcast(params), "sector").groupBy("sector").agg(_r2(F.col(y), F.col(x) * F.col("slope") + F.col("offset")).alias("r2"))
    return params.join(fitted, "sector")


def orthogonal(data: DataFrame, x: str, y: str, record: FitRecord | None = None) -> DataFrame:
    """(slope, offset, n): total least squares with equal weights, in closed form."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = watched(record, data, both, [x, y], method="orthogonal least squares").where(both)
    s = rows.agg(F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count(F.lit(1)).alias("n"))
    d = F.col("syy") - F.col("sxx")
    slope = F.try_divide(d + F.sqrt(d * d + 4 * F.col("sxy") * F.col("sxy")), 2 * F.col("sxy"))
    return s.select(slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("offset"), "n")


def multiple(data: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(term, value): least squares on several references; the offset's term is "offset". The sums of products are one aggregate;
    the driver solves as many equations as there are references, plus one."""
    rows = data.dropna(subset=[*xs, y])
    terms = [F.lit(1.0), *[F.col(x) for x in xs]]
    k = len(terms)
    sums = rows.agg(*[F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]], *[F.sum(a * F.col(y)) for a in terms]).first()
    gram, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = sums[at]
            at += 1
    values = np.linalg.lstsq(gram, np.array(sums[at:], float), rcond=None)[0]
    return data.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(["offset", *xs], values)], "term string, value double")


def predict_multiple(data: DataFrame, params: DataFrame, xs: list[str], name: str = "predicted") -> DataFrame:
    p = {r["term"]: r["value"] for r in params.collect()}  # one row a reference
    return data.withColumn(name, reduce(lambda a, b: a + b, [F.col(x) * p[x] for x in xs]) + p["offset"])


def fit_r2_multiple(data: DataFrame, params: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(r2) of a fit of several references."""
    rows = predict_multiple(data.dropna(subset=[*xs, y]), params, xs, "_p")
    return rows.agg(_r2(F.col(y), F.col("_p")).alias("r2"))


def fit_r2(data: DataFrame, params: DataFrame, x: str, y: str) -> DataFrame:
    """(r2) of a one-row linear fit."""
    rows = data.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(params.select("slope", "offset")))
    return rows.agg(_r2(F.col(y), F.col(x) * F.col("slope") + F.col("offset")).alias("r2"))


def predict(data: DataFrame, params: DataFrame, x: str, name: str = "predicted", direction: str | None = None, sectors: int = 12) -> DataFrame:
    """data with x * slope + offset, of its sector where the parameters have sectors."""
    p = params.select(*(["sector"] if direction else []), F.col("slope").alias("_slope"), F.col("offset").alias("_offset"))
    if direction:
        out = data.withColumn("sector", sector(F.col(direction), sectors)).join(F.broadcast(p), "sector", "left").drop("sector")
    else:
        out = data.crossJoin(F.broadcast(p))
    return out.withColumn(name, F.col(x) * F.col("_slope") + F.col("_offset")).drop("_slope", "_offset")


def combine(target: DataFrame, synthetic: DataFrame, column: str, ts: str = "ts") -> DataFrame:
    """(ts, <column>_Synthesized): the target where it has a value, else the prediction (column predicted)."""
    both = target.select(ts, column).join(synthetic.select(ts, "predicted"), ts, "full")
    return both.select(ts, F.coalesce(column, "predicted").alias(f"{column}_Synthesized")).where(F.col(f"{column}_Synthesized").isNotNull())


def synthesize(ref: DataFrame, target: DataFrame, ref_speed: str, target_speed: str, period: str, ref_direction: str | None = None, sectors: int = 12, threshold: float | None = None, through_origin: bool = False, ts: str = "ts", ref_method: Aggregate = "mean", target_method: Aggregate = "mean") -> DataFrame:
    """Fit on the merged averages, by sector if a direction is given, and fill the target's averages from the reference's. All
    bins are counted from the merged data's first, so those of both sides meet. Each side has its own aggregate. If both speeds have one name, the reference's
    gets the suffix _ref."""
    ref = set_apart(ref, target.select(ts, target_speed), ts=ts)
    ref_speed = renamed_apart([ref_speed], [target_speed], "_ref")[0]
    wanted = [ref_speed, *([ref_direction] if ref_direction else [])]
    dirs = (ref_direction,) if ref_direction else ()
    merged = merge_by_period(ref.select(ts, *wanted), target.select(ts, target_speed), period, dirs, method_1=ref_method, method_2=target_method, threshold_1=threshold, threshold_2=threshold, ts=ts)
    params = ols_by_sector(merged, ref_speed, target_speed, ref_direction, sectors, through_origin) if ref_direction else ols(merged, ref_speed, target_speed, through_origin)
    start = bounds(merged, ts)[0]
    sides = [average_by_period(df.select(ts, *cols), period, cols, d, m, threshold, origin=start, fill=False, ts=ts) for df, cols, d, m in ((ref, wanted, dirs, ref_method), (target, [target_speed], (), target_method))]
    return combine(sides[1], predict(sides[0], params, ref_speed, direction=ref_direction, sectors=sectors), target_speed, ts)


def synthesize_multiple(data: DataFrame, merged: DataFrame, xs: list[str], y: str, ts: str = "ts") -> DataFrame:
    """Predictions before the first merged row, then the merged targets."""
    first = bounds(merged, ts)[0]
    early = predict_multiple(data, multiple(merged, xs, y), xs).where(F.col(ts) < F.lit(first).cast("timestamp_ntz"))
    return early.select(ts, F.col("predicted").alias(f"{y}_Synthesized")).unionByName(merged.select(ts, F.col(y).alias(f"{y}_Synthesized")))


def speed_ratio(ref: DataFrame, target: DataFrame, ref_speed: str, target_speed: str, strict: bool = False, ts: str = "ts") -> DataFrame:
    """One row (simple_speed_ratio, ref_long_term_momm, target_long_term, target_overlap_coverage). The overlap ends with the
    reference; strict ends it with the earlier of both."""
    (a1, b1), (a2, b2) = bounds(ref, ts), bounds(target, ts)
    start, end = max(a1, a2), min(b1, b2) if strict else b1
    inside = F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    every = resolution(target.where(inside), ts)
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    points = micros_between(s, e) / micros_between(s, shift(s, every))
    points = F.round(points) if every.months == 1 else points
    r = ref.where(inside).agg(F.avg(ref_speed).alias("r"))
    t = target.where(inside).agg(F.avg(target_speed).alias("t"), F.count(target_speed).alias("n"))
    long_term = momm(ref.select(ts, ref_speed), [ref_speed], ts=ts).select(F.col("momm").alias("ref_long_term_momm"))
    ratio = F.try_divide("t", "r")
    return r.crossJoin(t).crossJoin(long_term).select(ratio.alias("simple_speed_ratio"), "ref_long_term_momm", (ratio * F.col("ref_long_term_momm")).alias("target_long_term"), F.try_divide(F.col("n"), points).alias("target_overlap_coverage"))


def speedsort_cutoff(long_term_mean: float) -> float:
    return min(0.5 * long_term_mean, 4.0)


def ranked(rows: DataFrame, group: str, value: str, step: float = 0.01) -> DataFrame:
    """rows with their rank `rn` by value in their group. Values are cut into bins of `step`; a row's rank is its rank in the bin and the
    rows in the bins before it, so that a group's rows are never sorted in one task."""
    binned = rows.withColumn("_bin", F.floor(F.col(value) / step))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    counts = binned.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(group, "_bin").orderBy(value))
    return binned.join(counts, [group, "_bin"]).withColumn("rn", inside + F.col("_before")).drop("_bin", "_before")


def speedsort_fit(data: DataFrame, ref_speed: str, target_speed: str, ref_direction: str, target_direction: str, cutoff: float, sectors: int = 12) -> DataFrame:
    """(sector, slope, offset, target_cutoff, n, n_above, veer, n_veer): in each sector of the reference's direction both speeds
    are ranked by themselves and paired by rank; the pairs before the first reference value from the cutoff on are dropped, and
    the line goes through the means of both halves of the rest. Veer is the mean turn of the target where both speeds reach
    half of 6 + half their mean. Numbers are rounded to 5 places."""
    rows = data.dropna(subset=[ref_speed, target_speed, ref_direction]).withColumn("sector", sector(F.col(ref_direction), sectors))
    xs = ranked(rows, "sector", ref_speed).select("sector", F.col(ref_speed).alias("x"), "rn")
    ys = ranked(rows, "sector", target_speed).select("sector", F.col(target_speed).alias("y"), "rn")
    pairs = xs.join(ys, ["sector", "rn"])
    first = pairs.groupBy("sector").agg(F.coalesce(F.min(F.when(F.col("x") >= cutoff, F.col("rn"))), F.lit(1)).alias("first"), F.count(F.lit(1)).alias("n"))
    above = pairs.join(F.broadcast(first), "sector").where("rn >= first").withColumn("half", F.floor((F.col("n") - F.col("first") + 1) / 2)).withColumn("at", F.col("rn") - F.col("first"))
    lower = F.col("at") < F.col("half")
    means = above.groupBy("sector").agg(*[F.avg(F.when(part, F.col(c))).alias(f"{c}{i}") for i, part in ((1, lower), (2, ~lower)) for c in ("x", "y")], F.min("y").alias("target_cutoff"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_above"))
    slope = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    fits = means.select("sector", slope.alias("slope"), (F.col("y1") - slope * F.col("x1")).alias("offset"), "target_cutoff", "n", "n_above")
    limits = rows.agg(*[(0.5 * (6 + 0.5 * F.avg(c))).alias(f"_{i}") for i, c in enumerate((ref_speed, target_speed))])
    fast = rows.where(F.col(target_direction).isNotNull()).crossJoin(F.broadcast(limits)).where((F.col(ref_speed) >= F.col("_0")) & (F.col(target_speed) >= F.col("_1")))
    veers = fast.groupBy("sector").agg(F.avg(veer(F.col(ref_direction), F.col(target_direction))).alias("veer"), F.count(F.lit(1)).alias("n_veer"))
    out = fits.join(veers, "sector", "left")
    return out.select("sector", *[F.round(c, 5).alias(c) for c in ("slope", "offset", "target_cutoff")], "n", "n_above", F.round("veer", 5).alias("veer"), F.coalesce("n_veer", F.lit(0)).alias("n_veer"))


def speedsort_predict(data: DataFrame, params: DataFrame, speed: str, direction: str, cutoff: float, sectors: int = 12, name: str = "predicted") -> DataFrame:
    """Below the cutoff a line through zero, above it the sector's line; null in sectors without a fit."""
    p = params.select("sector", F.col("slope").alias("_s"), F.col("offset").alias("_o"))
    out = data.withColumn("sector", sector(F.col(direction), sectors)).join(F.broadcast(p), "sector", "left")
    x = F.col(speed)
    low = (F.col("_s") * cutoff + F.col("_o")) * x / cutoff
    return out.withColumn(name, F.when(x < cutoff, low).otherwise(F.col("_s") * x + F.col("_o"))).drop("_s", "_o", "sector")


def predict_direction(data: DataFrame, params: DataFrame, direction: str, sectors: int = 12, name: str = "predicted_direction") -> DataFrame:
    """The direction turned by the veer, interpolated between the middles of neighbouring sectors. Where only one of two
    neighbours has a veer, it holds in its own half; where neither has, there is none. The knots are one row per sector."""
    width = 360 / sectors
    p = params.select("sector", "veer")
    left = data.sparkSession.range(sectors).select(F.col("id").cast("int").alias("_i"))
    knots = left.join(p.select((F.col("sector") - 1).alias("_i"), F.col("veer").alias("_a")), "_i", "left")
    knots = knots.join(p.select(F.pmod(F.col("sector") - 2, F.lit(sectors)).alias("_i"), F.col("veer").alias("_b")), "_i", "left")
    out = data.withColumn("_i", F.floor(F.pmod(F.col(direction), F.lit(360.0)) / width).cast("int")).join(F.broadcast(knots), "_i", "left")
    t = F.pmod(F.col(direction), F.lit(360.0)) / width - F.col("_i")
    turn = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("_a") + (F.col("_b") - F.col("_a")) * t)
    turn = turn.when(F.col("_a").isNotNull() & (t < 0.5), F.col("_a")).when(F.col("_b").isNotNull() & (t >= 0.5), F.col("_b"))
    return out.withColumn(name, wrap(F.col(direction) + turn)).drop("_i", "_a", "_b")


def overall_veer(data: DataFrame, ref_speed: str, target_speed: str, ref_direction: str, target_direction: str) -> DataFrame:
    """(veer) over all rows in which both speeds reach their veer cutoff."""
    limits = data.agg(*[(0.5 * (6 + 0.5 * F.avg(c))).alias(f"_{i}") for i, c in enumerate((ref_speed, target_speed))])
    fast = data.crossJoin(F.broadcast(limits)).where((F.col(ref_speed) >= F.col("_0")) & (F.col(target_speed) >= F.col("_1")))
    return fast.agg(F.round(F.avg(veer(F.col(ref_direction), F.col(target_direction))), 5).alias("veer"))


def adjust_low_reference(data: DataFrame, turn: float, ref_speed: str, target_speed: str, ref_direction: str, target_direction: str) -> DataFrame:
    """Where the reference is under 2 and the target over it by more than 4, take the target's direction less the overall veer."""
    low = (F.col(ref_speed) < 2) & (F.col(target_speed) > F.col(ref_speed) + 4)
    return data.withColumn(ref_direction, F.when(low, wrap(F.col(target_direction) - turn)).otherwise(F.col(ref_direction)))


def speedsort_prepare(data: DataFrame, ref_speed: str, target_speed: str, ref_direction: str, target_direction: str, calms: bool = True, seed: int = 0, ts: str = "ts") -> DataFrame:
    """Merged data as SpeedSort fits it: directions of calms are drawn (unless `calms` is false), then the reference's direction is taken from the
    target, less the overall veer, where the reference is low and the target is not."""
    if calms:
        data = randomize_calms(randomize_calms(data, ref_speed, ref_direction, seed=seed, ts=ts), target_speed, target_direction, seed=seed + 1, ts=ts)
    turn = overall_veer(data, ref_speed, target_speed, ref_direction, target_direction).first()["veer"]  # one number
    return data if turn is None else adjust_low_reference(data, turn, ref_speed, target_speed, ref_direction, target_direction)


def speedsort(ref: DataFrame, target: DataFrame, ref_speed: str, ref_direction: str, target_speed: str, target_direction: str, period: str, threshold: float | None = 0.9, sectors: int = 12, long_term: float | None = None, calms: bool = True, seed: int = 0, ts: str = "ts", ref_method: Aggregate = "mean", target_method: Aggregate = "mean") -> tuple[DataFrame, float]:
    """(parameters, cutoff): both sides averaged and merged by period, prepared and fitted. The cutoff follows from the reference's long-term mean:
    `long_term`, or the mean of monthly means of the merged reference. Names of the columns of both sides must differ."""
    dirs = (ref_direction,), (target_direction,)
    merged = merge_by_period(ref.select(ts, ref_speed, ref_direction), target.select(ts, target_speed, target_direction), period, *dirs, ref_method, target_method, threshold, threshold, ts=ts)
    mean = long_term if long_term is not None else momm(merged.select(ts, ref_speed), [ref_speed], ts=ts).first()["momm"]
    cutoff = speedsort_cutoff(mean)
    prepared = speedsort_prepare(merged, ref_speed, target_speed, ref_direction, target_direction, calms, seed, ts)
    return speedsort_fit(prepared, ref_speed, target_speed, ref_direction, target_direction, cutoff, sectors), cutoff


def speedsort_synthesize(ref: DataFrame, target: DataFrame, params: DataFrame, ref_speed: str, ref_direction: str, target_speed: str, target_direction: str, cutoff: float, sectors: int = 12, ts: str = "ts", period: str | None = None, threshold: float | None = None) -> DataFrame:
    """(ts, <speed>_Synthesized, <direction>_Synthesized): the target where it has values, else the prediction; no speed under 0. With a period both sides are averaged first,
    directions as vectors, in bins counted from the start of their overlap."""
    if period is not None:
        start = overlap_start(ref, target, period, ts)
        average = lambda df, speed, direction: average_by_period(df.select(ts, speed, direction), period, [speed, direction], (direction,), coverage_threshold=threshold, origin=start, fill=False, ts=ts)
        ref, target = average(ref, ref_speed, ref_direction), average(target, target_speed, target_direction)
    p = predict_direction(speedsort_predict(ref, params, ref_speed, ref_direction, cutoff, sectors), params, ref_direction, sectors)
    both = target.select(ts, target_speed, target_direction).join(p.select(ts, "predicted", "predicted_direction"), ts, "full")
    speed = F.coalesce(target_speed, "predicted")
    return both.select(ts, F.when(speed < 0, 0.0).otherwise(speed).alias(f"{target_speed}_Synthesized"), F.coalesce(target_direction, "predicted_direction").alias(f"{target_direction}_Synthesized"))


def randomize_calms(data: DataFrame, speed: str, direction: str, below: float = 1.0, seed: int = 0, ts: str = "ts") -> DataFrame:
    """A direction drawn evenly for rows with speed under `below`, from a digest of timestamp and seed, so that reruns agree."""
    drawn = F.pmod(F.xxhash64(F.col(ts), F.lit(seed)), F.lit(36000)) / 100
    return data.withColumn(direction, F.when(F.col(speed) < below, drawn).otherwise(F.col(direction)))
