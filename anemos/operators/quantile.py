"""Exact quantiles of all groups at once by distributed selection: no buffer holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cuts of a group's values in one pass, and the distinct values that a last window may sort in a group.
CUTS, MOST = 512, 100_000
#: Rows of cuts that are broadcast (each holds CUTS doubles); more are joined by a shuffle.
BROADCAST = 2_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _place(cuts: Column, value: Column) -> Column:
    """How many cuts are at most value, less one: by halving, nine looks for 512 cuts."""
    steps = F.array(*[F.lit(CUTS >> i) for i in range(1, CUTS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step) <= value, at + step).otherwise(at))


def group_quantiles(df: DataFrame, keys: list[str], column: str | Column, quantiles: dict[str, float], most: int = MOST) -> DataFrame:
    """(keys, one column for each of `quantiles`: name -> share from 0 to 1): exact, interpolated between the two nearest values. Nulls don't count; a group
    without values has no row. Null keys are a group.

    Values are counted with partial sums first. While the values that can still be an answer are more than `most` distinct ones in any group, each group's are cut at CUTS sample
    quantiles (whose sketch has a fixed size), counted by cut, and only those of the cuts in which a wanted rank lies stay: a pass cuts them by CUTS. So what a buffer, a window or a task's group
    holds is bounded by CUTS and `most`, not by rows; a group of 10^10 rows takes three passes, each over a 512th of the one before."""
    value = F.col(column) if isinstance(column, str) else column
    names = list(quantiles)
    if any(not 0 <= q <= 1 for q in quantiles.values()):
        raise ValueError("quantiles are shares from 0 to 1")
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(key.alias("g"), value.cast("double").alias("v")).where(F.col("v").isNotNull()).groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    sizes = rows.groupBy("g").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("distinct"))
    h = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(quantiles[x])) for x in names]), F.col("q") + 1)
    asked = sizes.select("g", "n", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("q")).withColumn("h", h)
    ranks = asked.select("g", "q", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), at.cast("long").alias("k")) for s, at in ((0, F.floor("h")), (1, F.ceil("h")))])).alias("r"))
    targets = ranks.select(F.struct("g", "q", "r.side").alias("t"), "g", F.col("r.k").alias("k"))
    found = _select(rows, targets, sizes.agg(F.max("distinct")).first()[0] or 0, most)
    low = F.max(F.when(F.col("t.side") == 0, F.col("v")))
    high = F.max(F.when(F.col("t.side") == 1, F.col("v")))
    both = found.groupBy("t.g", "t.q").agg(low.alias("low"), high.alias("high"))
    between = both.join(asked, [both["g"].eqNullSafe(asked["g"]), both["q"] == asked["q"]]).select(both["g"].alias("g"), both["q"].alias("q"), (F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h"))).alias("v"))
    out = between.groupBy("g").agg(*[F.max(F.when(F.col("q") == i, F.col("v"))).alias(x) for i, x in enumerate(names)])
    return out.select(*[F.col(f"g.{k}").alias(k) for k in keys], *names)


def _select(rows: DataFrame, targets: DataFrame, distinct: int, most: int) -> DataFrame:
    """(t, v): of rows (g, v distinct in g, w) the value at rank k of each target (t, g, k)."""
    if distinct <= most:
        last = F.sum("w").over(W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        run = rows.withColumn("last", last)
        hit = (F.col("k") < F.col("last")) & (F.col("k") >= F.col("last") - F.col("w"))
        return run.join(_small(targets.withColumnRenamed("g", "__g")), F.col("g").eqNullSafe(F.col("__g")) & hit).select("t", "v")
    cuts = rows.groupBy("g").agg(F.percentile_approx("v", [i / CUTS for i in range(CUTS)], 10_000).alias("cuts")).withColumnRenamed("g", "__g")
    cut = rows.join(_small(cuts), F.col("g").eqNullSafe(F.col("__g"))).drop("__g").withColumn("c", _place(F.col("cuts"), F.col("v"))).drop("cuts")
    counts = cut.groupBy("g", "c").agg(F.sum("w").alias("w"))
    last = F.sum("w").over(W.partitionBy("g").orderBy("c").rowsBetween(W.unboundedPreceding, 0))  # at most CUTS rows a group
    run = counts.withColumn("last", last)
    inside = (F.col("k") < F.col("last")) & (F.col("k") >= F.col("last") - F.col("w"))
    chosen = run.join(_small(targets.withColumnRenamed("g", "__g")), F.col("g").eqNullSafe(F.col("__g")) & inside).select("t", F.col("g").alias("__g"), F.col("c").alias("__c"), (F.col("k") - F.col("last") + F.col("w")).alias("k"))
    left = cut.join(_small(chosen.drop("k")), F.col("g").eqNullSafe(F.col("__g")) & (F.col("c") == F.col("__c"))).select(F.col("t").alias("g"), "v", "w")
    now = left.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    if now >= distinct:  # cuts could not part the values
        most = now
    return _select(left, chosen.select("t", F.col("t").alias("g"), "k"), now, most)
