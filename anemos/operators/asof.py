"""As-of joins: to each row the nearest row of another table in time, before it, after it, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str] = (), direction: str = "backward", within: str | None = None, columns: list[str] | None = None, bucket: str = "day", ts: str = "ts", suffix: str = "_right") -> DataFrame:
    """left's rows, each with the columns of the row of right that has the same `by` and the nearest ts at or before it (backward), at or after it (forward), or the nearer of
    both (nearest; of two as near the one before); nulls where there is none, or none `within` an interval such as "1 hour". Of right's rows of one time the one with the greatest columns, in order,
    counts. Right's ts comes as ts + suffix, and so do its columns whose names left has.

    Both sides are put together and sorted within buckets of time (`bucket`: a unit of date_trunc) and key; the last right row of each bucket, found with partial aggregates, is carried over the buckets
    after it. So no window sees more than one key's bucket, or one row for each of a key's buckets. Rows without ts or with a null key get nulls."""
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("direction is backward, forward or nearest")
    by = list(by)
    columns = [c for c in right.columns if c not in (ts, *by)] if columns is None else columns
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(by)]
    names = [f"k{i}" for i in range(len(by))]
    edge = F.date_trunc(bucket, F.col(ts)).cast("timestamp_ntz").alias("b")
    known = F.col(ts).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    payload = F.struct(F.col(ts).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    r = right.where(known).select(*keys, edge, F.col(ts).alias("t"), payload.alias("r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("l"))
    lefts = left.where(known).select(*keys, edge, F.col(ts).alias("t"), F.lit(None).cast(r.schema["r"].dataType).alias("r"), F.struct(*[F.col(c) for c in left.columns]).alias("l"))
    both = r.unionByName(lefts)

    def nearest(after: bool) -> Column:
        order = [F.col("t").desc() if after else F.col("t").asc(), F.col("l").isNotNull(), F.col("r").asc()]
        return F.last("r", ignorenulls=True).over(W.partitionBy(*names, "b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))

    def carried(after: bool) -> DataFrame:
        ends = _firsts(both, names) if after else both.groupBy(*names, "b").agg(F.max("r").alias("end"))
        order = F.col("b").desc() if after else F.col("b").asc()
        last = F.last("end", ignorenulls=True).over(W.partitionBy(*names).orderBy(order).rowsBetween(W.unboundedPreceding, -1))  # a row a bucket
        return ends.select(*names, "b", last.alias("after" if after else "before"))

    sides = {"backward": [False], "forward": [True], "nearest": [False, True]}[direction]
    rows = both
    for after in sides:
        name = "after" if after else "before"
        rows = rows.withColumn(f"in_{name}", nearest(after))
    rows = rows.where(F.col("l").isNotNull())
    for after in sides:
        name = "after" if after else "before"
        rows = rows.join(carried(after), [*names, "b"], "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", name)).drop(name)
    if len(sides) == 2:
        gap = lambda a, b: F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))
        later = F.col("in_before").isNull() | (gap("in_after.t", "t") < gap("t", "in_before.t"))
        rows = rows.withColumn("hit", F.when(F.coalesce(later, F.lit(False)) & F.col("in_after").isNotNull(), F.col("in_after")).otherwise(F.col("in_before")))
    else:
        rows = rows.withColumn("hit", F.col("in_after" if sides[0] else "in_before"))
    if within:
        near = F.col("hit.t").between(F.col("t") - F.expr(f"INTERVAL {within}"), F.col("t") + F.expr(f"INTERVAL {within}"))
        rows = rows.withColumn("hit", F.when(near, F.col("hit")))
    shown = [F.col("hit.t").alias(ts + suffix), *[F.col(f"hit.c{i}").alias(c + suffix if c in left.columns else c) for i, c in enumerate(columns)]]
    out = rows.select("l.*", *shown)
    bare = left.where(~known).select("*", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns[len(left.columns) :]])
    return out.unionByName(bare)


def _firsts(both: DataFrame, names: list[str]) -> DataFrame:
    """Of each bucket the right row of the first time, of several the one with the greatest columns."""
    first = both.groupBy(*names, "b").agg(F.min(F.when(F.col("r").isNotNull(), F.col("t"))).alias("f"))
    tied = both.join(first, [*names, "b"]).groupBy(*names, "b").agg(F.max(F.when(F.col("t") == F.col("f"), F.col("r"))).alias("end"))
    return tied
