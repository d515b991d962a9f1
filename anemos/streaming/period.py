"""Period averages of a stream: fixed-length bins anchored at a given origin, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anemos.functions.aggs import Aggregate, aggregate
from anemos.functions.scalar import circular_mean


def stream_average(stream: DataFrame, length: str, columns: list[str], points: int, directions: tuple[str, ...] = (), method: Aggregate = "mean", delay: str = "1 hour", start: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """(ts, columns, <column>_coverage) of windows of `length` (such as "10 minutes"), anchored `start` after the epoch; `points`
    is how many rows a full window has, as a stream can't tell its resolution. Rows later than `delay` are left out."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    aggs = []
    for c in columns:
        aggs.append((circular_mean(F.col(c)) if c in directions and method == "mean" else aggregate(method, F.col(c))).alias(c))
        aggs.append((F.count(c) / F.lit(points)).alias(f"{c}_coverage"))
    out = stamped.groupBy(F.window(ts, length, length, start).alias("w")).agg(*aggs)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias(ts), *[x for c in columns for x in (c, f"{c}_coverage")])
