"""Wind shear: power and log law fits as closed forms over the logarithms of the heights, and their application."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anemos.functions.bins import sector, sectors_table
from anemos.functions.scalar import log_scale, power_scale
from anemos.operators.dist import table_12x24
from anemos.operators.record import FitRecord, all_of, needed, watched

POWER, LOG = "power_law", "log_law"


def _check(speeds: list[str], heights: list[float], method: str) -> None:
    if len(speeds) != len(heights) or len(speeds) < 2:
        raise ValueError("as many heights as speeds are needed, two at least")
    if method not in (POWER, LOG):
        raise ValueError(f"method must be {POWER} or {LOG}")


def valid(df: DataFrame, speeds: list[str], min_speed: float, record: FitRecord | None = None, **inputs) -> DataFrame:
    """Rows in which every speed exceeds min_speed; a record is told of all rows in the same pass."""
    ok = all_of([F.col(s) > min_speed for s in speeds])
    return watched(record, df, ok, speeds, min_speed=min_speed, **inputs).where(ok)


def _none(min_speed: float) -> str:
    return f"there is no valid data above {min_speed} m/s to fit the shear to"


def slope_intercept(y: list[Column], heights: list[float]) -> tuple[Column, Column]:
    """Least squares of y on the logarithm of the height, as a weighted sum of the columns."""
    x = [math.log(h) for h in heights]
    mean = sum(x) / len(x)
    spread = sum((v - mean) ** 2 for v in x)
    slope = reduce(lambda a, b: a + b, [F.lit((v - mean) / spread) * c for v, c in zip(x, y)])
    return slope, reduce(lambda a, b: a + b, y) / len(y) - slope * mean


def alpha(speeds: list[Column], heights: list[float]) -> Column:
    return slope_intercept([F.ln(s) for s in speeds], heights)[0]


def coefficient(speeds: list[Column], heights: list[float]) -> Column:
    return F.exp(slope_intercept([F.ln(s) for s in speeds], heights)[1])


def roughness(speeds: list[Column], heights: list[float]) -> Column:
    slope, intercept = slope_intercept(speeds, heights)
    return F.exp(-F.try_divide(intercept, slope))


def fit(speeds: list[Column], heights: list[float], method: str) -> Column:
    return alpha(speeds, heights) if method == POWER else roughness(speeds, heights)


def rescale(u: Column, z1: float, z2: float, value: Column | float, method: str) -> Column:
    return power_scale(u, z1, z2, value) if method == POWER else log_scale(u, z1, z2, value)


def average(df: DataFrame, speeds: list[str], heights: list[float], min_speed: float = 3, method: str = POWER, record: FitRecord | None = None) -> DataFrame:
    """One row (value, slope, intercept, n): the fit on mean speeds; value is alpha or the roughness length. Without a valid row it is an error, when the row is read."""
    _check(speeds, heights, method)
    means = valid(df, speeds, min_speed, record, heights=heights, method=method).agg(*[F.avg(s).alias(s) for s in speeds], F.count(F.lit(1)).alias("n"))
    cols = [F.col(s) for s in speeds]
    slope, intercept = slope_intercept([F.ln(c) for c in cols] if method == POWER else cols, heights)
    return means.select(needed(F.col("n"), fit(cols, heights, method), _none(min_speed)).alias("value"), slope.alias("slope"), intercept.alias("intercept"), "n")


def by_sector(df: DataFrame, speeds: list[str], heights: list[float], direction: str, min_speed: float = 3, method: str = POWER, sectors: int = 12, edges: list[float] | None = None, record: FitRecord | None = None) -> DataFrame:
    """(sector, value, n) of every sector; null where there are no rows. Without any valid row it is an error."""
    _check(speeds, heights, method)
    rows = valid(df, speeds, min_speed, record, heights=heights, method=method, direction=direction, sectors=sectors, direction_bins=edges).where(F.col(direction).isNotNull()).withColumn("sector", sector(F.col(direction), sectors, edges))
    means = rows.groupBy("sector").agg(*[F.avg(s).alias(s) for s in speeds], F.count(F.lit(1)).alias("n"))
    dim = sectors_table(df.sparkSession, sectors, edges).select("sector")
    every = dim.join(means, "sector", "left").withColumn("all_n", F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy()))  # a row a sector
    return every.select("sector", needed(F.col("all_n"), fit([F.col(s) for s in speeds], heights, method), _none(min_speed)).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


def time_of_day(df: DataFrame, speeds: list[str], heights: list[float], min_speed: float = 3, method: str = POWER, by_month: bool = True, segments: int = 24, start: int = 7, ts: str = "ts", record: FitRecord | None = None) -> DataFrame:
    """(segment, month, value): a fit for each segment of the day (numbered from `start` o'clock) and calendar month; without
    by_month the months' values are averaged and the column month is left out."""
    _check(speeds, heights, method)
    if 24 % segments or not 0 <= start < 24:
        raise ValueError("24 must be a multiple of segments, and start an hour of the day")
    at = F.floor(F.pmod(F.hour(ts) - start, F.lit(24)) / F.lit(24 // segments)).cast("int")
    means = valid(df, speeds, min_speed, record, heights=heights, method=method, segments_per_day=segments, segment_start_time=start).groupBy(at.alias("segment"), F.month(ts).alias("month")).agg(*[F.avg(s).alias(s) for s in speeds])
    out = means.select("segment", "month", fit([F.col(s) for s in speeds], heights, method).alias("value"))
    return out if by_month else out.groupBy("segment").agg(F.avg("value").alias("value"))


def hours_of(table: DataFrame, segments: int = 24, start: int = 7) -> DataFrame:
    """time_of_day's result by clock hour; one without months holds for all twelve."""
    spark = table.sparkSession
    length = 24 // segments
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"), F.floor(F.pmod(F.col("id") - start, F.lit(24)) / F.lit(length)).cast("int").alias("segment"))
    out = hours.join(table, "segment")
    if "month" not in table.columns:
        out = out.crossJoin(spark.range(1, 13).select(F.col("id").cast("int").alias("month")))
    return out.select("hour", "month", "value")


def by_timestamp(df: DataFrame, speeds: list[str], heights: list[float], min_speed: float = 3, method: str = POWER, name: str = "shear") -> DataFrame:
    """df with the row's own fit; null where a speed is missing or not above min_speed."""
    _check(speeds, heights, method)
    ok = reduce(lambda a, b: a & b, [F.col(s) > min_speed for s in speeds])
    return df.withColumn(name, F.when(ok, fit([F.col(s) for s in speeds], heights, method)))


def table_12x24_of(df: DataFrame, speeds: list[str], heights: list[float], min_speed: float = 3, method: str = POWER, ts: str = "ts") -> DataFrame:
    return table_12x24(by_timestamp(df, speeds, heights, min_speed, method, "_shear"), "_shear", ts=ts)


def apply_average(df: DataFrame, speed: str, z1: float, z2: float, params: DataFrame, method: str = POWER, name: str | None = None) -> DataFrame:
    """df with the speed moved from height z1 to z2 by a one-row result of average."""
    name = name or f"{speed}_scaled_to_{z2:g}m"
    return df.crossJoin(F.broadcast(params.select(F.col("value").alias("_v")))).withColumn(name, rescale(F.col(speed), z1, z2, F.col("_v"), method)).drop("_v")


def apply_by_timestamp(df: DataFrame, speed: str, z1: float, z2: float, shear: str = "shear", method: str = POWER, name: str | None = None) -> DataFrame:
    """df with the speed moved from height z1 to z2 by each row's own value, as by_timestamp gives it; null where the row has none."""
    name = name or f"{speed}_scaled_to_{z2:g}m"
    return df.withColumn(name, rescale(F.col(speed), z1, z2, F.col(shear), method))


def apply_by_sector(df: DataFrame, speed: str, direction: str, z1: float, z2: float, params: DataFrame, method: str = POWER, sectors: int = 12, edges: list[float] | None = None, name: str | None = None) -> DataFrame:
    name = name or f"{speed}_scaled_to_{z2:g}m"
    p = params.select(F.col("sector").alias("_sector"), F.col("value").alias("_v"))
    out = df.withColumn("_sector", sector(F.col(direction), sectors, edges)).join(F.broadcast(p), "_sector", "left")
    return out.withColumn(name, rescale(F.col(speed), z1, z2, F.col("_v"), method)).drop("_sector", "_v")


def apply_time_of_day(df: DataFrame, speed: str, z1: float, z2: float, params: DataFrame, method: str = POWER, segments: int = 24, start: int = 7, ts: str = "ts", name: str | None = None) -> DataFrame:
    name = name or f"{speed}_scaled_to_{z2:g}m"
    p = hours_of(params, segments, start).select(F.col("hour").alias("_h"), F.col("month").alias("_m"), F.col("value").alias("_v"))
    out = df.withColumns({"_h": F.hour(ts), "_m": F.month(ts)}).join(F.broadcast(p), ["_h", "_m"], "left")
    return out.withColumn(name, rescale(F.col(speed), z1, z2, F.col("_v"), method)).drop("_h", "_m", "_v")


def profile(params: DataFrame, method: str = POWER, top: int = 120) -> DataFrame:
    """(height, speed) of average's fitted profile, for 1 m to `top` m."""
    z = F.ln(F.col("height"))
    speed = F.exp(F.col("intercept")) * F.exp(F.col("slope") * z) if method == POWER else F.col("slope") * z + F.col("intercept")
    heights = F.transform(F.sequence(F.lit(1), F.lit(top)), lambda h: h.cast("double"))
    return params.select("slope", "intercept", F.explode(heights).alias("height")).select("height", speed.alias("speed"))


def steps(hours: DataFrame) -> DataFrame:
    """hours_of's result shifted by one hour around the clock, as a step line ending at each hour draws it."""
    return hours.withColumn("hour", F.pmod(F.col("hour") + 1, F.lit(24)))
