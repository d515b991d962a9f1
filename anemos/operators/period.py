"""Averages by period with coverage, monthly means, means of monthly means, merging of two data sets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anemos.functions.aggs import EMPTY, Aggregate, aggregate
from anemos.functions.scalar import circular_mean
from anemos.functions.timeaxis import Period, bin_start, bounds, expected_points, floor_origin, ntz, resolution, slice_data, spine


def check_coverage(threshold: float | None) -> float:
    if threshold is None:
        return 0.0
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 <= threshold <= 1:
        raise TypeError("coverage_threshold must be a number from 0 to 1")
    return float(threshold)


def average_by_period(df: DataFrame, period: str | Period, columns: list[str] | None = None, directions: tuple[str, ...] = (), method: Aggregate = "mean", coverage_threshold: float | None = None, return_coverage: bool = False, data_resolution: str | Period | None = None, origin: datetime | None = None, fill: bool = True, ts: str = "ts") -> DataFrame:
    """One row for each period with the aggregate of each column, and <column>_coverage if asked for. Periods start at the
    midnight (month, year) of the first row. Columns in `directions` are averaged as vectors if the method is mean. Values
    whose coverage is under the threshold are null. Periods without rows stay unless fill is off."""
    period, threshold = Period.parse(period), check_coverage(coverage_threshold)
    columns = columns or [c for c in df.columns if c != ts]
    every = Period.parse(data_resolution) if data_resolution is not None else resolution(df, ts)
    if period.shorter_than(every):
        raise ValueError("the period is shorter than the data's resolution")
    origin = origin or floor_origin(bounds(df, ts)[0], period)
    binned = df.where(F.col(ts).isNotNull()).select(bin_start(F.col(ts), period, origin).alias(ts), *columns)
    aggs = []
    for c in columns:
        aggs.append((circular_mean(F.col(c)) if c in directions and method == "mean" else aggregate(method, F.col(c))).alias(c))
        aggs.append(F.count(c).alias(f"_n_{c}"))
    out = binned.groupBy(ts).agg(*aggs)
    if fill:
        out = spine(out.select(ts), ts, period).join(out, ts, "left")
    empty = F.lit(EMPTY[method]) if isinstance(method, str) and method in EMPTY else F.lit(None)
    points = expected_points(F.col(ts), period, every)
    result = [F.col(ts)]
    for c in columns:
        cover = F.coalesce(F.col(f"_n_{c}"), F.lit(0)) / points
        value = F.when(F.col(f"_n_{c}").isNull(), empty).otherwise(F.col(c))
        result.append(F.when(cover >= threshold, value).alias(c))
        if return_coverage:
            result.append(cover.alias(f"{c}_coverage"))
    return out.select(*result)


def coverage(df: DataFrame, period: str | Period = "1M", columns: list[str] | None = None, **options) -> DataFrame:
    columns = columns or [c for c in df.columns if c != options.get("ts", "ts")]
    return average_by_period(df, period, columns, return_coverage=True, **options).select(options.get("ts", "ts"), *[f"{c}_coverage" for c in columns])


def monthly_means(df: DataFrame, columns: list[str] | None = None, return_coverage: bool = False, **options) -> DataFrame:
    return average_by_period(df, "1MS", columns, return_coverage=return_coverage, **options)


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def drop_thin_months(df: DataFrame, columns: list[str], threshold: float, ts: str = "ts", data_resolution: str | Period | None = None) -> DataFrame:
    """Rows without those of year-months in which some column's coverage is above 0 but under the threshold."""
    cover = average_by_period(df, "1M", columns, return_coverage=True, data_resolution=data_resolution, fill=False, ts=ts)
    least = F.least(*[F.col(f"{c}_coverage") for c in columns]) if len(columns) > 1 else F.col(f"{columns[0]}_coverage")
    thin = cover.where((least > 0) & (least < threshold)).select(F.col(ts).alias("_month"))
    month = df.withColumn("_month", ntz(F.date_trunc("month", ts)))
    return month.join(thin, "_month", "left_anti").drop("_month")


def month_weights(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(month, days): mean length of each calendar month over the year-months that occur."""
    months = df.select(ntz(F.date_trunc("month", ts)).alias("m")).distinct()
    return months.groupBy(F.month("m").alias("month")).agg(F.avg(days_in_month(F.col("m"))).alias("days"))


def momm(df: DataFrame, columns: list[str] | None = None, date_from=None, date_to=None, seasonal: bool = False, coverage_threshold: float | None = None, ts: str = "ts") -> DataFrame:
    """(variable, momm): mean over calendar months of the mean of all data of that month; seasonal weighs months by their days
    and needs all twelve."""
    columns = columns or [c for c in df.columns if c != ts]
    df = slice_data(df, date_from, date_to, ts)
    threshold = check_coverage(coverage_threshold)
    out = None
    for c in columns:
        one = df.where(F.col(c).isNotNull()).select(ts, c)
        if threshold:
            one = drop_thin_months(one, [c], threshold, ts)
        months = one.groupBy(F.month(ts).alias("month")).agg(F.avg(c).alias("mean"))
        if seasonal:
            if months.count() < 12:
                raise ValueError("seasonal adjustment needs data of all twelve calendar months")
            months = months.join(month_weights(one, ts), "month")
            value = F.sum(F.col("mean") * F.col("days")) / F.sum("days")
        else:
            value = F.avg("mean")
        row = months.agg(value.alias("momm")).select(F.lit(c).alias("variable"), "momm")
        out = row if out is None else out.unionByName(row)
    return out


def monthly_norms(df: DataFrame, column: str, ref_from=None, ref_to=None, ts: str = "ts") -> DataFrame:
    """(ts, norm): monthly means over the mean of the reference range."""
    ref = slice_data(df, ref_from, ref_to, ts).agg(F.avg(column).alias("_ref"))
    return monthly_means(df.select(ts, column), [column], ts=ts).crossJoin(F.broadcast(ref)).select(ts, F.try_divide(column, "_ref").alias("norm"))


def overlap_start(df_1: DataFrame, df_2: DataFrame, period: str | Period, ts: str = "ts") -> datetime:
    """The period's floor of the later of both starts."""
    (a1, b1), (a2, b2) = bounds(df_1, ts), bounds(df_2, ts)
    if None in (a1, a2) or max(a1, a2) > min(b1, b2):
        raise IndexError("the data sets don't overlap")
    return floor_origin(max(a1, a2), Period.parse(period)) if Period.parse(period).months or Period.parse(period).micros % 86_400_000_000 == 0 else _floor_fixed(max(a1, a2), Period.parse(period))


def _floor_fixed(first: datetime, period: Period) -> datetime:
    from datetime import timedelta

    midnight = first.replace(hour=0, minute=0, second=0, microsecond=0)
    return midnight + timedelta(microseconds=(first - midnight) // timedelta(microseconds=1) // period.micros * period.micros)


def merge_by_period(df_1: DataFrame, df_2: DataFrame, period: str | Period, directions_1: tuple[str, ...] = (), directions_2: tuple[str, ...] = (), method_1: Aggregate = "mean", method_2: Aggregate = "mean", threshold_1: float | None = None, threshold_2: float | None = None, resolution_1=None, resolution_2=None, ts: str = "ts") -> DataFrame:
    """Inner join of both sets' averages from the start of their overlap on, without incomplete rows; columns of set 1, its
    coverages, columns of set 2, its coverages. Names must differ."""
    sides = []
    first, second = df_1.dropna(), df_2.dropna()
    start = overlap_start(first, second, period, ts)
    for df, dirs, method, threshold, every in ((first, directions_1, method_1, threshold_1, resolution_1), (second, directions_2, method_2, threshold_2, resolution_2)):
        every = every if every is not None else resolution(df, ts)
        cut = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
        columns = [c for c in df.columns if c != ts]
        out = average_by_period(cut, period, columns, dirs, method, threshold, True, every, start, fill=False, ts=ts)
        sides.append(out.select(ts, *columns, *[f"{c}_coverage" for c in columns]))
    return sides[0].join(sides[1], ts).dropna()


def offset_timestamps(df: DataFrame, offset: Period | str, date_from: datetime | None = None, date_to: datetime | None = None, overwrite: bool = False, ts: str = "ts") -> DataFrame:
    """Shift the timestamps in [date_from, date_to). Where a shifted row meets another, the shifted one stays if overwrite is
    set, else the other. Without date_to the last row isn't shifted."""
    from anemos.functions.timeaxis import shift

    sign = -1 if isinstance(offset, str) and offset.startswith("-") else 1
    length = Period.parse(offset.lstrip("-")) if isinstance(offset, str) else offset
    low, high = bounds(df, ts)
    a, b = date_from or low, date_to or high
    inside = (F.col(ts) >= F.lit(a).cast("timestamp_ntz")) & (F.col(ts) < F.lit(b).cast("timestamp_ntz"))
    moved = df.where(inside).withColumn(ts, ntz(shift(F.col(ts), length, sign)))
    rest = df.where(~inside)
    if overwrite:
        rest = rest.join(moved.select(ts), ts, "left_anti")
    else:
        moved = moved.join(rest.select(ts), ts, "left_anti")
    return rest.unionByName(moved)
