"""Periods, their bins, the resolution of a signal, and gaps."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MINUTE = 60 * 1_000_000
HOUR, DAY = 60 * MINUTE, 1440 * MINUTE


@dataclass(frozen=True)
class Period:
    """A calendar length in months or a fixed one in microseconds; one of the two is 0."""

    months: int = 0
    micros: int = 0

    @staticmethod
    def parse(text: str | Period) -> Period:
        if isinstance(text, Period):
            return text
        m = re.fullmatch(r"(\d*)\s*(min|T|S|H|h|D|W|MS|M|AS|A|YS|Y)", text.strip())
        if not m:
            raise ValueError(f"period {text!r} isn't one of min, T, S, H, D, W, M, MS, A, AS with a number before it")
        n, unit = int(m[1] or 1), m[2]
        if unit in ("M", "MS"):
            return Period(months=n)
        if unit in ("A", "AS", "Y", "YS"):
            return Period(months=12 * n)
        return Period(micros=n * {"S": MINUTE // 60, "min": MINUTE, "T": MINUTE, "H": HOUR, "h": HOUR, "D": DAY, "W": 7 * DAY}[unit])

    def shorter_than(self, other: Period) -> bool:
        return self.months * 30.4 * DAY + self.micros < other.months * 28 * DAY + other.micros


def ntz(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def shift(ts: Column, period: Period, times: Column | int = 1) -> Column:
    """ts plus `times` periods; days past a month's end are cut to its end."""
    times = F.lit(times) if isinstance(times, int) else times
    unit, n = ("MONTH", period.months) if period.months else ("MICROSECOND", period.micros)
    return F.timestamp_add(unit, (times * n).cast("long"), ts)


def micros_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def bounds(df: DataFrame, ts: str = "ts") -> tuple[datetime | None, datetime | None]:
    row = df.agg(F.min(ts), F.max(ts)).first()
    return row[0], row[1]


def floor_origin(first: datetime, period: Period) -> datetime:
    """Where the bins of data that start at `first` are anchored: its midnight, month or year."""
    if not period.months:
        return first.replace(hour=0, minute=0, second=0, microsecond=0)
    return datetime(first.year, 1 if period.months % 12 == 0 else first.month, 1)


def bin_start(ts: Column, period: Period, origin: datetime) -> Column:
    """Start of the period of ts, closed on the left, counted from origin."""
    if not period.months:
        steps = F.floor(micros_between(F.lit(origin).cast("timestamp_ntz"), ts) / F.lit(period.micros))
        return ntz(F.timestamp_add("MICROSECOND", steps * F.lit(period.micros), F.lit(origin).cast("timestamp_ntz")))
    first = origin.year * 12 + origin.month - 1
    month = (F.year(ts) * 12 + F.month(ts) - 1 - F.lit(first)).cast("int")
    start = F.lit(first) + month - F.pmod(month, F.lit(period.months))
    return ntz(F.make_date(F.floor(start / 12).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1)))


def expected_points(start: Column, period: Period, resolution: Period) -> Column:
    """Length of the bin over the resolution's length at the bin's start; both by the calendar."""
    return micros_between(start, shift(start, period)) / micros_between(start, shift(start, resolution))


def spine(df: DataFrame, column: str, period: Period) -> DataFrame:
    """Every bin from the first to the last of df[column]."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a IS NOT NULL")
    n = (F.floor(F.months_between("b", "a") + 0.5) / period.months if period.months else micros_between(F.col("a"), F.col("b")) / period.micros).cast("int")
    return ends.select("a", F.explode(F.sequence(F.lit(0), n)).alias("i")).select(ntz(shift(F.col("a"), period, F.col("i"))).alias(column))


def previous(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(ts, prev) of distinct timestamps. Sorted within days; a day's first row takes the last of the day before that has data,
    so nothing but one row a day is sorted in one place."""
    days = df.where(F.col(ts).isNotNull()).select(F.col(ts).alias("ts")).distinct().withColumn("day", F.to_date("ts"))
    ends = days.groupBy("day").agg(F.max("ts").alias("last"))
    before = ends.select("day", F.lag("last").over(W.orderBy("day")).alias("before"))
    inside = F.lag("ts").over(W.partitionBy("day").orderBy("ts"))
    return days.withColumn("inside", inside).join(before, "day").select("ts", F.coalesce("inside", "before").alias("prev"))


def step_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(step in microseconds, count) of neighbouring timestamps."""
    return previous(df, ts).where("prev IS NOT NULL").groupBy(micros_between(F.col("prev"), F.col("ts")).alias("step")).agg(F.count(F.lit(1)).alias("n"))


def resolution(df: DataFrame, ts: str = "ts") -> Period:
    """The most frequent step, the smallest of equals; 28 to 31 days count as a month and 365 or 366 as a year."""
    top = step_counts(df, ts).orderBy(F.desc("n"), "step").first()
    if top is None:
        raise ValueError("two timestamps at least are needed to tell the resolution")
    return as_period(top["step"])


def as_period(step: int) -> Period:
    if 28 * DAY <= step <= 31 * DAY:
        return Period(months=1)
    if 365 * DAY <= step <= 366 * DAY:
        return Period(months=12)
    return Period(micros=step)


def continuity_gaps(df: DataFrame, ts: str = "ts", columns: list[str] | None = None, every: Period | None = None) -> DataFrame:
    """(date_from, date_to, days_lost) of neighbouring rows whose step isn't the resolution; rows with no value don't count.
    Days lost are the step less one resolution, null if the step is shorter; for monthly data, less the days of the month."""
    columns = [c for c in df.columns if c != ts] if columns is None else columns
    some = df.where(F.coalesce(*[F.col(c) for c in columns]).isNotNull()) if columns else df
    every = every or resolution(some, ts)
    if every.months >= 12:
        raise ValueError("gaps of yearly data are not supported")
    step = micros_between(F.col("prev"), F.col("ts"))
    pairs = previous(some, ts).where("prev IS NOT NULL")
    if every.months:
        month = F.dayofmonth(F.last_day("prev")) * F.lit(DAY)
        gap, less = ~step.between(28 * DAY, 31 * DAY), month
    else:
        gap, less = step != every.micros, F.lit(every.micros)
    return pairs.where(gap).select(F.col("prev").alias("date_from"), F.col("ts").alias("date_to"), F.when(step >= less, (step - less) / DAY).alias("days_lost"))


def slice_data(df: DataFrame, date_from: str | datetime | None = None, date_to: str | datetime | None = None, ts: str = "ts") -> DataFrame:
    """Rows from date_from on and before date_to; where date_to is left out or is the last timestamp, that row stays."""
    a, b = (datetime.fromisoformat(x) if isinstance(x, str) else x for x in (date_from, date_to))
    if a and b and b < a:
        raise ValueError("date_to must be after date_from")
    if a:
        df = df.where(F.col(ts) >= F.lit(a).cast("timestamp_ntz"))
    if b:
        last = bounds(df, ts)[1]
        df = df.where((F.col(ts) <= F.lit(b).cast("timestamp_ntz")) if last == b else (F.col(ts) < F.lit(b).cast("timestamp_ntz")))
    return df
