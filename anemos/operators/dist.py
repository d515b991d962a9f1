"""Distributions, frequency tables, turbulence intensity, sector ratios, statistics. All results are in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anemos.functions.aggs import Aggregate, aggregate
from anemos.functions.bins import SPEED_EDGES, auto_edges, bin_index, bins, dist_edges, sector, sectors_table
from anemos.functions.scalar import clean
from anemos.operators.correl import ranked
from anemos.operators.period import drop_thin_months, month_weights
from anemos.operators.quantile import group_quantiles

PERCENT = "%frequency"


def _range(df: DataFrame, column: str) -> tuple[float, float]:
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        raise ValueError(f"{column} holds no values")
    return float(low), float(high)


def dist(df: DataFrame, column: str, against: str | None = None, edges: list[float] | None = None, method: Aggregate = PERCENT) -> DataFrame:
    """(bin, bin_left, bin_right, value) of every bin of `against` (default: the column itself). The percentage counts all rows
    with a value, those outside the bins too."""
    against = against or column
    rows = df.select(clean(F.col(column).cast("double")).alias("a"), clean(F.col(against).cast("double")).alias("b")).dropna()
    edges = edges or dist_edges(*_range(rows, "b"))
    found = rows.withColumn("bin", bin_index(F.col("b"), edges))
    dim = bins(df.sparkSession, edges)
    if method == PERCENT:
        total = found.agg(F.count(F.lit(1)).alias("total"))
        counts = found.groupBy("bin").agg(F.count("a").alias("n"))
        return dim.join(counts, "bin", "left").crossJoin(F.broadcast(total)).select("bin", "bin_left", "bin_right", (100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("value"))
    values = found.groupBy("bin").agg(aggregate(method, F.col("a")).alias("value"))
    value = F.coalesce("value", F.lit(0)) if method in ("count", "sum") else F.col("value")
    return dim.join(values, "bin", "left").select("bin", "bin_left", "bin_right", value.alias("value"))


def dist_many(df: DataFrame, columns: list[str], edges: list[float], method: Aggregate = PERCENT) -> DataFrame:
    """dist of each column by itself, with its name in `variable`; one pass over the data."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), clean(F.col(c)).alias("a")) for c in columns])).alias("s")).select("s.*").dropna()
    found = long.withColumn("bin", bin_index(F.col("a"), edges))
    dim = bins(df.sparkSession, edges).crossJoin(df.sparkSession.createDataFrame([(c,) for c in columns], "variable string"))
    if method == PERCENT:
        total = found.groupBy("variable").agg(F.count(F.lit(1)).alias("total"))
        value = 100.0 * F.coalesce("n", F.lit(0)) / F.col("total")
        return dim.join(found.groupBy("variable", "bin").agg(F.count("a").alias("n")), ["variable", "bin"], "left").join(total, "variable").select("variable", "bin", "bin_left", "bin_right", value.alias("value"))
    values = found.groupBy("variable", "bin").agg(aggregate(method, F.col("a")).alias("value"))
    return dim.join(values, ["variable", "bin"], "left").select("variable", "bin", "bin_left", "bin_right", "value")


def dist_of_wind_speed(df: DataFrame, column: str, max_speed: int = 30) -> DataFrame:
    return dist(df, column, edges=[i - 0.5 for i in range(max_speed + 2)])


freq_distribution = dist_of_wind_speed


def dist_matrix(df: DataFrame, value: str, x: str, y: str, x_edges: list[float] | None = None, y_edges: list[float] | None = None, x_count: int | None = None, y_count: int | None = None, method: Aggregate = PERCENT) -> DataFrame:
    """(y_bin, x_bin, y_left, x_left, value) of the cells that hold rows; the percentage is of rows inside the bins."""
    rows = df.select(F.col(value).alias("v"), F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    x_edges = x_edges or auto_edges(*_range(rows, "x"), x_count)
    y_edges = y_edges or auto_edges(*_range(rows, "y"), y_count)
    found = rows.withColumns({"x_bin": bin_index(F.col("x"), x_edges), "y_bin": bin_index(F.col("y"), y_edges)}).where("x_bin IS NOT NULL AND y_bin IS NOT NULL")
    cells = found.groupBy("y_bin", "x_bin").agg((F.count("v") if method == PERCENT else aggregate(method, F.col("v"))).alias("value"))
    if method == PERCENT:
        total = cells.agg(F.sum("value").alias("total"))
        cells = cells.crossJoin(F.broadcast(total)).withColumn("value", 100.0 * F.col("value") / F.col("total"))
    left = lambda edges, at: F.element_at(F.array(*[F.lit(float(e)) for e in edges]), at)
    return cells.select("y_bin", "x_bin", left(y_edges, F.col("y_bin")).alias("y_left"), left(x_edges, F.col("x_bin")).alias("x_left"), "value")


def wide(df: DataFrame, row: str, column: str, columns: list, value: str = "value") -> DataFrame:
    """A long result as a matrix with one column for each of `columns`."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value)).orderBy(row)


def by_sector(df: DataFrame, column: str, direction: str, sectors: int = 12, method: Aggregate = PERCENT, edges: list[float] | None = None, fill: float | None = 0.0) -> DataFrame:
    """(sector, sector_label, value) of every sector; sectors without rows hold `fill`."""
    rows = df.select(F.col(column).alias("v"), F.col(direction).alias("d")).dropna().withColumn("sector", sector(F.col("d"), sectors, edges))
    dim = sectors_table(df.sparkSession, sectors, edges).drop("sector_mid")
    if method == PERCENT:
        total = rows.agg(F.count(F.lit(1)).alias("total"))
        values = rows.groupBy("sector").agg(F.count("v").alias("n")).crossJoin(F.broadcast(total)).select("sector", (100.0 * F.col("n") / F.col("total")).alias("value"))
    else:
        values = rows.groupBy("sector").agg(aggregate(method, F.col("v")).alias("value"))
    value = F.col("value") if fill is None else F.coalesce("value", F.lit(fill))
    return dim.join(values, "sector", "left").select("sector", "sector_label", value.alias("value"))


def matrix_by_sector(df: DataFrame, value: str, binned: str, direction: str, edges: list[float], sectors: int = 12, direction_edges: list[float] | None = None, method: Aggregate = "mean", seasonal: bool = False, ts: str = "ts") -> DataFrame:
    """(bin, sector, value) of the cells that hold rows. Percentages are of rows inside the bins. Seasonal: each calendar
    month's value, 0 where the month has none for percentages, weighted by the month's days."""
    rows = df.select(F.col(ts).alias("ts"), F.col(value).alias("v"), F.col(binned).alias("b"), F.col(direction).alias("d")).dropna()
    found = rows.select("ts", "v", bin_index(F.col("b"), edges).alias("bin"), sector(F.col("d"), sectors, direction_edges).alias("sector"), F.month("ts").alias("month")).where("bin IS NOT NULL AND sector IS NOT NULL")
    cell = F.count("v") if method == PERCENT else aggregate(method, F.col("v"))
    if not seasonal:
        cells = found.groupBy("bin", "sector").agg(cell.alias("value"))
        if method == PERCENT:
            cells = cells.crossJoin(F.broadcast(cells.agg(F.sum("value").alias("total")))).withColumn("value", 100.0 * F.col("value") / F.col("total"))
        return cells.select("bin", "sector", "value")
    weights = month_weights(rows)
    if weights.count() < 12:
        raise ValueError("seasonal adjustment needs data of all twelve calendar months")
    cells = found.groupBy("month", "bin", "sector").agg(cell.alias("value"))
    if method == PERCENT:
        totals = cells.groupBy("month").agg(F.sum("value").alias("total"))
        cells = cells.join(totals, "month").withColumn("value", 100.0 * F.col("value") / F.col("total"))
    whole = weights.agg(F.sum("days").alias("all_days"))
    return cells.join(weights, "month").crossJoin(F.broadcast(whole)).groupBy("bin", "sector").agg((F.sum(F.col("value") * F.col("days")) / F.max("all_days")).alias("value"))


def freq_table(df: DataFrame, speed: str, direction: str, edges: list[float] | None = None, sectors: int = 12, direction_edges: list[float] | None = None, percentage: bool = True, seasonal: bool = False, coverage_threshold: float | None = None, target_mean: float | None = None, ts: str = "ts") -> DataFrame:
    """(bin, bin_left, bin_right, sector, value): joint frequencies of speed and direction, every cell. With target_mean, speeds
    are scaled until the table's mean is within 0.01 % of it (or the difference comes back to an earlier one)."""
    edges = edges or SPEED_EDGES
    rows = df.select(F.col(ts).alias("ts"), F.col(speed).alias("speed"), F.col(direction).alias("direction"))
    if coverage_threshold:
        rows = drop_thin_months(rows, ["speed", "direction"], coverage_threshold, "ts")
    rows = rows.dropna()

    def table(factor: float) -> DataFrame:
        scaled = rows.withColumn("speed", F.col("speed") * F.lit(factor)) if factor != 1 else rows
        cells = matrix_by_sector(scaled, "speed", "speed", "direction", edges, sectors, direction_edges, PERCENT if percentage or seasonal else "count", seasonal)
        n = sectors if direction_edges is None else len(direction_edges) - 1
        grid = bins(df.sparkSession, edges).crossJoin(df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("sector")))
        return grid.join(cells, ["bin", "sector"], "left").select("bin", "bin_left", "bin_right", "sector", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))

    if target_mean is None:
        return table(1.0)
    mean, high = rows.agg(F.avg("speed"), F.max("speed")).first()
    factor = target_mean / mean
    if high * factor > edges[-1]:
        raise ValueError("scaled speeds exceed the last edge")
    seen: list[float] = []
    for _ in range(100):
        out = table(factor)
        got = table_mean(out).first()[0]
        apart = round(abs(100 * (target_mean - got) / got), 12)
        if apart <= 0.01 or (apart in seen and apart == min(seen)):
            break
        seen.append(apart)
        factor *= target_mean / got
    return out


def table_mean(table: DataFrame) -> DataFrame:
    """(mean_speed) of a frequency table: bin middles weighted by frequency."""
    mid = (F.col("bin_left") + F.col("bin_right")) / 2
    return table.agg((F.sum(mid * F.col("value")) / F.sum("value")).alias("mean_speed"))


def table_12x24(df: DataFrame, column: str | Column, method: Aggregate = "mean", ts: str = "ts") -> DataFrame:
    """(hour, month, value)."""
    value = F.col(column) if isinstance(column, str) else column
    rows = df.select(F.hour(ts).alias("hour"), F.month(ts).alias("month"), value.alias("v")).where("v IS NOT NULL")
    return rows.groupBy("hour", "month").agg(aggregate(method, F.col("v")).alias("value"))


def turbulence(df: DataFrame, speed: str, std: str, min_speed: float = 3) -> DataFrame:
    """df's rows with both values and speed from min_speed on, with column ti."""
    rows = df.where(F.col(speed).isNotNull() & F.col(std).isNotNull() & (F.col(speed) >= min_speed))
    return rows.withColumn("ti", F.try_divide(std, speed))


def ti_by_speed(df: DataFrame, speed: str, std: str, edges: list[float] | None = None, min_speed: float = 3, percentile: float = 90) -> DataFrame:
    """(bin, bin_mid, mean_ti, ti_count, rep_ti, ti_2sigma, char_ti) of bins in which all are defined; ti_2sigma is one standard
    deviation, and char_ti adds it over the bin's middle to the mean."""
    edges = edges or SPEED_EDGES
    rows = turbulence(df, speed, std, min_speed).withColumn("bin", bin_index(F.col(speed), edges)).where("bin IS NOT NULL")
    t = F.col("ti")
    out = rows.groupBy("bin").agg(F.avg(t).alias("mean_ti"), F.count(t).alias("ti_count"), F.stddev_samp(t).alias("ti_2sigma"))
    out = out.join(F.broadcast(group_quantiles(rows, ["bin"], "ti", {"rep_ti": percentile / 100})), "bin")  # a row a bin
    dim = bins(df.sparkSession, edges).select("bin", ((F.col("bin_left") + F.col("bin_right")) / 2).alias("bin_mid"))
    out = out.join(F.broadcast(dim), "bin").withColumn("char_ti", F.col("mean_ti") + F.try_divide("ti_2sigma", "bin_mid"))
    return out.select("bin", "bin_mid", "mean_ti", "ti_count", "rep_ti", "ti_2sigma", "char_ti").dropna()


def ti_by_sector(df: DataFrame, speed: str, std: str, direction: str, sectors: int = 12, edges: list[float] | None = None, min_speed: float = 3) -> DataFrame:
    """(sector, sector_label, mean_ti, ti_count)."""
    rows = turbulence(df, speed, std, min_speed).where(F.col(direction).isNotNull()).withColumn("sector", sector(F.col(direction), sectors, edges))
    found = rows.groupBy("sector").agg(F.avg("ti").alias("mean_ti"), F.count("ti").alias("ti_count"))
    dim = sectors_table(df.sparkSession, sectors, edges).drop("sector_mid")
    return dim.join(found, "sector", "left").select("sector", "sector_label", F.coalesce("mean_ti", F.lit(0.0)).alias("mean_ti"), F.coalesce("ti_count", F.lit(0)).alias("ti_count"))


def ti_12x24(df: DataFrame, speed: str, std: str, min_speed: float = 3, ts: str = "ts") -> DataFrame:
    return table_12x24(turbulence(df, speed, std, min_speed), "ti", ts=ts)


def speed_ratio(a: Column, b: Column, low: float = 3, high: float = 50) -> Column:
    """b / a where both lie in [low, high)."""
    return F.when((a >= low) & (a < high) & (b >= low) & (b < high), F.try_divide(b, a))


def sector_ratio(df: DataFrame, pairs: list[tuple[str, str]], directions: list[str] | str, sectors: int = 72, min_speed: float = 3, edges: list[float] | None = None) -> DataFrame:
    """(pair, sector, value): mean ratio of the second speed to the first by sector, 0 where there is none; one direction for
    all pairs or one for each. One pass for all pairs."""
    directions = [directions] * len(pairs) if isinstance(directions, str) else directions
    each = [F.struct(F.lit(i).alias("pair"), speed_ratio(F.col(a), F.col(b), min_speed).alias("ratio"), sector(F.col(d), sectors, edges).alias("sector")) for i, ((a, b), d) in enumerate(zip(pairs, directions))]
    long = df.select(F.explode(F.array(*each)).alias("s")).select("s.*").dropna()
    found = long.groupBy("pair", "sector").agg(F.avg("ratio").alias("value"))
    dim = sectors_table(df.sparkSession, sectors, edges).select("sector").crossJoin(df.sparkSession.createDataFrame([(i,) for i in range(len(pairs))], "pair int"))
    return dim.join(found, ["pair", "sector"], "left").select("pair", "sector", F.coalesce("value", F.lit(0.0)).alias("value"))


def basic_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, count, mean, std, min, max) of numbers."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    return long.groupBy("variable").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def text_stats(df: DataFrame, column: str) -> DataFrame:
    """(variable, count, unique, top, freq) of a column of strings; top is the least of the most frequent."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(-F.col("n"), F.col(column)))
    return counts.agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.getField(column).alias("top"), F.max("n").alias("freq")).select(F.lit(column).alias("variable"), "count", "unique", "top", "freq")


def plot_bins(table: DataFrame, edges: list[float]) -> DataFrame:
    """(plot_bin, sector, value): a frequency table's bins summed into wider ones that overlap them."""
    wider = bins(table.sparkSession, edges, "plot_bin")
    hit = (F.col("bin_left") < F.col("plot_bin_right")) & (F.col("bin_right") > F.col("plot_bin_left"))
    return table.join(F.broadcast(wider), hit).groupBy("plot_bin", "sector").agg(F.sum("value").alias("value"))


def iec_curves(spark) -> DataFrame:
    """(speed, class_a, class_b, class_c): reference turbulence of the design classes for 1 to 25 m/s."""
    v = F.col("id").cast("double")
    return spark.range(1, 26).select(v.alias("speed"), *[(F.lit(i) * (F.lit(0.75) + F.lit(5.6) / v)).alias(f"class_{n}") for n, i in (("a", 0.16), ("b", 0.14), ("c", 0.12))])


def scatter_by_sector(df: DataFrame, x: str, y: str, direction: str, sectors: int = 12, sort_inputs: bool = False) -> DataFrame:
    """(sector, x, y) of rows with all three; sort_inputs pairs the values of each sector by rank instead of by row."""
    rows = df.select(sector(F.col(direction), sectors).alias("sector"), F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    if not sort_inputs:
        return rows
    xs, ys = ranked(rows, "sector", "x").select("sector", "x", "rn"), ranked(rows, "sector", "y").select("sector", "y", "rn")
    return xs.join(ys, ["sector", "rn"]).select("sector", "x", "y")
