"""Writers: CSV and the tab file of a joint frequency table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anemos.operators.dist import table_mean


def write_csv(df: DataFrame, path: str, header: bool = True, **options) -> None:
    """CSV files below path, as many as df has partitions."""
    writer = df.write.mode("overwrite").option("header", header)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.csv(path)


def per_mille(table: DataFrame) -> DataFrame:
    """A frequency table with each sector's column scaled to a sum of 1000; 0 in empty sectors."""
    total = F.sum("value").over(W.partitionBy("sector"))
    return table.withColumn("value", F.coalesce(F.try_divide(F.col("value") * 1000.0, total), F.lit(0.0)))


def tab_text(table: DataFrame, height: float, latitude: float, longitude: float, title: str = "frequency table", offset: float = 0.0, now: datetime | None = None) -> str:
    """Text of a tab file. The table is bounded by bins x sectors, and so is what reaches the driver."""
    mean = table_mean(table).first()[0]
    sums = {r["sector"]: r["total"] for r in table.groupBy("sector").agg(F.sum("value").alias("total")).collect()}
    rows = per_mille(table).orderBy("bin", "sector").collect()
    step = rows[0]["bin_right"] - rows[0]["bin_left"]
    out = [f"{title} created at {(now or datetime.now()):%Y-%m-%d %H:%M:%S}. Mean wind speed: {mean:.3f} m/s.", f"{latitude:.2f} {longitude:.2f} {height:.2f}", f" {len(sums)} {step:.2f} {offset:.2f}", " " + " ".join(f"{sums[k]:.2f}" for k in sorted(sums))]
    by_bin: dict[float, list[str]] = {}
    for r in rows:
        by_bin.setdefault(r["bin_right"], []).append(f"{r['value']:.2f}")
    return "\n".join([*out, *[f"{right:g} {' '.join(values)}" for right, values in sorted(by_bin.items())]]) + "\n"


def write_tab(table: DataFrame, path: str, height: float, latitude: float, longitude: float, **options) -> None:
    """One tab file at path, on whichever file system Spark reads it from."""
    text = tab_text(table, height, latitude, longitude, path.rsplit("/", 1)[-1], **options)
    sc = table.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
