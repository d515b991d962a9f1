"""Tables of plants, stations and sensors from JSON documents such as a metadata service returns. Fetching them is left to the
caller; a document is a file, so a saved answer reads like a live one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLANT = ["name", "uuid", "plant_type_id", "country", "latitude_ddeg", "longitude_ddeg", "elevation_m", "notes", "last_updated"]


def read_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row per object of JSON arrays at path, with the given columns; those an object lacks are null. Columns that end in
    _ddeg or _m are numbers, the rest text."""
    ddl = ", ".join(f"`{c}` {'double' if c.endswith(('_ddeg', '_m')) else 'string'}" for c in columns)
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def plants(spark: SparkSession, path: str, plant_type: str | None = None) -> DataFrame:
    """Plants by name, of one type if given; uuid is renamed to plant_uuid."""
    out = read_json(spark, path, PLANT)
    out = out.where(F.col("plant_type_id") == plant_type) if plant_type else out
    return out.withColumnRenamed("uuid", "plant_uuid").orderBy("name")


def stations(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """Measurement stations by name, of the given types; a ValueError names the types there are if none fits."""
    out = read_json(spark, path, ["name", "uuid", "plant_uuid", "measurement_station_type_id", "latitude_ddeg", "longitude_ddeg"])
    if types:
        found = out.where(F.col("measurement_station_type_id").isin(types))
        if found.isEmpty():
            known = [r[0] for r in out.select("measurement_station_type_id").distinct().orderBy("measurement_station_type_id").limit(100).collect()]
            raise ValueError(f"no station of type {types}; there are {known}")
        out = found
    return out.withColumnRenamed("uuid", "measurement_station_uuid").orderBy("name")


def start_end(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(start_date, end_date)."""
    return df.agg(F.min(ts).alias("start_date"), F.max(ts).alias("end_date"))


def sensor_table(points: DataFrame, configs: DataFrame, key: str = "uuid", measurement_type: str | None = None) -> DataFrame:
    """Measurement points with their configurations, where they have any, by name and date_from; the date is given by day."""
    rows = points.where(F.col("measurement_type_id") == measurement_type) if measurement_type else points
    out = rows.join(configs, key, "left").orderBy("name", "date_from")
    return out.withColumn("date_from", F.date_format("date_from", "yyyy-MM-dd"))
