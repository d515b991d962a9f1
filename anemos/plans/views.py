"""Met-like views of the star-schema tables, in Spark and as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CTE = {
    "met_events": """SELECT ts, least(value*0.08::DOUBLE, 40::DOUBLE) AS spd80, least(value*0.08::DOUBLE, 40::DOUBLE)*(0.90::DOUBLE + k*0.0005::DOUBLE) AS spd60,
  least(value*0.08::DOUBLE, 40::DOUBLE)*(0.80::DOUBLE + k*0.0005::DOUBLE) AS spd40, least(value*0.08::DOUBLE, 40::DOUBLE)*(0.05::DOUBLE + k*0.001::DOUBLE) AS spd80_std,
  (user_id*2.4::DOUBLE + k*3.6::DOUBLE) % 360::DOUBLE AS dir, k*0.4::DOUBLE - 10 AS temp, 950 + k AS pres, event_type
  FROM (SELECT *, CAST(props->>'$.k' AS DOUBLE) AS k FROM events)""",
    "met_h": """SELECT date_trunc('hour', ts) AS ts, avg(spd80) AS spd80, avg(spd60) AS spd60, avg(spd40) AS spd40,
  avg(spd80_std) AS spd80_std, min_by(dir, ts) AS dir, avg(temp) AS temp, avg(pres) AS pres FROM met_events GROUP BY 1""",
    "ref_daily": "SELECT o_orderdate AS ts, avg(o_totalprice)*0.00003::DOUBLE AS spd, CAST(sum(o_custkey) AS DOUBLE) % 360 AS dir FROM orders GROUP BY 1",
    "tgt_daily": "SELECT l_shipdate AS ts, avg(l_quantity)*0.3::DOUBLE AS spd, CAST(sum(l_suppkey) AS DOUBLE) % 360 AS dir FROM lineitem GROUP BY 1",
}


def ctes(sql: str) -> str:
    """sql with the views it names in front."""
    names = [n for n in CTE if n in sql or (n == "met_events" and "met_h" in sql)]
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in names)
    if not head:
        return sql
    if sql.strip().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql.strip()[15:]}"
    return f"WITH {head} {', ' + sql.strip()[5:] if sql.strip().startswith('WITH ') else sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def met_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    speed = F.least(F.col("value") * 0.08, F.lit(40.0))
    return table(spark, sf_dir, "events").withColumn("k", k).select(
        "ts", speed.alias("spd80"), (speed * (0.90 + F.col("k") * 0.0005)).alias("spd60"), (speed * (0.80 + F.col("k") * 0.0005)).alias("spd40"),
        (speed * (0.05 + F.col("k") * 0.001)).alias("spd80_std"), F.pmod(F.col("user_id") * 2.4 + F.col("k") * 3.6, F.lit(360.0)).alias("dir"),
        (F.col("k") * 0.4 - 10).alias("temp"), (950 + F.col("k")).alias("pres"), "event_type",
    )


def met_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    means = [F.avg(c).alias(c) for c in ("spd80", "spd60", "spd40", "spd80_std")]
    return met_events(spark, sf_dir).groupBy(hour.alias("ts")).agg(*means, F.min_by("dir", "ts").alias("dir"), F.avg("temp").alias("temp"), F.avg("pres").alias("pres"))


def ref_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg((F.avg("o_totalprice") * 0.00003).alias("spd"), F.pmod(F.sum("o_custkey").cast("double"), F.lit(360.0)).alias("dir"))


def tgt_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg((F.avg("l_quantity") * 0.3).alias("spd"), F.pmod(F.sum("l_suppkey").cast("double"), F.lit(360.0)).alias("dir"))


def station_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, text): a station model as JSON text for each order, its lines being the measurement points. Each point has a configuration from the ship date on, a
    sensor from ten days before to twenty days after it and another from then on, and a mounting from the fifth day on."""
    open_end = F.lit(None).cast("string").alias("date_to")
    one = lambda *cols: F.array(F.struct(*cols))

    def point(x: Column) -> Column:
        day = lambda n: F.date_format(x["l_shipdate"] + F.expr(f"INTERVAL {n} DAY"), "yyyy-MM-dd'T'HH:mm:ss")
        sensors = F.array(
            F.struct(x["l_linestatus"].alias("oem"), x["l_suppkey"].cast("string").alias("serial_number"), day(-10).alias("date_from"), day(20).alias("date_to"), one(x["l_tax"].alias("slope"), x["l_discount"].alias("offset")).alias("calibration")),
            F.struct(x["l_linestatus"].alias("oem"), x["l_partkey"].cast("string").alias("serial_number"), day(20).alias("date_from"), open_end, F.array().cast("array<struct<slope:double,offset:double>>").alias("calibration")),
        )
        return F.struct(
            F.concat(F.lit("P"), x["l_linenumber"]).alias("name"), F.when(x["l_returnflag"] == "R", "wind_speed").otherwise("wind_direction").alias("measurement_type_id"), x["l_quantity"].alias("height_m"),
            one(x["l_discount"].alias("slope"), x["l_tax"].alias("offset"), day(0).alias("date_from"), open_end).alias("logger_measurement_config"), sensors.alias("sensor"),
            one((x["l_partkey"] % 360).alias("boom_orientation_deg"), day(5).alias("date_from"), open_end).alias("mounting_arrangement"),
        )

    # lines are gathered as they are and made into points afterwards, so that no points are shuffled
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("r"), "l_linestatus", "l_returnflag")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(line)), point).alias("measurement_point"))
    key = F.col("o_orderkey")
    mast = F.when(F.col("o_orderstatus") == "F", F.struct(F.col("o_orderpriority").alias("mast_geometry_id"), F.lit("n").alias("notes")))
    profiler = F.when(F.col("o_orderstatus") != "F", one((key % 9).cast("int").alias("device_datum_plane_height_m"), F.lit("v").alias("notes")))
    kind = F.when(F.col("o_orderstatus") == "F", "mast").when(F.col("o_orderstatus") == "O", "lidar").otherwise("sodar")
    site = F.struct(F.concat(F.lit("S"), key).alias("name"), kind.alias("measurement_station_type_id"), (key % 181 - 90).alias("latitude_ddeg"), F.lit("own").alias("notes"), mast.alias("mast_properties"), profiler.alias("vertical_profiler_properties"), "measurement_point")
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(key.alias("model"), F.to_json(F.struct(F.col("o_orderpriority").alias("author"), F.lit("1.3").alias("version"), F.array(site).alias("measurement_location")), {"ignoreNullFields": "false"}).alias("text"))
