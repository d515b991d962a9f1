"""Registered queries of the library's operators over the views, each with SQL for DuckDB where SQL can express it. Doubles are
rounded to 9 places on both sides."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anemos.functions import bins as B
from anemos.functions import scalar as S
from anemos.functions import timeaxis as T
from anemos.functions.aggs import fold, python_aggregate, quantile
from anemos.operators import calibrate as C
from anemos.operators import correl as R
from anemos.operators import dist as D
from anemos.operators import documents as J
from anemos.operators import geo as G
from anemos.operators import period as P
from anemos.operators import shear as H
from anemos.operators import station as M
from anemos.operators.asof import asof
from anemos.operators.quantile import group_quantiles
from anemos.plans.views import ctes, met_events, met_h, ref_daily, station_docs, table, tgt_daily
from anemos.sources.writers import per_mille

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 9) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = "") -> Callable:
    """Register a query under its function's name; `doubles` are the SQL columns to round."""
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if sql is not None:
            inner = ctes(sql)
            replaced = ", ".join(f"round({c}, 9) AS {c}" for c in doubles.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({inner})" if doubles else inner
        return f

    return register


MONTH = "date_trunc('month', ts)"
SECTOR = "CAST(floor(((dir + 15) % 360) / 30) AS INT) + 1"
CIRC = "CASE WHEN avg(round(sin(radians({0})), 5)) = 0 AND avg(round(cos(radians({0})), 5)) = 0 THEN NULL ELSE (degrees(atan2(avg(round(sin(radians({0})), 5)), avg(round(cos(radians({0})), 5)))) + 360) % 360 END"
DAYS = "day(last_day(ts))"


# ---- periods ----
@query(f"SELECT {MONTH} AS ts, avg(spd) AS spd FROM tgt_daily GROUP BY 1", "spd")
def q01_monthly_means(s, d):
    return P.monthly_means(tgt_daily(s, d), ["spd"], data_resolution="1D")


@query(f"SELECT {MONTH} AS ts, avg(spd) AS spd, count(spd)::DOUBLE / max({DAYS}) AS spd_coverage FROM tgt_daily GROUP BY 1", "spd spd_coverage")
def q02_monthly_coverage(s, d):
    return P.monthly_means(tgt_daily(s, d), ["spd"], return_coverage=True)


@query(f"SELECT {MONTH} AS ts, CASE WHEN count(spd)::DOUBLE / max({DAYS}) >= 0.9 THEN avg(spd) END AS spd FROM ref_daily GROUP BY 1", "spd")
def q03_coverage_threshold(s, d):
    return P.average_by_period(ref_daily(s, d), "1M", ["spd"], coverage_threshold=0.9)


@query("SELECT m0 + to_days(CAST(7 * floor(date_diff('day', m0, ts) / 7.0) AS INT)) AS ts, avg(spd) AS spd FROM tgt_daily, (SELECT date_trunc('day', min(ts))::TIMESTAMP AS m0 FROM tgt_daily) GROUP BY 1", "spd")
def q04_seven_days(s, d):
    return P.average_by_period(tgt_daily(s, d), "7D", ["spd"], data_resolution="1D")


@query("""WITH b AS (SELECT time_bucket(INTERVAL 3 HOUR, ts, (SELECT date_trunc('day', min(ts))::TIMESTAMP FROM met_events)) AS ts, avg(spd80) AS spd80, avg(temp) AS temp FROM met_events GROUP BY 1)
SELECT g.ts, spd80, temp FROM (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 3 HOUR)) AS ts) g LEFT JOIN b USING (ts)""", "spd80 temp")
def q05_three_hours(s, d):
    return P.average_by_period(met_events(s, d), "3H", ["spd80", "temp"], data_resolution="10min")


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS ts, coalesce(sum(x), 0) AS x_sum, coalesce(product(x), 1) AS x_prod, stddev_samp(x) AS x_std, var_samp(x) AS x_var, median(x) AS x_median, min(x) AS x_min, max(x) AS x_max
FROM (SELECT ts, spd80 / 4 AS x FROM met_h) GROUP BY 1""", "x_sum x_prod x_std x_var x_median x_min x_max")
def q06_aggregations(s, d):
    df = met_h(s, d).select("ts", (F.col("spd80") / 4).alias("x"))
    out = None
    for m in ("sum", "prod", "std", "var", "median", "min", "max"):
        one = P.average_by_period(df, "1D", ["x"], method=m, data_resolution="1H").withColumnRenamed("x", f"x_{m}")
        out = one if out is None else out.join(one, "ts")
    return out


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS ts, {CIRC.format('dir')} AS dir FROM met_events GROUP BY 1", "dir")
def q07_circular_mean(s, d):
    return P.average_by_period(met_events(s, d).select("ts", "dir"), "1D", ["dir"], ("dir",), data_resolution="10min")


@query(f"""WITH m AS (SELECT {MONTH} AS m, avg(spd) AS spd FROM tgt_daily GROUP BY 1)
SELECT date_trunc('year', m)::TIMESTAMP AS ts, avg(spd) AS spd, count(spd) / (date_diff('day', date_trunc('year', m)::TIMESTAMP, date_trunc('year', m)::TIMESTAMP + INTERVAL 1 YEAR)::DOUBLE / 31) AS spd_coverage FROM m GROUP BY date_trunc('year', m)""", "spd spd_coverage")
def q08_annual(s, d):
    months = P.monthly_means(tgt_daily(s, d), ["spd"], data_resolution="1D")
    return P.average_by_period(months, "1A", ["spd"], return_coverage=True, data_resolution="1M")


@query(f"SELECT {MONTH} AS ts, avg(spd) / (SELECT avg(spd) FROM tgt_daily WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-01-01') AS norm FROM tgt_daily GROUP BY 1", "norm")
def q09_monthly_norms(s, d):
    return P.monthly_norms(tgt_daily(s, d), "spd", "1996-01-01", "1998-01-01")


# ---- distributions ----
def _dist_sql(view: str, col: str, against: str, edges: list[float], value: str) -> str:
    e = f"[{', '.join(map(str, edges))}]"
    cond = f"x >= e[i] AND x < e[i + 1]"
    return f"""WITH r AS (SELECT {col} AS a, {against} AS x FROM {view} WHERE {col} IS NOT NULL AND {against} IS NOT NULL),
dim AS (SELECT i::INT AS i, {e}::DOUBLE[] AS e FROM range(1, {len(edges)}) t(i)), t AS (SELECT count(*) AS total FROM r)
SELECT i AS bin, any_value(e[i]) AS bin_left, any_value(e[i + 1]) AS bin_right, {value} AS value FROM dim LEFT JOIN r ON {cond}, t GROUP BY i"""


PCT = "100.0 * count(a) / max(total)"


@query(_dist_sql("met_events", "spd80", "spd80", [0, 2, 5, 10, 20], PCT), "value")
def q10_dist(s, d):
    return D.dist(met_events(s, d), "spd80", edges=[0, 2, 5, 10, 20])


@query("""WITH r AS (SELECT spd80 AS x FROM met_h WHERE spd80 IS NOT NULL), l AS (SELECT round_even(min(x) - 0.5, 0) - 0.5 AS e0, max(x) + 0.5 AS e1, count(*) AS total FROM r),
dim AS (SELECT i::INT AS bin, e0 + i - 1 AS bin_left, e0 + i AS bin_right, total FROM l, range(1, 60) t(i) WHERE e0 + i < e1)
SELECT bin, bin_left, bin_right, 100.0 * count(x) / max(total) AS value FROM dim LEFT JOIN r ON x >= bin_left AND x < bin_right GROUP BY ALL""", "value bin_left bin_right")
def q11_dist_default_bins(s, d):
    return D.dist(met_h(s, d), "spd80")


@query(_dist_sql("met_h", "spd80", "temp", [0, 5, 8, 10, 12, 15, 20], "avg(a)"), "value")
def q12_dist_against(s, d):
    return D.dist(met_h(s, d), "spd80", "temp", [0, 5, 8, 10, 12, 15, 20], "mean")


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, * FROM ({ctes(_dist_sql('met_h', c, c, [0, 2, 4, 6, 8], PCT))})" for c in ("spd80", "spd60", "spd40")), "value")
def q13_dist_many(s, d):
    return D.dist_many(met_h(s, d), ["spd80", "spd60", "spd40"], [0, 2, 4, 6, 8])


@query(_dist_sql("met_events", "spd80", "spd80", [i - 0.5 for i in range(32)], PCT), "value")
def q14_dist_of_wind_speed(s, d):
    return D.dist_of_wind_speed(met_events(s, d), "spd80")


@query("""WITH r AS (SELECT spd80 AS v, spd80 AS x, temp AS y FROM met_h), l AS (SELECT floor(min(x)) AS x0, floor(min(y)) AS y0 FROM r), t AS (SELECT count(*) AS total FROM r)
SELECT CAST(floor(y - y0) AS INT) + 1 AS y_bin, CAST(floor(x - x0) AS INT) + 1 AS x_bin, any_value(y0 + floor(y - y0)) AS y_left, any_value(x0 + floor(x - x0)) AS x_left, 100.0 * count(v) / any_value(total) AS value FROM r, l, t GROUP BY 1, 2""", "value")
def q15_dist_matrix(s, d):
    return D.dist_matrix(met_h(s, d), "spd80", "spd80", "temp")


@query("""WITH r AS (SELECT spd80 AS v, pres AS x, temp AS y FROM met_h), l AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM r),
b AS (SELECT *, CAST(floor((x - x0) / (x1 - x0) * 4) AS INT) + 1 AS x_bin, CAST(floor((y - y0) / (y1 - y0) * 5) AS INT) + 1 AS y_bin FROM r, l)
SELECT y_bin, x_bin, y0 + (y1 - y0) / 5 * (y_bin - 1) AS y_left, x0 + (x1 - x0) / 4 * (x_bin - 1) AS x_left, avg(v) AS value FROM b WHERE x_bin <= 4 AND y_bin <= 5 GROUP BY ALL""", "value y_left x_left")
def q16_dist_matrix_mean(s, d):
    return D.dist_matrix(met_h(s, d), "spd80", "pres", "temp", x_count=4, y_count=5, method="mean")


LABELS = "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{x}')" for i, x in enumerate(B.sector_labels(12))) + ") v(sector, sector_label)"


@query(f"WITH dim AS ({LABELS}), r AS (SELECT {SECTOR} AS sector, spd80 FROM met_events), t AS (SELECT count(*) AS total FROM r) SELECT sector, sector_label, coalesce(100.0 * count(spd80) / max(total), 0) AS value FROM dim LEFT JOIN r USING (sector), t GROUP BY ALL", "value")
def q17_by_sector(s, d):
    return D.by_sector(met_events(s, d), "spd80", "dir")


@query(f"WITH dim AS ({LABELS}), r AS (SELECT {SECTOR} AS sector, spd80 FROM met_h) SELECT sector, sector_label, coalesce(avg(spd80), 0) AS value FROM dim LEFT JOIN r USING (sector) GROUP BY ALL", "value")
def q18_by_sector_mean(s, d):
    return D.by_sector(met_h(s, d), "spd80", "dir", method="mean")


@query("""WITH r AS (SELECT CASE WHEN dir < 90 THEN 1 WHEN dir < 130 THEN 2 WHEN dir < 200 THEN 3 ELSE 4 END AS sector, spd80 FROM met_events)
SELECT sector, CASE sector WHEN 1 THEN '0.0-90.0' WHEN 2 THEN '90.0-130.0' WHEN 3 THEN '130.0-200.0' ELSE '200.0-360.0' END AS sector_label, max(spd80) AS value FROM r GROUP BY ALL""", "value")
def q19_custom_sectors(s, d):
    return D.by_sector(met_events(s, d), "spd80", "dir", method="max", edges=[0, 90, 130, 200, 360])


@query(f"SELECT CAST(floor(spd80 / 5) AS INT) + 1 AS bin, {SECTOR} AS sector, avg(temp) AS value FROM met_events WHERE spd80 < 20 GROUP BY ALL", "value")
def q20_matrix_by_sector(s, d):
    return D.matrix_by_sector(met_events(s, d), "temp", "spd80", "dir", [0, 5, 10, 15, 20])


def _freq_sql(view: str, value: str, extra: str = "") -> str:
    return f"""WITH r AS (SELECT CAST(floor(spd80 + 0.5) AS INT) + 1 AS bin, {SECTOR} AS sector FROM {view} WHERE spd80 >= -0.5 AND spd80 < 40.5),
dim AS (SELECT b::INT AS bin, b - 1.5 AS bin_left, b - 0.5 AS bin_right, s::INT AS sector FROM range(1, 42) x(b), range(1, 13) y(s)), t AS (SELECT count(*) AS total FROM r), c AS (SELECT bin, sector, count(*) AS n FROM r GROUP BY ALL)
SELECT dim.bin, bin_left::DOUBLE AS bin_left, bin_right::DOUBLE AS bin_right, dim.sector, {value} AS value FROM dim LEFT JOIN c USING (bin, sector), t"""


@query(_freq_sql("met_events", "coalesce(100.0 * n / total, 0)"), "value")
def q21_freq_table(s, d):
    return D.freq_table(met_events(s, d), "spd80", "dir")


@query(_freq_sql("met_events", "coalesce(n, 0)::DOUBLE"))
def q22_freq_table_counts(s, d):
    return D.freq_table(met_events(s, d), "spd80", "dir", percentage=False)


@query("SELECT hour(ts)::INT AS hour, month(ts)::INT AS month, avg(spd80) AS value FROM met_events GROUP BY ALL", "value")
def q23_12x24(s, d):
    return D.table_12x24(met_events(s, d), "spd80")


@query("""WITH r AS (SELECT CAST(floor(spd80 + 0.5) AS INT) + 1 AS bin, spd80_std / spd80 AS ti FROM met_events WHERE spd80 >= 3 AND spd80 < 40.5)
SELECT bin, bin - 1.0::DOUBLE AS bin_mid, avg(ti) AS mean_ti, count(ti) AS ti_count, quantile_cont(ti, 0.9) AS rep_ti, stddev_samp(ti) AS ti_2sigma, avg(ti) + stddev_samp(ti) / (bin - 1) AS char_ti FROM r GROUP BY bin HAVING count(*) > 1""", "mean_ti rep_ti ti_2sigma char_ti")
def q24_ti_by_speed(s, d):
    return D.ti_by_speed(met_events(s, d), "spd80", "spd80_std")


@query(f"WITH dim AS ({LABELS}), r AS (SELECT {SECTOR} AS sector, spd80_std / spd80 AS ti FROM met_events WHERE spd80 >= 3) SELECT sector, sector_label, coalesce(avg(ti), 0) AS mean_ti, count(ti) AS ti_count FROM dim LEFT JOIN r USING (sector) GROUP BY ALL", "mean_ti")
def q25_ti_by_sector(s, d):
    return D.ti_by_sector(met_events(s, d), "spd80", "spd80_std", "dir")


@query("SELECT hour(ts)::INT AS hour, month(ts)::INT AS month, avg(spd80_std / spd80) AS value FROM met_events WHERE spd80 >= 3 GROUP BY ALL", "value")
def q26_ti_12x24(s, d):
    return D.ti_12x24(met_events(s, d), "spd80", "spd80_std")


@query("""WITH p AS (SELECT 0 AS pair, spd80 AS a, spd60 AS b, dir FROM met_events UNION ALL SELECT 1, spd80, spd40, dir FROM met_events), r AS (SELECT pair, CAST(floor(((dir + 2.5) % 360) / 5) AS INT) + 1 AS sector, b / a AS q FROM p WHERE a >= 3 AND a < 50 AND b >= 3 AND b < 50),
dim AS (SELECT x.p::INT AS pair, y.s::INT AS sector FROM range(2) x(p), range(1, 73) y(s)) SELECT pair, sector, coalesce(avg(q), 0) AS value FROM dim LEFT JOIN r USING (pair, sector) GROUP BY ALL""", "value")
def q27_sector_ratio(s, d):
    return D.sector_ratio(met_events(s, d), [("spd80", "spd60"), ("spd80", "spd40")], "dir")


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM met_h" for c in ("spd80", "spd60", "temp", "pres")), "mean std min max")
def q28_basic_stats(s, d):
    return D.basic_stats(met_h(s, d), ["spd80", "spd60", "temp", "pres"])


@query("SELECT avg(floor(spd80 + 0.5)) AS mean_speed FROM met_events WHERE spd80 < 40.5", "mean_speed")
def q29_table_mean(s, d):
    return D.table_mean(D.freq_table(met_events(s, d), "spd80", "dir"))


@query("SELECT 'event_type' AS variable, sum(n)::BIGINT AS count, count(*) AS \"unique\", arg_min(event_type, (-n, event_type)) AS top, max(n) AS freq FROM (SELECT event_type, count(*) AS n FROM met_events GROUP BY 1)")
def q28b_text_stats(s, d):
    return D.text_stats(met_events(s, d), "event_type")


# ---- long-term means ----
MOMM = "SELECT 'spd' AS variable, avg(m) AS momm FROM (SELECT avg(spd) AS m FROM {0} GROUP BY month(ts))"


@query(MOMM.format("tgt_daily"), "momm")
def q30_momm(s, d):
    return P.momm(tgt_daily(s, d), ["spd"])


@query(f"""WITH m AS (SELECT month(ts) AS mo, avg(spd) AS v FROM tgt_daily GROUP BY 1), w AS (SELECT month(x) AS mo, avg(day(last_day(x))) AS days FROM (SELECT DISTINCT {MONTH} AS x FROM tgt_daily) GROUP BY 1)
SELECT 'spd' AS variable, sum(v * days) / sum(days) AS momm FROM m JOIN w USING (mo)""", "momm")
def q31_momm_seasonal(s, d):
    return P.momm(tgt_daily(s, d), ["spd"], seasonal=True)


@query(f"""WITH r AS (SELECT * FROM ref_daily WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '2000-01-01'), thin AS (SELECT {MONTH} AS m FROM r GROUP BY 1 HAVING count(spd)::DOUBLE / max({DAYS}) < 0.95)
SELECT 'spd' AS variable, avg(m) AS momm FROM (SELECT avg(spd) AS m FROM r WHERE {MONTH} NOT IN (SELECT m FROM thin) GROUP BY month(ts))""", "momm")
def q32_momm_threshold(s, d):
    return P.momm(ref_daily(s, d), ["spd"], "1996-01-01", "2000-01-01", coverage_threshold=0.95)


@query(f"""WITH r AS (SELECT month(ts) AS mo, CAST(floor(spd + 0.5) AS INT) + 1 AS bin, {SECTOR} AS sector FROM tgt_daily), w AS (SELECT month(x) AS mo, avg(day(last_day(x))) AS days FROM (SELECT DISTINCT {MONTH} AS x FROM tgt_daily) GROUP BY 1),
c AS (SELECT mo, bin, sector, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY mo) AS v FROM r GROUP BY mo, bin, sector), f AS (SELECT bin, sector, sum(v * days) / max(tot) AS v FROM c JOIN w USING (mo), (SELECT sum(days) AS tot FROM w) GROUP BY bin, sector),
dim AS (SELECT b::INT AS bin, (b - 1.5)::DOUBLE AS bin_left, (b - 0.5)::DOUBLE AS bin_right, s::INT AS sector FROM range(1, 42) x(b), range(1, 13) y(s))
SELECT dim.bin, bin_left, bin_right, dim.sector, coalesce(v, 0) AS value FROM dim LEFT JOIN f USING (bin, sector)""", "value")
def q33_freq_table_seasonal(s, d):
    return D.freq_table(tgt_daily(s, d), "spd", "dir", seasonal=True)


@query(f"""WITH RECURSIVE t AS (SELECT spd, {SECTOR} AS sector FROM tgt_daily WHERE spd IS NOT NULL AND dir IS NOT NULL), first AS (SELECT 8.0 / avg(spd) AS f FROM t),
rec AS (SELECT 0 AS i, f, avg(floor(spd * f + 0.5)) AS got, []::DOUBLE[] AS seen FROM t, first GROUP BY f
 UNION ALL SELECT i + 1, nf, avg(floor(spd * nf + 0.5)), list_append(seen, apart) FROM (SELECT *, f * (8.0 / got) AS nf, round(abs(100 * (8.0 - got) / got), 12) AS apart FROM rec) r, t
 WHERE apart > 0.01 AND NOT coalesce(list_contains(seen, apart) AND apart = list_min(seen), false) AND i < 99 GROUP BY i, nf, seen, apart),
last AS (SELECT arg_max(f, i) AS f FROM rec), n AS (SELECT CAST(floor(spd * f + 0.5) AS INT) + 1 AS bin, sector, count(*) AS n FROM t, last GROUP BY ALL)
SELECT b::INT AS bin, (b - 1.5)::DOUBLE AS bin_left, (b - 0.5)::DOUBLE AS bin_right, s::INT AS sector, coalesce(100.0 * n / (SELECT count(*) FROM t), 0) AS value
FROM range(1, 42) x(b) CROSS JOIN range(1, 13) y(s) LEFT JOIN n ON n.bin = b AND n.sector = s""", "value")
def q34_freq_table_target_mean(s, d):
    return D.freq_table(tgt_daily(s, d), "spd", "dir", target_mean=8.0)


@query("""WITH r AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nx FROM (SELECT DISTINCT ts FROM ref_daily))
SELECT ts AS date_from, nx AS date_to, date_diff('day', ts, nx) - 1.0::DOUBLE AS days_lost FROM r WHERE date_diff('day', ts, nx) <> 1""", "days_lost")
def q35_continuity_gaps(s, d):
    return T.continuity_gaps(ref_daily(s, d), columns=["spd"])


@query("SELECT ts, spd, dir FROM tgt_daily WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1996-04-01'", "spd dir")
def q36_slice(s, d):
    return T.slice_data(tgt_daily(s, d), "1996-03-01", "1996-04-01")


# ---- calibration and cleaning ----
@query("SELECT ts, 0.05 * ((spd80 - 0.2) / 0.0468) + 0.236 AS x FROM met_h", "x")
def q40_slope_offset(s, d):
    return met_h(s, d).select("ts", S.adjust_slope_offset(F.col("spd80"), 0.0468, 0.2, 0.05, 0.236).alias("x"))


@query("SELECT ts, spd80 * 1.03 AS x FROM met_h", "x")
def q41_scale(s, d):
    return met_h(s, d).select("ts", S.scale(F.col("spd80"), 1.03).alias("x"))


@query("SELECT ts, dir, CASE WHEN dir + 200 > 360 THEN (dir + 200) % 360 ELSE dir + 200 END AS up, CASE WHEN dir - 30 < 0 THEN dir + 330 ELSE dir - 30 END AS down FROM met_events", "dir up down")
def q42_offset_direction(s, d):
    c = F.col("dir")
    return met_events(s, d).select("ts", "dir", S.offset_direction(c, 200).alias("up"), S.offset_direction(c, -30).alias("down"))


@query("""SELECT ts, CASE WHEN ts < TIMESTAMP '1997-01-01' THEN 1.02 * ((spd - 0.1) / 1.0) + 0.2 WHEN ts >= TIMESTAMP '1998-06-01' THEN 0.98 * ((spd - 0.1) / 1.01) + 0.15 ELSE spd END AS spd FROM tgt_daily""", "spd")
def q43_slope_offset_periods(s, d):
    periods = [C.Interval("spd", None, "1997-01-01", 1.0, 0.1, 1.02, 0.2), C.Interval("spd", "1998-06-01", None, 1.01, 0.1, 0.98, 0.15), C.Interval("spd", "1997-01-01", "1998-01-01", 1.0, None, 2.0, 0.0)]
    return C.slope_offset_by_period(tgt_daily(s, d).select("ts", "spd"), periods)


@query("""WITH o AS (SELECT ts, dir, CASE WHEN ts < TIMESTAMP '1997-01-01' THEN 25 WHEN ts < TIMESTAMP '1999-01-01' THEN -40 ELSE 0 END AS k FROM tgt_daily)
SELECT ts, CASE WHEN dir + k < 0 THEN dir + k + 360 WHEN dir + k > 360 THEN (dir + k) % 360 ELSE dir + k END AS dir FROM o""", "dir")
def q44_deadband_periods(s, d):
    return C.deadband_by_period(tgt_daily(s, d).select("ts", "dir"), [C.Interval("dir", None, "1997-01-01", logger_offset=5, offset=30), C.Interval("dir", "1997-01-01", "1999-01-01", logger_offset=10, offset=-30)])


@query("""WITH o AS (SELECT ts, dir, CASE WHEN ts >= TIMESTAMP '1996-06-01' AND ts < TIMESTAMP '1997-01-01' THEN 170 WHEN ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01' THEN 90 ELSE 0 END AS k FROM tgt_daily)
SELECT ts, CASE WHEN dir + k > 360 THEN (dir + k) % 360 ELSE dir + k END AS dir FROM o""", "dir")
def q45_device_orientation(s, d):
    devices = [C.Orientation("1996-06-01", "1997-01-01", 180.0), C.Orientation("1997-01-01", None, 100.0)]
    return C.orientation_by_period(tgt_daily(s, d).select("ts", "dir"), [C.Interval("dir", None, "1998-01-01", logger_offset=10)], devices)


def _shadow(low: float, high: float) -> str:
    return f"(dir >= {low} AND dir <= {high})" if low <= high else f"(dir >= {low} OR dir <= {high})"


def _selective_sql(name: str, b1: float, b2: float) -> str:
    return f"CASE WHEN spd80 IS NULL THEN spd60 WHEN spd60 IS NULL THEN spd80 WHEN {_shadow(*S.sector_limits(b1, 60))} THEN spd60 WHEN {_shadow(*S.sector_limits(b2, 60))} THEN spd80 ELSE (spd80 + spd60) / 2 END AS {name}"


BOOMS = {"plain": (315.0, 135.0), "wrap_1": (180.0, 60.0), "wrap_2": (90.0, 190.0)}


@query("SELECT ts, " + ", ".join(_selective_sql(n, *b) for n, b in BOOMS.items()) + " FROM met_h", " ".join(BOOMS))
def q46_selective_average(s, d):
    return met_h(s, d).select("ts", *[S.selective_average(F.col("spd80"), F.col("spd60"), F.col("dir"), *b).alias(n) for n, b in BOOMS.items()])


SHIFTED = "WITH m AS (SELECT ts + INTERVAL 10 DAY AS ts, spd FROM tgt_daily WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1996-03-01'), r AS (SELECT ts, spd FROM tgt_daily WHERE NOT (ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1996-03-01')) "


@query(SHIFTED + "SELECT true AS overwrite, * FROM (SELECT * FROM m UNION ALL SELECT * FROM r WHERE ts NOT IN (SELECT ts FROM m)) UNION ALL SELECT false, * FROM (SELECT * FROM r UNION ALL SELECT * FROM m WHERE ts NOT IN (SELECT ts FROM r))", "spd")
def q47_offset_timestamps(s, d):
    df = tgt_daily(s, d).select("ts", "spd")
    a, b = datetime(1996, 1, 1), datetime(1996, 3, 1)
    return P.offset_timestamps(df, "10D", a, b, True).select(F.lit(True).alias("overwrite"), "*").unionByName(P.offset_timestamps(df, "10D", a, b).select(F.lit(False).alias("overwrite"), "*"))


@query("SELECT ts, 100 * pres / (286.9 * (temp + 273.15)) AS density, round(100 * pres / (286.9 * (temp + 273.15)) + (200 - 50) / 1000.0 * -0.113, 3) AS density_site FROM met_h", "density density_site")
def q48_air_density(s, d):
    t, p = F.col("temp"), F.col("pres")
    return met_h(s, d).select("ts", S.air_density(t, p).alias("density"), S.air_density(t, p, 50, 200).alias("density_site"))


@query("""WITH r AS (SELECT ts, dir AS a, (dir + 40) % 360 AS b, CASE WHEN spd80 > 2 THEN (dir + 90) % 360 END AS c FROM met_events), v AS (SELECT ts, list_filter([a, b, c], lambda x: x IS NOT NULL) AS l FROM r),
m AS (SELECT ts, list_avg(list_transform(l, lambda x: round(sin(radians(x)), 5))) AS s, list_avg(list_transform(l, lambda x: round(cos(radians(x)), 5))) AS c FROM v) SELECT ts, CASE WHEN s = 0 AND c = 0 THEN NULL ELSE (degrees(atan2(s, c)) + 360) % 360 END AS dir FROM m""", "dir")
def q49_row_directions(s, d):
    r = met_events(s, d).select("ts", F.col("dir").alias("a"), ((F.col("dir") + 40) % 360).alias("b"), F.when(F.col("spd80") > 2, (F.col("dir") + 90) % 360).alias("c"))
    return r.select("ts", S.row_circular_mean([F.col(c) for c in "abc"]).alias("dir"))


LOG = [("spd", "1996-01-01", "1996-02-01"), ("All", "1997-05-01", "1997-05-20"), ("dir", None, "1995-03-01"), ("spd", "2001-01-01", None), ("x", None, None)]


def _log(s: SparkSession, rows=LOG, extra: list[str] | None = None) -> DataFrame:
    t = lambda x: datetime.fromisoformat(x) if x else None
    data = [(n, t(a), t(b), *([extra[i]] if extra else [])) for i, (n, a, b) in enumerate(rows)]
    return s.createDataFrame(data, "sensor string, date_from timestamp_ntz, date_to timestamp_ntz" + (", flag string" if extra else ""))


ALL_GONE = "(ts >= TIMESTAMP '1997-05-01' AND ts < TIMESTAMP '1997-05-20')"
LOGGED = f"SELECT ts, CASE WHEN {ALL_GONE} OR (ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1996-02-01') OR ts >= TIMESTAMP '2001-01-01' THEN NULL ELSE spd END AS spd, CASE WHEN {ALL_GONE} OR ts < TIMESTAMP '1995-03-01' THEN NULL ELSE dir END AS dir FROM tgt_daily"


@query(LOGGED, "spd dir")
def q50_cleaning_log(s, d):
    return C.apply_log(tgt_daily(s, d), _log(s))


@query(LOGGED, "spd dir")
def q50b_cleaning_log_joined(s, d):
    return C.apply_log(tgt_daily(s, d), _log(s), fold=0)


@query(f"SELECT ts, CASE WHEN {ALL_GONE} OR ts >= TIMESTAMP '2001-01-01' THEN NULL ELSE spd END AS spd, CASE WHEN {ALL_GONE} OR ts < TIMESTAMP '1995-03-01' THEN NULL ELSE dir END AS dir FROM tgt_daily", "spd dir")
def q51_flag_log(s, d):
    return C.apply_flags(tgt_daily(s, d), _log(s, extra=["Synthesized", "Icing", "Tower shading", "Icing", "Other"]))


def _rule(targets: list[str], column: str, value: float, op: int, **dates) -> dict:
    return {"rule": {"clean_out": [{"assembled_column_name": t} for t in targets], "conditions": {"assembled_column_name": column, "comparator_value": value, "comparison_operator_id": op}, **dates}}


RULES = [_rule(["spd80"], "temp", 8.0, 1), _rule(["spd60"], "pres", 990.0, 2), _rule(["spd40"], "spd80", 6.0, 3), _rule(["pres"], "temp", 12.0, 4), _rule(["temp"], "dir", 0.0, 5), _rule(["dir"], "spd80", 5.0, 6, date_from="2024-01-10", date_to="2024-01-11")]


@query("""WITH a AS (SELECT ts, spd80, spd60, spd40, dir, temp, pres, CASE WHEN temp < 8 THEN NULL ELSE spd80 END AS s80, CASE WHEN pres <= 990 THEN NULL ELSE spd60 END AS s60 FROM met_h)
SELECT ts, s80 AS spd80, s60 AS spd60, CASE WHEN s80 > 6 THEN NULL ELSE spd40 END AS spd40, CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' AND s80 IS DISTINCT FROM 5 THEN NULL ELSE dir END AS dir,
CASE WHEN dir = 0 THEN NULL ELSE temp END AS temp, CASE WHEN temp >= 12 THEN NULL ELSE pres END AS pres FROM a""", "spd80 spd60 spd40 dir temp pres")
def q52_cleaning_rules(s, d):
    return C.apply_rules(met_h(s, d).select("ts", "spd80", "spd60", "spd40", "dir", "temp", "pres"), RULES)


@query("SELECT event_id, CASE WHEN event_id % 5 NOT IN (1, 2, 3) THEN value END AS x FROM events", "x")
def q53_nan_to_null(s, d):
    k = F.col("event_id") % 5
    x = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, float("-inf")).otherwise(F.col("value"))
    return table(s, d, "events").select("event_id", S.clean(x).alias("x"))


@query(" UNION ALL ".join(f"SELECT '{v}' AS name, arg_min(step, (-n, step)) AS step FROM (SELECT step, count(*) AS n FROM (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS step FROM (SELECT DISTINCT ts FROM {v})) WHERE step IS NOT NULL GROUP BY 1)" for v in ("met_h", "tgt_daily")))
def q54_resolution(s, d):
    out = None
    for name, df in (("met_h", met_h(s, d)), ("tgt_daily", tgt_daily(s, d))):
        one = T.step_counts(df).orderBy(F.desc("n"), "step").limit(1).select(F.lit(name).alias("name"), "step")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT ts, spd FROM ref_daily WHERE {MONTH} IN (SELECT {MONTH} FROM ref_daily GROUP BY 1 HAVING count(spd)::DOUBLE / max({DAYS}) >= 0.95)", "spd")
def q55_drop_thin_months(s, d):
    return P.drop_thin_months(ref_daily(s, d).select("ts", "spd"), ["spd"], 0.95)


# ---- correlation ----
MERGED = """WITH s0 AS (SELECT greatest((SELECT min(ts) FROM ref_daily), (SELECT min(ts) FROM tgt_daily)) AS t0),
mm AS (SELECT a.ts, r, rc, t, tc FROM (SELECT date_trunc('month', ts)::TIMESTAMP AS ts, avg(spd) AS r, count(spd)::DOUBLE / max(day(last_day(ts))) AS rc FROM ref_daily, s0 WHERE ts >= date_trunc('month', t0) GROUP BY 1) a
  JOIN (SELECT date_trunc('month', ts)::TIMESTAMP AS ts, avg(spd) AS t, count(spd)::DOUBLE / max(day(last_day(ts))) AS tc FROM tgt_daily, s0 WHERE ts >= date_trunc('month', t0) GROUP BY 1) b ON a.ts = b.ts),
dd AS (SELECT a.ts, a.spd AS r, a.dir AS dir, b.spd AS t, b.dir AS tdir FROM ref_daily a JOIN tgt_daily b ON a.ts = b.ts) """


def _merged(s, d) -> DataFrame:
    return P.merge_by_period(ref_daily(s, d).select("ts", F.col("spd").alias("r")), tgt_daily(s, d).select("ts", F.col("spd").alias("t")), "1M", resolution_1="1D", resolution_2="1D")


def _daily(s, d) -> DataFrame:
    return ref_daily(s, d).select("ts", F.col("spd").alias("r"), "dir").join(tgt_daily(s, d).select("ts", F.col("spd").alias("t"), F.col("dir").alias("tdir")), "ts")


@query(MERGED + "SELECT ts, r, rc AS r_coverage, t, tc AS t_coverage FROM mm", "r r_coverage t t_coverage")
def q60_merge_by_period(s, d):
    return _merged(s, d)


@query(MERGED + "SELECT regr_slope(t, r) AS slope, regr_intercept(t, r) AS \"offset\", count(*) AS n FROM mm", "slope \"offset\"")
def q61_ols(s, d):
    return R.ols(_merged(s, d), "r", "t")


@query(MERGED + "SELECT sum(r * t) / sum(r * r) AS slope, 0.0::DOUBLE AS \"offset\", count(*) AS n FROM mm", "slope")
def q62_ols_origin(s, d):
    return R.ols(_merged(s, d), "r", "t", through_origin=True)


SECTOR_FIT = f"SELECT {SECTOR} AS sector, regr_slope(t, r) AS slope, regr_intercept(t, r) AS \"offset\", count(*) AS n, regr_r2(t, r) AS r2 FROM dd GROUP BY 1"


@query(MERGED + SECTOR_FIT, "slope \"offset\" r2")
def q63_ols_by_sector(s, d):
    return R.ols_by_sector(_daily(s, d), "r", "t", "dir")


@query(MERGED + """, v AS (SELECT var_pop(r) AS sxx, var_pop(t) AS syy, covar_pop(t, r) AS sxy, avg(r) AS mx, avg(t) AS my, count(*) AS n FROM mm),
b AS (SELECT *, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) AS slope FROM v) SELECT slope, my - slope * mx AS "offset", n FROM b""", "slope \"offset\"")
def q64_orthogonal(s, d):
    return R.orthogonal(_merged(s, d), "r", "t")


LAGGED = MERGED + ", x AS (SELECT a.ts, a.spd AS r, b.spd AS r1, t.spd AS t FROM ref_daily a JOIN ref_daily b ON a.ts = b.ts + INTERVAL 1 DAY JOIN tgt_daily t ON t.ts = a.ts), c AS (SELECT covar_pop(r, r) AS a, covar_pop(r1, r1) AS b, covar_pop(r, r1) AS k, covar_pop(r, t) AS p, covar_pop(r1, t) AS q, avg(r) AS mr, avg(r1) AS m1, avg(t) AS mt FROM x), s AS (SELECT *, (p * b - q * k) / (a * b - k * k) AS b0, (q * a - p * k) / (a * b - k * k) AS b1 FROM c) "


def _lagged(s, d) -> DataFrame:
    ref = ref_daily(s, d).select("ts", F.col("spd").alias("r"))
    before = ref.select((F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.col("r").alias("r1"))
    return ref.join(before, "ts").join(tgt_daily(s, d).select("ts", F.col("spd").alias("t")), "ts")


@query(LAGGED + "SELECT 'offset' AS term, mt - b0 * mr - b1 * m1 AS value FROM s UNION ALL SELECT 'r', b0 FROM s UNION ALL SELECT 'r1', b1 FROM s", "value")
def q65_multiple_regression(s, d):
    return R.multiple(_lagged(s, d), ["r", "r1"], "t")


@query(MERGED + "SELECT 'ols' AS fit, regr_r2(t, r) AS r2 FROM mm UNION ALL SELECT 'origin', 1 - sum((t - k * r) * (t - k * r)) / (count(*) * var_pop(t)) FROM mm, (SELECT sum(r * t) / sum(r * r) AS k FROM mm)", "r2")
def q66_r2(s, d):
    m = _merged(s, d)
    fits = [(n, R.fit_r2(m, R.ols(m, "r", "t", o), "r", "t")) for n, o in (("ols", False), ("origin", True))]
    return fits[0][1].select(F.lit("ols").alias("fit"), "r2").unionByName(fits[1][1].select(F.lit("origin").alias("fit"), "r2"))


@query(MERGED + """, f AS (SELECT regr_slope(t, r) AS a, regr_intercept(t, r) AS b FROM mm), p AS (SELECT date_trunc('month', ts)::TIMESTAMP AS ts, avg(spd) AS x FROM ref_daily GROUP BY 1), t AS (SELECT date_trunc('month', ts)::TIMESTAMP AS ts, avg(spd) AS y FROM tgt_daily GROUP BY 1)
SELECT coalesce(p.ts, t.ts) AS ts, coalesce(y, x * a + b) AS t_Synthesized FROM f, p FULL JOIN t ON p.ts = t.ts""", "t_Synthesized")
def q67_synthesize(s, d):
    return R.synthesize(ref_daily(s, d).select("ts", F.col("spd").alias("r")), tgt_daily(s, d).select("ts", F.col("spd").alias("t")), "r", "t", "1M")


@query(MERGED + f""", f AS (SELECT {SECTOR} AS sector, regr_slope(t, r) AS a, regr_intercept(t, r) AS b FROM dd GROUP BY 1), p AS (SELECT ts, spd * a + b AS x FROM (SELECT ts, spd, {SECTOR} AS sector FROM ref_daily) JOIN f USING (sector))
SELECT coalesce(p.ts, y.ts) AS ts, coalesce(y.spd, x) AS t_Synthesized FROM p FULL JOIN tgt_daily y ON p.ts = y.ts""", "t_Synthesized")
def q68_synthesize_by_sector(s, d):
    ref = ref_daily(s, d).select("ts", F.col("spd").alias("r"), "dir")
    tgt = tgt_daily(s, d).select("ts", F.col("spd").alias("t"))
    params = R.ols_by_sector(ref.join(tgt, "ts"), "r", "t", "dir")
    return R.combine(tgt, R.predict(ref, params, "r", direction="dir"), "t")


@query(f"""WITH b AS (SELECT greatest((SELECT min(ts) FROM ref_daily), (SELECT min(ts) FROM tgt_daily)) AS a, (SELECT max(ts) FROM ref_daily) AS z), r AS (SELECT avg(spd) AS r FROM ref_daily, b WHERE ts BETWEEN a AND z), t AS (SELECT avg(spd) AS t, count(spd) AS n FROM tgt_daily, b WHERE ts BETWEEN a AND z), m AS ({MOMM.format('ref_daily')})
SELECT t / r AS simple_speed_ratio, momm AS ref_long_term_momm, t / r * momm AS target_long_term, n / date_diff('day', a, z)::DOUBLE AS target_overlap_coverage FROM r, t, m, b""", "simple_speed_ratio ref_long_term_momm target_long_term target_overlap_coverage")
def q69_speed_ratio(s, d):
    return R.speed_ratio(ref_daily(s, d).select("ts", "spd"), tgt_daily(s, d).select("ts", "spd"), "spd", "spd")


SORTED = MERGED + f""", k AS (SELECT least(0.5 * momm, 4) AS cut FROM ({MOMM.format('ref_daily')})), w AS (SELECT *, {SECTOR} AS sector FROM dd),
pr AS (SELECT x.sector, x.rn, r, t FROM (SELECT sector, r, row_number() OVER (PARTITION BY sector ORDER BY r) AS rn FROM w) x JOIN (SELECT sector, t, row_number() OVER (PARTITION BY sector ORDER BY t) AS rn FROM w) y ON x.sector = y.sector AND x.rn = y.rn),
fi AS (SELECT sector, coalesce(min(rn) FILTER (r >= cut), 1) AS f, count(*) AS n FROM pr, k GROUP BY 1), ab AS (SELECT pr.*, n, rn - f AS gap, floor((n - f + 1) / 2) AS half FROM pr JOIN fi USING (sector) WHERE rn >= f),
ms AS (SELECT sector, avg(r) FILTER (gap < half) AS x1, avg(t) FILTER (gap < half) AS y1, avg(r) FILTER (gap >= half) AS x2, avg(t) FILTER (gap >= half) AS y2, min(t) AS tc, max(n) AS n, count(*) AS na FROM ab GROUP BY 1),
lm AS (SELECT 0.5 * (6 + 0.5 * avg(r)) AS lr, 0.5 * (6 + 0.5 * avg(t)) AS lt FROM w), vv AS (SELECT sector, avg(CASE WHEN tdir - dir > 180 THEN tdir - dir - 360 WHEN tdir - dir < -180 THEN tdir - dir + 360 ELSE tdir - dir END) AS v, count(*) AS nv FROM w, lm WHERE r >= lr AND t >= lt GROUP BY 1),
fit AS (SELECT sector, round((y2 - y1) / (x2 - x1), 5) AS slope, round(y1 - (y2 - y1) / (x2 - x1) * x1, 5) AS "offset", round(tc, 5) AS target_cutoff, n, na AS n_above, round(v, 5) AS veer, coalesce(nv, 0) AS n_veer FROM ms LEFT JOIN vv USING (sector)) """


def _cutoff(s, d) -> float:
    return R.speedsort_cutoff(P.momm(ref_daily(s, d), ["spd"]).first()["momm"])


def _speedsort(s, d) -> tuple[DataFrame, float]:
    cut = _cutoff(s, d)
    return R.speedsort_fit(_daily(s, d), "r", "t", "dir", "tdir", cut), cut


@query(SORTED + "SELECT * FROM fit", "slope \"offset\" target_cutoff veer")
def q70_speedsort_fit(s, d):
    return _speedsort(s, d)[0]


@query(SORTED + f"SELECT ts, CASE WHEN spd < cut THEN (slope * cut + \"offset\") * spd / cut ELSE slope * spd + \"offset\" END AS predicted FROM (SELECT *, {SECTOR} AS sector FROM ref_daily) LEFT JOIN fit USING (sector), k", "predicted")
def q71_speedsort_predict(s, d):
    params, cut = _speedsort(s, d)
    return R.speedsort_predict(ref_daily(s, d), params, "spd", "dir", cut).select("ts", "predicted")


TURNED = """, kn AS (SELECT i::INT AS i, a.veer AS va, b.veer AS vb FROM range(12) x(i) LEFT JOIN fit a ON a.sector = i + 1 LEFT JOIN fit b ON b.sector = (i + 1) % 12 + 1),
tu AS (SELECT ts, dir, dir / 30 - i AS f, va, vb FROM (SELECT *, CAST(floor(dir / 30) AS INT) AS i FROM ref_daily) JOIN kn USING (i)), nw AS (SELECT ts, dir + CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN va + (vb - va) * f WHEN va IS NOT NULL AND f < 0.5 THEN va WHEN vb IS NOT NULL AND f >= 0.5 THEN vb END AS p FROM tu),
turned AS (SELECT ts, CASE WHEN p < 0 THEN p + 360 WHEN p > 360 THEN p % 360 ELSE p END AS predicted_direction FROM nw)"""
SPEEDS = f"SELECT ts, CASE WHEN spd < cut THEN (slope * cut + \"offset\") * spd / cut ELSE slope * spd + \"offset\" END AS predicted FROM (SELECT *, {SECTOR} AS sector FROM ref_daily) LEFT JOIN fit USING (sector), k"


@query(SORTED + TURNED + "SELECT * FROM turned", "predicted_direction")
def q72_veer(s, d):
    return R.predict_direction(ref_daily(s, d), _speedsort(s, d)[0], "dir").select("ts", "predicted_direction")


@query(SORTED + TURNED + f""", pv AS ({SPEEDS})
SELECT ts, CASE WHEN coalesce(t.spd, predicted) < 0 THEN 0 ELSE coalesce(t.spd, predicted) END AS "t_Synthesized", coalesce(t.dir, predicted_direction) AS "tdir_Synthesized"
FROM tgt_daily t FULL JOIN (SELECT ts, predicted, predicted_direction FROM (SELECT ts FROM ref_daily) LEFT JOIN pv USING (ts) LEFT JOIN turned USING (ts)) USING (ts)""", '"t_Synthesized" "tdir_Synthesized"')
def q73_speedsort_synthesize(s, d):
    params, cut = _speedsort(s, d)
    ref = ref_daily(s, d).select("ts", F.col("spd").alias("r"), "dir")
    tgt = tgt_daily(s, d).select("ts", F.col("spd").alias("t"), F.col("dir").alias("tdir"))
    return R.speedsort_synthesize(ref, tgt, params, "r", "dir", "t", "tdir", cut)


VEERED = """, cu AS (SELECT 0.5 * (6 + 0.5 * avg(r)) AS lr, 0.5 * (6 + 0.5 * avg(t)) AS lt FROM dd), ov AS (SELECT round(avg(CASE WHEN tdir - dir > 180 THEN tdir - dir - 360 WHEN tdir - dir < -180 THEN tdir - dir + 360 ELSE tdir - dir END), 5) AS veer FROM dd, cu WHERE r >= lr AND t >= lt) """


@query(MERGED + VEERED + "SELECT veer FROM ov", "veer")
def q74_overall_veer(s, d):
    return R.overall_veer(_daily(s, d), "r", "t", "dir", "tdir")


@query(MERGED + VEERED + "SELECT ts, CASE WHEN r < 2 AND t > r + 4 THEN CASE WHEN tdir - veer < 0 THEN tdir - veer + 360 WHEN tdir - veer > 360 THEN (tdir - veer) % 360 ELSE tdir - veer END ELSE dir END AS dir FROM dd, ov", "dir")
def q75_speedsort_prepared(s, d):
    return R.speedsort_prepare(_daily(s, d), "r", "t", "dir", "tdir", calms=False).select("ts", "dir")


# ---- shear ----
Z = [80.0, 60.0, 40.0]
U = ["spd80", "spd60", "spd40"]
VALID = "spd80 > 3 AND spd60 > 3 AND spd40 > 3"
MX = "((ln(80) + ln(60) + ln(40)) / 3)"
SXX = f"((ln(80) - {MX}) ** 2 + (ln(60) - {MX}) ** 2 + (ln(40) - {MX}) ** 2)"


def _slope(f: str) -> str:
    return "(" + " + ".join(f"(ln({z:g}) - {MX}) / {SXX} * {f.format(u)}" for z, u in zip(Z, U)) + ")"


ALPHA = _slope("ln({})")
LIN = _slope("{}")
ROUGH = f"exp(-((spd80 + spd60 + spd40) / 3 - {LIN} * {MX}) / {LIN})"
MEANS = "avg(spd80) AS spd80, avg(spd60) AS spd60, avg(spd40) AS spd40"


@query(f"WITH m AS (SELECT {MEANS}, count(*) AS n FROM met_events WHERE {VALID}) SELECT 'power_law' AS method, {ALPHA} AS value, n FROM m UNION ALL SELECT 'log_law', {ROUGH}, n FROM m", "value")
def q80_shear_average(s, d):
    df = met_events(s, d)
    one = lambda m: H.average(df, U, Z, method=m).select(F.lit(m).alias("method"), "value", "n")
    return one("power_law").unionByName(one("log_law"))


def _sector_shear(value: str) -> str:
    return f"WITH m AS (SELECT {SECTOR} AS sector, {MEANS}, count(*) AS n FROM met_events WHERE {VALID} GROUP BY 1) SELECT i::INT AS sector, {value} AS value, coalesce(n, 0) AS n FROM range(1, 13) x(i) LEFT JOIN m ON m.sector = i"


@query(_sector_shear(ALPHA), "value")
def q81_shear_by_sector(s, d):
    return H.by_sector(met_events(s, d), U, Z, "dir")


@query(_sector_shear(ROUGH), "value")
def q81b_shear_by_sector_log(s, d):
    return H.by_sector(met_events(s, d), U, Z, "dir", method="log_law")


SEGMENT = "CAST(floor(((hour(ts) + 24 - 7) % 24) / {0}) AS INT)"


@query(f"WITH m AS (SELECT {SEGMENT.format(6)} AS segment, month(ts)::INT AS month, {MEANS} FROM met_events WHERE {VALID} GROUP BY 1, 2) SELECT segment, month, {ALPHA} AS value FROM m", "value")
def q82_shear_time_of_day(s, d):
    return H.time_of_day(met_events(s, d), U, Z, segments=4)


@query(f"WITH m AS (SELECT {SEGMENT.format(2)} AS segment, month(ts)::INT AS month, {MEANS} FROM met_events WHERE {VALID} GROUP BY 1, 2) SELECT segment, avg({ROUGH}) AS value FROM m GROUP BY 1", "value")
def q83_shear_time_of_day_pooled(s, d):
    return H.time_of_day(met_events(s, d), U, Z, method="log_law", by_month=False, segments=12)


@query(f"SELECT ts, CASE WHEN {VALID} THEN {ALPHA} END AS alpha, CASE WHEN {VALID} THEN {ROUGH} END AS z0 FROM met_h", "alpha z0")
def q84_shear_by_timestamp(s, d):
    df = H.by_timestamp(met_h(s, d), U, Z, name="alpha")
    return H.by_timestamp(df, U, Z, method="log_law", name="z0").select("ts", "alpha", "z0")


@query(f"WITH m AS (SELECT {MEANS} FROM met_events WHERE {VALID}), a AS (SELECT {ALPHA} AS a FROM m), g AS (SELECT {SECTOR} AS sector, {MEANS} FROM met_events WHERE {VALID} GROUP BY 1), q AS (SELECT sector, {ALPHA} AS b FROM g) SELECT ts, spd80 * pow(100.0 / 80, a) AS average, spd80 * pow(100.0 / 80, b) AS by_sector FROM a, (SELECT *, {SECTOR} AS sector FROM met_h) LEFT JOIN q USING (sector)", "average by_sector")
def q85_shear_apply(s, d):
    df, ev = met_h(s, d), met_events(s, d)
    out = H.apply_average(df, "spd80", 80, 100, H.average(ev, U, Z), name="average")
    return H.apply_by_sector(out, "spd80", "dir", 80, 100, H.by_sector(ev, U, Z, "dir"), name="by_sector").select("ts", "average", "by_sector")


@query(f"WITH m AS (SELECT {SEGMENT.format(6)} AS segment, month(ts)::INT AS month, {MEANS} FROM met_events WHERE {VALID} GROUP BY 1, 2), a AS (SELECT segment, month, {ALPHA} AS a FROM m) SELECT ts, spd80 * pow(100.0 / 80, a) AS scaled FROM (SELECT *, {SEGMENT.format(6)} AS segment, month(ts)::INT AS month FROM met_h) LEFT JOIN a USING (segment, month)", "scaled")
def q86_shear_apply_time_of_day(s, d):
    return H.apply_time_of_day(met_h(s, d), "spd80", 80, 100, H.time_of_day(met_events(s, d), U, Z, segments=4), segments=4, name="scaled").select("ts", "scaled")


@query("SELECT ts, spd80 * pow(120.0 / 80, 0.2) AS power, spd80 * ln(120 / 0.03) / ln(80 / 0.03) AS log FROM met_h", "power log")
def q87_shear_scale(s, d):
    return met_h(s, d).select("ts", S.power_scale(F.col("spd80"), 80, 120, 0.2).alias("power"), S.log_scale(F.col("spd80"), 80, 120, 0.03).alias("log"))


# ---- stations, tables, geography ----
def _models(s, d):
    return M.models(station_docs(s, d), "text", "model")


KIND = "CASE o_orderstatus WHEN 'F' THEN 'mast' WHEN 'O' THEN 'lidar' ELSE 'sodar' END"
LINED = "SELECT DISTINCT l_orderkey FROM lineitem"


@query(f"""SELECT o_orderkey AS model, 0 AS location, 'S' || o_orderkey AS name, {KIND} AS measurement_station_type_id, (o_orderkey % 181 - 90)::VARCHAR AS latitude_ddeg, 'own' AS notes,
 CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS mast_geometry_id, CASE WHEN o_orderstatus = 'F' THEN 'n' END AS mast_notes,
 CASE WHEN o_orderstatus <> 'F' THEN (o_orderkey % 9)::VARCHAR END AS device_datum_plane_height_m, CASE WHEN o_orderstatus <> 'F' THEN 'v' END AS profiler_notes
 FROM orders WHERE o_orderkey IN ({LINED})""")
def q90_station_header(s, d):
    rows = M.properties(_models(s, d))
    return J.horizontal(rows, ["name", "measurement_station_type_id", "latitude_ddeg", "notes", "mast_geometry_id", "mast_properties.notes", "device_datum_plane_height_m", "vertical_profiler_properties.notes"], ["model", "location"], titles={"mast_properties.notes": "mast_notes", "vertical_profiler_properties.notes": "profiler_notes"})


STRETCHES = """SELECT l_orderkey AS model, (row_number() OVER (PARTITION BY l_orderkey, step ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate) - 1)::INT AS point, 'P' || l_linenumber AS name, l_quantity AS height_m, l_discount AS slope,
 l_shipdate + to_days(a) AS date_from, CASE WHEN b IS NOT NULL THEN l_shipdate + to_days(b) END AS date_to, CASE WHEN step < 3 THEN l_suppkey ELSE l_partkey END::VARCHAR AS serial_number,
 CASE WHEN step < 3 THEN l_tax END AS calibration_slope, CASE WHEN step > 1 THEN (l_partkey % 360)::VARCHAR END AS boom, l_returnflag, l_tax
 FROM lineitem, (VALUES (1, 0, 5), (2, 5, 20), (3, 20, NULL)) t(step, a, b) WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""


@query(f"SELECT model, point, name, height_m, slope, date_from, date_to, serial_number, calibration_slope, boom FROM ({STRETCHES})", "height_m slope calibration_slope")
def q91_station_measurements(s, d):
    got = lambda k: J.text(F.try_element_at("props", F.lit(k)))
    return M.measurements(_models(s, d)).select("model", "point", got("name").alias("name"), got("height_m").cast("double").alias("height_m"), got("logger_measurement_config.slope").cast("double").alias("slope"), "date_from", "date_to", got("sensor.serial_number").alias("serial_number"), got("calibration.slope").cast("double").alias("calibration_slope"), got("boom_orientation_deg").alias("boom"))


@query(f"SELECT o_orderkey AS model, w.name, height_m FROM orders CROSS JOIN (VALUES ('P1'), ('P3'), ('none')) w(name) LEFT JOIN (SELECT l_orderkey, 'P' || l_linenumber AS name, arg_min(l_quantity, (l_partkey, l_suppkey, l_quantity)) AS height_m FROM lineitem GROUP BY ALL) p ON p.l_orderkey = o_orderkey AND p.name = w.name WHERE o_orderkey IN ({LINED})")
def q92_station_heights(s, d):
    return M.heights(_models(s, d), ["P1", "P3", "none"])


@query(f"SELECT model, name, boom AS boom_orientation_deg, min(date_from) AS date_from, CASE WHEN count(date_to) = count(*) THEN max(date_to) END AS date_to FROM ({STRETCHES}) WHERE boom IS NOT NULL GROUP BY ALL")
def q90b_station_table(s, d):
    """The table of mountings: stretches in which they don't change are one row."""
    return M.measurement_table(M.measurements(_models(s, d)), ["boom_orientation_deg", "no_such_field"])


@query(f"""SELECT o_orderkey AS model, f.property, f.property || '!' AS title, CASE f.property WHEN 'author' THEN o_orderpriority ELSE '1.3' END AS value
 FROM orders CROSS JOIN (VALUES ('author'), ('version')) f(property) WHERE o_orderkey IN ({LINED})""")
def q92b_vertical_view(s, d):
    return J.vertical(M.header(_models(s, d)), ["model"], titles={"author": "author!", "version": "version!"})


# ---- documents of any shape ----
@query("""SELECT '$.' || key AS path, CASE json_type(value) WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' ELSE lower(json_type(value)) END AS kind, count(*) AS n
 FROM (SELECT unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract(props, '$.' || key) AS value) GROUP BY ALL""")
def q99_document_paths(s, d):
    return J.paths(table(s, d, "events").select("event_id", J.parsed("props").alias("doc")), "doc")


@query("""WITH n AS (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
 SELECT '$.measurement_location[].measurement_point[].' || p.path AS path, p.kind, p.times * n.n AS n FROM n, (VALUES ('sensor', 'array', 1), ('sensor[]', 'object', 2), ('sensor[].oem', 'string', 2), ('sensor[].serial_number', 'string', 2),
 ('sensor[].date_from', 'string', 2), ('sensor[].date_to', 'string', 1), ('sensor[].date_to', 'null', 1), ('sensor[].calibration', 'array', 2), ('sensor[].calibration[]', 'object', 1), ('sensor[].calibration[].slope', 'number', 1), ('sensor[].calibration[].offset', 'number', 1)) p(path, kind, times)""")
def q99b_nested_paths(s, d):
    return J.paths(_models(s, d), "doc", 9).where(F.col("path").contains(".sensor"))


PROPS_SCHEMA = {"type": "object", "required": ["k", "z"], "properties": {"k": {"type": "integer", "maximum": 89, "multipleOf": 2, "not": {"const": 13}}, "z": {"type": "string"}}, "additionalProperties": False}


@query("""SELECT event_id, CASE WHEN rule = 'required' THEN '$' ELSE '$.k' END AS path, rule FROM (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
 (VALUES ('required'), ('maximum'), ('multipleOf'), ('not')) r(rule)
 WHERE CASE rule WHEN 'required' THEN true WHEN 'maximum' THEN k > 89 WHEN 'multipleOf' THEN k % 2 = 1 ELSE k = 13 END""")
def q100_schema_violations(s, d):
    return J.violations(table(s, d, "events").select("event_id", "props"), "props", PROPS_SCHEMA).select("event_id", "path", "rule")


MODEL_SCHEMA = {
    "type": "object", "definitions": {"slope": {"type": "number", "maximum": 0.07}},
    "properties": {"author": {"enum": ["1-URGENT", "2-HIGH", "5-LOW"]}, "measurement_location": {"items": {"oneOf": [{"required": ["mast_properties"], "properties": {"mast_properties": {"type": "object"}}}, {"properties": {"vertical_profiler_properties": {"type": "array", "items": {"properties": {"device_datum_plane_height_m": {"exclusiveMaximum": 8}}}}}}],
        "properties": {"name": {"pattern": "^S\\d*[0-8]$"}, "measurement_point": {"maxItems": 6, "items": {"properties": {"sensor": {"items": {"properties": {"calibration": {"items": {"properties": {"slope": {"$ref": "#/definitions/slope"}}}}}}}}}}}}},
    },
}


@query("""WITH o AS (SELECT o_orderkey AS model, o_orderpriority AS author, o_orderstatus AS status, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
 p AS (SELECT l_orderkey AS model, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS i, l_tax FROM lineitem WHERE l_orderkey IN (SELECT model FROM o))
 SELECT model, '$.author' AS path, 'enum' AS rule FROM o WHERE author NOT IN ('1-URGENT', '2-HIGH', '5-LOW')
 UNION ALL SELECT model, '$.measurement_location[0].name', 'pattern' FROM o WHERE model % 10 = 9
 UNION ALL SELECT model, '$.measurement_location[0].measurement_point', 'maxItems' FROM o WHERE n > 6
 UNION ALL SELECT model, '$.measurement_location[0]', 'oneOf' FROM o WHERE status <> 'F' AND model % 9 = 8
 UNION ALL SELECT model, '$.measurement_location[0].measurement_point[' || i || '].sensor[0].calibration[0].slope', 'maximum' FROM p WHERE l_tax > 0.07""")
def q100b_nested_violations(s, d):
    return J.violations(station_docs(s, d), "text", MODEL_SCHEMA).select("model", "path", "rule")


@query(_freq_sql("met_events", "coalesce(1000.0 * n / sum(n) OVER (PARTITION BY dim.sector), 0)"), "value")
def q93_tab_per_mille(s, d):
    return per_mille(D.freq_table(met_events(s, d), "spd80", "dir"))


NODES = "SELECT c_custkey AS node, (c_custkey % 181) - 90.0::DOUBLE AS latitude, (c_custkey * 7 % 360) - 180.0::DOUBLE AS longitude FROM customer"
HAV = "pow(sin(radians(latitude - 10) / 2), 2) + cos(radians(10)) * cos(radians(latitude)) * pow(sin(radians(longitude - 20) / 2), 2)"


@query(f"SELECT node, latitude, longitude, 2 * 6371 * atan2(sqrt({HAV}), sqrt(1 - ({HAV}))) AS distance_km FROM ({NODES}) WHERE latitude BETWEEN -20 AND 40 AND longitude BETWEEN -10 AND 50 ORDER BY distance_km, latitude, longitude LIMIT 4", "distance_km")
def q94_nearest_nodes(s, d):
    key = F.col("c_custkey")
    nodes = table(s, d, "customer").select(key.alias("node"), (key % 181 - 90.0).alias("latitude"), (key * 7 % 360 - 180.0).alias("longitude"))
    return G.nearest(nodes, 10, 20, 4, 30)


SPANS = "SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS child_pos, l_shipdate AS date_from, l_shipdate + to_days(l_quantity::INT // 4) AS date_to FROM lineitem"


@query(f"SELECT a.l_suppkey, a.child_pos AS pos_a, b.child_pos AS pos_b FROM ({SPANS}) a JOIN ({SPANS}) b ON a.l_suppkey = b.l_suppkey AND a.child_pos < b.child_pos AND a.date_from < b.date_to AND b.date_from < a.date_to")
def q95_overlaps(s, d):
    end = F.col("l_shipdate") + F.make_dt_interval(F.floor(F.col("l_quantity") / 4).cast("int"))
    spans = table(s, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("child_pos"), F.col("l_shipdate").alias("date_from"), end.alias("date_to"))
    return M.overlaps(spans, "l_suppkey")


@query("SELECT i::DOUBLE AS speed, avg(spd80_std / spd80) AS ti, 0.16 * (0.75 + 5.6 / i) AS class_a, 0.14 * (0.75 + 5.6 / i) AS class_b, 0.12 * (0.75 + 5.6 / i) AS class_c FROM met_events, LATERAL (SELECT CAST(floor(spd80 + 0.5) AS INT) AS i) WHERE i BETWEEN 1 AND 25 GROUP BY i", "ti class_a class_b class_c")
def q96_iec_curves(s, d):
    """Mean turbulence intensity at each speed beside the classes' curves."""
    seen = met_events(s, d).groupBy(F.floor(F.col("spd80") + 0.5).cast("double").alias("speed")).agg(F.avg(F.try_divide("spd80_std", "spd80")).alias("ti"))
    return D.iec_curves(s).join(seen, "speed")


@query(_freq_sql("met_events", "coalesce(100.0 * n / total, 0)").replace("SELECT dim.bin, bin_left", ", f AS (SELECT dim.bin, bin_left", 1) + ") SELECT p.i::INT AS plot_bin, sector, sum(value) AS value FROM f JOIN (SELECT i, [0, 3, 6, 9, 12, 15, 41][i] AS a, [0, 3, 6, 9, 12, 15, 41][i + 1] AS b FROM range(1, 7) t(i)) p ON bin_left < b AND bin_right > a GROUP BY ALL", "value")
def q97_plot_bins(s, d):
    return D.plot_bins(D.freq_table(met_events(s, d), "spd80", "dir"), [0, 3, 6, 9, 12, 15, 41])


@query("SELECT event_type, CAST(floor(spd80 / 5) AS INT) AS k, quantile_cont(spd80, 0.75) AS p75, avg(temp) + 2 * stddev_samp(temp) AS custom FROM met_events GROUP BY ALL HAVING count(*) > 1", "p75 custom")
def q98_callable_aggregates(s, d):
    k = F.floor(F.col("spd80") / 5).cast("int")
    custom = lambda c: F.avg(c) + 2 * F.stddev_samp(c)
    return met_events(s, d).groupBy("event_type", k.alias("k")).agg(quantile(0.75)(F.col("spd80")).alias("p75"), custom(F.col("temp")).alias("custom"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


# ---- selection, Python aggregates, as-of joins ----
@query("SELECT event_type, CAST(floor(spd80 / 5) AS INT) AS k, quantile_cont(temp, 0.1) AS p10, median(temp) AS p50, quantile_cont(temp, 0.999) AS p999 FROM met_events GROUP BY ALL", "p10 p50 p999")
def q101_quantiles_by_selection(s, d):
    rows = met_events(s, d).withColumn("k", F.floor(F.col("spd80") / 5).cast("int"))
    return group_quantiles(rows, ["event_type", "k"], "temp", {"p10": 0.1, "p50": 0.5, "p999": 0.999})


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS lower, quantile_cont(l_extendedprice, 0.95) AS upper FROM lineitem GROUP BY 1", "lower upper")
def q101b_large_groups(s, d):
    """A bound that the three groups are far beyond, so that they are cut down pass by pass."""
    return group_quantiles(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"lower": 0.25, "upper": 0.95}, most=200)


@query("SELECT date_trunc('day', ts) AS ts, avg(temp) + 2 * stddev_samp(temp) AS temp FROM met_events GROUP BY 1", "temp")
def q102_python_aggregate(s, d):
    """The same as the Column callable lambda c: F.avg(c) + 2 * F.stddev_samp(c)."""
    return P.average_by_period(met_events(s, d), "1D", ["temp"], method=python_aggregate(lambda v: v.mean() + 2 * v.std()), data_resolution="1h")


@query("SELECT l_suppkey, sqrt(sum(l_quantity * l_quantity) / count(*)) AS value FROM lineitem GROUP BY 1", "value")
def q102b_folded_aggregate(s, d):
    """Root mean square of each supplier's quantities, by states of two numbers."""
    return fold(table(s, d, "lineitem"), ["l_suppkey"], "l_quantity", lambda: (0.0, 0), lambda a, v: (a[0] + float((v * v).sum()), a[1] + len(v)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a: (a[0] / a[1]) ** 0.5 if a[1] else None)


PURCHASES = "SELECT user_id, ts, max(value) AS amount FROM events WHERE event_type = 'purchase' GROUP BY ALL"


@query(f"SELECT l.event_id, l.ts, l.user_id, r.ts AS ts_right, r.amount FROM events l ASOF LEFT JOIN ({PURCHASES}) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def q103_asof_backward(s, d):
    """Each event with the last purchase of its user."""
    e = table(s, d, "events")
    return asof(e.select("event_id", "ts", "user_id"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("amount")), ["user_id"])


@query("SELECT l.o_orderkey, l.ts, r.ts AS ts_right, r.line FROM (SELECT o_orderkey, o_orderdate AS ts FROM orders) l ASOF LEFT JOIN (SELECT l_shipdate AS ts, max(l_orderkey) AS line FROM lineitem GROUP BY 1) r ON l.ts <= r.ts")
def q103b_asof_forward(s, d):
    """Each order with the next day on which anything is shipped; days are few, so buckets are months."""
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return asof(orders, table(s, d, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("line")), direction="forward", bucket="month")


@query(f"""WITH p AS ({PURCHASES}), x AS (SELECT l.event_id, l.ts, l.user_id, b.ts AS bt, b.amount AS ba, a.ts AS at_, a.amount AS aa FROM events l
 ASOF LEFT JOIN p b ON l.user_id = b.user_id AND l.ts >= b.ts ASOF LEFT JOIN p a ON l.user_id = a.user_id AND l.ts <= a.ts),
 y AS (SELECT *, bt IS NULL OR (at_ IS NOT NULL AND at_ - ts < ts - bt) AS later FROM x),
 z AS (SELECT event_id, ts, user_id, CASE WHEN later THEN at_ ELSE bt END AS ts_right, CASE WHEN later THEN aa ELSE ba END AS amount FROM y)
 SELECT event_id, ts, user_id, CASE WHEN abs(epoch_us(ts) - epoch_us(ts_right)) <= 86400000000 THEN ts_right END AS ts_right, CASE WHEN abs(epoch_us(ts) - epoch_us(ts_right)) <= 86400000000 THEN amount END AS amount FROM z""")
def q103c_asof_nearest(s, d):
    e = table(s, d, "events")
    return asof(e.select("event_id", "ts", "user_id"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("amount")), ["user_id"], direction="nearest", within="1 day")


# ---- fits applied ----
@query(LAGGED + "SELECT ts, mt - b0 * mr - b1 * m1 + b0 * r + b1 * r1 AS predicted FROM x, s", "predicted")
def q104_predict_multiple(s, d):
    m = _lagged(s, d)
    return R.predict_multiple(m, R.multiple(m, ["r", "r1"], "t"), ["r", "r1"]).select("ts", "predicted")


@query(LAGGED + ", e AS (SELECT t, mt - b0 * mr - b1 * m1 + b0 * r + b1 * r1 AS p FROM x, s) SELECT 1 - sum((t - p) * (t - p)) / (count(*) * var_pop(t)) AS r2 FROM e", "r2")
def q104b_r2_multiple(s, d):
    m = _lagged(s, d)
    return R.fit_r2_multiple(m, R.multiple(m, ["r", "r1"], "t"), ["r", "r1"], "t")


@query(LAGGED + """, late AS (SELECT * FROM x WHERE ts >= TIMESTAMP '1996-01-01'), cl AS (SELECT covar_pop(r, r) AS a, covar_pop(r1, r1) AS b, covar_pop(r, r1) AS k, covar_pop(r, t) AS p, covar_pop(r1, t) AS q, avg(r) AS mr, avg(r1) AS m1, avg(t) AS mt FROM late),
 sl AS (SELECT *, (p * b - q * k) / (a * b - k * k) AS b0, (q * a - p * k) / (a * b - k * k) AS b1 FROM cl)
 SELECT ts, mt - b0 * mr - b1 * m1 + b0 * r + b1 * r1 AS "t_Synthesized" FROM x, sl WHERE ts < (SELECT min(ts) FROM late) UNION ALL SELECT ts, t FROM late""", '"t_Synthesized"')
def q104c_synthesize_multiple(s, d):
    m = _lagged(s, d)
    return R.synthesize_multiple(m, m.where(F.col("ts") >= F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz")), ["r", "r1"], "t")


@query(MERGED + """, v AS (SELECT var_pop(r) AS sxx, var_pop(t) AS syy, covar_pop(t, r) AS sxy, avg(r) AS mx, avg(t) AS my FROM mm),
b AS (SELECT *, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) AS slope FROM v) SELECT ts, slope * r + my - slope * mx AS predicted FROM mm, b""", "predicted")
def q104d_predict_orthogonal(s, d):
    m = _merged(s, d)
    return R.predict(m, R.orthogonal(m, "r", "t"), "r").select("ts", "predicted")


@query("SELECT a.ts, a.spd AS spd_0, b.spd AS spd_1, a.dir AS dir FROM ref_daily a JOIN tgt_daily b USING (ts)", "spd_0 spd_1 dir")
def q104e_merge_references(s, d):
    return R.merge_references([ref_daily(s, d), tgt_daily(s, d).select("ts", "spd")])


@query(f"SELECT hour(ts)::INT AS hour, month(ts)::INT AS month, avg({ALPHA}) AS value FROM met_h WHERE {VALID} GROUP BY ALL", "value")
def q105_shear_12x24(s, d):
    return H.table_12x24_of(met_h(s, d), U, Z)


@query(f"SELECT ts, CASE WHEN {VALID} THEN spd80 * pow(100.0 / 80, {ALPHA}) END AS scaled FROM met_h", "scaled")
def q105b_shear_apply_by_timestamp(s, d):
    return H.apply_by_timestamp(H.by_timestamp(met_h(s, d), U, Z), "spd80", 80, 100, name="scaled").select("ts", "scaled")


def _profile_sql(power: bool) -> str:
    speed, slope = ("exp(k) * pow(h, a)", ALPHA) if power else ("a * ln(h) + k", LIN)
    mean = "(ln(spd80) + ln(spd60) + ln(spd40)) / 3" if power else "(spd80 + spd60 + spd40) / 3"
    return f"WITH m AS (SELECT {MEANS} FROM met_events WHERE {VALID}), f AS (SELECT {slope} AS a, {mean} - {slope} * {MX} AS k FROM m) SELECT h::DOUBLE AS height, {speed} AS speed FROM f, range(1, 121) t(h)"


@query(_profile_sql(True), "speed")
def q105c_power_profile(s, d):
    return H.profile(H.average(met_events(s, d), U, Z))


@query(_profile_sql(False), "speed")
def q105d_log_profile(s, d):
    return H.profile(H.average(met_events(s, d), U, Z, method="log_law"), "log_law")
