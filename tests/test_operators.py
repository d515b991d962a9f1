from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anemos.functions import bins as B
from anemos.functions import scalar as S
from anemos.functions import timeaxis as T
from anemos.operators import calibrate as C
from anemos.operators import correl as R
from anemos.operators import dist as D
from anemos.operators import geo as G
from anemos.operators import period as P
from anemos.operators import shear as H
from anemos.sources import readers, writers

DAY = timedelta(days=1)


def series(spark, values, start=datetime(2016, 1, 9, 15, 30), step=timedelta(minutes=10), name="spd"):
    return spark.createDataFrame([(start + i * step, None if v is None else float(v)) for i, v in enumerate(values)], f"ts timestamp_ntz, {name} double")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_period_names():
    assert T.Period.parse("10min") == T.Period(micros=600_000_000) == T.Period.parse("10T")
    assert T.Period.parse("2W") == T.Period.parse("14D") == T.Period.parse("336H")
    assert T.Period.parse("3M") == T.Period(months=3) and T.Period.parse("AS") == T.Period(months=12)
    with pytest.raises(ValueError):
        T.Period.parse("3 parsecs")


def test_days_start_at_the_midnight_of_the_first_row(spark):
    df = series(spark, range(300))
    out = P.average_by_period(df, "7D").collect()
    assert out[0]["ts"] == datetime(2016, 1, 9)
    assert P.average_by_period(df, "3H", return_coverage=True).orderBy("ts").first()["spd_coverage"] == pytest.approx(15 / 18)
    with pytest.raises(ValueError):
        P.average_by_period(df, "5min")
    with pytest.raises(TypeError):
        P.average_by_period(df, "1D", coverage_threshold=1.2)


def test_quarters_start_at_the_first_month(spark):
    df = series(spark, range(200), datetime(2016, 2, 10), DAY)
    assert [r["ts"].month for r in P.average_by_period(df, "3M").orderBy("ts").collect()] == [2, 5, 8]


def test_empty_periods(spark):
    df = series(spark, [1, 2], datetime(2016, 1, 1), 3 * DAY)
    for method, empty in (("sum", 0.0), ("prod", 1.0), ("mean", None), ("count", 0)):
        got = [r["spd"] for r in P.average_by_period(df, "1D", method=method, data_resolution="1D").orderBy("ts").collect()]
        assert got[1] == got[2] == empty and len(got) == 4


def test_resolution_and_gaps(spark):
    df = series(spark, range(500)).where("minute(ts) <> 10 OR hour(ts) <> 3")
    assert T.resolution(df) == T.Period(micros=600_000_000)
    gaps = T.continuity_gaps(df).collect()
    assert all(g["days_lost"] == pytest.approx(1 / 144) for g in gaps) and len(gaps) >= 3
    months = spark.createDataFrame([(datetime(2020, m, 1), 1.0) for m in (1, 2, 3, 4, 7, 8)], "ts timestamp_ntz, v double")
    assert T.resolution(months) == T.Period(months=1)
    assert [g["date_from"] for g in T.continuity_gaps(months).collect()] == [datetime(2020, 4, 1)]


def test_vector_mean(spark):
    mean = lambda *d: spark.createDataFrame([(float(x),) for x in d], "d double").agg(S.circular_mean(F.col("d")).alias("v")).first()["v"]
    assert mean(350, 10) == pytest.approx(0, abs=1e-6) or mean(350, 10) == pytest.approx(360)
    assert mean(0, 180) is None and mean(90, 180) == pytest.approx(135)
    assert value(spark, S.row_circular_mean([F.lit(15.0), F.lit(25.0), F.lit(None).cast("double")])) == pytest.approx(20)


def test_wrap(spark):
    assert [value(spark, S.wrap(F.lit(float(d)))) for d in (-10, 0, 360, 370, 730, -370)] == [350, 0, 360, 10, 10, -10]


def test_sectors(spark):
    got = [value(spark, B.sector(F.lit(float(d)))) for d in (0, 14.9, 15, 344.9, 345, 359, 360)]
    assert got == [1, 1, 2, 12, 1, 1, 1]
    assert [value(spark, B.sector(F.lit(float(d)), edges=[0, 90, 130, 200, 360])) for d in (0, 90, 360)] == [1, 2, 4]
    assert B.sector_labels(12)[0] == "345.0-15.0" and B.direction_edges(4) == [0, 45, 135, 225, 315, 360]


def test_default_edges_can_leave_out_the_maximum():
    assert B.dist_edges(0.2, 29.0)[-1] == 28.5 and B.dist_edges(0.2, 29.2)[-1] == 29.5 and B.dist_edges(0.2, 28.7)[-1] == 28.5


def test_selective_average(spark):
    pick = lambda a, b, d: value(spark, S.selective_average(F.lit(a).cast("double"), F.lit(b).cast("double"), F.lit(d).cast("double"), 315, 135))
    assert (pick(1, 2, 135), pick(1, 2, 315), pick(1, 2, 45), pick(None, 2, 135), pick(1, None, 135), pick(1, 2, None)) == (2, 1, 1.5, 2, 1, 1.5)
    with pytest.raises(ValueError):
        S.selective_average(F.lit(1.0), F.lit(1.0), F.lit(1.0), 10, 40)


def test_scalars(spark):
    assert value(spark, S.adjust_slope_offset(F.lit(10.0), 0.045, 0.235, 0.046, 0.236)) == pytest.approx(0.046 * ((10 - 0.235) / 0.045) + 0.236)
    assert value(spark, S.air_density(F.lit(15.0), F.lit(1013.0))) == pytest.approx(1.2254, abs=1e-3)
    with pytest.raises(TypeError):
        S.air_density(F.lit(1.0), F.lit(1.0), 10)
    assert value(spark, S.haversine_km(F.lit(52.2296756), F.lit(21.0122287), F.lit(52.406374), F.lit(16.9251681))) == pytest.approx(278.4582, abs=1e-3)
    with pytest.raises(TypeError):
        S.adjust_slope_offset(F.lit(1.0), "1", 0, 1, 0)


def test_shear_fits_recover_their_laws(spark):
    rows = spark.createDataFrame([(datetime(2020, 1, 1), *[8 * (z / 80) ** 0.2 for z in (80, 60, 40)], 10.0)], "ts timestamp_ntz, a double, b double, c double, dir double")
    z = [80.0, 60.0, 40.0]
    assert H.average(rows, ["a", "b", "c"], z).first()["value"] == pytest.approx(0.2)
    assert H.by_timestamp(rows, ["a", "b", "c"], z).first()["shear"] == pytest.approx(0.2)
    assert [r["value"] for r in H.by_sector(rows, ["a", "b", "c"], z, "dir").orderBy("sector").collect()][:2] == [pytest.approx(0.2), None]
    import math

    log = spark.createDataFrame([tuple(0.5 * math.log(h / 0.03) for h in z)], "a double, b double, c double")
    assert H.average(log, ["a", "b", "c"], z, method="log_law").first()["value"] == pytest.approx(0.03)
    with pytest.raises(ValueError):
        H.average(log, ["a", "b"], z)
    assert H.hours_of(H.time_of_day(rows, ["a", "b", "c"], z, by_month=False, segments=4), 4).count() == 72


def test_fits_on_a_line(spark):
    rows = [(datetime(2020, 1, 1) + i * DAY, float(i % 17 + 3), 2.0 * (i % 17 + 3) + 1, float(i * 7 % 360)) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double, y double, dir double")
    for f in (R.ols, R.orthogonal):
        p = f(df, "x", "y").first()
        assert (p["slope"], p["offset"], p["n"]) == (pytest.approx(2), pytest.approx(1), 200)
    assert {r["term"]: round(r["value"], 6) for r in R.multiple(df.withColumn("z", F.col("dir")), ["x", "z"], "y").collect()} == {"offset": 1, "x": 2, "z": 0}
    assert R.fit_r2(df, R.ols(df, "x", "y"), "x", "y").first()["r2"] == pytest.approx(1)
    s = R.speedsort_fit(df.withColumn("d2", F.col("dir")), "x", "y", "dir", "d2", 4.0).collect()
    assert len(s) == 12 and all(r["veer"] in (None, 0.0) for r in s)


def test_direction_prediction_with_missing_sectors(spark):
    params = spark.createDataFrame([(1, 10.0), (2, 20.0), (4, -40.0)], "sector int, veer double")
    df = spark.createDataFrame([(float(d),) for d in (0, 15, 30, 40, 50, 80, 95, 110, 350, 340)], "dir double")
    got = [r["predicted_direction"] for r in R.predict_direction(df, params, "dir").collect()]
    assert got == [10, 30, 50, 60, None, 40, 55, None, 360, None] or got == [10, 30, 50, 60, None, 40, 55, None, 0, None]


def test_cleaning_folds_and_joins_alike(spark):
    df = series(spark, range(200), name="Spd80mN").withColumn("Dir", F.lit(1.0))
    t = datetime(2016, 1, 9, 16)
    log = spark.createDataFrame([("Spd80", t, t + timedelta(hours=3)), ("All", None, datetime(2016, 1, 9, 15, 50)), ("Dir", t + DAY, None), (None, t, t)], "sensor string, date_from timestamp_ntz, date_to timestamp_ntz")
    a, b = C.apply_log(df, log), C.apply_log(df, log, fold=0)
    assert a.exceptAll(b).count() == 0 and a.where("Spd80mN IS NULL").count() == 20
    with pytest.raises(ValueError):
        C.apply_rules(df, [{"rule": {"clean_out": []}}])
    rules = [{"rule": {"clean_out": [{"assembled_column_name": "Dir"}], "conditions": {"and": [{"assembled_column_name": "Spd80mN", "comparator_value": 5, "comparison_operator_id": 3}, {"not": {"assembled_column_name": "Spd80mN", "comparator_value": 10, "comparison_operator_id": 4}}]}}}]
    assert C.apply_rules(df, rules).where("Dir IS NULL").count() == 4


def test_target_mean(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1) + i * DAY, 4 + (i * 37 % 100) / 20, float(i * 11 % 360)) for i in range(366)], "ts timestamp_ntz, s double, d double")
    assert D.table_mean(D.freq_table(df, "s", "d", target_mean=7.5)).first()[0] == pytest.approx(7.5, rel=2e-3)


def test_nearest(spark):
    nodes = spark.createDataFrame([(50.0, 0.0), (50.5, 0.5), (51.0, 1.0), (60.0, 1.0)], "latitude double, longitude double")
    assert [r["latitude"] for r in G.nearest(nodes, 50.1, 0.1, 2).collect()] == [50.0, 50.5]
    with pytest.raises(ValueError):
        G.nearest(nodes, 1, 1, 17)


def test_nearest_of_nodes_in_one_place(spark):
    nodes = spark.range(2000).select(((F.lit(1999) - F.col("id")) * 7 % 2000).alias("node"), F.lit(50.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.create_map(F.lit("a"), "id").alias("m"))
    assert [r["node"] for r in G.nearest(nodes.repartition(7), 50.1, 0.1, 4).collect()] == [0, 1, 2, 3]


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.csv").write_text("Timestamp,Spd,Site\n2016-01-09 15:30,5.1,A\n2016-01-09T15:40:00Z,NaN,A\n")
    (tmp_path / "a/y.csv").write_text("Timestamp,Spd,Site\n2016-01-09 15:50:00,x,B\n")
    got = readers.read_csv(spark, str(tmp_path / "a"), strings=("Site",)).orderBy("ts").collect()
    assert [(r["ts"].minute, r["Spd"], r["Site"]) for r in got] == [(30, 5.1, "A"), (40, None, "A"), (50, None, "B")]
    (tmp_path / "a/z.csv").write_text("Timestamp,Spd,Site\n2016-01-09 15:50:00,1,B\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "a"), strings=("Site",))
    (tmp_path / "w.txt").write_text("Windographer\n\nDate/Time\tSpd 80m\tDir\t\n2016-01-09 15:30\t5.5\t9999\t\n2016-01-09 15:40\t19999\t10\t\n")
    got = readers.read_windographer(spark, str(tmp_path / "w.txt")).orderBy("ts").collect()
    assert [(r["Spd 80m"], r["Dir"]) for r in got] == [(5.5, None), (19999.0, 10.0)]
    (tmp_path / "c.dat").write_text('"TOA5","x"\n"TIMESTAMP","RECORD","Spd"\n"TS","RN","m/s"\n"","","Avg"\n"2016-01-09 15:30:00",1,5.5\n')
    assert readers.read_campbell(spark, str(tmp_path / "c.dat")).first()["Spd"] == 5.5
    (tmp_path / "q.dat").write_text('"TOA5","x"\n"TIMESTAMP","Note","Spd"\n"TS","","m/s"\n"","","Avg"\n"2016-01-09 15:30:00","calm, cold","6.5"\n')
    row = readers.read_campbell(spark, str(tmp_path / "q.dat"), strings=("Note",)).first()
    assert (row["Note"], row["Spd"]) == ("calm, cold", 6.5)
    (tmp_path / "log.csv").write_text("Sensor,Start,Stop,Reason\nAll,09/01/2016 15:30,,x\nSpd,2016-01-09 15:30:00,2016-01-10,y\n")
    log = readers.read_log(spark, str(tmp_path / "log.csv"), extra={"reason": "Reason"}, day_first=True).collect()
    assert log[0]["date_from"] == datetime(2016, 1, 9, 15, 30) and log[0]["date_to"] is None and log[1]["date_to"] == datetime(2016, 1, 10)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2020, 1, 1) + i * DAY, float(i % 12), float(i * 30 % 360)) for i in range(360)], "ts timestamp_ntz, s double, d double")
    text = writers.tab_text(D.freq_table(df, "s", "d"), 80, 53.5, -7.5)
    body = text.splitlines()[4:]
    writers.write_tab(D.freq_table(df, "s", "d"), str(tmp_path / "site.tab"), 80, 53.5, -7.5)
    assert (tmp_path / "site.tab").read_text().splitlines()[1:] == text.splitlines()[1:]
    assert len(body) == 41 and text.splitlines()[1] == "53.50 -7.50 80.00"
    for k in range(1, 13):
        assert sum(float(line.split()[k]) for line in body) == pytest.approx(1000, abs=0.1)
    writers.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 360


def test_streaming(spark, tmp_path):
    from anemos.streaming.period import stream_average

    series(spark, range(36), datetime(2016, 1, 9)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, spd double").parquet(str(tmp_path / "in"))
    q = stream_average(stream, "1 hour", ["spd"], 6).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("hours").orderBy("ts").collect()
    assert [r["spd"] for r in rows] == [2.5 + 6 * i for i in range(6)] and rows[0]["spd_coverage"] == 1


def test_known_values(spark):
    one = spark.createDataFrame([(7.74, 8.2, 8.57)], "a double, b double, c double")
    assert H.average(one, ["a", "b", "c"], [60, 80, 100]).first()["value"] == pytest.approx(0.199474297, abs=1e-8)
    two = spark.createDataFrame([(8.0, 8.365116)], "a double, b double")
    assert H.average(two, ["a", "b"], [80, 100]).first()["value"] == pytest.approx(0.2, abs=1e-6)
    assert H.average(two, ["a", "b"], [80, 100], method="log_law").first()["value"] == pytest.approx(0.602156994, abs=1e-6)
    assert value(spark, S.adjust_slope_offset(F.lit(8.0), 0.045, 0.235, 0.046, 0.236)) == pytest.approx(8.17355, abs=1e-4)
    got = [value(spark, S.offset_direction(F.lit(d).cast("double"), 345)) for d in (10.0, 30.0, None, 40.0, 350.0)]
    assert got == [355, 15, None, 25, 335]
    assert value(spark, S.air_density(F.lit(15.0), F.lit(1013.0), 0, 200)) == pytest.approx(1.203, abs=1e-3)
    d = spark.createDataFrame([(15.0, 3.0), (None, 4.0), (25.0, 5.0)], "d double, s double")
    assert d.agg(S.circular_mean(F.col("d"), F.col("s")).alias("v")).first()["v"] == pytest.approx(21.253, abs=1e-3)


def test_momm_of_a_year_that_counts_its_months(spark):
    df = spark.createDataFrame([(datetime(2016, 1, 1) + i * timedelta(hours=1),) for i in range(366 * 24)], "ts timestamp_ntz").withColumn("wspd", F.month("ts").cast("double"))
    assert P.momm(df, ["wspd"]).first()["momm"] == pytest.approx(6.5)
    days = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    assert P.momm(df, ["wspd"], seasonal=True).first()["momm"] == pytest.approx(sum((i + 1) * d for i, d in enumerate(days)) / 366)
    with pytest.raises(ValueError):
        P.momm(df.where("month(ts) < 12"), ["wspd"], seasonal=True)


def test_offset_timestamps_collide(spark):
    df = series(spark, [1, 2, 3, 4], datetime(2020, 1, 1), DAY)
    a, b = datetime(2020, 1, 1), datetime(2020, 1, 3)
    assert [r["spd"] for r in P.offset_timestamps(df, "1D", a, b, True).orderBy("ts").collect()] == [1, 2, 4]
    assert [r["spd"] for r in P.offset_timestamps(df, "1D", a, b).orderBy("ts").collect()] == [1, 3, 4]


def test_catalog(spark, tmp_path):
    from anemos.sources import catalog

    (tmp_path / "p.json").write_text('[{"name": "B", "uuid": "2", "plant_type_id": "onshore_wind"}, {"name": "A", "uuid": "1", "plant_type_id": "solar", "elevation_m": 3}]')
    assert [r["plant_uuid"] for r in catalog.plants(spark, str(tmp_path / "p.json")).collect()] == ["1", "2"]
    (tmp_path / "s.json").write_text('[{"name": "M", "uuid": "1", "measurement_station_type_id": "mast"}, {"name": "L", "uuid": "2", "measurement_station_type_id": "lidar"}]')
    assert [r["name"] for r in catalog.stations(spark, str(tmp_path / "s.json"), ["mast"]).collect()] == ["M"]
    with pytest.raises(ValueError, match="lidar"):
        catalog.stations(spark, str(tmp_path / "s.json"), ["sodar"])
    points = spark.createDataFrame([("1", "Spd", "wind_speed"), ("2", "Dir", "wind_direction")], "uuid string, name string, measurement_type_id string")
    configs = spark.createDataFrame([("1", datetime(2020, 1, 2)), ("1", datetime(2019, 1, 2))], "uuid string, date_from timestamp_ntz")
    assert [r["date_from"] for r in catalog.sensor_table(points, configs).collect()] == [None, "2019-01-02", "2020-01-02"]


def test_chart_data(spark):
    df = spark.createDataFrame([(1.0, 5.0, 10.0), (2.0, 3.0, 12.0), (9.0, 9.0, 90.0)], "x double, y double, d double")
    assert sorted((r["x"], r["y"]) for r in D.scatter_by_sector(df, "x", "y", "d", sort_inputs=True).collect()) == [(1, 3), (2, 5), (9, 9)]
    hours = H.hours_of(spark.createDataFrame([(0, 0.1), (1, 0.2)], "segment int, value double"), 2, 0)
    assert {r["value"] for r in H.steps(hours).where("hour = 0").collect()} == {0.2}
    calm = df.withColumn("ts", F.lit(datetime(2020, 1, 1)))
    assert R.randomize_calms(calm, "x", "d", 1.5).exceptAll(R.randomize_calms(calm.repartition(3), "x", "d", 1.5)).count() == 0


def test_speedsort_in_one(spark):
    start = datetime(2020, 1, 1)
    rows = [(start + timedelta(hours=i), 4 + (i * 37 % 100) / 10, float(i * 53 % 360)) for i in range(2000)]
    ref = spark.createDataFrame(rows, "ts timestamp_ntz, r double, dir double")
    target = spark.createDataFrame([(t, 1.2 * v, (d + 10) % 360) for t, v, d in rows], "ts timestamp_ntz, t double, tdir double")
    params, cutoff = R.speedsort(ref, target, "r", "dir", "t", "tdir", "1h")
    got = params.collect()
    assert cutoff == 4.0 and len(got) == 12 and sum(r["n"] for r in got) == 2000
    assert all(abs(r["slope"] - 1.2) < 1e-4 and abs(r["veer"] - 10) < 1e-4 for r in got)


def test_ranks_over_bins(spark):
    rows = [(i % 2, float(i * 7919 % 1000) / 300) for i in range(500)] + [(0, -1.5), (1, 1e6)]
    got = R.ranked(spark.createDataFrame(rows, "g int, v double"), "g", "v").collect()
    for g in (0, 1):
        mine = sorted((r["rn"], r["v"]) for r in got if r["g"] == g)
        assert [k for k, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_several_references(spark):
    rows = [(float(i % 13), float(i % 7)) for i in range(200)]
    data = spark.createDataFrame([(a, b, 2 * a - b + 3) for a, b in rows] + [(1.0, None, 2.0)], "a double, b double, y double")
    params = R.multiple(data, ["a", "b"], "y")
    assert abs(R.fit_r2_multiple(data, params, ["a", "b"], "y").first()["r2"] - 1) < 1e-9
    first = R.predict_multiple(data, params, ["a", "b"]).first()
    assert abs(first["predicted"] - first["y"]) < 1e-6
