from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anemos.operators import correl as R
from anemos.operators import shear as H
from anemos.operators.record import FitRecord

START = datetime(2019, 12, 1)


def mast(spark, hours=24 * 60):
    rows = [(START + timedelta(hours=i), 5.0 + i % 7, None if i % 10 == 0 else 4.0 + i % 5, float(i % 360)) for i in range(hours)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, d double")


def test_a_fit_records_its_rows_in_its_own_pass(spark):
    df = mast(spark)
    record = FitRecord(data_resolution=3600)
    with pytest.raises(ValueError):
        record.info()
    fitted = H.average(df, ["a", "b"], [80, 60], min_speed=4.5, record=record)
    n = fitted.first()["n"]
    info = record.info()
    valid = [(START + timedelta(hours=i)) for i in range(24 * 60) if i % 10 and i % 5 > 0]
    year = lambda t: 366 if t.year == 2020 else 365
    assert info["input"] == {"columns": ["a", "b"], "min_speed": 4.5, "heights": [80, 60], "method": "power_law"}
    assert info["output"] == {"rows": 1440, "valid": n, "first": valid[0], "last": valid[-1], "missing": {"a": 0, "b": 144}, "concurrent_period": round(sum(1 / 24 / year(t) for t in valid), 3)} and n == len(valid)


def test_records_of_other_fits(spark):
    df = mast(spark)
    for fit in (lambda r: H.by_sector(df, ["a", "b"], [80, 60], "d", record=r), lambda r: H.time_of_day(df, ["a", "b"], [80, 60], record=r), lambda r: R.ols(df, "a", "b", record=r), lambda r: R.orthogonal(df, "a", "b", record=r)):
        record = FitRecord()
        fit(record).collect()
        got = record.info()["output"]
        assert got["rows"] == 1440 and got["valid"] == 1296 and got["concurrent_period"] is None


def test_no_valid_row_is_an_error(spark):
    df = mast(spark)
    for fit in (H.average(df, ["a", "b"], [80, 60], 50), H.by_sector(df, ["a", "b"], [80, 60], "d", 50)):
        with pytest.raises(Exception, match="no valid data above 50 m/s"):
            fit.collect()
    with pytest.raises(ValueError):
        H.average(df, ["a"], [80, 60])


def test_equal_names_are_set_apart(spark):
    assert R.renamed_apart(["a", "b"], ["b", "c"]) == ["a_1", "b_1"] and R.renamed_apart(["a"], ["c"]) == ["a"]
    df = mast(spark).select("ts", F.col("a").alias("spd"))
    merged = R.merge_references([df, df.withColumn("own", F.lit(1)), df.where("spd > 8")])
    assert merged.columns == ["ts", "spd_0", "spd_1", "own", "spd_2"] and merged.count() == df.where("spd > 8").count()
    target = df.withColumn("spd", 2 * F.col("spd")).where(F.col("ts") < F.lit(START + timedelta(days=30)).cast("timestamp_ntz"))
    out = R.synthesize(df, target, "spd", "spd", "1D", target_method="max")
    assert out.columns == ["ts", "spd_Synthesized"] and out.count() == 60
    rows = {r["ts"]: r["spd_Synthesized"] for r in out.collect()}
    assert rows[START] == 22.0


def test_speedsort_averages_what_it_fills(spark):
    df = mast(spark)
    ref = df.select("ts", F.col("a").alias("r"), F.col("d").alias("rd"))
    target = df.select("ts", (1.2 * F.col("a")).alias("t"), F.col("d").alias("td"))
    params, cut = R.speedsort(ref, target, "r", "rd", "t", "td", "1h")
    out = R.speedsort_synthesize(ref, target.where("day(ts) > 5"), params, "r", "rd", "t", "td", cut, period="1D")
    assert out.count() == 60
    day = out.where(F.col("ts") == F.lit(datetime(2019, 12, 10)).cast("timestamp_ntz")).first()
    want = target.where("to_date(ts) = date'2019-12-10'").agg(F.avg("t")).first()[0]
    assert day["t_Synthesized"] == pytest.approx(want)
