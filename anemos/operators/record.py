"""Records of fits: what a fit was given and what its one pass saw, gathered while it runs."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class FitRecord:
    """Handed to a fit, it notes the fit's settings at once and, through an observation of the fit's own pass, its rows: no job of its own is run.
    info() can be read once the fit's result has been (an action on it); before that it waits for one.

    `rows` are all rows that the fit looked at, `valid` those it used, `first` and `last` the times of those, `missing` the nulls of each column. With `data_resolution` in seconds,
    `concurrent_period` is the time that valid rows cover, in years: for each year their share of it."""

    def __init__(self, data_resolution: float | None = None, ts: str = "ts"):
        self.data_resolution, self.ts = data_resolution, ts
        self.inputs: dict[str, Any] = {}
        self.seen: Observation | None = None

    def watch(self, rows: DataFrame, valid: Column, columns: list[str], **inputs: Any) -> DataFrame:
        """rows, watched; a fit calls this on what it is given, before it leaves out the rows that aren't valid."""
        self.inputs = {"columns": list(columns), **inputs}
        ok = F.coalesce(valid, F.lit(False))
        found = [F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("valid"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{i}") for i, c in enumerate(columns)]]
        if self.ts in rows.columns:
            year = F.make_timestamp_ntz(F.year(self.ts), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
            seconds = 86400.0 * (F.dayofyear(F.add_months(year.cast("date"), 12) - F.expr("INTERVAL 1 DAY")))
            t = F.when(ok, F.col(self.ts))
            found += [F.min(t).alias("first"), F.max(t).alias("last"), F.sum(F.when(ok, 1 / seconds)).alias("per_second")]
        self.seen = Observation()
        return rows.observe(self.seen, *found)

    def info(self) -> dict[str, Any]:
        if self.seen is None:
            raise ValueError("no fit has been given this record")
        got = dict(self.seen.get)
        per_second = got.pop("per_second", None)
        missing = {c: got.pop(f"missing_{i}") for i, c in enumerate(self.inputs["columns"])}
        period = round(per_second * self.data_resolution, 3) if per_second is not None and self.data_resolution else None
        return {"input": self.inputs, "output": {**got, "missing": missing, "concurrent_period": period}}


def watched(record: FitRecord | None, rows: DataFrame, valid: Column, columns: list[str], **inputs: Any) -> DataFrame:
    return rows if record is None else record.watch(rows, valid, columns, **inputs)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def needed(n: Column, value: Column, message: str) -> Column:
    """value, or an error that says what is missing where n rows were none."""
    return F.when(n == 0, F.raise_error(F.lit(message)).cast("double")).otherwise(value)
