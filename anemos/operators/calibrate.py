"""Calibration of speeds and directions by validity periods, all half open; and cleaning by logs and rules."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anemos.functions.scalar import adjust_slope_offset, offset_direction, wrap


def _time(value: str | datetime | None) -> datetime | None:
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def between(ts: Column, date_from: str | datetime | None, date_to: str | datetime | None) -> Column:
    """ts in [date_from, date_to); an open end doesn't bind."""
    out = F.lit(True)
    if _time(date_from) is not None:
        out = out & (ts >= F.lit(_time(date_from)).cast("timestamp_ntz"))
    if _time(date_to) is not None:
        out = out & (ts < F.lit(_time(date_to)).cast("timestamp_ntz"))
    return out


@dataclass
class Interval:
    """Properties of one sensor for one stretch of time."""

    column: str
    date_from: str | datetime | None = None
    date_to: str | datetime | None = None
    logger_slope: float | None = None
    logger_offset: float | None = None
    slope: float | None = None
    offset: float | None = None


def slope_offset_by_period(df: DataFrame, periods: Iterable[Interval], ts: str = "ts") -> DataFrame:
    """Replace the logger's slope and offset by the calibration's in each period; periods with a missing value or none to
    change are skipped. Folded into one CASE per column."""
    out = {c: F.col(c) for c in df.columns}
    for p in periods:
        values = (p.logger_slope, p.logger_offset, p.slope, p.offset)
        if p.column in out and None not in values and (p.logger_slope, p.logger_offset) != (p.slope, p.offset):
            out[p.column] = F.when(between(F.col(ts), p.date_from, p.date_to), adjust_slope_offset(F.col(p.column), *values)).otherwise(out[p.column])
    return df.select(*[v.alias(c) for c, v in out.items()])


def deadband_by_period(df: DataFrame, periods: Iterable[Interval], ts: str = "ts") -> DataFrame:
    """Add the deadband orientation (offset) less the logger's offset to directions, wrapped to 0..360, in each period."""
    out = {c: F.col(c) for c in df.columns}
    for p in periods:
        if p.column in out and p.offset is not None:
            out[p.column] = F.when(between(F.col(ts), p.date_from, p.date_to), offset_direction(F.col(p.column), F.lit(float(p.offset) - float(p.logger_offset or 0)))).otherwise(out[p.column])
    return df.select(*[v.alias(c) for c, v in out.items()])


@dataclass
class Orientation:
    """A remote device's orientation for one stretch of time."""

    date_from: str | None
    date_to: str | None
    orientation: float | None


def overlapping(devices: list[Orientation]) -> list[tuple[int, int]]:
    """Pairs of stretches that overlap."""
    low = lambda d: _time(d.date_from) or datetime.min
    high = lambda d: _time(d.date_to) or datetime.max
    return [(i, j) for i, a in enumerate(devices) for j, b in enumerate(devices) if i < j and low(a) < high(b) and low(b) < high(a)]


def orientation_by_period(df: DataFrame, periods: Iterable[Interval], devices: list[Orientation], ts: str = "ts") -> DataFrame:
    """Add the device's orientation less the logger's offset to directions where a measurement's and a device's stretch meet."""
    if overlapping(devices) and any(d.orientation is not None for d in devices):
        raise ValueError("device stretches overlap")
    out = {c: F.col(c) for c in df.columns}
    for p in periods:
        for d in devices:
            if p.column in out and d.orientation is not None:
                both = between(F.col(ts), p.date_from, p.date_to) & between(F.col(ts), d.date_from, d.date_to)
                out[p.column] = F.when(both, wrap(F.col(p.column) + F.lit(float(d.orientation) - float(p.logger_offset or 0)))).otherwise(out[p.column])
    return df.select(*[v.alias(c) for c, v in out.items()])


#: A log of so many rows is folded into the projection; a longer one is joined.
FOLDED = 200


def apply_log(df: DataFrame, log: DataFrame, ts: str = "ts", sensor: str = "sensor", date_from: str = "date_from", date_to: str = "date_to", all_sensors: str = "All", fold: int = FOLDED) -> DataFrame:
    """Null the columns whose name starts with a log row's sensor, or all, in [date_from, date_to); open ends don't bind.

    A log of at most `fold` rows becomes one predicate per column. A longer one stays a table: its intervals are dealt to the
    days they touch and joined to the rows' days, so neither is held by the driver. An interval with an open end is cut to
    the data's range first."""
    columns = [c for c in df.columns if c != ts]
    rows = log.select(F.col(sensor).alias("s"), F.col(date_from).alias("a"), F.col(date_to).alias("b")).limit(fold + 1).collect()
    if len(rows) <= fold:
        out = []
        for c in columns:
            hit = F.lit(False)
            for r in rows:
                if r["s"] is not None and (r["s"] == all_sensors or c.startswith(r["s"])):
                    hit = hit | between(F.col(ts), r["a"], r["b"])
            out.append(F.when(~hit, F.col(c)).alias(c))
        return df.select(ts, *out)
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    span = log.select(F.col(sensor).alias("s"), F.coalesce(date_from, F.lit(low).cast("timestamp_ntz")).alias("a"), F.col(date_to).alias("b"))
    last = F.least(F.coalesce("b", F.lit(high).cast("timestamp_ntz")), F.lit(high).cast("timestamp_ntz"))
    first = F.greatest("a", F.lit(low).cast("timestamp_ntz"))
    days = span.where(first <= last).withColumn("day", F.explode(F.sequence(F.to_date(first), F.to_date(last))))
    keyed = df.select(ts).distinct().withColumn("day", F.to_date(ts))
    hits = keyed.join(days, "day").where((F.col(ts) >= F.col("a")) & (F.col("b").isNull() | (F.col(ts) < F.col("b"))))
    hits = hits.groupBy(ts).agg(F.collect_set("s").alias("sensors"))
    flagged = lambda c: F.coalesce(F.exists("sensors", lambda s: (s == all_sensors) | F.lit(c).startswith(s)), F.lit(False))
    return df.join(hits, ts, "left").select(ts, *[F.when(~flagged(c), F.col(c)).alias(c) for c in columns])


def apply_flags(df: DataFrame, log: DataFrame, exclude: tuple[str, ...] = ("Synthesized",), flag: str = "flag", **options) -> DataFrame:
    """apply_log with the rows whose flag isn't excluded."""
    return apply_log(df, log.where(~F.coalesce(F.col(flag).isin(*exclude), F.lit(False))) if exclude else log, **options)


OPERATORS = {1: lambda c, v: c < v, 2: lambda c, v: c <= v, 3: lambda c, v: c > v, 4: lambda c, v: c >= v, 5: lambda c, v: c == v, 6: lambda c, v: ~c.eqNullSafe(F.lit(v))}


def _condition(cond: dict, current: dict[str, Column]) -> Column:
    if "and" in cond or "or" in cond:
        parts = [_condition(x, current) for x in cond.get("and", cond.get("or"))]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if "and" in cond else out | p
        return out
    if "not" in cond:
        return ~_condition(cond["not"], current)
    name, op = cond["assembled_column_name"], cond["comparison_operator_id"]
    if name not in current:
        raise KeyError(f"no column {name}")
    return F.coalesce(OPERATORS[int(op)](current[name], cond["comparator_value"]), F.lit(False))


def check_rules(rules: list[dict]) -> None:
    """Raise ValueError for rules that lack what apply_rules reads."""
    def check(cond: dict) -> None:
        for k in ("and", "or"):
            for x in cond.get(k, []):
                check(x)
        if "not" in cond:
            check(cond["not"])
        if not {"and", "or", "not"} & set(cond):
            if missing := {"assembled_column_name", "comparator_value", "comparison_operator_id"} - set(cond):
                raise ValueError(f"a condition lacks {', '.join(sorted(missing))}")
            if int(cond["comparison_operator_id"]) not in OPERATORS:
                raise ValueError(f"unknown comparison_operator_id {cond['comparison_operator_id']}")

    for r in rules:
        rule = r.get("rule", {})
        if not isinstance(rule.get("clean_out"), list) or "conditions" not in rule:
            raise ValueError("a rule needs clean_out and conditions")
        check(rule["conditions"])


def apply_rules(df: DataFrame, rules: list[dict] | str, replacement: float | None = None, ts: str = "ts") -> DataFrame:
    """Apply rules in turn: where the conditions hold in [date_from, date_to), columns whose name contains a target's get the
    replacement. A later rule sees what earlier ones changed. Null compares false, but true under "not equal"."""
    rules = json.loads(rules) if isinstance(rules, str) else rules
    check_rules(rules)
    columns = [c for c in df.columns if c != ts]
    for r in rules:
        rule = r["rule"]
        hit = between(F.col(ts), rule.get("date_from"), rule.get("date_to")) & _condition(rule["conditions"], {c: F.col(c) for c in columns})
        targets = [c for c in columns if any(t["assembled_column_name"] in c for t in rule["clean_out"])]
        value = F.lit(replacement).cast("double")
        df = df.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c in targets})
    return df
