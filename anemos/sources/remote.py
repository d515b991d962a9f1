"""Time series of a remote service as a table: a Python data source whose partitions are a node and a range of dates each."""

from __future__ import annotations

import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


class Part(InputPartition):
    def __init__(self, node: str, start: datetime, end: datetime):
        self.node, self.start, self.end = node, start, end


class SeriesReader(DataSourceReader):
    """Asks `url` with node, date_from and date_to (its braces are filled in) for rows of [date_from, date_to), as CSV with a header or a JSON list of objects, by `format`; the `time` field is
    the timestamp, fields that schema names are read, those that an answer lacks are null. Answers 429, 500, 502, 503 and 504, and broken connections, are tried again after `wait` seconds, then
    twice as long each, `retries` times; then the task fails, as for any other error. 404 and 204 are a node without data in that range."""

    def __init__(self, schema, options: dict):
        self.schema_ = schema
        self.options = {k.lower(): v for k, v in options.items()}
        self.start, self.end = (datetime.fromisoformat(self.options[k]) for k in ("date_from", "date_to"))
        self.nodes: list[str] = json.loads(self.options["nodes"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("ts",) and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.start = max(self.start, f.value)
            if column == ("ts",) and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.end = min(self.end, f.value if isinstance(f, LessThan) else f.value + timedelta(microseconds=1))
            if column == ("node",) and isinstance(f, EqualTo | In):
                kept = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.nodes = [n for n in self.nodes if n in kept]
            yield f  # Spark applies it to the rows again

    def partitions(self) -> list[Part]:
        days = timedelta(days=float(self.options.get("days", "366")))
        out = []
        for node in self.nodes:
            at = self.start
            while at < self.end:
                out.append(Part(node, at, min(at + days, self.end)))
                at += days
        return out

    def ask(self, part: Part) -> bytes:
        fields = {"node": part.node, "date_from": part.start.isoformat(), "date_to": part.end.isoformat()}
        url = self.options["url"].format(**{k: urllib.parse.quote(v, safe="") for k, v in fields.items()})
        request = urllib.request.Request(url, headers=json.loads(self.options.get("headers", "{}")))
        wait = float(self.options.get("wait", "1"))
        for left in range(int(self.options.get("retries", "5")), -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", "60"))) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return b""
                if e.code not in (429, 500, 502, 503, 504) or not left:
                    raise
            except (urllib.error.URLError, ConnectionError, TimeoutError):
                if not left:
                    raise
            time.sleep(wait)
            wait *= 2
        raise AssertionError("unreachable")

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        body = self.ask(part)
        if not body.strip():
            return
        rows = pd.DataFrame(json.loads(body)) if self.options.get("format", "csv") == "json" else pd.read_csv(io.BytesIO(body))
        if rows.empty:
            return
        ts = pd.to_datetime(rows[self.options.get("time", "ts")])
        inside = (ts >= part.start) & (ts < part.end)
        names = [f.name for f in self.schema_.fields[2:]]
        numbers = [pa.array(pd.to_numeric(rows[n], errors="coerce")[inside].astype(float), pa.float64(), from_pandas=True) if n in rows else pa.nulls(int(inside.sum()), pa.float64()) for n in names]
        yield pa.RecordBatch.from_arrays([pa.array([part.node] * int(inside.sum())), pa.array(ts[inside].astype("datetime64[us]"), pa.timestamp("us")), *numbers], names=["node", "ts", *names])


class SeriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_series"

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader(schema, self.options)


def read_series(spark: SparkSession, url: str, nodes: list[str], columns: list[str], date_from: datetime, date_to: datetime, **options) -> DataFrame:
    """(node, ts, columns) of remote nodes in [date_from, date_to): a task asks for one node and at most `days` (366) days. Conditions on ts and node narrow what is asked for
    (spark.sql.python.filterPushdown.enabled is set for the session). Nothing is asked before an action. See SeriesReader for url and other options (format,
    time, headers as JSON, retries, wait, timeout)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeriesSource)
    names = ", ".join(f"`{c}` double" for c in columns)
    reader = spark.read.format("remote_series").schema(f"node string, ts timestamp_ntz, {names}")
    given = {"url": url, "nodes": json.dumps(nodes), "date_from": date_from.isoformat(), "date_to": date_to.isoformat(), **options}
    return reader.options(**{k: str(v) for k, v in given.items()}).load()


def reanalysis_near(spark: SparkSession, url: str, nodes: DataFrame, latitude: float, longitude: float, columns: list[str], date_from: datetime, date_to: datetime, nearest: int = 4, **options) -> DataFrame:
    """read_series of the `nearest` nodes (node, latitude, longitude) to a place, with each one's distance."""
    from anemos.operators.geo import nearest as near

    found = near(nodes, latitude, longitude, nearest).withColumn("node", F.col("node").cast("string"))
    names = [r["node"] for r in found.select("node").collect()]  # at most 16
    return read_series(spark, url, names, columns, date_from, date_to, **options).join(F.broadcast(found.select("node", "distance_km")), "node")
