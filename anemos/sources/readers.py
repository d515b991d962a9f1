"""Readers of logger files. Schemas are given, not inferred, save that all signals are doubles by default."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from anemos.functions.scalar import clean

ISO = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd"]
DAY_FIRST = ["dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd/MM/yyyy"]


def parse_time(text: Column, day_first: bool = False) -> Column:
    """Timestamp without zone from the usual styles; a zone or fraction at the end is cut off."""
    bare = F.regexp_replace(F.trim(text), r"(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?$", "")
    short = F.regexp_replace(bare, r"^(\d)([/-])", "0$1$2")
    styles = [*DAY_FIRST, *ISO] if day_first else [*ISO, *DAY_FIRST]
    return F.coalesce(*[F.try_to_timestamp(short, F.lit(s)).cast("timestamp_ntz") for s in styles])


def _paths(spark: SparkSession, path: str | list[str], pattern: str):
    """A text reader and its paths: files as named, or those in folders and below them that fit the pattern."""
    paths = [path] if isinstance(path, str) else path
    reader = spark.read
    if not any(p.lower().endswith(pattern.lstrip("*")) for p in paths):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader, paths


def _value(text: Column, name: str, strings: tuple[str, ...], missing: str | None) -> Column:
    value = F.when(F.trim(text) != missing, text) if missing is not None else text
    return (value if name in strings else clean(value.try_cast("double"))).alias(name)


def _names(header: str, sep: str) -> list[str]:
    """Names of a header line; those that repeat are numbered, those that are empty are left out (as "")."""
    fields = [x.strip() for x in next(csv.reader([header], delimiter=sep, skipinitialspace=True), [])]
    seen: dict[str, int] = {}
    out = []
    for name in fields:
        n = seen[name] = seen.get(name, -1) + 1
        out.append(name if not n or not name else f"{name}.{n}")
    return out


def read_lines(spark: SparkSession, path: str | list[str], pattern: str, header: int | str = 0, skip: int = 0, sep: str = ",", day_first: bool = False, strings: tuple[str, ...] = (), missing: str | None = None, keep_rejects: bool = False, observation: Observation | None = None) -> DataFrame:
    """(ts, signals) of delimited files, each by its own header: the header-th line of a file, or its first that holds a text. Columns are united by name, in the
    order in which headers name them; a file that lacks one has nulls. The first column is the timestamp, whatever its name; `skip` lines after the header are left out,
    as are empty ones.

    All files are one scan of lines, which are joined with one row a file (its header); only distinct headers reach the driver. A line whose time can't be read is rejected: with
    `keep_rejects` it stays as a row with a null ts, its file and text in _file and _line (accepted() and rejected() part them), else it goes. An `observation` is told in the
    same pass how many lines were accepted and rejected, and one of those (lines, rejected, example)."""
    reader, paths = _paths(spark, path, pattern)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = reader.text(paths).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.regexp_replace("value", "^\uFEFF", "").alias("value"))
    heads = lines.where(F.contains("value", F.lit(header))) if isinstance(header, str) else lines
    heads = heads.groupBy("file").agg(F.min(F.struct("place", "value")).alias("head"))
    for _ in range(0 if isinstance(header, str) else header):
        before = heads.select("file", F.col("head.place").alias("before"))
        heads = lines.join(F.broadcast(before), "file").where(F.col("place") > F.col("before")).groupBy("file").agg(F.min(F.struct("place", "value")).alias("head"))
    kinds = [r[0] for r in heads.select("head.value").distinct().orderBy("value").limit(10_001).collect()]
    if not kinds:
        raise ValueError(f"no header line{f' with {header}' if isinstance(header, str) else ''}")
    if len(kinds) > 10_000:
        raise ValueError("over 10,000 different headers: these aren't tables")
    named = [_names(k, sep) for k in kinds]
    columns = list(dict.fromkeys(n for names in named for n in names[1:] if n))
    index = [[names[1:].index(c) + 1 if c in names[1:] else None for c in columns] for names in named]
    of_kind = spark.createDataFrame(list(zip(kinds, index)), "kind string, index array<int>")
    heads = heads.select("file", F.col("head.place").alias("head"), F.col("head.value").alias("kind")).join(F.broadcast(of_kind), "kind").drop("kind")
    wide = max(map(len, named))
    after = (F.col("place") > F.col("head")) & ~((F.col("place.block") == F.col("head.block")) & (F.col("place.id") <= F.col("head.id") + skip)) & (F.trim("value") != "")
    rows = lines.join(heads, "file").where(after)
    fields = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(wide))), {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = rows.withColumn("f", fields).select("file", "value", "index", F.array(*[F.col(f"f.c{i}") for i in range(wide)]).alias("f"))
    ts = parse_time(F.get("f", F.lit(0)), day_first)
    out = rows.select(ts.alias("ts"), *[_value(F.get("f", F.get("index", F.lit(i))), c, strings, missing) for i, c in enumerate(columns)], F.col("file").alias("_file"), F.when(ts.isNull(), F.col("value")).alias("_line"))
    return _reported(out, keep_rejects, observation)


def _reported(rows: DataFrame, keep_rejects: bool, observation: Observation | None) -> DataFrame:
    if observation is not None:
        bad = F.col("ts").isNull()
        rows = rows.observe(observation, F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("rejected"), F.min(F.when(bad, F.struct("_file", "_line"))).alias("example"))
    return rows if keep_rejects else rows.where(F.col("ts").isNotNull()).drop("_line")


def accepted(rows: DataFrame) -> DataFrame:
    """The signals of what a reader with keep_rejects gave."""
    return rows.where(F.col("ts").isNotNull()).drop("_file", "_line")


def rejected(rows: DataFrame) -> DataFrame:
    """(file, line) of the lines whose time can't be read."""
    return rows.where(F.col("ts").isNull()).select(F.col("_file").alias("file"), F.col("_line").alias("line"))


def check_unique(df: DataFrame, ts: str = "ts") -> None:
    """A ValueError if a timestamp occurs twice, naming the files if rows tell theirs. Only timestamps and files are grouped, with partial counts."""
    file = F.col("_file") if "_file" in df.columns else F.lit(None).cast("string")
    twice = df.groupBy(ts).agg(F.count(F.lit(1)).alias("n"), F.min(file).alias("a"), F.max(file).alias("b")).where("n > 1").first()
    if twice is not None:
        names = " and ".join(dict.fromkeys(x.rsplit("/", 1)[-1] for x in (twice["a"], twice["b"]) if x))
        raise ValueError(f"timestamp {twice[ts]} occurs {twice['n']} times{f', in {names}' if names else ''}")


def _finished(rows: DataFrame, unique: bool, keep_rejects: bool) -> DataFrame:
    if unique:
        check_unique(rows.where(F.col("ts").isNotNull()))
    return rows if keep_rejects else rows.drop("_file")


def read_csv(spark: SparkSession, path: str | list[str], day_first: bool = False, strings: tuple[str, ...] = (), pattern: str = "*.csv", unique: bool = True, sep: str = ",", **options) -> DataFrame:
    """(ts, signals) from a CSV file, or all in a folder and those below it, whose first column is the timestamp; headers may differ from file to file. Names in
    `strings` stay text. A timestamp that occurs twice is an error if unique is set, which costs a pass over the timestamps. Rejected lines: see read_lines."""
    return _finished(read_lines(spark, path, pattern, 0, 0, sep, day_first, strings, **options), unique, options.get("keep_rejects", False))


def read_windographer(spark: SparkSession, path: str | list[str], delimiter: str = "tab", flag_text: str = "9999", day_first: bool = False, pattern: str = "*.txt", **options) -> DataFrame:
    """(ts, signals) of text exports, a file or a folder of them: the header is a file's first line that holds Date/Time; fields equal to flag_text are
    missing. Rejected lines: see read_lines."""
    sep = {"tab": "\t", "comma": ",", "space": " "}.get(delimiter, delimiter)
    return _finished(read_lines(spark, path, pattern, "Date/Time", 0, sep, day_first, (), str(flag_text), **options), False, options.get("keep_rejects", False))


def read_campbell(spark: SparkSession, path: str | list[str], day_first: bool = False, strings: tuple[str, ...] = (), pattern: str = "*.dat", **options) -> DataFrame:
    """(ts, signals) of four-line-header logger files, a file or a folder of them, whose programs may differ: names are on a file's second line. Rejected lines: see read_lines."""
    return _finished(read_lines(spark, path, pattern, 1, 2, ",", day_first, strings, "NAN", **options), False, options.get("keep_rejects", False))


def _sheet_rows(content: bytes, sheet: int) -> Iterator[list[str | None]]:
    """The cells of one sheet of an .xlsx file, row by row, as text; a cell that a row leaves out is None."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        with z.open(names[sheet]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{main}row":
                    continue
                cells: dict[int, str | None] = {}
                for cell in row.iter(f"{main}c"):
                    letters = re.sub(r"\d", "", cell.get("r", "")) or "A"
                    at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1
                    text = cell.findtext(f"{main}v")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{main}t"))
                    cells[at] = shared[int(text)] if cell.get("t") == "s" and text else text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                row.clear()


def read_excel(spark: SparkSession, path: str | list[str], sheet: int = 0, day_first: bool = False, strings: tuple[str, ...] = (), pattern: str = "*.xlsx", keep_rejects: bool = False, observation: Observation | None = None) -> DataFrame:
    """(ts, signals) of one sheet of each .xlsx file at path, a file or a folder of them: the first row names columns, which are united by name, the first column is the time (a date of
    the sheet or text). A task reads a file, which is at most a million rows, by its own XML. Rejected rows: see read_lines."""
    reader, paths = _paths(spark, path, pattern)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                names, out = None, []
                for row in _sheet_rows(content, sheet):
                    if names is None:
                        names = [str(x or "").strip() for x in row]
                        yield pd.DataFrame({"file": [file], "first": [None], "cells": [dict.fromkeys((n for n in names[1:] if n), None)], "line": [None]})
                    elif any(x is not None for x in row):
                        row = row + [None] * (len(names) - len(row))
                        out.append((file, row[0], {n: x for n, x in zip(names[1:], row[1:]) if n}, ",".join(x or "" for x in row)))
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=["file", "first", "cells", "line"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["file", "first", "cells", "line"])

    rows = reader.format("binaryFile").load(paths).select("path", "content").mapInPandas(cells, "file string, first string, cells map<string,string>, line string")
    columns = [r[0] for r in rows.where("line IS NULL").select(F.explode(F.map_keys("cells"))).distinct().orderBy("col").collect()]
    serial = F.col("first").try_cast("double")
    ts = F.coalesce(F.timestamp_add("MICROSECOND", F.round(serial * 86_400_000).cast("long") * 1000, F.lit("1899-12-30 00:00:00").cast("timestamp_ntz")), parse_time(F.col("first"), day_first))
    out = rows.where("line IS NOT NULL").select(ts.alias("ts"), *[_value(F.try_element_at("cells", F.lit(c)), c, strings, None) for c in columns], F.col("file").alias("_file"), F.when(ts.isNull(), F.col("line")).alias("_line"))
    return _finished(_reported(out, keep_rejects, observation), False, keep_rejects)


def read_log(spark: SparkSession, path: str, sensor: str = "Sensor", date_from: str = "Start", date_to: str = "Stop", extra: dict[str, str] | None = None, day_first: bool = False, sep: str = ",") -> DataFrame:
    """(sensor, date_from, date_to, extras) of a cleaning or flagging log; ends that can't be read are open."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return raw.select(F.col(f"`{sensor}`").alias("sensor"), parse_time(F.col(f"`{date_from}`"), day_first).alias("date_from"), parse_time(F.col(f"`{date_to}`"), day_first).alias("date_to"), *[F.col(f"`{c}`").alias(n) for n, c in (extra or {}).items()])


def read_flags(spark: SparkSession, path: str, day_first: bool = False) -> DataFrame:
    return read_log(spark, path, "Data Column", "Start Time", "End Time", {"flag": "Flag Name"}, day_first, "\t")


def read_rules(spark: SparkSession, path: str) -> list[dict]:
    """Cleaning rules of a JSON file."""
    import json

    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
