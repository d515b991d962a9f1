"""Value bins [left, right), direction sectors and their labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPEED_EDGES = [float(x) for x in np.arange(-0.5, 41, 1)]


def bin_index(x: Column, edges: list[float]) -> Column:
    """Bin number from 1; null outside all bins."""
    e = [float(v) for v in edges]
    at = reduce(lambda a, b: a + b, [(x >= v).cast("int") for v in e[:-1]])
    return F.when((x >= e[0]) & (x < e[-1]), at)


def bins(spark: SparkSession, edges: list[float], name: str = "bin") -> DataFrame:
    """(name, name_left, name_right) of every bin."""
    e = [float(v) for v in edges]
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(zip(e[:-1], e[1:]))], f"{name} int, {name}_left double, {name}_right double")


def direction_edges(sectors: int) -> list[float]:
    width = 360 / sectors
    return [0.0, *[float(x) for x in np.arange(width / 2, 360, width)], 360.0]


def sector(direction: Column, sectors: int = 12, edges: list[float] | None = None) -> Column:
    """Sector number from 1. Without edges the first is centred on north; with edges 360 belongs to the last."""
    if edges is None:
        width = 360 / sectors
        return F.when(direction.between(0, 360), F.floor(F.pmod(direction + width / 2, F.lit(360.0)) / width).cast("int") + 1)
    at = reduce(lambda a, b: a + b, [(direction >= float(v)).cast("int") for v in edges[:-1]])
    return F.when((direction >= float(edges[0])) & (direction <= float(edges[-1])), at)


def sector_labels(sectors: int, edges: list[float] | None = None) -> list[str]:
    if edges is not None:
        return [f"{float(a)}-{float(b)}" for a, b in zip(edges[:-1], edges[1:])]
    e = direction_edges(sectors)
    return [f"{e[-2]}-{e[1]}", *[f"{a}-{b}" for a, b in zip(e[1:-2], e[2:-1])]]


def sectors_table(spark: SparkSession, sectors: int = 12, edges: list[float] | None = None) -> DataFrame:
    """(sector, sector_label, sector_mid)."""
    n = sectors if edges is None else len(edges) - 1
    mids = [i * 360 / n for i in range(n)] if edges is None else [(a + b) / 2 for a, b in zip(edges[:-1], edges[1:])]
    return spark.createDataFrame(list(zip(range(1, n + 1), sector_labels(n, edges), map(float, mids))), "sector int, sector_label string, sector_mid double")


def auto_edges(low: float, high: float, count: int | None = None) -> list[float]:
    """Edges one unit wide that hold low to high, or `count` equal bins of which the last leaves out the maximum."""
    if count:
        return [float(x) for x in np.linspace(low, high, count + 1)]
    return [float(x) for x in np.arange(np.floor(low), np.ceil(high) + 1 + (high % 1 == 0), 1)]


def dist_edges(low: float, high: float) -> list[float]:
    """Default edges of a distribution, on half units; the last may lie under the maximum."""
    e = [float(x) for x in np.arange(round(low - 0.5) - 0.5, high + 0.5, 1)]
    return e if len(e) > 1 else [e[0], e[0] + 1]
