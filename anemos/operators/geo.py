"""Nearest grid nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anemos.functions.scalar import haversine_km


def nearest(nodes: DataFrame, latitude: float, longitude: float, k: int = 1, half_width: float = 1.5, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The k nodes within half_width degrees that lie nearest, with distance_km; 1 to 16 of them. Of nodes in one place those come first that are smallest by
    their other columns, from the left (but for maps and variants, which have no order), so the answer doesn't change from run to run."""
    if not 1 <= k <= 16:
        raise ValueError("k must be 1 to 16")
    box = nodes.where(F.col(lat).between(latitude - half_width, latitude + half_width) & F.col(lon).between(longitude - half_width, longitude + half_width))
    d = haversine_km(F.lit(float(latitude)), F.lit(float(longitude)), F.col(lat), F.col(lon))
    others = [F.col(f"`{c}`") for c, t in nodes.dtypes if c not in (lat, lon) and "map<" not in t and "variant" not in t]
    return box.withColumn("distance_km", d).orderBy("distance_km", lat, lon, *others).limit(k)
