"""Column expressions: direction arithmetic, calibration, air density, scaling, distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def wrap(direction: Column) -> Column:
    """To 0..360: one turn is added below 0, whole turns are taken off above 360; 360 stays."""
    return F.when(direction < 0, direction + 360).when(direction > 360, direction % 360).otherwise(direction)


def offset_direction(direction: Column, offset: Column | float) -> Column:
    return wrap(direction + offset)


def adjust_slope_offset(x: Column, current_slope: float, current_offset: float, new_slope: float, new_offset: float) -> Column:
    for v in (current_slope, current_offset, new_slope, new_offset):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise TypeError("slopes and offsets must be numbers")
    return F.lit(float(new_slope)) * ((x - F.lit(float(current_offset))) / F.lit(float(current_slope))) + F.lit(float(new_offset))


def scale(x: Column, factor: float) -> Column:
    return x * F.lit(float(factor))


def linear(x: Column, slope: float | Column, offset: float | Column) -> Column:
    return x * slope + offset


def air_density(temperature: Column, pressure: Column, elevation_ref: float | None = None, elevation_site: float | None = None, lapse_rate: float = -0.113, gas_constant: float = 286.9) -> Column:
    """kg/m3 from degrees C and hPa; with both elevations moved by the lapse rate and rounded to 3 places."""
    density = pressure * 100 / (F.lit(gas_constant) * (temperature + 273.15))
    if (elevation_ref is None) != (elevation_site is None):
        raise TypeError("give both elevations or none")
    if elevation_ref is None:
        return density
    return F.round(density + F.lit((elevation_site - elevation_ref) / 1000 * lapse_rate), 3)


def circular(sine: Column, cosine: Column) -> Column:
    return F.when((sine == 0) & (cosine == 0), None).otherwise(F.pmod(F.degrees(F.atan2(sine, cosine)), F.lit(360.0)))


def circular_mean(direction: Column, weight: Column | None = None) -> Column:
    """Aggregate: vector mean, of sines and cosines at 5 places; null where the vectors cancel out."""
    s, c = F.round(F.sin(F.radians(direction)), 5), F.round(F.cos(F.radians(direction)), 5)
    if weight is not None:
        s, c = s * weight, c * weight
    return circular(F.avg(s), F.avg(c))


def row_circular_mean(directions: list[Column], weights: list[Column] | None = None) -> Column:
    """Vector mean over columns of a row; nulls are left out."""
    weights = weights or [F.lit(1.0)] * len(directions)
    parts = [[F.round(f(F.radians(d)), 5) * w for d, w in zip(directions, weights)] for f in (F.sin, F.cos)]
    count = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts[0]])
    sine, cosine = (reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in ps]) for ps in parts)
    return F.when(count > 0, circular(sine / F.nullif(count, F.lit(0)), cosine / F.nullif(count, F.lit(0))))


def wind_vector(speed: Column, direction_rad: Column) -> tuple[Column, Column]:
    return speed * F.cos(direction_rad), speed * F.sin(direction_rad)


def veer(ref: Column, target: Column) -> Column:
    """target - ref, within -180..180."""
    d = target - ref
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def power_scale(u: Column, z1: float, z2: float, alpha: Column | float) -> Column:
    return u * F.pow(F.lit(z2 / z1), alpha if isinstance(alpha, Column) else F.lit(float(alpha)))


def log_scale(u: Column, z1: float, z2: float, roughness: Column | float) -> Column:
    z0 = roughness if isinstance(roughness, Column) else F.lit(float(roughness))
    return u * F.try_divide(F.ln(F.lit(float(z2)) / z0), F.ln(F.lit(float(z1)) / z0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6,371 km."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def in_sector(direction: Column, low: float, high: float) -> Column:
    """Whether a direction lies in [low, high), through north if low > high."""
    return (direction >= low) & (direction < high) if low <= high else (direction >= low) | (direction < high)


def sectors_overlap(boom_1: float, boom_2: float, width: float) -> bool:
    apart = abs(boom_1 - boom_2) % 360
    return min(apart, 360 - apart) < width


def sector_limits(boom: float, width: float) -> tuple[float, float]:
    """Limits of the sector behind a boom, in the mast's shadow."""
    return (boom - width / 2 + 180) % 360, (boom + width / 2 + 180) % 360


def selective_average(speed_1: Column, speed_2: Column, direction: Column, boom_1: float, boom_2: float, width: float = 60) -> Column:
    """Mean of two anemometers, or the other one alone where one is missing or in the mast's shadow. A null direction counts as
    in no shadow."""
    if sectors_overlap(boom_1, boom_2, width):
        raise ValueError("sectors overlap")

    def shadow(boom: float) -> Column:
        low, high = sector_limits(boom, width)
        inside = (direction >= low) & (direction <= high) if low <= high else (direction >= low) | (direction <= high)
        return F.coalesce(inside, F.lit(False))

    return F.when(speed_1.isNull(), speed_2).when(speed_2.isNull(), speed_1).when(shadow(boom_1), speed_2).when(shadow(boom_2), speed_1).otherwise((speed_1 + speed_2) / 2)
