"""Longitude and latitude to UTM and back: the transverse Mercator series of Krueger to the fourth power of n.

Inside a zone the series is good to some micrometres. Angles are degrees, WGS 84; a point outside +-180, +-90 gives null, as do null and NaN.
Everything is sums, products, quotients, square roots and floors, which have the same bits in every engine; sines and the like of mathematical libraries differ in
the last one. These are a few hundred steps a point, so they run on Arrow batches in the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# The ellipsoid WGS 84, and scale and offsets of UTM.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)


def _powers(*rows: tuple[float, ...]) -> list[float]:
    """Coefficients of the multiple angles, from those of n, n^2, n^3 and n^4."""
    return [sum(k * _N ** (p + 1) for p, k in enumerate(row)) for row in rows]


#: Radius of the rectifying sphere, times the scale.
RADIUS = SCALE * AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECCENTRICITY = (FLATTENING * (2 - FLATTENING)) ** 0.5
#: Series: conformal sphere to plane, plane to conformal sphere, conformal to geographic latitude.
FORWARD = _powers((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
BACKWARD = _powers((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
LATITUDE = _powers((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))


#: Polynomials in the square of a small number, highest power first: sin(x) / x, cos(x) (to 45 degrees), sinh(x) / x (to 1), atanh(x) / x and atan(x) / x (to about 0.25 and 0.2).
SIN = [(-1) ** k / math.factorial(2 * k + 1) for k in range(8, -1, -1)]
COS = [(-1) ** k / math.factorial(2 * k) for k in range(9, -1, -1)]
SINH = [1 / math.factorial(2 * k + 1) for k in range(9, -1, -1)]
ATANH = [1 / (2 * k + 1) for k in range(13, -1, -1)]
ATAN = [(-1) ** k / (2 * k + 1) for k in range(12, -1, -1)]
#: A quarter of a turn in radians: a part of few bits, which whole numbers multiply exactly, and the rest.
QUARTER = (1.5707963267341256, 6.077100506506192e-11)
RADIAN, DEGREE = math.pi / 180, 180 / math.pi


def central_meridian(zone: int) -> float:
    if not 1 <= zone <= 60:
        raise ValueError(f"UTM has zones 1 to 60, not {zone}")
    return 6.0 * zone - 183.0


def in_range(lon: Column, lat: Column) -> Column:
    """Whether a point is on the globe; false for null and NaN."""
    return F.coalesce(lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0), F.lit(False))


def rounded(x: Column, digits: int) -> Column:
    """As `roads.steady`, with the same bits in every engine: rounding of decimal texts and of products differ beside a tie."""
    return F.floor((x + 1e-9) * 10.0**digits + 0.5) / 10.0**digits


def _polynomial(ks: list[float], x):
    y = ks[0]
    for k in ks[1:]:
        y = y * x + k
    return y


def _turned(q, r):
    """Sine and cosine of q quarters of a turn and r radians."""
    z = r * r
    s, c = r * _polynomial(SIN, z), _polynomial(COS, z)
    m = [q - 4.0 * np.floor(q / 4.0) == k for k in range(3)]
    return np.select(m, [s, c, -s], -c), np.select(m, [c, -s, -c], s)


def _of_degrees(a):
    q = np.floor(a / 90.0 + 0.5)
    return _turned(q, (a - 90.0 * q) * RADIAN)


def _of_radians(a):
    q = np.floor(a / QUARTER[0] + 0.5)
    return _turned(q, (a - q * QUARTER[0]) - q * QUARTER[1])


def _angle(a, b, h):
    """The angle of (b, a), whose length is h, by the tangent of its eighth; 0 if that is 0."""
    w = a / np.where(h > 0.0, h + np.abs(b), 1.0)
    for _ in range(2):
        w = w / (1.0 + np.sqrt(1.0 + w * w))
    found = 8.0 * (w * _polynomial(ATAN, w * w))
    return np.where(b >= 0.0, found, np.where(a >= 0.0, math.pi, -math.pi) - found)


def _area_sine(t):
    """The number whose hyperbolic sine is t, by the tangent of its sixteenth."""
    for _ in range(3):
        t = t / np.sqrt(2.0 * (1.0 + np.sqrt(1.0 + t * t)))
    z = t / (1.0 + np.sqrt(1.0 + t * t))
    return 16.0 * (z * _polynomial(ATANH, z * z))


def _sinh(v):
    """By the sine of a quarter."""
    g = v * 0.25
    g = g * _polynomial(SINH, g * g)
    for _ in range(2):
        g = 2.0 * g * np.sqrt(1.0 + g * g)
    return g


def _multiples(s, c, sign: float):
    """Sines and cosines of 2, 4, 6 and 8 times an angle; hyperbolic ones with sign 1, else -1."""
    s2, c2 = 2.0 * s * c, 1.0 + sign * 2.0 * s * s
    s4, c4 = 2.0 * s2 * c2, 1.0 + sign * 2.0 * s2 * s2
    s6, c6 = s4 * c2 + c4 * s2, c4 * c2 + sign * (s4 * s2)
    return (s2, s4, s6, 2.0 * s4 * c4), (c2, c4, c6, 1.0 + sign * 2.0 * s4 * s4)


def _bent(series: list[float], along, across, sines, sign: float):
    """Both coordinates with the series added (or taken away); sines: sine and cosine of `along`, hyperbolic ones of `across`."""
    (s, c), (sh, ch) = _multiples(*sines[:2], -1.0), _multiples(*sines[2:], 1.0)
    for j, k in enumerate(series):
        along = along + sign * k * s[j] * ch[j]
        across = across + sign * k * c[j] * sh[j]
    return along, across


def _two(a: str, b: str) -> StructType:
    return StructType([StructField(a, DoubleType()), StructField(b, DoubleType())])


@F.pandas_udf(DoubleType())
def cosine(degrees: pd.Series) -> pd.Series:
    return pd.Series(_of_degrees(degrees.to_numpy(np.float64))[1])


@F.pandas_udf(_two("x", "y"))
def _plane(turn: pd.Series, lat: pd.Series) -> pd.DataFrame:
    """Metres from the central meridian and the equator. The conformal latitude comes times the cosine of the latitude, so that poles are points like others."""
    with np.errstate(all="ignore"):
        (sin_lat, cos_lat), (sin_turn, cos_turn) = _of_degrees(lat.to_numpy(np.float64)), _of_degrees(turn.to_numpy(np.float64))
        e = ECCENTRICITY * sin_lat
        e = ECCENTRICITY * (e * _polynomial(ATANH, e * e))
        lift = e * _polynomial(SINH, e * e)
        up, flat = sin_lat * np.sqrt(1.0 + lift * lift) - lift, cos_lat * cos_turn
        h = np.sqrt(up * up + flat * flat)
        h = np.where(h > 0.0, h, np.nan)  # a quarter of a turn away on the equator: no place
        t = cos_lat * sin_turn / h
        along, across = _bent(FORWARD, _angle(up, flat, h), _area_sine(t), (up / h, flat / h, t, np.sqrt(1.0 + t * t)), 1.0)
        return pd.DataFrame({"x": RADIUS * across, "y": RADIUS * along})


@F.pandas_udf(_two("lon", "lat"))
def _globe(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Degrees from the central meridian, and of latitude, of metres from it and the equator."""
    with np.errstate(all="ignore"):
        along, across = y.to_numpy(np.float64) / RADIUS, x.to_numpy(np.float64) / RADIUS
        sh = _sinh(across)
        a, b = _bent(BACKWARD, along, across, (*_of_radians(along), sh, np.sqrt(1.0 + sh * sh)), -1.0)
        (sin_a, cos_a), sinh_b = _of_radians(a), _sinh(b)
        g = np.sqrt(sinh_b * sinh_b + cos_a * cos_a)
        h = np.sqrt(sin_a * sin_a + g * g)
        lat = _angle(sin_a, g, h)
        for k, s in zip(LATITUDE, _multiples(sin_a / h, g / h, -1.0)[0], strict=True):
            lat = lat + k * s
        return pd.DataFrame({"lon": _angle(sinh_b, cos_a, g) * DEGREE, "lat": lat * DEGREE})


def with_utm(rows: DataFrame, lon: str, lat: str, zone: int, south: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """`rows` with metres x and y; null if a point is off the globe."""
    at = rows.withColumn("_at", _plane(F.col(lon) - central_meridian(zone), F.col(lat)))
    fine = in_range(F.col(lon), F.col(lat)) & ~F.isnan("_at.x")
    return at.select(*rows.columns, F.when(fine, FALSE_EAST + F.col("_at.x")).alias(x), F.when(fine, (FALSE_NORTH if south else 0.0) + F.col("_at.y")).alias(y))


def with_lonlat(rows: DataFrame, x: str, y: str, zone: int, south: bool = False, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """`rows` with degrees lon and lat of metres x and y; null stays null."""
    at = rows.withColumn("_at", _globe(F.col(x) - FALSE_EAST, F.col(y) - (FALSE_NORTH if south else 0.0)))
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    return at.select(*rows.columns, F.when(known, F.col("_at.lon") + central_meridian(zone)).alias(lon), F.when(known, F.col("_at.lat")).alias(lat))
