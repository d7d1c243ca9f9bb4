"""Queries on map projections, geographic fields and flow in windows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rillspark.functions import projection
from rillspark.operators import nowcast, regrid
from rillspark.operators.roads import steady
from rillspark.plans.testbed import RAIN_SQL, rain_cells, view, with_views
from rillspark.sources.tables import table

ZONE = 45
#: The corner of the grid of the domain tables, in metres of this zone.
WEST, NORTH, CELL_M = 640000.0, 2495000.0, 30.0

# Where customers are: in and around the zone, some of them off the globe.
PLACES = """
SELECT c_custkey AS place_id, CAST(84 AS DOUBLE) + CAST(c_custkey * 7919 % 60000 AS DOUBLE) / 10000 AS lon,
       CASE WHEN c_custkey % 97 = 0 THEN CAST(90.5 AS DOUBLE) WHEN c_custkey % 89 = 0 THEN NULL ELSE CAST(c_custkey * 104729 % 160000 AS DOUBLE) / 1000 - 80 END AS lat
FROM {customer}"""

# A forecast on axes of uneven steps that cover the middle of the grid: two lines of cells of the source table lie outside on every side.
FORECAST = """
SELECT CAST(l_linenumber AS INT) AS frame, CAST(22.5480 AS DOUBLE) + CAST(l_suppkey % 9 AS DOUBLE) * 0.0011 + CAST((l_suppkey % 9) * (l_suppkey % 9) AS DOUBLE) * 0.00004 AS lat,
       CAST(88.3660 AS DOUBLE) + CAST(l_partkey % 11 AS DOUBLE) * 0.0007 + CAST((l_partkey % 11) * (l_partkey % 11) AS DOUBLE) * 0.00003 AS lon, MAX(CAST(l_quantity AS DOUBLE)) / 7200 AS rate
FROM {lineitem} GROUP BY l_linenumber, l_suppkey % 9, l_partkey % 11"""


def _places(spark, sf):
    return spark.sql(PLACES, customer=table(spark, sf, "customer"))


def _projected(spark, sf):
    at = projection.with_utm(_places(spark, sf), "lon", "lat", ZONE)
    back = projection.with_lonlat(at, "x", "y", ZONE, lon="lon2", lat="lat2")
    east, north = (F.col("lon2") - F.col("lon")) * projection.cosine(F.col("lat")), F.col("lat2") - F.col("lat")
    closing = F.sqrt(east * east + north * north) * 111_320.0
    digits = {"x": ("x", 4), "y": ("y", 4), "lon": ("lon2", 9), "lat": ("lat2", 9)}
    return back.select("place_id", projection.in_range(F.col("lon"), F.col("lat")).alias("on_globe"), *(projection.rounded(F.col(c), k).alias(n) for n, (c, k) in digits.items()), (closing < 1e-6).alias("closes"))


def _regridded(spark, sf):
    cells = regrid.cell_positions(view(spark, sf, "dem").select("r", "c"), WEST, NORTH, CELL_M, ZONE)
    found = regrid.on_cells(spark.sql(FORECAST, lineitem=table(spark, sf, "lineitem")), cells, per_second=True)
    return found.select("frame", "r", "c", steady(F.col("rate_mmh")).alias("rate_mmh"))


def _flow(spark, sf):
    return nowcast.windowed_flow(rain_cells(spark, sf), 0, 1, 5).select("r", "c", steady(F.col("u")).alias("u"), steady(F.col("v")).alias("v"))


QUERIES = {"p3_utm": _projected, "j14_regridded": _regridded, "w5_windowed_flow": _flow}


def _d(x: float) -> str:
    """A number that SQL reads as DOUBLE, to the last bit."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _polynomial(ks, x: str) -> str:
    text = _d(ks[0])
    for k in ks[1:]:
        text = f"({text} * {x} + {_d(k)})"
    return text


def _sines(a: str, n: str, degrees: bool) -> list[dict[str, str]]:
    """Steps to sin_n and cos_n of the column a. As everything in these statements they are sums, products, quotients, square roots and floors: the same bits in every engine."""
    first, rest = (_d(k) for k in projection.QUARTER)
    r = f"({a} - 90.0::DOUBLE * q_{n}) * {_d(projection.RADIAN)}" if degrees else f"({a} - q_{n} * {first}) - q_{n} * {rest}"
    return [
        {f"q_{n}": f"floor({a} / {'90.0::DOUBLE' if degrees else first} + 0.5::DOUBLE)"},
        {f"r_{n}": r, f"m_{n}": f"q_{n} - 4 * floor(q_{n} / 4)"},
        {f"z_{n}": f"r_{n} * r_{n}"},
        {f"s_{n}": f"r_{n} * {_polynomial(projection.SIN, f'z_{n}')}", f"c_{n}": _polynomial(projection.COS, f"z_{n}")},
        {f"sin_{n}": f"CASE m_{n} WHEN 0 THEN s_{n} WHEN 1 THEN c_{n} WHEN 2 THEN -s_{n} ELSE -c_{n} END", f"cos_{n}": f"CASE m_{n} WHEN 0 THEN c_{n} WHEN 1 THEN -s_{n} WHEN 2 THEN -c_{n} ELSE s_{n} END"},
    ]


def _angle(a: str, b: str, h: str, n: str) -> list[dict[str, str]]:
    """Steps to the angle n of (b, a), whose length is h."""
    half = lambda w: f"{w} / (1 + sqrt(1 + {w} * {w}))"
    return [
        {f"w_{n}": f"{a} / CASE WHEN {h} > 0 THEN {h} + abs({b}) ELSE 1 END"}, {f"v_{n}": half(f"w_{n}")}, {f"u_{n}": half(f"v_{n}")}, {f"z_{n}": f"u_{n} * u_{n}"},
        {f"a_{n}": f"8 * (u_{n} * {_polynomial(projection.ATAN, f'z_{n}')})"},
        {n: f"CASE WHEN {b} >= 0 THEN a_{n} ELSE CASE WHEN {a} >= 0 THEN {_d(math.pi)} ELSE {_d(-math.pi)} END - a_{n} END"},
    ]


def _hyperbolic(v: str, n: str) -> list[dict[str, str]]:
    """Steps to the hyperbolic sine n of v."""
    twice = lambda g: f"2 * {g} * sqrt(1 + {g} * {g})"
    return [{f"g_{n}": f"{v} * 0.25::DOUBLE"}, {f"z_{n}": f"g_{n} * g_{n}"}, {f"h_{n}": f"g_{n} * {_polynomial(projection.SINH, f'z_{n}')}"}, {f"i_{n}": twice(f"h_{n}")}, {n: twice(f"i_{n}")}]


def _multiples(s: str, c: str, n: str, sign: str) -> list[dict[str, str]]:
    """Steps to s2n, c2n and so on, of 2, 4, 6 and 8 times an angle."""
    return [
        {f"s2{n}": f"2 * {s} * {c}", f"c2{n}": f"1 {sign} 2 * {s} * {s}"},
        {f"s4{n}": f"2 * s2{n} * c2{n}", f"c4{n}": f"1 {sign} 2 * s2{n} * s2{n}"},
        {f"s6{n}": f"s4{n} * c2{n} + c4{n} * s2{n}", f"c6{n}": f"c4{n} * c2{n} {sign} s4{n} * s2{n}", f"s8{n}": f"2 * s4{n} * c4{n}", f"c8{n}": f"1 {sign} 2 * s4{n} * s4{n}"},
    ]


def _bent(series, along: str, across: str, n: str, sign: float) -> tuple[str, str]:
    """Both coordinates with the series of the multiples nt (plain) and nh (hyperbolic)."""
    a = along + "".join(f" + {_d(sign * k)} * s{j}{n}t * c{j}{n}h" for j, k in zip((2, 4, 6, 8), series, strict=True))
    b = across + "".join(f" + {_d(sign * k)} * c{j}{n}t * s{j}{n}h" for j, k in zip((2, 4, 6, 8), series, strict=True))
    return a, b


def _steps(source: str, name: str, steps: list[dict[str, str]]) -> str:
    """CTEs, one a step, from `source` to `name`; each adds columns."""
    names = [source, *(f"{name}{k}" for k in range(len(steps) - 1)), name]
    return ",\n".join(f"{new} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in step.items())} FROM {old})" for old, new, step in zip(names, names[1:], steps, strict=False))


def _lonlat_sql(source: str) -> str:
    """CTEs from `source` (with x and y) to `geo` (with lon2, lat2)."""
    a, b = _bent(projection.BACKWARD, "xi", "eta", "b", -1.0)
    lat = "chi" + "".join(f" + {_d(k)} * s{j}l" for j, k in zip((2, 4, 6, 8), projection.LATITUDE, strict=True))
    return _steps(source, "geo", [
        {"xi": f"y / {_d(projection.RADIUS)}", "eta": f"(x - {_d(projection.FALSE_EAST)}) / {_d(projection.RADIUS)}"},
        *_sines("xi", "xi", False), *_hyperbolic("eta", "se"), {"ce": "sqrt(1 + se * se)"},
        *_multiples("sin_xi", "cos_xi", "bt", "-"), *_multiples("se", "ce", "bh", "+"), {"s1": a, "s2": b},
        *_sines("s1", "s1", False), *_hyperbolic("s2", "sb"), {"g": "sqrt(sb * sb + cos_s1 * cos_s1)"}, {"hyp": "sqrt(sin_s1 * sin_s1 + g * g)"},
        *_angle("sin_s1", "g", "hyp", "chi"), *_angle("sb", "cos_s1", "g", "lam"), {"sc": "sin_s1 / hyp", "cc": "g / hyp"}, *_multiples("sc", "cc", "l", "-"),
        {"lon2": f"lam * {_d(projection.DEGREE)} + {projection.central_meridian(ZONE)}", "lat2": f"({lat}) * {_d(projection.DEGREE)}"},
    ])


def _utm_sql() -> str:
    e = _d(projection.ECCENTRICITY)
    a, b = _bent(projection.FORWARD, "p1", "p2", "f", 1.0)
    third = lambda t: f"{t} / sqrt(2 * (1 + sqrt(1 + {t} * {t})))"
    forward = _steps("t", "xy", [
        *_sines("lat", "lat", True), *_sines("turn", "turn", True),
        {"e1": f"{e} * sin_lat"}, {"ze": "e1 * e1"}, {"e2": f"{e} * (e1 * {_polynomial(projection.ATANH, 'ze')})"}, {"zs": "e2 * e2"}, {"lift": f"e2 * {_polynomial(projection.SINH, 'zs')}"},
        {"up": "sin_lat * sqrt(1 + lift * lift) - lift", "flat": "cos_lat * cos_turn"}, {"h": "nullif(sqrt(up * up + flat * flat), 0)"}, {"sn": "up / h", "cs": "flat / h", "sh": "cos_lat * sin_turn / h"},
        {"ch": "sqrt(1 + sh * sh)", "t1": third("sh")}, {"t2": third("t1")}, {"t3": third("t2")}, {"zt": "t3 / (1 + sqrt(1 + t3 * t3))"}, {"zz": "zt * zt"}, {"p2": f"16 * (zt * {_polynomial(projection.ATANH, 'zz')})"},
        *_angle("up", "flat", "h", "p1"), *_multiples("sn", "cs", "ft", "-"), *_multiples("sh", "ch", "fh", "+"), {"along": a, "across": b},
        {"x": f"CASE WHEN on_globe THEN {_d(projection.FALSE_EAST)} + {_d(projection.RADIUS)} * across END", "y": f"CASE WHEN on_globe THEN {_d(projection.RADIUS)} * along END"},
    ])
    near = lambda c, k: f"floor(({c} + {_d(1e-9)}) * {_d(10.0**k)} + 0.5::DOUBLE) / {_d(10.0**k)}"
    return f"""
WITH places AS ({PLACES.replace("{customer}", "customer")}),
t AS (SELECT *, coalesce(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, false) AS on_globe, lon - {projection.central_meridian(ZONE)} AS turn FROM places),
{forward},
{_lonlat_sql("xy")},
gap AS (SELECT *, (lon2 - lon) * cos_lat AS de, lat2 - lat AS dn FROM geo)
SELECT place_id, on_globe, {near("x", 4)} AS x, {near("y", 4)} AS y, {near("lon2", 9)} AS lon, {near("lat2", 9)} AS lat, sqrt(de * de + dn * dn) * 111320 < {_d(1e-6)} AS closes FROM gap"""


def _regrid_sql() -> str:
    return with_views("dem") + f""",
fc AS ({FORECAST.replace("{lineitem}", "lineitem")}),
lats AS (SELECT lat AS at, row_number() OVER (ORDER BY lat) - 1 AS place, lead(lat) OVER (ORDER BY lat) AS nxt, count(*) OVER () AS n FROM (SELECT DISTINCT lat FROM fc)),
lons AS (SELECT lon AS at, row_number() OVER (ORDER BY lon) - 1 AS place, lead(lon) OVER (ORDER BY lon) AS nxt, count(*) OVER () AS n FROM (SELECT DISTINCT lon FROM fc)),
xy AS (SELECT r, c, {WEST} + (c + 0.5) * {CELL_M} AS x, {NORTH} - (r + 0.5) * {CELL_M} AS y FROM dem),
{_lonlat_sql("xy")},
placed AS (
  SELECT g.r, g.c, a.place AS i, b.place AS j, (lat2 - a.at) / (a.nxt - a.at) AS fi, (lon2 - b.at) / (b.nxt - b.at) AS fj FROM geo g
  JOIN lats a ON a.nxt IS NOT NULL AND (a.place = 0 OR g.lat2 >= a.at) AND (a.place = a.n - 2 OR g.lat2 < a.nxt)
  JOIN lons b ON b.nxt IS NOT NULL AND (b.place = 0 OR g.lon2 >= b.at) AND (b.place = b.n - 2 OR g.lon2 < b.nxt)
), src AS (SELECT frame, a.place AS i, b.place AS j, rate * 3600 AS rate FROM fc JOIN lats a ON a.at = fc.lat JOIN lons b ON b.at = fc.lon),
frames AS (SELECT DISTINCT frame FROM fc)
SELECT f.frame, p.r, p.c, round(greatest(0.0, least(300.0, (1 - fi) * (1 - fj) * coalesce(s.rate, 0) + (1 - fi) * fj * coalesce(t.rate, 0) + fi * (1 - fj) * coalesce(u.rate, 0) + fi * fj * coalesce(v.rate, 0))) + 1e-9, 6) AS rate_mmh
FROM placed p CROSS JOIN frames f LEFT JOIN src s ON s.frame = f.frame AND s.i = p.i AND s.j = p.j LEFT JOIN src t ON t.frame = f.frame AND t.i = p.i AND t.j = p.j + 1
LEFT JOIN src u ON u.frame = f.frame AND u.i = p.i + 1 AND u.j = p.j LEFT JOIN src v ON v.frame = f.frame AND v.i = p.i + 1 AND v.j = p.j + 1"""


def _flow_sql(half: int = 2) -> str:
    """Every window unrolled: (2 * half + 1)^2 neighbours a cell."""
    sums = ", ".join(f"sum(k * b.{a} * b.{b}) AS g{a[1]}{b[1]}" for a, b in (("ix", "ix"), ("iy", "iy"), ("ix", "iy"), ("ix", "it"), ("iy", "it")))
    weights = ", ".join(f"({dy}, {dx}, {_d(math.exp(-(dx * dx + dy * dy) / (2.0 * half * half)))})" for dy in range(-half, half + 1) for dx in range(-half, half + 1))
    return f"""
WITH rain AS ({RAIN_SQL}), f AS (
  SELECT n.r, n.c, n.rate_mmh AS v, n.rate_mmh - p.rate_mmh AS it FROM rain n JOIN rain p ON n.frame = 1 AND p.frame = 0 AND p.r = n.r AND p.c = n.c
), d AS (
  SELECT r, c, it, (coalesce(lead(v) OVER x, v) - coalesce(lag(v) OVER x, v)) / 2 AS ix, (coalesce(lead(v) OVER y, v) - coalesce(lag(v) OVER y, v)) / 2 AS iy
  FROM f WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)
), w(dy, dx, k) AS (VALUES {weights}),
g AS (SELECT a.r, a.c, {sums} FROM d a CROSS JOIN w JOIN d b ON b.r = a.r + w.dy AND b.c = a.c + w.dx GROUP BY a.r, a.c),
s AS (SELECT max(r) AS h1, max(c) AS w1 FROM rain WHERE frame = 1)
SELECT r, c, round(CASE WHEN r BETWEEN {half} AND h1 - {half} AND c BETWEEN {half} AND w1 - {half} THEN -(gyy * gxt - gxy * gyt) / (gxx * gyy - gxy * gxy + {_d(nowcast.FLOW_FLOOR)}) ELSE 0 END + 1e-9, 6) AS u,
       round(CASE WHEN r BETWEEN {half} AND h1 - {half} AND c BETWEEN {half} AND w1 - {half} THEN -(gxx * gyt - gxy * gxt) / (gxx * gyy - gxy * gxy + {_d(nowcast.FLOW_FLOOR)}) ELSE 0 END + 1e-9, 6) AS v
FROM g, s"""


ORACLES = {"p3_utm": _utm_sql(), "j14_regridded": _regrid_sql(), "w5_windowed_flow": _flow_sql()}
