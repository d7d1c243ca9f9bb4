"""Projections, brackets, regridding and flow against plain versions."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest

from rillspark.functions import projection
from rillspark.operators import nowcast, regrid


def utm(lon, lat, zone):
    """By numerical integration of the meridian and the exact Gauss series of Redfearn, good to a millimetre inside a zone."""
    a, f, k0 = projection.AXIS, projection.FLATTENING, projection.SCALE
    e2 = f * (2 - f)
    phi, lam = math.radians(lat), math.radians(lon - projection.central_meridian(zone))
    steps = np.linspace(0, phi, 20001)
    integrand = a * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5
    meridian = np.sum((integrand[1:-1:2] * 4 + integrand[:-2:2] + integrand[2::2])) * (steps[1] - steps[0]) / 3
    nu, rho, t = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), a * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5, math.tan(phi)
    psi, c = nu / rho, math.cos(phi)
    x = lam * c + lam**3 * c**3 / 6 * (psi - t**2) + lam**5 * c**5 / 120 * (4 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 + 8 * t**2) - psi * 2 * t**2 + t**4) + lam**7 * c**7 / 5040 * (61 - 479 * t**2 + 179 * t**4 - t**6)
    y = lam**2 * c / 2 + lam**4 * c**3 / 24 * (4 * psi**2 + psi - t**2) + lam**6 * c**5 / 720 * (8 * psi**4 * (11 - 24 * t**2) - 28 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 - 32 * t**2) - psi * 2 * t**2 + t**4)
    return 500000 + k0 * nu * x, k0 * (meridian + nu * math.sin(phi) * y)


def test_utm_against_integration(spark):
    places = [(88.3639, 22.5726), (87.0, 0.0), (84.1, 60.0), (89.9, 45.5), (86.5, -33.0), (85.0, 79.0)]
    frame = spark.createDataFrame(places, "lon double, lat double")
    rows = projection.with_lonlat(projection.with_utm(frame, "lon", "lat", 45), "x", "y", 45, lon="lon2", lat="lat2").collect()
    for r in rows:
        x, y = utm(r.lon, r.lat, 45)
        assert abs(r.x - x) < 1e-3 and abs(r.y - y) < 1e-3, (r.lon, r.lat)
        assert abs(r.lon - r.lon2) * 111_000 < 1e-5 and abs(r.lat - r.lat2) * 111_000 < 1e-5
    south = projection.with_utm(frame, "lon", "lat", 45, south=True).collect()
    assert all(abs(s.y - r.y - 1e7) < 1e-6 for s, r in zip(south, rows, strict=True))


def test_points_off_the_globe(spark):
    frame = spark.createDataFrame([(181.0, 0.0), (0.0, -90.5), (None, 1.0), (float("nan"), 1.0), (180.0, 90.0)], "lon double, lat double")
    rows = projection.with_utm(frame, "lon", "lat", 45).collect()
    assert [r.x is None and r.y is None for r in rows] == [True, True, True, True, False]
    with pytest.raises(ValueError, match="zones"):
        projection.central_meridian(61)


def test_brackets_on_uneven_axes(spark):
    rng = np.random.default_rng(2)
    for axis in (np.sort(rng.normal(size=40)), np.array([0.0, 1e-9, 1.0, 1000.0, 1000.5]), np.array([3.0, 4.0])):
        values = np.r_[rng.uniform(axis[0] - 2, axis[-1] + 2, 300), axis, axis[0] - 1e6, axis[-1] + 1e6]
        found = regrid.brackets(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, v double"), spark.createDataFrame([(k, float(v)) for k, v in enumerate(axis)], "place long, at double"), "v", "i", "f").collect()
        assert len(found) == len(values)
        for r in found:
            low = int(np.clip(np.searchsorted(axis, r.v, side="right") - 1, 0, len(axis) - 2))
            assert r.i == low and math.isclose(r.f, (r.v - axis[low]) / (axis[low + 1] - axis[low]), rel_tol=1e-12, abs_tol=1e-12)
    one = regrid.brackets(spark.createDataFrame([(1.0,), (None,)], "v double"), spark.createDataFrame([(0, 5.0)], "place long, at double"), "v", "i", "f").collect()
    assert [(r.i, r.f) for r in one] == [(0, 0.0)]


def test_fields_on_cells(spark):
    """A plane stays a plane, inside and on all four sides outside; holes count as dry; rates are clipped."""
    lats, lons = [22.0, 22.1, 22.4, 22.5], [88.0, 88.3, 88.35]
    plane = lambda lat, lon: 20 * (lat - 21.5) + 8 * (lon - 87.5)
    field = [(1, lat, lon, plane(lat, lon)) for lat in lats for lon in lons] + [(2, lat, lon, 1000.0) for lat in lats for lon in lons] + [(3, 22.1, 88.3, None), (3, 22.0, 88.0, float("nan")), (3, 22.1, 88.0, 7.0)]
    targets = [(0, 0, 88.1, 22.05), (0, 1, 87.8, 22.2), (1, 0, 88.6, 22.45), (1, 1, 88.2, 21.9), (2, 0, 88.2, 22.9), (2, 1, 88.0, 22.1)]
    cells = spark.createDataFrame(targets, "r int, c int, lon double, lat double")
    found = {(x.frame, x.r, x.c): x.rate_mmh for x in regrid.on_cells(spark.createDataFrame(field, "frame int, lat double, lon double, rate double"), cells).collect()}
    assert len(found) == 18
    for r, c, lon, lat in targets:
        assert abs(found[1, r, c] - plane(lat, lon)) < 1e-9 and found[2, r, c] == 300.0
    assert found[3, 2, 1] == 7.0 and found[3, 2, 0] == 0.0
    again = {(x.frame, x.r, x.c): x.rate_mmh for x in regrid.on_cells(spark.createDataFrame([(1, *x[1:3], x[3] / 3600) for x in field if x[0] == 1], "frame int, lat double, lon double, rate double"), cells, per_second=True).collect()}
    assert all(abs(again[k] - found[k]) < 1e-9 for k in again)


@pytest.mark.parametrize("window", [1, 3, 5, 7])
def test_flow_against_loops(spark, window, monkeypatch):
    """Small tiles, so that windows reach over their borders."""
    from rillspark.functions import shared

    monkeypatch.setattr(nowcast, "tiled", lambda cells, place, halo: shared.tiled(cells, place, halo, 5))
    rng = np.random.default_rng(4)
    h, w, half = 13, 17, max(1, window // 2)
    y, x = np.mgrid[0:h, 0:w]
    past, now = (10 * np.exp(-((x - 7 - dx) ** 2 + (y - 6) ** 2) / 12) + rng.random((h, w)) for dx in (0, 1))
    ix, iy, it = np.zeros((h, w)), np.zeros((h, w)), now - past
    for r in range(h):
        for c in range(w):
            ix[r, c] = 0.5 * (now[r, min(c + 1, w - 1)] - now[r, max(c - 1, 0)])
            iy[r, c] = 0.5 * (now[min(r + 1, h - 1), c] - now[max(r - 1, 0), c])
    rows = [(f, r, c, float(v[r, c])) for f, v in enumerate((past, now)) for r in range(h) for c in range(w)]
    found = nowcast.windowed_flow(spark.createDataFrame(rows, "frame int, r int, c int, rate_mmh double"), 0, 1, window).collect()
    assert len(found) == h * w
    for cell in found:
        u = v = 0.0
        if half <= cell.r < h - half and half <= cell.c < w - half:
            s = dict.fromkeys(("xx", "yy", "xy", "xt", "yt"), 0.0)
            for dy in range(-half, half + 1):
                for dx in range(-half, half + 1):
                    at, k = (cell.r + dy, cell.c + dx), math.exp(-(dx * dx + dy * dy) / (2 * half * half))
                    for name, value in (("xx", ix[at] ** 2), ("yy", iy[at] ** 2), ("xy", ix[at] * iy[at]), ("xt", ix[at] * it[at]), ("yt", iy[at] * it[at])):
                        s[name] += k * value
            det = s["xx"] * s["yy"] - s["xy"] ** 2 + 1e-5
            u, v = -(s["yy"] * s["xt"] - s["xy"] * s["yt"]) / det, -(s["xx"] * s["yt"] - s["xy"] * s["xt"]) / det
        assert math.isclose(cell.u, u, rel_tol=1e-7, abs_tol=1e-9) and math.isclose(cell.v, v, rel_tol=1e-7, abs_tol=1e-9)
    assert spark.createDataFrame([], "frame int, r int, c int, rate_mmh double").transform(lambda d: nowcast.windowed_flow(d, 0, 1)).count() == 0


def test_projection_has_the_same_bits_as_its_sql(spark, tmp_path):
    """no sine of a mathematical library on either side (their last bits differ), and every place of a larger table agrees, unrounded."""
    import duckdb

    from rillspark.plans import q_grids

    text = q_grids.ORACLES["p3_utm"]
    assert not re.search(r"\b(sin|cos|tan|sinh|cosh|atan2|asinh|atanh|radians|degrees|pow|round)\(", text)
    spark.range(20000).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    whole = text[: text.rindex("SELECT place_id")] + "SELECT place_id, x, y, lon2, lat2, cos_lat FROM gap ORDER BY place_id"
    at = projection.with_lonlat(projection.with_utm(q_grids._places(spark, str(tmp_path)), "lon", "lat", q_grids.ZONE), "x", "y", q_grids.ZONE, lon="lon2", lat="lat2")
    found = at.select("place_id", "x", "y", "lon2", "lat2", projection.cosine("lat")).orderBy("place_id").collect()
    assert [r[:5] for r in con.execute(whole).fetchall()] == [tuple(r)[:5] for r in found]
    assert sorted(con.execute(text).fetchall()) == sorted(map(tuple, q_grids.QUERIES["p3_utm"](spark, str(tmp_path)).collect()))


def test_angles_against_the_mathematical_library():
    a = np.r_[np.linspace(-400, 400, 4001), [0.0, 90.0, -90.0, 180.0, 270.0]]
    s, c = projection._of_degrees(a)
    assert np.abs(s - np.sin(np.radians(a))).max() < 2e-15 and np.abs(c - np.cos(np.radians(a))).max() < 2e-15
    s, c = projection._of_radians(np.radians(a))
    assert np.abs(s - np.sin(np.radians(a))).max() < 1e-15 and np.abs(c - np.cos(np.radians(a))).max() < 1e-15
    x, y = np.cos(np.radians(a)), np.sin(np.radians(a))
    assert np.abs(projection._angle(y, x, np.sqrt(x * x + y * y)) - np.arctan2(y, x)).max() < 2e-15
    v = np.linspace(-4, 4, 4001)
    assert np.allclose(projection._sinh(v), np.sinh(v), rtol=1e-14, atol=0) and np.allclose(projection._area_sine(np.sinh(v)), v, rtol=1e-14, atol=0)
