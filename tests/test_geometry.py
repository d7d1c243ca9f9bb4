"""Geometries: WKB and WKT, files with and without metadata, crossings against brute force, the ladder on odd rows."""

from __future__ import annotations

import itertools
import json
import random
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rillspark.operators import geometry
from rillspark.sources import geo

LINE = np.array([(0.0, 1.5), (2.0, -3.0), (4.5, 1e9)])


def test_wkb_of_all_kinds():
    for kind, parts in (("Point", [LINE[:1]]), ("LineString", [LINE]), ("Polygon", [np.r_[LINE, LINE[:1]], np.r_[LINE[::-1], LINE[2:]]]), ("MultiPoint", [LINE[:1], LINE[1:2]]), ("MultiLineString", [LINE, LINE[:2]])):
        found, some = geometry.from_wkb(geometry.to_wkb(kind, parts))
        assert found == kind and all(np.array_equal(a, b) for a, b in zip(some, parts, strict=True))
    big = struct.pack(">BII4d", 0, 2, 2, 1, 2, 3, 4)
    assert np.array_equal(geometry.from_wkb(big)[1][0], [(1, 2), (3, 4)])
    for code, head in ((2 | geometry.HAS_Z, b""), (1002, b""), (2 | geometry.HAS_SRID | geometry.HAS_Z, struct.pack("<I", 4326)), (2002, b"")):
        data = struct.pack("<BI", 1, code) + head + struct.pack("<I6d", 2, 1, 2, 9, 3, 4, 9)
        assert np.array_equal(geometry.from_wkb(data)[1][0], [(1, 2), (3, 4)])
    many = struct.pack("<BII", 1, 6, 2) + geometry.to_wkb("Polygon", [LINE]) * 2
    assert geometry.from_wkb(many)[0] == "MultiPolygon" and len(geometry.from_wkb(many)[1]) == 2
    mixed = struct.pack("<BII", 1, 7, 2) + geometry.to_wkb("Point", [LINE[:1]]) + geometry.to_wkb("LineString", [LINE])
    assert geometry.from_wkb(mixed)[0] == "GeometryCollection" and len(geometry.from_wkb(mixed)[1]) == 2
    assert geometry.from_wkb(geometry.to_wkb("Point", [])) == ("Point", [])
    for data in (b"", b"\x01", b"\x07" + many[1:], many[:-1], many + b"\x00", struct.pack("<BII", 1, 2, 10**9), struct.pack("<BI", 1, 99)):
        with pytest.raises(ValueError):
            geometry.from_wkb(data)


def test_wkt():
    read = lambda t: (geometry.from_wkt(t)[0], [p.tolist() for p in geometry.from_wkt(t)[1]])
    assert read("POINT (1 2)") == ("Point", [[[1, 2]]])
    assert read(" linestring z(1 2 3, -4.5e1 5 6) ") == ("LineString", [[[1, 2], [-45, 5]]])
    assert read("SRID=4326;POLYGON ((0 0, 1 0, 0 1, 0 0), (2 2, 3 2, 2 3, 2 2))")[1][1][1] == [3, 2]
    assert read("MULTIPOLYGON (((0 0, 1 0, 0 1, 0 0)), ((2 2, 3 2, 2 3, 2 2)))")[0] == "MultiPolygon"
    assert read("MULTILINESTRING ((0 0, 1 0), (2 2, 3 2))") == ("MultiLineString", [[[0, 0], [1, 0]], [[2, 2], [3, 2]]])
    assert read("MULTIPOINT (1 2, 3 4)") == read("MULTIPOINT ((1 2), (3 4))") == ("MultiPoint", [[[1, 2]], [[3, 4]]])
    assert read("LINESTRING EMPTY") == ("LineString", [])
    for text in ("", "LINE (1 2)", "POINT (1)", "POINT 1 2", "LINESTRING (1 2, x y)", "POLYGON (0 0, 1 1)", "LINESTRING (1 2, 3 4"):
        with pytest.raises(ValueError):
            geometry.from_wkt(text)


def written(path, column, metadata):
    rows = pa.table({"id": [1, 2], column: [geometry.to_wkb("LineString", [LINE]), None], "other": ["a", "b"]})
    pq.write_table(rows.replace_schema_metadata(metadata), path)


@pytest.mark.parametrize(
    ("column", "metadata", "found", "note"),
    [
        ("shape", {"geo": json.dumps({"primary_column": "shape", "columns": {"shape": {"crs": "EPSG:32645"}}})}, "shape", None),
        ("geom", {}, "geom", "no geo metadata"),
        ("wkb_geometry", {"geo": "{not json"}, "wkb_geometry", "cannot be parsed"),
        ("geometry", {"geo": json.dumps({"primary_column": "gone"})}, "geometry", "not there"),
        ("shape", {}, None, "no geo metadata"),
    ],
)
def test_geometry_column(spark, tmp_path, column, metadata, found, note):
    path = str(tmp_path / "a.parquet")
    written(path, column, metadata)
    got = geo.geometry_column(spark, path)
    assert got.name == found and (note is None and not got.notes or any(note in n for n in got.notes))
    if found is None:
        with pytest.raises(ValueError, match="no geometry column"):
            geo.scan(spark, path)
    else:
        rows = {r.id: r for r in geo.scan(spark, path).collect()}
        assert [(p.x, p.y) for p in rows[1].parts[0]] == [tuple(p) for p in LINE] and rows[2].geom_state == "MISSING" and rows[1].other == "a"
    assert got.crs == ("EPSG:32645" if note is None else None)


def features(spark, rows):
    return spark.createDataFrame([(k, kind, "READ", [[(float(x), float(y)) for x, y in p] for p in parts]) for k, kind, parts in rows], f"ord long, geom_type string, geom_state string, parts {geometry.PARTS}")


def brute_crossed(parts):
    segs = [(k, i, len(m), *s) for k, p in enumerate(parts) for m in [[(a, b) for a, b in itertools.pairwise(p) if a != b]] for i, s in enumerate(m)]
    turn = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    on = lambda p, q, r: turn(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    for (k, i, n, a, b), (l, j, _, c, d) in itertools.combinations(segs, 2):
        if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
            return True
        if k == l:
            beside = abs(i - j) == 1 or {i, j} == {0, n - 1}
            if not beside and (on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b)):
                return True
            if beside and turn(a, b, c) == 0 and turn(a, b, d) == 0 and (b[0] - a[0]) * (d[0] - c[0]) + (b[1] - a[1]) * (d[1] - c[1]) < 0:
                return True
    return False


def test_crossings_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        n = rng.randrange(3, 14)
        ring = [(rng.randrange(12), rng.randrange(12)) for _ in range(n)]
        if k % 3 == 0:  # around a centre: often simple
            ring = [(round(50 + (5 + 30 * (k % 2) * rng.random()) * np.cos(t), 3), round(50 + 20 * np.sin(t), 3)) for t in np.linspace(0, 6, n)]
        parts = [[*ring, ring[0]]]
        if k % 5 == 0:
            parts.append([(x + 2, y + 3) for x, y in parts[0]])
        rows.append((k, "Polygon", parts))
    rows.append((900, "Polygon", [[(x, (x * 7919) % 1000 if x % 2 else 0) for x in range(400)] + [(0, -5)] + [(0, 0)]]))
    rows.append((901, "Polygon", [[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]]))  # touches its own edge
    rows.append((902, "Polygon", [[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(0, 0), (3, 1), (1, 3), (0, 0)]]))  # a hole may touch in a point
    found = {r.ord for r in geometry.crossed(features(spark, rows), "ord").collect()}
    assert found == {k for k, _, parts in rows if brute_crossed(parts)} and 0 < len(found) < len(rows) and 901 in found and 902 not in found


def test_ladder_on_odd_rows(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    data = [
        (1, None, "MISSING_GEOMETRY"), (2, b"junk", "UNPARSEABLE_GEOMETRY"), (3, geometry.to_wkb("LineString", []), "EMPTY_GEOMETRY"), (4, geometry.to_wkb("LineString", [np.zeros((3, 2))]), "INVALID_GEOMETRY"),
        (5, geometry.to_wkb("LineString", [np.array([(0, 0), (np.nan, 1)])]), "INVALID_GEOMETRY"), (6, geometry.to_wkb("LineString", [np.array([(0, 0), (np.inf, 1)])]), "INVALID_GEOMETRY"),
        (7, geometry.to_wkb("Polygon", [np.array(square[:4])]), "INVALID_GEOMETRY"), (8, geometry.to_wkb("Polygon", [np.array([square[k] for k in (0, 2, 1, 3, 0)])]), "INVALID_GEOMETRY"),
        (9, geometry.to_wkb("Polygon", [np.array(square)]), "UNSUPPORTED_GEOMETRY"), (10, geometry.to_wkb("Point", [LINE[:1]]), "UNSUPPORTED_GEOMETRY"),
        (11, geometry.to_wkb("LineString", [np.array([(0, 0), (2, 2), (0, 2), (2, 0)])]), None),  # lines may cross themselves
        (12, geometry.to_wkb("MultiLineString", [LINE, LINE[:2]]), None), (13, geometry.to_wkb("MultiLineString", [LINE, LINE[:1]]), "INVALID_GEOMETRY"), (14, b"", "UNPARSEABLE_GEOMETRY"),
    ]
    rows = spark.createDataFrame([(k, b, "p") for k, b, _ in data], "ord long, geometry binary, parts_ string")
    found = {r.ord: r.rejection for r in geometry.laddered(geometry.decoded(rows, "geometry"), "ord").collect()}
    assert found == {k: rung for k, _, rung in data}
    assert geometry.laddered(geometry.decoded(rows.limit(0), "geometry"), "ord").count() == 0
    every = geometry.laddered(geometry.decoded(rows, "geometry"), "ord", supported=("Polygon", "Point")).where("rejection IS NULL")
    assert {r.ord for r in every.collect()} == {9, 10}


def test_text_geometries_and_audit(spark):
    rows = spark.createDataFrame([(1, "a", "POINT (1 2)"), (2, "a", "LINESTRING (3 -4, 5 6)"), (3, None, "LINESTRING (0 0, 1 1)"), (4, "b", None), (5, "c", "oops")], "ord long, source_id string, geometry string")
    read = geometry.decoded(rows, "geometry")
    r = geometry.geometry_audit(read).first()
    assert (r.records, r.geometry_type, r.missing, r.unparseable, r.empty, r.unsupported, r.duplicate_ids, r.status) == (5, "LineString", 1, 1, 0, 1, 1, "AUDIT_PARTIAL")
    assert (r.west, r.south, r.east, r.north) == (0, -4, 5, 6)
    assert geometry.geometry_audit(read.where("ord > 3")).first().status == "BLOCKED" and geometry.geometry_audit(read.where("ord > 3")).first().geometry_type == "NONE"
    assert geometry.geometry_audit(read.limit(0)).first().status == "BLOCKED" and geometry.geometry_audit(read.where("ord < 4")).first().status == "VALIDATED"


def test_hydraulic_attributes(spark):
    rows = spark.createDataFrame([(1, "250", 1.5), (2, " 3e2 ", None), (3, "wide", float("nan")), (4, None, 2.0)], "ord long, `Dia (mm)` string, z double")
    found = geometry.hydraulic(rows, (("dia (mm)", "diameter_m", 0.001, ""), ("z", "invert_m", 1.0, "survey"), ("gone", "x", 1.0, "")), "ord")
    got = {(r.ord, r.target): (r.value, r.availability) for r in found.collect()}
    assert got == {(1, "diameter_m"): (0.25, "PRESENT"), (2, "diameter_m"): (0.3, "PRESENT"), (3, "diameter_m"): (None, "MISSING"), (4, "diameter_m"): (None, "MISSING"), (1, "invert_m"): (1.5, "DERIVED"), (2, "invert_m"): (None, "MISSING"), (3, "invert_m"): (None, "MISSING"), (4, "invert_m"): (2.0, "DERIVED")}
    assert geometry.hydraulic(rows, (("gone", "x", 1.0, ""),), "ord").count() == 0
