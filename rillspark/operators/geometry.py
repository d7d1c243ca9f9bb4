"""Geometries as columns: WKB and WKT to parts of points and back, validity, the ladder of rejections, hydraulic attributes, audits.

A decoded geometry is its type, a state (MISSING, UNPARSEABLE, EMPTY or READ) and its parts: the points of points, lines and rings, in order. All that
follows is DataFrame code on these columns; a ring's crossings are found by a join of its segments on the cells of a grid of its own size.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.functions.shared import settled
from rillspark.operators import audit

# Numbers of geometry types, and flags of the extended format.
TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000
LINES, AREAS = ("LineString", "MultiLineString"), ("Polygon", "MultiPolygon")

PARTS = "array<array<struct<x:double,y:double>>>"
_WKT = re.compile(r"\s*(?:SRID=\d+;)?\s*([A-Z]+)\s*(?:Z|M|ZM)?\s*(EMPTY|\(.*\))\s*", re.IGNORECASE | re.DOTALL)
_NUMBERS = re.compile(r"[-+.\deE]+(?:\s+[-+.\deE]+)+")


def _read(data: bytes, at: int) -> tuple[str, list[np.ndarray], int]:
    """Type, parts and end of the WKB geometry that begins at a place."""
    order = {0: ">", 1: "<"}[data[at]]
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 5 + 4 * bool(code & HAS_SRID)
    base, iso = (code & 0x0FFFFFFF) % 1000, (code & 0x0FFFFFFF) // 1000
    width = 2 + (bool(code & HAS_Z) or iso in (1, 3)) + (bool(code & HAS_M) or iso in (2, 3))

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
        return n

    def points(n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, f"{order}f8", n * width, at).reshape(n, width)[:, :2]
        at += 8 * n * width
        return found

    name = TYPES[base]
    if base == 1:
        here = points(1)
        return name, [] if np.isnan(here).all() else [here], at
    if base == 2:
        here = points(count())
        return name, [here] if len(here) else [], at
    if base == 3:
        return name, [ring for _ in range(count()) if len(ring := points(count()))], at
    parts: list[np.ndarray] = []
    for _ in range(count()):
        _, some, at = _read(data, at)
        parts += some
    return name, parts, at


def from_wkb(data: bytes) -> tuple[str, list[np.ndarray]]:
    """Type and parts; ValueError if the bytes are not one whole geometry."""
    try:
        name, parts, end = _read(data, 0)
    except (KeyError, IndexError, struct.error) as error:
        raise ValueError("not WKB") from error
    if end != len(data):
        raise ValueError("bytes after the geometry")
    return name, parts


def from_wkt(text: str) -> tuple[str, list[np.ndarray]]:
    """Type and parts; ValueError if the text is not one geometry. Collections are not read."""
    found = _WKT.fullmatch(text)
    names = {n.upper(): n for n in TYPES.values()}
    if not found or found[1].upper() not in names or found[1].upper() == "GEOMETRYCOLLECTION":
        raise ValueError("not WKT")
    name = names[found[1].upper()]
    if found[2].upper() == "EMPTY":
        return name, []
    try:
        nested = json.loads(_NUMBERS.sub(lambda m: "[" + ",".join(repr(float(x)) for x in m[0].split()) + "]", found[2].replace("(", "[").replace(")", "]")))
        depth = {"Point": 0, "LineString": 0, "MultiPoint": 0, "Polygon": 1, "MultiLineString": 1, "MultiPolygon": 2}[name]
        for _ in range(depth - 1):
            nested = [ring for polygon in nested for ring in polygon]
        parts = [np.array(p, float) for p in (nested if depth else [nested])]
        if name == "MultiPoint":
            parts = [p.reshape(1, -1) for p in np.array(nested, float).reshape(len(nested), -1)]
        if any(p.ndim != 2 or p.shape[1] < 2 for p in parts):
            raise ValueError("points need two numbers")
    except (json.JSONDecodeError, TypeError) as error:
        raise ValueError("not WKT") from error
    return name, [p[:, :2] for p in parts]


def to_wkb(kind: str, parts: list[np.ndarray]) -> bytes:
    """Little-endian WKB of a point, line, polygon or several points or lines."""
    code = {n: c for c, n in TYPES.items()}[kind]
    row = lambda p: np.ascontiguousarray(p, "<f8").tobytes()
    head = struct.pack("<BI", 1, code)
    if kind == "Point":
        return head + (row(parts[0][:1]) if parts else row(np.full((1, 2), np.nan)))
    if kind == "LineString":
        return head + struct.pack("<I", len(parts[0]) if parts else 0) + (row(parts[0]) if parts else b"")
    if kind == "Polygon":
        return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(p)) + row(p) for p in parts)
    if kind in ("MultiPoint", "MultiLineString"):
        return head + struct.pack("<I", len(parts)) + b"".join(to_wkb(kind[5:], [p]) for p in parts)
    raise ValueError(f"{kind} is not written")


def _nested(rows: list[list[np.ndarray] | None]) -> pa.Array:
    """Parts of many rows as one Arrow array, from flat coordinates and two levels of offsets."""
    flat = [p for parts in rows for p in parts or ()]
    xy = np.concatenate(flat) if flat else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k], np.float64)) for k in (0, 1)], ["x", "y"])
    ends = np.cumsum([0, *map(len, flat)])
    places = np.cumsum([0, *(len(parts or ()) for parts in rows)])
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points))


def decoded(rows: DataFrame, geometry: str) -> DataFrame:
    """`rows` with geom_type, geom_state, parts and geom_key (digest of type and coordinates) in place of the column `geometry` (WKB as binary, or WKT as string)."""
    kept = [f for f in rows.schema if f.name != geometry]
    as_text = dict(rows.dtypes)[geometry] == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, states, parts = [], [], []
            for data in batch.column(len(kept)).to_pylist():
                try:
                    kind, some = (None, None) if data is None else from_wkt(data) if as_text else from_wkb(data)
                    state = "MISSING" if data is None else "READ" if some else "EMPTY"
                except ValueError:
                    kind, some, state = None, None, "UNPARSEABLE"
                kinds.append(kind)
                states.append(state)
                parts.append(some)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(kinds, pa.string()), pa.array(states, pa.string()), _nested(parts)], names=[*(f.name for f in kept), "geom_type", "geom_state", "parts"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"geom_type string, geom_state string, parts {PARTS}"])
    found = rows.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{geometry}`")).mapInArrow(run, schema)
    return found.withColumn("geom_key", F.when(F.col("geom_state") == "READ", F.sha2(F.concat_ws(":", "geom_type", F.to_json("parts")), 256)))


def encoded(rows: DataFrame, geometry: str = "geometry") -> DataFrame:
    """`rows` (with geom_type and parts) with WKB in a column `geometry`; null where geom_type is null."""
    kept = [f for f in rows.schema if f.name not in ("geom_type", "parts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, parts = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
            data = [None if k is None else to_wkb(k, [np.array([(q["x"], q["y"]) for q in part]) for part in p or ()]) for k, p in zip(kinds, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(data, pa.binary())], names=[*(f.name for f in kept), geometry])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{geometry}` binary"])
    return rows.select(*(F.col(f"`{f.name}`") for f in kept), "geom_type", F.col("parts").cast(PARTS).alias("parts")).mapInArrow(run, schema)


def coordinates(features: DataFrame, *keys: str) -> DataFrame:
    """A row for each point: keys, part, place, x, y (both places from 0)."""
    parts = features.select(*keys, F.posexplode("parts").alias("part", "points"))
    return parts.select(*keys, "part", F.posexplode("points").alias("place", "p")).select(*keys, "part", "place", "p.x", "p.y")


def segments(features: DataFrame, key: str) -> DataFrame:
    """A row for each segment of every part: key, part, i, n (segments of the part), x1, y1, x2, y2; segments without length are left out."""
    pairs = F.transform(F.slice("points", F.lit(1), F.greatest(F.size("points") - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), F.get("points", i + 1).alias("b")))
    moves = F.filter(pairs, lambda s: (s["a"]["x"] != s["b"]["x"]) | (s["a"]["y"] != s["b"]["y"]))
    parts = features.select(key, F.posexplode("parts").alias("part", "points")).select(key, "part", moves.alias("moves"))
    rows = parts.select(key, "part", F.size("moves").alias("n"), F.posexplode("moves").alias("i", "s"))
    return rows.select(key, "part", "i", "n", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def crossed(features: DataFrame, key: str) -> DataFrame:
    """The keys of features whose rings cross or touch themselves, or cross each other.

    Segments are dealt to the cells of a grid over their feature that has about as many cells as the feature has segments: column by column, the rows that
    the segment passes there, so a long segment meets cells along its way only. Segments of a feature that share a cell are compared.
    """
    every = settled(segments(features, key), "segments")
    box = every.groupBy(key).agg(F.count(F.lit(1)).alias("all"), F.min(F.least("x1", "x2")).alias("w"), F.min(F.least("y1", "y2")).alias("s"), F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("side"))
    sized = every.join(box.hint("merge"), key).withColumn("step", F.col("side") / F.ceil(F.sqrt("all")))
    slot = lambda v, low: F.floor((v - F.col(low)) / F.col("step")).cast("int")
    across = sized.withColumn("gx", F.explode(F.sequence(slot(F.least("x1", "x2"), "w"), slot(F.greatest("x1", "x2"), "w"))))
    rise = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    level = lambda x: F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), F.col("y1") + (x - F.col("x1")) * rise))
    left, right = F.col("w") + F.col("gx") * F.col("step"), F.col("w") + (F.col("gx") + 1) * F.col("step")
    steep = F.col("x1") == F.col("x2")
    low = F.when(steep, F.least("y1", "y2")).otherwise(F.least(level(left), level(right))) - F.col("side") * 1e-9
    high = F.when(steep, F.greatest("y1", "y2")).otherwise(F.greatest(level(left), level(right))) + F.col("side") * 1e-9
    cells = across.withColumn("gy", F.explode(F.sequence(slot(low, "s"), slot(high, "s")))).select(key, "part", "i", "n", "x1", "y1", "x2", "y2", "gx", "gy")
    a = settled(cells, "cells")
    b = a.select(*(F.col(c).alias(c if c in (key, "gx", "gy") else f"{c}_") for c in a.columns))
    pairs = a.join(b.hint("merge"), [key, "gx", "gy"]).where("part < part_ OR (part = part_ AND i < i_)")
    turn = lambda px, py, qx, qy, rx, ry: F.signum((F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px)))
    seg, other = ("x1", "y1", "x2", "y2"), ("x1_", "y1_", "x2_", "y2_")
    turns = {"o1": turn(*seg, "x1_", "y1_"), "o2": turn(*seg, "x2_", "y2_"), "o3": turn(*other, "x1", "y1"), "o4": turn(*other, "x2", "y2")}
    within = lambda o, x, y, s: (F.col(o) == 0) & F.col(x).between(F.least(s[0], s[2]), F.greatest(s[0], s[2])) & F.col(y).between(F.least(s[1], s[3]), F.greatest(s[1], s[3]))
    proper = (F.col("o1") * F.col("o2") < 0) & (F.col("o3") * F.col("o4") < 0)
    touches = within("o1", "x1_", "y1_", seg) | within("o2", "x2_", "y2_", seg) | within("o3", "x1", "y1", other) | within("o4", "x2", "y2", other)
    beside = (F.col("i_") == F.col("i") + 1) | ((F.col("i") == 0) & (F.col("i_") == F.col("n") - 1))
    back = (F.col("o1") == 0) & (F.col("o2") == 0) & ((F.col("x2") - F.col("x1")) * (F.col("x2_") - F.col("x1_")) + (F.col("y2") - F.col("y1")) * (F.col("y2_") - F.col("y1_")) < 0)
    same = F.col("part") == F.col("part_")
    return pairs.withColumns(turns).where(proper | (same & ~beside & touches) | (same & beside & back)).select(key).distinct()


def shaped(part: Column, kind: Column) -> Column:
    """Whether a part is fit for its type, but for crossings: finite; a line has two different points; a ring is closed, and has three."""
    finite = F.forall(part, lambda p: (F.abs(p["x"]) < F.lit(float("inf"))) & (F.abs(p["y"]) < F.lit(float("inf"))))  # false for NaN, which is above all
    ring = (F.size(part) >= 4) & (F.get(part, F.lit(0)) == F.get(part, F.size(part) - 1)) & (F.size(F.array_distinct(part)) >= 3)
    return finite & F.when(kind.isin(*LINES), F.size(F.array_distinct(part)) >= 2).when(kind.isin(*AREAS), ring).otherwise(True)


def laddered(features: DataFrame, key: str, supported: tuple[str, ...] = LINES) -> DataFrame:
    """`features` (decoded) with rejection: the first rung that a feature fails, or null.

    The rungs: MISSING_GEOMETRY, UNPARSEABLE_GEOMETRY, EMPTY_GEOMETRY, INVALID_GEOMETRY, UNSUPPORTED_GEOMETRY. Validity: parts as in `shaped`; rings neither cross nor touch
    themselves, and do not cross each other. A type that is not known is unsupported. `key` is unique.
    """
    kind = F.col("geom_type")
    fine = settled(features.withColumn("_shaped", (F.col("geom_state") == "READ") & F.forall("parts", lambda p: shaped(p, kind))), "shaped")
    bad = crossed(fine.where(F.col("_shaped") & kind.isin(*AREAS)), key).withColumn("_crossed", F.lit(True))
    rung = (
        F.when(F.col("geom_state") == "MISSING", "MISSING_GEOMETRY").when(F.col("geom_state") == "UNPARSEABLE", "UNPARSEABLE_GEOMETRY").when(F.col("geom_state") == "EMPTY", "EMPTY_GEOMETRY")
        .when(~F.col("_shaped") | F.col("_crossed"), "INVALID_GEOMETRY").when(~kind.isin(*supported), "UNSUPPORTED_GEOMETRY")
    )
    return fine.join(bad.hint("merge"), key, "left").withColumn("rejection", rung).drop("_shaped", "_crossed")


def mapped(features: DataFrame, rules: DataFrame, dataset: str = "drains", supported: tuple[str, ...] = LINES) -> DataFrame:
    """Every feature with its status: the rung of the ladder that rejects it, a repeated id or geometry, an unknown type, or MAPPED.

    features: ord (unique), source_id, source_type and a decoded geometry; rules: raw_type, feature_type, matched trimmed and lower-cased. Of features that pass the ladder, taken in order, one that
    repeats a kept id or geometry is a duplicate. The id of a kept one comes from its source id, or from its geometry.
    """
    ladder = settled(laddered(features, "ord", supported), "ladder")
    passed = ladder.where("rejection IS NULL").select("ord", "source_id", F.col("geom_key").alias("geometry_key"))
    decided = ladder.join(audit.first_wins(passed).hint("merge"), "ord", "left")
    typed = decided.withColumn("raw_type", F.lower(F.trim(F.coalesce("source_type", F.lit(""))))).join(F.broadcast(rules), "raw_type", "left")
    status = F.when(F.col("rejection").isNotNull(), F.concat(F.lit("REJECTED_"), "rejection")).when(F.col("decision") != "KEPT", F.concat(F.lit("REJECTED_"), "decision")).when(F.col("feature_type").isNull(), "UNRESOLVED_TYPE").otherwise("MAPPED")
    kept = F.col("rejection").isNull() & (F.col("decision") == "KEPT")
    return typed.select("ord", "source_id", "geom_type", status.alias("status"), F.when(kept, F.coalesce("feature_type", F.lit("UNKNOWN"))).alias("feature_type"), F.when(kept, audit.stable_id(dataset, F.col("source_id"), F.col("geom_key"))).alias("feature_id"))


def geometry_audit(features: DataFrame, supported: tuple[str, ...] = LINES) -> DataFrame:
    """One row: records, commonest type (of equals the first by name; NONE without any), missing, unparseable, empty and unsupported ones, repeated ids, bounds and status.

    BLOCKED without records or without a geometry that can be read; AUDIT_PARTIAL with any that cannot; else VALIDATED.
    """
    xs, ys = F.transform(F.flatten("parts"), lambda p: p["x"]), F.transform(F.flatten("parts"), lambda p: p["y"])
    flat = features.select("source_id", "geom_state", "geom_type", F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n"))
    state = lambda s: F.count_if(F.col("geom_state") == s)
    read = F.when(F.col("geom_state") == "READ", F.col("geom_type"))
    # types are few: one row each, then one row in all
    by_type = flat.groupBy(read.alias("kind")).agg(F.count(F.lit(1)).alias("k"), F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"), *(state(x).alias(x.lower()) for x in ("MISSING", "UNPARSEABLE", "EMPTY")))
    found = by_type.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("records"), F.coalesce(F.min(F.when(F.col("kind").isNotNull(), F.struct((-F.col("k")).alias("k"), "kind")))["kind"], F.lit("NONE")).alias("geometry_type"),
        *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("missing", "unparseable", "empty")), F.coalesce(F.sum(F.when(~F.col("kind").isin(*supported), F.col("k"))), F.lit(0)).alias("unsupported"),
        F.min("w").alias("west"), F.min("s").alias("south"), F.max("e").alias("east"), F.max("n").alias("north"),
    )
    ids = features.agg((F.count("source_id") - F.countDistinct("source_id")).alias("duplicate_ids"))
    bad = F.col("missing") + F.col("unparseable") + F.col("empty")
    status = F.when(bad >= F.col("records"), "BLOCKED").when(bad > 0, "AUDIT_PARTIAL").otherwise("VALIDATED")
    return found.crossJoin(F.broadcast(ids)).withColumn("status", status)


def hydraulic(features: DataFrame, rules: tuple[tuple[str, str, float, str], ...], *keys: str) -> DataFrame:
    """A row for each feature and rule (column, target, scale, derivation): value, availability and note.

    Null and what is no number are MISSING; else the value times the scale is DERIVED if the rule names a derivation, and PRESENT if not. Columns are matched in any case; a rule whose column
    is absent gives no rows.
    """
    there = {c.strip().lower(): c for c in features.columns}
    known = [(there[c.lower()], target, scale, how) for c, target, scale, how in rules if c.lower() in there]

    def one(column: str, target: str, scale: float, how: str) -> Column:
        raw = F.col(f"`{column}`")
        number = raw.try_cast("double")
        fine = number.isNotNull() & ~F.isnan(number)
        note = F.when(raw.isNull() | F.isnan(number), "null in source row").when(~fine, "non-numeric source value").otherwise(F.lit(how or None).cast("string"))
        return F.struct(F.lit(target).alias("target"), F.when(fine, number * scale).alias("value"), F.when(~F.coalesce(fine, F.lit(False)), "MISSING").otherwise("DERIVED" if how else "PRESENT").alias("availability"), note.alias("note"))

    kind = "array<struct<target:string,value:double,availability:string,note:string>>"
    each = F.array(*(one(*rule) for rule in known)).cast(kind) if known else F.array().cast(kind)
    return features.select(*keys, F.explode(each).alias("h")).select(*keys, "h.*")
