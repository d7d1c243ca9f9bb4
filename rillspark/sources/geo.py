"""Geo-Parquet: tables with a geometry column in WKB, named by the file's metadata or by custom."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession

from rillspark.operators.geometry import decoded

# Names that a geometry column has where the metadata does not say.
CANDIDATES = ("geometry", "geom", "wkb_geometry")


@dataclasses.dataclass(frozen=True)
class GeometryColumn:
    """The geometry column of a table (None if it has none), its reference system as text, and what is worth a note."""

    name: str | None
    crs: str | None
    notes: tuple[str, ...]


def _geo_metadata(spark: SparkSession, file: str) -> str | None:
    """The entry `geo` of a Parquet file's footer, through Spark's own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()


def geometry_column(spark: SparkSession, path: str) -> GeometryColumn:
    """The primary column of the metadata; else the first of CANDIDATES that the table has. One footer is read (an empty table has none)."""
    rows = spark.read.parquet(path)
    first = rows.select("_metadata.file_path").first()
    text, notes, found, crs = (_geo_metadata(spark, first[0]) if first else None), [], None, None
    if text is None:
        notes.append("no geo metadata: the reference system cannot be verified")
    else:
        try:
            about = json.loads(text)
            found = about.get("primary_column")
            crs = about.get("columns", {}).get(found, {}).get("crs")
            crs = crs if crs is None or isinstance(crs, str) else json.dumps(crs, sort_keys=True)
        except (ValueError, AttributeError):
            notes.append("geo metadata cannot be parsed")
    if found is not None and found not in rows.columns:
        notes.append(f"the metadata names a column {found} that is not there")
        found = None
    if found is None:
        found = next((c for c in CANDIDATES if c in rows.columns), None)
        if found:
            notes.append(f"column {found} is taken for the geometry")
    return GeometryColumn(found, crs, tuple(notes))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A table with its geometry decoded (geom_type, geom_state, parts, geom_key); ValueError without a geometry column."""
    column = geometry_column(spark, path)
    if column.name is None:
        raise ValueError(f"no geometry column in {path}")
    return decoded(spark.read.parquet(path), column.name)
