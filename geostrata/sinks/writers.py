"""Sinks: GeoJSON collections and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_json(properties: list[str], geometry: Column, bbox: Column | None = None, ident: str = "subarea_id") -> Column:
    """A GeoJSON feature as text; nulls are written."""
    parts = [F.lit("Feature").alias("type"), F.col(ident).alias("id")]
    if bbox is not None:
        parts.append(bbox.alias("bbox"))
    parts += [geometry.alias("geometry"), F.struct(*(F.col(c) for c in properties)).alias("properties")]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def multipoint_features(table: DataFrame) -> DataFrame:
    """(ord, feature) of the table ``features``."""
    skip = {"coordinates", "bbox", "ord"}
    props = [c for c in table.columns if c not in skip]
    return table.select("ord", feature_json(props, F.struct(F.lit("MultiPoint").alias("type"), F.col("coordinates")), F.col("bbox")).alias("feature"))


def polygon_features(table: DataFrame) -> DataFrame:
    """(ord, feature) of outlines that have a ring."""
    props = [c for c in table.columns if c != "ring"]
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates"))
    return table.where("ring is not null").select(F.struct((F.col("kind") != "cluster_boundary").alias("sub"), "parent_cluster_id", "id").alias("ord"), feature_json(props, geometry, None, "id").alias("feature"))


def collection(rows: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row ``geojson``: the collection of (ord, feature) rows in order, with ``meta`` if given.

    A GeoJSON collection is one document; use ``write_lines`` for results that don't fit in one.
    """
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "feature"))), lambda s: s["feature"]), ",").alias("body"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), "body", F.lit("]"))
    if meta is None:
        return body.select(F.concat(text, F.lit("}")).alias("geojson"))
    return body.crossJoin(F.broadcast(meta.select("meta"))).select(F.concat(text, F.lit(',"meta":'), "meta", F.lit("}")).alias("geojson"))


def write_geojson(rows: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """The collection as one text file in the folder ``path``."""
    collection(rows, meta).coalesce(1).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One feature per line, in order, from all executors."""
    rows.sort("ord").select("feature").write.mode("overwrite").text(path)


def csv_field(value: Column) -> Column:
    """RFC 4180: quoted where it holds a comma, a quote or a line break; quotes doubled; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_text(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row ``csv``: header and rows with CRLF after each."""
    shown = [c for c in df.columns if c not in (order or [])]
    line = F.concat_ws(",", *(csv_field(F.col(c)) for c in shown))
    key = F.struct(*(F.col(c) for c in order)) if order else F.struct(line)
    lines = df.select(key.alias("k"), line.alias("l")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "l"))), lambda s: s["l"]).alias("ls"))
    head = F.lit(",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ',"\r\n') else c for c in shown))
    return lines.select(F.concat(F.array_join(F.concat(F.array(head), "ls"), "\r\n"), F.lit("\r\n")).alias("csv"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files by Spark's writer, quotes doubled, CRLF, header in each."""
    df.select(*(F.col(c).cast("string") for c in df.columns)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', lineSep="\r\n", emptyValue="", nullValue="")
