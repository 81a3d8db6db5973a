"""Point and polygon sources: GeoJSON files of points and of administrative areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.functions.geo import RINGS
from geostrata.operators.ranking import numbered

# Property names that hold an area's name, in order of preference.
NAME_FIELDS = ["name", "NAME", "Name", "shapeName", "ADM3_EN", "ADM2_EN", "ADM1_EN", "ADM3", "ADM2", "ADM1", "NAME_3", "NAME_2", "NAME_1"]


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(position, feature): the features of a GeoJSON collection, each as VARIANT, in their order.

    A file without features, or with null for them, gives none.
    """
    whole = spark.read.text(path, wholetext=True)
    doc = whole.select(F.parse_json("value").alias("doc"))
    each = F.from_json(F.to_json(F.variant_get("doc", "$.features", "variant")), "array<string>")
    return doc.select(F.posexplode(each).alias("position", "raw")).select("position", F.when(F.col("raw").isNotNull(), F.parse_json("raw")).alias("feature"))


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("feature", path, kind)


def _json(path: str) -> Column:
    return F.to_json(F.try_variant_get("feature", path, "variant"))


def _plain(path: str) -> Column:
    """A scalar as text, without quotes; null for a missing or null one."""
    return F.try_variant_get("feature", path, "string")


def parse_points(features: DataFrame, dataset: str, dataset_ord: int = 0) -> DataFrame:
    """(dataset_ord, source, position, vertex, lon, lat, orig_id): Point and MultiPoint vertices; other geometries are skipped."""
    kind = _get("$.geometry.type", "string")
    one = F.from_json(_json("$.geometry.coordinates"), "array<double>")
    many = F.from_json(_json("$.geometry.coordinates"), "array<array<double>>")
    places = F.when(kind == "Point", F.array(one)).when(kind == "MultiPoint", many)
    rows = features.where("feature is not null").select("position", F.coalesce(_plain("$.id"), _plain("$.properties.id")).alias("orig_id"), F.posexplode(places).alias("vertex", "c"))
    return rows.select(F.lit(dataset_ord).alias("dataset_ord"), F.lit(dataset).alias("source"), "position", "vertex", F.get("c", F.lit(0)).alias("lon"), F.get("c", F.lit(1)).alias("lat"), "orig_id")


def merge_points(datasets: list[DataFrame]) -> DataFrame:
    """``points`` (idx, id, lon, lat, source, orig_id) from tables of ``parse_points``; idx from 0, ids count from 0 in each dataset."""
    rows = datasets[0]
    for d in datasets[1:]:
        rows = rows.unionByName(d)
    order = ["dataset_ord", "position", "vertex"]
    n = numbered(rows, order, "idx").withColumn("idx", F.col("idx") - 1)
    first = n.groupBy("dataset_ord").agg(F.min("idx").alias("_first"))  # a row per dataset
    n = n.join(F.broadcast(first), "dataset_ord")
    return n.select(F.col("idx").cast("long").alias("idx"), F.concat_ws(":", "source", (F.col("idx") - F.col("_first")).cast("string")).alias("id"), "lon", "lat", "source", "orig_id")


def read_points(spark: SparkSession, datasets: dict[str, str]) -> DataFrame:
    """``points`` of several files; keys are dataset names."""
    return merge_points([parse_points(read_features(spark, path), name, i) for i, (name, path) in enumerate(datasets.items())])


def name_fields(features: DataFrame) -> DataFrame:
    """(field, first): property names that hold text that isn't blank in at least half of the features."""
    total = features.select(F.count(F.lit(1)).alias("total"))  # one row
    raw = features.where("feature is not null").select("position", F.expr("posexplode(map_entries(from_json(to_json(try_variant_get(feature, '$.properties', 'variant')), 'map<string,variant>')))").alias("at", "e"))
    text = raw.select("position", "at", F.col("e.key").alias("field"), ((F.schema_of_variant("e.value") == "STRING") & (F.trim(F.expr("try_variant_get(e.value, '$', 'string')")) != "")).alias("is_text"))
    fields = text.groupBy("field").agg(F.count_if("is_text").alias("n"), F.min(F.struct("position", "at")).alias("first"))
    return fields.crossJoin(F.broadcast(total)).where((F.col("n") > 0) & (F.col("n") >= F.col("total") / 2)).select("field", "first")


def detect_name_field(features: DataFrame) -> str | None:
    """The preferred name field, else the first candidate, else None. Candidates are property names, so they are few."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, NAME_FIELDS)), F.col("field")), F.lit(0))
    row = name_fields(features).orderBy(F.when(rank > 0, rank).otherwise(len(NAME_FIELDS) + 1), "first").select("field").first()
    return row[0] if row else None


def parse_admin_units(features: DataFrame, name_field: str | None = None) -> DataFrame:
    """(unit_idx, id, name, polygons, minx, miny, maxx, maxy): Polygon and MultiPolygon features; the box is that of outer rings.

    The id is the feature's, else its property id, else name, else its position. The name is the
    property ``name_field`` if it isn't blank, else the id.
    """
    kind = _get("$.geometry.type", "string")
    raw = _json("$.geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(raw, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(raw, "array<array<array<array<double>>>>"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    shaped = F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point))).cast(RINGS)
    props = F.from_json(_json("$.properties"), "map<string,string>")
    ident = F.coalesce(_plain("$.id"), _plain("$.properties.id"), _plain("$.properties.name"), F.col("position").cast("string"))
    named = F.try_element_at(props, F.lit(name_field)) if name_field else F.lit(None).cast("string")
    name = F.when(F.trim(named) != "", named).otherwise(ident)
    rows = features.where("feature is not null").select("position", ident.alias("id"), name.alias("name"), shaped.alias("polygons")).where("polygons is not null")
    outer = F.flatten(F.transform("polygons", lambda rings: F.get(rings, F.lit(0))))
    x, y = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    n = numbered(rows, ["position"], "rn")
    return n.select((F.col("rn") - 1).cast("int").alias("unit_idx"), "id", "name", "polygons", F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy"))
