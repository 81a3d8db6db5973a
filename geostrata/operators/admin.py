"""Administrative areas: tagging points, straddling clusters, names, and splits by area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions.geo import in_multi_polygon
from geostrata.operators.pass2 import Options, Pass2, subcluster
from geostrata.runtime import checkpoint

#: Most tiles along one side of the areas' extent.
TILES = 64


def locate(points: DataFrame, units: DataFrame, tiles: int = TILES) -> DataFrame:
    """``points`` with ``unit_idx``: the first area that contains each, -1 for none.

    Areas are dealt to the tiles that their boxes touch, so a point meets the areas of its own tile
    by an equi-join; the box and then the polygons are tested on those alone.
    """
    extent = checkpoint(units.agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), F.greatest(F.max("maxx") - F.min("minx"), F.lit(1e-9)).alias("w"), F.greatest(F.max("maxy") - F.min("miny"), F.lit(1e-9)).alias("h")))  # one row
    tile = lambda v, low, size: F.floor((v - F.col(low)) / F.col(size) * tiles)
    u = units.crossJoin(F.broadcast(extent)).select("unit_idx", "polygons", "minx", "miny", "maxx", "maxy", F.explode(F.sequence(tile(F.col("minx"), "x0", "w"), tile(F.col("maxx"), "x0", "w"))).alias("tx"), tile(F.col("miny"), "y0", "h").alias("_lo"), tile(F.col("maxy"), "y0", "h").alias("_hi"))
    u = u.withColumn("ty", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    p = points.select("idx", "lon", "lat").crossJoin(F.broadcast(extent)).withColumn("tx", tile(F.col("lon"), "x0", "w")).withColumn("ty", tile(F.col("lat"), "y0", "h")).drop("x0", "y0", "w", "h")
    x, y = F.col("lon"), F.col("lat")
    boxed = p.join(u, ["tx", "ty"]).where((x >= F.col("minx")) & (x <= F.col("maxx")) & (y >= F.col("miny")) & (y <= F.col("maxy")))
    hit = boxed.where(in_multi_polygon(x, y, F.col("polygons"))).groupBy("idx").agg(F.min("unit_idx").alias("unit_idx"))
    return points.join(hit, "idx", "left").withColumn("unit_idx", F.coalesce("unit_idx", F.lit(-1)))


def units_of(members: DataFrame, located: DataFrame, units: DataFrame, group: list[str]) -> DataFrame:
    """(group, admin_units, straddle): ids of the areas that a group's members lie in, by unit_idx; more than one straddles."""
    tagged = members.join(located.select("idx", "unit_idx"), "idx")
    ids = tagged.where("unit_idx >= 0").join(units.select("unit_idx", F.col("id").cast("string").alias("_id")), "unit_idx").groupBy(*group).agg(F.transform(F.sort_array(F.collect_set(F.struct("unit_idx", "_id"))), lambda s: s["_id"]).alias("admin_units"))
    every = members.select(*group).distinct()
    same = [every[c].eqNullSafe(ids[c]) for c in group]
    joined = every.join(ids, same, "left").select(*(every[c] for c in group), F.coalesce("admin_units", F.array().cast("array<string>")).alias("admin_units"))
    return joined.withColumn("straddle", F.size("admin_units") > 1)


def cluster_members(pass2: Pass2) -> DataFrame:
    """(parent, idx): all members of each cluster, with and without values."""
    return pass2.members.where("parent is not null").select("parent", "idx")


def cluster_names(labels: DataFrame, clusters: DataFrame, located: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """(id, name): each cluster by the area that most of its points lie in.

    Where more points lie outside all areas, or without areas, it is "Cluster <id>". A cluster with
    less than half of its points in that area names how many more it touches. A name's second
    holder, in list order, gets " 2", and so on. Ties go to the area with the lower unit_idx.
    """
    base = clusters.select("id", "list_ord", F.concat(F.lit("Cluster "), F.col("id").cast("string")).alias("base"))
    if located is not None and units is not None:
        n = labels.where("label >= 1").join(located.select("idx", "unit_idx"), "idx").groupBy(F.col("label").alias("id"), "unit_idx").agg(F.count(F.lit(1)).alias("n"))
        inside = F.col("unit_idx") >= 0
        g = n.groupBy("id").agg(F.sum("n").alias("total"), F.sum(F.when(~inside, F.col("n"))).alias("out"), F.count_if(inside).alias("areas"), F.max(F.when(inside, F.struct("n", (-F.col("unit_idx")).alias("m")))).alias("best"))
        g = g.where(F.col("best").isNotNull() & (F.col("best.n") >= F.coalesce("out", F.lit(0)))).withColumn("unit_idx", (-F.col("best.m")).cast("int"))
        g = g.join(units.select("unit_idx", F.col("name").alias("area")), "unit_idx")
        others = F.col("areas") - 1
        more = F.when(others == 1, "1 more area").otherwise(F.concat(others.cast("string"), F.lit(" more areas")))
        text = F.when((2 * F.col("best.n") < F.col("total")) & (others > 0), F.concat("area", F.lit(" and "), more)).otherwise(F.col("area"))
        base = base.join(g.select("id", text.alias("area_name")), "id", "left").withColumn("base", F.coalesce("area_name", "base")).drop("area_name")
    w = Window.partitionBy("base").orderBy("list_ord")
    return base.withColumn("_n", F.row_number().over(w)).select("id", F.when(F.col("_n") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" "), F.col("_n").cast("string"))).alias("name"))


def display_names(ids: DataFrame, names: DataFrame, units: DataFrame | None = None, column: str = "parent_cluster_id") -> DataFrame:
    """``ids`` with ``cluster_name`` for ids like 3, 3@area and 3@outside; null for null."""
    text = F.col(column).cast("string")
    parts = F.split(text, "@")
    own = ids.withColumn("_id", F.expr(f"try_cast(split(cast({column} as string), '@')[0] as int)")).withColumn("_area", F.try_element_at(parts, F.lit(2))).withColumn("_first", F.element_at(parts, 1))
    own = own.join(names.select(F.col("id").alias("_id"), F.col("name").alias("_name")), "_id", "left")
    if units is not None:
        u = units.groupBy(F.col("id").cast("string").alias("_area")).agg(F.min_by("name", "unit_idx").alias("_unit"))
        own = own.join(u, "_area", "left")
    else:
        own = own.withColumn("_unit", F.lit(None).cast("string"))
    cluster = F.coalesce("_name", F.concat(F.lit("Cluster "), F.col("_first")))
    area = F.when(F.col("_area") == "outside", "outside the areas").otherwise(F.coalesce("_unit", "_area"))
    return own.withColumn("cluster_name", F.when(text.isNull(), None).when(F.col("_area").isNull(), cluster).otherwise(F.concat(cluster, F.lit(" · "), area))).drop("_id", "_area", "_first", "_name", "_unit")


def split_cluster(pass2: Pass2, parent: int, points: DataFrame, located: DataFrame, units: DataFrame, options: Options = Options()) -> tuple[DataFrame, Pass2]:
    """A cluster's pieces by area, and pass 2 of each.

    Pieces: (piece_key, unit_id, name, n); ``piece_key`` is "<parent>@<area id>" or
    "<parent>@outside", and stands as a key in the result, so sub-areas of pieces stay apart.
    """
    own = cluster_members(pass2).where(F.col("parent") == parent)
    if own.limit(1).count() == 0:
        raise ValueError(f"no cluster {parent}")
    tagged = own.select("idx").join(located.select("idx", "unit_idx"), "idx").join(units.select("unit_idx", F.col("id").cast("string").alias("unit_id"), "name"), "unit_idx", "left")
    tagged = tagged.withColumn("piece_key", F.concat(F.lit(f"{parent}@"), F.coalesce("unit_id", F.lit("outside"))))
    pieces = tagged.groupBy("piece_key", "unit_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("unit_idx").alias("_u")).withColumn("ord", F.when(F.col("_u") < 0, F.lit(2**31 - 1)).otherwise(F.col("_u"))).drop("_u")
    rows = points.join(tagged.select("idx", "piece_key"), "idx").withColumn("label", F.lit(1))
    return pieces, subcluster(rows, options, ["piece_key"])
