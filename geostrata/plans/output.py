"""Outputs of a run as tables: features, outlines, classes, composition, configuration, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.geo import frame_of
from geostrata.operators.admin import display_names, units_of
from geostrata.operators.dbscan import NOISE
from geostrata.operators.hull import SEGMENTS, outlines
from geostrata.operators.pass2 import Pass2, weighted_stats
from geostrata.operators.spatial import nearest

# The frame of coordinates and the method of distances that outputs name.
CRS, DISTANCE_METHOD = "EPSG:4326", "projected-equirectangular"
FIFTHS = ["lowest", "second", "middle", "fourth", "highest"]


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves upwards."""
    return F.floor(x + 0.5).cast("long")


def subarea_properties(pass2: Pass2) -> DataFrame:
    """A row for each sub-area with the properties that outputs carry."""
    return pass2.subareas.select(F.col("group_id").alias("subarea_id"), F.lit("subarea").alias("kind"), F.col("parent").alias("parent_cluster_id"), "band", F.array("range_min", "range_max").alias("band_value_range"), half_up(F.col("population")).alias("population"), F.col("mean_ability").alias("mean_ability_to_pay"), "has_unknown", "scattered", F.col("missing_pop").alias("missing_population_count"), "seq")


def features(pass2: Pass2, points: DataFrame, located: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """Features of sub-areas, unknown groups and the last-mile group, with geometry and ``ord``, their place in the collection."""
    none = lambda kind: F.lit(None).cast(kind)
    sub = subarea_properties(pass2)
    rest = pass2.groups.select(F.col("group_id").alias("subarea_id"), "kind", F.col("parent").alias("parent_cluster_id"), none("int").alias("band"), none("array<double>").alias("band_value_range"), half_up(F.col("population")).alias("population"), F.col("mean_ability").alias("mean_ability_to_pay"), (F.col("kind") == "unknown").alias("has_unknown"), F.lit(False).alias("scattered"), F.col("missing_pop").alias("missing_population_count"), none("int").alias("seq"))
    rows = sub.unionByName(rest)
    shape = pass2.members.select("group_id", "idx").join(points.select("idx", "lon", "lat"), "idx").groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat"))), lambda s: F.array(s["lon"], s["lat"])).alias("coordinates"),
        F.array(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).alias("bbox"), F.array(F.avg("lon"), F.avg("lat")).alias("centroid"), F.count(F.lit(1)).alias("point_count"),
    )
    out = rows.join(shape.withColumnRenamed("group_id", "subarea_id"), "subarea_id")
    if located is not None and units is not None:
        tags = units_of(pass2.members.select("group_id", "idx"), located, units, ["group_id"]).withColumnRenamed("group_id", "subarea_id")
        out = out.join(tags, "subarea_id", "left")
    else:
        out = out.withColumn("admin_units", none("array<string>")).withColumn("straddle", F.lit(False))
    last = F.col("kind") == "last_mile"
    w = F.struct(last.cast("int").alias("a"), F.coalesce("parent_cluster_id", F.lit(0)).alias("b"), (F.col("kind") == "unknown").cast("int").alias("c"), F.coalesce("band", F.lit(-1)).alias("d"), F.col("scattered").cast("int").alias("e"), F.coalesce("seq", F.lit(0)).alias("f"))
    return out.withColumn("ord", w).drop("seq")


def boundaries(labels: DataFrame, clusters: DataFrame, points: DataFrame, cluster_tightness_km: float, pass2: Pass2 | None = None, buffer_m: float = 0) -> DataFrame:
    """(id, kind, parent_cluster_id, point_count, tightness_km, ring): outlines of clusters, then of sub-areas that aren't scattered.

    A group without a polygon keeps its row with a null ring; ``without_polygon`` counts those.
    """
    frame = frame_of(points)
    own = labels.where("label >= 1").join(points.select("idx", "lon", "lat"), "idx").select(F.concat(F.lit("cluster-"), F.col("label").cast("string")).alias("gid"), "idx", "lon", "lat", F.lit(float(cluster_tightness_km)).alias("tightness_km"))
    info = clusters.select(F.concat(F.lit("cluster-"), F.col("id").cast("string")).alias("gid"), F.lit("cluster_boundary").alias("kind"), F.col("id").cast("int").alias("parent_cluster_id"), F.col("size").cast("long").alias("point_count"))
    if pass2 is not None:
        good = pass2.subareas.where("not scattered").join(pass2.clusters.select("parent", "eps2_km"), "parent").select("group_id", "parent", "point_count", F.coalesce("eps2_km", F.lit(float(cluster_tightness_km))).alias("tightness_km"))
        sub = pass2.members.join(good.select("group_id", "tightness_km"), "group_id").join(points.select("idx", "lon", "lat"), "idx")
        own = own.unionByName(sub.select(F.col("group_id").alias("gid"), "idx", "lon", "lat", "tightness_km"))
        info = info.unionByName(good.select(F.col("group_id").alias("gid"), F.lit("subarea_boundary").alias("kind"), F.col("parent").alias("parent_cluster_id"), F.col("point_count").cast("long").alias("point_count")))
    rings = outlines(own, "gid", frame, buffer_m=buffer_m)
    return info.join(rings, "gid").withColumnRenamed("gid", "id")


def boundary_meta(found: DataFrame, buffer_m: float) -> DataFrame:
    """One row: method, buffer and the number of groups without a polygon."""
    return found.agg(F.lit("chi-shape concave hull on a Delaunay triangulation").alias("method"), F.lit(float(buffer_m)).alias("buffer_m"), F.lit(SEGMENTS).alias("ring_segments"), F.count_if(F.col("ring").isNull()).alias("without_polygon"))


def quintile_cuts(subareas: DataFrame) -> DataFrame:
    """One row (cuts, count): nearest-rank fifths of the sub-areas' means."""
    return subareas.where("mean_ability is not null").agg(F.array(*(F.expr(f"percentile_disc({q}) within group (order by mean_ability)") for q in (0.2, 0.4, 0.6, 0.8))).alias("cuts"), F.count(F.lit(1)).alias("count"))


def select_class(pass2: Pass2, kind: str, fifth: int | None = None, lo: float | None = None, hi: float | None = None, which: str | None = None) -> DataFrame:
    """(subarea_id, export_class, export_comparable_across_map) of sub-areas in a class.

    ``fifth``: above the lower cut up to the upper one, over all means. ``range``: from lo to hi.
    ``band``: the lowest or highest band of each cluster that has several; not comparable.
    """
    sub = pass2.subareas
    v = F.col("mean_ability")
    if kind == "band":
        if which not in ("lowest", "highest"):
            raise ValueError("which must be 'lowest' or 'highest'")
        many = pass2.clusters.where("k > 1").select("parent", F.lit(0).alias("band") if which == "lowest" else (F.col("k") - 1).alias("band"))
        rows, label, comparable = sub.join(many, ["parent", "band"], "left_semi"), f"{which} band within its own cluster", False
    elif kind == "range":
        if lo is None or hi is None or not lo <= hi or max(abs(lo), abs(hi)) == float("inf"):
            raise ValueError("the value range needs two numbers, the first not above the second")
        rows, label, comparable = sub.where((v >= lo) & (v <= hi)), f"value {lo:g} to {hi:g}", True
    elif kind == "fifth":
        if fifth not in range(1, 6):
            raise ValueError("fifth must be from 1 to 5")
        cut = sub.crossJoin(F.broadcast(quintile_cuts(sub)))
        above = v > F.get("cuts", F.lit(fifth - 2)) if fifth > 1 else F.lit(True)
        up_to = v <= F.get("cuts", F.lit(fifth - 1)) if fifth < 5 else F.lit(True)
        rows, label, comparable = cut.where(v.isNotNull() & above & up_to), f"{FIFTHS[fifth - 1]} fifth across the map", True
    else:
        raise ValueError("kind must be 'band', 'range' or 'fifth'")
    return rows.select(F.col("group_id").alias("subarea_id"), F.lit(label).alias("export_class"), F.lit(comparable).alias("export_comparable_across_map"))


def filter_by_class(table: DataFrame, picked: DataFrame) -> DataFrame:
    """Sub-area rows (features or outlines) in a class, with its two columns."""
    key = "subarea_id" if "subarea_id" in table.columns else "id"
    return table.where(F.col("kind").isin("subarea", "subarea_boundary")).join(picked.withColumnRenamed("subarea_id", key), key)


def count_column(layer: str) -> str:
    """A layer's column name: n_ and its lower-case letters and digits, other runs as one underscore."""
    import re

    return "n_" + re.sub("[^a-z0-9]+", "_", layer.lower())


def composition(members: DataFrame, points: DataFrame, layers: list[str], group: list[str]) -> DataFrame:
    """(group, n_<layer> ...): members of each layer, zeros included. Of layers with one column name the last one counts."""
    named = {count_column(x): x for x in layers}
    own = members.join(points.select("idx", "source"), "idx")
    return own.groupBy(*group).agg(*(F.count_if(F.col("source") == x).alias(n) for n, x in named.items()))


def composition_text(members: DataFrame, points: DataFrame, group: list[str]) -> DataFrame:
    """(group, composition): "layer n" by falling count, then name, comma-joined."""
    n = members.join(points.select("idx", "source"), "idx").groupBy(*group, "source").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "source")))
    return n.groupBy(*group).agg(F.array_join(F.transform(parts, lambda s: F.concat(s["source"], F.lit(" "), (-s["m"]).cast("string"))), ", ").alias("composition"))


def run_config(params: dict, sources: dict, timestamp: str, version: str) -> dict:
    """The cfg_ columns that every feature of a run carries."""
    flat = params["algorithm"] == "dbscan"
    key = "eps_km" if flat else "max_link_km"
    return {"cfg_algorithm": params["algorithm"], "cfg_distance_km": params[key], "cfg_distance_source": sources.get(key), "cfg_min_points": params["min_pts"] if flat else params["min_cluster_size"], "cfg_min_samples": None if flat else params["min_samples"], "cfg_weighting": "population" if params.get("cluster_weight") else "none", "cfg_run_time": timestamp, "cfg_tool_version": version}


def with_config(table: DataFrame, names: DataFrame, config: dict, params: dict, pass2: Pass2 | None = None, units: DataFrame | None = None) -> DataFrame:
    """``table`` with cluster_name, the run's columns and, on sub-areas, those of their cluster."""
    out = display_names(table, names, units)
    for k, v in config.items():
        out = out.withColumn(k, F.lit(v))
    if pass2 is None:
        return out
    bands = params["pass2_method"] == "bands"
    own = pass2.clusters.select(F.col("parent").alias("parent_cluster_id"), F.col("k").alias("_k"), F.col("method").alias("_m"), F.col("eps2_km").alias("_e"))
    out = out.join(own, "parent_cluster_id", "left")
    sub = F.col("kind").isin("subarea", "subarea_boundary") & F.col("_k").isNotNull()
    return out.select(*(c for c in out.columns if c not in ("_k", "_m", "_e")), F.when(sub, params["pass2_method"]).alias("cfg_subarea_method"), F.when(sub, F.lit(params["pass2_bands"] if bands else None)).alias("cfg_bands_max"), F.when(sub, F.col("_k")).alias("cfg_band_count"), F.when(sub, F.col("_m")).alias("cfg_banding_method"), F.when(sub, F.lit(params["pass2_min2"] if bands else None)).alias("cfg_min2"), F.when(sub, F.col("_e")).alias("cfg_eps2_km"))


def last_mile_facts(points: DataFrame, labels: DataFrame, grouping_km: float) -> DataFrame:
    """One row on places in no cluster: n, share, median_km and p90_km to the nearest clustered place (nearest rank), near_miss_share within twice the distance, and people."""
    own = points.join(labels, "idx")
    out, inside = own.where(F.col("label") == NOISE), own.where("label >= 1")
    d = nearest(out, inside).where("other >= 0").withColumn("km", F.sqrt("d2") / 1000)
    by_rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by km)")
    far = d.agg(by_rank(0.5).alias("median_km"), by_rank(0.9).alias("p90_km"), F.avg((F.col("km") <= 2 * grouping_km).cast("double")).alias("near_miss_share"))
    n = own.agg(F.count_if(F.col("label") == NOISE).alias("n"), F.coalesce(F.avg((F.col("label") == NOISE).cast("double")), F.lit(0.0)).alias("share"))
    stats = lambda t, p: t.agg(*(c.alias(f"{p}_{x}") for c, x in zip(weighted_stats(), ("population", "mean_ability", "missing_pop"), strict=True)))
    joined = n.crossJoin(F.broadcast(far))  # single rows
    return joined.crossJoin(F.broadcast(stats(out, "last_mile"))).crossJoin(F.broadcast(stats(inside, "clustered")))


def last_mile_layers(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n) of places in no cluster."""
    return points.join(labels.where(F.col("label") == NOISE), "idx").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def run_summary(labels: DataFrame, clusters: DataFrame, pass2: Pass2 | None = None) -> DataFrame:
    """(ord, label, value): headline counts of a run."""
    a = labels.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("label") == NOISE).alias("noise"), F.count_if(F.col("label") == -2).alias("filtered")).crossJoin(F.broadcast(clusters.agg(F.count(F.lit(1)).alias("clusters"))))
    pairs = [("points", "points"), ("clusters", "clusters"), ("last-mile (unclustered) points", "noise"), ("filtered points", "filtered")]
    if pass2 is not None:
        a = a.crossJoin(F.broadcast(pass2.subareas.agg(F.count_if(~F.col("scattered")).alias("sub"), F.count_if("scattered").alias("scat")))).crossJoin(F.broadcast(pass2.groups.agg(F.coalesce(F.sum(F.when(F.col("kind") == "unknown", F.col("point_count"))), F.lit(0)).alias("unk"))))
        pairs += [("sub-areas", "sub"), ("scattered groups", "scat"), ("unknown-value points", "unk")]
    return a.select(F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(x).alias("label"), F.col(c).cast("long").alias("value")) for i, (x, c) in enumerate(pairs)))).alias("r")).select("r.*")


def provenance(pass2: Pass2, pass1: dict, layers: dict, timestamp: str, version: str, point_count: int, resolution_km: float | None = None, sources: dict | None = None, extra: dict | None = None) -> DataFrame:
    """One row ``meta``: the run's provenance as JSON; this engine's own settings stand under ``engine``."""
    o = pass2.options
    note = f"Sub-areas resolve no contrast finer than a cell of the input layer (~{'unknown' if resolution_km is None else f'{resolution_km:.2f} km'})."
    lit = lambda d: F.parse_json(F.lit(__import__("json").dumps(d)))
    each = pass2.clusters.agg(F.array_sort(F.collect_list(F.struct("parent", "k", "method", "flag"))).alias("c"))
    banding = F.transform("c", lambda s: F.struct(s["parent"].alias("parentClusterId"), s["k"].alias("bandCount"), s["method"].alias("method"), s["flag"].alias("flag")))
    meta = F.struct(
        F.struct(F.lit(version).alias("version"), F.lit(timestamp).alias("generatedAt")).alias("tool"), F.lit(point_count).alias("pointCount"), F.lit(CRS).alias("crs"), F.lit(DISTANCE_METHOD).alias("clusteringDistanceMethod"),
        F.struct(F.lit(resolution_km).cast("double").alias("resolutionCeilingKm"), F.lit(note).alias("note")).alias("caveats"), lit({k: layers.get(k) for k in ("abilityToPay", "population", "admin")}).alias("layers"),
        F.struct(lit(pass1).alias("pass1"), F.struct(F.lit(o.min2).alias("min2"), F.lit(o.eps2_rule()).alias("eps2Rule"), F.lit(o.eps2_override_km).cast("double").alias("eps2OverrideKm"), F.lit(o.mode).alias("bandMode"), F.lit(float(o.banding.size_threshold)).alias("sizeThreshold")).alias("pass2"), lit(sources or {}).alias("sources")).alias("params"),
        F.struct(banding.alias("perCluster")).alias("banding"), lit({"respatialise": o.respatialise, "eps2Percentile": o.eps2_percentile, "modalityGuard": o.modality_guard, "regionCount": o.region_count} | (extra or {})).alias("engine"),
    )
    return each.select(F.to_json(meta, {"ignoreNullFields": "false"}).alias("meta"))
