"""Registered queries of the clustering engine and their SQL.

The tables hold no geometry; points, areas and a raster are derived from them by arithmetic that
both engines do alike. Coordinates are km multiples of 0.05 held as metres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions.geo import project
from geostrata.functions.render import absolute_fill, absolute_legend, band_fill, band_label, band_legend, subarea_label
from geostrata.operators import admin, breaks, pass1, pass2, spatial, suggest
from geostrata.operators.dbscan import core_points, dbscan, neighbour_sums
from geostrata.operators.hdbscan import hdbscan, reachability_edges
from geostrata.plans import output
from geostrata.plans import params as params_of
from geostrata.sources.raster import Filter, Raster, allocate, apply_filters, outside_counts
from geostrata.streaming.session_log import as_log, counts

EPS, MIN_PTS = 2000.0, 4

_BASE_SQL = """
  SELECT c_custkey AS idx, 'customer:' || c_custkey AS id, c_nationkey AS nk, c_mktsegment AS source,
    CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS population,
    CASE WHEN c_custkey % 17 <> 0 THEN CAST((c_custkey * 37 + c_nationkey * 101) % 1000 AS DOUBLE) / 1000 + CAST(c_custkey % 3 AS DOUBLE) END AS ability,
    (c_custkey * 7919) % 1009 AS u, (c_custkey * 104729) % 997 AS v, (c_custkey * 31) % 10 = 0 AS far
  FROM customer"""
# 4 decimals of a degree at most, so that both engines hold the same coordinates
POINTS_SQL = f"""
  SELECT idx, id, nk, source, population, ability, CAST(xu AS DOUBLE) * 50 AS x_m, CAST(yu AS DOUBLE) * 50 AS y_m,
    30 + CAST(xu AS DOUBLE) / 2000 AS lon, CAST(yu AS DOUBLE) / 2000 AS lat
  FROM (SELECT *,
    CASE WHEN far THEN (u * 12000) // 1009 ELSE (nk % 5) * 2000 + (u % 101) + (v % 101) END AS xu,
    CASE WHEN far THEN (v * 12000) // 997 ELSE (nk // 5) * 2000 + (u % 97) + (v % 89) END AS yu
    FROM ({_BASE_SQL}))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with idx, id, source, population, ability, x_m, y_m, lon, lat."""
    sql = POINTS_SQL.replace("//", "div").replace("FROM customer", "FROM {customer}")
    return spark.sql(sql, customer=table(spark, sf_dir, "customer"))


def raster(spark: SparkSession, sf_dir: str) -> Raster:
    """Prices of parts laid out in 40 columns over the points' extent; every 37th has no data."""
    cells = table(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("row"), (F.col("p_partkey") % 40).alias("col"), F.when(F.col("p_partkey") % 37 == 0, -9999.0).otherwise(F.floor("p_retailprice").cast("double")).alias("value"))
    return Raster("price", cells, 40, 500, 30.6, 6.0, 0.15, -0.15, nodata=-9999.0)


RASTER_SQL = "SELECT p_partkey // 40 AS r, p_partkey % 40 AS c, floor(p_retailprice) AS value FROM part WHERE p_partkey % 37 <> 0"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An area of four corners for each nation's square of the map; every fifth is a triangle."""
    n = table(spark, sf_dir, "nation")
    x0, y0 = 30 + (F.col("n_nationkey") % 5) * 1.0, F.expr("n_nationkey div 5") * 1.0
    at = lambda dx, dy: F.struct((x0 + dx).cast("double").alias("x"), (y0 + dy).cast("double").alias("y"))
    ring = F.when(F.col("n_nationkey") % 5 == 4, F.array(at(0, 0), at(0.125, 0), at(0, 0.125))).otherwise(F.array(at(0, 0), at(0.5, 0), at(0.5, 0.5), at(0, 0.5)))
    size = F.when(F.col("n_nationkey") % 5 == 4, 0.125).otherwise(0.5)
    return n.select(F.col("n_nationkey").alias("unit_idx"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.array(F.array(ring)).alias("polygons"), x0.alias("minx"), y0.alias("miny"), (x0 + size).alias("maxx"), (y0 + size).alias("maxy"))


UNITS_SQL = "SELECT n_nationkey AS unit_idx, n_name AS name, 30.0::DOUBLE + n_nationkey % 5 AS x0, (n_nationkey // 5)::DOUBLE AS y0, n_nationkey % 5 = 4 AS tri FROM nation"
LOCATED_SQL = f"""SELECT p.idx, coalesce(min(u.unit_idx), -1) AS unit_idx FROM p LEFT JOIN ({UNITS_SQL}) u
  ON p.lon >= u.x0 AND p.lat >= u.y0 AND CASE WHEN u.tri THEN p.lon < u.x0 + 0.125 AND p.lon < (0 - 0.125) * (p.lat - u.y0) / (0.125) + u.x0 + 0.125 AND p.lat < u.y0 + 0.125 ELSE p.lon < u.x0 + 0.5 AND p.lat < u.y0 + 0.5 END GROUP BY p.idx"""

_P = f"WITH RECURSIVE p AS ({POINTS_SQL}), "
NB_SQL = "nb AS (SELECT a.idx, b.idx AS other, b.population AS pop FROM p a JOIN p b ON b.x_m BETWEEN a.x_m - 2000 AND a.x_m + 2000 AND (b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m) <= 4000000.0), "
DB_SQL = NB_SQL + """core AS (SELECT idx FROM nb GROUP BY idx HAVING count(*) >= 4),
  ce AS (SELECT nb.idx, nb.other FROM nb JOIN core a ON a.idx = nb.idx JOIN core b ON b.idx = nb.other),
  cc(idx, c) AS (SELECT idx, idx FROM core UNION SELECT ce.other, cc.c FROM cc JOIN ce ON ce.idx = cc.idx WHERE cc.c < ce.other),
  comp AS (SELECT idx, min(c) AS c FROM cc GROUP BY idx),
  ids AS (SELECT idx, CAST(dense_rank() OVER (ORDER BY c) AS INT) AS label FROM comp),
  border AS (SELECT nb.idx, min(ids.label) AS label FROM nb JOIN ids ON ids.idx = nb.other WHERE nb.idx NOT IN (SELECT idx FROM core) GROUP BY nb.idx),
  lab AS (SELECT p.idx, coalesce(ids.label, border.label, -1) AS label FROM p LEFT JOIN ids USING (idx) LEFT JOIN border USING (idx)) """


def labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return p, dbscan(p, EPS, MIN_PTS)


def q_project_points(spark, sf_dir):
    p = project(points(spark, sf_dir))
    return p.select("idx", F.round("x_m", 1).alias("x"), F.round("y_m", 1).alias("y"))


def q_neighbour_counts(spark, sf_dir):
    return neighbour_sums(points(spark, sf_dir), EPS).select("idx", "n")


def q_core_points_weighted(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("population", F.coalesce("population", F.lit(0.0)))
    return core_points(p, EPS, 20_000.0, weight="population")


def q_dbscan_labels(spark, sf_dir):
    return labels(spark, sf_dir)[1].select("idx", "label")


def q_dbscan_summary(spark, sf_dir):
    p, lab = labels(spark, sf_dir)
    stats = p.join(lab, "idx").where("label >= 1").groupBy(F.col("label").alias("id")).agg(F.count(F.lit(1)).alias("size"), *pass2.weighted_stats(), F.min("idx").alias("first_idx"))
    return stats.select("id", "size", F.round("population", 2).alias("population"), F.round("mean_ability", 6).alias("mean_ability"), "missing_pop", "first_idx")


def q_dbscan_ranked(spark, sf_dir):
    p, lab = labels(spark, sf_dir)
    found = pass1.summarise(p.join(lab, "idx").withColumn("population", F.coalesce("population", F.lit(0.0))), ["population"], "population")
    return found.select("id", "size", F.size("member_ids").cast("long").alias("n_members"), F.round(F.element_at("totals", "population"), 2).alias("total"), "list_ord")


def q_kdist(spark, sf_dir):
    return spatial.kth_distance(points(spark, sf_dir), MIN_PTS).select("idx", F.round("kdist", 6).alias("kdist"))


def q_k_nearest(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.k_nearest(p, p, 3).select("idx", "other", "d2", F.col("rank").cast("long").alias("rank"))


def q_eps_knee(spark, sf_dir):
    return suggest.knee(spatial.kth_distance(points(spark, sf_dir), MIN_PTS)).select(F.round("eps_km", 9).alias("eps_km"))


def q_eps2_by_cluster(spark, sf_dir):
    p, lab = labels(spark, sf_dir)
    own = p.join(lab, "idx").where("label >= 1 and ability is not null").withColumnRenamed("label", "parent")
    return pass2.derive_eps2(own, 4, 0.5, ["parent"]).select("parent", F.round("eps2_m", 6).alias("eps2_m"))


def q_nearest_cluster(spark, sf_dir):
    p, lab = labels(spark, sf_dir)
    own = p.join(lab, "idx")
    return spatial.nearest(own.where("label = -1"), own.where("label >= 1")).select("idx", "other", "d2")


def q_last_mile_facts(spark, sf_dir):
    p, lab = labels(spark, sf_dir)
    f = output.last_mile_facts(p, lab, EPS / 1000)
    return f.select("n", F.round("share", 9).alias("share"), F.round("median_km", 6).alias("median_km"), F.round("p90_km", 6).alias("p90_km"), F.round("near_miss_share", 9).alias("near_miss_share"), F.round("last_mile_population", 2).alias("last_mile_population"), F.round("clustered_mean_ability", 6).alias("clustered_mean_ability"))


def q_raster_sample(spark, sf_dir):
    return raster(spark, sf_dir).sample(points(spark, sf_dir), "value", "covered").select("idx", "value", "covered")


def q_raster_filter(spark, sf_dir):
    r = raster(spark, sf_dir)
    return apply_filters(points(spark, sf_dir), [Filter(r, ">=", 910.0), Filter(r, "<=", 990.0)]).where("keep").select("idx")


def q_raster_outside(spark, sf_dir):
    r = raster(spark, sf_dir)
    return outside_counts(apply_filters(points(spark, sf_dir), [Filter(r, "<=", 950.0), Filter(r, ">=", 0.0)]))


def q_raster_people(spark, sf_dir):
    return raster(spark, sf_dir).people(points(spark, sf_dir)).select("idx", "people")


def q_raster_allocate(spark, sf_dir):
    r = raster(spark, sf_dir)
    # the frame of the derived points: metres are 100,000 times degrees from (30, 0)
    p = points(spark, sf_dir)
    cells = r.populated().select((F.col("row") * 40 + F.col("col")).alias("idx"), F.round((F.col("lon") - 30) * 100_000, 3).alias("x_m"), F.round(F.col("lat") * 100_000, 3).alias("y_m"), "people")
    return allocate(cells, p, "people")


def q_cluster_weights(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("people", F.coalesce("population", F.lit(0.0)))
    return pass1.cluster_weights(p, "people", {"BUILDING": 2.0, "MACHINERY": 0.5}, 0.1)[0].select("idx", F.round("cw", 9).alias("cw"))


def q_admin_locate(spark, sf_dir):
    return admin.locate(points(spark, sf_dir), units(spark, sf_dir)).select("idx", "unit_idx")


def q_straddle(spark, sf_dir):
    p, lab = labels(spark, sf_dir)
    u = units(spark, sf_dir)
    t = admin.units_of(lab.where("label >= 1"), admin.locate(p, u), u, ["label"])
    return t.select("label", F.array_join("admin_units", ",").alias("admin_units"), "straddle")


def q_cluster_names(spark, sf_dir):
    p, lab = labels(spark, sf_dir)
    u = units(spark, sf_dir)
    return admin.cluster_names(lab, pass1.summarise(p.join(lab, "idx")), admin.locate(p, u), u)


def q_composition(spark, sf_dir):
    p, lab = labels(spark, sf_dir)
    return output.composition(lab, p, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], ["label"])


def q_bimodality(spark, sf_dir):
    p = points(spark, sf_dir)
    return breaks.bimodality(p.withColumn("parent", F.col("nk")), "ability", ["parent"]).select("parent", F.round("bc", 7).alias("bc"))


def q_weighted_stats(spark, sf_dir):
    s = points(spark, sf_dir).groupBy("nk").agg(*pass2.weighted_stats())
    return s.select("nk", F.round("population", 2).alias("population"), F.round("mean_ability", 6).alias("mean_ability"), "missing_pop")


def _banded(spark, sf_dir):
    return points(spark, sf_dir).where("ability is not null").withColumn("parent", F.col("nk")).withColumn("value", F.floor(F.col("ability") * 20).cast("double"))


def q_jenks_breaks(spark, sf_dir):
    t = breaks.band_table(_banded(spark, sf_dir), "value", ["parent"])
    return t.select("parent", "k", F.array_join("breaks", ",").alias("breaks"), "method", "flag")


def q_band_ranges(spark, sf_dir):
    b = _banded(spark, sf_dir)
    t = breaks.band_table(b, "value", ["parent"])
    own = b.join(t.select("parent", "k", "breaks"), "parent").withColumn("band", breaks.band_of(F.col("value"), F.col("breaks")))
    return own.groupBy("parent", "band", "k").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).select("parent", "band", "lo", "hi", "n", band_label(F.col("band"), F.col("k")).alias("band_label"))


def _pass2(spark, sf_dir, **options):
    p, lab = labels(spark, sf_dir)
    own = p.join(lab, "idx")
    return p, lab, pass2.subcluster(own, pass2.Options(**options))


def _subarea_rows(t):
    return t.select("parent", "group_id", "band", "scattered", "range_min", "range_max", F.round("population", 2).alias("population"), F.round("mean_ability", 6).alias("mean_ability"), "missing_pop", "point_count")


def q_subareas(spark, sf_dir):
    return _subarea_rows(_pass2(spark, sf_dir)[2].subareas)


def q_subareas_two_bands(spark, sf_dir):
    return _subarea_rows(_pass2(spark, sf_dir, banding=breaks.Banding(max_bands=2), eps2_override_km=1.5)[2].subareas)


def q_subareas_hdbscan(spark, sf_dir):
    return _subarea_rows(_pass2(spark, sf_dir, respatialise="hdbscan")[2].subareas)


def q_skater_regions(spark, sf_dir):
    return _subarea_rows(_pass2(spark, sf_dir, mode="regions")[2].subareas)


def q_pass2_clusters(spark, sf_dir):
    return _pass2(spark, sf_dir, modality_guard=True)[2].clusters.select("parent", "k", "method", "flag", F.round("eps2_km", 9).alias("eps2_km"), "has_unknown")


def q_unknown_groups(spark, sf_dir):
    return _pass2(spark, sf_dir)[2].groups.select("group_id", "kind", "parent", "point_count", F.round("population", 2).alias("population"), F.round("mean_ability", 6).alias("mean_ability"), "missing_pop")


def q_features(spark, sf_dir):
    p, _, r = _pass2(spark, sf_dir)
    u = units(spark, sf_dir)
    f = output.features(r, p, admin.locate(p, u), u)
    return f.select("subarea_id", "kind", "parent_cluster_id", "population", "point_count", F.array_join("admin_units", ",").alias("admin_units"), "straddle", F.round(F.get("centroid", F.lit(0)), 6).alias("lon"), F.round(F.get("centroid", F.lit(1)), 6).alias("lat"))


def q_quintile_class(spark, sf_dir):
    return output.select_class(_pass2(spark, sf_dir)[2], "fifth", fifth=1)


def q_band_class(spark, sf_dir):
    return output.select_class(_pass2(spark, sf_dir)[2], "band", which="lowest")


def q_range_class(spark, sf_dir):
    return output.select_class(_pass2(spark, sf_dir)[2], "range", lo=0.5, hi=1.5)


def q_band_legend(spark, sf_dir):
    r = _pass2(spark, sf_dir)[2]
    return band_legend(r.subareas, r.clusters)


def q_subarea_labels(spark, sf_dir):
    r = _pass2(spark, sf_dir)[2]
    t = r.subareas.join(r.clusters.select("parent", "k"), "parent")
    return t.select("group_id", subarea_label(F.col("band"), F.col("k"), F.col("scattered")).alias("label"), band_fill(F.col("band"), F.col("k")).alias("fill"))


def q_subarea_config(spark, sf_dir):
    p, lab, r = _pass2(spark, sf_dir)
    u = units(spark, sf_dir)
    names = admin.cluster_names(lab, pass1.summarise(p.join(lab, "idx")), admin.locate(p, u), u)
    params = params_of.standard_values() | {"eps_km": EPS / 1000}
    config = output.run_config(params, {"eps_km": "user"}, "2026-01-01T00:00:00Z", "1")
    t = output.with_config(output.subarea_properties(r), names, config, params, r)
    return t.select("subarea_id", "cluster_name", "cfg_algorithm", "cfg_distance_km", "cfg_distance_source", "cfg_subarea_method", "cfg_bands_max", "cfg_band_count", "cfg_banding_method", "cfg_min2", F.round("cfg_eps2_km", 9).alias("cfg_eps2_km"))


def q_composition_text(spark, sf_dir):
    p, lab = labels(spark, sf_dir)
    return output.composition_text(lab, p, ["label"])


def q_last_mile_layers(spark, sf_dir):
    return output.last_mile_layers(*labels(spark, sf_dir))


def q_absolute_legend(spark, sf_dir):
    s = points(spark, sf_dir).groupBy("nk").agg(F.round(F.avg("ability"), 3).alias("mean_ability"))
    return absolute_legend(s).select(F.col("stop").cast("long").alias("stop"), F.round("value", 9).alias("value"), "colour")


def q_display_names(spark, sf_dir):
    u = units(spark, sf_dir)
    ids = u.select("id").unionByName(spark.range(1).select(F.lit("outside").alias("id"))).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    ids = ids.select(F.concat(F.col("k").cast("string"), F.lit("@"), "id").alias("piece"))
    none = spark.range(0).select(F.col("id").cast("int").alias("id"), F.lit("").alias("name"))
    return admin.display_names(ids, none, u, "piece").select("cluster_name", "piece")


def q_cluster_points(spark, sf_dir):
    return pass1.cluster_points(points(spark, sf_dir).select("idx", "id", "lon", "lat", "source"), eps_km=EPS / 1000, min_pts=MIN_PTS).labels


def q_noise_share(spark, sf_dir):
    """The shares that the guard of the suggested parameters looks at."""
    s = suggest.shares(points(spark, sf_dir), EPS / 1000, MIN_PTS)
    return spark.createDataFrame([(round(s["largest"], 9), round(s["noise"], 9))], "largest double, noise double")


def q_core_points_floors(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("population", F.coalesce("population", F.lit(0.0)))
    return core_points(p, EPS, MIN_PTS, floors={"population": 30_000.0})


def q_absolute_colour(spark, sf_dir):
    s = points(spark, sf_dir).groupBy("nk").agg(F.round(F.avg("ability"), 3).alias("mean_ability"))
    return absolute_fill(s).select("nk", "mean_ability", "fill")


def q_split_pieces(spark, sf_dir):
    p, lab, r = _pass2(spark, sf_dir)
    u = units(spark, sf_dir)
    pieces, _ = admin.split_cluster(r, 1, p, admin.locate(p, u), u)
    return pieces.select("piece_key", "name", "n")


def q_reachability_edges(spark, sf_dir):
    e = reachability_edges(points(spark, sf_dir), 4, EPS)
    return e.select("a", "b", F.round("w", 6).alias("w"))


def q_hdbscan_labels(spark, sf_dir):
    return hdbscan(points(spark, sf_dir), 10, 4, EPS).select("idx", "label")


def q_boundaries(spark, sf_dir):
    p, lab = labels(spark, sf_dir)
    b = output.boundaries(lab, pass1.summarise(p.join(lab, "idx")), p, EPS / 1000)
    return b.select("id", "kind", "parent_cluster_id", "point_count", F.size("ring").cast("long").alias("corners"))


def q_run_summary(spark, sf_dir):
    p, lab, r = _pass2(spark, sf_dir)
    return output.run_summary(lab, pass1.summarise(p.join(lab, "idx")), r)


def q_session_log_counts(spark, sf_dir):
    return counts(as_log(table(spark, sf_dir, "events")))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_STATS = "round(coalesce(sum(population), 0), 2) AS population, round(CASE WHEN sum(CASE WHEN ability IS NOT NULL THEN population END) > 0 THEN sum(population * ability) / sum(CASE WHEN ability IS NOT NULL THEN population END) END, 6) AS mean_ability, count(*) FILTER (population IS NULL) AS missing_pop"
_KNN = "kn AS (SELECT a.idx, b.idx AS other, (b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m) AS d2, row_number() OVER (PARTITION BY a.idx ORDER BY (b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m), b.idx) AS rank FROM p a JOIN p b ON a.idx <> b.idx) "
_SAMPLE = f"rs AS ({RASTER_SQL}), s AS (SELECT p.idx, p.lon, p.lat, rs.value, CAST(floor((p.lat - 6.0) / -0.15) AS BIGINT) BETWEEN 0 AND 499 AND CAST(floor((p.lon - 30.6) / 0.15) AS BIGINT) BETWEEN 0 AND 39 AS covered FROM p LEFT JOIN rs ON rs.r = CAST(floor((p.lat - 6.0) / -0.15) AS BIGINT) AND rs.c = CAST(floor((p.lon - 30.6) / 0.15) AS BIGINT) AND CAST(floor((p.lon - 30.6) / 0.15) AS BIGINT) BETWEEN 0 AND 39) "


def _breaks_sql(rows: str, most: int) -> str:
    """jk (parent, k, br, n, spread) of the table jv (parent, value): the cheapest cuts into 2 to ``most`` classes, a layer for each; the most classes of 5 values or more."""
    layers = ["e1 AS (SELECT parent, value, n, s1, s2, greatest(s2 - s1 * s1 / n, 0) AS t, []::DOUBLE[] AS br, n AS fewest FROM jq)"]
    for k in range(2, most + 1):
        layers.append(f"""e{k} AS (SELECT parent, value, n, s1, s2, r.t AS t, r.br AS br, r.fewest AS fewest FROM (
    SELECT y.parent, y.value, y.n, y.s1, y.s2, arg_min(struct_pack(t := x.t + greatest(y.s2 - x.s2 - (y.s1 - x.s1) * (y.s1 - x.s1) / (y.n - x.n), 0), br := list_append(x.br, x.value), fewest := least(x.fewest, y.n - x.n)),
      struct_pack(t := x.t + greatest(y.s2 - x.s2 - (y.s1 - x.s1) * (y.s1 - x.s1) / (y.n - x.n), 0), i := x.n)) AS r
    FROM e{k - 1} x JOIN jq y ON x.parent = y.parent AND x.value < y.value GROUP BY ALL))""")
    every = " UNION ALL ".join(f"SELECT e{k}.parent, {k} AS k, br FROM e{k} JOIN jh ON jh.parent = e{k}.parent AND e{k}.value = jh.hi WHERE fewest >= 5 AND jh.spread > 0" for k in range(2, most + 1))
    return f"""jv AS ({rows}),
  jo AS (SELECT parent, value, row_number() OVER w AS n, sum(value) OVER w AS s1, sum(value * value) OVER w AS s2 FROM jv WINDOW w AS (PARTITION BY parent ORDER BY value ROWS UNBOUNDED PRECEDING)),
  jq AS (SELECT parent, value, max(n) AS n, arg_max(s1, n) AS s1, arg_max(s2, n) AS s2 FROM jo GROUP BY parent, value),
  jh AS (SELECT parent, count(*) AS n, max(value) AS hi, max(value) - min(value) AS spread FROM jv GROUP BY parent),
  {", ".join(layers)}, jf AS ({every}),
  jk AS (SELECT jh.parent, coalesce(max(jf.k), 1) AS k, coalesce(arg_max(br, jf.k), []::DOUBLE[]) AS br, any_value(n) AS n, any_value(spread) AS spread FROM jh LEFT JOIN jf ON jf.parent = jh.parent GROUP BY jh.parent) """


_JENKS = _breaks_sql("SELECT nk AS parent, floor(ability * 20) AS value FROM p WHERE ability IS NOT NULL", 5)
_METHOD = "CASE WHEN k > 1 THEN CASE WHEN n > 1500 THEN 'ckmeans' ELSE 'fisher-jenks' END ELSE 'single-unit' END"
_FLAG = "CASE WHEN k > 1 THEN NULL WHEN spread > 0 THEN 'insufficient-points' ELSE 'homogeneous' END"
_BC = "SELECT parent, CASE WHEN n >= 4 AND g2 IS NOT NULL THEN (g1 * g1 + 1) / (g2 + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))) END AS bc FROM (SELECT parent, count(value)::DOUBLE AS n, CASE WHEN max(value) > min(value) THEN skewness(value) END AS g1, CASE WHEN max(value) > min(value) THEN kurtosis(value) END AS g2 FROM jv GROUP BY parent)"


def _pass2_sql(most: int = 5, eps2: float | None = None, guard: bool = False) -> str:
    """Pass 2 by bands: cl (parent, k, br, eps2), g (members of sub-areas, s null where scattered), sub (a row each)."""
    cut = f"jk JOIN ({_BC}) bc USING (parent)" if guard else "jk"
    own = "CASE WHEN bc <= 5.0::DOUBLE / 9 THEN 1 ELSE k END" if guard else "k"
    flag = f"CASE WHEN bc <= 5.0::DOUBLE / 9 THEN 'unimodal' ELSE {_FLAG} END" if guard else _FLAG
    method = f"CASE WHEN bc <= 5.0::DOUBLE / 9 THEN 'single-unit' ELSE {_METHOD} END" if guard else _METHOD
    derived = """kq AS (SELECT a.parent, a.idx, (b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m) AS d2, row_number() OVER (PARTITION BY a.parent, a.idx ORDER BY (b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m)) AS rank FROM v a JOIN v b ON a.parent = b.parent AND a.idx <> b.idx JOIN ck ON ck.parent = a.parent WHERE ck.k > 1),
  dq AS (SELECT parent, CASE WHEN count(*) > 4 THEN nullif(quantile_cont(kd, 0.5), 0) END AS eps2 FROM (SELECT parent, idx, sqrt(max(d2)) AS kd FROM kq WHERE rank <= 4 GROUP BY ALL) GROUP BY parent)"""
    fixed = f"dq AS (SELECT parent, {eps2}::DOUBLE AS eps2 FROM ck WHERE k > 1)"
    return f""", v AS (SELECT p.idx, label AS parent, population, ability, x_m, y_m, lon, lat FROM p JOIN lab USING (idx) WHERE label >= 1 AND ability IS NOT NULL),
  {_breaks_sql("SELECT parent, ability AS value FROM v", most)},
  ck AS (SELECT parent, {own} AS k, {method} AS method, {flag} AS flag, br FROM {cut}),
  {derived if eps2 is None else fixed},
  cl AS (SELECT ck.*, dq.eps2 FROM ck LEFT JOIN dq USING (parent)),
  m AS (SELECT v.*, k, eps2, CASE WHEN k > 1 THEN len(list_filter(br, lambda x: v.ability > x)) ELSE 0 END AS band FROM v JOIN cl USING (parent)),
  n2 AS (SELECT a.parent, a.band, a.idx, o.idx AS other FROM m a JOIN m o ON a.parent = o.parent AND a.band = o.band AND (o.x_m - a.x_m) * (o.x_m - a.x_m) + (o.y_m - a.y_m) * (o.y_m - a.y_m) <= a.eps2 * a.eps2),
  c2 AS (SELECT parent, band, idx FROM n2 GROUP BY ALL HAVING count(*) >= 4),
  e2x AS (SELECT n2.* FROM n2 JOIN c2 x ON x.idx = n2.idx JOIN c2 y ON y.idx = n2.other),
  r2(idx, c) AS (SELECT idx, idx FROM c2 UNION SELECT e2x.other, r2.c FROM r2 JOIN e2x ON e2x.idx = r2.idx WHERE r2.c < e2x.other),
  q2 AS (SELECT idx, min(c) AS c FROM r2 GROUP BY idx),
  i2 AS (SELECT idx, dense_rank() OVER (PARTITION BY parent, band ORDER BY c) AS s FROM q2 JOIN c2 USING (idx)),
  d2 AS (SELECT n2.idx, min(s) AS s FROM n2 JOIN i2 ON i2.idx = n2.other GROUP BY n2.idx),
  g AS (SELECT m.*, CASE WHEN k = 1 OR eps2 IS NULL THEN 1 ELSE s END AS s, min(ability) OVER (PARTITION BY parent, band) AS range_min, max(ability) OVER (PARTITION BY parent, band) AS range_max FROM m LEFT JOIN d2 USING (idx)),
  gm AS (SELECT *, parent || '-b' || band || '-' || CASE WHEN s IS NULL THEN 'scattered' ELSE 's' || s END AS group_id FROM g),
  sub AS (SELECT parent, group_id, band, s IS NULL AS scattered, range_min, range_max, {_STATS}, count(*) AS point_count FROM gm GROUP BY parent, group_id, band, s, range_min, range_max) """


_FIVE = _pass2_sql()
_AREAS = f", l AS ({LOCATED_SQL}), t AS (SELECT label AS id, unit_idx, count(*) AS n FROM lab JOIN l USING (idx) WHERE label >= 1 GROUP BY ALL), tt AS (SELECT id, sum(n) AS total, coalesce(sum(n) FILTER (unit_idx < 0), 0) AS outside, count(*) FILTER (unit_idx >= 0) AS areas, max(n) FILTER (unit_idx >= 0) AS best FROM t GROUP BY id), w AS (SELECT tt.*, (SELECT min(unit_idx) FROM t WHERE t.id = tt.id AND unit_idx >= 0 AND t.n = tt.best) AS unit FROM tt), b0 AS (SELECT w.id, (SELECT min(idx) FROM lab WHERE label = w.id) AS f, CASE WHEN best IS NULL OR best < outside THEN 'Cluster ' || w.id ELSE n_name || CASE WHEN 2 * best < total AND areas > 1 THEN CASE WHEN areas = 2 THEN ' and 1 more area' ELSE ' and ' || (areas - 1) || ' more areas' END ELSE '' END END AS base FROM w LEFT JOIN nation ON n_nationkey = w.unit) "
_HEX = "printf('%02x', CAST(floor({a} + {b} * t + 0.5) AS INT))"

ORACLE_SQL = {
    "subareas": f"{_P}{DB_SQL}{_FIVE} SELECT parent, group_id, band, scattered, range_min, range_max, population, mean_ability, missing_pop, point_count FROM sub",
    "subareas_two_bands": f"{_P}{DB_SQL}{_pass2_sql(2, 1500.0)} SELECT parent, group_id, band, scattered, range_min, range_max, population, mean_ability, missing_pop, point_count FROM sub",
    "pass2_clusters": f"{_P}{DB_SQL}{_pass2_sql(guard=True)}, hu AS (SELECT label AS parent, count(ability) AS n, count(*) FILTER (ability IS NULL) > 0 AS has_unknown FROM p JOIN lab USING (idx) WHERE label >= 1 GROUP BY label) SELECT hu.parent, CASE WHEN hu.n = 0 THEN 0 ELSE cl.k END AS k, CASE WHEN hu.n = 0 THEN 'none' ELSE cl.method END AS method, CASE WHEN hu.n = 0 THEN 'all-unknown' ELSE cl.flag END AS flag, round(eps2 / 1000, 9) AS eps2_km, has_unknown FROM hu LEFT JOIN cl USING (parent)",
    "features": f"{_P}{DB_SQL}{_FIVE}, l AS ({LOCATED_SQL}), every AS (SELECT group_id, 'subarea' AS kind, parent, idx FROM gm UNION ALL SELECT CASE WHEN label >= 1 THEN label || '-unknown' ELSE 'last-mile' END, CASE WHEN label >= 1 THEN 'unknown' ELSE 'last_mile' END, CASE WHEN label >= 1 THEN label END, idx FROM p JOIN lab USING (idx) WHERE label = -1 OR ability IS NULL), un AS (SELECT group_id, string_agg(unit_idx::VARCHAR, ',' ORDER BY unit_idx) AS ids, count(*) AS n FROM (SELECT DISTINCT group_id, unit_idx FROM every JOIN l USING (idx) WHERE unit_idx >= 0) GROUP BY group_id) SELECT group_id AS subarea_id, kind, parent AS parent_cluster_id, CAST(floor(coalesce(sum(population), 0) + 0.5) AS BIGINT) AS population, count(*) AS point_count, coalesce(any_value(un.ids), '') AS admin_units, coalesce(any_value(un.n), 0) > 1 AS straddle, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM every JOIN p USING (idx) LEFT JOIN un USING (group_id) GROUP BY group_id, kind, parent",
    "quintile_class": f"{_P}{DB_SQL}{_FIVE}, cut AS (SELECT quantile_disc(mean_ability, 0.2) AS c FROM sub) SELECT group_id AS subarea_id, 'lowest fifth across the map' AS export_class, true AS export_comparable_across_map FROM sub, cut WHERE mean_ability <= c",
    "range_class": f"{_P}{DB_SQL}{_FIVE} SELECT group_id AS subarea_id, 'value 0.5 to 1.5' AS export_class, true AS export_comparable_across_map FROM sub WHERE mean_ability BETWEEN 0.5 AND 1.5",
    "band_class": f"{_P}{DB_SQL}{_FIVE} SELECT group_id AS subarea_id, 'lowest band within its own cluster' AS export_class, false AS export_comparable_across_map FROM sub JOIN cl USING (parent) WHERE cl.k > 1 AND band = 0",
    "run_summary": f"{_P}{DB_SQL}{_FIVE} SELECT 0 AS ord, 'points' AS label, count(*) AS value FROM lab UNION ALL SELECT 1, 'clusters', count(DISTINCT label) FROM lab WHERE label >= 1 UNION ALL SELECT 2, 'last-mile (unclustered) points', count(*) FROM lab WHERE label = -1 UNION ALL SELECT 3, 'filtered points', 0 UNION ALL SELECT 4, 'sub-areas', count(*) FROM sub WHERE NOT scattered UNION ALL SELECT 5, 'scattered groups', count(*) FROM sub WHERE scattered UNION ALL SELECT 6, 'unknown-value points', count(*) FROM p JOIN lab USING (idx) WHERE label >= 1 AND ability IS NULL",
    "band_legend": f"{_P}{DB_SQL}{_FIVE} SELECT DISTINCT sub.parent, band, CASE WHEN k <= 1 THEN 'whole area' ELSE CASE WHEN band = 0 THEN 'lowest ' WHEN band = k - 1 THEN 'highest ' ELSE ['first', 'second', 'third', 'fourth'][band + 1] || '-lowest ' END || ['half', 'third', 'quarter', 'fifth'][k - 1] END AS label, range_min, range_max FROM sub JOIN cl USING (parent)",
    "subarea_labels": f"{_P}{DB_SQL}{_FIVE} SELECT group_id, CASE WHEN scattered THEN 'scattered points — ' ELSE '' END || CASE WHEN k <= 1 THEN 'whole area' ELSE CASE WHEN band = 0 THEN 'lowest ' WHEN band = k - 1 THEN 'highest ' ELSE ['first', 'second', 'third', 'fourth'][band + 1] || '-lowest ' END || ['half', 'third', 'quarter', 'fifth'][k - 1] END || ' of this area' AS label, '#' || {_HEX.format(a=234, b=22 - 234)} || {_HEX.format(a=241, b=74 - 241)} || {_HEX.format(a=245, b=104 - 245)} AS fill FROM (SELECT sub.*, cl.k, band::DOUBLE / greatest(1, cl.k - 1) AS t FROM sub JOIN cl USING (parent))",
    "subarea_config": f"{_P}{DB_SQL}{_FIVE}{_AREAS}, nm AS (SELECT id, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY f) > 1 THEN ' ' || row_number() OVER (PARTITION BY base ORDER BY f) ELSE '' END AS name FROM b0) SELECT group_id AS subarea_id, nm.name AS cluster_name, 'dbscan' AS cfg_algorithm, 2.0::DOUBLE AS cfg_distance_km, 'user' AS cfg_distance_source, 'bands' AS cfg_subarea_method, 5 AS cfg_bands_max, cl.k AS cfg_band_count, cl.method AS cfg_banding_method, 4 AS cfg_min2, round(eps2 / 1000, 9) AS cfg_eps2_km FROM sub JOIN cl USING (parent) JOIN nm ON nm.id = sub.parent",
    "composition_text": f"{_P}{DB_SQL} SELECT label, string_agg(source || ' ' || n, ', ' ORDER BY n DESC, source) AS composition FROM (SELECT label, source, count(*) AS n FROM lab JOIN p USING (idx) GROUP BY ALL) GROUP BY label",
    "last_mile_layers": f"{_P}{DB_SQL} SELECT source, count(*) AS n FROM lab JOIN p USING (idx) WHERE label = -1 GROUP BY source",
    "absolute_legend": f"{_P} s AS (SELECT round(avg(ability), 3) AS a FROM p GROUP BY nk), r AS (SELECT min(a) AS lo, max(a) AS hi FROM s), t AS (SELECT unnest(range(5)) AS stop, lo, hi FROM r) SELECT stop, round(lo + (hi - lo) * stop / 4, 9) AS value, '#' || {_HEX.format(a=234, b=22 - 234)} || {_HEX.format(a=241, b=74 - 241)} || {_HEX.format(a=245, b=104 - 245)} AS colour FROM (SELECT *, (lo + (hi - lo) * stop / 4 - lo) / (hi - lo) AS t FROM t)",
    "display_names": f"SELECT 'Cluster ' || k || CASE WHEN n_nationkey < 0 THEN ' · outside the areas' ELSE ' · ' || n_name END AS cluster_name, k || '@' || CASE WHEN n_nationkey < 0 THEN 'outside' ELSE n_nationkey::VARCHAR END AS piece FROM (SELECT unnest([1, 2]) AS k), (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT -1, '')",
    "cluster_points": f"WITH RECURSIVE p0 AS ({POINTS_SQL}), fr AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM p0), p AS (SELECT p0.* EXCLUDE (x_m, y_m), (lon - lon0) * (pi() / 180) * 6371000.0 * cos(lat0 * (pi() / 180)) AS x_m, (lat - lat0) * (pi() / 180) * 6371000.0 AS y_m FROM p0, fr), {DB_SQL} SELECT idx, label FROM lab",
    "noise_share": f"{_P}{DB_SQL} SELECT round(max(n) FILTER (label >= 1) / sum(n), 9) AS largest, round(coalesce(max(n) FILTER (label = -1), 0) / sum(n), 9) AS noise FROM (SELECT label, count(*) AS n FROM lab GROUP BY label)",
    "core_points_floors": f"{_P}{NB_SQL} z AS (SELECT 1) SELECT idx FROM nb GROUP BY idx HAVING count(*) >= 4 AND sum(coalesce(pop, 0)) >= 30000",
    "unknown_groups": f"{_P}{DB_SQL}, u AS (SELECT p.*, label FROM p JOIN lab USING (idx)) SELECT label || '-unknown' AS group_id, 'unknown' AS kind, label AS parent, count(*) AS point_count, {_STATS} FROM u WHERE label >= 1 AND ability IS NULL GROUP BY label UNION ALL SELECT 'last-mile', 'last_mile', NULL, count(*), {_STATS} FROM u WHERE label = -1 HAVING count(*) > 0",
    "cluster_names": f"{_P}{DB_SQL}{_AREAS} SELECT id, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY f) > 1 THEN ' ' || row_number() OVER (PARTITION BY base ORDER BY f) ELSE '' END AS name FROM b0",
    "split_pieces": f"{_P}{DB_SQL}, l AS ({LOCATED_SQL}) SELECT '1@' || coalesce(n_nationkey::VARCHAR, 'outside') AS piece_key, n_name AS name, count(*) AS n FROM lab JOIN l USING (idx) LEFT JOIN nation ON n_nationkey = unit_idx WHERE label = 1 GROUP BY ALL",
    "absolute_colour": f"{_P} a AS (SELECT nk, round(avg(ability), 3) AS mean_ability FROM p GROUP BY nk), t AS (SELECT *, (mean_ability - min(mean_ability) OVER ()) / nullif(max(mean_ability) OVER () - min(mean_ability) OVER (), 0) AS t FROM a) SELECT nk, mean_ability, CASE WHEN mean_ability IS NULL THEN '#c9ccce' ELSE '#' || {_HEX.format(a=234, b=22 - 234)} || {_HEX.format(a=241, b=74 - 241)} || {_HEX.format(a=245, b=104 - 245)} END AS fill FROM t",
    "project_points": f"{_P} f AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM p) SELECT idx, round((lon - lon0) * (pi() / 180) * 6371000.0 * cos(lat0 * (pi() / 180)), 1) AS x, round((lat - lat0) * (pi() / 180) * 6371000.0, 1) AS y FROM p, f",
    "neighbour_counts": f"{_P}{NB_SQL} z AS (SELECT 1) SELECT idx, count(*) AS n FROM nb GROUP BY idx",
    "core_points_weighted": f"{_P}{NB_SQL} z AS (SELECT 1) SELECT idx FROM nb GROUP BY idx HAVING sum(coalesce(pop, 0)) >= 20000",
    "dbscan_labels": f"{_P}{DB_SQL} SELECT idx, label FROM lab",
    "dbscan_summary": f"{_P}{DB_SQL} SELECT label AS id, count(*) AS size, {_STATS}, min(idx) AS first_idx FROM lab JOIN p USING (idx) WHERE label >= 1 GROUP BY label",
    "dbscan_ranked": f"{_P}{DB_SQL} SELECT label AS id, count(*) AS size, count(*) AS n_members, round(sum(coalesce(population, 0)), 2) AS total, row_number() OVER (ORDER BY sum(coalesce(population, 0)) DESC, min(idx)) AS list_ord FROM lab JOIN p USING (idx) WHERE label >= 1 GROUP BY label",
    "kdist": f"{_P}{_KNN} SELECT idx, round(sqrt(max(d2)), 6) AS kdist FROM kn WHERE rank <= 4 GROUP BY idx",
    "k_nearest": f"{_P}{_KNN} SELECT idx, other, d2, rank FROM kn WHERE rank <= 3",
    "eps_knee": f"{_P}{_KNN}, kd AS (SELECT idx, sqrt(max(d2)) AS kdist FROM kn WHERE rank <= 4 GROUP BY idx), r AS (SELECT kdist, row_number() OVER (ORDER BY kdist, idx) - 1 AS i, count(*) OVER () AS n, min(kdist) OVER () AS lo, max(kdist) OVER () AS hi FROM kd) SELECT round(kdist / 1000, 9) AS eps_km FROM r ORDER BY abs((hi - lo) * i - (n - 1) * (kdist - lo)) DESC, i LIMIT 1",
    "eps2_by_cluster": f"{_P}{DB_SQL}, q AS (SELECT p.idx, label AS parent, x_m, y_m FROM p JOIN lab USING (idx) WHERE label >= 1 AND ability IS NOT NULL), kq AS (SELECT a.parent, a.idx, (b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m) AS d2, row_number() OVER (PARTITION BY a.parent, a.idx ORDER BY (b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m)) AS rank FROM q a JOIN q b ON a.parent = b.parent AND a.idx <> b.idx), d AS (SELECT parent, idx, sqrt(max(d2)) AS kd FROM kq WHERE rank <= 4 GROUP BY ALL) SELECT parent, round(CASE WHEN count(*) > 4 THEN quantile_cont(kd, 0.5) END, 6) AS eps2_m FROM d GROUP BY parent",
    "nearest_cluster": f"{_P}{DB_SQL}, q AS (SELECT * FROM p JOIN lab USING (idx)) SELECT a.idx, arg_min(b.idx, struct_pack(d := (b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m), i := b.idx)) AS other, min((b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m)) AS d2 FROM q a, q b WHERE a.label = -1 AND b.label >= 1 GROUP BY a.idx",
    "last_mile_facts": f"{_P}{DB_SQL}, q AS (SELECT * FROM p JOIN lab USING (idx)), d AS (SELECT a.idx, sqrt(min((b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m))) / 1000 AS km FROM q a, q b WHERE a.label = -1 AND b.label >= 1 GROUP BY a.idx) SELECT (SELECT count(*) FROM q WHERE label = -1) AS n, round((SELECT avg(CASE WHEN label = -1 THEN 1.0::DOUBLE ELSE 0 END) FROM q), 9) AS share, round(quantile_disc(km, 0.5), 6) AS median_km, round(quantile_disc(km, 0.9), 6) AS p90_km, round(avg(CASE WHEN km <= 4 THEN 1.0::DOUBLE ELSE 0 END), 9) AS near_miss_share, round((SELECT sum(population) FROM q WHERE label = -1), 2) AS last_mile_population, round((SELECT sum(population * ability) / sum(population) FILTER (ability IS NOT NULL) FROM q WHERE label >= 1), 6) AS clustered_mean_ability FROM d",
    "raster_sample": f"{_P}{_SAMPLE} SELECT idx, value, covered FROM s",
    "raster_filter": f"{_P}{_SAMPLE} SELECT idx FROM s WHERE coalesce(value, 0) >= 910 AND coalesce(value, 0) <= 990",
    "raster_outside": f"{_P}{_SAMPLE} SELECT 'price' AS raster, sum(CASE WHEN coalesce(value, 0) <= 950 THEN 2 ELSE 1 END)::BIGINT AS n FROM s WHERE NOT covered HAVING count(*) > 0",
    "raster_people": f"{_P}{_SAMPLE} SELECT idx, coalesce(value, 0) AS people FROM s",
    "raster_allocate": f"{_P} rs AS ({RASTER_SQL}), cell AS (SELECT r * 40 + c AS ci, round((30.6::DOUBLE + (c + 0.5) * 0.15::DOUBLE - 30) * 100000, 3) AS x, round((6.0::DOUBLE + (r + 0.5) * (-0.15)::DOUBLE) * 100000, 3) AS y, value FROM rs WHERE value > 0), m AS (SELECT ci, any_value(value) AS value, arg_min(p.idx, struct_pack(d := (p.x_m - x) * (p.x_m - x) + (p.y_m - y) * (p.y_m - y), i := p.idx)) AS idx FROM cell, p GROUP BY ci) SELECT idx, sum(value) AS people FROM m GROUP BY idx",
    "cluster_weights": f"{_P} w AS (SELECT idx, coalesce(population, 0) / (SELECT avg(coalesce(population, 0)) FROM p) * CASE source WHEN 'BUILDING' THEN 2.0::DOUBLE WHEN 'MACHINERY' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS v FROM p) SELECT idx, round(greatest(v / (SELECT avg(v) FROM w), 0.1::DOUBLE), 9) AS cw FROM w",
    "admin_locate": f"{_P} l AS ({LOCATED_SQL}) SELECT * FROM l",
    "straddle": f"{_P}{DB_SQL}, l AS ({LOCATED_SQL}) SELECT label, coalesce(string_agg(DISTINCT unit_idx::VARCHAR, ',' ORDER BY unit_idx::VARCHAR) FILTER (unit_idx >= 0), '') AS admin_units, count(DISTINCT unit_idx) FILTER (unit_idx >= 0) > 1 AS straddle FROM lab JOIN l USING (idx) WHERE label >= 1 GROUP BY label",
    "composition": f"{_P}{DB_SQL} SELECT label, " + ", ".join(f"count(*) FILTER (source = '{x}') AS n_{x.lower()}" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM lab JOIN p USING (idx) GROUP BY label",
    "bimodality": f"{_P} m AS (SELECT nk AS parent, count(ability)::DOUBLE AS n, skewness(ability) AS g1, kurtosis(ability) AS g2 FROM p GROUP BY nk) SELECT parent, CASE WHEN n >= 4 THEN round((g1 * g1 + 1) / (g2 + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 7) END AS bc FROM m WHERE n > 0",
    "weighted_stats": f"{_P} z AS (SELECT 1) SELECT nk, {_STATS} FROM p GROUP BY nk",
    "jenks_breaks": f"{_P}{_JENKS} SELECT parent, k, list_aggregate(list_transform(br, lambda x: format('{{:.1f}}', x)), 'string_agg', ',') AS breaks, {_METHOD} AS method, {_FLAG} AS flag FROM jk",
    "band_ranges": f"{_P}{_JENKS}, z AS (SELECT parent, len(list_filter(br, lambda x: value > x)) AS band, value, k FROM jv JOIN jk USING (parent)) SELECT parent, band, min(value) AS lo, max(value) AS hi, count(*) AS n, CASE WHEN any_value(k) = 1 THEN 'whole area' ELSE CASE WHEN band = 0 THEN 'lowest ' WHEN band = any_value(k) - 1 THEN 'highest ' ELSE ['first', 'second', 'third', 'fourth'][band + 1] || '-lowest ' END || ['half', 'third', 'quarter', 'fifth'][any_value(k) - 1] END AS band_label FROM z GROUP BY parent, band",
    "reachability_edges": f"{_P}{NB_SQL} n2 AS (SELECT nb.idx, nb.other, (b.x_m - a.x_m) * (b.x_m - a.x_m) + (b.y_m - a.y_m) * (b.y_m - a.y_m) AS d2, floor(b.x_m / 2000) AS cx, floor(b.y_m / 2000) AS cy FROM nb JOIN p a ON a.idx = nb.idx JOIN p b ON b.idx = nb.other WHERE nb.idx <> nb.other), rk AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d2, cx, cy, other) AS rank FROM n2), core AS (SELECT idx, coalesce(min(sqrt(d2)) FILTER (rank >= 4), max(sqrt(d2))) AS core FROM rk GROUP BY idx), e AS (SELECT DISTINCT least(idx, other) AS a, greatest(idx, other) AS b, sqrt(d2) AS d FROM rk WHERE rank <= 16) SELECT e.a, e.b, round(greatest(x.core, y.core, d, 1.0), 6) AS w FROM e JOIN core x ON x.idx = e.a JOIN core y ON y.idx = e.b",
    "session_log_counts": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS event, count(*) AS n FROM events GROUP BY ALL",
}
