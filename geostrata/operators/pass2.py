"""Pass 2: split each cluster into sub-areas by value bands and space, or into regions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators.breaks import UNIFORM_BC, Banding, band_of, band_table, bimodality, unimodal
from geostrata.operators.dbscan import NOISE, dbscan
from geostrata.operators.hdbscan import hdbscan
from geostrata.operators.regions import DEFAULT_KNN, regions
from geostrata.operators.spatial import kth_distance
from geostrata.runtime import checkpoint

#: Fixed value: a hierarchical split of a band links at this multiple of the cluster's distance.
LINK_FACTOR = 4


@dataclass(frozen=True)
class Options:
    min2: int = 4
    eps2_override_km: float | None = None
    eps2_percentile: float = 0.5
    respatialise: str = "dbscan"
    modality_guard: bool = False
    modality_threshold: float = UNIFORM_BC
    mode: str = "bands"
    region_count: int = 4
    region_knn: int = DEFAULT_KNN
    banding: Banding = field(default_factory=Banding)

    def eps2_rule(self) -> str:
        return "override" if self.eps2_override_km is not None else f"q{self.eps2_percentile:g}-min2-nn"


@dataclass
class Pass2:
    """``clusters``: keys, parent, k, method, flag, eps2_km, has_unknown; ``subareas`` and ``groups`` (unknown and last-mile) with statistics; ``members``: keys, parent, group_id, kind, idx."""

    clusters: DataFrame
    subareas: DataFrame
    groups: DataFrame
    members: DataFrame
    options: Options


def finite(value: Column) -> Column:
    """Null for NaN and infinite values."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def weighted_stats() -> list[Column]:
    """population (a sum), mean_ability (weighted by population; null without weight), missing_pop (a count)."""
    pop, ability = F.col("population"), F.col("ability")
    both = pop.isNotNull() & ability.isNotNull()
    weight = F.sum(F.when(both, pop))
    return [F.coalesce(F.sum(pop), F.lit(0.0)).alias("population"), F.when(weight > 0, F.sum(F.when(both, pop * ability)) / F.nullif(weight, F.lit(0.0))).alias("mean_ability"), F.count_if(pop.isNull()).alias("missing_pop")]


def derive_eps2(points: DataFrame, min2: int, percentile: float, keys: list[str]) -> DataFrame:
    """(keys, eps2_m): a quantile of the distances to the min2-th neighbour; null for min2 points or fewer."""
    d = kth_distance(points, min2, keys)
    return d.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > min2, F.percentile("kdist", percentile)).alias("eps2_m"))


def subcluster(points: DataFrame, options: Options = Options(), keys: list[str] | None = None) -> Pass2:
    """Pass 2 of ``points`` (keys, idx, x_m, y_m, label, ability, population).

    Missing values are null (NaN and infinities count as missing); a table without the columns
    ability or population is refused. Points of a cluster without a value form its unknown group,
    points in no cluster the last-mile group; none is dropped. ``keys`` runs several inputs apart
    from each other at once.
    """
    for c in ("ability", "population"):
        if c not in points.columns:
            raise ValueError(f"pass 2 needs the column {c}")
    keys = keys or []
    parent = [*keys, "parent"]
    base = points.select(*keys, "idx", "x_m", "y_m", "label", finite(F.col("ability").cast("double")).alias("ability"), finite(F.col("population").cast("double")).alias("population"))
    base = checkpoint(base.where((F.col("label") >= 1) | (F.col("label") == NOISE)))
    inside = base.where("label >= 1").withColumnRenamed("label", "parent")
    valued = inside.where("ability is not null")
    head = inside.groupBy(*parent).agg(F.count("ability").alias("n_valued"), F.count_if(F.col("ability").isNull()).alias("n_unknown"), F.min("ability").alias("lo"), F.max("ability").alias("hi"))

    if options.mode == "regions":
        clusters, placed = _regions(valued, head, parent, options)
    else:
        clusters, placed = _bands(valued, head, parent, options)
    placed = checkpoint(placed)
    stats = placed.groupBy(*parent, "group_id", "band", "seq", "scattered", "range_min", "range_max").agg(*weighted_stats(), F.count(F.lit(1)).alias("point_count"))
    clusters = clusters.withColumn("has_unknown", F.col("n_unknown") > 0).drop("n_valued", "n_unknown", "lo", "hi")
    subareas = stats.join(clusters.select(*parent, "has_unknown"), parent)
    unknown = inside.where("ability is null").withColumn("group_id", F.concat(F.col("parent").cast("string"), F.lit("-unknown"))).withColumn("kind", F.lit("unknown"))
    last = base.where(F.col("label") == NOISE).withColumn("parent", F.lit(None).cast("int")).withColumn("group_id", F.lit("last-mile")).withColumn("kind", F.lit("last_mile"))
    rest = unknown.select(*parent, "group_id", "kind", "idx", "ability", "population").unionByName(last.select(*parent, "group_id", "kind", "idx", "ability", "population"))
    groups = rest.groupBy(*parent, "group_id", "kind").agg(*weighted_stats(), F.count(F.lit(1)).alias("point_count"))
    members = placed.select(*parent, "group_id", F.lit("subarea").alias("kind"), "idx").unionByName(rest.select(*parent, "group_id", "kind", "idx"))
    return Pass2(checkpoint(clusters), subareas, groups, members, options)


def _whole(head: DataFrame, cond: Column, method: str, flag: Column) -> DataFrame:
    return head.where(cond).withColumn("k", F.lit(1)).withColumn("method", F.lit(method)).withColumn("flag", flag)


def _bands(valued: DataFrame, head: DataFrame, parent: list[str], o: Options) -> tuple[DataFrame, DataFrame]:
    no_breaks = F.array().cast("array<double>")
    table = band_table(valued, "ability", parent, o.banding)
    known = head.join(table.select(*parent, "k", "breaks", "method", "flag"), parent, "left")
    if o.modality_guard:
        known = known.join(bimodality(valued, "ability", parent), parent, "left")
        smooth = unimodal(F.col("bc"), o.modality_threshold) & (F.col("n_valued") > 0)
        for c, v in (("k", F.lit(1)), ("breaks", no_breaks), ("method", F.lit("single-unit")), ("flag", F.lit("unimodal"))):
            known = known.withColumn(c, F.when(smooth, v).otherwise(F.col(c)))
        known = known.drop("bc")
    none = F.col("n_valued") == 0
    known = known.withColumn("k", F.when(none, 0).otherwise(F.col("k"))).withColumn("method", F.when(none, "none").otherwise(F.col("method"))).withColumn("flag", F.when(none, "all-unknown").otherwise(F.col("flag"))).withColumn("breaks", F.coalesce("breaks", no_breaks))
    known = checkpoint(known)
    split = valued.join(known.where("k > 1").select(*parent), parent, "left_semi")
    if o.eps2_override_km is not None:
        eps = known.where("k > 1").select(*parent, F.lit(o.eps2_override_km * 1000.0).alias("eps2_m"))
    else:
        eps = derive_eps2(split, o.min2, o.eps2_percentile, parent)
    eps = eps.withColumn("eps2_m", F.when((F.col("eps2_m") > 0) & (F.col("eps2_m") < float("inf")), F.col("eps2_m")))
    clusters = checkpoint(known.join(eps, parent, "left").withColumn("eps2_km", F.col("eps2_m") / 1000))

    banded = valued.join(clusters.select(*parent, "k", "breaks", "eps2_m"), parent).withColumn("band", band_of(F.col("ability"), F.col("breaks")))
    banded = checkpoint(banded.drop("breaks"))
    ranges = banded.groupBy(*parent, "band").agg(F.min("ability").alias("range_min"), F.max("ability").alias("range_max"))
    apart = banded.where("k > 1 and eps2_m is not null")
    key = [*parent, "band"]
    if o.respatialise == "hdbscan":
        local = hdbscan(apart.withColumn("_link", F.col("eps2_m") * LINK_FACTOR), o.min2, o.min2, "_link", keys=key)
    else:
        local = dbscan(apart, "eps2_m", o.min2, keys=key)
    local = local.withColumnRenamed("label", "local")
    placed = banded.join(local, [*key, "idx"], "left").withColumn("local", F.coalesce("local", F.lit(1)))
    seqs = placed.where("local >= 1").select(*key, "local").distinct().withColumn("seq", F.row_number().over(Window.partitionBy(*key).orderBy("local")))
    placed = placed.join(seqs, [*key, "local"], "left").join(ranges, key)
    scattered = F.col("local") == NOISE
    tail = F.when(scattered, F.lit("scattered")).otherwise(F.concat(F.lit("s"), F.col("seq").cast("string")))
    placed = placed.withColumn("scattered", scattered).withColumn("group_id", F.concat(F.col("parent").cast("string"), F.lit("-b"), F.col("band").cast("string"), F.lit("-"), tail))
    return clusters.drop("breaks", "eps2_m"), placed.select(*parent, "group_id", "band", "seq", "scattered", "range_min", "range_max", "idx", "ability", "population")


def _regions(valued: DataFrame, head: DataFrame, parent: list[str], o: Options) -> tuple[DataFrame, DataFrame]:
    flat = (F.col("n_valued") < 2) | (F.col("hi") - F.col("lo") <= 0)
    many = valued.join(head.where(~flat).select(*parent), parent, "left_semi")
    found = checkpoint(regions(many, "ability", parent, o.region_count, o.region_knn))
    counts = found.groupBy(*parent).agg(F.max("region").cast("int").alias("_k"))
    none = F.col("n_valued") == 0
    clusters = head.join(counts, parent, "left").select(*head.columns, F.when(none, 0).when(flat, 1).otherwise(F.col("_k")).cast("int").alias("k"), F.when(none, "none").otherwise("regions").alias("method"), F.when(none, "all-unknown").when(flat, "homogeneous").alias("flag"), F.lit(None).cast("double").alias("eps2_km"))
    placed = valued.join(found, [*parent, "idx"], "left").withColumn("seq", F.coalesce("region", F.lit(1)).cast("int"))
    ranges = placed.groupBy(*parent, "seq").agg(F.min("ability").alias("range_min"), F.max("ability").alias("range_max"))
    placed = placed.join(ranges, [*parent, "seq"]).withColumn("band", F.col("seq") - 1).withColumn("scattered", F.lit(False))
    placed = placed.withColumn("group_id", F.concat(F.col("parent").cast("string"), F.lit("-r"), F.col("seq").cast("string")))
    return clusters, placed.select(*parent, "group_id", "band", "seq", "scattered", "range_min", "range_max", "idx", "ability", "population")
