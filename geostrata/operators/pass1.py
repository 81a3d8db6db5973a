"""Pass 1: filter, project, weight and cluster points; summarise the clusters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.geo import frame_of, project
from geostrata.operators.dbscan import FILTERED, NOISE, dbscan
from geostrata.operators.hdbscan import hdbscan
from geostrata.runtime import checkpoint
from geostrata.sources.raster import Filter, Raster, apply_filters, outside_counts, weights


@dataclass(frozen=True)
class Weight:
    """A raster whose people are totalled for each cluster, and the floor that core points need."""

    raster: Raster
    allocation: str = "allocate"
    min_pop: float | None = None


@dataclass
class Pass1:
    """What pass 1 found. ``labels``: idx, label; ``clusters``: id, size, member_ids, totals, centroid, list_ord."""

    points: DataFrame
    labels: DataFrame
    clusters: DataFrame
    outside: DataFrame | None
    weighting: dict = field(default_factory=dict)
    floors: dict = field(default_factory=dict)


def layer_weight(source: Column, layer_weights: dict[str, float] | None) -> Column | None:
    """Each point's layer multiplier, 1 for layers that aren't named; None when all are 1."""
    if not layer_weights:
        return None
    for name, w in layer_weights.items():
        if isinstance(w, bool) or not isinstance(w, int | float) or not 0 < w < float("inf"):
            raise ValueError(f'layer weight for "{name}" must be a number greater than 0')
    if all(w == 1 for w in layer_weights.values()):
        return None
    table = F.create_map(*(F.lit(x) for name, w in layer_weights.items() for x in (name, float(w))))
    return F.coalesce(F.try_element_at(table, source), F.lit(1.0))


def cluster_weights(points: DataFrame, people: str | None = None, layer_weights: dict[str, float] | None = None, floor: float = 0.1) -> tuple[DataFrame, dict]:
    """``points`` with ``cw`` and a report: people over their mean, times layer weights over their mean, at least ``floor``.

    With neither, or people that sum to 0 or less, every point weighs 1 and no floor applies.
    """
    layer = layer_weight(F.col("source"), layer_weights)
    report = {"requested": people is not None, "applied": False} | ({"layers": True} if layer is not None else {})
    if people is not None:
        # the mean is one row that joins as a broadcast; whether it is positive shapes the plan
        mean = points.agg((F.sum(people) / F.count(F.lit(1))).alias("m")).first()["m"]
        report["applied"] = bool(mean and mean > 0)
    out = points.withColumn("cw", F.col(people) / F.lit(mean) if report["applied"] else F.lit(1.0))
    if layer is not None:
        out = out.withColumn("cw", F.col("cw") * layer)
        out = out.crossJoin(F.broadcast(out.agg(F.avg("cw").alias("_mean")))).withColumn("cw", F.col("cw") / F.col("_mean")).drop("_mean")
    if report["applied"] or layer is not None:
        out = out.withColumn("cw", F.greatest("cw", F.lit(float(floor))))
    return out, report


def resolve_floors(requested: bool, algorithm: str, weight_rows: list[Weight]) -> tuple[dict, list[Weight]]:
    """Which floors hold: those with a finite min_pop, under DBSCAN; the others are named as skipped."""
    report = {"requested": requested, "applied": False, "skipped": []}
    if not requested:
        return report, []
    good = [w for w in weight_rows if algorithm != "hdbscan" and w.min_pop is not None and abs(w.min_pop) < float("inf")]
    report["skipped"] = [w.raster.name for w in weight_rows if w not in good]
    report["applied"] = bool(good)
    return report, good


def summarise(labelled: DataFrame, totals: list[str] | None = None, rank_by: str | None = None) -> DataFrame:
    """(id, size, member_ids, totals, centroid, list_ord) of labels from 1.

    ``list_ord`` orders clusters by their first member, or by the total ``rank_by`` from the
    highest (a missing one counts as 0) and then the first member.
    """
    totals = totals or []
    sums = F.create_map(*(x for t in totals for x in (F.lit(t), F.coalesce(F.sum(t), F.lit(0.0)).cast("double")))) if totals else F.create_map().cast("map<string,double>")
    g = labelled.where(F.col("label") >= 1).groupBy(F.col("label").alias("id")).agg(
        F.count(F.lit(1)).alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda s: s["id"]).alias("member_ids"),
        sums.alias("totals"), F.struct(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).alias("centroid"), F.min("idx").alias("first_idx"),
    )
    from geostrata.operators.ranking import numbered

    rank = [F.coalesce(F.try_element_at("totals", F.lit(rank_by)), F.lit(0.0)).desc()] if rank_by else []
    return numbered(g, [*rank, "first_idx"], "list_ord").drop("first_idx")


def cluster_points(points: DataFrame, algorithm: str = "dbscan", eps_km: float = 5.0, min_pts: float = 4, filters: list[Filter] | None = None, weight_rows: list[Weight] | None = None, weighted: bool = False, cluster_weight: Raster | None = None, cluster_weight_allocation: str = "allocate", weight_floor: float = 0.1, layer_weights: dict[str, float] | None = None, min_cluster_size: float | None = None, min_samples: float | None = None, max_link_km: float | None = None, rank_by: str | None = None) -> Pass1:
    """Cluster ``points`` (idx, id, lon, lat, source).

    Filtered points get label -2 and take no part. Everything is validated at once, also where no
    point is left: an algorithm of that name, a positive distance, a number of points above 0.
    """
    if algorithm not in ("dbscan", "hdbscan"):
        raise ValueError(f"algorithm {algorithm!r} is not 'dbscan' or 'hdbscan'")
    if algorithm == "dbscan" and not (eps_km > 0 and min_pts > 0):
        raise ValueError("eps_km and min_pts must be above 0")
    if weight_floor is None:
        weight_floor = 0.1
    mcs = min_cluster_size or 5
    ms, link_m = min_samples or mcs, (max_link_km or 10) * 1000
    weight_rows = weight_rows or []

    marked = apply_filters(points, filters or [])
    kept = marked.where("keep").drop("keep", "outside")
    frame = checkpoint(frame_of(kept))
    base = checkpoint(project(kept, frame))
    for w in weight_rows:
        base = weights(w.raster, base, w.allocation, frame, w.raster.name)
    people = None
    if cluster_weight is not None:
        people = "_people"
        base = weights(cluster_weight, base, cluster_weight_allocation, frame, people)
    base, weighting = cluster_weights(base, people, layer_weights, weight_floor)
    base = checkpoint(base)
    totals = [w.raster.name for w in weight_rows]
    if weighting["applied"] and cluster_weight.name not in totals:
        base = base.withColumn(cluster_weight.name, F.col(people))
        totals.append(cluster_weight.name)
    floors, enforced = resolve_floors(weighted, algorithm, weight_rows)
    weigh = "cw" if weighting["applied"] or weighting.get("layers") else None
    if algorithm == "dbscan":
        labels = dbscan(base, eps_km * 1000, min_pts, weight=weigh, floors={w.raster.name: w.min_pop for w in enforced})
    else:
        labels = hdbscan(base, mcs, ms, link_m, weigh)
    labels = checkpoint(labels.select("idx", "label"))
    clusters = summarise(base.join(labels, "idx"), totals, rank_by)
    every = labels.unionByName(marked.where("not keep").select("idx", F.lit(FILTERED).alias("label")))
    return Pass1(base, every, clusters, outside_counts(marked) if filters else None, weighting, floors)


def noise_ids(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(idx, id) of points in no cluster."""
    return points.join(labels.where(F.col("label") == NOISE), "idx").select("idx", "id")
