"""Suggested parameters: the knee of the k-distance curve and a guard against one dominant cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions.geo import project
from geostrata.operators.dbscan import NOISE, dbscan
from geostrata.operators.ranking import numbered
from geostrata.operators.spatial import kth_distance
from geostrata.runtime import checkpoint

# Fixed values of the guard: largest share allowed, factor of a step, noise allowed, most steps.
DOMINANCE_SHARE, STEP_FACTOR, NOISE_CAP, MAX_STEPS = 0.5, 0.8, 0.25, 10


def knee(kdist: DataFrame) -> DataFrame:
    """(eps_km, n): the sorted ``kdist`` farthest from the chord between its ends; the first of equals."""
    ranked = numbered(kdist.select("idx", "kdist"), ["kdist", "idx"], "rn")
    ends = ranked.agg(F.count(F.lit(1)).alias("n"), F.min("kdist").alias("lo"), F.max("kdist").alias("hi"))  # one row
    each = ranked.crossJoin(F.broadcast(ends))
    gap = F.abs((F.col("hi") - F.col("lo")) * (F.col("rn") - 1) - (F.col("n") - 1) * (F.col("kdist") - F.col("lo")))
    return each.groupBy("n").agg((F.max_by("kdist", F.struct(gap, -F.col("rn"))) / 1000).alias("eps_km")).select("eps_km", "n")


def suggest_eps(points: DataFrame, min_pts: int) -> float | None:
    """The knee in km for points with lon and lat; None for ``min_pts`` points or fewer."""
    row = knee(kth_distance(project(points), min_pts)).first()
    return None if row is None or row["n"] <= min_pts else row["eps_km"]


def shares(points: DataFrame, eps_km: float, min_pts: float) -> dict[str, float]:
    """The largest cluster's and the noise's share of projected points."""
    labels = dbscan(points, eps_km * 1000, min_pts)
    by = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    r = by.agg(F.sum("n").alias("all"), F.max(F.when(F.col("label") >= 1, F.col("n"))).alias("most"), F.sum(F.when(F.col("label") == NOISE, F.col("n"))).alias("noise")).first()
    return {"largest": (r["most"] or 0) / r["all"], "noise": (r["noise"] or 0) / r["all"]}


def suggest_parameters(points: DataFrame, min_pts: int) -> dict | None:
    """eps_km, max_link_km and the guard's report: the knee, made smaller in steps while one cluster dominates."""
    placed = checkpoint(project(points))
    row = knee(kth_distance(placed, min_pts)).first()
    if row is None or row["n"] <= min_pts:
        return None
    first = eps = row["eps_km"]
    now, steps, why = shares(placed, eps, min_pts), 0, "ok"
    while now["largest"] > DOMINANCE_SHARE:
        if steps == MAX_STEPS:
            why = "step-limit"
            break
        after = shares(placed, eps * STEP_FACTOR, min_pts)
        if after["noise"] > NOISE_CAP:
            why = "noise-cap"
            break
        eps, now, steps = eps * STEP_FACTOR, after, steps + 1
    return {"eps_km": eps, "max_link_km": eps, "guard": {"knee_km": first, "steps": steps, "largest_share": now["largest"], "noise_share": now["noise"], "stopped_by": why}}
