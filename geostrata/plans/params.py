"""The catalogue of parameters with their standard values, and notes on what they mean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Parameter:
    key: str
    label: str
    unit: str
    standard: object
    stage: str
    algorithm: str | None = None
    method: str | None = None


_POINTS = "points (population-weighted places when weighting is on)"

# Keys, labels, units and standards of a run's parameters.
PARAMETERS = [
    Parameter("algorithm", "pass-1 algorithm", "", "dbscan", "pass1"),
    Parameter("eps_km", "grouping distance (eps)", "km", 5, "pass1", algorithm="dbscan"),
    Parameter("min_pts", "min_pts", _POINTS, 4, "pass1", algorithm="dbscan"),
    Parameter("weighted", "enforce min_pop floors", "", False, "pass1", algorithm="dbscan"),
    Parameter("min_cluster_size", "min_cluster_size", _POINTS, 25, "pass1", algorithm="hdbscan"),
    Parameter("min_samples", "min_samples", _POINTS, 10, "pass1", algorithm="hdbscan"),
    Parameter("max_link_km", "linking distance (max_link)", "km", 8, "pass1", algorithm="hdbscan"),
    Parameter("cluster_weight", "reshape clusters by", "raster (empty = none)", None, "pass1"),
    Parameter("weight_floor", "min weight floor", "x mean weight", 0.1, "pass1"),
    Parameter("pass2_method", "pass-2 method", "", "bands", "pass2"),
    Parameter("pass2_region_count", "target regions", "regions", 4, "pass2", method="regions"),
    Parameter("pass2_bands", "bands (max)", "bands", 5, "pass2", method="bands"),
    Parameter("pass2_min2", "min points per sub-cluster (min2)", "points", 4, "pass2", method="bands"),
    Parameter("pass2_eps2_km", "eps2 override", "km (empty = auto per cluster)", None, "pass2", method="bands"),
    Parameter("pass2_eps2_pct", "eps2 percentile", "quantile 0-1", 0.5, "pass2", method="bands"),
    Parameter("pass2_respat", "respatialise with", "", "dbscan", "pass2", method="bands"),
    Parameter("pass2_modality", "modality guard", "", False, "pass2", method="bands"),
    Parameter("boundary_buffer_m", "boundary buffer", "m", 0, "output"),
]

# Engine defaults of the hierarchical algorithm differ from the standards above.
ENGINE_HDBSCAN = {"min_cluster_size": 5, "max_link_km": 10.0}

HELP = {
    "algorithm": "dbscan groups at one distance; hdbscan finds groups of different densities.",
    "eps_km": "Places within this distance of each other are neighbours.",
    "min_pts": "Neighbours, the place itself counted, that start a cluster.",
    "weighted": "Also ask that the people near a place reach each weight row's floor.",
    "min_cluster_size": "The least weight of a group that counts as a cluster.",
    "min_samples": "The weight of neighbours that sets how dense a place's surroundings are.",
    "max_link_km": "Places farther apart than this are never linked.",
    "cluster_weight": "A raster whose people make a place count for more or less.",
    "weight_floor": "No place counts for less than this share of the mean.",
    "pass2_method": "bands of values, or contiguous regions of similar values.",
    "pass2_region_count": "Regions to aim at in each cluster.",
    "pass2_bands": "The most bands of a cluster; fewer are used where a band would be too small.",
    "pass2_min2": "Neighbours that hold a sub-area together.",
    "pass2_eps2_km": "One distance for the sub-areas of all clusters instead of one derived for each.",
    "pass2_eps2_pct": "Which quantile of neighbour distances the derived distance takes.",
    "pass2_respat": "The algorithm that splits a band in space.",
    "pass2_modality": "Leave a cluster whole when its values are spread smoothly.",
    "boundary_buffer_m": "Metres around each place that an outline takes in.",
    "last_mile": "Places in no cluster. They stay in the result as a group of their own.",
    "unknown": "Places of a cluster without a value. They are shown and never estimated.",
    "band": "A class of values within one cluster; numbers don't compare across clusters.",
    "scattered": "Places of a band that hold no sub-area together.",
}


def standard_values() -> dict[str, object]:
    """Each parameter's standard."""
    return {p.key: p.standard for p in PARAMETERS}


def parameter_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a table, standards as text."""
    rows = [(i, p.key, p.label, p.unit, None if p.standard is None else str(p.standard), p.stage, p.algorithm, p.method) for i, p in enumerate(PARAMETERS)]
    return spark.createDataFrame(rows, "ord int, key string, label string, unit string, standard string, stage string, algorithm string, method string")
