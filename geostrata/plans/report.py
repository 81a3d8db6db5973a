"""Run report, session log and plain-language explanation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.plans.output import CRS, DISTANCE_METHOD
from geostrata.plans.params import PARAMETERS

REPORT_COLUMNS = ["section", "item", "value", "unit", "source"]
LOG_COLUMNS = ["time", "event", "item", "from", "to", "note"]
SECTIONS = ["run", "input", "parameter", "suggestion", "result", "cluster", "banding", "caveat"]

_SCHEMA = "sec int, ord int, section string, item string, value string, unit string, source string"


def _text(v: object) -> str | None:
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def run_report(spark: SparkSession, timestamp: str, version: str, params: dict, sources: dict, inputs: list[tuple] = (), summary: DataFrame | None = None, clusters: DataFrame | None = None, pass2: DataFrame | None = None, suggestion: dict | None = None, layer_weights: dict | None = None, weight_rows: list[tuple] = (), filters: list[tuple] = (), rank_by: str | None = None, caveat: str = "") -> DataFrame:
    """Tidy rows (sec, ord, section, item, value, unit, source) in a fixed order of sections.

    Parameters of the other algorithm or method are left out, and those of pass 2 without a pass 2.
    ``clusters``: (ord, id, name, size, composition, name_source); ``pass2``: its clusters.
    """
    rows: list[tuple] = []

    def put(section: str, item: str, value: object = None, unit: str = "", source: str = "") -> None:
        rows.append((SECTIONS.index(section), len(rows), section, item, _text(value), unit, source))

    for item, value in (("timestamp", timestamp), ("tool version", version), ("CRS", CRS), ("clustering distance method", DISTANCE_METHOD)):
        put("run", item, value)
    for item, value, unit in inputs:
        put("input", item, value, unit)
    for p in PARAMETERS:
        if p.algorithm in (None, params.get("algorithm")) and (p.stage != "pass2" or pass2 is not None) and p.method in (None, params.get("pass2_method")):
            put("parameter", p.label, params.get(p.key), p.unit, sources.get(p.key, ""))
    for layer, w in (layer_weights or {}).items():
        put("parameter", f"layer weight: {layer}", w, "x, relative to other layers", "standard" if w == 1 else "user")
    for i, (raster, allocation, least) in enumerate(weight_rows, 1):
        put("parameter", f"population weight {i}", f"{raster}, {allocation}, min_pop {least}", "people (min_pop)", "user")
    for i, (raster, op, value) in enumerate(filters, 1):
        put("parameter", f"filter {i}", f"{raster} {op} {value}", "", "user")
    put("parameter", "rank clusters by", rank_by, "raster (empty = none)", "user" if rank_by else "standard")
    if suggestion:
        g = suggestion["guard"]
        for item, value, unit in (("k-distance knee", g["knee_km"], "km"), ("guard steps (x0.8 each)", g["steps"], ""), ("largest cluster share at suggested distance", g["largest_share"], "fraction of points"), ("guard stopped because", g["stopped_by"], "")):
            put("suggestion", item, value, unit)
    if pass2 is not None:
        put("caveat", "resolution ceiling", caveat)
        put("caveat", "bands", "A band belongs to its own cluster. Compare clusters by the value itself, not by band numbers.")
        put("caveat", "unknown", "Places without a value are shown as such; no value or band is made up for them.")
    put("caveat", "last-mile", "Places in no cluster stay in the result as the last-mile layer.")
    parts = [spark.createDataFrame(rows, _SCHEMA)]
    blank = F.lit("")
    if summary is not None:
        parts.append(summary.select(F.lit(4).alias("sec"), "ord", F.lit("result").alias("section"), F.col("label").alias("item"), F.col("value").cast("string").alias("value"), blank.alias("unit"), blank.alias("source")))
    if clusters is not None:
        parts.append(clusters.select(F.lit(5).alias("sec"), F.col("ord").cast("int").alias("ord"), F.lit("cluster").alias("section"), F.concat(F.lit("cluster "), F.col("id").cast("string")).alias("item"), F.col("name").alias("value"), F.concat(F.col("size").cast("string"), F.lit(" places: "), "composition").alias("unit"), F.col("name_source").alias("source")))
    if pass2 is not None:
        text = F.concat("method", F.lit(", "), F.col("k").cast("string"), F.lit(" band(s)"), F.coalesce(F.concat(F.lit(", "), "flag"), blank))
        named = F.concat(F.lit("cluster "), F.col("parent").cast("string"))
        own = pass2
        if clusters is not None:
            own = pass2.join(clusters.select(F.col("id").alias("parent"), "name"), "parent", "left")
            named = F.when(F.col("name").isNotNull(), F.concat("name", F.lit(" (cluster "), F.col("parent").cast("string"), F.lit(")"))).otherwise(named)
        parts.append(own.select(F.lit(6).alias("sec"), F.col("parent").cast("int").alias("ord"), F.lit("banding").alias("section"), named.alias("item"), text.alias("value"), blank.alias("unit"), blank.alias("source")))
    return reduce(DataFrame.unionByName, parts)


def log_entries(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The session log (ord, time, event, item, from, to, note); fields left out are empty."""
    return spark.createDataFrame([(i, *(str(e.get(c, "")) for c in LOG_COLUMNS)) for i, e in enumerate(entries)], "ord int, time string, event string, item string, `from` string, `to` string, note string")


def _km(x: float) -> str:
    return f"{x:.2f} km" if x < 10 else f"{x:.1f} km"


def explain(params: dict, sources: dict, facts: dict, suggestion: dict | None = None, pass2_facts: dict | None = None) -> list[dict]:
    """Three sections (title, paragraphs) that say in plain words how a result came about.

    ``facts``: one row of ``last_mile_facts`` with points and clusters; ``pass2_facts``: clusters,
    sub-areas, unknown and how many clusters stayed whole, by reason.
    """
    flat = params["algorithm"] == "dbscan"
    key = "eps_km" if flat else "max_link_km"
    dist = _km(params[key])
    how = f"DBSCAN was used: a place with {params['min_pts']} places within {dist}, itself counted, starts a cluster, and all places that close to it belong to it." if flat else f"HDBSCAN was used: groups may differ in density, hold {params['min_cluster_size']} places at least, and link over {dist} at most."
    if sources.get(key) == "user":
        why = f"The distance of {dist} was set by hand."
    elif sources.get(key) == "suggested" and suggestion:
        g = suggestion["guard"]
        why = f"The distance of {dist} follows the usual spacing of the places" + (f", made smaller in {g['steps']} step(s) from {_km(g['knee_km'])} so that no cluster takes in more than half of them." if g["steps"] else ".")
        why += {"ok": "", "noise-cap": " It was not made smaller still, since too many places would have been left over.", "step-limit": " One cluster still holds more than half after all steps."}[g["stopped_by"]]
    else:
        why = f"The distance of {dist} is the standard one."
    one = [how, why] + (["Places count by the people around them."] if params.get("cluster_weight") else []) + [f"{facts['points']:,} places formed {facts['clusters']:,} clusters; {facts['n']:,} are in none."]
    if pass2_facts is None:
        two = ["Clusters were not split further."]
    else:
        reasons = {"insufficient-points": "too few places with a value", "homogeneous": "equal values", "unimodal": "smoothly spread values", "all-unknown": "no values"}
        two = [("Each cluster was cut into contiguous regions of similar values." if params["pass2_method"] == "regions" else "Each cluster's values were cut into natural classes, and each class into areas that hang together."), f"{pass2_facts['subareas']:,} sub-areas; {pass2_facts['unknown']:,} places have no value and stay apart."]
        two += [f"{n:,} cluster(s) stayed whole: {reasons[flag]}." for flag, n in sorted(pass2_facts.get("whole", {}).items()) if n]
    three = [f"{facts['n']:,} places ({facts['share'] * 100:.0f} %) are last-mile places: not enough others lie near them."]
    if facts.get("median_km") is not None:
        three.append(f"Half of them lie within {_km(facts['median_km'])} of a clustered place, nine in ten within {_km(facts['p90_km'])}; {facts['near_miss_share'] * 100:.0f} % lie within twice the distance.")
    return [{"title": "How the clusters formed", "paragraphs": one}, {"title": "How the sub-areas formed", "paragraphs": two}, {"title": "Last-mile places", "paragraphs": three}]


def explanation_text(sections: list[dict], timestamp: str, version: str) -> str:
    """The sections as plain text."""
    parts = [f"About this result\nRun {timestamp}, version {version}\n"]
    parts += [f"{s['title']}\n{'-' * len(s['title'])}\n" + "\n\n".join(s["paragraphs"]) + "\n" for s in sections]
    return "\n".join(parts)
