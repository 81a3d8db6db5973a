"""Outputs, reports and entry points; the queries without SQL against brute force."""

import json
import os
import random
from itertools import combinations
from math import hypot

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_clustering import table
from test_density import brute_hdbscan, brute_regions

from geostrata import queries
from geostrata.functions.render import absolute_legend
from geostrata.operators import admin, breaks, hull, pass1, pass2, suggest
from geostrata.plans import output, params, report
from geostrata.sinks import writers
from geostrata.sources.raster import Filter, Raster, weights
from geostrata.streaming import session_log

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def plain(spark):
    return {r.idx: r for r in queries.points(spark, DATA).collect()}


def test_hdbscan_query(spark):
    p = plain(spark)
    ids = sorted(p)
    got = {r.idx: r.label for r in queries.q_hdbscan_labels(spark, DATA).collect()}
    assert [got[i] for i in ids] == brute_hdbscan([(p[i].x_m, p[i].y_m) for i in ids], 10, 4, queries.EPS)


def bands_of(values, most=5):
    """(k, edges) by trying all cuts between distinct values."""
    a = sorted(values)
    u = sorted(set(a))
    if u[-1] == u[0]:
        return 1, []
    for k in range(min(most, len(u)), 1, -1):
        if len(a) < 5 * k:
            continue
        cost = lambda cut: sum(np.var([v for v in a if lo < v <= hi]) * sum(lo < v <= hi for v in a) for lo, hi in zip([-1e9, *cut], [*cut, 1e9], strict=True))
        cut = min(combinations(u[:-1], k - 1), key=lambda c: (round(cost(c), 9), c))
        if all(sum(lo < v <= hi for v in a) >= 5 for lo, hi in zip([-1e9, *cut], [*cut, 1e9], strict=True)):
            return k, list(cut)
    return 1, []


def test_bands_and_hdbscan_split(spark):
    """Bands of each cluster, each split by density at four times the cluster's distance."""
    r = random.Random(4)
    xy = [(r.gauss(0, 300), r.gauss(0, 300)) for _ in range(26)] + [(r.gauss(9000, 50), r.gauss(0, 50)) for _ in range(12)]
    v = [float(r.choice([1, 2, 3, 20, 21, 22])) for _ in range(26)] + [5.0] * 12
    pts = table(spark, xy, label=[1] * 26 + [2] * 12, ability=v, population=[1.0] * 38)
    got = pass2.subcluster(pts, pass2.Options(respatialise="hdbscan"))
    k, edges = bands_of(v[:26])
    d = sorted(sorted(hypot(a[0] - b[0], a[1] - b[1]) for b in xy[:26])[4] for a in xy[:26])
    link = 4 * float(np.quantile(d, 0.5))
    want = {}
    for band in range(k):
        own = [i for i in range(26) if sum(v[i] > e for e in edges) == band]
        labels = brute_hdbscan([xy[i] for i in own], 4, 4, link)
        order = {x: n for n, x in enumerate(sorted({x for x in labels if x >= 1}), 1)}
        for i, x in zip(own, labels, strict=True):
            want[i] = f"1-b{band}-" + (f"s{order[x]}" if x >= 1 else "scattered")
    want |= {i: "2-b0-s1" for i in range(26, 38)}
    assert {m.idx: m.group_id for m in got.members.collect()} == want
    eps = {c.parent: c.eps2_km for c in got.clusters.collect()}
    assert eps[1] == pytest.approx(link / 4000) and eps[2] is None


def test_regions_query(spark):
    p = plain(spark)
    lab = {r.idx: r.label for r in queries.q_dbscan_labels(spark, DATA).collect()}
    want = {}
    for c in sorted({x for x in lab.values() if x >= 1}):
        own = sorted(i for i in lab if lab[i] == c and p[i].ability is not None)
        if not own:
            continue
        flat = len({p[i].ability for i in own}) == 1
        found = [1] * len(own) if flat else brute_regions([(p[i].x_m, p[i].y_m) for i in own], [p[i].ability for i in own], 4, 8)
        for i, r in zip(own, found, strict=True):
            want.setdefault(f"{c}-r{r}", []).append(i)
    got = {r.group_id: r for r in queries.q_skater_regions(spark, DATA).collect()}
    assert set(got) == set(want)
    for g, own in want.items():
        both = [(p[i].population, p[i].ability) for i in own if p[i].population is not None]
        w = sum(a for a, _ in both)
        mean = sum(a * b for a, b in both) / w if w > 0 else None
        assert (got[g].point_count, got[g].range_min, got[g].missing_pop) == (len(own), min(p[i].ability for i in own), len(own) - len(both))
        assert got[g].population == pytest.approx(w, abs=0.01) and (mean is None and got[g].mean_ability is None or got[g].mean_ability == pytest.approx(mean, abs=1e-6))


def plain_ring(xy, longest):
    """The outline by the definition: empty circles, then border edges cut in, longest first."""
    n = len(xy)

    def turn(a, b, c):
        return (xy[b][0] - xy[a][0]) * (xy[c][1] - xy[a][1]) - (xy[b][1] - xy[a][1]) * (xy[c][0] - xy[a][0])

    def inside(a, b, c, d):
        m = [[xy[p][0] - xy[d][0], xy[p][1] - xy[d][1], (xy[p][0] - xy[d][0]) ** 2 + (xy[p][1] - xy[d][1]) ** 2] for p in (a, b, c)]
        return np.linalg.det(np.array(m)) > 0

    tri = []
    for t in combinations(range(n), 3):
        a, b, c = t if turn(*t) > 0 else (t[0], t[2], t[1])
        if turn(a, b, c) > 0 and not any(inside(a, b, c, d) for d in range(n) if d not in t):
            tri.append((a, b, c))
    third = {e: c for a, b, c in tri for e, c in (((a, b), c), ((b, c), a), ((c, a), b))}
    border = {e for e in third if e[::-1] not in third}
    size = lambda e: hypot(xy[e[0]][0] - xy[e[1]][0], xy[e[0]][1] - xy[e[1]][1])
    while True:
        on = {v for e in border for v in e}
        e = max((e for e in border if size(e) > longest and third[e] not in on), key=size, default=None)
        if e is None:
            break
        border = (border - {e}) | {(e[0], third[e]), (third[e], e[1])}
    after, ring = dict(border), [min(border, key=lambda e: xy[e[0]])[0]]
    while after[ring[-1]] != ring[0]:
        ring.append(after[ring[-1]])
    return ring


@pytest.mark.parametrize("seed", range(8))
def test_outline(seed):
    r = random.Random(seed)
    xy = [(r.uniform(0, 1000), r.uniform(0, 1000)) for _ in range(24)]
    x, y = np.array([p[0] for p in xy]), np.array([p[1] for p in xy])
    for longest in (150.0, 300.0, 1e9):
        assert hull.concave_ring(x, y, longest) == plain_ring(xy, longest)


def test_boundaries_query(spark):
    p, lab = queries.labels(spark, DATA)
    found = output.boundaries(lab, pass1.summarise(p.join(lab, "idx")), p, 2.0).collect()
    own = plain(spark)
    lon0, lat0 = (sum(getattr(r, c) for r in own.values()) / len(own) for c in ("lon", "lat"))
    members = {}
    for r in lab.where("label >= 1").collect():
        members.setdefault(f"cluster-{r.label}", []).append(r.idx)
    assert {b.id: b.point_count for b in found} == {c: len(m) for c, m in members.items()}
    k, deg = 6371000.0, np.pi / 180
    for b in found:
        place = {(own[i].lon, own[i].lat) for i in members[b.id]}
        if b.ring is None:
            continue
        ring = [tuple(c) for c in b.ring]
        assert ring[0] == ring[-1] and set(ring) <= place and len(set(ring)) == len(ring) - 1
        at = [((lo - lon0) * deg * k * np.cos(lat0 * deg), (la - lat0) * deg * k) for lo, la in ring]
        area = sum(a[0] * c[1] - c[0] * a[1] for a, c in zip(at, at[1:], strict=False)) / 2
        assert area > 0
    assert output.boundary_meta(output.boundaries(lab, pass1.summarise(p.join(lab, "idx")), p, 2.0), 0).first().without_polygon == sum(b.ring is None for b in found)


def test_bands_agree():
    rng = np.random.default_rng(9)
    for _ in range(40):
        v = rng.integers(0, 9, rng.integers(1, 40)).astype(float)
        k, edges, method, _ = breaks.choose_bands(v)
        assert (k, edges) == bands_of(v.tolist()) and method == ("fisher-jenks" if k > 1 else "single-unit")
        assert breaks.choose_bands(v, breaks.Banding(size_threshold=0))[:2] == (k, edges)
        u, n = np.unique(v, return_counts=True)
        assert breaks.choose_bands(u[::-1], times=n[::-1])[:2] == (k, edges)


def run(spark):
    xy = [(0, 0), (100, 0), (0, 100), (100, 100), (50, 50), (60, 40), (90000, 0)]
    pts = table(spark, xy, label=[1, 1, 1, 1, 1, 1, -1], ability=[1.0, None, 2.0, 3.0, 4.0, 5.0, 6.0], population=[10.0, 5.0, None, 2.5, 1.0, 1.0, 4.0]).withColumn("lon", F.col("x_m") / 1000).withColumn("lat", F.col("y_m") / 1000).withColumn("source", F.when(F.col("idx") % 2 == 0, "Health Posts").otherwise("schools"))
    return pts, pass2.subcluster(pts)


def test_collection_and_provenance(spark, tmp_path):
    pts, r = run(spark)
    f = output.features(r, pts)
    meta = output.provenance(r, {"algorithm": "dbscan"}, {"abilityToPay": "wealth"}, "2026-01-01T00:00:00Z", "9", 7, 1.25)
    whole = json.loads(writers.collection(writers.multipoint_features(f), meta).first().geojson)
    assert whole["type"] == "FeatureCollection" and [x["properties"]["kind"] for x in whole["features"]] == ["subarea", "unknown", "last_mile"]
    one = whole["features"][0]
    assert one["id"] == "1-b0-s1" and one["geometry"] == {"type": "MultiPoint", "coordinates": [[0.0, 0.0], [0.0, 0.1], [0.1, 0.1], [0.05, 0.05], [0.06, 0.04]]}
    assert one["bbox"] == [0.0, 0.0, 0.1, 0.1] and one["properties"]["population"] == 15 and one["properties"]["missing_population_count"] == 1
    assert one["properties"]["mean_ability_to_pay"] == pytest.approx((10 + 7.5 + 4 + 5) / 14.5) and one["properties"]["has_unknown"] and one["properties"]["band_value_range"] == [1.0, 5.0]
    unknown, last = whole["features"][1:]
    assert unknown["id"] == "1-unknown" and unknown["properties"]["band"] is None and unknown["properties"]["mean_ability_to_pay"] is None and last["properties"]["parent_cluster_id"] is None
    m = whole["meta"]
    assert m["tool"] == {"version": "9", "generatedAt": "2026-01-01T00:00:00Z"} and m["pointCount"] == 7 and m["crs"] == "EPSG:4326" and m["layers"] == {"abilityToPay": "wealth", "population": None, "admin": None}
    assert "1.25 km" in m["caveats"]["note"] and m["params"]["pass2"]["eps2Rule"] == "q0.5-min2-nn" and m["banding"]["perCluster"] == [{"parentClusterId": 1, "bandCount": 1, "method": "single-unit", "flag": "insufficient-points"}]
    writers.write_geojson(writers.multipoint_features(f), f"{tmp_path}/a")
    writers.write_lines(writers.multipoint_features(f), f"{tmp_path}/b")
    assert len(json.loads("".join(x.value for x in spark.read.text(f"{tmp_path}/a").collect()))["features"]) == 3 and spark.read.text(f"{tmp_path}/b").count() == 3
    rings = spark.createDataFrame([("cluster-1", "cluster_boundary", 1, [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]), ("cluster-2", "cluster_boundary", 2, None)], "id string, kind string, parent_cluster_id int, ring array<array<double>>")
    poly = json.loads(writers.collection(writers.polygon_features(rings)).first().geojson)["features"]
    assert [p["id"] for p in poly] == ["cluster-1"] and poly[0]["geometry"]["coordinates"] == [[[0, 0], [1, 0], [0, 1], [0, 0]]]
    writers.write_csv(spark.createDataFrame([(1, 'a"b,c')], "n int, t string").coalesce(1), f"{tmp_path}/c")
    files = [x for x in os.listdir(f"{tmp_path}/c") if x.endswith(".csv")]
    assert open(f"{tmp_path}/c/{files[0]}", newline="").read() == 'n,t\r\n1,"a""b,c"\r\n'


def test_classes_and_composition(spark):
    pts, r = run(spark)
    assert [tuple(x) for x in output.select_class(r, "range", lo=1, hi=3).collect()] == [("1-b0-s1", "value 1 to 3", True)]
    assert output.select_class(r, "band", which="highest").count() == 0 and output.select_class(r, "fifth", fifth=5).count() == 0 and output.select_class(r, "fifth", fifth=1).count() == 1
    for bad in ({"kind": "range", "lo": 3, "hi": 1}, {"kind": "band", "which": "x"}, {"kind": "fifth", "fifth": 6}, {"kind": "x"}):
        with pytest.raises(ValueError):
            output.select_class(r, **bad)
    picked = output.filter_by_class(output.features(r, pts), output.select_class(r, "fifth", fifth=1))
    assert [(x.subarea_id, x.export_class) for x in picked.collect()] == [("1-b0-s1", "lowest fifth across the map")]
    members = pts.select("idx", F.lit(1).alias("g"))
    got = output.composition(members, pts, ["schools", "Health Posts", "health-posts"], ["g"]).first()
    assert (got.n_schools, got.n_health_posts) == (3, 0)  # of one column name the last layer counts
    assert output.composition_text(members, pts, ["g"]).first().composition == "Health Posts 4, schools 3"
    assert [tuple(x) for x in absolute_legend(r.subareas.withColumn("mean_ability", F.lit(2.0)), 1).select("value", "colour").collect()] == [(2.0, "#eaf1f5")] * 2


def test_reports(spark):
    _, r = run(spark)
    p = params.standard_values()
    assert p["eps_km"] == 5 and {x.key for x in params.PARAMETERS} <= set(params.HELP) and params.parameter_table(spark).count() == len(params.PARAMETERS)
    assert params.ENGINE_HDBSCAN == {"min_cluster_size": 5, "max_link_km": 10.0}
    guard = {"eps_km": 3.2, "guard": {"knee_km": 4.0, "steps": 1, "largest_share": 0.4, "noise_share": 0.1, "stopped_by": "ok"}}
    clusters = spark.createDataFrame([(1, 1, "North", 6, "schools 6", "area")], "ord int, id int, name string, size long, composition string, name_source string")
    summary = spark.createDataFrame([(0, "points", 7)], "ord int, label string, value long")
    rows = report.run_report(spark, "t", "9", p, {"eps_km": "suggested"}, [("points", 7, "")], summary, clusters, r.clusters, guard, {"a": 2.0, "b": 1}, [("pop", "allocate", 100)], [("wealth", ">=", 1)], "pop", "none").orderBy("sec", "ord").collect()
    by = {(x.section, x.item): x for x in rows}
    assert [s for i, s in enumerate(x.section for x in rows) if not i or rows[i - 1].section != s] == report.SECTIONS
    assert by["parameter", "grouping distance (eps)"].source == "suggested" and ("parameter", "min_samples") not in by and ("parameter", "target regions") not in by
    assert by["parameter", "layer weight: a"].source == "user" and by["parameter", "layer weight: b"].source == "standard" and by["parameter", "filter 1"].value == "wealth >= 1"
    assert by["cluster", "cluster 1"].value == "North" and by["banding", "North (cluster 1)"].value == "single-unit, 1 band(s), insufficient-points" and by["parameter", "enforce min_pop floors"].value == "false"
    short = report.run_report(spark, "t", "9", p | {"algorithm": "hdbscan"}, {}).collect()
    assert {x.item for x in short if x.section == "caveat"} == {"last-mile"} and "min_samples" in {x.item for x in short}
    log = report.log_entries(spark, [{"time": "t", "event": "set", "from": 1, "to": 2}, {"event": "run"}]).collect()
    assert [(x.time, x.event, x["from"], x["to"], x.note) for x in log] == [("t", "set", "1", "2", ""), ("", "run", "", "", "")]
    facts = {"points": 7, "clusters": 1, "n": 1, "share": 1 / 7, "median_km": 12.34, "p90_km": 12.34, "near_miss_share": 0.5}
    told = report.explain(p | {"eps_km": 3.2}, {"eps_km": "suggested"}, facts, guard, {"subareas": 1, "unknown": 1, "whole": {"insufficient-points": 1}})
    text = report.explanation_text(told, "t", "9")
    assert "3.20 km" in text and "4.00 km" in text and "12.3 km" in text and "too few places with a value" in text and "(14 %)" in text
    other = report.explain(p | {"algorithm": "hdbscan", "cluster_weight": "pop"}, {"max_link_km": "user"}, facts | {"median_km": None})
    assert "set by hand" in str(other) and "people" in str(other) and "not split" in str(other)


def test_suggested_parameters(spark):
    r = random.Random(2)
    xy = [(r.gauss(0, 400), r.gauss(0, 400)) for _ in range(60)] + [(r.uniform(-20000, 20000), r.uniform(-20000, 20000)) for _ in range(40)]
    pts = spark.createDataFrame([(i, x / 111194.93, y / 111194.93) for i, (x, y) in enumerate(xy)], "idx long, lon double, lat double")
    s = suggest.suggest_parameters(pts, 4)
    g = s["guard"]
    assert s["eps_km"] == pytest.approx(g["knee_km"] * 0.8 ** g["steps"]) and s["max_link_km"] == s["eps_km"] and g["stopped_by"] in ("ok", "noise-cap", "step-limit")
    assert suggest.suggest_eps(pts, 4) == pytest.approx(g["knee_km"])
    now = suggest.shares(__import__("geostrata.functions.geo", fromlist=["project"]).project(pts), s["eps_km"], 4)
    assert now["largest"] == pytest.approx(g["largest_share"]) and (g["stopped_by"] != "ok" or now["largest"] <= 0.5)
    assert suggest.suggest_parameters(pts.limit(4), 4) is None and suggest.suggest_eps(pts.limit(4), 4) is None


def grid(spark, people, density=False):
    cells = spark.createDataFrame([(r, c, float(people(r, c))) for r in range(4) for c in range(4)], "row int, col int, value double")
    return Raster("pop", cells, 4, 4, 0.0, 0.04, 0.01, -0.01, nodata=-1.0, is_density=density)


def test_pass1(spark):
    """Filters, weights by allocation, floors and ranks against plain counting."""
    at = [(0.001, 0.039), (0.002, 0.038), (0.003, 0.039), (0.031, 0.001), (0.032, 0.002), (0.033, 0.003), (0.02, 0.02), (0.5, 0.5)]
    pts = spark.createDataFrame([(i, f"a:{i}", x, y, "a") for i, (x, y) in enumerate(at)], "idx long, id string, lon double, lat double, source string")
    pop = grid(spark, lambda r, c: 10 * r + c)
    r = pass1.cluster_points(pts, eps_km=0.5, min_pts=3, filters=[Filter(pop, ">=", 0.0)], weight_rows=[pass1.Weight(pop, "allocate")], rank_by="pop")
    label = {x.idx: x.label for x in r.labels.collect()}
    assert label == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: -1, 7: -1} and [(x.raster, x.n) for x in r.outside.collect()] == [("pop", 1)]
    lon0, lat0 = (sum(p[k] for p in at) / len(at) for k in (0, 1))
    to = {}
    for row in range(4):
        for col in range(4):
            if 10 * row + col > 0:
                x, y = (col + 0.5) * 0.01, 0.04 - (row + 0.5) * 0.01
                near = min(range(8), key=lambda i: (((at[i][0] - x) * np.cos(np.radians(lat0))) ** 2 + (at[i][1] - y) ** 2, i))
                to[near] = to.get(near, 0) + 10 * row + col
    own = {x.idx: x["pop"] for x in r.points.collect()}
    assert own == {i: to.get(i, 0.0) for i in range(8)} and lon0 > 0
    clusters = {x.id: x for x in r.clusters.collect()}
    assert clusters[2].totals["pop"] == sum(to.get(i, 0) for i in (3, 4, 5)) and [c for c, x in sorted(clusters.items(), key=lambda t: t[1].list_ord)] == sorted(clusters, key=lambda c: -clusters[c].totals["pop"])
    assert clusters[1].member_ids == ["a:0", "a:1", "a:2"] and [x.id for x in pass1.noise_ids(r.points, r.labels).orderBy("idx").collect()] == ["a:6", "a:7"]
    assert {x.idx: x.w for x in weights(pop, pts.where("idx <> 6"), "sample", None, "w").collect()} == {0: 0, 1: 0, 2: 0, 3: 33, 4: 33, 5: 33, 7: 0}
    cut = pass1.cluster_points(pts, eps_km=0.5, min_pts=3, filters=[Filter(pop, ">=", 20.0)])
    assert {x.idx: x.label for x in cut.labels.collect()}[0] == -2 and cut.clusters.count() == 1
    tree = pass1.cluster_points(pts, "hdbscan", min_cluster_size=3, min_samples=2, max_link_km=1.0)
    assert {x.idx for x in tree.labels.where("label >= 1").collect()} == {0, 1, 2, 3, 4, 5}
    floors = pass1.cluster_points(pts, eps_km=0.5, min_pts=3, weighted=True, weight_rows=[pass1.Weight(pop, "allocate", 1e9)])
    assert floors.floors["applied"] and floors.clusters.count() == 0
    for bad in ({"algorithm": "x"}, {"eps_km": 0}, {"min_pts": 0}):
        with pytest.raises(ValueError):
            pass1.cluster_points(pts.limit(0), **bad)


def test_planted_pocket(spark):
    """A poor pocket inside a city of middling values comes out as one sub-area, within 2 km of where it was planted."""
    r = random.Random(1)
    rows = [(r.gauss(0, 6000), r.gauss(0, 6000), r.gauss(60, 6)) for _ in range(900)] + [(r.gauss(7000, 700), r.gauss(-4000, 700), r.gauss(15, 3)) for _ in range(120)]
    pts = table(spark, [(x, y) for x, y, _ in rows], label=[1] * len(rows), ability=[v for *_, v in rows], population=[1.0] * len(rows))
    got = pass2.subcluster(pts)
    low = got.subareas.where("band = 0 and not scattered").orderBy(F.desc("point_count")).first()
    at = got.members.where(F.col("group_id") == low.group_id).join(pts, "idx").agg(F.avg("x_m"), F.avg("y_m")).first()
    assert hypot(at[0] - 7000, at[1] + 4000) < 2000 and low.mean_ability < 30


def test_split_runs_pass2_of_pieces(spark):
    sq = lambda x: [[[{"x": float(a), "y": float(b)} for a, b in ((x, -1), (x + 1, -1), (x + 1, 1), (x, 1))]]]
    units = spark.createDataFrame([(0, "A", "North", sq(0), 0.0, -1.0, 1.0, 1.0)], "unit_idx int, id string, name string, polygons array<array<array<struct<x:double,y:double>>>>, minx double, miny double, maxx double, maxy double")
    xy = [(i * 100, 0) for i in range(12)] + [(-100 - i * 100, 0) for i in range(6)]
    pts = table(spark, xy, label=[1] * 18, ability=[1.0] * 6 + [9.0] * 6 + [2.0] * 6, population=[1.0] * 18).withColumn("lon", (F.col("x_m") + 50) / 10000).withColumn("lat", F.lit(0.0))
    located = admin.locate(pts, units)
    pieces, again = admin.split_cluster(pass2.subcluster(pts), 1, pts, located, units)
    assert sorted((p.piece_key, p.name, p.n) for p in pieces.collect()) == [("1@A", "North", 12), ("1@outside", None, 6)]
    assert sorted((s.piece_key, s.group_id, s.point_count) for s in again.subareas.collect()) == [("1@A", "1-b0-s1", 6), ("1@A", "1-b1-s1", 6), ("1@outside", "1-b0-s1", 6)]
    with pytest.raises(ValueError):
        admin.split_cluster(pass2.subcluster(pts), 5, pts, located, units)


def test_session_log_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.limit(50).write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    for _ in range(2):  # the second run finds nothing new
        session_log.append_log(session_log.read_log(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
