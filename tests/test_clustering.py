import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.operators import admin, breaks, hull, pass1, pass2, regions, spatial
from geostrata.operators.components import connected_components
from geostrata.operators.dbscan import dbscan
from geostrata.operators.hdbscan import hdbscan


def table(spark, xy, **more):
    rows = [(i, float(x), float(y), *(v[i] for v in more.values())) for i, (x, y) in enumerate(xy)]
    kinds = "".join(f", {k} {'string' if k == 'source' else 'int' if k == 'label' else 'double'}" for k in more)
    return spark.createDataFrame(rows, "idx long, x_m double, y_m double" + kinds)


def scan(xy, eps, least, w=None):
    n, w = len(xy), w or [1] * len(xy)
    near = [[j for j in range(n) if (xy[i][0] - xy[j][0]) ** 2 + (xy[i][1] - xy[j][1]) ** 2 <= eps * eps] for i in range(n)]
    core = [sum(w[j] for j in near[i]) >= least for i in range(n)]
    label, c = [0] * n, 0
    for i in range(n):
        if label[i] > 0 or not core[i]:
            continue
        c += 1
        todo, label[i] = [i], c
        while todo:
            u = todo.pop()
            if core[u]:
                for v in near[u]:
                    if label[v] <= 0:
                        label[v] = c
                        todo.append(v)
    return [x or -1 for x in label]


@pytest.mark.parametrize("seed", [1, 2])
def test_dbscan(spark, seed):
    r = random.Random(seed)
    xy = [(r.randint(0, 40) * 50, r.randint(0, 40) * 50) for _ in range(150)]
    w = [r.choice([0.5, 1.0, 2.0]) for _ in xy]
    got = dbscan(table(spark, xy, w=w), 200.0, 5, weight="w").orderBy("idx").collect()
    assert [x.label for x in got] == scan(xy, 200, 5, w)


def test_range_and_neighbours(spark):
    pts = table(spark, [(0, 0), (1000, 0), (0, 1000), (1000, 1000), (5000, 5000)])
    pairs = spatial.range_pairs(pts, 1000.0).where("idx = 0").collect()
    assert sorted(p.other for p in pairs) == [0, 1, 2]
    with pytest.raises(spatial.RadiusError):
        spatial.range_pairs(pts, 3000.0, cell=1000.0)
    far = {r.idx: r.kdist for r in spatial.kth_distance(pts, 1).collect()}
    assert far[0] == 1000 and far[4] == pytest.approx(4000 * 2**0.5)
    assert max(r.kdist for r in spatial.kth_distance(pts, 99).collect()) == pytest.approx(5000 * 2**0.5)
    assert spatial.kth_distance(table(spark, [(0, 0)]), 3).first().kdist == float("inf")
    q = spark.createDataFrame([(0, 5100.0, 5100.0), (1, 500.0, 0.0)], "idx long, x_m double, y_m double")
    assert {r.idx: r.other for r in spatial.nearest(q, pts).collect()} == {0: 4, 1: 0}
    assert {r.other for r in spatial.nearest(q, pts.limit(0)).collect()} == {-1}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (21, 20), (30, 30), (None, 4)], "a int, b int")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(10)}, 20: 20, 21: 20, 30: 30}
    assert connected_components(edges.limit(0)).count() == 0


def test_breaks():
    assert breaks.optimal_starts(np.array([1.0, 2, 3, 100, 101, 102]), 2) == [0, 3]
    rng = np.random.default_rng(3)
    for _ in range(60):
        a = np.sort(rng.integers(0, 12, rng.integers(4, 11)).astype(float))
        for k in (2, 3):
            cost = lambda cuts: sum(((p - p.mean()) ** 2).sum() for p in np.split(a, cuts))
            best = min(cost(list(c)) for c in combinations(range(1, len(a)), k - 1))
            assert cost(breaks.optimal_starts(a, k)[1:]) == pytest.approx(best)
            assert cost(breaks.fisher_starts(a, k)[1:]) == pytest.approx(best)
    three = np.concatenate([b + 0.01 * np.arange(8) for b in (0, 100, 200)])
    k, edges, method, flag = breaks.choose_bands(three)
    assert (k, method, flag, len(edges)) == (3, "fisher-jenks", None, 2)
    assert breaks.choose_bands(np.arange(1600.0))[2] == "ckmeans"
    assert breaks.choose_bands(np.array([2.0, 2, 2]))[3] == "homogeneous"
    assert breaks.choose_bands(np.array([1.0, 2]))[3] == "insufficient-points"
    with pytest.raises(ValueError):
        breaks.Banding(max_bands=1)


def test_modality(spark):
    v = [1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 6, 6, 6, 7, 7, 8]
    d = spark.createDataFrame([(1, float(x)) for x in v] + [(2, float(x)) for x in [0] * 10 + [10] * 10] + [(3, 1.0)] * 3, "g int, v double")
    bc = {r.g: r.bc for r in breaks.bimodality(d, "v", ["g"]).collect()}
    assert bc[1] < breaks.UNIFORM_BC < bc[2] and bc[3] is None


def test_weighted_stats(spark):
    d = spark.createDataFrame([(0, 1.0, 10.0), (0, 3.0, 30.0), (1, 1.0, 10.0), (1, 5.0, None), (2, 5.0, None), (3, 9.0, 0.0)], "g int, ability double, population double")
    got = {r.g: (r.population, r.mean_ability, r.missing_pop) for r in d.groupBy("g").agg(*pass2.weighted_stats()).collect()}
    assert got == {0: (40, 2.5, 0), 1: (10, 1, 1), 2: (0, None, 1), 3: (0, None, 0)}


def run2(spark, x, y, label, ability, population=None, **o):
    n = len(x)
    return pass2.subcluster(table(spark, list(zip(x, y, strict=True)), label=label, ability=[None if a is None else float(a) for a in ability], population=[None if p is None else float(p) for p in (population or [1.0] * n)]), pass2.Options(**o))


def test_pass2_single_unit(spark):
    r = run2(spark, [0] * 6, [0] * 6, [1, 1, 1, 1, -1, -2], [2, 2, 2, None, 2, 2], [10, 30, None, 5, 100, 100])
    c = r.clusters.first()
    assert (c.k, c.flag, c.has_unknown) == (1, "homogeneous", True)
    s = r.subareas.first()
    assert (s.group_id, s.population, s.mean_ability, s.missing_pop) == ("1-b0-s1", 40, 2, 1)
    g = {x.kind: (x.point_count, x.population, x.mean_ability) for x in r.groups.collect()}
    assert g == {"unknown": (1, 5, None), "last_mile": (1, 100, 2)}


def test_pass2_scattered_unknown_and_unsplit(spark):
    r = run2(spark, [0, 50, 100, 80000, 20000, 20050, 20100, 20080], [0, 0, 0, 80000, 0, 0, 0, 0], [1] * 8, [0] * 4 + [10] * 4, min2=2, eps2_override_km=1.0, banding=breaks.Banding(max_bands=2, floor=2))
    got = {x.group_id: sorted(m.idx for m in r.members.where(F.col("group_id") == x.group_id).collect()) for x in r.subareas.collect()}
    assert got == {"1-b0-s1": [0, 1, 2], "1-b0-scattered": [3], "1-b1-s1": [4, 5, 6, 7]}
    n = run2(spark, [0, 1], [0, 1], [1, 1], [None, None])
    assert n.clusters.first().flag == "all-unknown" and n.subareas.count() == 0
    u = run2(spark, [0, 1, 2, 3], [0] * 4, [1] * 4, [0, 0, 9, 9], banding=breaks.Banding(max_bands=2, floor=2))
    assert u.clusters.first().eps2_km is None and {x.group_id for x in u.subareas.collect()} == {"1-b0-s1", "1-b1-s1"}


def test_regions(spark):
    pts = table(spark, [(1000 * i, 0) for i in range(9)], v=[10.0] * 3 + [0.0] * 3 + [10.0] * 3).withColumn("parent", F.lit(1))
    got = regions.regions(pts, "v", ["parent"], 3, 2).orderBy("idx").collect()
    assert [r.region for r in got] == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_eps2(spark):
    pts = table(spark, [(1000 * i, 0) for i in range(5)]).withColumn("parent", F.lit(1))
    assert [pass2.derive_eps2(pts, 2, p, ["parent"]).first().eps2_m for p in (0.0, 0.5, 1.0)] == [1000, 1000, 2000]
    assert pass2.derive_eps2(pts, 5, 0.5, ["parent"]).first().eps2_m is None


def test_hdbscan_blobs(spark):
    r = random.Random(5)
    xy = [(cx + r.gauss(0, 60), cy + r.gauss(0, 60)) for cx, cy in ((0, 0), (5000, 0)) for _ in range(20)] + [(50000, 50000)]
    got = [x.label for x in hdbscan(table(spark, xy), 8, 4, 2000.0).orderBy("idx").collect()]
    assert len(set(got[:20])) == 1 and len(set(got[20:40])) == 1 and got[0] != got[20] and got[40] == -1


def test_weights_and_floors(spark):
    d = spark.createDataFrame([(0, "a", 10.0), (1, "b", 30.0)], "idx int, source string, people double")
    cw, report = pass1.cluster_weights(d, "people", None, 0.1)
    assert {r.idx: r.cw for r in cw.collect()} == {0: 0.5, 1: 1.5} and report == {"requested": True, "applied": True}
    cw, report = pass1.cluster_weights(d, None, {"a": 3.0})
    assert {r.idx: r.cw for r in cw.collect()} == {0: 1.5, 1: 0.5} and report["layers"]
    with pytest.raises(ValueError):
        pass1.cluster_weights(d, None, {"a": 0})
    assert pass1.resolve_floors(True, "hdbscan", [])[0] == {"requested": True, "applied": False, "skipped": []}


def test_admin(spark):
    sq = lambda x: [[[{"x": float(a), "y": float(b)} for a, b in ((x, 0), (x + 10, 0), (x + 10, 10), (x, 10))]]]
    units = spark.createDataFrame([(0, "A", "A", sq(0), 0.0, 0.0, 10.0, 10.0), (1, "B", "B", sq(20), 20.0, 0.0, 30.0, 10.0)], "unit_idx int, id string, name string, polygons array<array<array<struct<x:double,y:double>>>>, minx double, miny double, maxx double, maxy double")
    pts = spark.createDataFrame([(0, 5.0, 5.0), (1, 25.0, 5.0), (2, 2.0, 2.0), (3, 100.0, 100.0)], "idx long, lon double, lat double")
    loc = admin.locate(pts, units)
    assert {r.idx: r.unit_idx for r in loc.collect()} == {0: 0, 1: 1, 2: 0, 3: -1}
    members = spark.createDataFrame([("x", 0), ("x", 1), ("y", 2), ("y", 3)], "g string, idx long")
    assert {r.g: (r.admin_units, r.straddle) for r in admin.units_of(members, loc, units, ["g"]).collect()} == {"x": (["A", "B"], True), "y": (["A"], False)}


def test_hull():
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 1000, 200), rng.uniform(0, 1000, 200)
    wide, tight = hull.concave_ring(x, y, 1e9), hull.concave_ring(x, y, 150)
    area = lambda r: sum(x[a] * y[b] - x[b] * y[a] for a, b in zip(r, r[1:] + r[:1], strict=True)) / 2
    assert 0 < area(tight) < area(wide) and len(set(tight)) == len(tight)
    best = sorted(zip(x, y, strict=True))
    assert (x[wide[0]], y[wide[0]]) == best[0]
    assert hull.concave_ring(np.array([0.0, 1, 2]), np.array([0.0, 1, 2]), 5) is None
    assert hull.concave_ring(np.array([0.0, 0, 0, 1]), np.array([0.0, 0, 0, 1]), 5) is None
    assert hull.outline(np.array([37.0]), np.array([0.0]), 37.0, 0.0, 100, 50) is not None
