"""Density clustering, regions and nearest points against brute force on small inputs."""

import random
from math import dist

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.operators import dbscan as dense
from geostrata.operators import hdbscan as hierarchy
from geostrata.operators import regions, spatial
from geostrata.operators.dbscan import core_points, dbscan
from geostrata.operators.hdbscan import hdbscan
from geostrata.operators.trees import density_clusters, spanning_forest
from test_clustering import scan, table


def parts(nodes, edges):
    """The two sides of a tree (nodes, ascending edges) without its last edge, the side of its first end first."""
    (w, a, b), rest = edges[-1], edges[:-1]
    out = []
    for start in (a, b):
        side, grown = {start}, True
        while grown:
            more = {y for _, p, q in rest for x, y in ((p, q), (q, p)) if x in side and y not in side}
            side, grown = side | more, bool(more)
        out.append((side, [e for e in rest if e[1] in side]))
    return w, out


def tree_of(n, edges):
    seen, out = [{i} for i in range(n)], []
    for e in edges:
        x, y = (next(s for s in seen if v in s) for v in e[1:])
        if x is not y:
            seen = [s for s in seen if s is not x and s is not y] + [x | y]
            out.append(e)
    return out


def condensed(n, mass, edges, least):
    """The definition, by sets: (clusters as dicts, in order of creation)."""
    weigh = lambda s: sum(mass[i] for i in s)
    clusters = [{"birth": 0.0, "up": -1, "stable": 0.0, "home": set()}]
    todo = [(set(range(n)), tree_of(n, edges), 0)]
    while todo:
        nodes, tree, c = todo.pop()
        own = clusters[c]
        while True:
            if len(nodes) == 1:
                own["home"] |= nodes
                break
            w, sides = parts(nodes, tree)
            big = [s for s in sides if weigh(s[0]) >= least]
            rise = 1 / w - own["birth"]
            if len(big) == 1:
                out = next(s for s in sides if s is not big[0])
                own["stable"] += weigh(out[0]) * rise
                own["home"] |= out[0]
                nodes, tree = big[0]
                continue
            own["stable"] += weigh(nodes) * rise
            if not big:
                own["home"] |= nodes
            for s in big:
                clusters.append({"birth": 1 / w, "up": c, "stable": 0.0, "home": set()})
                todo.append((*s, len(clusters) - 1))
            break
    return clusters


def chosen(n, mass, edges, least):
    clusters = condensed(n, mass, edges, least)
    order = sorted(range(len(clusters)), key=lambda c: -clusters[c]["birth"])
    seen, best, wins = {}, {}, {}
    for c in order:
        below = [x for x in range(len(clusters)) if clusters[x]["up"] == c]
        seen[c] = sum(mass[i] for i in clusters[c]["home"]) + sum(seen.get(x, 0) for x in below)
        rest = sum(best.get(x, 0) for x in below)
        wins[c] = seen[c] >= least and (not below or clusters[c]["stable"] >= rest)
        best[c] = clusters[c]["stable"] if wins[c] else rest
        if wins[c]:
            gone = list(below)
            while gone:
                x = gone.pop()
                wins[x] = wins[x] and x not in order[: order.index(c)]  # those that come later decide again
                gone += [y for y in range(len(clusters)) if clusters[y]["up"] == x]
    label = [-1] * n
    for c, own in enumerate(clusters):
        at = c
        while at >= 0 and not wins[at]:
            at = clusters[at]["up"]
        for i in own["home"]:
            label[i] = at
    return label, clusters


@pytest.mark.parametrize("seed", range(60))
def test_density_clusters(seed):
    r = random.Random(seed)
    n = r.randint(2, 24)
    pairs = {(r.randrange(i), i) for i in range(1, n)} | {tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randint(0, 30))}
    pairs = r.sample(sorted(pairs), len(pairs))
    w = sorted(r.choice([1.0, 2.0, 4.0, 5.0]) if seed % 2 else r.uniform(1, 9) for _ in pairs)
    mass, least = [r.choice([1.0, 2.0]) if seed % 3 else 1.0 for _ in range(n)], r.randint(1, 7)
    edges = [(x, a, b) for x, (a, b) in zip(w, pairs, strict=True)]
    a, b = (np.array([e[k] for e in edges]) for k in (1, 2))
    assert [edges[i] for i in spanning_forest(n, a, b)] == tree_of(n, edges)
    label, clusters = chosen(n, mass, edges, least)
    got, birth = density_clusters(np.array(mass), np.array(w), a, b, least)
    assert got.tolist() == label
    assert birth.tolist() == [clusters[c]["birth"] if c >= 0 else 0.0 for c in label]


def test_one_pair():
    label, birth = density_clusters(np.ones(2), np.array([5.0]), np.array([0]), np.array([1]), 2)
    assert label.tolist() == [0, 0] and birth.tolist() == [0.0, 0.0]


def brute_hdbscan(xy, least, samples, link):
    """Labels by the definition: cells of the link length order equal distances."""
    n = len(xy)
    cell = lambda i: (xy[i][0] // link, xy[i][1] // link)
    near = [sorted((dist(xy[i], xy[j]), cell(j), j) for j in range(n) if j != i and dist(xy[i], xy[j]) <= link) for i in range(n)]
    core = [x[samples - 1][0] if len(x) >= samples else x[-1][0] if x else link for x in near]
    first = {}
    for i in range(n):
        for rank, (d, _, j) in enumerate(near[i][:16]):
            first.setdefault((min(i, j), max(i, j)), (i, rank, d))
    edges = sorted((max(core[a], core[b], d, 1.0), g, k, a, b) for (a, b), (g, k, d) in first.items())
    home = list(range(n))
    for _, _, _, a, b in edges:
        x, y = min(home[a], home[b]), max(home[a], home[b])
        home = [x if h == y else h for h in home]
    found = []
    for ord_, c in enumerate(sorted(set(home))):
        own = [i for i in range(n) if home[i] == c]
        place = {i: k for k, i in enumerate(own)}
        label, clusters = chosen(len(own), [1.0] * len(own), [(w, place[a], place[b]) for w, _, _, a, b in edges if home[a] == c], least)
        for s in {x for x in label if x >= 0}:
            found.append(((-clusters[s]["birth"], s > 0, ord_ if s == 0 else -ord_, s), [own[k] for k, x in enumerate(label) if x == s]))
    out = [-1] * n
    for number, (_, members) in enumerate(sorted(found), 1):
        for i in members:
            out[i] = number
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_hdbscan(spark, seed):
    r = random.Random(seed)
    grid = lambda v: round(v / 40) * 40 if seed == 3 else v  # noqa: E731  (a grid gives ties)
    xy = [(grid(cx + r.gauss(0, 120)), grid(cy + r.gauss(0, 120))) for cx, cy in ((0, 0), (700, 100), (9000, 9000)) for _ in range(22)] + [(grid(r.uniform(0, 9000)), grid(r.uniform(0, 9000))) for _ in range(12)]
    xy = list(dict.fromkeys((float(a), float(b)) for a, b in xy))
    got = [x.label for x in hdbscan(table(spark, xy), 5, 4, 900.0).orderBy("idx").collect()]
    assert got == brute_hdbscan(xy, 5, 4, 900.0)


def brute_regions(xy, v, target, knn):
    n = len(xy)
    near = [sorted((dist(xy[i], xy[j]) ** 2, j) for j in range(n) if j != i)[:knn] for i in range(n)]
    tree = tree_of(n, sorted(((v[i] - v[j]) ** 2, i, j) for i in range(n) for _, j in near[i] if j > i))
    cuts = max(0, min(target, n) - (n - len(tree)))
    kept = sorted(tree, key=lambda e: (-e[0], e[1], e[2]))[cuts:]
    home = list(range(n))
    for _, a, b in kept:
        x, y = min(home[a], home[b]), max(home[a], home[b])
        home = [x if h == y else h for h in home]
    names = sorted(set(home))
    return [names.index(h) + 1 for h in home]


@pytest.mark.parametrize("seed", [1, 2])
def test_regions(spark, seed):
    r = random.Random(seed)
    xy = [(r.randint(0, 30) * 100, r.randint(0, 30) * 100) for _ in range(60)]
    v = [float(r.randint(0, 6)) for _ in xy]
    got = regions.regions(table(spark, xy, v=v).withColumn("parent", F.lit(1)), "v", ["parent"], 5, 4).orderBy("idx").collect()
    assert [x.region for x in got] == brute_regions(xy, v, 5, 4)


@pytest.mark.parametrize(("keys", "k"), [([], 1), (["key"], 4)])
def test_nearest_tiles(spark, monkeypatch, keys, k):
    """Many tiles, lots, a crowded place, far queries and two keys against all pairs."""
    monkeypatch.setattr(spatial, "TILE", 40)
    monkeypatch.setattr(spatial, "LOT", 100)
    r = random.Random(k)
    rows = [(i, *((5.0, 5.0) if i % 4 == 0 else (r.gauss(0, 9), r.gauss(0, 9)) if i % 4 == 1 else (r.uniform(0, 900), r.uniform(0, 900))), i % 2) for i in range(400)]
    asked = [(1000 + i, r.uniform(-20000, 2000), r.uniform(-500, 9000), i % 3) for i in range(150)] + [(2000, None, 1.0, 0)]
    schema = "idx long, x_m double, y_m double, key int"
    got = spatial.k_nearest(spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema), k, keys)
    want = []
    for q in asked:
        if q[1] is not None:
            near = sorted(((p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]), p[0]) for p in rows if not keys or p[3] == q[3])[:k]
            want += [(q[0], i, d, rank) for rank, (d, i) in enumerate(near, 1)]
    assert sorted((x.idx, x.other, x.d2, x["rank"]) for x in got.collect()) == sorted(want)


def test_crowded_cells(spark):
    """40,000 points in one cell, a crowded neighbour just beyond eps and one just within."""
    n = 40_000
    pts = spark.range(n).selectExpr("id as idx", "(id % 200) * 0.16 as x_m", "(id div 200) * 0.16 as y_m")
    other = spark.range(2 * n).selectExpr(f"id + {n} as idx", f"case when id < {n} then 132.0 else -131.6 end + (id % 317) * 0.0001 as x_m", "(id div 1317) * 0.1 as y_m")
    got = dbscan(pts.unionByName(other).unionByName(spark.sql(f"select {3 * n}L as idx, 9999.0D as x_m, 0.0D as y_m")), 100.0, 5)
    assert sorted(map(tuple, got.groupBy("label").count().collect())) == [(-1, 1), (1, n), (2, n), (3, n)]
    near = pts.unionByName(other.selectExpr("idx", "x_m - 0.15 as x_m", "y_m"))
    assert sorted(map(tuple, dbscan(near, 100.1, 5).groupBy("label").count().collect())) == [(1, 2 * n), (2, n)]


@pytest.mark.parametrize("seed", [7, 8])
def test_dbscan_floors_and_negative_weights(spark, seed):
    r = random.Random(seed)
    xy = [(r.randint(0, 12) * 50, r.randint(0, 12) * 50) for _ in range(160)]
    w, people = [r.choice([-1.0, 0.5, 2.0]) if seed == 8 else r.choice([0.5, 2.0]) for _ in xy], [r.choice([0.0, 3.0]) for _ in xy]
    pts = table(spark, xy, w=w, people=people)
    near = [[j for j in range(len(xy)) if dist(xy[i], xy[j]) <= 100] for i in range(len(xy))]
    want = [i for i in range(len(xy)) if sum(w[j] for j in near[i]) >= 12 and sum(people[j] for j in near[i]) >= 15]
    assert sorted(x.idx for x in core_points(pts, 100.0, 12, weight="w", floors={"people": 15.0}).collect()) == want
    assert [x.label for x in dbscan(pts, 100.0, 12, weight="w").orderBy("idx").collect()] == scan(xy, 100, 12, w)


def no_pairs(*_, **__):
    raise AssertionError("all pairs within reach")


def test_hdbscan_crowded(spark, monkeypatch):
    """A crowd within one link length: no pair of all becomes a row, and rings go a lot at a time."""
    monkeypatch.setattr(hierarchy, "range_pairs", no_pairs)
    monkeypatch.setattr(hierarchy, "LOT_EDGES", 60)
    monkeypatch.setattr(spatial, "TILE", 40)
    r = random.Random(8)
    xy = [(r.uniform(0, 600), r.uniform(0, 600)) for _ in range(150)] + [(r.uniform(2e3, 9e3), r.uniform(0, 9e3)) for _ in range(60)]
    got = [x.label for x in hdbscan(table(spark, xy), 5, 4, 900.0).orderBy("idx").collect()]
    assert got == brute_hdbscan(xy, 5, 4, 900.0)


def brute_edges(xy, mass, samples, link):
    near = [sorted(((xy[i][0] - x) ** 2 + (xy[i][1] - y) ** 2, x // link, y // link, j) for j, (x, y) in enumerate(xy) if j != i) for i in range(len(xy))]
    near = [[(d**0.5, j) for d, _, _, j in own if d <= link * link] for own in near]
    core = {i: next((d for k, (d, _) in enumerate(own) if sum(mass[j] for _, j in own[: k + 1]) >= samples), own[-1][0]) for i, own in enumerate(near) if own}
    return {(min(i, j), max(i, j)): max(core[i], core[j], d, 1.0) for i, own in enumerate(near) for d, j in own[:16]}


@pytest.mark.parametrize("weighted, most", [(False, 10_000), (True, 10_000), (True, 20)])
def test_reachability_edges(spark, monkeypatch, weighted, most):
    """Nearest neighbours alone, with many at one distance; weights that need more of them, in the end all."""
    monkeypatch.setattr(hierarchy, "MOST_ASKED", most)
    monkeypatch.setattr(spatial, "TILE", 40)
    if most > 20:
        monkeypatch.setattr(hierarchy, "range_pairs", no_pairs)
    r = random.Random(5)
    xy = [(float(r.randrange(-6, 7) * 50), float(r.randrange(0, 13) * 50)) for _ in range(160)] + [(r.uniform(2e3, 9e3), r.uniform(0, 9e3)) for _ in range(40)]
    mass = [r.choice([0.0, 0.125, 0.25]) if weighted else 1.0 for _ in xy]
    pts = spark.createDataFrame([(i, *p, m) for i, (p, m) in enumerate(zip(xy, mass, strict=True))], "idx long, x_m double, y_m double, m double")
    got = {(e.a, e.b): e.w for e in hierarchy.reachability_edges(pts, 4, 400.0, "m" if weighted else None).collect()}
    want = brute_edges(xy, mass, 4, 400.0)
    assert got.keys() == want.keys()
    assert all(got[e] == pytest.approx(want[e], abs=1e-9) for e in want)


@pytest.mark.parametrize("keys, crowded", [([], 2), ([], 0), (["part"], 2)])
def test_edges_by_tile(spark, monkeypatch, keys, crowded):
    """Tiles find their edges themselves: borders, ties, a crowded place dealt in lots, two sizes of groups."""
    monkeypatch.setattr(hierarchy, "k_nearest", no_pairs)
    monkeypatch.setattr(hierarchy, "EDGE_TILE", 40)
    monkeypatch.setattr(hierarchy, "CROWDED", crowded)
    monkeypatch.setattr(spatial, "TILE", 40)
    r = random.Random(12)
    xy = [(float(r.randrange(-6, 7) * 50), float(r.randrange(0, 13) * 50)) for _ in range(160)] + [(100.0, 300.0)] * 90 + [(r.uniform(2e3, 9e3), r.uniform(0, 9e3)) for _ in range(60)]
    ids = r.sample(range(1000), len(xy))
    rows = [(i, *p, int(n % 9 == 0)) for n, (i, p) in enumerate(zip(ids, xy, strict=True))]
    got = hierarchy.reachability_edges(spark.createDataFrame([*rows, (5000, None, 1.0, 0), (5001, float("nan"), 1.0, 1)], "idx int, x_m double, y_m double, part int"), 4, 400.0, keys=keys)
    assert dict(got.dtypes) == {**dict.fromkeys(keys, "int"), "a": "int", "b": "int", "w": "double", "gen": "int", "rank": "int"}
    want = {}
    for part in (0, 1) if keys else (None,):
        own = [p for p in rows if part in (None, p[3])]
        core, first = {}, {}
        for i, x, y, _ in sorted(own):
            near = sorted(((x - u) * (x - u) + (y - v) * (y - v), u // 400, v // 400, j) for j, u, v, _ in own if j != i)
            near = [(d**0.5, j) for d, _, _, j in near if d <= 160_000]
            core[i] = near[min(4, len(near)) - 1][0] if near else None
            for rank, (d, j) in enumerate(near[:16], 1):
                first.setdefault((min(i, j), max(i, j)), (i, rank, d))
        want |= {(part, a, b): (max(core[a], core[b], d, 1.0), gen, rank) for (a, b), (gen, rank, d) in first.items()}
    rows = got.collect()
    assert len(rows) == len(want)
    found = {(e.part if keys else None, e.a, e.b): (e.w, e.gen, e["rank"]) for e in rows}
    assert found.keys() == want.keys()
    assert all(found[e][1:] == want[e][1:] and found[e][0] == pytest.approx(want[e][0], abs=1e-9) for e in want)


def test_range_counts(spark, monkeypatch):
    """Counts without pairs: crowded and thin blocks, lots, many points at one place and at just the radius."""
    monkeypatch.setattr(dense, "range_pairs", no_pairs)
    for name, value in (("BLOCK", 2), ("CROWD", 30), ("LOT", 4)):
        monkeypatch.setattr(spatial, name, value)
    r = random.Random(6)
    xy = [(float(r.randrange(-8, 9) * 50), float(r.randrange(-8, 9) * 50)) for _ in range(260)] + [(r.uniform(-4e3, 4e3), r.uniform(-4e3, 4e3)) for _ in range(60)]
    rows = [(i, i % 2, *p, 250.0 if i % 2 else 400.0) for i, p in enumerate(xy)] + [(900, 0, None, 1.0, 400.0), (901, 2, 0.0, 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "idx long, part int, x_m double, y_m double, eps double")
    got = {(p.part, p.idx): p.n for p in dense.neighbour_sums(pts, "eps", ["part"]).collect()}
    assert got == {(i % 2, i): sum(j % 2 == i % 2 and (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 <= (62_500 if i % 2 else 160_000) for j, q in enumerate(xy)) for i, p in enumerate(xy)}
    same = spark.range(3000).selectExpr("id idx", "100.0D x_m", "-50.0D y_m")
    assert {p.n for p in dense.neighbour_sums(same, 10.0).collect()} == {3000}
