"""DBSCAN as joins and connected components.

Clusters are the components of the graph of core points within eps of each other, numbered by
their smallest core index; a border point takes the lowest number among its core neighbours; the
rest is noise. Core points of one cell of side eps / sqrt(2) all lie within eps of each other, so
components are found over cells, not points, and the pairs of a crowded place never become edges.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators.components import connected_components
from geostrata.operators.ranking import numbered
from geostrata.operators.spatial import _col, around, range_counts, range_pairs
from geostrata.runtime import checkpoint

# Fixed values of the data model: labels of points outside clusters.
UNVISITED, NOISE, FILTERED = 0, -1, -2


#: Parts of a cell along each side, for the test of whether two crowded cells come within eps of each other.
PARTS = 4


def neighbour_sums(points: DataFrame, eps: float | str, keys: list[str] | None = None, sums: list[str] | None = None, others: DataFrame | None = None) -> DataFrame:
    """(keys, idx, n, sum_<c>): neighbours within eps, the point itself counted, and sums of columns over them.

    Neighbours are ``others``, by default the points themselves.
    """
    keys, sums = keys or [], sums or []
    if others is None and not sums:
        return range_counts(points, eps, keys)
    pairs = range_pairs(points, eps, keys, others=others, carry=sums)
    return pairs.groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"o_{c}").alias(f"sum_{c}") for c in sums))


def _celled(points: DataFrame, radius: Column) -> DataFrame:
    """``points`` with cx and cy: cells whose points all lie within ``radius`` of each other."""
    side = radius / sqrt(2) * (1 - 1e-9)
    return points.withColumn("cx", F.floor(F.try_divide("x_m", side))).withColumn("cy", F.floor(F.try_divide("y_m", side)))


def core_points(points: DataFrame, eps: float | str, min_pts: float, keys: list[str] | None = None, weight: str | None = None, floors: dict[str, float] | None = None, core: Column | None = None) -> DataFrame:
    """(keys, idx) of core points.

    A point is core where the number of its neighbours (or the sum of their ``weight``) reaches
    ``min_pts`` and, for each column of ``floors``, their sum reaches its floor. ``core`` replaces
    the first test by an expression over n and sum_<column>.

    A cell of side eps / sqrt(2) that passes by itself holds core points alone, if no summed value
    of the table is negative. Only points of the other cells, few in each, count their neighbours.
    """
    keys, floors = keys or [], floors or {}
    sums = list(dict.fromkeys([*([weight] if weight else []), *floors]))
    test = core if core is not None else (F.col(f"sum_{weight}") if weight else F.col("n")) >= min_pts
    for c, least in floors.items():
        test = test & (F.coalesce(f"sum_{c}", F.lit(0.0)) >= least)
    if core is not None:
        return neighbour_sums(points, eps, keys, sums).where(test).select(*keys, "idx")
    placed = _celled(points, _col(eps))
    cells = placed.where("cx is not null and cy is not null").groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in sums)).where(test)
    if sums:
        least = points.agg(F.least(*(F.min(c) for c in sums), F.lit(0.0)).alias("_least"))  # one row
        cells = cells.crossJoin(F.broadcast(least)).where("_least >= 0")
    cells = checkpoint(cells.select(*keys, "cx", "cy"))
    sure = placed.join(cells, [*keys, "cx", "cy"], "left_semi").select(*keys, "idx")
    thin = placed.join(cells, [*keys, "cx", "cy"], "left_anti").drop("cx", "cy")
    return sure.unionByName(neighbour_sums(thin, eps, keys, sums, points).where(test).select(*keys, "idx"))


def _box() -> list[Column]:
    return [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]


def _reach() -> tuple[Column, Column]:
    """Squares of the least and the greatest distance that points of the boxes a_ and b_ can have."""

    def along(lo: str, hi: str) -> tuple[Column, Column]:
        ahead, behind = F.col(f"b_{lo}") - F.col(f"a_{hi}"), F.col(f"a_{lo}") - F.col(f"b_{hi}")
        return F.greatest(ahead, behind, F.lit(0.0)), F.greatest(F.col(f"b_{hi}") - F.col(f"a_{lo}"), F.col(f"a_{hi}") - F.col(f"b_{lo}"))

    (nx, fx), (ny, fy) = along("x0", "x1"), along("y0", "y1")
    return nx * nx + ny * ny, fx * fx + fy * fy


def _cell_edges(cores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): nodes of neighbouring cells with two core points within eps of each other.

    Tight boxes of cells, then of their parts, settle nearly all pairs of cells; points meet points
    only in pairs of parts that boxes leave open, and only those that come within eps of the other
    part's box, so crowded cells don't multiply their points.
    """
    e2 = F.col("_eps") * F.col("_eps")
    part = lambda c: F.pmod(F.floor(F.try_divide(c, F.col("_eps") / sqrt(2) / PARTS)), F.lit(PARTS))
    fine = cores.withColumn("s", part("x_m") * PARTS + part("y_m"))
    parts = checkpoint(fine.select(*keys, "cx", "cy", "node", "_eps", "s", F.col("x_m").alias("x0"), F.col("x_m").alias("x1"), F.col("y_m").alias("y0"), F.col("y_m").alias("y1")).groupBy(*keys, "cx", "cy", "node", "_eps", "s").agg(*_box()))
    cells = parts.groupBy(*keys, "cx", "cy", "node", "_eps").agg(*_box())
    boxed = lambda d, p, *more: d.select(*keys, F.col("node").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("x0", "x1", "y0", "y1")), *more)
    ahead = F.filter(around(2), lambda o: (o["dx"] > 0) | ((o["dx"] == 0) & (o["dy"] > 0)))
    left = boxed(cells, "a", "_eps", F.col("cx").alias("_cx"), F.col("cy").alias("_cy")).withColumn("_o", F.explode(ahead))
    left = left.withColumn("cx", F.col("_cx") + F.col("_o.dx")).withColumn("cy", F.col("_cy") + F.col("_o.dy")).drop("_cx", "_cy", "_o")
    least, most = _reach()
    pairs = checkpoint(left.join(boxed(cells, "b", "cx", "cy"), [*keys, "cx", "cy"]).where(least <= e2).select(*keys, "a", "b", "_eps", (most <= e2).alias("sure")))
    open_ = pairs.where("not sure").drop("sure")
    of = lambda p: boxed(parts, p, F.col("s").alias(f"s{p}"))
    boxes = [f"{p}_{c}" for p in ("a", "b") for c in ("x0", "x1", "y0", "y1")]
    inner = checkpoint(open_.join(of("a"), [*keys, "a"]).join(of("b"), [*keys, "b"]).where(least <= e2).select(*keys, "a", "b", "sa", "sb", "_eps", *boxes, (most <= e2).alias("sure")))
    by_part = inner.where("sure").select(*keys, "a", "b").distinct()
    rest = inner.where("not sure").join(by_part, [*keys, "a", "b"], "left_anti")
    both = [*keys, "a", "b", "sa", "sb"]

    def facing(p: str, q: str) -> DataFrame:
        """Points of part ``p`` that come within eps of the box of part ``q``."""
        own = fine.select(*keys, F.col("node").alias(p), F.col("s").alias(f"s{p}"), F.col("x_m").alias(f"x{p}"), F.col("y_m").alias(f"y{p}"))
        beyond = lambda v, lo, hi: F.greatest(F.col(f"{q}_{lo}") - F.col(v), F.col(v) - F.col(f"{q}_{hi}"), F.lit(0.0))
        dx, dy = beyond(f"x{p}", "x0", "x1"), beyond(f"y{p}", "y0", "y1")
        return rest.join(own, [*keys, p, f"s{p}"]).where(dx * dx + dy * dy <= e2).select(*both, "_eps", f"x{p}", f"y{p}")

    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    by_point = facing("a", "b").join(facing("b", "a").drop("_eps"), both).where(dx * dx + dy * dy <= e2).select(*keys, "a", "b").distinct()
    return pairs.where("sure").select(*keys, "a", "b").unionByName(by_part).unionByName(by_point)


def dbscan(points: DataFrame, eps: float | str, min_pts: float, keys: list[str] | None = None, weight: str | None = None, floors: dict[str, float] | None = None, core: Column | None = None) -> DataFrame:
    """(keys, idx, label): cluster ids from 1 within each ``keys``, -1 for noise.

    ``points`` needs idx (unique within keys), x_m, y_m and the columns named. ``eps`` in metres is
    a number or a column that is constant within keys. Points with null coordinates are noise.
    """
    keys = keys or []
    radius = _col(eps)
    base = points.select(*keys, "idx", "x_m", "y_m", radius.alias("_eps"), *dict.fromkeys([*([weight] if weight else []), *(floors or {})]))
    ids = checkpoint(core_points(base, "_eps", min_pts, keys, weight, floors, core))
    cores = base.select(*keys, "idx", "x_m", "y_m", "_eps").join(ids, [*keys, "idx"], "left_semi")
    cell = _celled(cores, F.col("_eps"))
    cores = checkpoint(cell.join(cell.groupBy(*keys, "cx", "cy").agg(F.min("idx").alias("node")), [*keys, "cx", "cy"]))
    edges = _cell_edges(cores, keys)
    nodes = cores.select(*keys, "node").distinct()
    if keys:  # one graph: a node is known by its keys and its index
        named = lambda c: F.struct(*keys, F.col(c).alias("node"))
        component = connected_components(edges, named("a"), named("b")).select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.node").alias("node"), F.col("component.node").alias("component"))
    else:
        component = connected_components(edges)
    roots = nodes.join(component, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))
    first = roots.select(*keys, "component").distinct()
    if keys:
        ids = first.withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy("component")))
    else:
        ids = numbered(first, ["component"], "label")
    labelled = roots.join(ids, [*keys, "component"]).select(*keys, "node", F.col("label").cast("int").alias("label"))
    core_labels = checkpoint(cores.join(labelled, [*keys, "node"]).select(*keys, "idx", "x_m", "y_m", "_eps", "label"))
    rest = base.select(*keys, "idx", "x_m", "y_m", "_eps").join(core_labels.select(*keys, "idx"), [*keys, "idx"], "left_anti")
    border = range_pairs(rest, "_eps", keys, others=core_labels, carry=["label"]).groupBy(*keys, "idx").agg(F.min("o_label").alias("label"))
    rest = rest.select(*keys, "idx").join(border, [*keys, "idx"], "left").withColumn("label", F.coalesce("label", F.lit(NOISE)))
    return core_labels.select(*keys, "idx", "label").unionByName(rest)
