"""Connected components as DataFrame rounds of large-star and small-star (Kiveris et al. 2014).

Every round is a few aggregations and joins over the edges alone, so nothing of the graph reaches
the driver but two numbers that tell whether a round changed it. Each round is checkpointed to
the shared folder. Minima are pre-aggregated, and the joins that hand them back are salted, so a
node with a large share of all edges does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.runtime import checkpoint

SALTS = 8


def _with_min(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m, the smallest of u and its neighbours v."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), salts.alias("salt"))
    return edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS))).join(least, ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    own = _with_min(down)
    return own.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, a: str | Column = "a", b: str | Column = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node reachable.

    Edges with a null end are left out; self-loops, repeated and reversed edges are allowed, and
    a node whose only edge is a self-loop is its own component. An empty table gives no rows.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    given = edges.select(col(a).alias("u"), col(b).alias("v")).where("u is not null and v is not null")
    given = checkpoint(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, state = given.where("u <> v"), None
    for _ in range(max_rounds):
        now = checkpoint(_small_star(_large_star(now)))
        if state == (state := _state(now)):
            break
        if not state[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    loops = given.where("u = v").select(F.col("u").alias("node")).join(now.select(F.col("u").alias("node")), "node", "left_anti").join(roots, "node", "left_anti")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(roots.unionByName(loops).select("node", F.col("node").alias("component")))
