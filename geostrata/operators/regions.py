"""Contiguous regions of similar values: a nearest-neighbour graph cut along its spanning tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.operators.spatial import k_nearest
from geostrata.operators.trees import joined, spanning_forest
from geostrata.runtime import fresh

#: Neighbours of a point in the graph.
DEFAULT_KNN = 8


def regions(points: DataFrame, value: str, keys: list[str], target: int, knn: int = DEFAULT_KNN) -> DataFrame:
    """(keys, idx, region): regions from 1 by their lowest idx, in each group of ``keys``.

    Edges lead from a point to its neighbours of higher idx and weigh the squared difference of
    values; the heaviest edges of the minimum spanning forest are cut until ``target`` regions
    stand. A graph that is not connected can give more. The graph is found by joins; the tree of
    one group is one task's work.
    """
    near = k_nearest(points, points, knn, keys).where("other > idx")
    v = points.select(*keys, F.col("idx"), F.col(value).alias("_v"))
    edges = near.select(*keys, "idx", "other").join(v, [*keys, "idx"]).join(v.select(*keys, F.col("idx").alias("other"), F.col("_v").alias("_o")), [*keys, "other"])
    edges = edges.select(*keys, F.col("idx").alias("a"), F.col("other").alias("b"), ((F.col("_v") - F.col("_o")) * (F.col("_v") - F.col("_o"))).alias("w"))

    def kernel(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        n = len(rows)
        out = rows[[*keys, "idx"]].copy()
        if n <= 1 or target <= 1:
            out["region"] = 1
            return out
        links = links.sort_values(["w", "a", "b"])
        ids, w = rows["idx"].to_numpy(), links["w"].to_numpy()
        a, b = (np.searchsorted(ids, links[c].to_numpy()) for c in ("a", "b"))
        tree = spanning_forest(n, a, b)
        cuts = max(0, min(target, n) - (n - len(tree)))
        kept = tree[np.lexsort((b[tree], a[tree], -w[tree]))][cuts:]
        out["region"] = np.unique(joined(np.arange(n), a[kept], b[kept]), return_inverse=True)[1] + 1
        return out

    fields = "".join(f"{k} {points.schema[k].dataType.simpleString()}, " for k in keys)
    return fresh(points.select(*keys, "idx")).groupBy(*keys).cogroup(fresh(edges).groupBy(*keys)).applyInPandas(kernel, f"{fields}idx {points.schema['idx'].dataType.simpleString()}, region int")
