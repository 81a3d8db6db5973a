"""Embedding near-dedup: collision-counting projections.

Vectors are projected on many random directions and each projection is sorted. A vector looks at
the windows centred on its own values at both sparse ends of the sorted projections: there a pair
with a high cosine still collides often and an unrelated pair hardly ever. Collisions are counted
per pair; pairs with at least ``count`` of them (a number calibrated so that pairs at the cosine
threshold reach it with the wanted recall) are verified in double precision, once, in the first
projection in which they collide.

The ends hold about ``LIST`` vectors each, whatever the number of vectors: the more there are, the
farther out the ends begin and the more directions there are, so the rows that are sorted and the
pairs that are counted grow in proportion. Ids and values are sorted and counted first, with the
vectors rounded to bytes: a pair whose bytes rule the cosine out, whatever was rounded off, needs
no verification. Vectors are fetched only for those that have a pair to verify.

Equal vectors are one class. A list of more than ``block`` classes is cut into parts and each pair
of parts is a group of its own. Groups return sums per vector and the edges of a spanning forest,
never their pairs.
"""

from __future__ import annotations

from math import ceil, erfc, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import join_counted, mapped, whole_groups
from geostrata.operators.components import connected_components
from geostrata.runtime import checkpoint

#: Classes at an end of a sorted projection, ends that a vector is to be in, and the share of an end that is the smallest.
LIST, ROWS, LEAST_TAIL = 48, 18, 1e-5
#: Half the width of a window.
HALF_WINDOW = 0.8
RECALL, COSINE = 0.99, 0.9
#: Classes of a list that one task compares with each other at a time, and directions that are projected on at a time.
BLOCK, STRIP = 400, 2_048


def _upper(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def tail_start(share: float) -> float:
    """The standard normal value with ``share`` of the mass above it."""
    lo, hi = 0.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _upper(mid) > share else (lo, mid)
    return lo


def layout(classes: int, rows: int = ROWS, size: int = LIST) -> tuple[int, float]:
    """(directions, share of the vectors at each end) for a number of classes.

    Beyond ``size / LEAST_TAIL`` classes the ends no longer shrink, and the lists grow instead.
    """
    tail = min(0.01, max(LEAST_TAIL, size / max(1, classes)))
    return ceil(rows / (2 * tail)), tail


def calibrate(cosine: float, directions: int, tail: float, half: float = HALF_WINDOW, recall: float = RECALL) -> tuple[int, float]:
    """The largest count that pairs at ``cosine`` reach with probability ``recall``, and that probability; 1 at least.

    A pair's values on a random direction are a standard normal pair with its cosine as
    correlation, and directions are independent, so its collisions are binomial.
    """
    t, s = tail_start(tail), sqrt(1 - cosine**2)
    step = 1e-3
    p = 0.0
    for i in range(int(6 / step)):
        x = t + (i + 0.5) * step
        low, high = max(t, x - half), x + half
        p += exp(-x * x / 2) / sqrt(2 * pi) * step * (_upper((low - cosine * x) / s) - _upper((high - cosine * x) / s))
    n, term, below, best = 2 * directions, (1 - p) ** (2 * directions), 0.0, None
    for k in range(1, n + 1):  # below: the probability of fewer than k
        below += term
        term *= (n - k + 1) / k * p / (1 - p)
        if best is None or 1 - below >= recall:
            best = (k, 1 - below)
        if 1 - below < recall:
            break
    return best


def _strips(x: np.ndarray, dim: int, directions: int, t: float):
    """(row, list, value) of each place at an end: projections of unit vectors on a strip of directions at a time."""
    for first in range(0, directions, STRIP):
        g = np.random.default_rng((dim, first)).standard_normal((dim, STRIP)).astype(np.float32)[:, : directions - first]
        y = x @ g
        row, direction = np.nonzero(np.abs(y) >= t)
        value = y[row, direction]
        yield row, 2 * (direction + first) + (value < 0), np.abs(value).astype(np.float16)


def _by_length(vec: pa.Array):
    """(dim, row numbers, unit vectors in doubles) of a batch of packed vectors, a thousand of one length at a time."""
    raw = [np.frombuffer(x, "<f8") for x in vec.to_pylist()]
    by: dict[int, list[int]] = {}
    for i, x in enumerate(raw):
        by.setdefault(len(x), []).append(i)
    for dim, rows in by.items():
        for a in range(0, len(rows), 1000):
            yield dim, np.array(rows[a : a + 1000]), np.array([raw[i] for i in rows[a : a + 1000]])


def _crowded(classes: DataFrame, directions: int, tail: float, block: int) -> DataFrame:
    """(list, parts) of the lists with more than ``block`` classes."""
    t = tail_start(tail)

    def kernel(batches):
        for batch in batches:
            for dim, _, x in _by_length(batch.column("vec")):
                for _, lists, _ in _strips(x.astype(np.float32), dim, directions, t):
                    of, n = np.unique(lists, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(of + (dim << 32)), pa.array(n)], ["list", "n"])

    sizes = mapped(classes.select("vec"), kernel, "list long, n long").groupBy("list").agg(F.sum("n").alias("n"))
    return checkpoint(sizes.where(F.col("n") > block).select("list", F.ceil(F.col("n") / block).cast("int").alias("parts")))


def _places(classes: DataFrame, directions: int, tail: float) -> DataFrame:
    """A row for each place at an end: list (vector length, direction and end), value, rep, n, own (all its lists), at (its values there), small (the vector in bytes)."""
    t = tail_start(tail)

    def kernel(batches):
        for batch in batches:
            rep, size = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            for dim, rows, x in _by_length(batch.column("vec")):
                row, lists, value = (np.concatenate(c) for c in zip(*_strips(x.astype(np.float32), dim, directions, t), strict=True))
                small = pa.array(_small(x), pa.binary())
                order = np.lexsort((lists, row))
                row, lists, value = row[order], lists[order], value[order]
                cuts = np.searchsorted(row, np.arange(len(rows) + 1))
                own = pa.array([lists[i:j].astype("<i4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                at = pa.array([value[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists + (dim << 32)), pa.array(value.astype(np.float32)), pa.array(rep[rows][row]), pa.array(size[rows][row]), own.take(take), at.take(take), small.take(take)], ["list", "value", "rep", "n", "own", "at", "small"])

    return mapped(classes.select("rep", "n", "vec"), kernel, "list long, value float, rep long, n long, own binary, at binary, small binary")


def _small(x: np.ndarray) -> list[bytes]:
    """Each unit vector as one byte a component, with its scale and how far that is from the vector."""
    scale = (np.abs(x).max(1) / 127).astype(np.float32)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    off = np.linalg.norm(x - q * scale[:, None].astype(float), axis=1)
    head = np.column_stack([scale, (off * (1 + 1e-5) + 1e-7).astype(np.float32)])
    return [h.tobytes() + r.tobytes() for h, r in zip(head, q, strict=True)]


def _possible(small: list[bytes], cosine: float) -> np.ndarray:
    """Which pairs of vectors can have that cosine: their bytes' product, and the most that rounding can have taken from it."""
    raw = np.frombuffer(b"".join(small), np.uint8).reshape(len(small), -1)
    head = raw[:, :8].copy().view(np.float32).astype(float)
    q = raw[:, 8:].view(np.int8).astype(np.float32)
    off = head[:, 1]
    error = off[:, None] + off[None, :] + 3 * off[:, None] * off[None, :]
    return (q @ q.T) * head[:, :1] * head[None, :, 0] >= cosine - error - 1e-5


def _windows(value: np.ndarray, half: float, step: int):
    """(a, b) with a before b in the sorted values and b in the window around a, in slices of about ``step`` pairs."""
    ahead = np.searchsorted(value, value + half, side="right") - np.arange(len(value)) - 1
    upto = np.cumsum(ahead)
    first = 0
    while first < len(value):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + step, side="right")))
        n = ahead[first:last]
        a = np.repeat(np.arange(first, last), n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        first = last


def _passing(here: int, value: np.ndarray, own: list[bytes], at: list[bytes], cross: np.ndarray | None, count: int, half: float, possible: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list's rows, sorted by value, that collide ``count`` times or more, and in list ``here`` first.

    Pairs that are not ``possible`` are left out before their collisions are counted one by one.
    """
    joined, values = np.frombuffer(b"".join(own), "<i4"), np.frombuffer(b"".join(at), np.float16).astype(np.float32)
    row = np.repeat(np.arange(len(own)), [len(x) // 4 for x in own])
    lists, spot, counts = np.unique(joined, return_inverse=True, return_counts=True)
    shared = counts > 1  # lists that at least two members are in
    place = np.cumsum(shared) - 1
    good = shared[spot]
    lists, row, spot, values = lists[shared], row[good], place[spot[good]], values[good]
    m = np.zeros((len(own), len(lists)), np.float32)
    m[row, spot] = 1
    good = m @ m.T >= count  # common lists: no fewer than collisions
    if possible is not None:
        good &= possible
    m[row, spot] = values
    keep_a, keep_b = [], []
    for a, b in _windows(value, half, max(1, 1_000_000 // max(1, len(lists)))):
        ok = good[a, b]
        if cross is not None:
            ok &= cross[a] != cross[b]
        a, b = a[ok], b[ok]
        x, y = m[a], m[b]
        met = (x > 0) & (y > 0) & (np.abs(x - y) <= half)
        ok = (met.sum(1) >= count) & (lists[met.argmax(1)] == here) if len(a) else np.zeros(0, bool)
        keep_a.append(a[ok])
        keep_b.append(b[ok])
    return np.concatenate(keep_a), np.concatenate(keep_b)


def _verified(a: np.ndarray, b: np.ndarray, vec: list[bytes], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose cosine in double precision is ``cosine`` or more."""
    used = np.union1d(a, b)
    unit = np.array([np.frombuffer(vec[i], "<f8") for i in used])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    x, y = np.searchsorted(used, a), np.searchsorted(used, b)
    near = np.concatenate([(unit[x[i : i + 50_000]] * unit[y[i : i + 50_000]]).sum(1) >= cosine for i in range(0, len(x), 50_000)])
    return a[near], b[near]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that links reach from each of n members."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    """``rows`` by group (list, i, j), each group sorted by value."""
    keys = ["list", "i", "j"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, "value", "rep", "n", "part", "own", "at", *more).repartition(n, *keys).sortWithinPartitions(*keys, "value", "rep")


def _groups(batches, count: int, half: float, cosine: float | None = None):
    """(table, first row, end, pairs) of each group with pairs that pass the count; with ``cosine``, of those that can have it."""
    keys = ["list", "i", "j"]
    for t in whole_groups(batches, keys, 4_000):
        columns = [t[k].to_numpy() for k in keys]
        change = np.zeros(t.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(np.concatenate(([True], change, [True])))
        value, part, own, at = t["value"].to_numpy(), t["part"].to_numpy(), t["own"].to_pylist(), t["at"].to_pylist()
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if y - x > 1:
                cross = part[x:y] if columns[1][x] != columns[2][x] else None
                a, b = _passing(int(columns[0][x]) & 0xFFFFFFFF, value[x:y], own[x:y], at[x:y], cross, count, half, None if cosine is None else _possible(t["small"].slice(x, y - x).to_pylist(), cosine))
                if len(a):
                    yield t, x, y, a, b


def _links(classes: DataFrame, cosine: float, directions: int, tail: float, count: int, half: float, block: int) -> DataFrame:
    """(rep, links, root) of each group: vectors linked to rep there, and one that its links reach."""
    places = _places(classes, directions, tail).join(_crowded(classes, directions, tail, block), "list", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = places.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")
    dealt = _dealt(own, "small")

    def counted(batches):
        for t, x, y, a, b in _groups(batches, count, half, cosine):
            yield from t.slice(x, y - x).take(pa.array(np.union1d(a, b))).drop_columns("small").to_batches()

    def verified(batches):
        for t, x, y, a, b in _groups(batches, count, half):
            m, rep, size = y - x, t["rep"].to_numpy()[x:y], t["n"].to_numpy()[x:y]
            a, b = _verified(a, b, t["vec"].slice(x, m).to_pylist(), cosine)
            if len(a):
                links = np.bincount(a, size[b], m) + np.bincount(b, size[a], m)
                root, some = rep[_forest(m, a, b)], np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], ["rep", "links", "root"])

    open_ = checkpoint(mapped(dealt, counted, dealt.drop("small").schema))
    return mapped(_dealt(open_.join(classes.select("rep", "vec"), "rep"), "vec"), verified, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, rows: int = ROWS, half: float = HALF_WINDOW, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, at a cosine of ``cosine`` or more.

    ``rows`` is how many ends of projections a vector is in on average: with more of them fewer
    pairs are missed, at a cost in proportion.

    Null or zero vectors, and those with null or non-finite components, link with nothing and are
    their own component; so do vectors with a null vec_id, whose component is null. Vectors of
    different lengths never link. Equal vectors link with each other and share their other links.
    An empty table gives no rows; other columns are ignored.
    """

    def packed(batches):
        for batch in batches:
            col = batch.column("embedding")
            raw = []
            for x in col:
                v = None if not x.is_valid or x.values is None or x.values.null_count else np.asarray(x.values.to_numpy(zero_copy_only=False), "<f8")
                good = v is not None and len(v) and np.isfinite(v).all() and v.any() and np.isfinite(w := v / np.abs(v).max()).all()
                raw.append((w / np.linalg.norm(w) + 0.0).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "vec"])

    units = mapped(vectors.select("vec_id", "embedding"), packed, "vec_id long, vec binary")
    units = checkpoint(units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("vec")).alias("vec")).withColumn("e1", F.xxhash64("vec")).withColumn("e2", F.xxhash64(F.lit(1), "vec")))
    filled = units.where("vec is not null")
    classes = checkpoint(filled.groupBy("e1", "e2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")))
    directions, tail = layout(classes.count(), rows)
    count, _ = calibrate(cosine, directions, tail, half, recall)
    found = checkpoint(_links(classes, cosine, directions, tail, count, half, block))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = classes.select("e1", "e2", "rep", "n").join(links, "rep", "left").join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
    by_class = by_class.select("e1", "e2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = join_counted(filled, by_class, ["e1", "e2"]).select("vec_id", "n_links", "component_id")
    alone = units.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
