"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures.

A document's set of word shingles gives ``SYMBOLS`` minima, of which 8 bits each are kept. Pairs
at the similarity threshold differ in few symbols; ``distance_bound`` takes the count that all
but one in a thousand such pairs stay under. The signature is split into chunks so that, by the
pigeonhole principle, every pair within the bound has a chunk with at most ``ERRORS`` errors; for
each chunk all such errors are enumerated (each place left out in turn), and equal keys meet.

Documents with equal sets are one class from the start. Buckets tell which classes lie within the
signature distance of each other; of those pairs only a spanning forest is passed on, so a group
of thousands of near copies costs as many rows as it has members. Inside each component of the
forests all pairs are decided on the full shingle sets by matrix products over parts of bounded
size, and again only a forest of the links leaves a task.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import blocks, constants, hash_runs, join_counted, lower_ascii, mapped, mix, runs, whole_groups
from geostrata.operators.components import connected_components
from geostrata.runtime import checkpoint

SHINGLE, THRESHOLD = 5, 80
SYMBOLS, ERRORS = 64, 1
#: Classes of a bucket, and documents of a candidate component, that one task compares at a time.
BLOCK, PART = 1_000, 300
#: Shingles of all documents of such a part.
PART_SHINGLES = 1_000_000
#: Documents whose ids are broadcast to pick their texts; more are joined by a shuffle.
PICK_IDS = 300_000

_INSIDE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STEP, _HASHES, _CELLS = constants(256, 5), constants(SYMBOLS, 29), constants(SYMBOLS, 31)


def distance_bound(threshold: int, symbols: int = SYMBOLS, miss: float = 1e-3) -> int:
    """Differing symbols that a pair with similarity ``threshold`` % exceeds with probability ``miss`` at most."""
    p = (1 - threshold / 100) * (1 - 2**-8)
    total = 0.0
    for k in range(symbols + 1):
        total += comb(symbols, k) * p**k * (1 - p) ** (symbols - k)
        if total >= 1 - miss:
            return k
    return symbols


def chunks(bound: int, symbols: int = SYMBOLS, errors: int = ERRORS) -> list[tuple[int, int]]:
    """Chunk limits: as many that ``bound`` errors leave one of them with at most ``errors``."""
    n = min(symbols, bound // (errors + 1) + 1)
    cuts = np.linspace(0, symbols, n + 1).astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin.

    A text of fewer words than ``size`` has its whole word sequence as its one shingle.
    """
    low = lower_ascii(data)
    starts, ends, rows = runs(_INSIDE[low], offsets)
    words = hash_runs(low, starts, ends)
    n = len(offsets) - 1
    cuts = np.searchsorted(rows, np.arange(n + 1))
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            grams += words[k : k + len(grams)] * _STEP[k]
        grams = mix(grams)
        out, lengths = [], np.zeros(n, np.int64)
        for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b - a >= size:
                own = grams[a : b - size + 1].copy()
                own.sort()
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                own = mix(np.array([(words[a:b] * _STEP[: b - a]).sum()], np.uint64) + np.uint64(b - a))
            else:
                continue
            out.append(own)
            lengths[r] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(lengths)))


def signatures(sets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sums that stand for each set, and its signature of one byte a symbol (0 for empty sets)."""
    n = len(cuts) - 1
    full = np.flatnonzero(np.diff(cuts) > 0)
    f1, f2, sig = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, SYMBOLS), np.uint8)
    if len(full):
        at = cuts[:-1][full]
        with np.errstate(over="ignore"):
            f1[full], f2[full] = np.add.reduceat(sets, at), np.add.reduceat(mix(sets ^ np.uint64(0x5BD1E995)), at)
            for k in range(SYMBOLS):
                v = (sets ^ (sets >> np.uint64(29))) * _HASHES[k]
                sig[full, k] = mix(np.minimum.reduceat(v, at)).astype(np.uint8)
    return f1, f2, sig


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, n_shingles, f1, f2 (equal for equal sets), sig (null without words)."""

    def kernel(batches):
        for batch in batches:
            parts = []
            for _, data, offsets in blocks(batch.column("text")):
                sets, cuts = shingle_sets(data, offsets, size)
                parts.append((np.diff(cuts), *signatures(sets, cuts)))
            n, f1, f2, sig = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, SYMBOLS), np.uint8))
            raw = [s.tobytes() if k else None for s, k in zip(sig, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(raw, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sig"])

    return mapped(docs.select("doc_id", "text"), kernel, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def bucket_keys(classes: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """(key, rep) for each chunk and each enumerated error of it."""

    def kernel(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, SYMBOLS).astype(np.uint64)
            if not len(sig):
                continue
            with np.errstate(over="ignore"):
                cell = (sig + np.uint64(1)) * _CELLS
                keys = []
                for a, b in limits:
                    whole = cell[:, a:b].sum(1)
                    keys += [mix(whole - cell[:, j] + _STEP[128 + j]) for j in range(a, b)]
            key = np.concatenate(keys).view(np.int64)
            rep = np.tile(batch.column("rep").to_numpy(), len(keys))
            for i in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 50_000]), pa.array(rep[i : i + 50_000])], ["key", "rep"])

    return mapped(classes.select("rep", "sig"), kernel, "key long, rep long")


def _dealt(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """``rows`` dealt to groups (key, i, j): a key's rows are cut into parts by hash, and each pair of parts is a group.

    ``part`` is a row's own part, so a group never holds more than two parts of about ``block`` rows.
    """
    own = rows.withColumn("parts", F.ceil(F.col(size) / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return own.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")


def _groups(columns: list[np.ndarray]) -> list[tuple[int, int]]:
    """Limits of the runs of rows that agree in all columns."""
    change = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    cuts = np.flatnonzero(np.concatenate(([True], change, [True]))).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class _Forest:
    """Components of 0..n-1 while links come in; ``root`` is the smallest member of each one's component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        """Make one component of the components of ``members``."""
        roots = np.unique(self.root[members])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def edges(self, names: np.ndarray) -> np.ndarray:
        own = np.flatnonzero(self.root != np.arange(len(self.root)))
        return np.column_stack([names[self.root[own]], names[own]])


def _near_forest(sig: np.ndarray, left: np.ndarray, right: np.ndarray | None, bound: int) -> _Forest:
    """Components of signatures within ``bound``: among ``left``, or between ``left`` and ``right``.

    Rows near the first of ``left`` are linked through it; only rows that aren't near it are
    compared with all others. Between two parts, what is near the first on either side is linked
    through it too, as the groups of single parts tell.
    """
    forest = _Forest(len(sig))
    near = lambda x, others: others[(sig[others] != sig[x]).sum(1) <= bound]
    lead = left[0]
    at_lead = near(lead, left)
    if right is None:
        forest.join(at_lead)
        for x in np.setdiff1d(left, at_lead).tolist():
            forest.join(near(x, left))
        return forest
    to_lead = near(lead, right)
    forest.join(np.append(to_lead, lead))
    for x in np.setdiff1d(left, at_lead).tolist():
        forest.join(np.append(near(x, right), x))
    for x in np.setdiff1d(right, to_lead).tolist():
        forest.join(np.append(near(x, left), x))
    return forest


def candidates(buckets: DataFrame, bound: int, block: int = BLOCK) -> DataFrame:
    """(a, b): a forest of the classes of each bucket (key, rep, sig, n) whose signatures lie within ``bound``.

    Its components over all buckets are those of all pairs within the bound, since each such pair
    meets in some bucket.
    """
    keys = ["key", "i", "j"]
    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(buckets, "key", "n", block).select(*keys, "part", "rep", "sig").repartition(n, *keys).sortWithinPartitions(*keys, "rep")

    def kernel(batches):
        for t in whole_groups(batches, keys):
            key, i, j, part, rep = (t[c].to_numpy() for c in (*keys, "part", "rep"))
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            found = []
            for a, b in _groups([key, i, j]):
                if b - a < 2:
                    continue
                if i[a] == j[a]:
                    left, right = np.arange(b - a), None
                else:
                    left, right = np.flatnonzero(part[a:b] == i[a]), np.flatnonzero(part[a:b] == j[a])
                    if not len(left) or not len(right):
                        continue
                found.append(_near_forest(sig[a:b], left, right, bound).edges(rep[a:b]))
            if found:
                out = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["a", "b"])

    return mapped(dealt, kernel, "a long, b long").distinct()


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: int, slice_: int = 4096) -> np.ndarray:
    """Whether each of ``left`` and each of ``right`` reach ``threshold`` %: common shingles counted by matrix products."""
    sizes = np.array([len(x) for x in sets])
    used = np.union1d(left, right)
    joined = np.concatenate([sets[i] for i in used])
    names, counts = np.unique(joined, return_counts=True)
    names = names[counts > 1]
    common = np.zeros((len(left), len(right)), np.float32)
    spot = np.full(len(sets), -1)
    spot[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(used)), sizes[used])
    at = np.searchsorted(names, joined)
    at[at == len(names)] = 0
    good = names[at] == joined if len(names) else np.zeros(len(joined), bool)
    row, at = row[good], at[good]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for first in range(0, len(names), slice_):
        a, b = np.searchsorted(at, [first, first + slice_])
        m = np.zeros((len(used), min(slice_, len(names) - first)), np.float32)
        m[row[a:b], at[a:b] - first] = 1
        common += m[spot[left]] @ m[spot[right]].T
    common = common.astype(np.int64)
    return (common > 0) & (100 * common >= threshold * (sizes[left][:, None] + sizes[right][None, :] - common))


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``ids`` (rep, ...) with the texts of those documents; a small table of ids is broadcast, by its count."""
    few = ids.count() <= PICK_IDS
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    return texts.join(F.broadcast(ids) if few else ids, "rep")


def _linked(rows: DataFrame, keys: list[str], size: int, threshold: int, between: bool) -> DataFrame:
    """(a, b): a forest of the links inside each group of rows (keys, rep, text), or between its two ``side``s."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, "rep", "text", *(["side"] if between else [])]
    dealt = rows.select(*columns).repartition(n, *keys).sortWithinPartitions(*keys, "rep")

    def kernel(batches):
        for t in whole_groups(batches, keys, 300):
            columns, rep, sets = [t[c].to_numpy() for c in keys], t["rep"].to_numpy(), []
            for _, data, offsets in blocks(t["text"]):
                own, cuts = shingle_sets(data, offsets, size)
                sets += [own[cuts[i] : cuts[i + 1]] for i in range(len(cuts) - 1)]
            side = t["side"].to_numpy(zero_copy_only=False) if between else None
            found = []
            for a, b in _groups(columns):
                left = np.flatnonzero(side[a:b]) if between else np.arange(b - a)
                right = np.flatnonzero(~side[a:b]) if between else left
                if b - a < 2 or not len(left) or not len(right):
                    continue
                yes, forest = similar(sets[a:b], left, right, threshold), _Forest(b - a)
                for x in np.flatnonzero(yes.any(1)).tolist():
                    forest.join(np.append(right[yes[x]], left[x]))
                found.append(forest.edges(rep[a:b]))
            if found:
                out = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["a", "b"])

    return mapped(dealt, kernel, "a long, b long").where("a <> b").distinct()


def links(members: DataFrame, docs: DataFrame, size: int, threshold: int, block: int = PART) -> DataFrame:
    """(a, b): a forest of all links inside each candidate component (rep, component, n_shingles), confirmed on full shingle sets.

    A component is cut into parts of about ``block`` documents or ``PART_SHINGLES`` shingles. First all pairs inside each part
    are decided, and all pairs with the component's first document. What is then linked with most
    of a component is its core; where a component of several parts has other documents, those are
    decided against all of it, part by part. Of ids on several rows any text may stand for the id.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("_shingles")).where("n > 1")
    sizes = checkpoint(sizes.select("component", "n", F.ceil(F.greatest(F.col("n") / block, F.col("_shingles") / PART_SHINGLES)).cast("int").alias("parts")))
    own = join_counted(members, sizes, ["component"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    own = checkpoint(own.select("rep", "component", "parts", "part"))
    lead = F.when(F.col("rep") == F.col("component"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    with_text = _texts(own, docs)
    inside = checkpoint(_linked(with_text.withColumn("part", F.explode(lead)), ["component", "part"], size, threshold, False))
    large = own.where("parts > 1")
    if large.limit(1).count() == 0:
        return inside
    now = connected_components(inside).select(F.col("node").alias("rep"), F.col("component").alias("now"))
    large = large.join(now, "rep", "left").withColumn("now", F.coalesce("now", "rep"))
    core = large.groupBy("component", "now").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("now", F.struct("n", "now")).alias("core"))
    large = checkpoint(large.join(core, "component").withColumn("other", F.col("now") != F.col("core")))
    others = large.where("other").groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("lots"))
    large = large.join(others, "component")
    # a group: one part of a component and one lot of its other documents
    every = large.select("rep", "component", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("j"), F.lit(False).alias("side"))
    rest = large.where("other").select("rep", "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.pmod(F.hash("rep"), F.col("lots")).cast("int").alias("j"), F.lit(True).alias("side"))
    ids = checkpoint(every.unionByName(rest).groupBy("rep", "component").agg(F.collect_list(F.struct("i", "j", "side")).alias("to")))
    dealt = _texts(ids, docs).select("rep", "component", "text", F.explode("to").alias("t")).select("rep", "component", "text", "t.*")
    return inside.unionByName(checkpoint(_linked(dealt, ["component", "i", "j"], size, threshold, True)))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Words are maximal runs without ASCII white space, A-Z lower-cased; pairs with a Jaccard
    similarity of ``threshold`` % or more are linked. Null or empty texts have an empty set and
    are linked with nothing. Rows with the same doc_id count as one document when links are
    followed. A row without an id gets the component of rows with an id and an equal set of shingles,
    and is not kept then. It is not searched for near texts: without such a row its component is
    null and it is kept.
    """
    rows = checkpoint(sketch(docs, size))
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = checkpoint(rows.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")).where("rep is not null"))
    one = classes.groupBy("rep").agg(F.min("sig").alias("sig"))  # ids on several rows, with different texts
    repeated = filled.groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select("doc_id")

    bound = distance_bound(threshold)
    keys = bucket_keys(classes, chunks(bound))
    shared = checkpoint(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    buckets = keys.join(shared, "key").join(one, "rep")
    near = connected_components(candidates(buckets, bound))
    long_ = classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles"))
    confirmed = links(checkpoint(near.select(F.col("node").alias("rep"), "component").join(long_, "rep")), docs, size, threshold)

    final = connected_components(confirmed)
    by_class = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("f1", "f2", "n_shingles", "n", F.coalesce("component", "rep").alias("own"))
    lowest = by_class
    if repeated.limit(1).count():  # an id on rows with different texts links their classes
        ends = filled.join(repeated, "doc_id", "left_semi").join(by_class, ["f1", "f2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("own").alias("b"))
        again = connected_components(ends)
        lowest = by_class.join(again.select(F.col("node").alias("own"), "component"), "own", "left").select("f1", "f2", "n_shingles", "n", F.coalesce("component", "own").alias("own"))
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = join_counted(rows.where("n_shingles > 0"), lowest, ["f1", "f2", "n_shingles"], "left").select("doc_id", "n_shingles", F.col("own").alias("component_id"))
    return found.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each group, all columns as they were."""
    dropped = near_duplicates(docs, size, threshold).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["_gone"], "left_anti")
