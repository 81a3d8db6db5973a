"""Helpers shared by the operators: Arrow text blocks, hashing, sorted group streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one key may have in a shuffled join.
HOT_ROWS = 100_000
#: Bytes of an Arrow batch that goes to a Python worker: ten thousand long texts at once would fill several copies of it.
BATCH_BYTES = 4_000_000
#: Bytes of text that a kernel works on at once; a longer single text makes a block of its own.
BLOCK_BYTES = 160_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        x = mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(seed))
    return x | np.uint64(1)


_PLACES = constants(4096, 17)


def _places(n: int) -> np.ndarray:
    global _PLACES
    if n > len(_PLACES):
        _PLACES = constants(max(n, 2 * len(_PLACES)), 17)
    return _PLACES


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, row offsets) of slices of at most ``limit`` bytes; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ``inside`` bytes; a run never spans two rows."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run: a multilinear form of its bytes and length, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    before = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(before, lengths)
    took = data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        took *= _places(int(lengths.max()))[place]
        return mix(np.add.reduceat(took, before) + lengths.astype(np.uint64) * _GOLD)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return data + ((data >= 65) & (data <= 90)) * np.uint8(32)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``; about ``rows`` rows at a time."""
    held: list[pa.Table] = []
    n = 0

    def split(t: pa.Table) -> int:
        """Rows before the last group."""
        last = t.slice(t.num_rows - 1)
        same = None
        for k in keys:
            here = pc.fill_null(pc.equal(t[k], last[k][0]), False)
            same = here if same is None else pc.and_(same, here)
        different = np.flatnonzero(~same.to_numpy(zero_copy_only=False))
        return int(different[-1]) + 1 if len(different) else 0

    for b in batches:
        if b.num_rows:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
        if n >= rows:
            t = pa.concat_tables(held).combine_chunks()
            if at := split(t):
                yield t.slice(0, at)
                held = [t.slice(at)]
            else:
                held = [t]
            n = held[0].num_rows if at else 0
    if held and (t := pa.concat_tables(held).combine_chunks()).num_rows:
        yield t


def join_counted(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot: int | None = None) -> DataFrame:
    """``left`` joined with one row a key of ``right``, whose column ``n`` tells how many rows of ``left`` have it.

    Keys with more than ``hot`` rows are broadcast, of which there are at most (rows of ``left``) /
    ``hot``; their rows stay where they are instead of meeting in one task. The rest is sorted and merged at
    every size. ``n`` is dropped.
    """
    hot = HOT_ROWS if hot is None else hot
    many, few = right.where(F.col("n") > hot).drop("n"), right.where(F.col("n") <= hot).drop("n")
    rest = left.join(F.broadcast(many.select(*on)), on, "left_anti").join(few.hint("merge"), on, how)
    return left.join(F.broadcast(many), on).unionByName(rest)


def mapped(rows: DataFrame, kernel, schema) -> DataFrame:
    """``rows.mapInArrow`` in batches of about ``BATCH_BYTES``, unless the session names a bound of its own."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) in (None, "67108864b"):  # Spark's default
        conf.set(name, str(BATCH_BYTES))
    return rows.mapInArrow(kernel, schema)
