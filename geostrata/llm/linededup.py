"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

Each non-blank line is a position (document, place). Ranks of positions by their first 2^k lines
come from ranks by 2^(k-1) lines: pairs of ranks are sorted over range partitions and numbered.
A position whose rank nobody shares can't start a repeated run and leaves the rounds, so rounds
work on repeated lines only, and a run of ``min_words`` words has at most that many lines, which
bounds the rounds at log2(min_words) + 1 whatever the corpus.

Positions that share their first L lines are a longest-common-prefix interval of the suffix
array; the ranks of its two overlapping blocks of 2^k lines name it. For every position the
shortest run of at least ``min_words`` words that starts there, and the one that ends there, is
looked up. A run whose interval has an earlier position is a later copy. The union of those runs
is the union of all maximal repeated runs of ``min_words`` words or more, without their first
occurrences: deleting it keeps at least one copy of every line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import blocks, hash_runs, join_counted, mapped, mix, runs
from geostrata.runtime import checkpoint

MIN_WORDS = 50

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Non-blank lines of a block: starts, ends, rows, words, two hashes."""
    starts, ends, rows = runs(data != 10, offsets)
    begin, _, _ = runs(~_BLANK[data], offsets)
    words = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    full = words > 0
    starts, ends, rows, words = starts[full], ends[full], rows[full], words[full]
    with np.errstate(over="ignore"):
        first, second = hash_runs(data, starts, ends), hash_runs(255 - data, starts, ends)
        return starts, ends, rows, words, first, mix(second * _SECOND + first)


def _positions(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per non-blank line: doc_id, h (the text's hash), at, x1, x2 (the line's), ahead and back.

    ``ahead`` lines from here, or ``back`` lines up to here, are the shortest run with
    ``min_words`` words; 0 where the document ends before.
    """

    def kernel(batches):
        for batch in batches:
            ids, hs = batch.column("doc_id"), batch.column("h")
            for at, data, offsets in blocks(batch.column("text")):
                _, _, rows, words, x1, x2 = _lines(data, offsets)
                total = np.concatenate(([0], np.cumsum(words)))
                row_first = np.searchsorted(rows, rows, side="left")
                row_end = np.searchsorted(rows, rows, side="right")
                here = np.arange(len(rows))
                stop = np.searchsorted(total, total[:-1] + min_words, side="left")
                ahead = np.where(stop <= row_end, stop - here, 0)
                begin = np.searchsorted(total, total[1:] - min_words, side="right") - 1
                back = np.where(begin >= row_first, here + 1 - begin, 0)
                take = pa.array(rows + at)
                yield pa.RecordBatch.from_arrays([ids.take(take), hs.take(take), *(pa.array(x.astype(np.int32)) for x in (here - row_first, ahead, back)), pa.array(x1.view(np.int64)), pa.array(x2.view(np.int64))], ["doc_id", "h", "at", "ahead", "back", "x1", "x2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where("text is not null")
    return mapped(keyed, kernel, f"doc_id {kind}, h long, at int, ahead int, back int, x1 long, x2 long")


def _ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """``classes`` with ``rank``, their dense number in the order of ``keys``: sorted over range partitions."""

    def number(batches):
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield b.append_column("part", pa.array(np.full(n, part, np.int32))).append_column("place", pa.array(np.arange(done, done + n)))
            done += n

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = classes.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    numbered = checkpoint(mapped(ordered, number, f"{fields}, part int, place long"))
    counts = sorted((r["part"], r["n"]) for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    offset, rows = 0, []
    for part, size in counts:  # as many as partitions
        rows.append((part, offset))
        offset += size
    offsets = classes.sparkSession.createDataFrame(rows, "part int, before long")
    return numbered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Windows (doc_id, h, at, size) of non-blank lines that repeat an earlier run of the corpus.

    Earlier: by doc_id (null first), then the text's hash, then the place. Rows that agree in
    doc_id and text are one document and are not copies of each other.
    """
    places = checkpoint(_positions(docs, min_words).dropDuplicates(["doc_id", "h", "at"]))
    place = F.struct("doc_id", "h", "at")
    lines = places.groupBy("x1", "x2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranks = checkpoint(join_counted(places, _ranked(lines, ["x1", "x2"]), ["x1", "x2"]).select("doc_id", "h", "at", "ahead", "back", "rank"))
    windows = ranks.where("ahead > 0").select("doc_id", "h", "at", F.col("ahead").alias("size"))
    windows = windows.unionByName(ranks.where("back > 1").select("doc_id", "h", (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("size"))).distinct()
    windows = checkpoint(windows)
    longest = windows.agg(F.max("size")).first()[0] or 0
    found, k = None, 0
    same = lambda x, y: [x["doc_id"].eqNullSafe(y["doc_id"]), x["h"] == y["h"], x["at"] == y["at"]]
    while 2**k <= longest:
        block = 2**k
        own = windows.where((F.col("size") >= block) & (F.col("size") < 2 * block))
        head = ranks.select("doc_id", "h", "at", "rank")
        named = own.join(head.hint("merge"), same(own, head)).select(own["doc_id"], own["h"], own["at"], "size", F.col("rank").alias("r1"))
        if block > 1:
            tail = ranks.select("doc_id", "h", (F.col("at")).alias("at"), F.col("rank").alias("r2"))
            shifted = named.withColumn("to", F.col("at") + F.col("size") - block)
            named = shifted.join(tail.hint("merge"), [shifted["doc_id"].eqNullSafe(tail["doc_id"]), shifted["h"] == tail["h"], shifted["to"] == tail["at"]]).select(shifted["doc_id"], shifted["h"], shifted["at"], "size", "r1", "r2")
        else:
            named = named.withColumn("r2", F.col("r1"))
        named = checkpoint(named)
        first = checkpoint(named.groupBy("size", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        copies = join_counted(named, first, ["size", "r1", "r2"]).where(place > F.col("first")).select("doc_id", "h", "at", "size")
        found = copies if found is None else found.unionByName(copies)
        if 2 * block > longest:
            break
        left, right = ranks.select("doc_id", "h", "at", F.col("rank").alias("r1")), ranks.select("doc_id", "h", (F.col("at") - block).alias("at"), F.col("rank").alias("r2"))
        pairs = checkpoint(left.join(right.hint("merge"), same(left, right)).select(left["doc_id"], left["h"], left["at"], "r1", "r2"))
        classes = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        ranks = checkpoint(join_counted(pairs, _ranked(classes, ["r1", "r2"]), ["r1", "r2"]).select("doc_id", "h", "at", "rank"))
        k += 1
    return found if found is not None else windows.limit(0)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, deleted): per document with copies, the sorted places of its lines to delete."""
    copies = later_copies(docs, min_words)
    lines = copies.select("doc_id", "h", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("line"))
    return lines.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line")).alias("deleted"))


def _with_deleted(docs: DataFrame, min_words: int) -> tuple[DataFrame, str, str]:
    names, taken = [], {c.lower() for c in docs.columns}
    for base in ("_deleted", "_h"):
        while base in taken:
            base += "_"
        names.append(base)
    deleted, h = names
    found = checkpoint(repeated_lines(docs, min_words)).select(F.col("doc_id").alias("_id"), F.col("h").alias("_of"), F.col("deleted").alias("_lines"))
    own = docs.withColumn(h, F.xxhash64("text"))
    joined = own.join(found.hint("merge"), own["doc_id"].eqNullSafe(found["_id"]) & (own[h] == found["_of"]), "left")
    return joined.select(*(own[c] for c in docs.columns), found["_lines"].alias(deleted)), deleted, h


def _without(text: str, lines: set[int]) -> tuple[str, int]:
    """``text`` without its non-blank lines numbered in ``lines``, and how many of those it has."""
    kept, place = [], 0
    for line in text.split("\n"):
        if line.strip("\t\n\x0b\x0c\r "):
            if place not in lines:
                kept.append(line)
            place += 1
        else:
            kept.append(line)
    return "\n".join(kept), place


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without later copies of repeated line runs, all columns kept.

    ``n_chars``, where the table has it, follows the new text. A document of which no non-blank
    line stays is dropped unless ``drop_emptied`` is false. Null and empty texts stay as they are.
    """
    marked, deleted, _ = _with_deleted(docs, min_words)
    at = docs.columns.index("text")

    def kernel(batches):
        for batch in batches:
            lines = batch.column(len(docs_columns))
            keep, texts = np.ones(batch.num_rows, bool), batch.column(at)
            touched = np.flatnonzero(lines.is_valid().to_numpy(zero_copy_only=False))
            batch = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            if len(touched):
                new = texts.to_pylist()
                for i in touched.tolist():
                    drop = set(lines[i].as_py())
                    new[i], n = _without(new[i], drop)
                    keep[i] = not drop_emptied or len(drop) < n
                batch = batch.set_column(at, batch.schema.names[at], pa.array(new, texts.type))
            yield batch.filter(pa.array(keep))

    docs_columns = docs.columns
    out = mapped(marked, kernel, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, n_lines (not blank), n_deleted, deleted (their places, comma-joined), text_sha256 (of what stays).

    A null text reads as empty. Rows that agree in doc_id and text are one document and lose the
    same lines; among equal runs the one of the lowest doc_id (null first) stays. Long texts are
    read as a whole; an empty table gives none; other columns are ignored.
    """
    marked, deleted, _ = _with_deleted(docs.select("doc_id", "text"), min_words)

    def kernel(batches):
        import hashlib

        for batch in batches:
            total, gone, joined, sha = [], [], [], []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column(deleted).to_pylist(), strict=True):
                left, n = _without(text or "", set(lines or ()))
                total.append(n)
                gone.append(len(lines or ()))
                joined.append(",".join(map(str, lines or ())))
                sha.append(hashlib.sha256(left.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(joined, pa.string()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_deleted", "deleted", "text_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(marked, kernel, f"doc_id {kind}, n_lines long, n_deleted long, deleted string, text_sha256 string")
