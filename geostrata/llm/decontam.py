"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The benchmark's n-gram windows are hashed into a sorted array that is broadcast behind a check
of its size. A larger benchmark is cut into blocks of items within that bound, which are collected,
broadcast, scanned and freed one after another, so neither the driver nor a worker ever holds more
than one. Training texts are tokenised and their windows hashed in vectorised numpy; every hash hit
is verified word by word before it counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import blocks, constants, hash_runs, lower_ascii, mapped, mix, runs
from geostrata.runtime import checkpoint

WINDOW = 10
#: The broadcast's bound: characters of benchmark text in one pass over the documents.
BLOCK_CHARS = 10_000_000
#: Characters of a piece of an item that is too long for one block.
PIECE_CHARS = 1_000_000
_STEP = constants(64, 91)
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

_INSIDE = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):  # 0-9, a-z and every byte of a character beyond ASCII
    _INSIDE[_a:_b] = True


def _words(data: np.ndarray, offsets: np.ndarray):
    low = lower_ascii(data)
    starts, ends, rows = runs(_INSIDE[low], offsets)
    return low, starts, ends, rows, hash_runs(low, starts, ends)


class NgramSet:
    """The windows of some items, in arrays: about 40 bytes a word besides the words themselves.

    Items' words are numbered by text (``ids``) and stand one after another. For each length, equal
    windows are one entry: its hash, a place where it stands, and the items that hold it.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.names = [i for i, _ in items]
        vocabulary: dict[bytes, int] = {}
        ids, hashes, owner = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for at, data, offsets in blocks(pa.array([t for _, t in items], pa.large_string())):
            low, starts, ends, rows, own = _words(data, offsets)
            ids.append(np.array([vocabulary.setdefault(low[s:e].tobytes(), len(vocabulary)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int32))
            hashes.append(own)
            owner.append((rows + at).astype(np.int32))
        self.ids, hashes, owner = np.concatenate(ids), np.concatenate(hashes), np.concatenate(owner)
        self.words = list(vocabulary)
        self.known = np.unique(hashes)
        first, last = (np.searchsorted(owner, owner, side=s) for s in ("left", "right"))
        short = np.flatnonzero((last - first < window) & (first == np.arange(len(owner))))
        self.by: dict[int, tuple] = {}
        for n in {window, *(last - first)[short].tolist()}:
            starts = np.flatnonzero(np.arange(len(owner)) + n <= last) if n == window else short[(last - first)[short] == n]
            if len(starts):
                self.by[n] = self._entries(starts, n, hashes, owner)

    def _entries(self, starts: np.ndarray, n: int, hashes: np.ndarray, owner: np.ndarray) -> tuple:
        """(hashes in order, a place, first item number and end of each entry; item numbers)."""
        with np.errstate(over="ignore"):
            h = np.zeros(len(starts), np.uint64)
            for k in range(n):
                h += hashes[starts + k] * _STEP[k % 64]
            h = mix(h)
        order = np.lexsort((owner[starts], h))
        h, starts = h[order], starts[order]
        same = lambda x, y: np.all([self.ids[x + k] == self.ids[y + k] for k in range(n)], axis=0)
        new = np.concatenate(([True], h[1:] != h[:-1]))
        lead = starts[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        if not same(starts, lead).all():  # different windows with one hash: each set of equal words is an entry
            order = sorted(range(len(h)), key=lambda i: (h[i], self.ids[starts[i] : starts[i] + n].tolist(), owner[starts[i]]))
            h, starts = h[order], starts[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | ~same(starts[1:], starts[:-1])))
        entry, item = np.cumsum(new) - 1, owner[starts]
        fresh = np.concatenate(([True], (entry[1:] != entry[:-1]) | (item[1:] != item[:-1])))
        cuts = np.searchsorted(entry[fresh], np.arange(entry[-1] + 2))
        return h[new], starts[new], cuts, item[fresh]

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """(words, starts, ends, rows, hit word flags, {row: items}) of a block of texts."""
        low, starts, ends, rows, hashes = _words(data, offsets)
        hit, items = np.zeros(len(starts), bool), {}
        if not len(self.known) or not len(hashes):
            return low, starts, ends, rows, hit, items
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        known = self.known[at] == hashes
        sums = np.concatenate(([0], np.cumsum(known)))
        for n, (keys, place, cuts, of) in self.by.items():
            if len(hashes) < n:
                continue
            full = np.flatnonzero((sums[n:] - sums[:-n] == n) & (rows[n - 1 :] == rows[: len(rows) - n + 1]))
            if not len(full):
                continue
            h = np.zeros(len(full), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h += hashes[full + k] * _STEP[k % 64]
            h = mix(h)
            left, right = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            found = left < right
            for p, i, j in zip(full[found].tolist(), left[found].tolist(), right[found].tolist(), strict=True):
                words = [low[s:e].tobytes() for s, e in zip(starts[p : p + n].tolist(), ends[p : p + n].tolist(), strict=True)]
                for entry in range(i, j):
                    if words == [self.words[w] for w in self.ids[place[entry] : place[entry] + n].tolist()]:
                        hit[p : p + n] = True
                        items.setdefault(int(rows[p]), set()).update(of[cuts[entry] : cuts[entry + 1]].tolist())
        return low, starts, ends, rows, hit, {r: {self.names[i] for i in own} for r, own in items.items()}


def _pieces(text: str, window: int, chars: int) -> Iterator[str]:
    """A text's words in pieces of about ``chars`` characters that overlap by ``window`` - 1 words.

    Each window lies in a piece. A piece has ``window`` words or more, unless the text has fewer.
    """
    held: list[str] = []
    size = 0
    for m in _WORD.finditer(text):
        if len(held) >= window and size + len(m.group()) > chars:
            yield " ".join(held)
            held = held[len(held) - window + 1 :]
            size = sum(map(len, held)) + len(held)
        held.append(m.group())
        size += len(held[-1]) + 1
    if held:
        yield " ".join(held)


def _cut_items(items: DataFrame, window: int, block_chars: int) -> DataFrame:
    """``items`` with each text of more than ``block_chars`` characters in pieces under its id."""

    def kernel(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                for piece in _pieces(text, window, min(block_chars, PIECE_CHARS)) if len(text) > block_chars else [text]:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([piece], batch.column(1).type)], ["item_id", "text"])

    return mapped(items, kernel, items.schema)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, window: int = WINDOW) -> Iterator[list[tuple[int, str | None]]]:
    """The items in lists of bounded size. An item beyond the bound comes in pieces that share its id.

    ``block_chars`` must hold a window of one-letter words; a single window beyond it is a block.
    """
    if block_chars < 2 * window - 1:
        raise ValueError(f"block_chars is {block_chars}; a window of {window} words has {2 * window - 1} characters or more")
    # the sizes alone; texts come with the blocks
    measure = lambda d: d.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("most")).first()
    items = benchmark.where("text is not null").select("item_id", "text")
    size = measure(items)
    if size["most"] > block_chars:
        items = checkpoint(_cut_items(items, window, block_chars))
        size = measure(items)
    parts = max(1, -(-2 * int(size["n"]) // block_chars))
    if parts == 1:
        yield [(r["item_id"], r["text"]) for r in items.collect()]
        return
    cut = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for p in range(parts):
        held: list[tuple[int, str | None]] = []
        chars = 0
        for r in cut.where(F.col("part") == p).toLocalIterator():
            if held and chars + len(r["text"]) > block_chars:
                yield held
                held, chars = [], 0
            held.append((r["item_id"], r["text"]))
            chars += len(r["text"])
        if held:
            yield held


def _joined(ids) -> str:
    return ",".join(sorted(map(str, ids)))


def _flagged(batch: pa.RecordBatch, grams: NgramSet | None, marks: list | None):
    """For each block of a batch's texts: (first row, offsets, starts, ends, rows, hit flags, {row: items}).

    Hits come from a set of n-grams or from ``marks``, the numbers of a row's hit words.
    """
    for at, data, offsets in blocks(batch.column("text")):
        if grams is not None:
            _, starts, ends, rows, hit, found = grams.scan(data, offsets)
        else:
            _, starts, ends, rows, _ = _words(data, offsets)
            hit, found, first = np.zeros(len(starts), bool), {}, np.searchsorted(rows, np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                if marks[at + r]:
                    hit[first[r] + np.array(marks[at + r])] = True
        yield at, data, offsets, starts, ends, rows, hit, found


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> tuple[DataFrame, object | None]:
    """``docs`` and the broadcast n-grams; or, for a benchmark of several blocks, ``docs`` with two columns more: hit words and items.

    Each of several blocks is scanned in a pass of its own, whose hits are written before the next
    one is collected. The passes' hits are put together by document (its id and its text's hash).
    """
    sc = docs.sparkSession.sparkContext
    each = item_blocks(benchmark, block_chars, window)
    block, after = next(each, []), next(each, None)
    if after is None:
        return docs, sc.broadcast(NgramSet(block, window))

    def scan(grams):
        def kernel(batches):
            for batch in batches:
                row, marks, items = [], [], []
                for at, _, offsets, _, _, rows, hit, found in _flagged(batch, grams.value, None):
                    first = np.searchsorted(rows, np.arange(len(offsets)))
                    for r, of in found.items():
                        row.append(at + r)
                        marks.append(np.flatnonzero(hit[first[r] : first[r + 1]]).astype(np.int32))
                        items.append(sorted(map(str, of)))
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(marks, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["_id", "_h", "m", "i"])

        keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
        return checkpoint(mapped(keyed, kernel, f"_id {docs.schema['doc_id'].dataType.simpleString()}, _h long, m array<int>, i array<string>"))

    hits = None
    while block is not None:
        grams = sc.broadcast(NgramSet(block, window))
        part = scan(grams)
        grams.destroy()
        hits = part if hits is None else hits.unionByName(part)
        block, after = after, next(each, None)
    hits = hits.groupBy("_id", "_h").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("m")))).alias("m"), F.array_distinct(F.flatten(F.collect_list("i"))).alias("i"))
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits["_id"]) & (F.xxhash64(docs["text"]) == hits["_h"]), "left")
    taken = {c.lower() for c in docs.columns}
    marks, items = (next(x for n in range(len(taken) + 1) if (x := name + "_" * n) not in taken) for name in ("_marks", "_items"))
    return joined.select(*(docs[c] for c in docs.columns), hits["m"].alias(marks), hits["i"].alias(items)), None


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean; so is a document over an empty benchmark.
    Items that are null or hold no word have no window. An item with a null id counts as an item
    ``None``. Rows with equal or null doc_id stay separate rows, and other columns are ignored.
    """
    marked, grams = _with_hits(docs.select("doc_id", "text"), benchmark, window, block_chars)

    def kernel(batches):
        for batch in batches:
            n, own = batch.num_rows, grams.value if grams else None
            words, hits, items = np.zeros(n, np.int64), np.zeros(n, np.int64), [set() for _ in range(n)]
            if not grams:
                items = [set(x or ()) for x in batch.column("_items").to_pylist()]
            for at, _, offsets, _, _, rows, hit, found in _flagged(batch, own, None if grams else batch.column("_marks").to_pylist()):
                for r, of in found.items():
                    items[at + r] = of
                m = len(offsets) - 1
                words[at : at + m] = np.bincount(rows, minlength=m)
                hits[at : at + m] = np.bincount(rows[hit], minlength=m)
            sha = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(hits), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(hits > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(marked, kernel, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "spans", window: int = WINDOW, max_share: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without benchmark passages, all columns kept.

    ``action="documents"`` drops every document with a hit. ``action="spans"`` cuts each maximal
    run of hit words, together with what lies between them, out of the text, and drops a document
    only where more than ``max_share`` of its words are hit. Null texts stay null. ``n_chars``,
    where the table has it, follows the new text.
    """
    if action not in ("spans", "documents"):
        raise ValueError(f"action {action!r} is not 'spans' or 'documents'")
    marked, grams = _with_hits(docs, benchmark, window, block_chars)
    width = len(docs.columns)

    def kernel(batches):
        for batch in batches:
            texts, keep, changed = batch.column("text"), np.ones(batch.num_rows, bool), {}
            marks = None if grams else batch.column(width).to_pylist()
            for at, data, offsets, starts, ends, rows, hit, _ in _flagged(batch, grams.value if grams else None, marks):
                for r in np.unique(rows[hit]).tolist():
                    own = np.flatnonzero(rows == r)
                    if action == "documents" or hit[own].sum() > max_share * len(own):
                        keep[at + r] = False
                        continue
                    drop = np.zeros(int(offsets[r + 1] - offsets[r]), bool)
                    marked_words = own[hit[own]]
                    for part in np.split(marked_words, np.flatnonzero(np.diff(marked_words) > 1) + 1):
                        drop[starts[part[0]] - offsets[r] : ends[part[-1]] - offsets[r]] = True
                    changed[at + r] = data[offsets[r] : offsets[r + 1]][~drop].tobytes().decode()
            batch = pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width])
            if changed:
                new = texts.to_pylist()
                for i, t in changed.items():
                    new[i] = t
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, texts.type))
            yield batch if keep.all() else batch.filter(pa.array(keep))

    out = mapped(marked, kernel, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
