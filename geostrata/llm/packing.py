"""Packing by power-of-two decomposition.

A document of L ids is split into pieces whose lengths are powers of two of at most ``max_len``:
full pieces of ``max_len`` first, then the binary digits of the rest, longest first. Each piece
is a sequence of its own, so no sequence crosses documents, none needs padding, and sequences
of one length form a bucket that a trainer batches together.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from geostrata.llm.common import mapped

MAX_LEN = 2048
#: Entries of a worker's table of ids by white-space chunk. Beyond that it starts anew, and what is met
#: again comes from the table before.
CACHE_ENTRIES = 200_000
END_ID = 1

_LATIN = re.compile("[\x00-\xff]*")
# what the tokenizer joins as punctuation, the underscore included
_PUNCTUATION = re.escape("".join(c for c in map(chr, range(256)) if not c.isalnum() and not c.isspace()))
_PAIR = re.compile(f"[{_PUNCTUATION}][{_PUNCTUATION}]")
_EDGE = re.compile(r"(?<=[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff])(?=[^\w\s'])")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class ChunkEncoder:
    """A text's ids as little-endian unsigned 32-bit bytes, from ids remembered by chunk.

    The tokenizer of ``word_bpe_49k.json`` lower-cases and never joins across white space, so a
    text's ids are those of its white-space chunks in turn. In a Latin-1 text a pre-token ends
    between a letter and punctuation, and without runs of punctuation a comma or full stop is one
    of its own, so a space there changes no id and lets far fewer distinct chunks arise. A text with ``<|`` (special tokens are matched
    in the raw text) or with separators that Python and the tokenizer see differently is encoded
    whole.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.entries, self.ids, self.before = Tokenizer.from_file(path), entries, {}, {}
        # the same vocabulary for words that need neither folding nor splitting
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.final = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.final[i] = token.endswith("</w>")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: set[str]) -> None:
        words = [w for w in missing if w.isalpha() and _LATIN.fullmatch(w) and w == w.lower()]
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            raw, a = ids.tobytes(), 0
            for w, b in zip(part, ((np.flatnonzero(self.final[ids]) + 1) * 4).tolist(), strict=True):
                self.ids[w] = raw[a:b]
                a = b
        self.ids.update((w, self._whole(w)) for w in missing.difference(words))

    def encode(self, text: str) -> bytes:
        if "<|" in text or _ODD_SPACE.search(text):
            return self._whole(text)
        if _LATIN.fullmatch(text):
            text = text.lower()
            text = _EDGE.sub(" ", text) if _PAIR.search(text) else text.replace(",", " ,").replace(".", " .")
        chunks = text.split()
        found = list(map(self.ids.get, chunks))
        if None in found:
            if len(self.ids) > self.entries:
                self.before, self.ids, found = self.ids, {}, [None] * len(chunks)
            missing = {c for c, x in zip(chunks, found, strict=True) if x is None}
            known = missing & self.before.keys()
            self.ids.update((c, self.before[c]) for c in known)
            self._learn(missing - known)
            found = map(self.ids.__getitem__, chunks)
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """A worker's encoder, whose table serves all of its tasks."""
    return ChunkEncoder(path)


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, in order."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    A null or empty text is the end id alone: one piece of length 1. Rows with equal or null
    doc_id are separate documents. ``sequence_id`` holds the bucket, the input partition and the
    piece's number there, so ids are unique without a shuffle and those of one bucket lie
    together. ``max_len`` must be a power of two.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def kernel(batches):
        encode = encoder(tokenizer_path).encode
        end, done, part = np.array([end_id], "<u4").tobytes(), 0, TaskContext.get().partitionId()
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = (encode(text) if text else b"") + end
                view, n, at = memoryview(raw), len(raw) // 4, 0
                for k in piece_lengths(n, max_len):
                    row.append(i)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(view[4 * at : 4 * (at + k)]))
                    if with_ids:
                        ids.append(np.frombuffer(view[4 * at : 4 * (at + k)], "<u4"))
                    total.append(n)
                    at += k
            size = np.array(length, np.int64)
            bucket = np.log2(np.maximum(size, 1)).astype(np.int64)
            sequence = (bucket << 56) + (part << 32) + np.arange(done, done + len(size))
            done += len(size)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(sequence), pa.array(np.zeros(len(size), np.int64)), pa.array(bucket.astype(np.int32))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<int>" * with_ids
    return mapped(docs.select("doc_id", "text"), kernel, schema)
