"""Token counts by a linear longest-match automaton.

The vocabulary (byte strings) becomes a trie. Each node has a failure link: when no edge fits the
next byte, greedy matching would emit some tokens and go on at another node; the number of those
tokens is precomputed with the link ("popped tokens"), so a word's length in pieces is found in
one pass over its bytes without building a piece. A node can lie inside a token, and then what
it pops is the greedy split of its own string.
"""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geostrata.llm.common import mapped

#: Entries of a worker's table of counts by chunk; it starts anew beyond that.
CACHE_ENTRIES = 150_000


class LongestMatch:
    """The automaton of a vocabulary; every byte that a text holds should be a token.

    A byte that starts no token counts as one token of its own.
    """

    def __init__(self, tokens):
        tokens = set(tokens) | {bytes([b]) for b in range(256)}
        self.edges: list[dict[int, int]] = [{}]
        accepts, depth = [False], [0]
        for t in tokens:
            node = 0
            for b in t:
                nxt = self.edges[node].get(b)
                if nxt is None:
                    nxt = len(self.edges)
                    self.edges[node][b] = nxt
                    self.edges.append({})
                    accepts.append(False)
                    depth.append(depth[node] + 1)
                node = nxt
            accepts[node] = bool(t) or accepts[node]
        n = len(self.edges)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:  # by depth: a node's link leads to a shallower node
            u = queue.popleft()
            for b, v in self.edges[u].items():
                if accepts[v]:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, pops = self.fail[u], self.popped[u]
                    while z != -1 and b not in self.edges[z]:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z != -1:
                        self.fail[v], self.popped[v] = self.edges[z][b], pops
                queue.append(v)

        size = sum(map(len, self.edges))
        at = np.fromiter((u * 256 + b for u, own in enumerate(self.edges) for b in own), np.int64, size)
        to = np.fromiter((v for own in self.edges for v in own.values()), np.int32, size)
        order = np.argsort(at)
        self.at, self.to = at[order], to[order]
        self.fail, self.popped = np.array(self.fail, np.int32), np.array(self.popped, np.int32)
        del self.edges

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Greedy longest-match tokens of each word; all words take a byte at a time, together."""
        length = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-length, kind="stable")  # those that still have bytes come first
        data = np.frombuffer(b"".join(words), np.uint8)
        first = (np.cumsum(length) - length)[order]
        node, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        live = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
        for k, n in enumerate(live.tolist()):
            todo, byte = np.arange(n), data[first[:n] + k]
            while len(todo):
                u = node[todo]
                spot = np.searchsorted(self.at, u.astype(np.int64) * 256 + byte[todo])
                found = self.at[np.minimum(spot, len(self.at) - 1)] == u.astype(np.int64) * 256 + byte[todo]
                node[todo[found]] = self.to[spot[found]]
                todo, u = todo[~found], u[~found]
                total[todo] += self.popped[u]
                node[todo] = self.fail[u]
        left = np.flatnonzero(node)
        while len(left):
            total[left] += self.popped[node[left]]
            node[left] = self.fail[node[left]]
            left = left[node[left] != 0]
        out = np.zeros(len(words), np.int64)
        out[order] = total
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """The automaton of a file of base64 tokens and ranks; of the vocabulary's size, not the input's."""
    with open(path, "rb") as f:
        return LongestMatch(base64.b64decode(line.split()[0]) for line in f if line.strip())


@lru_cache(maxsize=2)
def known_counts(path: str) -> dict[str, int]:
    """A worker's table of counts by chunk, which serves all of its tasks."""
    return {}


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per row: doc_id, n_words, n_tokens, longest_word_tokens.

    A word is a maximal run without white space, read as its UTF-8 bytes after one space. Null
    and empty texts have 0 of each; rows with equal or null doc_id stay separate rows. Long texts
    and words are read as a whole; an empty table gives none; other columns are ignored.
    """

    def kernel(batches):
        counts, cache = automaton(vocabulary_path).counts, known_counts(vocabulary_path)
        for batch in batches:
            chunks = [text.split() if text else [] for text in batch.column("text").to_pylist()]
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            new = list({c for own in chunks for c in own}.difference(cache))
            cache.update(zip(new, counts([b" " + c.encode() for c in new]).tolist(), strict=True))
            each = [[cache[c] for c in own] for own in chunks]
            words, tokens, longest = map(len, each), map(sum, each), (max(x, default=0) for x in each)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), pa.int64()) for x in (words, tokens, longest))], ["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), kernel, f"doc_id {kind}, n_words long, n_tokens long, longest_word_tokens long")
