"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's subwords (1 to 3 bytes of its lower-cased text, with at least one letter) are hashed
into buckets, each with an embedding; their mean goes through a linear softmax. Embeddings and
weights are trained together by stochastic gradient descent in numpy, a part of the sample sets
the temperature of the probabilities and the score below which a prediction is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import blocks, mapped

BITS, DIM = 14, 16
#: Bound on the documents that the model is trained and calibrated on.
MAX_TRAIN = 3_000
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint32)
_FOLD[65:91] += 32


def subwords(data: np.ndarray, offsets: np.ndarray):
    """For n of 1 to 3: buckets of all subwords of a block and their rows' first places."""
    folded, letter = _FOLD[data], _LETTER[data]
    n_bytes = len(data)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    value, has = np.zeros(n_bytes, np.uint32), np.zeros(n_bytes, bool)
    for n in (1, 2, 3):
        if n_bytes < n:
            return
        m = n_bytes - n + 1
        value[:m] |= folded[n - 1 :] << np.uint32(8 * (n - 1))
        has[:m] |= letter[n - 1 :]
        at = np.flatnonzero(has[:m] & (np.arange(n, n_bytes + 1) <= row_end[:m]))
        with np.errstate(over="ignore"):
            bucket = ((value[at] + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        yield bucket, np.searchsorted(at, offsets)


def sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sum of the table's rows over its subwords, and their number."""
    total, count = np.zeros((len(offsets) - 1, table.shape[1])), np.zeros(len(offsets) - 1)
    for bucket, cuts in subwords(data, offsets):
        count += np.diff(cuts)
        for k in range(table.shape[1]):
            run = np.concatenate(([0.0], np.cumsum(table[bucket, k], dtype=np.float64)))
            total[:, k] += run[cuts[1:]] - run[cuts[:-1]]
    return total, count


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # logits by bucket: the embeddings times the softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(ids: list[np.ndarray], counts: list[np.ndarray], langs: list[str], epochs: int = 12, rate: float = 2.0, batch: int = 32, target: float = 0.99) -> Model:
    """Train on four fifths of the documents and calibrate on the rest.

    Below 50 documents a fifth of them says too little: all are used for both, so the rejection
    threshold is then too kind.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 1.0)
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    few = len(y) < 50
    own, rest = (order, order) if few else (order[len(y) // 5 :], order[: len(y) // 5])
    emb, w, b = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    share = [(c / max(c.sum(), 1)).astype(np.float32) for c in counts]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        own = rng.permutation(own)
        for i in range(0, len(own), batch):
            part = own[i : i + batch]
            where = np.concatenate([ids[d] for d in part])
            used, inverse = np.unique(where, return_inverse=True)
            x = np.zeros((len(part), len(used)), np.float32)
            np.add.at(x, (np.repeat(np.arange(len(part)), [len(ids[d]) for d in part]), inverse), np.concatenate([share[d] for d in part]))
            hidden = x @ emb[used]
            z = hidden @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            grad = x.T @ (p @ w.T)
            w -= step * (hidden.T @ p)
            b -= step * p.sum(0)
            emb[used] -= step * len(used) ** 0.5 * grad
    table = (emb @ w).astype(np.float64)
    model = Model(names, table, b.astype(np.float64), 1.0, 0.0)
    total = np.array([(table[ids[d]] * counts[d][:, None]).sum(0) for d in rest])
    count = np.array([counts[d].sum() for d in rest], float)

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(total, count)[np.arange(len(rest)), y[rest]], 1e-12)).mean()

    model.temperature = min(np.geomspace(0.3, 5, 41).tolist(), key=loss)
    p = model.probabilities(total, count)
    score, right = p.max(1), p.argmax(1) == y[rest]
    down = np.argsort(-score)
    good = np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= target
    model.reject_below = float(score[down][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 1 on division by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """The model of at most ``max_train`` documents with a language, not held out, by smallest id hash.

    What the driver receives is at most 2**BITS bucket counts a document.
    """
    chosen = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    ids = chosen.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    one = F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("one")  # of rows with one id
    rows = chosen.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.*")

    def kernel(batches):
        for batch in batches:
            ids, counts = [], []
            for _, data, offsets in blocks(batch.column("text")):
                parts = list(subwords(data, offsets))
                for r in range(len(offsets) - 1):
                    own = np.concatenate([b[c[r] : c[r + 1]] for b, c in parts]) if parts else np.zeros(0, np.uint32)
                    found, n = np.unique(own, return_counts=True)
                    ids.append(found.astype(np.int32))
                    counts.append(n.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["id", "lang", "ids", "counts"])

    found = mapped(rows, kernel, "id string, lang string, ids array<int>, counts array<float>").toArrow().sort_by([("id", "ascending"), ("lang", "ascending")])
    as_arrays = lambda name: [np.asarray(x.values.to_numpy()) for x in found[name]]
    return fit(as_arrays("ids"), as_arrays("counts"), found["lang"].to_pylist())


def identify(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected.

    ``lang_pred`` is a language of the sample, or ``und`` with score 0 where the text is null or
    has no letter (or nothing could be learned). ``rejected``: such a row, or one whose score lies
    below the threshold that kept 99 % of the calibration rows above it right. Rows with equal or
    null doc_id stay separate rows; long texts are read as a whole; an empty table gives none;
    other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, max_train))

    def kernel(batches):
        m = model.value
        for batch in batches:
            lang, score = [], []
            texts = batch.column("text")
            for at, data, offsets in blocks(texts):
                total, count = sums(data, offsets, m.table)
                ascii_letters = np.concatenate(([0], np.cumsum(_LETTER[data] & (data < 128))))
                has = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for r in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
                    has[r] = any(map(str.isalpha, texts[at + r].as_py()))
                if not m.langs:
                    has[:] = False
                    best, p = np.zeros(len(has), np.int64), np.zeros(len(has))
                else:
                    all_p = m.probabilities(total, count)
                    best, p = all_p.argmax(1), all_p.max(1)
                lang += [m.langs[i] if h else UNKNOWN for i, h in zip(best.tolist(), has.tolist(), strict=True)]
                score += np.where(has, p, 0.0).tolist()
            s = np.array(score, float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(s), pa.array((s < m.reject_below) | np.array([x == UNKNOWN for x in lang], bool))], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", held_out().alias("held_out"), "text"), kernel, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
