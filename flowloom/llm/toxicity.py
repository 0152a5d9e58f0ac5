"""Toxicity scores: FTRL-proximal logistic regression over hashed word features.

Features of a text are its distinct words, the 4- and 5-byte heads of words,
word pairs and one-word skip pairs, hashed to ``2**bits`` coordinates
(punctuation splits words here).  Every coordinate has its own learning rate,
and the L1 term keeps a coordinate at zero until its evidence exceeds it, so
the model that travels to the executors is a short list of (coordinate, weight).

Labels are learned from a bounded sample: all labelled rows up to
``max_train_rows`` and ``MAX_TRAIN_BYTES`` of text, beyond that a hash-chosen
share of about that size; one task learns from it, so its memory has the same
bound at any input size.  Rates, penalties and passes were chosen by the log
loss on one fold of the training rows (crc32 mod 5 is 4), never on held-out ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, with_rest
from .textops import U64, Words, iter_words, mix64, pair_hash

MAX_TRAIN_ROWS = 16_000
#: bytes of text to learn from; one longer text is learned from whole, as 2**bits coordinates at most
MAX_TRAIN_BYTES = 256 << 20
BITS = 20


def _features(w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every feature occurrence of a chunk."""
    h, d, shift = w.hash, w.doc, U64(64 - bits)
    one, two = pair_hash(h[:-1], h[1:], 1), pair_hash(h[:-2], h[2:], 2)
    near, skip = d[:-1] == d[1:], d[:-2] == d[2:]
    heads = [mix64(w.head_hash(n) + U64(n)) for n in (4, 5)]
    doc = np.concatenate([d, d, d, d[:-1][near], d[:-2][skip]])
    at = np.concatenate([h, *heads, one[near], two[skip]]) >> shift
    return doc, at.astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal learner over sets of coordinates; the last one is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def word_features(col: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, text of each feature, coordinate) of every chunk of a text column."""
    for w in iter_words(col, letters_only=True):
        yield w.n_docs, *_features(w, bits)


def _train(bits: int, epochs: int, features, rates: dict):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("r", "ascending"), ("text", "ascending"), ("y", "ascending")])
        examples = []
        for n_docs, doc, at in features(rows.column("text").combine_chunks(), bits):
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(1, n_docs))
            examples += [np.append(np.unique(x), 1 << bits).astype(np.int32) for x in np.split(at[order], cut)]
        model, labels = Ftrl(1 << bits, **rates), rows.column("y").to_numpy()
        for e in range(epochs):
            for i in np.random.default_rng(e).permutation(len(examples)):
                model.learn(examples[i], labels[i])
        w = model.weights(np.arange((1 << bits) + 1))
        at = np.flatnonzero(w)
        return pa.table({"at": at, "w": w[at]})

    return run


def fit(labelled: DataFrame, *, bits: int = BITS, epochs: int = 3, features=word_features, **rates) -> dict[int, float]:
    """Weights by coordinate, from rows (doc_id, text, y); at most ``2**bits + 1`` of them."""
    rows = labelled.select(
        F.xxhash64("doc_id").alias("r"), F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int").alias("y")
    )
    learn = _train(bits, epochs, features, rates)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_TRAIN_BYTES:
        rows = rows.where(F.pmod(F.xxhash64("r", F.lit("bytes")), F.lit(1 << 30)) < int(MAX_TRAIN_BYTES / size * (1 << 30)))
    weights = rows.groupBy(F.lit(0).alias("model")).applyInArrow(lambda rows: learn(rows), "at bigint, w double")
    return {r["at"]: r["w"] for r in weights.collect()}


def score_batches(bits: int, model, features=word_features):
    """A map over (doc_id, text[, rest]) batches that adds ``score``; ``model`` is broadcast (coordinates, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << bits) + 1, np.float32)
        at, w = model.value
        dense[at] = w
        for b in batches:
            out = []
            for n_docs, doc, at in features(b.column(1), bits):
                hit = dense[at] != 0
                pairs = np.unique(doc[hit] * (1 << bits) + at[hit])  # each feature counts once a text
                s = np.bincount(pairs >> bits, dense[pairs & ((1 << bits) - 1)], n_docs)
                out.append(1 / (1 + np.exp(-np.clip(s + dense[-1], -40, 40))))
            s = np.concatenate(out) if out else np.zeros(0)
            kept = [0] if b.num_columns == 2 else range(b.num_columns)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in kept), pa.array(s)], names=[*(b.schema.names[i] for i in kept), "score"]
            )

    return run


def pack(model: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(model), np.int64), np.array(list(model.values()), np.float32)


def training_sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """All of ``labels`` up to ``max_rows``; beyond, a hash-chosen share of about that size."""
    n = labels.count()
    if n <= max_rows:
        return labels
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    return labels.where(share < int(max_rows / n * (1 << 30)))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    fold: int = 5,
    held_out_fold: int = 0,
    max_train_rows: int = MAX_TRAIN_ROWS,
    bits: int = BITS,
    extra_columns: bool = False,
) -> DataFrame:
    """Row per document: doc_id, held_out, score, predicted.

    With ``extra_columns`` the whole input row comes along as the struct ``row``.

    ``labels(doc_id, toxic)`` teach only through documents whose
    ``crc32(doc_id) % fold`` is not ``held_out_fold``.  Null texts score as
    empty ones; an empty text scores the bias.  Rows that repeat an id are
    scored each.  A null id is scored, never held out and never learned from;
    labels that are null are skipped.  With no labels at all every score is 0.5
    less a hair, so nothing is rejected.  Other columns are ignored.
    """
    spark = docs.sparkSession
    src, row = with_rest(docs, extra_columns)
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    known = known.where(F.col("y").isNotNull() & (rest != held_out_fold))
    sample = training_sample(known, max_train_rows)
    model = fit(src.select("doc_id", "text").join(broadcast_if_small(sample, 4 * max_train_rows), "doc_id"), bits=bits)
    model.setdefault(1 << bits, -1e-6)
    packed = pack(model)
    schema = T.StructType([*(f for f in src.schema.fields if f.name != "text" or extra_columns), T.StructField("score", T.DoubleType())])
    scored = src.mapInArrow(score_batches(bits, spark.sparkContext.broadcast(packed)), schema)
    return scored.select(
        "doc_id", *row, F.coalesce(rest == held_out_fold, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
