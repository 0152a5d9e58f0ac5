"""Quality by hierarchical empirical Bayes: document evidence, shrunk host and path posteriors.

A logistic classifier over hashed words, word pairs and buckets of general
shape (length, repetition, shares of symbols, digits and capitals) gives each
document's probability of being good.  Hosts and paths under them have a share
of good documents; the share of a sparse site is shrunk toward its parent, with
a strength fitted by the method of moments from grouped sums.  A document's
posterior odds are its own odds times the odds of its path relative to the
global prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, materialize
from .textops import U64, _chunks, iter_words, mix64, text_buffers
from .toxicity import BITS, MAX_TRAIN_ROWS, _features, fit, pack, score_batches, training_sample

#: learning rate, L1 penalty and passes, chosen by the log loss on one fold of the labelled rows (crc32 mod 5 is 4)
RATES, EPOCHS = {"alpha": 0.3, "l1": 4.0}, 5
SALTS = 16
_EPS = 1e-4


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bucket of a share: twentieths, and finer ones near zero."""
    x = part / np.maximum(whole, 1)
    return np.where(x < 0.05, -np.floor(np.log2(np.maximum(x, 1e-4))) + 30, np.floor(x * 20)).astype(np.int64)


def features(col: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, text of each feature, coordinate): words, pairs and shape buckets of every chunk of a text column."""
    data, offsets = text_buffers(col)
    for (i, j), w in zip(_chunks(offsets), iter_words(col, letters_only=True), strict=True):
        raw, own = data[int(offsets[i]) : int(offsets[j])], offsets[i : j + 1] - offsets[i]
        count = lambda mask, own=own: np.diff(np.concatenate([[0], np.cumsum(mask)])[own])
        size, words = np.diff(own), np.diff(w.bounds)
        capital, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        symbol = (raw > 32) & (raw < 127) & ~capital & ~digit & ~((raw >= 97) & (raw <= 122))
        distinct = lambda doc, h, n=w.n_docs: np.bincount(doc[np.unique(mix64(h ^ mix64(doc.astype(U64))), return_index=True)[1]], minlength=n)
        near = w.doc[:-1] == w.doc[1:]
        pairs = mix64(w.hash[:-1][near] + w.hash[1:][near] * U64(3))
        shape = [
            np.floor(2 * np.log2(words + 1)), np.floor(2 * size / np.maximum(words, 1)), _share(distinct(w.doc, w.hash), words),
            _share(distinct(w.doc[:-1][near], pairs), words), _share(count(symbol), size), _share(count(digit), size),
            _share(count(capital), size), _share(count(space), size), _share(count(raw == 10), words),
        ]
        at = [mix64(np.minimum(x, 60).astype(U64) + U64(64 * k + 1)) >> U64(64 - bits) for k, x in enumerate(shape)]
        doc, words_at = _features(w, bits)
        yield w.n_docs, np.concatenate([doc, *[np.arange(w.n_docs)] * len(at)]), np.concatenate([words_at, *(x.astype(np.int64) for x in at)])


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - _EPS)), F.lit(_EPS))
    return F.ln(p / (1 - p))


def _strength(groups: DataFrame, mean: float) -> float:
    """Beta strength from group sums (n, s): within-group variance over what lies between groups."""
    between = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)) / F.sum("n")
    noise = F.sum(F.lit(mean * (1 - mean))) / F.sum("n")
    b, w = groups.agg(F.coalesce(between, F.lit(0.0)), F.coalesce(noise, F.lit(0.0))).first()
    tau = max(b - w, 1e-6)
    return max(1.0, min(1e6, mean * (1 - mean) / tau - 1))


def score_quality(
    docs: DataFrame, labels: DataFrame, *, host: Column | None = None, path: Column | None = None, threshold: float = 0.5
) -> DataFrame:
    """Row per document: doc_id, evidence, host_mean, path_mean, score, kept.

    ``host`` and ``path`` are columns of ``docs``, ``source`` and ``lang`` by
    default; nulls are sites of their own.  ``labels(doc_id, quality)`` teach
    the classifier, from at most about ``MAX_TRAIN_ROWS`` rows chosen by hash;
    null ids and labels teach nothing.  Null and empty texts have the evidence
    of an empty text.  Rows that repeat an id, and null ids, are scored each.
    With no labels the evidence is next to 1 and every document is kept.  An
    empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    site = F.struct(F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), site.alias("site"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL")
    sample = training_sample(known, MAX_TRAIN_ROWS)
    taught = src.select("doc_id", "text").join(broadcast_if_small(sample, 4 * MAX_TRAIN_ROWS), "doc_id")
    model = fit(taught, epochs=EPOCHS, features=features, **RATES)
    model.setdefault(1 << BITS, 10.0)
    schema = "doc_id bigint, text string, site struct<host:string,path:string>, score double"
    seen = src.mapInArrow(score_batches(BITS, spark.sparkContext.broadcast(pack(model)), features), schema)
    seen = materialize(seen.select("doc_id", "site.host", "site.path", F.col("score").alias("evidence")), "evidence")

    # hot hosts: sums by salt first, and a salted join back
    paths = materialize(seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total, good_sum = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    mean = good_sum / total if total else 0.5
    a, b = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select("host", ((a * mean + F.col("s")) / (a + F.col("n"))).alias("host_mean"))
    paths = paths.join(hosts, "host").select("host", "path", "host_mean", ((b * F.col("host_mean") + F.col("s")) / (b + F.col("n"))).alias("path_mean"))
    paths = paths.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(paths, ["host", "path", "salt"])
    logit = _logit(F.col("evidence")) + _logit(F.col("path_mean")) - _logit(F.lit(mean))
    out = out.select("doc_id", "evidence", "host_mean", "path_mean", (1 / (1 + F.exp(-logit))).alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)
