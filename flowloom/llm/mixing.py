"""Mixing sources to target weights, with DataFrame functions only.

1. A classifier learns domains from a labelled table: naive Bayes over the
   presence of the words that tell the domains apart best (found on a bounded
   sample of labelled rows) and over binned shape features of whole texts.
   Each document gets posteriors ``p[d]``: soft membership.
2. Rates ``r >= 0`` as close to one as the targets allow bring the expected
   domain token totals, ``sum_i r_i * tokens_i * p_i[d]``, to the targets.  They
   follow from a dual vector of ``D`` numbers, found by Newton's method; a step
   needs one pass that sums ``D * D + D + 1`` numbers, and no rate table is
   rewritten between steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table

#: labelled rows the classifier learns from, at most about this many
MAX_LABELLED = 4_000
#: words the classifier looks at
MAX_WORDS = 192
#: how little rates may count against misses when targets are hard to meet, and a guard against endless passes
LEAST_SOFTNESS, MAX_PASSES = 1.5e-6, 300
#: share of tokens wanted of each domain, by (quality, toxic)
TARGETS = {"good": 0.80, "poor": 0.20, "toxic": 0.0}
WORD = "[^\\x20\\x09-\\x0D]+"


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), "[\\x20\\x09-\\x0D]+")


def _features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row columns, words, tokens, bins): whole-text shape features as small ints."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), *keep)
    d = d.withColumn("words", F.filter(_words(F.col("text")), lambda w: w != ""))
    n = F.greatest(F.size("words"), F.lit(1))
    letters = F.length("text")
    return d.select(
        "doc_id", *keep,
        F.size("words").cast("bigint").alias("tokens"),
        F.array_distinct("words").alias("words"),
        F.array(
            F.least(F.floor(F.log2(n.cast("double"))), F.lit(16)),
            F.least(F.floor(letters / n), F.lit(20)),
            F.least(F.floor(16 * F.size(F.array_distinct("words")) / n), F.lit(16)),
            F.least(F.floor(8 * (letters - F.length(F.replace(F.col("text"), F.lit("!!"), F.lit("")))) / n), F.lit(16)),
            F.least(F.floor(8 * (letters - F.length(F.replace(F.col("text"), F.lit(" | "), F.lit("")))) / n), F.lit(24)),
            F.least(F.floor(8 * (letters - F.length(F.translate("text", "#$%&*", ""))) / n), F.lit(24)),
        ).cast("array<int>").alias("bins"),
    )


def learn_domains(labelled: DataFrame, max_words: int = MAX_WORDS) -> tuple[list[str], list[float], dict, dict]:
    """(domains, log priors, word weights, bin weights) from rows (domain, words, bins).

    Words are chosen by the mutual information of their presence with the
    domain; the result is a bounded table, which the plan carries as literals.
    """
    totals = {r[0]: r[1] for r in labelled.groupBy("domain").count().collect()}
    names, n = sorted(totals), sum(totals.values())
    if not names:
        return [], [], {}, {}
    seen = labelled.select("domain", F.explode("words").alias("w")).groupBy("w", "domain").count()
    wide = seen.groupBy("w").agg(*(F.sum(F.when(F.col("domain") == d, F.col("count")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(names)))
    info = F.lit(0.0)
    every = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    for i, d in enumerate(names):
        for hits, share in ((F.col(f"n{i}"), every), (totals[d] - F.col(f"n{i}"), n - every)):
            expected = share * totals[d] / n
            info = info + F.when((hits > 0) & (expected > 0), hits * F.ln(hits / expected)).otherwise(0.0)
    best = wide.withColumn("info", F.round(info, 6)).where("info > 4").orderBy(F.desc("info"), "w").limit(max_words).collect() if max_words else []
    words = {}
    for r in best:
        on = [math.log((r[f"n{i}"] + 0.5) / (totals[d] + 1)) for i, d in enumerate(names)]
        off = [math.log(1 - math.exp(x)) for x in on]
        words[r["w"]] = [a - b for a, b in zip(on, off, strict=True)], off
    priors = [math.log(totals[d] / n) + sum(off[i] for _, off in words.values()) for i, d in enumerate(names)]
    bins: dict[tuple[int, int], list[float]] = {}
    counts = labelled.select("domain", F.posexplode("bins").alias("f", "b")).groupBy("f", "b", "domain").count().collect()
    table_ = {}
    for f, b, d, c in counts:
        table_.setdefault((f, b), {})[d] = c
    for fb, by in table_.items():
        bins[fb] = [math.log((by.get(d, 0) + 1) / (totals[d] + 25)) for d in names]
    return names, priors, {w: x[0] for w, x in words.items()}, bins


def posteriors(features: DataFrame, model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, tokens, p: array<double>) of every document."""
    names, priors, words, bins = model
    if not names:
        return features.select("doc_id", *keep, "tokens", F.array().cast("array<double>").alias("p"))
    vector = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    zero = vector([0.0] * len(names))
    terms = F.array(vector(priors))
    if words:
        look = F.create_map(*(x for w, v in words.items() for x in (F.lit(w), vector(v))))
        found = F.array_intersect("words", F.array(*map(F.lit, words)))
        terms = F.concat(terms, F.transform(found, lambda w: F.element_at(look, w)))
    if bins:
        look = F.create_map(*(x for (f, b), v in bins.items() for x in (F.lit(f * 100 + b), vector(v))))
        terms = F.concat(terms, F.transform("bins", lambda b, i: F.coalesce(F.element_at(look, i * 100 + b), zero)))
    add = lambda s, t: F.zip_with(s, t, lambda a, b: a + b)
    d = features.select("doc_id", *keep, "tokens", F.aggregate(terms, zero, add).alias("s"))
    d = d.withColumn("s", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    return d.select("doc_id", *keep, "tokens", F.transform("s", lambda x: x / F.aggregate("s", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def _inverse(m: list[list[float]]) -> list[list[float]]:
    n = len(m)
    a = [[*row, *(float(i == j) for j in range(n))] for i, row in enumerate(m)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(n):
            if r != i and a[r][i]:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i], strict=True)]
    return [row[n:] for row in a]


def _rate(dual: list[float]) -> Column:
    """A document's rate: max(0, 1 - p . dual); without tokens it stays one."""
    dot = F.aggregate(F.zip_with("p", F.array(*map(F.lit, dual)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), 1.0 - dot)).otherwise(1.0)


def fit_rates(soft: DataFrame, targets: list[float], *, tolerance: float = 1e-3) -> DataFrame:
    """``soft(doc_id, tokens, p)`` with columns ``rate`` and ``miss``.

    Of all ``r >= 0`` takes those that minimise ``softness / 2 * sum_i tokens_i * (r_i - 1) ** 2 / T + |miss|^2 / 2``,
    with ``miss[d] = (sum_i r_i * tokens_i * p_i[d] - targets[d]) / T`` and ``T`` all tokens.  The dual has one number
    a domain, is convex and piecewise quadratic, and Newton's method with a line search ends with its gradient under a
    tenth of the tolerance.  ``softness`` falls until no domain misses by more than ``tolerance``, or to
    ``LEAST_SOFTNESS``, where what is still missed can't be met with such posteriors.  ``miss`` states what is left.
    """
    k = len(targets)
    total = float(soft.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) or 1.0
    want = [t / total for t in targets]
    passes = 0

    def look(dual, softness):
        """The dual's value, the misses, and the curvature, in one pass."""
        nonlocal passes
        passes += 1
        if passes > MAX_PASSES:
            raise RuntimeError("rates did not converge")
        d = soft.select("tokens", "p", _rate(dual).alias("r"))
        some = F.when(F.col("r") > 0, F.col("tokens")).otherwise(0)
        sums = [F.sum(F.col("tokens") * F.col("r") * F.col("r"))]
        sums += [F.sum(F.col("tokens") * F.col("r") * F.col("p")[i]) for i in range(k)]
        sums += [F.sum(some * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(k)]
        got = [x / total for x in d.agg(*(F.coalesce(x, F.lit(0.0)) for x in sums)).first()]
        value = softness / 2 * sum(x * x for x in dual) + got[0] / 2 + sum(x * y for x, y in zip(want, dual, strict=True))
        return value, [x - y for x, y in zip(got[1 : k + 1], want, strict=True)], [got[1 + k * (i + 1) : 1 + k * (i + 2)] for i in range(k)]

    dual, softness = [0.0] * k, 1e-2
    while True:
        value, miss, curve = look(dual, softness)
        while True:
            slope = [softness * x - y for x, y in zip(dual, miss, strict=True)]
            if max(map(abs, slope)) <= tolerance / 10:
                break
            inverse = _inverse([[curve[i][j] + (i == j) * softness for j in range(k)] for i in range(k)])
            step = [-sum(inverse[i][j] * slope[j] for j in range(k)) for i in range(k)]
            fall = sum(x * y for x, y in zip(slope, step, strict=True))
            size = 1.0
            while True:
                at = [x + size * y for x, y in zip(dual, step, strict=True)]
                new = look(at, softness)
                if new[0] <= value + 1e-4 * size * fall + 1e-12:
                    break
                size /= 2
            dual, (value, miss, curve) = at, new
        if max(map(abs, miss)) <= tolerance or softness <= LEAST_SOFTNESS:
            return soft.withColumn("rate", _rate(dual)).withColumn("miss", F.array(*map(F.lit, miss)))
        softness /= 10


def mix(docs: DataFrame, labels: DataFrame, *, targets: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """Row per document: doc_id, tokens, domains, p, rate, miss.

    ``labels(doc_id, quality, toxic)`` teach the domains ``good``, ``poor`` and
    ``toxic``; ``targets`` are their shares of ``total`` expected tokens (all
    tokens of the input by default); ``miss`` is what the rates miss of them, by
    domain as a share of all tokens (null if nothing is fitted).  A domain without a labelled row can't be
    predicted, and the other shares are scaled to one.  Null and empty texts
    have no tokens and keep rate 1, as do all documents if nothing is
    labelled.  Rows that repeat an id, and null ids, get a rate each.  Other
    columns are ignored.
    """
    shares = dict(targets or TARGETS)
    known = labels.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")
    ).where("domain IS NOT NULL AND doc_id IS NOT NULL")
    n = known.count()
    if n > MAX_LABELLED:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(MAX_LABELLED / n * (1 << 30)))
    texts = docs.select("doc_id", "text")
    labelled = _features(texts.withColumn("doc_id", F.col("doc_id").cast("bigint")).join(broadcast_if_small(known.select("doc_id").distinct(), 4 * MAX_LABELLED), "doc_id", "left_semi"))
    labelled = labelled.join(broadcast_if_small(known, 4 * MAX_LABELLED), "doc_id")
    labelled = materialize(labelled.hint("rebalance"), "labelled")  # a few rows of each task: together, not a file a task
    model = learn_domains(labelled)
    names = model[0]
    soft = materialize(posteriors(_features(texts), model), "soft")
    share = sum(shares.get(d, 0.0) for d in names)
    if not names or share <= 0:
        rated = soft.withColumn("rate", F.lit(1.0)).withColumn("miss", F.lit(None).cast("array<double>"))
    else:
        if total is None:
            total = float(soft.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
        rated = fit_rates(soft, [total * shares.get(d, 0.0) / share for d in names])
    domains = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return rated.select("doc_id", "tokens", domains.alias("domains"), "p", "rate", "miss")


def mix_tables(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
