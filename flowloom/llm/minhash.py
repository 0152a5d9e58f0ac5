"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Each text becomes its set of distinct word shingles (64-bit hashes).  Equal
   sets collapse to a class at once, so exact copies never meet each other.
2. A class keeps the ``k`` smallest hashes of its set: a bottom-k sketch.  Two
   sets that reach the similarity share most retained values, so it is enough
   to look up each class under its rarest retained values (frequent ones come
   last in one global order): if ``o`` values are shared, the ``k - o + 1``
   rarest of both sketches meet.  Two sets at the similarity share fewer than
   ``o`` with probability ``TAIL`` at most, by the binomial distribution, which
   bounds that of values drawn from a union; sets of up to ``k`` values, whose
   sketches are whole, lose nothing.
3. Inverted lists of these values give pairs of a list's smallest class with
   each other member; set sizes and a 128-bit signature of the same hash
   function filter them; the sketch of the union estimates the similarity; the
   full sets decide.  Links become components.
4. Members of one list that are still in different components, though their
   signatures allow the similarity, form families.  Lists within one component
   are left out; long lists are cut into blocks, each pair of blocks a group of
   its own.  A family's sets are compared block against block inside tasks,
   which emit only the links they find; blocks hold thousands of sets, by
   number and bytes.  So no link between components is lost, a group of ``g``
   copies costs about ``g`` comparisons of texts, and no pair that isn't a link
   is written.

Signatures and sketches of unions exclude a pair at the similarity with
probability ``TAIL`` each, too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, discard, list_blocks, materialize
from .textops import U64, iter_words, mix64, shingle_sets

SKETCH = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, s1 bigint, s2 bigint, sketch binary"
#: at most this many frequent values order the lookups; the rest rank as rare
MAX_RANKED = 400_000
#: a pair's ids are broadcast to pick its texts only up to this many ids
MAX_BROADCAST_IDS = 1_000_000
#: about as many members of a list are in one block of it
LIST_BLOCK = 4096
#: members and bytes of sets in one block of a family
FAMILY_BLOCK, FAMILY_BYTES = 2048, 16 << 20
#: probability that one filter excludes a pair at the similarity
TAIL = 1e-12


@lru_cache(maxsize=4096)
def least(n: int, p: float) -> int:
    """The largest ``o`` with ``P(Bin(n, p) < o) <= TAIL``."""
    total = 0.0
    for o in range(n + 1):
        total += math.comb(n, o) * p**o * (1 - p) ** (n - o)
        if total > TAIL:
            return o
    return n


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits: for each 1/128 of the hash range a bit of its smallest member."""
    at = np.searchsorted(s, np.arange(128, dtype=U64) << U64(57))
    ok = at < len(s)
    v = s[np.minimum(at, len(s) - 1)]
    bit = ok & ((v >> U64(57)) == np.arange(128, dtype=U64)) & ((mix64(v) & U64(1)) == 1)
    one, two = np.packbits(bit).view(">i8")
    return int(one), int(two)


def _sketches(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            n, d1, d2, s1, s2, sk = [], [], [], [], [], []
            for w in iter_words(b.column(1)):
                for s in shingle_sets(w, size):
                    n.append(len(s))
                    if not len(s):
                        for x in (d1, d2, s1, s2):
                            x.append(0)
                        sk.append(b"")
                        continue
                    x, y = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    d1.append(int(x))
                    d2.append(int(y))
                    x, y = _signature(s)
                    s1.append(x)
                    s2.append(y)
                    sk.append(s[:k].tobytes())
            kind = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [ids.cast(kind), *(pa.array(x, kind) for x in (n, d1, d2, s1, s2)), pa.array(sk, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "s1", "s2", "sketch"],
            )

    return run


def overlap_bound(n: int, k: int, sim: float) -> int:
    """Least number of retained values that two similar sets share, one of size ``n``."""
    s = min(n, k)
    if n <= sim * k:  # the partner's sketch is its whole set, too
        return max(1, int(np.ceil(sim * n - 1e-9)))
    return max(1, least(s, sim))


def _lookups(k: int, sim: float, ranked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = ranked.value
        for b in batches:
            docs, ns = b.column(0).to_numpy(), b.column(1).to_numpy()
            picked, reps = [], []
            for n, raw in zip(ns.tolist(), b.column(4).to_pylist(), strict=True):
                v = np.frombuffer(raw, U64)
                take = len(v) - overlap_bound(n, k, sim) + 1
                if take < len(v):
                    rank = np.zeros(len(v), np.int64)
                    if len(values):
                        at = np.minimum(np.searchsorted(values, v), len(values) - 1)
                        rank = np.where(values[at] == v, ranks[at], 0)
                    v = v[np.lexsort((v, rank))[:take]]
                picked.append(v)
                reps.append(len(v))
            v = np.concatenate(picked).view(np.int64) if picked else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v)] + [pa.array(np.repeat(b.column(i).to_numpy(), reps)) for i in range(4)],
                names=["value", "doc", "n", "s1", "s2"],
            )

    return run


def _verify(percent: int, size: int, k: int):
    """Rows (a, b, text_a, text_b) -> (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[s for w in iter_words(b.column(i)) for s in shingle_sets(w, size)] for i in (2, 3)]
            ok = np.zeros(b.num_rows, bool)
            for r, (x, y) in enumerate(zip(*sets, strict=True)):
                union = np.union1d(x[:k], y[:k])[:k]  # the union's own bottom-k sketch
                shared = np.isin(union, x[:k], assume_unique=True) & np.isin(union, y[:k], assume_unique=True)
                if shared.sum() < least(len(union), percent / 100):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[r] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, k: int = 64, id_col: str = "doc_id", text_col: str = "text",
    list_block: int = LIST_BLOCK,
) -> DataFrame:
    """Row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` on their
    sets of ``shingle``-word shingles; ``component_id`` is the smallest id that
    links reach, ``kept`` marks that document.  Null and empty texts have an
    empty set and link with nothing.  Rows that repeat an id are one document:
    each returns a row, and a link of any of its texts counts for the id.  A
    null id can't be linked: its component is null and it is kept.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sk = materialize(src.mapInArrow(_sketches(k, shingle), SKETCH), "sketches")

    full = sk.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_shingles", "s1", "s2", "sketch"))
    )
    reps = materialize(reps.select("doc_id", F.col("n_shingles").alias("n"), "s1", "s2", "sketch", "d1", "d2"), "reps")
    lists = materialize(reps.select("doc_id", "n", "s1", "s2", "sketch").mapInArrow(
        _lookups(k, percent / 100, spark.sparkContext.broadcast(_ranked(reps))),
        "value bigint, doc bigint, n bigint, s1 bigint, s2 bigint",
    ), "lists")

    heads = lists.groupBy("value").agg(
        F.min(F.struct("doc", "n", "s1", "s2")).alias("p"), F.count(F.lit(1)).alias("members")
    )
    shared = materialize(lists.join(heads.where("members > 1"), "value"), "shared")
    first = shared.where("doc <> p.doc").select(
        F.col("p.doc").alias("a"), F.col("doc").alias("b"), "n", "s1", "s2",
        F.col("p.n").alias("n2"), F.col("p.s1").alias("t1"), F.col("p.s2").alias("t2"),
    )
    first = materialize(first.where(_plausible(percent)).select("a", "b").distinct(), "pairs")
    links = _linked(src, first, percent, shingle, k)
    # rows of one id with different texts are one document
    repeated = full.groupBy("doc_id").count().where("count > 1").select("doc_id")
    same_id = full.join(repeated, "doc_id").join(reps.select("d1", "d2", F.col("doc_id").alias("r")), ["d1", "d2"])
    own = same_id.where("doc_id <> r").select(F.col("r").alias("a"), F.col("doc_id").alias("b"))
    comps = connected_components(links)
    discard(lists, first, links)

    # second round: members of a list that the first left in different components
    left = shared.where("members > 2").join(comps.withColumnRenamed("node", "doc"), "doc", "left")
    left = left.select("value", "members", "doc", "n", "s1", "s2", F.coalesce("comp", "doc").alias("comp"))
    left = _blocks(left, list_block)
    families = materialize(left.mapInArrow(_families(percent), "a bigint, b bigint").distinct(), "families")
    more = own
    if families.limit(1).count():
        more = more.union(_family_links(src, families, comps, percent, shingle))
    more = materialize(more, "morelinks")
    discard(shared, families)
    if more.limit(1).count():  # components so far are stars, which say as much as their links
        comps = connected_components(comps.selectExpr("node AS a", "comp AS b").union(more))
    discard(more)
    return _result(sk, reps, comps)


def _most_apart(percent: int) -> int:
    """Bits by which the signatures of two sets at the similarity may differ."""
    return 128 - least(128, (1 + percent / 100) / 2)


def _alike(n, s1, s2, i, j, percent: int) -> np.ndarray:
    """Which of the rows ``j`` row ``i`` may be similar to, by size and signature."""
    bits = np.bitwise_count(s1[j] ^ s1[i]) + np.bitwise_count(s2[j] ^ s2[i])
    return (bits <= _most_apart(percent)) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))


def _blocks(rows: DataFrame, list_block: int) -> DataFrame:
    """(pair, doc, n, s1, s2, comp) sorted by pair: the rows of two blocks of a list, for every two and each alone.

    Lists whose members are all in one component have no link to find.  Any two
    members of a list meet in a group of about ``2 * list_block`` rows or fewer.
    """
    open_lists = rows.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    rows = rows.join(open_lists.select("value"), "value", "left_semi")
    rows = list_blocks(rows.withColumn("blocks", F.ceil(F.col("members") / list_block)), "value", "doc", "blocks")
    return rows.select("pair", "doc", "n", "s1", "s2", "comp").repartition("pair").sortWithinPartitions("pair")


def _families(percent: int):
    """Rows (pair, doc, n, s1, s2, comp) sorted by pair -> (a, b): members of a list that need comparing.

    In each group rows spread from one to all that may be similar to it, each
    row asking only about rows not reached yet; a family that spans more than
    one component is emitted as a star around its smallest member.
    """

    def emit(rows: np.ndarray) -> list[tuple[int, int]]:
        doc, n, s1, s2, comp = rows
        if len(np.unique(comp)) < 2:
            return []
        s1, s2, out = s1.view(U64), s2.view(U64), []
        rest = np.arange(len(doc))
        while len(rest):
            family, wave, rest = [rest[0]], [rest[0]], rest[1:]
            while wave and len(rest):
                hit = _alike(n, s1, s2, wave.pop(), rest, percent)
                new, rest = rest[hit].tolist(), rest[~hit]
                wave += new
                family += new
            if len(family) > 1 and len(np.unique(comp[family])) > 1:
                head = int(doc[family].min())
                out += [(head, int(d)) for d in doc[family] if d != head]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def batch(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            value = b.column(0).to_numpy()
            rows = np.stack([b.column(i).to_numpy() for i in range(1, 6)])
            cut = np.concatenate([[0], np.flatnonzero(np.diff(value)) + 1, [len(value)]])
            found = []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if held and value[s] != key:
                    found += emit(np.concatenate(held, 1))
                    held = []
                key = value[s]
                held.append(rows[:, s:e])
            if found:
                yield batch(found)
        if held and (found := emit(np.concatenate(held, 1))):
            yield batch(found)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for w in iter_words(b.column(1)) for s in shingle_sets(w, size)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["doc", "grams"])

    return run


def _compare(percent: int):
    """One task of a family: sets of two blocks -> links between different components."""

    def run(rows: pa.Table) -> pa.Table:
        doc, comp, side = (rows.column(c).to_numpy() for c in ("doc", "comp", "side"))
        sets = [np.frombuffer(x, U64) for x in rows.column("grams").to_pylist()]
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        # an inverted index over the right side: positions of each shingle
        size = np.array([len(s) for s in sets])
        flat = np.concatenate([sets[r] for r in right]) if len(right) else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        out = []
        for i in left:
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            k = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            both = np.bincount(owner[at], minlength=len(right))
            ok = (100 * both >= percent * (size[right] + size[i] - both)) & (comp[right] != comp[i])
            out += [(int(doc[i]), int(doc[r])) for r in right[ok]]
        # a spanning forest says as much as all links
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        kept = []
        for a, b in out:
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([y for _, y in kept], pa.int64())})

    return run


def _family_links(src: DataFrame, families: DataFrame, comps: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links inside families between documents of different components.

    A family is cut into blocks by members and bytes, and each pair of blocks
    is one bounded task.
    """
    members = connected_components(families).select(F.col("node").alias("doc"), F.col("comp").alias("family"))
    members = members.join(comps.withColumnRenamed("node", "doc"), "doc", "left")
    members = members.withColumn("comp", F.coalesce("comp", "doc"))
    ids = broadcast_if_small(members.select(F.col("doc").alias("doc_id")), MAX_BROADCAST_IDS)
    grams = src.join(ids, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc bigint, grams binary")
    sets = rows = materialize(members.join(grams, "doc"), "familysets")
    sizes = rows.groupBy("family").agg(
        F.expr(f"ceil(greatest(count(1) / {FAMILY_BLOCK}, sum(octet_length(grams)) / {FAMILY_BYTES})) AS blocks")
    )
    rows = list_blocks(rows.join(broadcast_if_small(sizes, MAX_BROADCAST_IDS), "family"), "family", "doc", "blocks")
    rows = rows.select("pair", "doc", "comp", "grams", "side")
    compare = _compare(percent)
    links = materialize(rows.groupBy("pair").applyInArrow(lambda t: compare(t), "a bigint, b bigint").distinct(), "familylinks")
    discard(sets)
    return links


def _ranked(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent retained values and their frequencies, ``MAX_RANKED`` at most.

    Any order of values is right; this one only keeps common values out of the
    lookups, so a bounded number of them is enough at any input size.
    """
    values = F.explode(
        F.transform(F.sequence(F.lit(0), F.expr("length(sketch) div 8 - 1")), lambda i: F.substring("sketch", i * 8 + 1, F.lit(8)))
    )
    counts = reps.select(values.alias("v")).groupBy("v").count().where("count > 3")
    counts = materialize(counts, "frequent")
    sizes = counts.groupBy(F.floor(F.log2("count") * 4).alias("b")).count().orderBy(F.desc("b")).collect()
    total, least = 0, None
    for b, n in sizes:
        if total + n > MAX_RANKED:
            break
        total, least = total + n, b
    if least is None:
        discard(counts)
        return np.zeros(0, U64), np.zeros(0, np.int64)
    got = counts.where(F.floor(F.log2("count") * 4) >= least).toArrow()
    v = np.frombuffer(b"".join(got.column("v").to_pylist()), U64)
    c = got.column("count").to_numpy()
    order = np.argsort(v)
    discard(counts)
    return v[order], c[order]


def _plausible(percent: int):
    """Sizes allow the similarity, and the 128-bit signatures don't exclude it."""
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (apart <= _most_apart(percent))


def _linked(src: DataFrame, pairs: DataFrame, percent: int, shingle: int, k: int) -> DataFrame:
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = materialize(src.join(broadcast_if_small(ids, MAX_BROADCAST_IDS), "doc_id", "left_semi"), "texts")
    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b")
    links = materialize(rows.mapInArrow(_verify(percent, shingle, k), "a bigint, b bigint").distinct(), "links")
    discard(texts)
    return links


def _result(sk: DataFrame, reps: DataFrame, comps: DataFrame) -> DataFrame:
    named = reps.join(comps, reps.doc_id == comps.node, "left").select(
        "d1", "d2", F.coalesce("comp", "doc_id").alias("c")
    )
    # a hot class is spread over salts: its members are many, its component is one
    salts = 32
    named = named.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = sk.select("doc_id", "n_shingles", "d1", "d2", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = rows.where(linked).join(named, ["d1", "d2", "salt"]).select("doc_id", "n_shingles", F.col("c").alias("component_id"))
    rest = rows.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(rest).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
