"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Symbols are all training words counted ``MIN_COUNT`` times or more (up to
``MAX_WORDS``, the bound of what is broadcast), the end of a text, and one
symbol for the words left.  Ranked by count they form nested classes of 16,
fewer levels deep for frequent words, so the softmax is a product of a factor a
level: P(class), P(subclass | class), ..., each over 16 places and log-linear in
hashed features of the history: the last word (bigram), the word before it
(skip), and both (trigram).  A word
behind the last symbol has its add-one share of that symbol's training tokens,
so the model covers every word.

All training tokens count.  They are summed to a table of distinct n-grams,
which grows with the corpus and is dealt into blocks by hash.  Each gradient
round is a distributed pass over one block, and all blocks are passed once; a
weight's step is its summed derivative over the second derivatives of all rounds
so far.  The number of weight rows grows with the training tokens up to
``MAX_ROWS``.  Bigram and trigram rows lie in a window that belongs to the last
word, wider for frequent words, and the n-grams are dealt by that window: a
task touches its own rows only, so a round's traffic is about the size of the
model and not that of the model times the tasks.  N-grams of frequent words are
dealt apart.  The driver only holds the bounded weights.

Counts of the vocabulary are exact.  Frequent words travel to the executors in
a table of fixed size; the others, whose counts are small, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize, release_shuffles
from .textops import U64, Words, iter_words, mix64

WIDTH = 16
BITS = 20  # of a symbol in an n-gram's key
END_HASH = -7046029254386353131  # stands for the end among the word hashes
MIN_COUNT, MAX_WORDS = 4, 1 << 18
REGIONS = 256
SKIP_ROWS, MIN_ROWS, MAX_ROWS, TOKENS_A_ROW = 1 << 14, 1 << 14, 1 << 19, 256
DEPTH = 5
SLOTS = 1 << 20
MAX_TABLE_WORDS = 300_000
_BUFFER = 1 << 22
_STEP = 1 << 14
_PLACES = 1 << 11  # of weight rows whose derivatives travel together
STEP = 1 / 3
MAX_WEIGHT = 10.0  # five rounds of 2 at most reach it


def _with_ends(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, the texts of the tokens, and their offsets."""
    at = w.bounds[1:]
    h = np.insert(w.hash.view(np.int64), at, END_HASH)
    doc = np.insert(w.doc, at, np.arange(w.n_docs))
    return h, doc, w.bounds + np.arange(w.n_docs + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush():
        v, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(c)], names=["h", "c"])

    for b in batches:
        for w in iter_words(b.column(0)):
            h = _with_ends(w)[0]
            held.append(h)
            n += len(h)
            if n > _BUFFER:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


@dataclass
class Table:
    """Frequent words by slot of their hash: two slots each, earlier (more frequent) words first."""

    key: np.ndarray
    count: np.ndarray
    symbol: np.ndarray

    @staticmethod
    def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mix64(h.view(U64))
        return (x & U64(SLOTS - 1)).astype(np.int64), (x >> U64(44)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, symbols: dict[int, int], other: int) -> Table:
        t = cls(np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.full(SLOTS, other, np.int32))
        taken = np.zeros(SLOTS, bool)
        for w, c, *at in zip(words.tolist(), counts.tolist(), *(s.tolist() for s in cls.slots(words)), strict=True):
            for s in at:
                if not taken[s]:
                    taken[s], t.key[s], t.count[s], t.symbol[s] = True, w, c, symbols.get(w, other)
                    break
        t.count[~taken] = -1
        return t

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        a, b = self.slots(h)
        in_a, in_b = (self.key[a] == h) & (self.count[a] >= 0), (self.key[b] == h) & (self.count[b] >= 0)
        return np.where(in_a, a, np.where(in_b, b, -1))


def _symbols(t: Table, w: Words, other: int) -> tuple[np.ndarray, ...]:
    """Hashes, texts, offsets, slots, symbols, and last and last but one symbols of the tokens of a chunk."""
    h, doc, bounds = _with_ends(w)
    slot = t.find(h)
    sym = np.where(slot >= 0, t.symbol[slot], other).astype(np.int64)
    back = []
    for k in (1, 2):
        prev = np.full(len(sym), other + 1)
        prev[k:] = np.where(doc[k:] == doc[:-k], sym[:-k], other + 1)
        back.append(prev)
    return h, doc, bounds, slot, sym, back[0], back[1]


def _planes(x: np.ndarray) -> bytes:
    """Integers as bytes, the lowest of all first, so that the zeros of the higher ones compress."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _integers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _pack(name: str, group: np.ndarray, k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (group, k, c) with up to ``_STEP`` sorted keys of a group as differences, and their counts, in bytes.

    Spark spends more on a row than numpy on an n-gram, so n-grams travel by the thousand.
    """
    order = np.argsort(group.astype(np.uint16), kind="stable")
    group, k, c = group[order], k[order], c[order]
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    cuts = [x for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for x in range(lo, hi, _STEP)] + [len(group)]
    for i in range(0, len(cuts) - 1, 16):
        at = list(zip(cuts[i : i + 16], cuts[i + 1 : i + 17], strict=False))
        keys = pa.array([_planes(np.diff(k[lo:hi], prepend=0)) for lo, hi in at], pa.binary())
        counts = pa.array([_planes(c[lo:hi]) for lo, hi in at], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(group[[lo for lo, _ in at]].astype(np.int32)), keys, counts], names=[name, "k", "c"])


def _unpack(k: pa.Array, c: pa.Array) -> Iterator[pa.RecordBatch]:
    """Counted keys (k, c) of packed ones, a batch a row."""
    for x, y in zip(k, c, strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(_integers(x.as_buffer()))), pa.array(_integers(y.as_buffer()))], names=["k", "c"])


def _ngrams(table, model):
    """Texts -> packed counted keys of n-grams, by the part they are dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, t, m = [], 0, Table(*table.value), Model(*model.value)

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            return _pack("part", m.parts(k), k, c)

        for b in batches:
            for w in iter_words(b.column(0)):
                *_, sym, h1, h2 = _symbols(t, w, m.other)
                held.append((h2 << 2 * BITS) | (h1 << BITS) | sym)
                n += len(sym)
                if n > _BUFFER:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted keys (k, c) with the counts of equal keys summed, a buffer at a time.

    A part beyond the buffer may give a key more than once; a gradient sums the counts anyway.
    """
    held, n = [], 0

    def flush():
        k, c = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        order = np.argsort(k)
        k = k[order]
        first = np.flatnonzero(np.diff(k, prepend=-1))
        merged = pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(np.add.reduceat(c[order], first))], names=["k", "c"])
        for i in range(0, len(first), _STEP):
            yield merged.slice(i, _STEP)

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n > _BUFFER:
            yield from flush()
            held, n = [], 0
    if n:
        yield from flush()


def _merge_parts(blocks: int):
    """Packed n-grams of whole parts -> packed ones by block, with equal keys merged a buffer at a time.

    The keys of a part follow one another, so a gradient stays within few windows for long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0

        def flush():
            for part in sorted(held):
                merged = pa.Table.from_batches(_merge(iter(held[part])))
                k, c = merged.column("k").to_numpy(), merged.column("c").to_numpy()
                block = mix64(k.astype(U64) ^ U64(1 << 62)) % U64(blocks)
                yield from _pack("block", block.astype(np.int32), k, c)

        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), _unpack(b.column(1), b.column(2)), strict=True):
                held.setdefault(part, []).append(x)
                n += x.num_rows
            if n > _BUFFER:
                yield from flush()
                held, n = {}, 0
        yield from flush()

    return run


@dataclass
class Model:
    """Weights of a model over symbols ``0 .. other``; ``other + 1`` stands before a text.

    ``bias`` has a row a node of the class tree, level by level; ``weight`` has
    the rows of the last words' windows and then the skip rows.
    """

    count: np.ndarray  # of each symbol and of the one before a text
    bias: np.ndarray
    weight: np.ndarray

    @classmethod
    def new(cls, counts: np.ndarray, texts: int, rows: int) -> Model:
        """Untrained model of symbols with these counts, which gives each its share of them."""
        leaves = np.zeros(WIDTH**DEPTH)
        leaves[cls.codes(np.arange(len(counts)))] = counts
        bias = []
        for level in range(DEPTH):
            n = leaves.reshape(WIDTH**level, WIDTH, -1).sum(2)
            share = n / np.maximum(1e-9, n.sum(1, keepdims=True))
            bias.append(np.where(share > 0, np.log(np.maximum(share, 1e-30)), -30.0).astype(np.float32))
        weight = np.zeros((rows + SKIP_ROWS, WIDTH), np.float32)
        return cls(np.append(counts, texts).astype(np.float64), np.concatenate(bias), weight)

    @staticmethod
    def codes(sym: np.ndarray) -> np.ndarray:
        """Place of a symbol in the full tree: 256 words under the first class, 4096 under three, 65536 under the others."""
        last = WIDTH ** (DEPTH - 1)
        far = sym - 256
        under = np.where(far < 3 * 4096, (1 + far // 4096) * last + far % 4096, sym - 256 - 3 * 4096 + 4 * last)
        return np.where(sym < 256, sym, under)

    def __post_init__(self):
        self.other = len(self.count) - 2
        self.n_rows = len(self.weight) - SKIP_ROWS
        self.code = self.codes(np.arange(self.other + 1))
        self.forks = (self.bias > -30).sum(1) > 1  # a node with one place has nothing to learn
        share = self.count / max(1.0, self.count.sum())
        least = self.n_rows // REGIONS
        wide = np.maximum(least, 2.0 ** np.ceil(np.log2(np.maximum(share * self.n_rows, 1))))
        self.window = wide.astype(np.int64) - 1
        self.region = (mix64(np.arange(len(share)).astype(U64)) % U64(REGIONS)).astype(np.int64)
        self.spread = 1 + (share * 128).astype(np.int64)

    def parts(self, k: np.ndarray) -> np.ndarray:
        """Part of each n-gram: the region of its last word, and a share of it for frequent words."""
        h1 = (k >> BITS) & ((1 << BITS) - 1)
        salt = (mix64(k.astype(U64)) >> U64(8)).astype(np.int64) % self.spread[h1]
        return (self.region[h1] * 256 + salt).astype(np.int32)

    def levels(self, sym: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By level, the tokens that a fork of the class tree lies on the way to, the node, and the place in it."""
        code, first = self.code[sym], 0
        for level in range(DEPTH):
            node = first + (code >> 4 * (DEPTH - level))
            at = np.flatnonzero(self.forks[node])
            if len(at):
                yield at, node[at], (code[at] >> 4 * (DEPTH - level - 1)) & (WIDTH - 1)
            first += WIDTH**level

    def rows(self, h1: np.ndarray, h2: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
        """Weight rows of the three features of a history at a node."""
        at = node.astype(U64) << U64(40)
        one, two = h1.astype(U64), h2.astype(U64)
        place = self.region[h1] * (self.n_rows // REGIONS), self.window[h1]
        in_window = lambda x: (place[0] + (mix64(x).astype(np.int64) & place[1])) & (self.n_rows - 1)
        skip = mix64(at | two | U64(1 << 39)) & U64(SKIP_ROWS - 1)
        return in_window(at | one), in_window(mix64(at | one) ^ two), skip.astype(np.int64) + self.n_rows

    def powers(self, rows: tuple[np.ndarray, ...], node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unnormalised probabilities of the 16 places of a node, and their sums.

        Weights lie within ``MAX_WEIGHT`` and biases between -30 and 0, so nothing overflows and no sum is 0.
        """
        x = self.weight.take(rows[0], 0)
        x += self.weight.take(rows[1], 0)
        x += self.weight.take(rows[2], 0)
        x += self.bias.take(node, 0)
        np.exp(x, x)
        return x, x @ np.ones(WIDTH, x.dtype)

    def log_prob(self, h1: np.ndarray, h2: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Natural log of P(sym | h2 h1), in bounded steps."""
        out = np.zeros(len(sym))
        for i in range(0, len(sym), _STEP):
            s = slice(i, i + _STEP)
            for at, node, place in self.levels(sym[s]):
                e, total = self.powers(self.rows(h1[s][at], h2[s][at], node), node)
                out[i + at] += np.log(e[np.arange(len(at)), place] / total)
        return out


def _parts(x: Table | Model) -> tuple[np.ndarray, ...]:
    """Plain arrays, which workers can unpickle without this package."""
    return tuple(getattr(x, f.name) for f in fields(x))


_NAMES = [f"g{i}" for i in range(2 * WIDTH)]


def _gradient(model):
    """N-grams (k, c) -> first derivatives and bounds of the second ones by weight row, summed over the task.

    With E tokens expected at a place and N at all places of a row, E * (1 - E / N) bounds its second derivative.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        expected, seen = np.zeros((2, m.weight.size))
        touched, mask = np.zeros(len(m.weight), bool), (1 << BITS) - 1
        pairs = expected.view(np.complex128)  # two places are added as one number
        places = np.arange(pairs.size).reshape(len(m.weight), -1)
        for b in batches:
            key, count = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.float64)
            for i in range(0, len(key), _STEP):
                k, c = key[i : i + _STEP], count[i : i + _STEP]
                h1, h2 = (k >> BITS) & mask, k >> 2 * BITS
                for at, node, place in m.levels(k & mask):
                    rows = m.rows(h1[at], h2[at], node)
                    p, total = m.powers(rows, node)
                    p *= (c[at] / total).astype(np.float32)[:, None]
                    flat, n = p.astype(np.float64).view(np.complex128).ravel(), c[at]
                    for r in rows:
                        np.add.at(pairs, places.take(r, 0).ravel(), flat)
                        np.add.at(seen, r * WIDTH + place, n)
                        touched[r] = True
        expected, seen, rows = expected.reshape(-1, WIDTH), seen.reshape(-1, WIDTH), np.flatnonzero(touched)
        for i in range(0, len(rows), 1 << 14):
            r = rows[i : i + (1 << 14)]
            e, n = expected[r], seen[r]
            d = np.concatenate([n - e, e * (1 - e / n.sum(1, keepdims=True)).clip(0)], 1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(r), *(pa.array(x) for x in d.T.copy())], names=["r", *_NAMES])

    return run


def _derivatives(model):
    """Packed n-grams (k, c) -> rows (at, r, d): derivatives of the weight rows ``r`` from ``at * _PLACES`` on, in bytes."""
    gradient = _gradient(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gradient(x for b in batches for x in _unpack(b.column(0), b.column(1))):
            r, d = b.column(0).to_numpy(), np.stack([x.to_numpy() for x in b.columns[1:]], 1)
            cuts = np.append(np.flatnonzero(np.diff(r // _PLACES, prepend=-1)), len(r))
            own = [slice(*x) for x in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((r[cuts[:-1]] // _PLACES).astype(np.int32)), pa.array([(r[x] % _PLACES).astype(np.int16).tobytes() for x in own], pa.binary()),
                 pa.array([d[x].tobytes() for x in own], pa.binary())], names=["at", "r", "d"],
            )

    return run


def _update(model, pull: float, prior: float, step: float):
    """Rows (at, r, d) of this round, and those this gave for earlier ones -> summed second derivatives and new weights.

    Only the weights travel to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, sums = Model(*model.value).weight, {}
        for b in batches:
            for at, r, d in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                r = np.frombuffer(r.as_buffer(), np.int16)
                d = np.frombuffer(d.as_buffer(), np.float32).reshape(len(r), -1)
                if at not in sums:
                    sums[at] = np.zeros((_PLACES, 2 * WIDTH)), np.zeros(_PLACES, bool)
                sums[at][0][r, 2 * WIDTH - d.shape[1] :] += d  # earlier rounds only have second derivatives
                sums[at][1][r] = True
        for at, (d, touched) in sums.items():
            r = np.flatnonzero(touched)
            d, w = d[r], old[at * _PLACES + r].astype(np.float64)
            w += np.clip((d[:, :WIDTH] - pull * w) / (d[:, WIDTH:] + prior) * step, -2, 2)
            w = w.clip(-MAX_WEIGHT, MAX_WEIGHT)
            parts = r.astype(np.int16), d[:, WIDTH:].astype(np.float32), w.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["at", "r", "d", "w"]
            )

    return run


def write_blocks(ngrams: DataFrame, blocks: int) -> DataFrame:
    """``ngrams`` (k, c), or packed (block, k, c), as a table (k, c, block) of which a round reads its own block only."""
    block = "block" if "block" in ngrams.columns else F.expr(f"CAST(pmod(xxhash64(k), {blocks}) AS INT)").alias("block")
    return materialize(ngrams.select("k", "c", block), "ngrams", "block", blocks)


def fit(ngrams: DataFrame, m: Model, *, blocks: int = 5, prior: float = 2.0, step: float = STEP) -> Model:
    """``m`` trained on packed n-grams (k, c, block): a distributed gradient round over each of ``blocks`` blocks of them.

    A weight moves by its first derivative in the block over the sum of its
    second derivatives in this and earlier blocks and a Gaussian prior, a third
    of it as three features share a history.
    """
    spark = ngrams.sparkSession
    m = Model(m.count, m.bias, m.weight.copy())
    rows, before = "at int, r binary, d binary", None
    for i in range(blocks):
        sent = spark.sparkContext.broadcast(_parts(m))
        d = ngrams.where(F.col("block") == i).select("k", "c").mapInArrow(_derivatives(sent), rows)
        if before is not None:
            d = d.union(before.select("at", "r", "d"))
        sums = d.repartition("at").mapInArrow(_update(sent, prior / blocks, prior, step), rows + ", w binary")
        sums = materialize(sums, "derivatives")
        got = sums.select("at", "r", "w").toArrow()
        sent.destroy()  # else the driver keeps a model a round
        if before is not None:
            discard(before)
        before = sums
        for b in got.to_batches():
            for at, r, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                r = np.frombuffer(r.as_buffer(), np.int16).astype(np.int64)
                m.weight[at * _PLACES + r] = np.frombuffer(w.as_buffer(), np.float32).reshape(-1, WIDTH)
        del got, sums, d
        release_shuffles(spark)
    discard(before)
    return m


def _score(table, model, log_n: float, log_other: float):
    ln10 = np.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, m = Table(*table.value), Model(*model.value)
        logs = np.log10(np.maximum(t.count, 0) + 1.0)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            rare, cuts = [], [np.zeros(1, np.int64)]
            for w in iter_words(b.column(1)):
                h, doc, bounds, slot, sym, h1, h2 = _symbols(t, w, m.other)
                found = slot >= 0
                log_c = np.where(found, logs[slot], 0.0)
                s = m.log_prob(h1, h2, sym) / ln10 + np.where(sym == m.other, log_c - log_other, 0.0)
                add = lambda x: np.bincount(doc, x, w.n_docs)  # noqa: E731, B023
                n = np.diff(bounds)
                for c, x in zip(cols, (n, add(found), add(log_c) - n * log_n, add(s)), strict=False):
                    c.append(x)
                rare.append(h[~found])
                cuts.append(cuts[-1][-1] + np.cumsum(np.bincount(doc[~found], minlength=w.n_docs)))
            n, known, base, score = (np.concatenate(c) if c else np.zeros(0) for c in cols[:4])
            tails = pa.ListArray.from_arrays(
                pa.array(np.concatenate(cuts).astype(np.int32)), pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), tails],
                names=["doc_id", "n_tokens", "known", "base", "score", "rare"],
            )

    return run


def score_texts(docs: DataFrame, *, fold: int = 7, held_out_fold: int = 2, blocks: int = 5) -> DataFrame:
    """Row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose ``crc32(doc_id) % fold`` is not ``held_out_fold`` teach the
    counts and the model.  Tokens are the words and one end per text, so null
    and empty texts have one token.  Rows that repeat an id count and are
    scored each.  A null id is scored, never held out and never learned from.
    An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold))
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = src.where(rest != held_out_fold).select("text")

    vocab = train.mapInArrow(_count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    vocab = materialize(vocab, "vocabulary")
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("h")).first()
    release_shuffles(spark)
    words, counts = _frequent(vocab)
    n_sym = min(int((counts >= MIN_COUNT).sum()), MAX_WORDS)
    symbols = {w: i for i, w in enumerate(words[:n_sym].tolist())}
    table = Table.build(words, counts, symbols, n_sym)
    del symbols
    other = total - int(counts[:n_sym].sum())
    log_n = float(np.log10(total + distinct + 1))
    log_other = float(np.log10(other + distinct - n_sym + 1))
    rows = min(max(MIN_ROWS, 1 << (total // TOKENS_A_ROW).bit_length()), MAX_ROWS)
    texts = int(counts[words == END_HASH].sum())
    model = Model.new(np.append(counts[:n_sym], other + distinct - n_sym + 1), texts, rows)
    sent, blank = (spark.sparkContext.broadcast(_parts(x)) for x in (table, model))
    del table

    grams = train.mapInArrow(_ngrams(sent, blank), "part int, k binary, c binary")
    grams = write_blocks(grams.repartition("part").mapInArrow(_merge_parts(blocks), "block int, k binary, c binary"), blocks)
    blank.destroy()
    release_shuffles(spark)
    model = fit(grams, model, blocks=blocks)
    discard(grams)

    part = "doc_id bigint, n_tokens bigint, known bigint, base double, score double, rare array<bigint>"
    trained = spark.sparkContext.broadcast(_parts(model))
    del model
    scored = src.mapInArrow(_score(sent, trained, log_n, log_other), part)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    sent.destroy()
    trained.destroy()
    rare = scored.select("row", F.explode("rare").alias("h")).join(vocab, "h")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("log_c"))
    out = scored.join(rare, "row", "left")
    log_c = F.coalesce("log_c", F.lit(0.0))
    return out.select(
        "doc_id", F.coalesce(rest == held_out_fold, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + log_c).alias("base_score"), (F.col("score") + log_c).alias("score"),
    )


def _frequent(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words above a count that at most ``MAX_TABLE_WORDS`` words reach, and the end, with counts, by falling count."""
    band = F.floor(F.log2("c") * 8)
    sizes = vocab.groupBy(band.alias("b")).count().orderBy(F.desc("b")).collect()
    n, least = 0, None
    for b, k in sizes:
        if n + k > MAX_TABLE_WORDS:
            break
        n, least = n + k, b
    got = vocab.where((band >= least) | (F.col("h") == END_HASH)) if least is not None else vocab.where(F.col("h") == END_HASH)
    got = got.toArrow()
    words, counts = got.column("h").to_numpy(), got.column("c").to_numpy()
    order = np.lexsort((words, -counts))
    return words[order], counts[order]
