"""Line deduplication: a segment-partition edit-distance join over all lines.

A line of ``l`` characters may differ by ``t = min(tau, l // CHARS_PER_EDIT)``
edits from a longer one.  It is split into ``t + 1`` even segments; lines within
``t`` edits share at least one segment of the shorter, up to a small shift.  So
every line probes, for each shorter length and segment, the substrings of the
multi-match-aware selection (12 keys a line for ``t = 2``); the keys of its own
length and no shift are its index entries.  Keys hash (length, segment,
content).

Lines that meet under a key are told apart by a packed signature (length and
character counts): ``t`` edits move it by a bounded amount.  Lists of up to
``SHORT`` lines give their pairs.  A longer list gives a star: each member with
the list's first.  After stars are verified, only members in different
components with near signatures are still open; they meet block against block
inside tasks, which hold their texts, verify, and emit the links of a spanning
forest.  So a list gives rows in proportion to its length, no link is lost, and
a key with many lines, found by counting a sixteenth of all lines, never goes
through one task.  Every verification is a banded bit-parallel edit distance
over many pairs at once.

Links become classes, and the first occurrence of a class, by (doc_id, line
number), stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, connected_components, discard, join_hot, list_blocks, materialize, materialize_only
from .textops import _LOWER, _SPACE, U64, _chunks, _powers, mix64, text_buffers

TAU = 2
#: a line may differ by one edit for so many of its characters, up to ``TAU``; shorter ones compare exactly
CHARS_PER_EDIT = 10
#: lists of up to this many lines give all their pairs, at most (SHORT - 1) / 2 a line
SHORT = 8
#: lines and bytes of text of a block of a longer list
BLOCK_LINES, BLOCK_BYTES = 2048, 8 << 20
#: lists that are expected to be this long, and hold a 20,000th of all keys, don't go through one task
HOT_LIST, _SAMPLE = 512, 16
#: texts of candidate lines are picked by a broadcast list of up to this many ids, else by a join
MAX_BROADCAST_LINES = 2_000_000
MAX_BROADCAST_KEYS = 200_000
_LANES = 14  # character classes counted in the signature, four bits each
_LOCAL = 1 << 18  # line hashes a task remembers to avoid repeated keys
_PAIRS = 1 << 15  # pairs that are verified at once


class _Lines:
    """Trimmed, non-empty lines of a chunk of texts, ASCII case folded."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int):
        lo, hi = int(offsets[i]), int(offsets[j])
        self.raw = data[lo:hi]
        b = _LOWER[self.raw]
        n = hi - lo
        own = offsets[i : j + 1] - lo
        brk = np.flatnonzero(b == 10)
        start = np.union1d(own[:-1], brk + 1)
        start = start[start < n] if n else start[:0]
        end = np.append(start[1:], n)
        doc = np.searchsorted(own, start, "right") - 1
        ink = np.concatenate([[0], np.cumsum(~_SPACE[b])])
        where = np.flatnonzero(~_SPACE[b])
        some = ink[end] > ink[start]
        start, end, doc, all_start = start[some], end[some], doc[some], start
        start, end = where[ink[start]], where[ink[end] - 1] + 1
        # the line's number in its text counts blank lines, too
        all_doc = np.searchsorted(own, all_start, "right") - 1
        number = np.arange(len(all_start)) - np.searchsorted(all_doc, np.arange(j - i))[all_doc]
        self.doc, self.number, self.start, self.end, self.b = doc + i, number[some], start, end, b
        up, self.inv = _powers(n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum((b.astype(U64) + U64(1)) * up[:n], out=self.prefix[1:])
        self.hash = mix64(self.span(start, end))
        self.first = (b & 0xC0) != 0x80  # bytes that begin a character
        self.chars = np.concatenate([[0], np.cumsum(self.first)])
        self.size = self.chars[end] - self.chars[start]
        self.at = np.append(np.flatnonzero(self.first), n)  # byte offset of each character

    def span(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.prefix[e] - self.prefix[s]) * self.inv[s]

    def signature(self) -> np.ndarray:
        """Length modulo 256 and, modulo 16, the counts of 14 character classes."""
        out = (self.size & 255).astype(U64) << U64(56)
        lane = (self.b % 32) % _LANES
        lane[~self.first] = 255
        for k in range(_LANES):
            c = np.concatenate([[0], np.cumsum(lane == k, dtype=np.int32)])
            out |= ((c[self.end] - c[self.start]) & 15).astype(U64) << U64(4 * k)
        return out

    def keys(self, rows: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
        """Probe keys of some lines: (index into ``rows``, key), sorted by index."""
        size, c0 = self.size[rows], self.chars[self.start[rows]]
        owners, keys = [], []
        for delta in range(tau + 1):
            allowed = _budget(size - delta, tau)
            for t in range(max(delta, 1), tau + 1):
                r = np.flatnonzero(allowed == t)
                l, c = size[r], c0[r]
                base, extra = np.divmod(l - delta, t + 1)
                p = np.zeros(len(r), np.int64)
                for i in range(t + 1):
                    width = base + (i >= t + 1 - extra)
                    for shift in range(max(-i, delta - (t - i)), min(i, delta + (t - i)) + 1):
                        ok = (p + shift >= 0) & (p + shift + width <= l)
                        a = c[ok] + p[ok] + shift
                        salt = (l[ok] - delta).astype(U64) * U64(64) + U64(i)
                        owners.append(r[ok])
                        keys.append(mix64(self.span(self.at[a], self.at[a + width[ok]]) + mix64(salt)))
                    p = p + width
        owner, key = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((owners, np.int64), (keys, U64)))
        order = np.argsort(owner, kind="stable")
        return owner[order], key[order]


def _budget(size: np.ndarray, tau: int) -> np.ndarray:
    """Edits by which a line of ``size`` characters may differ from a longer one."""
    return np.clip(size // CHARS_PER_EDIT, 0, tau)


def _scan(tau: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_LOCAL, U64)  # direct-mapped: a line that is pushed out only repeats its keys
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(b.column(1))
            for i, j in _chunks(offsets):
                w = _Lines(data, offsets, i, j)
                _, new = np.unique(w.hash, return_index=True)
                slot = (w.hash[new] & U64(_LOCAL - 1)).astype(np.int64)
                again = seen[slot] == w.hash[new]
                seen[slot] = w.hash[new]
                new = np.sort(new[~again])
                owner, keys = w.keys(new, tau)
                width = np.zeros(len(w.hash), np.int64)
                width[new] = np.bincount(owner, minlength=len(new))
                cut = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[w.doc], pa.int64()), pa.array(w.number.astype(np.int32)), pa.array(w.hash.view(np.int64)),
                        pa.array(w.signature().view(np.int64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(keys.view(np.int64))),
                    ],
                    names=["doc_id", "line_no", "h", "sig", "keys"],
                )

    return run


def _near(x: np.ndarray, y: np.ndarray, tau: int) -> np.ndarray:
    """Signatures that ``tau`` edits may turn into each other."""
    d = (x >> U64(56)).astype(np.int64) - (y >> U64(56)).astype(np.int64) & 255
    ok = np.minimum(d, 256 - d) <= tau
    moved = np.zeros(np.broadcast_shapes(x.shape, y.shape), np.int64)
    for k in range(_LANES):
        d = ((x >> U64(4 * k)) - (y >> U64(4 * k))).astype(np.int64) & 15
        moved += np.minimum(d, 16 - d)
    return ok & (moved <= 2 * tau)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, mask=m) for v, m in columns.values()], names=list(columns))


def _pairs(tau: int):
    """Rows (k, h, sig) sorted by (k, h) -> candidate pairs (null, a, b) of short lists, rows (k, h, sig) of longer ones."""

    def long_rows(k, h, sig):
        return _batch(k=(k, None), a=(h, None), b=(sig, None))

    def lists(k, h, sig, cut):
        """All lists at once: the pairs of every size, and the rows of the long ones."""
        size = np.diff(cut)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(2, SHORT + 1):
            at = cut[:-1][size == n]
            for i in range(n if len(at) else 0):
                for j in range(i + 1, n):
                    left.append(at + i)
                    right.append(at + j)
        x, y = np.concatenate(left), np.concatenate(right)
        ok = _near(sig[x].view(U64), sig[y].view(U64), tau)
        x, y = x[ok], y[ok]  # rows are sorted by h within a list
        if len(x):
            yield _batch(k=(np.zeros(len(x), np.int64), np.ones(len(x), bool)), a=(h[x], None), b=(h[y], None))
        long = np.repeat(size > SHORT, size)
        if long.any():
            yield long_rows(k[cut[0] : cut[-1]][long], h[cut[0] : cut[-1]][long], sig[cut[0] : cut[-1]][long])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_key = None, None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(i).to_numpy() for i in range(3)]
            if held is not None:  # the list that the last batch left open
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            k, h, sig = (x[new] for x in rows)
            if long_key is not None:  # more of a list that is known to be long
                n = int(np.searchsorted(k != long_key, True))
                if n:
                    yield long_rows(k[:n], h[:n], sig[:n])
                k, h, sig = k[n:], h[n:], sig[n:]
                if not len(k):
                    held = None
                    continue
            long_key = None
            cut = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
            last = int(cut[-2])
            if len(k) - last > SHORT:
                yield from lists(k, h, sig, cut)
                held, long_key = None, k[-1]
            else:
                yield from lists(k, h, sig, cut[:-1])
                held = [x[last:].copy() for x in (k, h, sig)]
        if held is not None:
            yield from lists(*held, np.array([0, len(held[0])]))

    return run


def _stars(tau: int):
    """Rows (h, sig, p_h, p_sig) -> pairs with the list's first line whose signatures are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, sig, ph, ps = (b.column(i).to_numpy() for i in range(4))
            ok = (h != ph) & _near(sig.view(U64), ps.view(U64), tau)
            yield _batch(a=(np.minimum(h, ph)[ok], None), b=(np.maximum(h, ph)[ok], None))

    return run


def edit_distances_within(left: list[str], right: list[str], tau: int) -> np.ndarray:
    """Whether each pair is within its budget of edits, at most ``tau``; shorter lines have smaller budgets.

    A band of ``2 * tau + 1`` diagonals is one machine word: bit ``d`` of level
    ``e`` says that diagonal ``d`` reaches the current character with at most
    ``e`` edits.  A column updates all levels of all pairs by shifts.
    """
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    swap = sizes[:, 0] > sizes[:, 1]
    a = [y if s else x for x, y, s in zip(left, right, swap, strict=True)]
    b = [x if s else y for x, y, s in zip(left, right, swap, strict=True)]
    la, lb = sizes.min(1), sizes.max(1)
    allowed = _budget(la, tau)
    out = (allowed == 0) & np.array([x == y for x, y in zip(a, b, strict=True)], bool)
    todo = np.flatnonzero((allowed > 0) & (lb - la <= allowed))
    todo = todo[np.argsort(lb[todo], kind="stable")]
    while len(todo):  # groups of about equal length and bounded size
        n = 1
        while n < len(todo) and n < _PAIRS and (n + 1) * int(lb[todo[n]]) <= max(1 << 20, 2 * int(lb[todo[0]])):
            n += 1
        rows, todo = todo[:n], todo[n:]
        out[rows] = _band([a[i] for i in rows], [b[i] for i in rows], la[rows], lb[rows], allowed[rows], tau)
    return out


def _matrix(texts: list[str], before: int, width: int, fill: int) -> np.ndarray:
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), width), fill, np.uint32)
    where = np.repeat(np.arange(len(texts)) * width + before, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out.ravel()[where] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return out


def _band(a, b, la, lb, allowed, tau) -> np.ndarray:
    """Pairs with ``len(a) <= len(b)``, sorted by ``len(b)``."""
    n, width, word = len(a), int(lb[-1]), np.uint8 if tau < 4 else np.uint32
    x, y = _matrix(a, tau, width + 2 * tau, 0xFFFFFFFF), _matrix(b, 0, width, 0xFFFFFFFE)
    same = np.zeros((width, n), word)  # bit d: a[j + d - tau] == b[j]
    for d in range(2 * tau + 1):
        same |= ((x[:, d : d + width] == y).T.astype(word) << word(d)).astype(word)
    full, one = word((1 << (2 * tau + 1)) - 1), word(1)
    # before the first column diagonal tau + e stands for e characters of a consumed
    level = [np.full(n, ((1 << (e + 1)) - 1) << tau, word) for e in range(tau + 1)]
    ended = np.searchsorted(lb, np.arange(width + 1), "right")  # pairs whose text ends by a column
    out, done = np.zeros(n, bool), 0
    final = word(1) << (tau + la - lb).astype(word)
    for j in range(width):
        new = []
        for e in range(tau + 1):
            v = level[e] & same[j]
            if e:
                v |= level[e - 1] | level[e - 1] >> one | new[e - 1] << one
            new.append(v & full)
        level = new
        if ended[j + 1] > done:
            r = slice(done, int(ended[j + 1]))
            reached = np.stack([level[e][r] & final[r] for e in range(tau + 1)])
            out[r] = reached[allowed[r], np.arange(r.stop - r.start)] != 0
            done = r.stop
        if j % 32 == 31 and not level[tau][done:].any():
            break
    return out


def edit_distance_within(a: str, b: str, tau: int = TAU) -> bool:
    return bool(edit_distances_within([a], [b], tau)[0])


def _texts(wanted):
    """Rows (h, line) of the lines whose hash is wanted (all, if None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = None if wanted is None else wanted.value
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            for i, j in _chunks(offsets):
                w = _Lines(data, offsets, i, j)
                _, rows = np.unique(w.hash, return_index=True)
                if want is not None:
                    rows = rows[np.isin(w.hash[rows].view(np.int64), want)]
                low = w.b.tobytes()
                lines = [low[s:e].decode("utf-8", "replace") for s, e in zip(w.start[rows].tolist(), w.end[rows].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(w.hash[rows].view(np.int64)), pa.array(lines, pa.string())], names=["h", "line"])

    return run


def _verify(tau: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = edit_distances_within(b.column(2).to_pylist(), b.column(3).to_pylist(), tau)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _grouped(names: list[str], work):
    """Rows sorted by their first column -> ``work(columns)`` of each group; a group is held as arrays until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            return work(dict(zip(names, pa.Table.from_batches(held).columns[1:], strict=True)))

        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if held and k[s] != key:
                    if (out := flush()) is not None:
                        yield out
                    held = []
                key = k[s]
                held.append(b.slice(s, e - s))
        if held and (out := flush()) is not None:
            yield out

    return run


def _near_apart(h, sig, comp, side, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group's rows, across its sides and components, whose signatures are near; block by block."""
    sig, alone = sig.view(U64), bool((side == 0).all())
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    parts = 2 * tau + 1 if len(left) * len(right) > 1 << 16 else 1
    for p in range(parts):  # of 2 * tau + 1 parts of the signature one is the same on both sides
        mask = U64(sum(15 << (4 * k) for k in range(_LANES) if k % parts == p) if parts > 1 else 0)
        ls, rs = (x[np.argsort(sig[x] & mask, kind="stable")] for x in (left, right))
        keys = np.unique(sig[left] & mask)
        la, lz, ra, rz = (np.searchsorted(sig[x] & mask, keys, s) for x in (ls, rs) for s in ("left", "right"))
        for g in np.flatnonzero((lz > la) & (rz > ra)):
            for s in range(int(la[g]), int(lz[g]), 256):
                xs = ls[s : min(s + 256, int(lz[g]))]
                for t in range(int(ra[g]), int(rz[g]), 2048):
                    ys = rs[t : min(t + 2048, int(rz[g]))]
                    ok = comp[xs][:, None] != comp[ys][None]
                    if alone:
                        ok &= xs[:, None] < ys[None]
                    i, j = np.nonzero(ok)
                    near = _near(sig[xs[i]], sig[ys[j]], tau)
                    if near.any():
                        yield xs[i[near]], ys[j[near]]


def _suspects(tau: int):
    """A group's members that may be near a member of another component."""

    def work(c):
        h, sig, comp, side = (c[k].to_numpy() for k in ("h", "sig", "comp", "side"))
        if len(np.unique(comp)) < 2:
            return None
        hit = np.zeros(len(h), bool)
        for x, y in _near_apart(h, sig, comp, side, tau):
            hit[x] = hit[y] = True
        at = np.flatnonzero(hit)
        if not len(at):
            return None
        return _batch(pair=(c["pair"].to_numpy()[at], None), h=(h[at], None), sig=(sig[at], None), comp=(comp[at], None), side=(side[at], None))

    return _grouped(["h", "sig", "comp", "side", "pair"], work)


def _find(root: dict, x):
    while root.setdefault(x, x) != x:
        root[x] = x = root[root[x]]
    return x


def _group_links(tau: int):
    """A group's links between components: a spanning forest, verified batch by batch so that joined components drop out."""

    def work(c):
        h, sig, side = (c[k].to_numpy() for k in ("h", "sig", "side"))
        comp, texts, root, links = c["comp"].to_numpy(), c["line"], {}, []
        _, comp = np.unique(comp, return_inverse=True)
        now = np.arange(comp.max() + 1)
        for x, y in _near_apart(h, sig, comp, side, tau):
            for s in range(0, len(x), _PAIRS):
                a, b = x[s : s + _PAIRS], y[s : s + _PAIRS]
                apart = now[comp[a]] != now[comp[b]]
                a, b = a[apart], b[apart]
                if not len(a):
                    continue
                ok = edit_distances_within(texts.take(a).to_pylist(), texts.take(b).to_pylist(), tau)
                for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                    u, v = _find(root, int(comp[i])), _find(root, int(comp[j]))
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        links.append((min(int(h[i]), int(h[j])), max(int(h[i]), int(h[j]))))
                now = np.array([_find(root, int(v)) for v in range(len(now))])
        if not links:
            return None
        return _batch(a=(np.array([x for x, _ in links]), None), b=(np.array([x for _, x in links]), None))

    return _grouped(["h", "sig", "comp", "side", "line"], work)


def _candidates(lines: DataFrame, tau: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of short lists and stars of long ones, rows (k, h, sig) of long lists)."""
    some = lines.where("size(keys) > 0")
    keyed = some.selectExpr("explode(array_distinct(keys)) AS k", "h", "sig")
    counts = some.where(f"pmod(h, {_SAMPLE}) = 0").selectExpr("explode(array_distinct(keys)) AS k").groupBy("k").count()
    counts = materialize(counts.where(f"count >= {HOT_LIST // _SAMPLE}"), "hotkeys")
    total = some.selectExpr("sum(size(keys)) AS n").first().n or 0
    hot = F.broadcast(counts.where(F.col("count") * _SAMPLE * 20_000 >= total).select("k"))  # 20,000 keys at most, but for chance
    cold = keyed.join(hot, "k", "left_anti").repartition("k").sortWithinPartitions("k", "h")
    found = materialize(cold.mapInArrow(_pairs(tau), "k bigint, a bigint, b bigint"), "linelists")
    rows = found.where("k IS NOT NULL").selectExpr("k", "a AS h", "b AS sig").union(keyed.join(hot, "k", "left_semi"))
    rows = materialize(rows.distinct(), "longlists")
    heads = rows.groupBy("k").agg(F.expr("min(struct(h, sig)) AS p"))
    stars = rows.join(broadcast_if_small(heads, MAX_BROADCAST_KEYS), "k").selectExpr("h", "sig", "p.h AS p_h", "p.sig AS p_sig")
    pairs = found.where("k IS NULL").select("a", "b").union(stars.mapInArrow(_stars(tau), "a bigint, b bigint"))
    pairs = materialize(pairs.distinct(), "linepairs")
    discard(found, counts)
    return pairs, rows


def _open_links(src: DataFrame, rows: DataFrame, comps: DataFrame, tau: int) -> DataFrame | None:
    """Links of long lists between lines that are still in different components; None if there are none."""
    d = rows.join(comps.selectExpr("node AS h", "comp"), "h", "left").selectExpr("k", "h", "sig", "coalesce(comp, h) AS comp")
    d = materialize(d, "openlists")
    sizes = d.groupBy("k").agg(F.expr("min(comp) AS lo"), F.expr("max(comp) AS hi"), F.expr(f"ceil(count(1) / {BLOCK_LINES}) AS blocks"))
    sizes = sizes.where("lo <> hi").select("k", "blocks")
    d2 = list_blocks(d.join(broadcast_if_small(sizes, MAX_BROADCAST_KEYS), "k"), "k", "h", "blocks")
    d2 = d2.selectExpr("pair", "h", "sig", "comp", "side", "pair AS again").repartition("pair").sortWithinPartitions("pair")
    found = materialize(d2.mapInArrow(_suspects(tau), "pair bigint, h bigint, sig bigint, comp bigint, side int"), "suspects")
    if not found.limit(1).count():
        discard(d, found)
        return None
    texts = _line_texts(src, found.select("h").distinct())
    found2 = found.join(texts, "h")
    # long lines make smaller blocks
    sizes = found2.groupBy("pair").agg(F.expr(f"ceil(sum(octet_length(line)) / {BLOCK_BYTES}) AS blocks"))
    wide = F.broadcast(sizes.where("blocks > 1").limit(0)) if not sizes.where("blocks > 1").limit(1).count() else sizes.where("blocks > 1")
    narrow = found2.join(wide, "pair", "left_anti").select("pair", "h", "sig", "comp", "side", "line")
    parts = list_blocks(found2.join(wide, "pair").withColumnRenamed("pair", "g").withColumnRenamed("side", "old"), "g", "h", "blocks")
    # a part of one block with itself, or of two; rows of the old sides only meet across them
    parts = parts.selectExpr("pair", "h", "sig", "comp", "CASE WHEN old = 0 THEN side ELSE old END AS side", "line")
    both = narrow.union(parts).repartition("pair").sortWithinPartitions("pair")
    links = materialize(both.mapInArrow(_group_links(tau), "a bigint, b bigint").distinct(), "linelinks")
    discard(d, found, texts)
    return links if links.limit(1).count() else None


def line_classes(docs: DataFrame, *, tau: int = TAU) -> DataFrame:
    """Row per non-empty line: doc_id, line_no, class_doc, class_line, kept.

    Lines end at ``\\n``, are numbered from 0 in their text, and compare
    trimmed with ASCII letters lower-cased.  Two lines are linked within
    ``min(tau, l // CHARS_PER_EDIT)`` edits, ``l`` the characters of the shorter
    one; a class is named by its first line by (doc_id, line_no), the one that
    is kept.  Null and blank texts and blank lines give no rows.  Rows that
    repeat an id count as texts of one document: equal (id, number) lines are
    all kept or dropped alike.  Rows with a null id give no rows.  Empty tables
    give none.  Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.where("doc_id IS NOT NULL")
    lines = src.mapInArrow(_scan(tau), "doc_id bigint, line_no int, h bigint, sig bigint, keys array<bigint>")
    lines = materialize(lines, "lines")
    pairs, rows = _candidates(lines, tau)
    links = _verified(src, pairs, tau)
    comps = connected_components(links)
    discard(pairs, links)
    if rows.limit(1).count() and (more := _open_links(src, rows, comps, tau)):
        comps = connected_components(comps.selectExpr("node AS a", "comp AS b").union(more))
        discard(more)
    discard(rows)

    first = lines.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("f"), F.count(F.lit(1)).alias("n"))
    named = first.join(comps.withColumnRenamed("node", "h"), "h", "left").where("n > 1 OR comp IS NOT NULL")
    named = materialize(named.select("h", "f", F.coalesce("comp", "h").alias("c")), "lineclasses")
    heads = named.groupBy("c").agg(F.min("f").alias("head"))
    named2 = materialize(join_hot(named.select("h", "c"), heads, ["c"], MAX_BROADCAST_KEYS, "h").select("h", "head"), "lineheads")
    discard(named)
    out = join_hot(lines.select("doc_id", "line_no", "h"), named2, ["h"], MAX_BROADCAST_KEYS, "doc_id, line_no")
    head = F.coalesce("head", F.struct("doc_id", "line_no"))
    out = out.select("doc_id", "line_no", head["doc_id"].alias("class_doc"), head["line_no"].alias("class_line"))
    return out.withColumn("kept", F.expr("class_doc = doc_id AND class_line = line_no"))


def _line_texts(src: DataFrame, ids: DataFrame) -> DataFrame:
    """(h, line) of the lines with the hashes ``ids(h)``."""
    spark = src.sparkSession
    if ids.limit(MAX_BROADCAST_LINES + 1).count() <= MAX_BROADCAST_LINES:
        wanted = spark.sparkContext.broadcast(np.sort(ids.toArrow().column("h").to_numpy()))
        texts = src.mapInArrow(_texts(wanted), "h bigint, line string")
    else:
        texts = src.mapInArrow(_texts(None), "h bigint, line string").join(ids, "h", "left_semi")
    return materialize(texts.groupBy("h").agg(F.min("line").alias("line")), "linetexts")


def _verified(src: DataFrame, pairs: DataFrame, tau: int) -> DataFrame:
    texts = _line_texts(src, pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    rows = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a")
    rows = rows.join(texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b")
    links = rows.select("a", "b", "line_a", "line_b").mapInArrow(_verify(tau), "a bigint, b bigint").distinct()
    links = materialize(links, "linelinks")
    discard(texts)
    return links


def repeated_lines(docs: DataFrame, groups: DataFrame | None = None, **options) -> DataFrame:
    """(doc_id, gone: array<int>) of the documents that hold repeated lines, hinted for broadcast only if few.

    ``groups(doc_id, group)`` names documents that count as one, such as proven
    near copies: a line that one of them holds first stays, once, in each.
    """

    def flagged() -> DataFrame:
        flags = line_classes(docs, **options).where("NOT kept")
        if groups is None:
            return flags.select("doc_id", "line_no")
        of = lambda c, g: groups.selectExpr(f"doc_id AS {c}", f"group AS {g}")
        flags = flags.join(of("doc_id", "g"), "doc_id", "left").join(of("class_doc", "o"), "class_doc", "left")
        flags = flags.selectExpr("*", "coalesce(g, doc_id) = coalesce(o, class_doc) AND doc_id <> class_doc AS own")
        once = flags.where("own").groupBy("doc_id", "class_doc", "class_line").agg(F.collect_set("line_no").alias("n"))
        once = once.selectExpr("doc_id", "explode(array_except(n, array(array_min(n)))) AS line_no")
        return flags.where("NOT own").select("doc_id", "line_no").union(once)

    flags = materialize_only(flagged, docs.sparkSession, "repeated")
    small = flags.limit(MAX_BROADCAST_LINES + 1).count() <= MAX_BROADCAST_LINES
    gone = flags.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    return F.broadcast(gone) if small else gone


def without_lines(text: str, gone: str) -> Column:
    """The text in SQL ``text`` without the lines numbered in ``gone``; as it is where that is null."""
    cut = f"transform(array(split({text}, '\\n')), p -> array_join(transform(array_except(sequence(0, size(p) - 1), {gone}), i -> p[i]), '\\n'))[0]"
    return F.expr(f"CASE WHEN {gone} IS NOT NULL THEN {cut} ELSE {text} END")


def drop_repeated_lines(docs: DataFrame, groups: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` with repeated lines taken out of their texts, whatever their share; all columns and rows stay.

    ``groups`` is as in ``repeated_lines``.

    Documents with no repeated line are returned as they are; one of repeated
    lines only becomes empty.  Null texts stay null; a column of any other name
    is left alone.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_key"))
    cut = packed.join(repeated_lines(docs, groups, **options).withColumnRenamed("doc_id", "_key"), "_key", "left")
    return cut.select(*(without_lines("_row.text", "gone").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))
