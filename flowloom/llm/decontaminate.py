"""Benchmark decontamination: pigeonhole edit matching of test items in texts.

An item of ``l`` characters may differ by ``k = floor(error_rate * l)`` edits.
Split into ``k + 1`` pieces, one piece must occur unchanged, so an automaton of
all pieces scans each whole text once; every piece hit proposes a window that
Myers' bit-parallel distance accepts or rejects.  Matching ignores ASCII case
and treats each white-space character as a space.

The test set is matched in blocks of bounded size, each broadcast to all
documents; documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, with_rest

ERROR_RATE = 0.06
#: characters of test items in one broadcast block
BLOCK_CHARS = 2_000_000
HIT = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"

_FOLD = bytes(32 if c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def fold(text: str) -> bytes:
    return text.encode("utf-8").translate(_FOLD)


def pieces(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """(byte offset, piece) of ``k + 1`` even pieces, cut between characters."""
    s = item.decode("utf-8")
    cuts = [len(s) * i // (k + 1) for i in range(k + 2)]
    at = [len(s[:c].encode("utf-8")) for c in cuts]
    return [(at[i], item[at[i] : at[i + 1]]) for i in range(k + 1)]


def best_match(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the best occurrence of ``item`` inside ``text``, by Myers' algorithm."""
    m = len(item)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diag | up) & mask, up & diag
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & mask, minus << 1 & mask
        eq |= down
        up, down = minus | ~(eq | plus) & mask, plus & eq
        if score < best:
            best, end = score, j + 1
    return best, end


class _Block:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            b = fold(text).strip()
            if not b:
                continue
            s = b.decode("utf-8")
            k = int(rate * len(s))
            self.items.append((item_id, b, s, k, np.bincount(np.frombuffer(b, np.uint8), minlength=256)))
            for off, p in pieces(b, k):
                found.setdefault(p.decode("latin-1"), []).append((len(self.items) - 1, off))
        self.scan = ahocorasick.Automaton()
        for p, uses in found.items():
            self.scan.add_word(p, (len(p), uses))
        if found:
            self.scan.make_automaton()

    def hits(self, text: str) -> list[dict]:
        if not self.items or not text:
            return []
        b = fold(text)
        windows: dict[int, set[int]] = {}
        for end, (n, uses) in self.scan.iter(b.decode("latin-1")):
            for i, off in uses:
                windows.setdefault(i, set()).add(end + 1 - n - off)
        out = []
        for i, starts in windows.items():
            item_id, ib, s, k, counts = self.items[i]
            best = None
            done = -(1 << 60)
            for at in sorted(starts):
                if at >= 0 and b[at : at + len(ib)] == ib:
                    lo = len(b[:at].decode("utf-8"))
                    best = (0, lo, lo + len(s))
                    break
                if at <= done or not k:
                    continue
                lo, hi = max(0, at - 4 * k), min(len(b), at + len(ib) + 8 * k)  # 4 bytes a character, starts up to 4k on share it
                win = b[lo:hi]
                lack = counts - np.bincount(np.frombuffer(win, np.uint8), minlength=256)
                if lack[lack > 0].sum() > 4 * k:
                    continue
                while lo < len(b) and b[lo] & 0xC0 == 0x80:
                    lo += 1
                win = b[lo:hi].decode("utf-8", "ignore")
                d, end = best_match(s, win)
                done = at + 4 * k
                if d <= k and (best is None or d < best[0]):
                    back = best_match(s[::-1], win[:end][::-1])[1]
                    base = len(b[:lo].decode("utf-8", "ignore"))
                    best = (d, base + end - back, base + end)
            if best:
                out.append({"item_id": item_id, "distance": best[0], "start": best[1], "end": best[2]})
        return sorted(out, key=lambda h: h["item_id"])


def _match(block, rate: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = _Block(block.value, rate)
        for rows in batches:
            hits = [b.hits(t) if t else [] for t in rows.column(1).to_pylist()]
            kept = [0] if rows.num_columns == 2 else range(rows.num_columns)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in kept), pa.array(hits, kind)], names=[*(rows.schema.names[i] for i in kept), "hits"]
            )

    return run


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """Items in blocks of about ``BLOCK_CHARS``, drawn partition by partition."""
    block, size = [], 0
    for item_id, text in items.orderBy("item_id", "text").toLocalIterator():
        if size + len(text) > BLOCK_CHARS and block:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, error_rate: float = ERROR_RATE, extra_columns: bool = False) -> DataFrame:
    """Row per document: doc_id, hits: an array of (item_id, distance, start, end), at most one per item.

    ``start`` and ``end`` are character offsets of the best occurrence in the
    text, the first of equals.  Null and empty texts have no hits; null and
    blank items match nothing; items that repeat an id are matched each; items
    too short for an edit must occur exactly.  Rows that repeat a doc_id, null
    ids included, are matched each.  An empty table gives no rows.  Other
    columns are ignored; with ``extra_columns`` the whole input row comes along
    as the struct ``row``.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("length(trim(text)) > 0")
    src, row = with_rest(docs, extra_columns)
    blocks = _item_blocks(items)
    block, more = next(blocks, []), next(blocks, None)
    sent = spark.sparkContext.broadcast(block)
    if more is None:
        fields = [f for f in src.schema.fields if f.name != "text" or extra_columns]
        schema = T.StructType([*fields, *T.StructType.fromDDL(f"hits {HIT}").fields])
        return src.mapInArrow(_match(sent, error_rate), schema).select("doc_id", *row, "hits")
    # one block at a time is on the driver and the executors
    keyed = materialize(src.withColumn("n", F.monotonically_increasing_id()), "texts")
    found = None
    while True:
        one = keyed.select(F.col("n").alias("doc_id"), "text").mapInArrow(_match(sent, error_rate), f"doc_id bigint, hits {HIT}")
        one = materialize(one.where("size(hits) > 0"), "leaks")
        sent.unpersist()
        found = one if found is None else found.union(one)
        if more is None:
            break
        sent, more = spark.sparkContext.broadcast(more), next(blocks, None)
    found = found.groupBy(F.col("doc_id").alias("n")).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return keyed.join(found, "n", "left").select("doc_id", *row, F.array_sort(F.coalesce("hits", F.array().cast(HIT))).alias("hits"))
