"""Chroma audio fingerprints: integral-image filters over pitch-class frames, and alignment of recordings.

Audio is cut into overlapping frames; the energy of each spectrum is folded
into 12 pitch classes.  Sixteen rectangle filters over the (time, class) image,
evaluated on its integral image, are quantized to two bits each: one 32-bit
integer a step.  Half of the filters of two integers a few steps apart make a
key: every offset at which a key agrees is proposed, the bit error rate over
the overlap decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATE, FRAME, HOP, SPAN = 4000, 512, 128, 12
MAX_ERROR, MIN_OVERLAP = 0.25, 24
#: the bits of every other filter; a key is one half of two integers so many steps apart
KEY_MASKS, KEY_GAP = (0xCCCCCCCC, 0x33333333), 6


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, steps): time and class contrasts at growing scales, by a rule."""
    return [(i % 4, (5 * i) % 9, 2 + i % 3, 4 + 2 * (i % 5)) for i in range(16)]


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Pitch-class frames (n, steps, 12) of recordings of one length (n, samples), each frame of unit length."""
    steps = max(0, (pcm.shape[1] - FRAME) // HOP + 1)
    if not steps:
        return np.zeros((len(pcm), 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME, 1)[:, ::HOP][:, :steps] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=2)) ** 2
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (freq > 50) & (freq < RATE / 2 - 1)
    fold = np.zeros((len(freq), 12))
    fold[np.flatnonzero(use), np.round(12 * np.log2(freq[use] / 440)).astype(int) % 12] = 1
    c = np.sqrt(power @ fold)
    size = np.linalg.norm(c, axis=2, keepdims=True)
    return np.where(size > 1e-9, c / np.maximum(size, 1e-9), 0)


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """uint32 (n, steps - SPAN + 1) of recordings of one length."""
    c = chroma(pcm.astype(np.float64))
    n, steps, _ = c.shape
    m = max(0, steps - SPAN + 1)
    image = np.zeros((n, steps + 1, 13))
    image[:, 1:, 1:] = c.cumsum(1).cumsum(2)
    t = np.arange(m)

    def area(t0, t1, k0, k1):
        return image[:, t1][:, :, k1] - image[:, t0][:, :, k1] - image[:, t1][:, :, k0] + image[:, t0][:, :, k0]

    out = np.zeros((n, m), np.uint32)
    for kind, k, high, wide in filters():
        mid, half = wide // 2, k + max(1, high // 2)
        if kind == 0:  # early against late
            a, b = area(t, t + mid, k, k + high), area(t + mid, t + wide, k, k + high)
        elif kind == 1:  # low against high classes
            a, b = area(t, t + wide, k, half), area(t, t + wide, half, k + high)
        elif kind == 2:  # opposite corners
            a = area(t, t + mid, k, half) + area(t + mid, t + wide, half, k + high)
            b = area(t + mid, t + wide, k, half) + area(t, t + mid, half, k + high)
        else:  # middle against both sides
            a, q = area(t + wide // 4, t + wide - wide // 4, k, k + high), area(t, t + wide, k, k + high)
            b = q - a
        x = np.log1p(a) - np.log1p(b)
        level = np.digitize(np.round(x, 9), (-0.2, 0.0, 0.2))
        out = out << np.uint32(2) | (level ^ (level >> 1)).astype(np.uint32)  # Gray code: near levels differ by one bit
    return out


def pcm_reader(b: pa.RecordBatch) -> list[np.ndarray]:
    """Second column as 16-bit little-endian mono samples; null is silence of no length."""
    return [np.frombuffer((x or b"")[: len(x or b"") // 2 * 2], "<i2") for x in b.column(1).to_pylist()]


def fingerprints(audio: DataFrame, reader: Callable[[pa.RecordBatch], list[np.ndarray]] = pcm_reader) -> DataFrame:
    """(id, n_frames, digest, fp: array<bigint>) of ``audio(id, data)``.

    Null, empty and too short recordings have an empty fingerprint.  Rows that
    repeat an id are fingerprinted each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                sounds = reader(b)
                fps: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(sounds)
                by: dict[int, list[int]] = {}
                for i, x in enumerate(sounds):
                    by.setdefault(len(x), []).append(i)
                for at in by.values():
                    for p in range(0, len(at), 32):
                        part = at[p : p + 32]
                        for i, f in zip(part, fingerprint(np.stack([sounds[i] for i in part])), strict=True):
                            fps[i] = f
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).cast(pa.int64()), pa.array([len(f) for f in fps], pa.int64()),
                        pa.array([hashlib.sha256(f.tobytes()).hexdigest() for f in fps]), pa.array([f.astype(np.int64) for f in fps], pa.list_(pa.int64())),
                    ],
                    names=["id", "n_frames", "digest", "fp"],
                )

    return audio.mapInArrow(run, "id bigint, n_frames bigint, digest string, fp array<bigint>")


def align(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, r, offset, overlap, errors, error_rate) of recordings that align, at their best offset.

    Both are (id, fp) with distinct fingerprints.  A recording never aligns with itself.  Every offset at which half
    of the filters agree in two integers ``KEY_GAP`` steps apart is checked; the least error rate is the best.
    """
    def keys(prints: DataFrame, name: str) -> DataFrame:
        d = prints.select("id", "fp", F.explode(F.array(*(F.lit(m).cast("bigint") for m in KEY_MASKS))).alias("m"))
        n = F.greatest(F.size("fp") - KEY_GAP, F.lit(0))
        both = F.zip_with(F.slice("fp", 1, n), F.slice("fp", KEY_GAP + 1, n), lambda a, b: F.shiftleft(a.bitwiseAND(F.col("m")), 32).bitwiseOR(b.bitwiseAND(F.col("m"))))
        return d.select(F.col("id").alias(name), F.posexplode(both).alias(f"at_{name}", "k"))

    hits = keys(queries, "q").join(keys(prints, "r"), "k").where("q <> r")
    offsets = hits.select("q", "r", (F.col("at_r") - F.col("at_q")).alias("offset")).distinct()
    d = offsets.join(queries.select(F.col("id").alias("q"), F.col("fp").alias("x")), "q").join(prints.select(F.col("id").alias("r"), F.col("fp").alias("y")), "r")
    d = d.withColumn("lo", F.greatest(F.lit(0), -F.col("offset")))
    d = d.withColumn("overlap", F.greatest(F.lit(0), F.least(F.size("x"), F.size("y") - F.col("offset")) - F.col("lo")))
    x, y = F.slice("x", F.col("lo") + 1, F.col("overlap")), F.slice("y", F.col("lo") + F.col("offset") + 1, F.col("overlap"))
    d = d.withColumn("errors", F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, e: s + e))
    d = d.where(F.col("overlap") >= MIN_OVERLAP).withColumn("error_rate", F.col("errors") / (32 * F.col("overlap")))
    d = d.where(F.col("error_rate") <= MAX_ERROR).groupBy("q", "r").agg(
        F.min(F.struct("error_rate", F.abs("offset").alias("far"), "offset", "overlap", "errors")).alias("b")
    )
    return d.select("q", "r", "b.offset", "b.overlap", "b.errors", "b.error_rate")


def match_recordings(prints: DataFrame, *, query_every: int = 20) -> DataFrame:
    """Row per recording: id, n_frames, digest, class_id, is_query, n_matches, best_id, best_offset, best_error.

    Equal fingerprints are a class, named by its smallest id; classes are
    aligned once.  Queries are the ids divisible by ``query_every``; their
    matches are other classes (empty fingerprints match nothing).
    """
    prints = materialize(prints, "prints")
    classes = prints.groupBy("digest").agg(F.min("id").alias("class_id"), F.first("fp").alias("fp"), F.bool_or(F.col("id") % query_every == 0).alias("asked"))
    classes = materialize(classes, "classes")
    reps = classes.where("size(fp) > 0").select(F.col("class_id").alias("id"), "fp", "asked")
    found = align(reps.select("id", "fp"), reps.where("asked").select("id", "fp"))
    found = found.groupBy("q").agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.struct("error_rate", "r", "offset")).alias("b"))
    named = classes.select("digest", "class_id").join(found, F.col("class_id") == F.col("q"), "left")
    d = prints.select("id", "n_frames", "digest").join(named, "digest")
    ask = F.coalesce(F.col("id") % query_every == 0, F.lit(False))
    return d.select(
        "id", "n_frames", "digest", "class_id", ask.alias("is_query"), F.when(ask, F.coalesce("n_matches", F.lit(0).cast("bigint"))).alias("n_matches"),
        F.when(ask, F.col("b.r")).alias("best_id"), F.when(ask, F.col("b.offset")).alias("best_offset"), F.when(ask, F.col("b.error_rate")).alias("best_error"),
    )


def melody_reader(b: pa.RecordBatch) -> list[np.ndarray]:
    """Vectors rendered as sound: a note a component, its pitch by the component's size."""
    t = np.arange(250) / RATE
    out = []
    for v in b.column(1).to_pylist():
        v = np.array(v or [], np.float64)
        scale = np.sqrt((v**2).mean()) if len(v) else 1
        pitch = np.clip(np.round(12 * v / max(scale, 1e-9)), -24, 24)
        freq = 440 * 2 ** (pitch / 12)
        out.append((12000 * np.sin(2 * np.pi * freq[:, None] * t[None])).ravel().astype("<i2"))
    return out
