"""Header decoding: one vectorised pass over a batch of packets.

Ethernet with one VLAN tag, radiotap and 802.11 with LLC/SNAP, IPv4, IPv6 with
extension headers, TCP, UDP and ICMP.  Every header field is an array read over
all packets of an Arrow batch, so a plan holds one call and each byte is read
once; only ``data`` and ``link_type`` travel to Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FIVE_TUPLE

ETHERNET, RAW_80211, RADIOTAP = 1, 105, 127
_IPV4, _IPV6, _VLAN = 0x0800, 0x86DD, 0x8100
#: IPv6 next-header values that are extension headers, and the authentication header among them
_EXTENSIONS, _AUTH, _ESP, _NO_NEXT = (0, 43, 44, 51, 60), 51, 50, 59
_SNAP = bytes.fromhex("AAAA03000000")
_MAPPED = np.array([0] * 10 + [255] * 2, np.uint8)
_HEADERS = f"struct<src_mac:binary,dst_mac:binary,bssid:binary,five_tuple:{FIVE_TUPLE},l7_offset:int>"


class _Packets:
    """Byte access by offset over the packets of a batch; reads beyond a packet give bytes to be masked."""

    def __init__(self, col: pa.Array):
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        self.there = col.is_valid().to_numpy(zero_copy_only=False)
        col = col.fill_null(b"") if col.null_count else col
        kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
        _, off, data = col.buffers()
        at = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        self.bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        self.start, self.size = at[:-1], np.diff(at)

    def u8(self, at) -> np.ndarray:
        return self.bytes[np.clip(self.start + at, 0, len(self.bytes) - 1)].astype(np.int64)

    def u16(self, at) -> np.ndarray:
        return self.u8(at) << 8 | self.u8(at + 1)

    def block(self, at, n: int) -> np.ndarray:
        where = (self.start + at)[:, None] + np.arange(n)
        return self.bytes[np.clip(where, 0, len(self.bytes) - 1)]


def _binary(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of equal width as a binary array with nulls."""
    cut = np.concatenate([[0], np.cumsum(np.where(valid, rows.shape[1], 0))]).astype(np.int32)
    mask = pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [mask, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(rows[valid]))])


def _int(values: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=~valid)


def _link_layer(p: _Packets, link: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
    """MACs and BSSID, and the offset of the IP header (-1: none)."""
    n, zero = p.size, np.zeros(len(p.size), np.int64)
    eth, wifi = (link == ETHERNET) & (n >= 14), (link == RAW_80211) | (link == RADIOTAP)
    outer = p.u16(zero + 12)
    tagged = (outer == _VLAN) & (n >= 18)
    kind = np.where(tagged, p.u16(zero + 16), outer)
    ip_at = np.where(eth & np.isin(kind, (_IPV4, _IPV6)), np.where(tagged, 18, 14), -1)

    length = p.u8(zero + 2) | p.u8(zero + 3) << 8
    tap = (n >= 4) & (p.u8(zero) == 0) & (length >= 4) & (length <= n)
    w = np.where(link == RADIOTAP, np.where(tap, length, 0), 0)
    wifi &= ((link == RAW_80211) | tap) & (n >= w + 24)
    fc = p.u8(w) | p.u8(w + 1) << 8
    frame, to_ds, from_ds = fc >> 2 & 3, fc >> 8 & 1, fc >> 9 & 1
    a1, a2, a3 = (p.block(w + i, 6) for i in (4, 10, 16))
    third = (frame == 0) | ((frame == 2) & (to_ds == 0) & (from_ds == 0))
    first, second = ((frame == 2) & (to_ds == d) & (from_ds == 1 - d) for d in (1, 0))
    bssid = np.where(third[:, None], a3, np.where(first[:, None], a1, a2))
    body = w + np.where((frame == 2) & (to_ds == 1) & (from_ds == 1), 30, 24)
    snap = (p.block(body, 6) == np.frombuffer(_SNAP, np.uint8)).all(1)
    inner = wifi & snap & (n >= body + 8) & np.isin(p.u16(body + 6), (_IPV4, _IPV6))
    ip_at = np.where(inner, body + 8, ip_at)
    ip_at = np.where((link != ETHERNET) & (link != RAW_80211) & (link != RADIOTAP) & p.there, 0, ip_at)

    any_mac, e = eth | wifi, eth[:, None]
    macs = [
        _binary(np.where(e, p.block(zero + 6, 6), a2), any_mac),
        _binary(np.where(e, p.block(zero, 6), a1), any_mac),
        _binary(bssid, wifi & (third | first | second)),
    ]
    return macs, ip_at


def _chain(p: _Packets, at: np.ndarray, n: np.ndarray, six: np.ndarray, compat_auth: bool) -> tuple[np.ndarray, ...]:
    """IPv6 header chain: next header, its position, and whether the walk stopped (False: eight headers) or was cut off."""
    nh, pos = p.u8(at + 6), np.full(len(at), 40, np.int64)
    walking, stopped, cut = six.copy(), np.zeros(len(at), bool), np.zeros(len(at), bool)
    for _ in range(8):
        ext = np.isin(nh, _EXTENSIONS)
        stopped |= walking & ~ext
        cut |= walking & ext & (n < pos + 2)
        walking &= ext & ~cut
        if not walking.any():
            break
        units = p.u8(at + pos + 1)
        step = (units + 1) * 8 if compat_auth else np.where(nh == _AUTH, (units + 2) * 4, (units + 1) * 8)
        nh, pos = np.where(walking, p.u8(at + pos), nh), np.where(walking, pos + step, pos)
    return nh, pos, stopped, cut


def _headers(data: pa.Array, link_type: pa.Array, compat_auth: bool) -> pa.Array:
    p = _Packets(data)
    link = link_type.fill_null(-1).to_numpy(zero_copy_only=False)
    macs, ip_at = _link_layer(p, link)
    has = ip_at >= 0
    at = np.maximum(ip_at, 0)
    n = np.maximum(p.size - at, 0)
    first = p.u8(at)
    version, ihl = np.where(n > 0, first >> 4, 0), (first & 15) * 4
    four = has & (version == 4) & (n >= 20) & (ihl >= 20) & (n >= ihl)
    six = has & (version == 6) & (n >= 40)
    nh, pos, stopped, cut = _chain(p, at, n, six, compat_auth)
    has = four | (six & ~cut)
    proto, o = np.where(four, p.u8(at + 9), nh), np.where(four, ihl, pos)
    mapped = np.broadcast_to(_MAPPED, (len(at), 12))
    src, dst = (
        np.where(four[:, None], np.concatenate([mapped, p.block(at + v4, 4)], 1), p.block(at + v6, 16)) for v4, v6 in ((12, 8), (16, 24))
    )
    ports = ((proto == 6) | (proto == 17)) & (n >= o + 4)
    # a stopped chain names no transport: ESP and "no next header" end it
    silent = (four & (proto == 1)) | (six & ((proto == 58) | (stopped & np.isin(proto, (_ESP, _NO_NEXT)))))
    tcp = ports & (proto == 6)
    l7 = np.where(tcp, o + (p.u8(at + o + 12) >> 4) * 4, np.where(ports, o + 8, o))
    known = has & ~(tcp & (n < o + 20)) & ~silent
    five = pa.StructArray.from_arrays(
        [
            _int(proto, has), _binary(src, has), _binary(dst, has),
            _int(np.where(ports, p.u16(at + o), 0), has), _int(np.where(ports, p.u16(at + o + 2), 0), has),
        ],
        names=["protocol", "src_ip", "dst_ip", "src_port", "dst_port"], mask=pa.array(~has),
    )
    offset = _int(at + np.minimum(l7, n), known)
    return pa.StructArray.from_arrays([*macs, five, offset], names=["src_mac", "dst_mac", "bssid", "five_tuple", "l7_offset"])


def decode(packets: DataFrame, *, compat_auth: bool = False) -> DataFrame:
    """``packets(data, link_type, ...)`` with src_mac, dst_mac, bssid, five_tuple and l7_offset.

    A packet without a readable IP header has a null five_tuple; null data has
    nulls only.  ``l7_offset`` is the 0-based offset of the payload in
    ``data``, never beyond its end; null where there is none.  ``compat_auth``
    counts the IPv6 authentication header in 8-byte units, as the other
    extension headers.
    """

    def headers(data: pa.Array, link_type: pa.Array) -> pa.Array:
        return _headers(data, link_type, compat_auth)

    read = F.arrow_udf(headers, _HEADERS)
    keep = [F.col(f"`{c}`") for c in packets.columns]
    d = packets.select(*keep, read(F.col("data"), F.col("link_type").cast("int")).alias("_h"))
    return d.select(*keep, *(F.col(f"_h.{c}") for c in ("src_mac", "dst_mac", "bssid", "five_tuple", "l7_offset")))


def l7_data(data: Column, l7_offset: Column) -> Column:
    """Payload bytes; null without an offset."""
    return F.when(l7_offset.isNotNull(), data.substr(l7_offset + 1, F.length(data)))


def payload_offset(df: DataFrame, col: str = "data", out: str = "payload_offset") -> DataFrame:
    """``df`` with the payload offset of bare IP datagrams in ``col``."""
    bare = df.select("*", F.struct("*").alias("_row")).select("_row", F.col(col).alias("data"), F.lit(101).alias("link_type"))
    return decode(bare).select("_row.*", F.col("l7_offset").alias(out))
