"""Addresses, protocols, names and times as SQL expressions and columns.

Functions take the SQL text of their arguments: a text is one call to the JVM
however long it is, where a tree of columns is one call a node.

IP addresses are 16-byte binaries; IPv4 is v4-mapped, so comparing the bytes
compares addresses by number.
"""

from __future__ import annotations

import ipaddress
from pathlib import PurePath

from pyspark.sql import Column
from pyspark.sql import functions as F

V4_PREFIX = "00000000000000000000FFFF"
#: protocol numbers by name, and the ones that listings name (fixed values)
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1, "icmpv6": 58}


def ip_literal(text: str) -> bytes:
    """16 bytes of an address given as text; ``ValueError`` if it is none."""
    a = ipaddress.ip_address(text)
    return bytes.fromhex(V4_PREFIX) + a.packed if a.version == 4 else a.packed


def lit_binary(b: bytes) -> Column:
    return F.lit(bytearray(b))


def v4_bytes(number: str) -> str:
    """16-byte form of an IPv4 address given as a number."""
    return f"unhex(concat('{V4_PREFIX}', lpad(hex({number}), 8, '0')))"


def _v4_text(ip: str) -> str:
    return "concat_ws('.', " + ", ".join(f"conv(hex(substring({ip}, {13 + i}, 1)), 16, 10)" for i in range(4)) + ")"


def _compress(groups: str) -> str:
    """``::`` in place of the first longest run of two or more zero groups."""
    out = "CASE"
    for run in range(8, 1, -1):
        at = f"regexp_instr({groups}, '(?<![^:])0(?::0){{{run - 1}}}(?![^:])')"
        out += f" WHEN {at} > 0 THEN concat(substring({groups}, 1, greatest({at} - 2, 0)), '::', substring({groups}, {at} + {2 * run}, 40))"
    return f"{out} ELSE {groups} END"


def is_v4(ip: str) -> str:
    return f"hex(substring({ip}, 1, 12)) = '{V4_PREFIX}'"


def ip_sql(ip: str) -> str:
    """Dotted IPv4, or IPv6 in its compressed lower-case form."""
    groups = f"substring(regexp_replace(lower(hex({ip})), '\\\\G0{{0,3}}([0-9a-f]+?)(?=(?:[0-9a-f]{{4}})*$)', ':$1'), 2, 40)"
    # a one-element transform evaluates the groups once for all patterns
    return f"CASE WHEN {is_v4(ip)} THEN {_v4_text(ip)} WHEN {ip} IS NOT NULL THEN transform(array({groups}), g -> {_compress('g')})[0] END"


def ip_text(ip: str) -> Column:
    return F.expr(ip_sql(ip))


def ip_text_full(ip: str) -> Column:
    """Dotted IPv4, or IPv6 as eight groups of four digits."""
    full = f"regexp_replace(lower(hex({ip})), '(.{{4}})(?!$)', '$1:')"
    return F.expr(f"CASE WHEN {is_v4(ip)} THEN {_v4_text(ip)} ELSE {full} END")


def mac_sql(mac: str) -> str:
    return f"lower(hex({mac}))"


def mac_text(mac: str) -> Column:
    return F.expr(mac_sql(mac))


def protocol_name(proto: str, icmpv6: bool = False) -> Column:
    more = " WHEN 58 THEN 'ICMPv6'" if icmpv6 else ""
    return F.expr(f"CASE {proto} WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP'{more} ELSE '?' END")


def protocol_number(name: str) -> int:
    if name.lower() not in PROTOCOLS:
        raise ValueError(f"unknown protocol {name!r}; known: {', '.join(PROTOCOLS)}")
    return PROTOCOLS[name.lower()]


#: characters that a file name must not hold
UNSAFE = r'[\x00-\x1F\x7F/\\:*?"<>|.]'


def safe_name(key: Column) -> Column:
    return F.regexp_replace(key, UNSAFE, "_")


def file_stem(path: str) -> str:
    return "stdin" if path == "-" else PurePath(path).stem


def ts_micros(sec: Column, usec: Column) -> Column:
    return sec * 1_000_000 + usec


def ts_seconds(us: Column) -> Column:
    return us / 1e6


def session_order(src_ip: str, src_port: str, dst_ip: str, dst_port: str) -> str:
    """Whether (source, destination) is the session's own order: the smaller (address, port) first."""
    return f"({src_ip} < {dst_ip} OR ({src_ip} = {dst_ip} AND {src_port} < {dst_port}))"
