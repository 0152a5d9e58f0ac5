"""Captures built in code."""

import socket
import struct

PAYLOAD = b"TESTPAYLOAD"


def tcp_frame(src, dst, sport, dport, payload=PAYLOAD):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, 0x10, 8192, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, socket.inet_aton(src), socket.inet_aton(dst))
    return bytes(6) + b"\x11" * 6 + b"\x08\x00" + ip + tcp


THREE = [
    (1000, 0, tcp_frame("10.0.0.1", "10.0.0.2", 1234, 80)),
    (1001, 0, tcp_frame("10.0.0.2", "10.0.0.1", 80, 1234)),
    (2000, 0, tcp_frame("192.168.1.1", "192.168.1.2", 5555, 443)),
]


def pcap(packets=THREE, order="<", magic=0xA1B2C3D4, link=1):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for sec, frac, data in packets:
        out += struct.pack(order + "IIII", sec, frac, len(data), len(data)) + data
    return out


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    n = len(body) + 12
    return struct.pack(order + "II", kind, n) + body + struct.pack(order + "I", n)


def pcapng(order="<"):
    shb = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1) + bytes(4), order)
    idb = block(1, struct.pack(order + "HHI", 1, 0, 65535), order)
    ns = block(1, struct.pack(order + "HHI", 105, 0, 65535) + struct.pack(order + "HHB3x", 9, 1, 9) + bytes(4), order)
    frame = bytes(12) + b"\x08\x00" + b"\x45" + bytes(19)
    epb = lambda i, ts: block(6, struct.pack(order + "5I", i, 0, ts, len(frame), len(frame)) + frame, order)
    spb = block(3, struct.pack(order + "I", 5) + b"\x60abcd", order)
    unknown = block(0xBAD, b"1234", order)
    return shb + idb + unknown + epb(0, 1000) + ns + epb(1, 2_000_000_123) + spb


def ipv6_chain(headers, last, body):
    """Ethernet + IPv6 with extension headers (next, bytes)."""
    ip = struct.pack(">IHBB", 6 << 28, 0, headers[0][0] if headers else last, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02"
    ext = b""
    for i, (_, data) in enumerate(headers):
        nxt = headers[i + 1][0] if i + 1 < len(headers) else last
        ext += bytes([nxt]) + data
    return bytes(12) + b"\x86\xdd" + ip + ext + body
