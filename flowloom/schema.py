"""Schemas of packets and flows."""

FIVE_TUPLE = "struct<protocol:int,src_ip:binary,dst_ip:binary,src_port:int,dst_port:int>"
#: what a capture source yields; every other packet column is decoded from it
RAW_PACKET = (
    "file string, file_stem string, pkt_idx bigint, link_type int, out_link_type int,"
    "ts_sec bigint, ts_usec bigint, cap_len bigint, orig_len bigint, data binary"
)
DECODED = ("src_mac", "dst_mac", "bssid", "five_tuple", "l7_offset")
