import io
import os
import struct

import pytest
from captures import PAYLOAD, THREE, pcap, pcapng
from pyspark.sql import functions as F

from flowloom import api
from flowloom.cli import main
from flowloom.operators.archive import Archive, flow_properties, flow_repr, packet_repr
from flowloom.operators.filters import PacketFilter
from flowloom.operators.strategies import Strategy
from flowloom.sources import archive_file as af
from flowloom.sources import capture as cap
from flowloom.sources.sinks import read_pipe


@pytest.fixture
def test_pcap(tmp_path):
    p = tmp_path / "test.pcap"
    p.write_bytes(pcap())
    return str(p)


@pytest.mark.parametrize("order,magic,frac", [("<", 0xA1B2C3D4, 123456), (">", 0xA1B2C3D4, 123456), ("<", 0xA1B23C4D, 123456789), (">", 0xA1B23C4D, 123456789)])
def test_pcap_kinds(order, magic, frac):
    link, records = cap.read_records(io.BytesIO(pcap([(7, frac, b"abc")], order, magic)))
    r = list(records)
    assert link == 1 and (r[0].ts_sec, r[0].ts_usec, r[0].data) == (7, 123456, b"abc")


def test_compat_time_and_cuts():
    blob = pcap([(7, 123456, b"abc")])
    assert next(cap.read_records(io.BytesIO(blob), compat_ts=True)[1]).ts_usec == 123
    assert len(list(cap.read_records(io.BytesIO(blob + b"tail"))[1])) == 1
    with pytest.raises(cap.ParseError):
        list(cap.read_records(io.BytesIO(blob[:-1]))[1])
    assert list(cap.read_records(io.BytesIO(blob[:-1]), permissive=True)[1]) == []
    for bad in (b"", b"abcd" * 8, pcap()[:10]):
        with pytest.raises(cap.ParseError):
            cap.read_records(io.BytesIO(bad))


@pytest.mark.parametrize("order", ["<", ">"])
def test_pcapng(order):
    link, records = cap.read_records(io.BytesIO(pcapng(order)))
    r = list(records)
    assert link == 1 and [(x.link_type, x.ts_sec, x.ts_usec) for x in r] == [(1, 0, 1000), (105, 2, 0), (1, 0, 0)]
    assert r[2].data == b"\x60abcd"
    for n in range(28, len(pcapng(order)), 7):  # any cut ends the stream without an error
        list(cap.read_records(io.BytesIO(pcapng(order)[:n]))[1])


def test_ranges_and_discovery(spark, tmp_path):
    many = [(i, 0, bytes([i % 256]) * (i % 50)) for i in range(500)]
    (tmp_path / "a.cap").write_bytes(pcap(many))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.PCAPNG").write_bytes(pcapng())
    (tmp_path / "c.txt").write_bytes(b"no")
    df = cap.read_captures(spark, str(tmp_path), recursive=True, range_bytes=1000)
    rows = df.where("file_stem = 'a'").orderBy("pkt_idx").collect()
    assert df.rdd.getNumPartitions() > 5
    assert [(r.pkt_idx, r.ts_sec, bytes(r.data)) for r in rows] == [(i, i, d) for i, (_, _, d) in enumerate(many)]
    assert df.where("file_stem = 'b'").count() == 3 and cap.read_captures(spark, str(tmp_path)).where("file_stem = 'b'").count() == 0
    assert cap.read_remote_captures(spark, str(tmp_path / "a.cap")).count() == 500


@pytest.mark.parametrize("order,magic", [("<", 0xA1B2C3D4), (">", 0xA1B23C4D)])
def test_ranges_never_rest_on_a_guess(spark, tmp_path, order, magic):
    inner = pcap([(9, i, b"fake" * 3) for i in range(60)], order)[24:]  # a payload that looks like records
    many = [(i, 0, inner if i % 7 == 3 else b"\0" * 700 if i % 5 == 0 else bytes([i % 256]) * (i % 50)) for i in range(120)]
    many[50] = (50, 0, b"x" * 9000)  # longer than several ranges
    blob = pcap(many, order, magic)
    (tmp_path / "a.pcap").write_bytes(blob)
    want = [(i, r.ts_sec, r.data) for i, r in enumerate(cap.read_records(io.BytesIO(blob))[1])]
    for size in (100, 997, 5000):
        df = cap.read_captures(spark, str(tmp_path), range_bytes=size)
        assert [(r.pkt_idx, r.ts_sec, bytes(r.data)) for r in df.select("pkt_idx", "ts_sec", "data").orderBy("pkt_idx").collect()] == want
    ranges = cap.plan_ranges(spark, [str(tmp_path / "a.pcap")], 997)
    assert ranges[0].start == 24 and ranges[-1].end == len(blob)
    assert all(a.end == b.start for a, b in zip(ranges, ranges[1:], strict=False))
    (tmp_path / "a.pcap").write_bytes(blob + b"tail")  # a cut-off record header ends the file
    assert cap.read_captures(spark, str(tmp_path), range_bytes=997).count() == len(want)
    (tmp_path / "a.pcap").write_bytes(blob[:-1])  # a cut-off body is an error, unless allowed
    assert cap.read_captures(spark, str(tmp_path), range_bytes=997, permissive=True).count() == len(want) - 1
    with pytest.raises(Exception, match="left"):
        cap.read_captures(spark, str(tmp_path), range_bytes=997).count()



@pytest.mark.parametrize("strategy,groups", [("session", 2), ("flow", 3), ("host", 4), ("hostpair", 2), ("mac", 2), ("bssid", 1), ("nosplit", 1), ("seconds 1000", 2), ("packets 2", 2)])
def test_strategies(spark, test_pcap, strategy, groups):
    assert api.read_flows(spark, test_pcap, strategy).flow_count() == groups


def test_flows(spark, test_pcap):
    a = api.read_flows(spark, test_pcap)
    f = a.flows().collect()
    assert [(x.flow_id, x.key, x.packet_count, x.total_bytes, x.start_ts_us, x.end_ts_us) for x in f] == [
        (1, "6_10.0.0.1_10.0.0.2_1234_80", 2, 130, 1_000_000_000, 1_001_000_000),
        (2, "6_192.168.1.1_192.168.1.2_5555_443", 1, 65, 2_000_000_000, 2_000_000_000),
    ]
    assert a.find_by_ip("10.0.0.2").count() == 1 and a.find_by_port(443).count() == 1 and a.find_by_protocol("TCP").count() == 2
    assert [bytes(r.data) for r in a.packets(1).collect()] == [THREE[0][2], THREE[1][2]]
    assert a.find(ips=["10.0.0.1", "192.168.1.1"]).count() == 0
    with pytest.raises(ValueError):
        a.find()
    with pytest.raises(ValueError):
        PacketFilter(["nonsense"])
    for bad in ("seconds", "packets 0", "what"):
        with pytest.raises(ValueError):
            Strategy.parse(bad)


def test_split(spark, test_pcap, tmp_path):
    out = tmp_path / "out"
    api.split(spark, test_pcap, str(out))
    names = sorted(os.listdir(out))
    assert names == ["test_6_10_0_0_1_10_0_0_2_1234_80.pcap", "test_6_192_168_1_1_192_168_1_2_5555_443.pcap"]
    assert (out / names[0]).stat().st_size == 24 + 2 * (16 + 65)
    api.split(spark, test_pcap, str(out), ip_filters=["10.0.0.1"], port_filters=[80], clean=True)
    assert os.listdir(out) == names[:1]
    api.split(spark, test_pcap, str(tmp_path / "l7"), output_type="L7")
    assert sorted((tmp_path / "l7" / n).read_bytes() for n in os.listdir(tmp_path / "l7")) == [PAYLOAD, PAYLOAD * 2]


@pytest.mark.parametrize("indexed", [True, False])
def test_archive_file(spark, test_pcap, tmp_path, indexed):
    path = str(tmp_path / "x.arc")
    api.create_archive(spark, test_pcap, path, secondary_index=indexed)
    a = af.ArchiveFile(path)
    assert [e.packet_count for e in a.entries] == [2, 1] and (a.index is not None) == indexed
    assert a.lookup("port", 80) == [1] and a.lookup("proto", 6) == [1, 2] and a.lookup("ip", a.entries[1].src_ip) == [2]
    opened = Archive.open(spark, path)
    assert opened.flow_count() == 2 and opened.link_type == 1
    blobs = list(opened.pipe())
    assert [af.count_frames(b) for b in blobs] == [2, 1] and len(blobs[0]) == 186
    buf = io.BytesIO()
    assert api.pipe_to(spark, path, buf) == 2
    buf.seek(0)
    assert list(read_pipe(buf)) == blobs
    with pytest.raises(LookupError):
        opened.extract_matching(str(tmp_path / "none"), ports=[9])
    assert repr(opened) == "Archive(flows=2, link_type=1)"
    assert "TCP 10.0.0.1:1234 -> 10.0.0.2:80, 2 pkts, 130 bytes)" in flow_repr(flow_properties(opened.get_flow(1)).first())
    assert packet_repr(opened.packets(1).first()) == "Packet(ts=1000.000000, length=65, orig_len=65)"
    assert opened.extract_matching(str(tmp_path / "ex"), ports=[443]) == 1 and os.listdir(tmp_path / "ex") == ["flow_2.pcap"]
    with open(path, "r+b") as f:
        f.write(b"X")
    with pytest.raises(af.ArchiveError):
        af.ArchiveFile(path)


def test_archive_folder(spark, test_pcap, tmp_path):
    api.create_archive(spark, test_pcap, str(tmp_path / "arc"), single_file=False)
    a = Archive.open(spark, str(tmp_path / "arc"))
    assert len(a) == 2 and a.packets(a.find_by_port(443)).count() == 1


def test_codecs():
    for x in ([], [0], [1], [1000], [0, 1, 2, 3, 4, 5], [100, 200, 300], [0, 1_000_000, 2_000_000]):
        assert af.decode_offsets(af.encode_offsets(x)) == x
    assert len(af.encode_offsets([100, 200, 300])) == 10 and len(af.encode_offsets([0, 1_000_000, 2_000_000])) == 14
    e = af.Entry(42, 6, bytes(16), b"\1" * 16, 1, 2, 3, 4, 5, 6, 7, 8)
    assert len(e.pack()) == 96 and af.Entry.unpack(e.pack()) == e


def test_random_bytes_fail_cleanly():
    state = 12345
    for size in range(0, 400, 13):
        out = bytearray()
        for _ in range(size):
            state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
            out.append(state >> 32 & 255)
        for head in (b"", struct.pack("<I", 0xA1B2C3D4), bytes([0x0A, 0x0D, 0x0D, 0x0A])):
            try:
                list(cap.read_records(io.BytesIO(head + bytes(out)))[1])
            except cap.ParseError:
                pass


def test_cli(spark, test_pcap, tmp_path, capsys):
    arc, out = str(tmp_path / "a.arc"), str(tmp_path / "o")
    assert main(["-r", test_pcap, "-o", out, "-s", "seconds", "1000", "-port", "80"], spark) == 0
    assert os.listdir(out) == ["test_ts_1.pcap"]
    assert main(["-r", test_pcap, "--mode", "archive", "--archive", arc], spark) == 0
    main(["--mode", "extract", "--archive", arc, "--list-flows"], spark)
    text = capsys.readouterr().out
    assert "TCP" in text and "10.0.0.1" in text
    main(["--mode", "extract", "--archive", arc, "--extract", "1", "-o", out], spark)
    assert (tmp_path / "o" / "flow_1.pcap").stat().st_size == 186
    for none in ([], ["--filter-port", "9"]):  # no filter, and one that no flow meets
        with pytest.raises(SystemExit):
            main(["--mode", "extract", "--archive", arc, "-o", out, *none], spark)
    assert main(["-r", test_pcap, "-o", out, "-s", "nosplit", "--ip", "10.0.0.1", "-v"], spark) == 0
    assert "3 packets, 2 passed, 1 filtered out" in capsys.readouterr().err


def test_stream(spark, test_pcap, tmp_path):
    from flowloom.streaming.capture_stream import running_flows

    spark.dataSource.register(cap.CaptureSource)
    raw = spark.readStream.format("capture").load(os.path.dirname(test_pcap))
    q = running_flows(api.decoded(raw), Strategy("session")).writeStream.format("memory").queryName("flows_now").outputMode("complete").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert sorted(r.packet_count for r in spark.table("flows_now").select(F.col("packet_count")).collect()) == [1, 2]


@pytest.mark.parametrize("indexed", [True, False])
def test_archive_ports_above_two_bytes(tmp_path, indexed):
    ports = [(80, 65616), (65616, 443), (80, 443), (2**31 - 1, 80)]
    w = af.ArchiveWriter(str(tmp_path / "a"), 1, indexed)
    w.finish(af.Entry(i, 6, bytes(16), bytes(16), s, d, 1, 0, 0, 60) for i, (s, d) in enumerate(ports, 1))
    a = af.ArchiveFile(str(tmp_path / "a"))
    assert [(e.src_port, e.dst_port) for e in a.entries] == ports
    assert (a.lookup("port", 80), a.lookup("port", 65616), a.lookup("port", 2**31 - 1)) == ([1, 3, 4], [1, 2], [4])
    assert a.lookup("port", 65535) == []
    assert a.entries[2].pack()[48:56] == bytes.fromhex("5000BB0100000000")  # as other tools read it
