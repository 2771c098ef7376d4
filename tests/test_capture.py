import json
import random

import pyarrow as pa
import pytest
from frames import eth, fragment6, fragment_stream, ip, ip6, packets, tagged, udp
from pyspark.sql import functions as F

from wirelane.operators import defrag, protocols, rules
from wirelane.plans.capture import Capture, Options, write_json_array, write_ndjson
from wirelane.sources import ocf, pcap

FRAMES, CELLS = fragment_stream(31)


def kept(rows, options=Options()):
    """A capture of which all tables are read."""
    return Capture(rows, options).__enter__()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("captures")
    (d / "a.pcap").write_bytes(pcap.write_pcap([(1_234_567_890, 7 * i, p) for i, p in enumerate(FRAMES)]))
    (d / "b.pcapng").write_bytes(pcap.write_pcapng([(0, (5 << 32) + i, p) for i, p in enumerate(FRAMES)], options=[(1, b"note")]) + pcap.write_pcapng([(1, 7, b"x")], links=[1, 101], order=">"))
    return str(d)


def test_sources_agree(spark, folder):
    pcap.register(spark)
    whole = spark.createDataFrame([], "file string")
    whole = pcap.read_captures(spark, folder)
    split = pcap.scan_captures(spark, folder, 200)
    source = spark.read.format("pcap").load(folder)
    columns = [c for c in whole.columns if c != "file"]
    key = F.regexp_extract("file", "[^/]+$", 0).alias("file")
    assert sorted(whole.select(key, *columns).collect()) == sorted(split.select(key, *columns).collect())
    assert sorted(whole.select(key, *columns).collect()) == sorted(source.select(key, *columns).collect())
    last = whole.where(F.col("file").endswith("b.pcapng") & (F.col("packet_id") == len(FRAMES))).first()
    assert (last.link_type, last.interface_id, last.ts_raw, last.payload) == (101, 1, 7, b"x")


def test_all_magics_and_broken_files():
    frames = [(1, 2, b"abc"), (3, 4, b"")]
    for order in "<>":
        for magic in (pcap.PCAP_MICROSECONDS, pcap.PCAP_NANOSECONDS):
            got = pcap.scan(pcap.write_pcap(frames, 1, order, magic))
            assert [(r[0], r[3], r[4], r[7]) for r in got] == [(0, 1, (1 << 32) | 2, b"abc"), (1, 1, (3 << 32) | 4, b"")]
    data = pcap.write_pcapng([(0, 1, b"abc")])
    assert len(pcap.scan(data)) == 1 and pcap.scan(b"") == []
    for broken in (data[:-1], b"nonsense", data[:-4] + b"\0\0\0\0", pcap.write_pcap(frames)[:-1][:42]):
        with pytest.raises(pcap.CaptureError):
            pcap.scan(broken)
    block = data[28 + 20 :]
    assert pcap.packet_options(pcap.write_pcapng([(0, 1, b"abc")], options=[(1, b"note"), (2, b"xy")])[48:]) == [(1, b"note"), (2, b"xy")] and block


def test_ranges_that_begin_in_a_capture_inside_a_packet(spark, tmp_path):
    """Payloads that hold whole captures, sections of both byte orders, and files of one huge block."""
    inner = pcap.write_pcapng([(0, i, b"inner%d" % i) for i in range(60)])
    (tmp_path / "a.pcapng").write_bytes(pcap.write_pcapng([(0, 1, b"x"), (0, 2, inner), (0, 3, b"y")]) + pcap.write_pcapng([(1, 4, inner), (0, 5, b"z")], links=[7, 8], order=">"))
    (tmp_path / "b.pcap").write_bytes(pcap.write_pcap([(1, 2, pcap.write_pcap([(1, i, b"abc") for i in range(80)])[24:]), (3, 4, b"after")], order=">"))
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "head.pcap").write_bytes(pcap.write_pcap([]))
    rows = lambda df: sorted(df.withColumn("file", F.regexp_extract("file", "[^/]+$", 0)).collect())
    for size in (37, 100, 1000):
        assert rows(pcap.scan_captures(spark, str(tmp_path), size)) == rows(pcap.read_captures(spark, str(tmp_path)))


@pytest.mark.parametrize(("container", "order"), [("pcap", "little"), ("pcapng", "big")])
def test_written_captures_are_read(spark, tmp_path, container, order):
    pcap.register(spark)
    p = packets(spark, FRAMES).withColumn("interface_id", (F.col("packet_id") % 3).cast("long"))
    writer = p.repartition(3).write.format("pcap").option("container", container).option("byteOrder", order)
    writer.mode("append").save(str(tmp_path / "c"))
    writer.mode("overwrite").save(str(tmp_path / "c"))
    columns = ["ts_raw", "payload", "caplen", *(["interface_id"] if container == "pcapng" else [])]
    assert sorted(spark.read.format("pcap").load(f"{tmp_path}/c/*.pcap").select(*columns).collect()) == sorted(p.select(*columns).collect())
    assert len(list((tmp_path / "c").glob("*"))) == 3


def test_stream_is_batch(spark, folder):
    pcap.register(spark)
    path = folder + "/a.pcap"
    query = spark.readStream.format("pcap").option("maxBytesPerTrigger", 150).load(path).writeStream.format("memory").queryName("seen").start()
    try:
        for _ in range(40):
            query.processAllAvailable()
            if spark.table("seen").count() == len(FRAMES):
                break
        rows = spark.table("seen").drop("file").orderBy("packet_id").collect()
    finally:
        query.stop()
    assert rows == pcap.read_captures(spark, path).drop("file").orderBy("packet_id").collect()


def expected(cells, last, config=defrag.Config(), flush=False):
    """What the packet-by-packet model reports: rows of `datagram`, and (packet, ports, datagram_id) of those completed."""
    found, _ = defrag.fold_limited(cells, config)
    shown, done = [], []
    for i, d in enumerate(found, 1):
        row = d.row()
        if row["completion_status"] == defrag.COMPLETE:
            done.append((row["last_packet_id"], int.from_bytes(row["payload"][:2], "big"), int.from_bytes(row["payload"][2:4], "big"), i))
        if row["completion_status"] == defrag.COMPLETE or flush or last >= row["last_packet_id"] + config.timeout:
            shown.append((i, row["total_length"], row["fragment_count"], row["first_packet_id"], row["last_packet_id"], row["completion_status"], row["gap_bytes"]))
    return shown, sorted(done)


@pytest.mark.parametrize("version", [4, 6])
@pytest.mark.parametrize("timeout", [3, 30])
def test_reassembly(spark, version, timeout):
    frames, cells = fragment_stream(40 + version, version=version)
    config = defrag.Config(timeout=timeout)
    c = Capture(packets(spark, frames), Options(reassembly=config)).__enter__()
    shown, done = expected(cells, len(frames) - 1, config)
    rows = c.table("datagram").orderBy("datagram_id").collect()
    assert [(r.datagram_id, r.total_length, r.fragment_count, r.first_packet_id, r.last_packet_id, r.completion_status, r.gap_bytes) for r in rows] == shown
    assert {r.ip_version for r in rows} == {version} and (timeout == 30 or len({r.completion_status for r in rows}) > 1)
    again = c.table("udp").where("is_reassembled").orderBy("packet_id").collect()
    assert [(r.packet_id, r.src_port, r.dst_port, r.datagram_id) for r in again] == done
    assert c.table("udp").where("not is_reassembled").count() == len(frames) - len(cells)
    parts = c.table(f"ipv{version}_frag").orderBy("packet_id").collect()
    assert [(r.packet_id, r.frag_offset_bytes, r.more_fragments, r.is_first) for r in parts] == [(p, o, m, o == 0) for _, p, o, m, _ in cells]
    c.close()
    if timeout == 30:
        return
    flushed = Capture(packets(spark, frames), Options(reassembly=config, flush=True)).table("datagram")
    assert flushed.count() == len(defrag.fold_limited(cells, config)[0])
    off = Capture(packets(spark, frames), Options(reassembly=None))
    assert off.table("udp").count() == len(frames) - len(cells) + sum(o == 0 for _, _, o, _, _ in cells)


def test_capacity_and_key_reuse(spark):
    """A limit that the timeout can reach: datagrams are refused as the packet-by-packet model refuses them."""
    frames, cells = fragment_stream(50, datagrams=25)
    config = defrag.Config(max_concurrent=4, timeout=20)
    c = Capture(packets(spark, frames), Options(reassembly=config))
    found, of = defrag.fold_limited(cells, config)
    number = {id(d): i for i, d in enumerate(found, 1)}
    want = [(p, 0 if d is None else number[id(d)]) for (_, p, *_), d in zip(cells, of, strict=True)]
    assert [(r.packet_id, r.datagram_id) for r in c.table("ipv4_frag").orderBy("packet_id").collect()] == want and any(not d for _, d in want)
    whole = udp(4001, 4002, bytes(range(30)))
    twice = [eth(ip(part, 77, at, more)) for _ in range(2) for part, at, more in ((whole[:24], 0, 1), (whole[24:], 24, 0))]
    assert Capture(packets(spark, twice)).table("datagram").count() == 2


def test_fold_is_the_packet_by_packet_model():
    rng = random.Random(4)
    for _ in range(300):
        cells, packet = [], 0
        for _ in range(rng.randrange(1, 25)):
            packet += rng.randrange(1, 6)
            offset, size = 8 * rng.randrange(4), rng.choice([8, 16])
            cells.append((bytes([rng.randrange(3)]), packet, offset, rng.random() < 0.6, bytes([rng.randrange(2)]) * size))
        config = defrag.Config(timeout=rng.choice([2, 5, 30]))
        together, _ = defrag.fold_limited(cells, config)
        apart = [d for key in {c[0] for c in cells} for d in defrag.fold([c[1:] for c in cells if c[0] == key], config)[0]]
        assert sorted(map(repr, (d.row() for d in together))) == sorted(map(repr, (d.row() for d in apart)))


def test_ipv6(spark):
    rng = random.Random(61)
    segments = rng.randbytes(32)
    srh = protocols.IPV6_ROUTING.pack({"next_header": 51, "hdr_ext_len": 4, "routing_type": 4, "segments_left": 1, "last_entry": 1, "flags": 0, "tag": 300}) + segments
    hop = protocols.IPV6_OPTIONS.pack({"next_header": 60, "hdr_ext_len": 1}) + bytes([0, 0, 30, 3, 1, 2, 3, 1, 5, 0, 0, 0, 0, 0])
    destination = protocols.IPV6_OPTIONS.pack({"next_header": 43, "hdr_ext_len": 0}) + bytes([62, 4, 9, 9, 9, 9])
    ah = protocols.IPV6_AH.pack({"next_header": 17, "payload_len": 1, "reserved": 0, "spi": 4242, "seq": 5})
    whole = eth(ip6(hop + destination + srh + ah + udp(901, 902, b"payload"), 0), 0x86DD)
    cut_short = eth(ip6(hop[:9], 0, 2), 0x86DD)
    c = kept(packets(spark, [whole, cut_short, eth(fragment6(udp(903, 904, b"only"), 17, 0, 0, 8), 0x86DD)]))
    assert [(r.packet_id, r.src_port, r.is_reassembled) for r in c.table("udp").orderBy("packet_id").collect()] == [(0, 901, False), (2, 903, True)]
    layers = json.loads(c.json().where("packet_id = 0").first().line)["_source"]["layers"]
    assert list(layers) == ["frame", "eth", "ipv6", "ipv6.hop_by_hop", "ipv6.option", "ipv6.dest_opts", "ipv6.routing", "ipv6.srh_segment", "ipv6.ah", "udp"]
    assert [s["address"] for s in layers["ipv6.srh_segment"]] == [segments[:16].hex(":", 2), segments[16:].hex(":", 2)]
    assert [(o["container"], o["type"], o["length"]) for o in layers["ipv6.option"]] == [(0, 0, 0), (0, 0, 0), (0, 30, 3), (0, 1, 5), (60, 62, 4)]
    assert layers["ipv6.ah"]["spi"] == 4242 and layers["ipv6.routing"]["tag"] == 300


def someip(service, method, body):
    return protocols.SOMEIP.pack({"service_id": service, "method_id": method, "length": 8 + len(body), "client_id": 77, "session_id": 9, "protocol_version": 1, "interface_version": 3, "message_type": 0, "return_code": 0}) + body


def sd_option(kind, body):
    return (len(body) + 1).to_bytes(2, "big") + bytes([kind, 0]) + body


def test_someip(spark):
    rng = random.Random(71)
    entry = lambda kind, options: protocols.SD_ENTRY.pack({"type": kind, "index_1st_opts": 0, "index_2nd_opts": 0, "num_opt_1": options, "num_opt_2": 0, "service_id": 0x4C21, "instance_id": 12, "major_version": 2, "ttl": 70_000, "minor_version": 40})
    four, six = rng.randbytes(4), rng.randbytes(16)
    options = [sd_option(4, four + b"\0\6" + (41_500).to_bytes(2, "big")), sd_option(6, six + b"\0\x11" + (41_501).to_bytes(2, "big")), sd_option(1, b"k=v\0")]
    entries = b"".join(entry(kind, n) for kind, n in ((6, 0), (7, 1), (1, 2)))
    sd = b"\x80\0\0\0" + len(entries).to_bytes(4, "big") + entries + sum(map(len, options)).to_bytes(4, "big") + b"".join(options)
    members = b"\x20\x33" + rng.randbytes(4) + b"\x63\x44" + b"\0\5" + rng.randbytes(5)
    frames = [eth(ip(udp(30490, 30490, someip(0xFFFF, 0x8100, sd)))), eth(ip(udp(52_000, 41_777, someip(0x4C21, 17, members)))), eth(ip(udp(30490, 1, someip(5, 6, b""))))]
    c = kept(packets(spark, frames))
    counts = lambda c: [c.table(t).count() for t in ("someip", "someip_sd_entry", "someip_sd_option", "someip_tlv")]
    assert counts(c) == [2, 3, 3, 0]
    rows = c.table("someip_sd_option").orderBy("option_index").collect()
    assert [(r.type, r.l4proto, r.port, bytes(r.address)) for r in rows] == [(4, 6, 41_500, four + bytes(12)), (6, 17, 41_501, six), (1, 0, 0, bytes(16))]
    assert [(r.body.type, r.body.num_opt_1, r.body.ttl) for r in c.table("someip_sd_entry").orderBy("entry_index").collect()] == [(6, 0, 70_000), (7, 1, 70_000), (1, 2, 70_000)]
    more = kept(packets(spark, frames), Options(someip_tlv_ports=(41_777,)))
    assert counts(more) == [3, 3, 3, 2]
    assert [(r.data_id, r.wire_type, r.length) for r in more.table("someip_tlv").orderBy("tlv_index").collect()] == [(0x33, 2, 4), (0x344, 6, 5)]
    layers = json.loads(c.json().where("packet_id = 0").first().line)["_source"]["layers"]
    assert list(layers)[-3:] == ["someip", "someip.sd_entry", "someip.sd_option"] and len(layers["someip.sd_entry"]) == 3


def gptp(kind, body, seq):
    return protocols.GPTP.pack({"major_sdo_id": 1, "message_type": kind, "minor_version": 1, "version": 2, "message_length": 34 + len(body), "domain_number": 3, "minor_sdo_id": 0, "flags": 0, "correction_field": -seq, "message_specific": 0, "source_port_identity": {"clock_identity": bytes([seq] * 8), "port_number": seq}, "sequence_id": seq, "control": 0, "log_message_interval": -2}) + body


def test_gptp_and_lldp(spark):
    """Messages of every kind with fields from a seed come back from their tables."""
    rng = random.Random(81)
    seconds, nanoseconds = rng.randrange(1 << 40), rng.randrange(10**9)
    stamp = seconds.to_bytes(6, "big") + nanoseconds.to_bytes(4, "big")
    clock, port, rate, base, phase = rng.randbytes(8), rng.randrange(1 << 16), -rng.randrange(1, 1 << 30), rng.randrange(1 << 16), rng.randrange(1 << 30)
    information = b"\0\x80\xc2\0\0\1" + rate.to_bytes(4, "big", signed=True) + base.to_bytes(2, "big") + rng.randbytes(12) + phase.to_bytes(4, "big")
    follow = stamp + b"\0\3" + len(information).to_bytes(2, "big") + information
    path = [rng.randbytes(8) for _ in range(3)]
    quality = {"current_utc_offset": -21, "grandmaster_priority1": 12, "grandmaster_clock_class": 6, "grandmaster_clock_accuracy": 33, "grandmaster_offset_scaled_log_variance": 17_000, "grandmaster_priority2": 99, "steps_removed": 4, "time_source": 32}
    sizes = {"current_utc_offset": 2, "grandmaster_offset_scaled_log_variance": 2, "steps_removed": 2}
    raw = {k: v.to_bytes(sizes.get(k, 1), "big", signed=v < 0) for k, v in quality.items()}
    announce = stamp + raw["current_utc_offset"] + b"\0" + b"".join(raw[k] for k in list(quality)[1:6]) + clock + raw["steps_removed"] + raw["time_source"] + b"\0\x08" + (24).to_bytes(2, "big") + b"".join(path)
    response = stamp + clock + port.to_bytes(2, "big")
    bodies = [(11, announce), (0, stamp), (13, stamp), (8, follow), (9, response), (11, announce[:20]), (1, stamp), (2, stamp), (3, response), (10, response)]
    frames = [eth(gptp(k, b, n), 0x88F7, n) for n, (k, b) in enumerate(bodies, 1)]
    frames[1] = tagged(gptp(0, stamp, 2), [9], 0x88F7)
    chassis, system = rng.randbytes(6), "seeded switch".encode()
    lldp = b"\x02\x07\x04" + chassis + b"\x06\x02\x01\x2c" + b"\x0a" + bytes([len(system)]) + system + b"\x0e\x04\0\x2a\0\x0a" + b"\x10\x0c\x05\x01\xc6\x33\x64\x07\x03" + (513).to_bytes(4, "big") + b"\0" + b"\0\0"
    c = kept(packets(spark, [*frames, eth(lldp, 0x88CC)]))
    kinds = ("sync", "delay_req", "pdelay_req", "follow_up", "delay_resp", "pdelay_resp", "pdelay_resp_follow_up", "announce", "path_trace")
    assert [c.table(f"gptp_{k}").count() for k in kinds] == [1, 1, 1, 1, 1, 1, 1, 1, 3]
    f = c.table("gptp_follow_up").first()
    assert (f.common.msg_index, f.common.sequence_id, f.common.correction_field, f.cumulative_scaled_rate_offset, f.gm_time_base_indicator, f.scaled_last_gm_freq_change) == (3, 4, -4, rate, base, phase)
    assert (f.precise_origin_timestamp_seconds, f.precise_origin_timestamp_nanoseconds) == (seconds, nanoseconds)
    a = c.table("gptp_announce").first()
    assert {k: a[k] for k in quality} == quality and bytes(a.grandmaster_identity) == clock and (a.common.msg_index, a.path_trace_count) == (0, 3)
    assert [(r.msg_index, r.entry_index, bytes(r.clock_identity)) for r in c.table("gptp_path_trace").orderBy("entry_index").collect()] == [(0, i, x) for i, x in enumerate(path)]
    for kind, index in (("delay_resp", 4), ("pdelay_resp", 8), ("pdelay_resp_follow_up", 9)):
        r = c.table(f"gptp_{kind}").first()
        assert (r.common.msg_index, bytes(r.requesting_port_identity.clock_identity), r.requesting_port_identity.port_number) == (index, clock, port)
    rows = c.table("lldp").orderBy("tlv_index").collect()
    assert [(r.tlv_type, r.subtype, r.ttl_seconds, r.caps_supported, r.caps_enabled, r.mgmt_iface_subtype, r.mgmt_iface_number) for r in rows] == [(1, 4, 0, 0, 0, 0, 0), (3, 0, 300, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0, 0), (7, 0, 0, 42, 10, 0, 0), (8, 0, 0, 0, 0, 3, 513)]
    assert bytes(rows[2].value_head) == system.ljust(32, b"\0") and rows[2].value_offset == 15
    line = json.loads(c.json().where("packet_id = 0").first().line)["_source"]["layers"]
    assert list(line) == ["frame", "eth", "gptp.path_trace", "gptp.announce"]


def test_sinks(spark, folder, tmp_path):
    spark.dataSource.register(ocf.Ocf)
    c = kept(pcap.read_captures(spark, folder + "/a.pcap"))
    write_ndjson(c, str(tmp_path / "lines"))
    lines = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "lines")).collect()), key=lambda x: x["_index"])
    shown, done = expected(CELLS, len(FRAMES) - 1)
    packet, _, _, number = done[0]
    _, total, count, *_ = next(s for s in shown if s[0] == number)
    assert len(lines) == len(FRAMES) and lines[packet]["_source"]["layers"]["ip.reassembled"] == {"datagram_id": number, "total_length": total, "fragment_count": count, "completion_status": 0}
    write_json_array(c, str(tmp_path / "array"))
    arrays = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "array"), wholetext=True).collect()]
    assert arrays == [lines]
    stream = c.to_arrow("udp", 3)
    batches = list(stream)
    assert max(b.num_rows for b in batches) == 3 and sum(b.num_rows for b in batches) == c.table("udp").count()
    assert c.layers("eth").is_cached
    c.close()
    assert c.table("udp").count() == sum(b.num_rows for b in batches) and not c.layers("eth").is_cached
    written = ocf.dump_tables({"udp": c.table("udp"), "tcp": c.table("tcp"), "eth": c.table("eth")}, str(tmp_path / "x"))
    assert [w.rsplit("_", 1)[1] for w in written] == ["udp.avro", "eth.avro"]
    assert spark.read.format("avro_ocf").load(written[0]).columns == c.table("udp").columns
    back = spark.read.format("avro_ocf").schema(c.table("udp").schema).load(written[0])
    assert sorted(back.collect()) == sorted(c.table("udp").collect())
    assert c.join_packets("udp").count() == c.table("udp").count()


def test_rules(spark):
    text = """
    # comment
    udp.src_port == 6 && udp.dst_port == 8123 => someip_tlv udp_payload "members"
    udp.dst_port == 2345 => raw_tlv udp_payload "raw"
    udp.dst_port == 0x771A => oddtlv someip_payload "odd"
    vlan.vid >= 1000 => lldp vlan_payload "units"
    """
    found = rules.parse_rules(text)
    element = b"\x10\x21\7\7"
    odd = b"\x63\x21" + (16).to_bytes(2, "big") + b"\0\4\0\3" + element * 3
    units = b"\x08\2ab" + b"\x0c\1c" + b"\0\0"
    frames = [eth(ip(udp(6, 8123, b"\x02\x15" + bytes(1) + b"\x50\x77\x03xyz"))), eth(ip(udp(1, 2345, b"\x09\x04data\x08\0"))), eth(ip(udp(1, 0x771A, someip(3, 4, odd)))), tagged(units, [1001], 0x88CC), b""]
    p = packets(spark, frames)
    tables = rules.run_rules(p, found)
    assert [(r.data_id, r.wire_type, r.length) for r in tables["someip_tlv"].orderBy("tlv_index").collect()] == [(0x215, 0, 1), (0x77, 5, 3)]
    assert [(r.packet_id, r.type, r.length) for r in tables["raw_tlv"].orderBy("tlv_index").collect()] == [(1, 9, 4), (1, 8, 0)]
    assert [(r.elem_index, r.array_id, r.elem_data_id) for r in tables["oddtlv"].orderBy("elem_index").collect()] == [(0, 0x321, 0x21), (1, 0x321, 0x21), (2, 0x321, 0x21)]
    assert [(r.tlv_type, r.tlv_length) for r in tables["lldp"].orderBy("tlv_index").collect()] == [(4, 2), (6, 1)]
    stats = rules.rule_stats(p, found).orderBy("rule_id").collect()
    assert [(r.label, r.matched, r.rows) for r in stats] == [("members", 1, 2), ("raw", 1, 2), ("odd", 1, 3), ("units", 1, 2)]
    assert tuple(rules.packet_stats(p, found).first()) == (5, 4)
    for bad in ('udp.nothing == 1 => raw_tlv udp_payload "x"', 'udp.dst_port == 70000 => raw_tlv udp_payload "x"', 'ipx.a == 1 => raw_tlv udp_payload "x"', "nonsense", 'udp.dst_port == 1 => what udp_payload "x"'):
        with pytest.raises(rules.RuleError):
            rules.parse_rules(bad)


@pytest.mark.parametrize("body", [ip(udp(1, 2345, b"\1\2ab")), ip(udp(1, 2345, b"\1\2ab"), ihl=7), b"", b"\x45"])
def test_rules_and_walk_agree_on_any_number_of_tags(spark, body):
    frames = [tagged(body, list(range(1, n + 1))) for n in range(1, 12)] + [tagged(body, [5] * 6)[:n] for n in range(14, 45)] + [tagged(b"", [7] * 16_000)]
    p = packets(spark, frames)
    layers = rules.Layers(p)
    got = {r.packet_id: (r.port, r.vid, None if r.region is None else bytes(r.region)) for r in layers.rows.select("packet_id", layers.field("udp", "dst_port").alias("port"), layers.field("vlan", "vid").alias("vid"), layers.region("udp_payload").alias("region")).collect()}
    for i, frame in enumerate(frames):
        rows = protocols.Walk(frame).rows
        ports, tags = rows.get("udp"), rows.get("vlan")
        assert got[i][:2] == (ports[0]["dst_port"] if ports else None, tags[0]["vid"] if tags else None), i
        assert (got[i][2] is None) == (not ports)


@pytest.mark.parametrize("reassembly", [True, False])
def test_batches_are_walked_like_packets(reassembly):
    """Cut and mutated frames of all kinds, and null ones: the walk of a batch gives what walking each packet gives."""
    rng = random.Random(6)
    options = protocols.IPV6_OPTIONS.pack({"next_header": 17, "hdr_ext_len": 0}) + bytes([30, 4, 1, 2, 3, 4])
    seeds = FRAMES + fragment_stream(7, version=6)[0] + [tagged(ip(udp(5, 6, b"xy"), ihl=7), [1, 2, 3]), tagged(ip6(options + udp(7, 8, b"z"), 0), [4], 0x86DD), eth(ip(bytes(30), proto=6)), eth(b"\x02\3\4ab\x06\2\0\7\0\0", 0x88CC), tagged(bytes(50), [8], 0x88F7)]
    frames = []
    for _ in range(2500):
        frame = bytearray(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 3])):
            frame[rng.randrange(len(frame))] = rng.randrange(256)
        frames.append(None if rng.random() < 0.02 else bytes(frame[: rng.choice([len(frame), rng.randrange(len(frame) + 1)])]))
    links = [rng.choice([1] * 9 + [101]) for _ in frames]
    whole = pa.array([b"skipped", *frames], pa.binary())
    got = protocols.decode_batch(whole.slice(1), pa.array(links, pa.int32()), reassembly, frozenset(protocols.TABLES)).to_pylist()
    for frame, link, found in zip(frames, links, got, strict=True):
        want = None if frame is None else protocols.Walk(frame, reassembly).rows if link == 1 else {}
        assert found == (want if want is None else {t: want.get(t, []) for t in protocols.LAYERS.names})
    some = protocols.decode_batch(whole, pa.array([1, *links], pa.int32()), reassembly, frozenset(["tcp", "vlan"])).to_pylist()
    assert all(x is None or not x["udp"] and not x["eth"] for x in some) and any(x and x["vlan"] for x in some)


def test_any_frame_ends():
    rng = random.Random(5)
    seeds = FRAMES + [eth(ip6(bytes(40), 0), 0x86DD), eth(bytes(60), 0x88CC), eth(bytes(20), 0x8100)]
    for _ in range(3000):
        frame = bytearray(rng.choice(seeds))
        for _ in range(rng.randrange(6)):
            frame[rng.randrange(len(frame))] = rng.randrange(256)
        frame = bytes(frame[: rng.randrange(len(frame) + 1)])
        layers = protocols.Walk(frame).rows
        for row in layers.get("gptp", []):
            protocols.gptp_message(row["message"])
        protocols.someip_rows(frame, True)


def test_other_links_have_no_layers(spark):
    c = Capture(packets(spark, FRAMES[:1], link=101))
    assert c.table("packets").count() == 1 and c.table("eth").count() == 0
