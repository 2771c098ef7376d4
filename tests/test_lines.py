import io
import json
import random

from frames import eth, fragment_stream, ip, ip6, packets, tagged, udp
from wirelane.plans import files, lines
from wirelane.sources import pcap


FRAMES, _ = fragment_stream(90)


def test_flat_lines(spark):
    late = ip(bytes(8), 1, 16)
    frames = [eth(ip(udp(17, 18, b"x"))), tagged(ip6(bytes(20), 6), [311], 0x86DD), eth(late), b"short"]
    rows = lines.packet_lines(packets(spark, frames)).orderBy("packet_id").collect()
    head = frames[0][14:]
    src, dst = (".".join(map(str, head[a : a + 4])) for a in (12, 16))
    want = {"packet_id": 0, "interface_id": 0, "timestamp_raw": 0, "caplen": 43, "origlen": 43, "link_type": 1, "layers": [
        {"type": "ethernet", "dst": frames[0][:6].hex(":"), "src": frames[0][6:12].hex(":"), "ethertype": "0x0800"},
        {"type": "ipv4", "src": src, "dst": dst, "protocol": 17, "ttl": head[8], "total_length": 29}, {"type": "udp", "src_port": 17, "dst_port": 18}]}
    assert rows[0].line == json.dumps(want, separators=(",", ":"))
    second = json.loads(rows[1].line)["layers"]
    assert [x["type"] for x in second] == ["ethernet", "vlan", "ipv6", "tcp"] and second[1]["vid"] == 311
    assert second[2]["src"] == frames[1][18 + 8 : 18 + 24].hex(":", 2)
    assert [x["type"] for x in json.loads(rows[2].line)["layers"]] == ["ethernet", "ipv4"] and json.loads(rows[3].line)["layers"] == []


def test_totals(spark, tmp_path):
    start, options = 9 << 32, [(1, b"seed ninety"), (12, b"")]
    data = pcap.write_pcapng([(0, start + i, p) for i, p in enumerate(FRAMES)], options=options)
    (tmp_path / "a.pcapng").write_bytes(data)
    checksum = lines.FNV_OFFSET
    for i, p in enumerate(FRAMES):
        for x in (start + i, len(p), len(p), *(y for code, value in options for y in (code, len(value), *value))):
            checksum = (checksum ^ x) * lines.FNV_PRIME % 2**64
    want = (len(FRAMES), sum(map(len, FRAMES)), 2 * len(FRAMES), f"{checksum:016x}")
    row = lines.totals(spark, str(tmp_path)).first()
    assert (row.packets, row.caplen, row.options, row.checksum) == want
    # Whatever the window, the totals are the same, and no more than a window and a block are held.
    for window in (64, 300, 1 << 16):
        got = lines.windowed_totals(io.BytesIO(data).read, window)
        assert (got.packets, got.caplen, got.options, f"{got.checksum:016x}") == want and got.held <= window + max(map(len, FRAMES)) + 80


def test_command_line(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap([(1, i, p) for i, p in enumerate(FRAMES)]))
    lines.main([str(tmp_path / "a.pcap"), "--json", str(tmp_path / "j"), "--json-array", str(tmp_path / "a"), "--avro", str(tmp_path / "t")])
    assert spark.read.text(str(tmp_path / "j")).count() == len(FRAMES)
    array = "\n".join(r.value for r in spark.read.text(str(tmp_path / "a"), wholetext=True).collect())
    assert [x["_index"] for x in json.loads(array)] == list(range(len(FRAMES)))
    assert {p.name for p in tmp_path.glob("t_*.avro")} >= {"t_packets.avro", "t_eth.avro", "t_udp.avro", "t_datagram.avro"}


def test_files(spark, tmp_path):
    rng = random.Random(91)
    (tmp_path / "elf").mkdir()
    want = []
    for order, data in (("big", 2), ("little", 1)):
        heads = [{"type": rng.randrange(8), "flags": rng.randrange(8), "offset": rng.randrange(1 << 40), "vaddr": rng.randrange(1 << 63), "paddr": 0, "filesz": rng.randrange(1 << 30), "memsz": rng.randrange(1 << 30), "align": 4096} for _ in range(3)]
        entry, machine = rng.randrange(1 << 63), rng.randrange(1, 300)
        values = {"magic": b"\x7fELF", "file_class": 2, "data": data, "ident": bytes(10), "type": 3, "machine": machine, "version": 1, "entry": entry, "phoff": 96, "shoff": 0, "flags": 0, "ehsize": 64, "phentsize": 56, "phnum": len(heads), "shentsize": 0, "shnum": 0, "shstrndx": 0}
        (tmp_path / "elf" / order).write_bytes(files.ELF64.pack(values, order).ljust(96, b"\0") + b"".join(files.ELF64_SEGMENT.pack(h, order) for h in heads))
        want.append((order, entry, machine, 3, [(h["type"], h["offset"], h["vaddr"], h["memsz"]) for h in heads]))
    (tmp_path / "elf" / "not").write_bytes(b"x" * 100)
    (tmp_path / "elf" / "cut").write_bytes(files.ELF64.pack(values, "little"))
    rows = files.elf_headers(spark, str(tmp_path / "elf")).collect()
    assert sorted((r.order, int(r.entry), r.machine, r.phnum) for r in rows if not r.path.endswith("cut")) == [w[:4] for w in sorted(want)]
    segments = files.elf_segments(spark, str(tmp_path / "elf")).orderBy("order", "segment").collect()
    assert [(r.order, r.type, int(r.offset), int(r.vaddr), int(r.memsz)) for r in segments] == [(w[0], *h) for w in sorted(want) for h in w[4]]
    boot = files.FAT16_BOOT.pack({"jump": b"\xeb\x3e\x90", "oem": b"SEEDED  ", "bytes_per_sector": 512, "sectors_per_cluster": 4, "reserved_sectors": 2, "fats": 2, "root_entries": 32, "total_sectors": 900, "media": 240, "sectors_per_fat": 3})
    entry = lambda name, ext, attributes, size: files.FAT16_ENTRY.pack({"name": name, "extension": ext, "attributes": attributes, "reserved": bytes(10), "time": 0, "date": 0, "cluster": 7, "size": size})
    root = entry(b"NOTES   ", b"MD ", 33, 70_007) + entry(b"\xe5ONE    ", b"BIN", 32, 5) + entry(b"PHOTOS  ", b"   ", 16, 0) + entry(b"A       ", b"B  ", 32, 1)
    (tmp_path / "fat.img").write_bytes(boot.ljust(8 * 512, b"\0") + root.ljust(1024, b"\0"))
    rows = files.fat16_directory(spark, str(tmp_path / "fat.img")).orderBy("entry").collect()
    assert [(r.entry, r.name, r.attributes, r.size) for r in rows] == [(0, "NOTES.MD", 33, 70_007), (2, "PHOTOS", 16, 0), (3, "A.B", 32, 1)]
