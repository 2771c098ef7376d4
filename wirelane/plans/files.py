"""Other file formats by the same layouts: ELF headers and segments, and FAT16 directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelane.operators.layout import RUNTIME, Layout, le_u16, le_u32, raw, u8, uint

_R16, _R32, _R64 = (uint(n, RUNTIME) for n in (16, 32, 64))
# The records of both formats, in file order.
ELF64 = Layout("Elf64", [("magic", raw(4)), ("file_class", u8), ("data", u8), ("ident", raw(10)), ("type", _R16), ("machine", _R16), ("version", _R32), ("entry", _R64), ("phoff", _R64), ("shoff", _R64), ("flags", _R32), ("ehsize", _R16), ("phentsize", _R16), ("phnum", _R16), ("shentsize", _R16), ("shnum", _R16), ("shstrndx", _R16)])
ELF64_SEGMENT = Layout("ProgramHeader", [("type", _R32), ("flags", _R32), ("offset", _R64), ("vaddr", _R64), ("paddr", _R64), ("filesz", _R64), ("memsz", _R64), ("align", _R64)])
FAT16_BOOT = Layout("BootSector", [("jump", raw(3)), ("oem", raw(8)), ("bytes_per_sector", le_u16), ("sectors_per_cluster", u8), ("reserved_sectors", le_u16), ("fats", u8), ("root_entries", le_u16), ("total_sectors", le_u16), ("media", u8), ("sectors_per_fat", le_u16)])
FAT16_ENTRY = Layout("DirectoryEntry", [("name", raw(8)), ("extension", raw(3)), ("attributes", u8), ("reserved", raw(10)), ("time", le_u16), ("date", le_u16), ("cluster", le_u16), ("size", le_u32)])


def elf_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, order, entry, machine, phnum) of 64-bit ELF files; their byte order is a field of the file."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, ELF64.size).alias("b"))
    order = F.when(ELF64.view(F.col("b"))["data"] == 2, "big").otherwise("little")
    view = ELF64.view(F.col("b"), 0, order)
    known = files.where((view["magic"] == F.lit(b"\x7fELF")) & (view["file_class"] == 2))
    return known.select("path", order.alias("order"), view["entry"].cast("decimal(20,0)").alias("entry"), view["machine"].alias("machine"), view["phnum"].alias("phnum"))


def elf_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, order, segment, type, flags, offset, vaddr, filesz, memsz) of the program headers of 64-bit ELF files.

    They stand phnum times phentsize bytes at phoff, a place anywhere in the file; a header cut short by the end of the file gives no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    order = F.when(ELF64.view(F.col("content"))["data"] == 2, "big").otherwise("little")
    view = ELF64.view(F.col("content"), 0, order)
    known = files.where((view["magic"] == F.lit(b"\x7fELF")) & (view["file_class"] == 2) & (view["phnum"] > 0))
    at = view["phoff"].cast("long"), view["phentsize"].cast("long")
    heads = F.transform(F.sequence(F.lit(0), view["phnum"] - 1), lambda i: F.substring("content", (at[0] + i * at[1] + 1).cast("int"), F.lit(ELF64_SEGMENT.size)))
    rows = known.select("path", order.alias("order"), F.posexplode(heads).alias("segment", "record"))
    head = ELF64_SEGMENT.view(F.col("record"), 0, F.col("order"))
    return rows.where(F.octet_length("record") == ELF64_SEGMENT.size).select("path", "order", "segment", *(head[n].alias(n) for n in ("type", "flags", "offset", "vaddr", "filesz", "memsz")))


def fat16_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, name, attributes, size) of the root directories of FAT16 images, up to the first free record; deleted ones are left out."""
    images = spark.read.format("binaryFile").load(path).select("path", "content")
    boot = FAT16_BOOT.view(F.col("content"))
    root = (boot["reserved_sectors"] + boot["fats"] * boot["sectors_per_fat"]) * boot["bytes_per_sector"]
    rows = images.select("path", F.substring("content", root + 1, boot["root_entries"] * 32).alias("root"), boot["root_entries"].alias("n"))
    entries = rows.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.substring("root", i * 32 + 1, F.lit(32)))).alias("entry", "record"), "root")
    entry = FAT16_ENTRY.view(F.col("record"))
    first = F.hex(F.substring("record", 1, 1))
    entries = entries.where(F.octet_length("record") == 32).withColumn("first", first)
    ends = entries.where("first = '00'").groupBy("path").agg(F.min("entry").alias("end"))
    live = entries.join(ends, "path", "left").where("(end is null or entry < end) and first <> 'E5'")
    name = F.rtrim(F.decode(entry["name"], "ISO-8859-1"))
    extension = F.rtrim(F.decode(entry["extension"], "ISO-8859-1"))
    return live.select("path", "entry", F.concat_ws(".", name, F.when(extension != "", extension)).alias("name"), entry["attributes"].alias("attributes"), entry["size"].alias("size"))
