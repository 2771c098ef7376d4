"""Avro object container files: a data source that writes and reads them, a file per task.

spark.write.format("avro_ocf").mode("append").save(path). Files appear under their names once the job is
committed, so a task that is run again leaves no part of a file behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wirelane.functions import schemas
from wirelane.sources.pcap import _filesystem, _paths
from wirelane.sources.sink import FileWriter

ROWS_A_BLOCK = 4096


def avro_type(kind: T.DataType, path: str) -> Any:
    """The Avro type of a Spark type; decimals are texts."""
    simple = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes", T.DecimalType: "string"}
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind:
            of = avro_type(f.dataType, f"{path}_{f.name}")
            fields.append({"name": f.name, "type": ["null", of] if f.nullable else of})
        return {"type": "record", "name": path, "fields": fields}
    if isinstance(kind, T.ArrayType):
        item = avro_type(kind.elementType, path)
        return {"type": "array", "items": ["null", item] if kind.containsNull else item}
    if type(kind) not in simple:
        raise TypeError(f"Avro files hold no {kind.simpleString()}")
    return simple[type(kind)]


def encode(schema: Any, value: Any) -> bytes:
    if isinstance(schema, list):
        return b"\0" if value is None else b"\x02" + encode(schema[1], value)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return b"".join(encode(f["type"], value[f["name"]]) for f in schema["fields"])
    if kind == "array":
        items = b"".join(encode(schema["items"], v) for v in value)
        return (schemas.varint(len(value)) + items if value else b"") + b"\0"
    if kind == "boolean":
        return b"\1" if value else b"\0"
    if kind in ("int", "long"):
        return schemas.varint(value)
    if kind in ("float", "double"):
        import struct

        return struct.pack("<f" if kind == "float" else "<d", value)
    return schemas.avro_bytes(value if isinstance(value, bytes) else str(value).encode())


class OcfWriter(FileWriter):
    suffix = "avro"

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        super().__init__(options, overwrite)
        self.schema = json.dumps(avro_type(schema, options.get("recordname", "row")), separators=(",", ":"))

    def chunks(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        schema, sync, head = json.loads(self.schema), uuid.uuid4().bytes, True
        for batch in iterator:
            for at in range(0, batch.num_rows, ROWS_A_BLOCK):
                rows = [encode(schema, r) for r in batch.slice(at, ROWS_A_BLOCK).to_pylist()]
                yield (schemas.ocf_header(self.schema, sync) if head else b"") + schemas.ocf_block(rows, sync)
                head = False


def spark_type(kind: Any) -> T.DataType:
    """The Spark type of an Avro one, for files of any writer."""
    simple = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "fixed": T.BinaryType()}
    if isinstance(kind, list):
        return spark_type(next(k for k in kind if k != "null"))
    name = kind["type"] if isinstance(kind, dict) else kind
    if name == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"]), isinstance(f["type"], list)) for f in kind["fields"]])
    if name == "array":
        return T.ArrayType(spark_type(kind["items"]), isinstance(kind["items"], list))
    return simple[name]


def _schema_of(path: str) -> T.StructType:
    """The schema that the header of the first file under a path holds."""
    files = _paths(path)
    if not files:
        raise ValueError(f"no files under {path}: give the schema with spark.read.schema()")
    store, inner = _filesystem(files[0])
    with store.open_input_file(inner) as f:
        size = 1 << 16
        while True:
            f.seek(0)
            data = f.read(size)
            try:
                return spark_type(schemas.ocf_schema(data))
            except IndexError:  # the header is longer
                if len(data) < size:
                    raise
                size *= 4


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class OcfReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.names = options["path"], schema.names

    def partitions(self) -> list[File]:
        return [File(p) for p in _paths(self.path)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition.path:
            store, inner = _filesystem(partition.path)
            with store.open_input_file(inner) as f:
                data = f.read()
            for record in schemas.read_ocf(data):
                yield tuple(record[n] for n in self.names)


class Ocf(DataSource):
    """Options: recordName. A schema that is not given is that of the first file's header."""

    @classmethod
    def name(cls) -> str:
        return "avro_ocf"

    def schema(self) -> T.StructType:
        return _schema_of(self.options["path"])

    def reader(self, schema: T.StructType) -> OcfReader:
        return OcfReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> OcfWriter:
        return OcfWriter(self.options, schema, overwrite)


def dump_tables(tables: dict[str, DataFrame], stem: str) -> list[str]:
    """Write each table that has rows to the folder <stem>_<table>.avro; their paths."""
    out = []
    for name, table in tables.items():
        if not table.isEmpty():
            table.write.format("avro_ocf").option("recordName", name).mode("append").save(f"{stem}_{name}.avro")
            out.append(f"{stem}_{name}.avro")
    return out
