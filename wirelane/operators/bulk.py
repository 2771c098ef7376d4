"""Bulk decode: a kernel that is given each packet and fills a row of columns, or refuses it."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wirelane.functions.types import sql_type
from wirelane.operators import protocols as pr

#: kernel(payload, caplen, link_type) gives the row's values by name, or None for a packet that is no row.
Kernel = Callable[[bytes, int, int], "dict[str, Any] | None"]


class Columns:
    """Columns of a fixed number of rows and which of them are valid; rows are set one by one, in any order."""

    def __init__(self, kind: T.StructType, rows: int):
        self.kind, self.valid = kind, np.zeros(rows, bool)
        self.values: dict[str, list] = {name: [None] * rows for name in kind.names}

    def scatter(self, i: int, row: dict[str, Any]) -> None:
        for name, column in self.values.items():
            column[i] = row[name]
        self.valid[i] = True

    def arrow(self) -> pa.StructArray:
        arrays = [pa.array(self.values[f.name], to_arrow_type(f.dataType)) for f in self.kind.fields]
        return pa.StructArray.from_arrays([pa.array(self.valid), *arrays], ["valid", *self.kind.names])


@dataclasses.dataclass(frozen=True)
class BulkTable:
    """every: (file, packet_id, valid, columns) of each packet; rows: those that the kernel took."""

    every: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.every.where("valid").drop("valid")

    def count(self) -> int:
        return self.rows.count()


def bulk_decode(packets: DataFrame, kernel: Kernel, schema: str) -> BulkTable:
    """The kernel over all packets (file, packet_id, caplen, link_type, payload), batch by batch on the executors.

    schema: the columns of a row, as in a struct type. If any packet has no payload, there are no rows at all.
    """
    kind = sql_type(f"struct<{schema}>")
    result = T.StructType([T.StructField("valid", T.BooleanType()), *kind.fields])

    def run(payloads: pa.Array, sizes: pa.Array, links: pa.Array) -> pa.Array:
        columns = Columns(kind, len(payloads))
        for i, (data, size, link) in enumerate(zip(payloads.to_pylist(), sizes.to_pylist(), links.to_pylist(), strict=True)):
            if data is not None and (row := kernel(data, size, link)) is not None:
                columns.scatter(i, row)
        return columns.arrow()

    found = F.arrow_udf(run, result)("payload", "caplen", "link_type")
    any_null = packets.agg(F.coalesce(F.bool_or(F.col("payload").isNull()), F.lit(False)).alias("_null"))  # one row
    every = packets.select("file", "packet_id", found.alias("row")).join(F.broadcast(any_null)).where("not _null")
    return BulkTable(every.select("file", "packet_id", "row.*"))


FLOW = "eth_type: int, ip_src: binary, ip_dst: binary, protocol: smallint, src_port: int, dst_port: int"


def flow(payload: bytes, caplen: int, link_type: int) -> dict[str, Any] | None:
    """The row of FLOW of an IPv4 packet with ports, behind any VLAN tags; None for others."""
    if link_type != 1:
        return None
    rows = pr.Walk(payload, reassembly=False).rows
    ports = rows.get("udp") or rows.get("tcp")
    if "ipv4" not in rows or not ports:
        return None
    ip, eth = rows["ipv4"][0], rows["eth"][0]
    return {"eth_type": eth["ethertype"], "ip_src": ip["src"], "ip_dst": ip["dst"], "protocol": ip["protocol"], "src_port": ports[0]["src_port"], "dst_port": ports[0]["dst_port"]}
