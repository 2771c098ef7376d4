"""Reassembly of fragments that arrive as a stream.

The packet clock is Spark's event time: packet_id + 1 counts as seconds, as what stands at 0 is late from the start, and
the watermark stands `timeout` packets behind the last one seen. The open datagrams of the keys of a bucket are its state; one leaves
when it is complete, or when the watermark has passed its last fragment.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wirelane.operators.defrag import Config, Datagram

SCHEMA = "file string, ip_version int, first_packet_id long, last_packet_id long, total_length long, fragment_count long, completion_status int, gap_bytes long, payload binary"


#: Keys share state by their hash: a call into Python costs far more than a fragment, so a key has none of its own.
BUCKETS = 1 << 11


def _save(held: dict[tuple, Datagram]) -> bytes:
    """Datagrams' plain values by their keys: state outlives the code's classes."""
    return pickle.dumps({key: vars(d) for key, d in held.items()})


def _load(blob: bytes) -> dict[tuple, Datagram]:
    held = {}
    for key, values in pickle.loads(blob).items():
        held[key] = Datagram(0)
        vars(held[key]).update(values)
    return held


def _due(d: Datagram) -> int:
    """The watermark has passed the datagram's last fragment once it is greater."""
    return 1000 * (d.last + 1) + 1


def _step(config: Config):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def frame(found: list[tuple[tuple, Datagram]]) -> pd.DataFrame:
        return pd.DataFrame([{"file": key[0], "ip_version": key[1], **d.row()} for key, d in found], columns=columns)

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = _load(state.get[0]) if state.exists else {}
        out, seen = [], set()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("packet_id")
            fields = (rows[c].tolist() for c in ("file", "ip_version", "key", "packet_id", "frag_offset_bytes", "more_fragments", "data"))
            for file, version, own, packet, offset, more, data in zip(*fields, strict=True):
                key = file, version, bytes(own)
                seen.add(key)
                now = held.get(key)
                if now is not None and packet - now.last > config.timeout:
                    out.append((key, now))
                    now = None
                now = held[key] = now or Datagram(packet)
                if now.add(packet, offset, more, bytes(data), config):
                    out.append((key, held.pop(key)))
        # A key that has rows in this batch is not looked at before the next.
        for key in [k for k, d in held.items() if k not in seen and _due(d) < watermark]:
            out.append((key, held.pop(key)))
        if held:
            state.update((_save(held),))
            # Not before the watermark, which may have passed a datagram's last fragment already.
            state.setTimeoutTimestamp(max(min(map(_due, held.values())), watermark + 1))
        elif state.exists:
            state.remove()
        for k in range(0, len(out), 4096):
            yield frame(out[k : k + 4096])

    return run


def reassemble_stream(fragments: DataFrame, config: Config = Config()) -> DataFrame:
    """Datagrams of a stream of (file, ip_version, key, packet_id, frag_offset_bytes, more_fragments, data), in append mode.

    Complete ones come at once, others (completion_status 1 or 3) once the watermark has passed them. Packets
    more than `timeout` behind the last one seen are late and dropped by Spark. The number of datagrams held is not
    limited here: state spills to the state store.
    """
    bucketed = fragments.withColumn("bucket", F.pmod(F.xxhash64("file", "ip_version", "key"), F.lit(BUCKETS)))
    timed = bucketed.withColumn("clock", F.timestamp_seconds(F.col("packet_id") + 1)).withWatermark("clock", f"{config.timeout} seconds")
    return timed.groupBy("bucket").applyInPandasWithState(_step(config), SCHEMA, "blob binary", "append", GroupStateTimeout.EventTimeTimeout)
