"""Conversations without quotations: replies are linked to what they quote, and ordered as a tree.

Lines of a message that begin with `>` are quoted, as deep as there are such signs. Neighbouring quoted
lines of one depth are a passage. A passage's words are joined, normalised and hashed, so it does not
matter where its lines break; bodies of messages are hashed whole, by paragraphs and by lines. A passage comes
from the first earlier message of its conversation with that hash; else from the one that holds most of
its five-word shingles, four fifths of them at least; else, unless it is short, from the first
message of all with that hash; else its lines are looked up one by one. The message that most lines of the
shallowest passages that match come from is what is replied to; short lines decide where others do not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelane.llm.common import Scratch, slices

QUOTED = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$")
ATTRIBUTION = re.compile(r"(?:wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t]*$", re.IGNORECASE)
PARAGRAPHS = re.compile(r"\n[ \t]*\n")
#: Shorter normalised passages link messages of one conversation alone.
MIN_KEY = 8
#: Words of a shingle, and the per cent of a passage's shingles that a message must hold.
WIDTH, COVER = 5, 80
#: How a passage was found: the better ways decide.
BY_LINES, ELSEWHERE, BY_SHINGLES, WHOLE = 1, 2, 3, 4


def normalise(text: str) -> str:
    """The words of a text, wherever its lines break."""
    return " ".join(text.split()).casefold()


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def key_of(text: str) -> int | None:
    """A 63-bit hash of the normalised text, or its complement, which is negative, if it is short; null if it is empty."""
    key = normalise(text)
    if not key:
        return None
    return _hash(key) if len(key) >= MIN_KEY else ~_hash(key)


def shingles_of(text: str) -> list[int]:
    words = normalise(text).split(" ")
    return sorted({_hash(" ".join(words[i : i + WIDTH])) for i in range(len(words) - WIDTH + 1)})


def keys_of(body: str) -> list[int]:
    """The hashes of a message's body: whole, of its paragraphs and of its lines."""
    parts = {body, *PARAGRAPHS.split(body), *body.split("\n")}
    return sorted({h for x in parts if (h := key_of(x)) is not None})


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The message without quotations and the lines that announce them, and its passages (depth, lines)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        if found := QUOTED.match(line):
            depth = found[1].count(">")
            if depth != last:
                passages.append((depth, []))
            passages[-1][1].append(found[2])
            if not last:
                while own and not own[-1].strip():
                    own.pop()
                if own and ATTRIBUTION.search(own[-1]):
                    own.pop()
            last = depth
        else:
            own.append(line)
            last = 0
    return "\n".join(own).strip("\n") if passages else text, passages


_PARSED = "conv_id long, turn long, role string, copy int, body string, n_quoted int, own array<long>, quoted array<struct<passage: int, depth: int, key: bigint, lines: array<bigint>, shingles: array<bigint>>>"
_QUOTED = pa.list_(pa.struct([("passage", pa.int32()), ("depth", pa.int32()), ("key", pa.int64()), ("lines", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))]))


def _passage(i: int, depth: int, lines: list[str]) -> dict:
    whole = "\n".join(lines)
    return {"passage": i, "depth": depth, "key": key_of(whole), "lines": [h for x in lines if (h := key_of(x)) is not None], "shingles": shingles_of(whole)}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1000):
            found = [parse(t or "") for t in batch.column("text").to_pylist()]
            quoted = [[_passage(i, depth, lines) for i, (depth, lines) in enumerate(passages)] for _, passages in found]
            count = [sum(len(lines) for _, lines in passages) for _, passages in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "copy")), pa.array([body for body, _ in found], pa.string()), pa.array(count, pa.int32()), pa.array([keys_of(body) for body, _ in found], pa.list_(pa.int64())), pa.array(quoted, _QUOTED)], ["conv_id", "turn", "role", "copy", "body", "n_quoted", "own", "quoted"])


def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "body", 1000):
            held = pa.array([shingles_of(t or "") for t in batch.column("body").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), held], ["conv_id", "turn", "held"])


def _sources(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, copy, passage, depth, parent, n): the messages that each passage comes from, by the best way that finds any; n counts lines."""
    place = ["conv_id", "turn", "copy", "passage", "depth"]
    own = parsed.select("conv_id", "turn", F.explode("own").alias("key"))
    here = own.groupBy("conv_id", "key").agg(F.min("turn").alias("here"))
    first = here.where("key >= 0").groupBy("key").agg(F.min(F.struct("conv_id", "here")).alias("first"))
    quotes = parsed.select("conv_id", "turn", "copy", F.explode("quoted").alias("q")).select("conv_id", "turn", "copy", "q.*")
    quotes = scratch.save(quotes, "quoted")
    lines = F.struct(F.size(F.filter("lines", lambda x: x >= 0)).cast("long").alias("long"), F.size("lines").cast("long").alias("all"))
    inner = lambda turn: F.struct(F.col("conv_id").alias("c"), turn.alias("t"))
    outer = F.struct(F.col("first.conv_id").alias("c"), F.col("first.here").alias("t"))
    known = quotes.where("key is not null").withColumn("n", lines).select(*place, "key", "n")

    whole = known.join(here, ["conv_id", "key"]).where("here < turn").select(*place, inner(F.col("here")).alias("parent"), "n", F.lit(WHOLE).alias("way"))
    elsewhere = known.where("key >= 0").join(first, "key").where("first.conv_id <> conv_id").select(*place, outer.alias("parent"), "n", F.lit(ELSEWHERE).alias("way"))

    # Only conversations with a passage of enough words are shingled, and of each shingle the first message that holds it is kept.
    asked = quotes.where(F.size("shingles") > 0).withColumn("n", lines)
    bodies = parsed.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", "body")
    held = bodies.mapInArrow(_shingle, "conv_id long, turn long, held array<long>").select("conv_id", "turn", F.explode("held").alias("shingle"))
    held = held.groupBy("conv_id", "shingle").agg(F.min("turn").alias("here"))
    parts = asked.select(*place, "n", F.size("shingles").alias("of"), F.explode("shingles").alias("shingle"))
    covered = parts.join(held, ["conv_id", "shingle"]).where("here < turn").groupBy(*place, "n", "of", "here").agg(F.count(F.lit(1)).alias("hits"))
    covered = covered.where(100 * F.col("hits") >= COVER * F.col("of")).select(*place, inner(F.col("here")).alias("parent"), "n", F.lit(BY_SHINGLES).alias("way"))

    each = quotes.select(*place, F.explode("lines").alias("key"))
    placed = each.join(here, ["conv_id", "key"], "left").withColumn("here", F.when(F.col("here") < F.col("turn"), F.col("here")))
    inside = placed.where("here is not null").withColumn("parent", inner(F.col("here")))
    outside = placed.where("here is null and key >= 0").join(first, "key").where("first.conv_id <> conv_id").withColumn("parent", outer).drop("first")
    tally = F.struct(F.count_if(F.col("key") >= 0).alias("long"), F.count(F.lit(1)).alias("all"))
    by_lines = inside.unionByName(outside).groupBy(*place, "parent").agg(tally.alias("n")).withColumn("way", F.lit(BY_LINES))

    found = scratch.save(reduce(DataFrame.unionByName, (whole, elsewhere, covered, by_lines)), "found")
    best = found.groupBy(*place).agg(F.max("way").alias("way"))
    return scratch.save(found.join(best, [*place, "way"]).drop("way"), "sources")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """One row per message: (conv_id, position, turn, role, body, n_quoted, parent_turn, source_conv, source_turn, depth, links).

    messages: (conv_id, turn, role, text). body is the text without quotations; parent_turn the earlier
    message of the conversation that it quotes most (the first of equals) at the shallowest level that
    matches one, null if there is none; source_conv and source_turn name the message that it quotes most
    at the shallowest level that matches any, where that is in another conversation. links has the
    message that each passage of any depth comes from, without those that match none; null if none does.
    position counts a conversation's messages from 0: a reply follows what it replies to, replies
    to one message stand by turn, and messages that reply to nothing stand by turn. Rows that share
    conv_id and turn are copies: all are kept, the first by role and text being the one that is replied
    to. Ties go to the earliest message. A null text is an empty body; texts may have any length. Rows with a null
    conv_id or turn are left out. Other columns, also ones named like those returned, are not carried. An empty
    table gives an empty one.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    key = ["conv_id", "turn"]
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null and turn is not null")
    copies = Window.partitionBy(*key).orderBy("role", "text")
    parsed = rows.withColumn("copy", F.row_number().over(copies) - 1).mapInArrow(_parse, _PARSED)
    parsed = scratch.save(parsed, "parsed")

    sources = _sources(parsed, scratch)
    tally = lambda long, all: F.struct(long.alias("long"), all.alias("all")).alias("n")
    early = (-F.col("parent.c"), -F.col("parent.t"))
    whole = sources.groupBy(*key, "copy", "passage", "depth").agg(F.max_by("parent", F.struct("n", *early)).alias("parent"))
    link = F.struct("passage", "depth", F.col("parent.c").alias("conv_id"), F.col("parent.t").alias("turn"))
    passages = whole.groupBy(*key, "copy").agg(F.sort_array(F.collect_list(link)).alias("links"))
    votes = sources.groupBy(*key, "copy", "depth", "parent").agg(tally(F.sum("n.long"), F.sum("n.all")))
    # Deeper levels decide where no shallower one matches.
    level, is_inner = -F.col("depth"), F.col("parent.c") == F.col("conv_id")
    best = votes.groupBy(*key, "copy").agg(F.max_by("parent", F.struct(level, "n", *early)).alias("inner_or_outer"), F.max_by(F.when(is_inner, F.col("parent.t")), F.struct(is_inner.cast("int"), level, "n", early[1])).alias("parent_turn"))
    best = best.join(passages, [*key, "copy"])
    best = scratch.save(best, "best")
    outer = F.col("inner_or_outer.c") != F.col("conv_id")
    links = best.select(*key, "copy", "parent_turn", F.when(outer, F.col("inner_or_outer.c")).alias("source_conv"), F.when(outer, F.col("inner_or_outer.t")).alias("source_turn"), "links")

    # Paths from the root, doubled in each round: only messages that reply to one are in these tables.
    at = lambda turn: F.struct(turn.alias("turn"))
    paths = scratch.save(links.where("parent_turn is not null").select("conv_id", "turn", "copy", F.array(at(F.col("turn"))).alias("path"), F.col("parent_turn").alias("up")), "paths-0")
    k = 0
    while not paths.where("up is not null").isEmpty():
        heads = paths.where("copy = 0").select("conv_id", F.col("turn").alias("up"), F.col("path").alias("above"), F.col("up").alias("next_up"))
        joined = paths.join(heads, ["conv_id", "up"], "left")
        grown = F.when(F.col("up").isNull(), F.col("path")).when(F.col("above").isNull(), F.concat(F.array(at(F.col("up"))), F.col("path"))).otherwise(F.concat("above", "path"))
        k += 1
        paths = scratch.save(joined.select("conv_id", "turn", "copy", grown.alias("path"), F.col("next_up").alias("up")), f"paths-{k}")
        scratch.drop(f"paths-{k - 1}")

    out = parsed.drop("own", "quoted").join(links, [*key, "copy"], "left").join(paths.drop("up"), [*key, "copy"], "left")
    out = out.withColumn("path", F.coalesce("path", F.array(at(F.col("turn")))))
    order = Window.partitionBy("conv_id").orderBy("path", "copy")
    out = out.withColumn("position", F.row_number().over(order).cast("long") - 1).withColumn("depth", F.size("path") - 1)
    return out.select("conv_id", "position", "turn", "role", "body", "n_quoted", "parent_turn", "source_conv", "source_turn", "depth", "links")
