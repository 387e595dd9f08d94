"""Chat formatting: logged snapshots of a growing conversation are collapsed to the longest before rendering.

Prefixes of a conversation are told by a rolling hash that can be put together from stretches: a conversation may lie in
several tasks, each of which hashes its own turns, and what stands before is put in front afterwards. So a conversation
that holds a third of all turns is no hot key; its rendered text comes in pieces of some turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Prefix hashes are polynomials in BASE modulo a prime: that of turns x and then y is hash(x) * BASE ** len(y) + hash(y).
PRIME, BASE = 2**127 - 1, 0x5851F42D4C957F2D14057B7EF767814F
#: So many turns make a piece.
PIECE = 1000


def local_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, n, prefix, last) beside every turn, from turns sorted by conversation: within this task, how many turns and their hash; last of its conversation here."""
    part, state, at, held = TaskContext.get().partitionId(), 0, 0, None

    def marked(found: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        n, prefix, last = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(found), pa.int32()), pa.array(n, pa.int64()), pa.array(prefix, pa.binary()), pa.array(last)], [*batch.schema.names, "part", "n", "prefix", "last"])

    name = object()
    for batch in batches:
        found: list[tuple] = []
        for conv, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if conv != name:
                if found:
                    found[-1] = (*found[-1][:2], True)
                elif held is not None:
                    held = ([(*held[0][0][:2], True)], held[1])
                name, state, at = conv, 0, 0
            if held is not None and not found:
                yield marked(*held)
                held = None
            state, at = (state * BASE + int.from_bytes(said, "big")) % PRIME, at + 1
            found.append((at, state.to_bytes(16, "big"), False))
        if found:  # the last turn of a batch waits for the next one
            if len(found) > 1:
                yield marked(found[:-1], batch.slice(0, len(found) - 1))
            held = ([found[-1]], batch.slice(len(found) - 1, 1))
    if held is not None:
        yield marked([(*held[0][0][:2], True)], held[1])


def offsets(ends: list[tuple]) -> dict[tuple, tuple[int, int, bool]]:
    """Of conversations that lie in several tasks, as (part, conversation, turns, prefix): how many turns stand before each stretch, their hash, and whether more follow."""
    out: dict[tuple, tuple[int, int, bool]] = {}
    before: dict[object, tuple[int, int, int]] = {}
    for part, conv, n, prefix in sorted(ends, key=lambda e: e[0]):
        count, state, last = before.get(conv, (0, 0, -1))
        if last >= 0:
            out[last, conv] = (*out[last, conv][:2], True)
        out[part, conv] = (count, state, False)
        before[conv] = (count + n, (state * pow(BASE, n, PRIME) + int.from_bytes(prefix, "big")) % PRIME, part)
    return out


def prefixes_of(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, said, prefix, n, last) of the distinct turns (conv_id, turn, said): the hash and number of all turns up to each."""
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    once = turns.select("conv_id", "turn", "said").distinct()
    ordered = once.repartitionByRange("conv_id", "turn", "said").sortWithinPartitions("conv_id", "turn", "said")
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, said binary, part int, n long, prefix binary, last boolean"
    local = scratch.write(ordered.mapInArrow(local_prefixes, schema), "local prefixes")
    # a row for each task at most lies at its border with the next, so these few are the driver's
    ends = local.where("last")
    several = ends.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1")
    found = offsets([(r["part"], r["conv_id"], r["n"], bytes(r["prefix"])) for r in ends.join(several, "conv_id").select("part", "conv_id", "n", "prefix").collect()])
    shared = turns.sparkSession.sparkContext.broadcast(found)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, prefix, last = (batch.column(c).to_pylist() for c in ("n", "prefix", "last"))
            if known:
                for k, place in enumerate(zip(batch.column("part").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)):
                    if place in known:
                        count, state, more = known[place]
                        prefix[k] = ((state * pow(BASE, n[k], PRIME) + int.from_bytes(prefix[k], "big")) % PRIME).to_bytes(16, "big")
                        n[k], last[k] = n[k] + count, last[k] and not more
            columns = [*(batch.column(c) for c in ("conv_id", "turn", "said")), pa.array(prefix, pa.binary()), pa.array(n, pa.int64()), pa.array(last)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "said", "prefix", "n", "last"])

    return scratch.write(local.mapInArrow(whole, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, said binary, prefix binary, n long, last boolean"), "prefixes")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that begin no longer one; of equal ones, the smallest id."""
    whole = prefixes.where("last").groupBy("prefix", "n").agg(F.min("conv_id").alias("conv_id"))
    begun = prefixes.where("not last").select("prefix", "n").distinct()
    return whole.join(begun, ["prefix", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def escaped(text: Column, marker: str) -> Column:
    """text with a backslash more in each place that reads as the marker, so that only markers do; taking one away gives it back."""
    first, rest = re.escape(marker[0]), re.escape(marker[1:])
    quoted = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, rf"{first}(\\*){rest}", f"{quoted(marker[0])}\\\\$1{quoted(marker[1:])}")


def chat_pieces(df: DataFrame, scratch: Scratch | None = None, before: str = "<|", between: str = "|>\n", after: str = "\n", piece: int = PIECE) -> DataFrame:
    """(conv_id, n_turns, piece, rendered): what format_chats gives, in pieces of so many turns, numbered from 0, whose texts in order are a conversation's."""
    if min(len(before.strip()), len(between.strip())) < 2:
        raise ValueError("markers need two characters")
    scratch = scratch or Scratch(df.sparkSession)
    turns = df.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("said", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    with Scratch(df.sparkSession) as own:
        prefixes = prefixes_of(turns, own)
        places = prefixes.select("conv_id", "turn", "said", (F.col("n") - 1).alias("at")).join(maximal(prefixes), "conv_id")
        places = scratch.write(places.select("conv_id", "n_turns", F.col("turn").alias("_turn"), F.col("said").alias("_said"), "at"), "turns of maximal conversations")
    role = escaped(escaped(F.col("role"), before.strip()), between.strip())
    shown = F.concat(F.lit(before), role, F.lit(between), escaped(F.col("text"), before.strip()), F.lit(after))
    # texts meet their places turn by turn, so that a conversation's don't all meet in one task
    rows = turns.select(F.col("conv_id").alias("_conv"), "turn", "said", shown.alias("shown"))
    met = rows.join(places, (F.col("_conv") == F.col("conv_id")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("said") == F.col("_said")))
    pieces = met.groupBy("conv_id", F.floor(F.col("at") / piece).alias("piece")).agg(F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_set(F.struct("at", "shown"))).alias("parts"))
    return pieces.select("conv_id", "n_turns", "piece", F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("rendered"))


def format_chats(df: DataFrame, scratch: Scratch | None = None, before: str = "<|", between: str = "|>\n", after: str = "\n", piece: int = PIECE) -> DataFrame:
    """(conv_id, n_turns, rendered): each conversation that is no snapshot of a longer one, as one text.

    df: (conv_id, turn, role, text), extra columns are dropped. A conversation is its turns by `turn`; null roles and
    texts count as empty, a null turn comes first, repeated rows count once, rows with equal turn are ordered by a
    digest of what they say. Rows without conv_id belong to no conversation and go. A conversation whose turns all begin
    a longer one goes; of equal ones the smallest conv_id stays. Prefixes are equal if their numbers of turns and 127-bit
    hashes are. A turn is rendered as before + role + between + text + after. So that no text can pose as a turn, `<|` in
    texts and roles is written `<\\|`, and `|>` in roles `|\\>` (of what already has backslashes there, with one more). An
    empty table gives no rows; texts of any length stay whole. A conversation that doesn't fit one string (2 GB) has to be
    taken as `chat_pieces` gives it.
    """
    pieces = chat_pieces(df, scratch, before, between, after, piece)
    whole = pieces.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("piece", "rendered"))).alias("pieces"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("pieces", lambda p: p["rendered"]), "").alias("rendered"))
