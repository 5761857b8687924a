"""Structure repair of conversations: cheapest edits to ``system? (user assistant)+`` with an audit of every choice.

Rows shrink to symbols (role initial, fault) before they are put in order, and a conversation is first brought to runs of
equal symbols in chunks of turns, many tasks to a long conversation; only the runs meet in one place. The
solver (``role_paths``) works on the runs. The texts come in once more, in order, and stream past the audit.

Rows of one turn stand in the order of role and of the text's MD5 digest, so equal rows are neighbours. Digests
also stand for texts where repeats are looked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.role_paths import INITIALS, MUST_GO, NAMES, NEXT, START, Paths, Prices, kept, symbol
from sheaf.session import cut_lineage

SPACE = " \t\n\x0b\f\r"
CHUNK_TURNS = 10_000
"""Turn numbers of a chunk."""
PIECE_RUNS = 50_000
"""Runs that leave a chunk as one row."""
LEGAL = {"su", "ua", "au"}


@lru_cache(maxsize=4)
def paths(prices: Prices) -> Paths:
    return Paths(prices)


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls as one space (turn and conv_id stay), and the digest that orders a turn."""
    space = F.lit(" ")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), space).alias("role"),
                       F.coalesce(F.col("text").cast("string"), space).alias("text")).withColumn(
        "digest", F.unhex(F.md5("text")))


def _end(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


def row_symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, blank, truncated, first: light rows; ``first``: no earlier turn has that role and text."""
    end = _end(F.col("text"))
    light = _ordered(rows).select("conv_id", "turn", "role", "digest", (end == "").alias("blank"),
                                  (~end.isin(".", "!", "?")).alias("truncated"))
    earliest = light.groupBy("conv_id", "role", "digest").agg(
        F.min("turn").alias("_turn"), F.max(F.col("turn").isNull()).alias("_null")).select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "_turn", "_null")
    same = light["conv_id"].eqNullSafe(F.col("_conv")) & (light["role"] == F.col("_role")) & (light["digest"] == F.col("_digest"))
    first = F.when(F.col("_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("_turn"))
    return light.join(earliest, same).select(*light.columns, first.alias("first"))


RUNS = ("conv_id long, chunk long, part long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
        "low long, high long, turns long, symbols array<int>, counts array<long>")


def _runs(light: DataFrame) -> DataFrame:
    """Runs of symbols per chunk of turns, in parts of bounded size, with the counts that add up over a conversation."""
    names = [c.split()[0] for c in RUNS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}[
        c.split()[1]] for c in RUNS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, piece, before = [], None, None, None

        def fresh(part, initial=None):
            return {"part": part, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": initial, "tail": initial,
                    "low": None, "high": None, "turns": 0, "symbols": [], "counts": []}

        def close():
            out.append((*at, *(piece[c] for c in names[2:])))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for b in batches:
            for conv, chunk, turn, role, digest, blank, truncated, first in zip(*(c.to_pylist() for c in b.columns)):
                initial = role[:1]
                if (conv, chunk) != at:
                    if at is not None:
                        close()
                    at, piece, before = (conv, chunk), fresh(0, initial), None
                elif len(piece["counts"]) >= PIECE_RUNS:
                    close()
                    piece = fresh(piece["part"] + 1, initial)
                elif piece["tail"] + initial not in LEGAL:
                    piece["illegal"] += 1
                piece["tail"] = initial
                again = before == (turn, role, digest)
                before = (turn, role, digest)
                if turn is not None:
                    if piece["high"] != turn:
                        piece["turns"] += 1
                        piece["high"] = turn
                        if piece["low"] is None:
                            piece["low"] = turn
                if blank:
                    piece["blank"] += 1
                    c = MUST_GO
                elif again or not first:
                    piece["duplicate"] += 1
                    c = MUST_GO
                else:
                    piece["truncated"] += truncated
                    c = symbol(INITIALS.get(initial, 3), truncated)
                if piece["symbols"] and piece["symbols"][-1] == c:
                    piece["counts"][-1] += 1
                else:
                    piece["symbols"].append(c)
                    piece["counts"].append(1)
            if len(out) >= 5_000:
                yield batch()
                out.clear()
        if at is not None:
            close()
        if out:
            yield batch()

    chunk = F.floor(F.col("turn") / CHUNK_TURNS).cast("long")
    dealt = light.select("conv_id", chunk.alias("chunk"), "turn", "role", "digest", "blank", "truncated", "first").repartition(
        "conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role", "digest")
    return dealt.mapInArrow(run, RUNS)


AUDITS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def audits(rows: DataFrame, ids: DataFrame | None = None, prices: Prices = Prices()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation.

    ``ids``: conversations to report besides (column conv_id); those without rows have zeros and an empty audit.
    """
    runs = _runs(row_symbols(rows))
    if ids is not None:
        empty = [F.lit(None).cast(k).alias(n) for n, k in (c.split(" ") for c in RUNS.split(", ")[1:])]
        runs = runs.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", *empty))
    names = [c.split()[0] for c in AUDITS.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        out, at, state = [], (), None

        def close():
            cost, audit = paths(prices).solve(state["symbols"], state["counts"])
            gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
            out.append((at[0], gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], cost, audit))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for b in batches:
            for row in b.to_pylist():
                if (row["conv_id"],) != at:
                    if at:
                        close()
                    at = (row["conv_id"],)
                    state = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "tail": None, "low": None, "high": None,
                             "turns": 0, "symbols": array("b"), "counts": array("q")}
                if row["symbols"] is None:
                    continue
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    state[c] += row[c]
                if state["tail"] is not None and state["tail"] + row["head"] not in LEGAL:
                    state["illegal"] += 1
                state["tail"] = row["tail"]
                if row["low"] is not None:
                    if state["high"] == row["low"]:
                        state["turns"] -= 1
                    state["low"] = row["low"] if state["low"] is None else state["low"]
                    state["high"] = row["high"]
                state["symbols"].extend(row["symbols"])
                state["counts"].extend(row["counts"])
            if len(out) >= 2_000:
                yield batch()
                out.clear()
        if at:
            close()
        if out:
            yield batch()

    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part").mapInArrow(run, AUDITS)


REPAIRED = "conv_id long, edit string, role string, text string"


def repaired_rows(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, edit (K, R or I), role, text of the rows that stay or are inserted.

    All rows of a conversation are neighbours in one partition, in their order.
    """
    names = [c.split()[0] for c in REPAIRED.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, audit, place, state = [], (), "", 0, START

        def insertions():
            nonlocal place, state
            while place < len(audit) and audit[place] == "I":
                place, state = place + 1, NEXT[state]
                out.append((at[0], "I", NAMES[state], ""))

        for b in batches:
            for conv, side, audited_, role, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (
                    "conv_id", "side", "audit", "role", "text"))):
                if side == 0:
                    insertions()
                    at, audit, place, state = (conv,), audited_, 0, START
                    continue
                insertions()
                edit = audit[place]
                place += 1
                if edit == "K":
                    state = kept(state, symbol(INITIALS.get(role[:1], 3), False))
                    out.append((conv, edit, role, text))
                elif edit == "R":
                    state = NEXT[state]
                    out.append((conv, edit, NAMES[state], text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i else pa.int64()) for i, c in enumerate(zip(*out))], names)
                out.clear()
        insertions()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i else pa.int64()) for i, c in enumerate(zip(*out))], names)

    none = F.lit(None)
    both = audited.select("conv_id", F.lit(0).alias("side"), "audit", none.cast("long").alias("turn"), none.cast("string").alias("role"),
                          none.cast("binary").alias("digest"), none.cast("string").alias("text")).unionByName(
        _ordered(rows).select("conv_id", F.lit(1).alias("side"), none.cast("string").alias("audit"), "turn", "role", "digest", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "side", "turn", "role", "digest").mapInArrow(run, REPAIRED)


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` lines; rows in the order of ``repaired_rows``, none of which is kept."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, digest = [], (), None
        for b in batches:
            for conv, role, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text"))):
                if (conv,) != at:
                    if at:
                        out.append((at[0], digest.hexdigest()))
                    at, digest = (conv,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["conv_id", "repaired_sha256"])
                out = []
        if at:
            out.append((at[0], digest.hexdigest()))
            ids, digests = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests)], ["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None, prices: Prices = Prices()) -> DataFrame:
    """One row per conversation: the columns of ``audits`` and repaired_sha256.

    ``rows`` has conv_id, turn, role, text; other columns are ignored. Rows stand by turn, nulls first, then role, then the
    text's digest; a null role or text is one space; rows without a conv_id are one conversation. An empty
    role has no legal initial. Repeated rows are duplicates of the first. An empty table gives no rows.
    """
    found = cut_lineage(audits(rows, ids, prices))
    digests = conversation_digests(repaired_rows(rows, found)).withColumnRenamed("conv_id", "_conv")
    out = found.join(digests, found["conv_id"].eqNullSafe(digests["_conv"]), "left")
    return out.select(*found.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage that crc32 of ``conv_id:turn`` chooses: rows dropped (0), emptied (1), without
    ``.!?`` (2), repeated (3), or given the role user (4), of 20 remainders. Nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                       (F.crc32(F.encode(key, "UTF-8")) % 20).alias("_h"))
    h = F.col("_h")
    copies = F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(h != 0).select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("_copy")).drop("_copy")
