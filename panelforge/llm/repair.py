"""Conversation structure repair: lightest derivations over rows as weighted deductions.

A conversation is to become ``(s?(ua)+)?`` in the initials of its roles. An item (i, q) says that the first i rows can be edited
so that the roles so far end in state q. Deductions lead from item to item: keep, rerole or delete the next row, insert a
message. Each carries a cost and a letter, so a derivation is worth (cost, audit), compared in that order. Its weight function appends:
(c, w) -> (c + cost, w + letter). That is superior, since nothing gets cheaper and no string sorts after its own extension, and
monotone within an item: derivations of one item and one cost edit the same rows, so neither audit is a prefix of
the other and what is appended to both does not change their order. Knuth's agenda then finalises items in the order of their value.

Rows are sorted over all tasks and cut into pieces of bounded size; a piece has a table of lightest derivations from each state to
each state, and a conversation's pieces are joined by the same weights. So a conversation may span any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {2: "user", 3: "assistant"}
#: States: 0 nothing yet, 1 after the system message, 2 after a user's, 3 after an assistant's. What may come next, and where it leads.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
GOALS = (0, 3)
#: Rows and characters of a piece; patterns of pieces that a worker remembers.
PIECE_ROWS, PIECE_CHARS, CACHE_PATTERNS = 256, 1 << 15, 50_000
SPACE = " \t\n\x0b\x0c\r"
TABLE = "array<struct<start: int, end: int, cost: bigint, audit: string>>"
FACTS = "min_turn bigint, max_turn bigint, turns bigint, n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string"


@lru_cache(CACHE_PATTERNS)
def lightest(pattern: tuple[tuple[str, str, int], ...], start: int) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) from a state before a run of rows to each state after it.

    A row is (initial, fault, copies): fault "x" must go, "t" is truncated, "" is sound; copies beyond the first of a row must go.
    """
    n = len(pattern)
    agenda, done, found = [(0, "", 0, start)], set(), {}
    while agenda and len(found) < len(NEXT):
        cost, audit, i, state = heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            found[state] = (cost, audit)
        for role, end in NEXT[state].items():
            if role != "s" and (i, end) not in done:
                heappush(agenda, (cost + INSERT, audit + "I", i, end))
        if i == n:
            continue
        initial, fault, copies = pattern[i]
        heappush(agenda, (cost + DELETE * copies, audit + "D" * copies, i + 1, state))
        if fault == "x":
            continue
        more, rest = TRUNCATED * (fault == "t") + DELETE * (copies - 1), "D" * (copies - 1)
        for role, end in NEXT[state].items():
            if role == initial:
                heappush(agenda, (cost + KEEP + more, audit + "K" + rest, i + 1, end))
            elif role != "s":
                heappush(agenda, (cost + REROLE + more, audit + "R" + rest, i + 1, end))
    return found


def joined(tables: list[list[dict]]) -> tuple[int, str, list[tuple[int, int, str]]]:
    """Cost and audit of the lightest derivation over a conversation's pieces, and (start, end, audit) of each piece in it."""
    best = {0: (0, "", None)}
    for table in tables:
        new: dict[int, tuple] = {}
        for e in table:
            if e["start"] in best:
                cost, audit, _ = best[e["start"]]
                value = (cost + e["cost"], audit + e["audit"])
                if e["end"] not in new or value < new[e["end"]][:2]:
                    new[e["end"]] = (*value, (best[e["start"]], e))
        best = new
    end = min((best[q][:2], q) for q in GOALS if q in best)[1]
    cost, audit, back = best[end]
    path = []
    while back:
        before, e = back
        path.append((e["start"], e["end"], e["audit"]))
        back = before[2]
    return cost, audit, path[::-1]


def edited(start: int, audit: str, roles: list[str], texts: list[str], copies: list[int]) -> list[dict]:
    """The messages that a piece's edits leave."""
    out, state, rows = [], start, ((r, t, c == 0) for r, t, n in zip(roles, texts, copies) for c in range(n))
    for letter in audit:
        role, text, _ = (None, "", True) if letter == "I" else next(rows)
        if letter == "D":
            continue
        end = NEXT[state][role[:1]] if letter == "K" else next(e for r, e in NEXT[state].items() if r != "s")
        out.append({"edit": letter, "role": role if letter == "K" else ROLES[end], "text": text})
        state = end
    return out


def _pieces(conv_type: pa.DataType):
    fields = ["conv_id", "piece", "min_turn", "max_turn", "turns", "n_rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "lightest", "roles", "texts", "copies"]

    def piece(number: int, conv, rows: list[dict], starts: tuple[int, ...]) -> dict:
        pattern, faults, illegal, last = [], {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
        for r in rows:
            initial, fault, n = r["initial"], r["fault"], r["copies"]
            if fault:
                faults[fault] += n if fault in ("blank", "duplicate") else 1
            if fault not in ("blank", "duplicate"):
                faults["duplicate"] += n - 1
            illegal += (last is not None and last + initial not in ("su", "ua", "au")) + (n - 1) * (initial + initial not in ("su", "ua", "au"))
            last = initial
            pattern.append((initial if initial in ("s", "u", "a") else "", "x" if fault in ("blank", "duplicate") else "t" if fault else "", n))
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        table = [{"start": s, "end": q, "cost": c, "audit": w} for s in starts for q, (c, w) in lightest(tuple(pattern), s).items()]
        return {
            "conv_id": conv, "piece": number, "min_turn": min(turns, default=None), "max_turn": max(turns, default=None), "turns": len(set(turns)), "n_rows": sum(r["copies"] for r in rows),
            **faults, "illegal": illegal, "first": rows[0]["initial"], "last": last, "lightest": table, "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows], "copies": [r["copies"] for r in rows],
        }

    entry = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    kinds = [conv_type, *[pa.int64()] * 9, pa.string(), pa.string(), pa.list_(entry), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(fields, kinds)))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows as pieces. Only the first conversation of a task may have begun before it, and a long one goes on over pieces."""
        number, conv, rows, chars, starts, seen = TaskContext.get().partitionId() << 32, None, [], 0, tuple(NEXT), False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if seen and (r["conv_id"] != conv or len(rows) == PIECE_ROWS or chars > PIECE_CHARS):
                    out.append(piece(number, conv, rows, starts))
                    number, rows, chars, starts = number + 1, [], 0, tuple(NEXT) if r["conv_id"] == conv else (0,)
                conv, seen = r["conv_id"], True
                rows.append(r)
                chars += len(r["text"])
            yield pa.RecordBatch.from_pylist(out, schema)
        if seen:
            yield pa.RecordBatch.from_pylist([piece(number, conv, rows, starts)], schema)

    return pieces


def _whole(conv_type: pa.DataType):
    step = pa.struct([("piece", pa.int64()), ("start", pa.int32()), ("audit", pa.string())])
    counts = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", conv_type), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("steps", pa.list_(step))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations from their pieces."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["piece"])
                cost, audit, path = joined([p["lightest"] for p in parts])
                timed = [p for p in parts if p["turns"]]
                turns = sum(p["turns"] for p in timed) - sum(a["max_turn"] == b["min_turn"] for a, b in zip(timed, timed[1:]))
                gaps = timed[-1]["max_turn"] - timed[0]["min_turn"] + 1 - turns if timed else 0
                illegal = sum(p["illegal"] for p in parts) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
                total = {c: sum(p[c] for p in parts) for c in ("n_rows", "blank", "duplicate", "truncated")}
                out.append({"conv_id": r["conv_id"], **total, "gaps": gaps, "illegal": illegal, "cost": cost, "audit": audit, "steps": [{"piece": p["piece"], "start": s, "audit": w} for p, (s, _, w) in zip(parts, path)]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return whole


def _edited(conv_type: pa.DataType):
    message = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("conv_id", conv_type), ("piece", pa.int64()), ("messages", pa.list_(message))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256).to_pylist()
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "piece": r["piece"], "messages": edited(r["start"], r["audit"], r["roles"], r["texts"], r["copies"])} for r in rows], schema)

    return run


@dataclass
class Repaired:
    """facts: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit. pieces: conv_id, piece, messages (edit, role, text)."""

    facts: DataFrame
    pieces: DataFrame

    def messages(self) -> DataFrame:
        """conv_id, piece, at, edit, role, text: the repaired conversations, ordered by piece and at."""
        return self.pieces.select("conv_id", "piece", F.posexplode("messages").alias("at", "m")).select("conv_id", "piece", "at", "m.edit", "m.role", "m.text")


def faults(text: Column, first: Column) -> Column:
    """A row's first fault: blank, duplicate (if not the ``first`` of its kind), truncated, or the empty string."""
    left = F.rtrim(text, F.lit(SPACE))
    return F.when(left == "", "blank").when(~first, "duplicate").when(~F.right(left, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """The cheapest edits that give each conversation roles whose initials are ``(s?(ua)+)?``; of equal costs the least audit in ASCII.

    Rows of a conversation are ordered by turn (nulls first), then role and text. A row is blank (nothing but ASCII white space),
    a duplicate (role and text seen earlier in its conversation) or truncated (its last other character is none of ``.!?``); the first
    that holds counts. Edits: K keeps a row, R makes it a user's or assistant's (2), D deletes it (3; blank rows and duplicates
    must go), I inserts an empty message of user or assistant (2); a truncated row that stays costs 1 more.
    ``audit`` has a letter for each edit. ``gaps`` counts missing turn numbers between a conversation's least and largest,
    ``illegal`` adjacent rows whose initials are not su, ua or au.

    Null roles and texts are one space; a null conv_id is a conversation. ``turn`` is a whole number. An empty table has no
    conversations; other columns are ignored. Equal rows are counted before anything is shuffled, and a conversation of
    any length is dealt over tasks by its order; only one small table for each piece of it meets in one place.
    """
    kind = rows.schema[conv_id].dataType
    arrow = T.StructType([T.StructField("c", kind)])
    conv_type = _arrow_type(arrow)
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    narrow = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), told(role).alias("role"), told(text).alias("text"))
    counted = narrow.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    counted = staged(counted.withColumn("mark", mark), "conversation-rows")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = counted.groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m")).agg(F.min(order).alias("earliest"))
    seen = counted.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")))
    judged = seen.select("conv_id", "turn", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"), faults(F.col("text"), F.col("turn").eqNullSafe(F.col("earliest.turn"))).alias("fault"))
    judged = staged(judged.withColumn("head", F.substring("text", 1, 64)), "judged-rows")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = judged.repartitionByRange(parts, "conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text")
    of = f"conv_id {kind.simpleString()}"
    pieces = placed.select("conv_id", "turn", "role", "text", "copies", "initial", "fault").mapInArrow(_pieces(conv_type), f"{of}, piece bigint, {FACTS}, lightest {TABLE}, roles array<string>, texts array<string>, copies array<bigint>")
    pieces = staged(pieces, "conversation-pieces")
    part = F.struct("piece", "min_turn", "max_turn", "turns", "n_rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "lightest")
    counts = "n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    whole = pieces.groupBy("conv_id").agg(F.collect_list(part).alias("parts")).mapInArrow(_whole(conv_type), f"{of}, {counts}, audit string, steps array<struct<piece: bigint, start: int, audit: string>>")
    whole = staged(whole, "repaired-conversations")
    steps = whole.select(F.explode("steps").alias("s")).select("s.piece", "s.start", "s.audit")
    done = pieces.select("conv_id", "piece", "roles", "texts", "copies").join(steps, "piece").mapInArrow(_edited(conv_type), f"{of}, piece bigint, messages array<struct<edit: string, role: string, text: string>>")
    return Repaired(whole.drop("steps"), done)


def _arrow_type(schema: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).field(0).type
