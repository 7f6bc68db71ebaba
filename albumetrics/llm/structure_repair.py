"""Repair of conversation structure at least cost, by a suffix-shared automaton of role and fault signatures.

A conversation should read ``(s?(ua)+)?`` in the first letters of its roles, without blank, duplicate or cut-off turns. Each
row becomes one symbol: ``x`` (blank or duplicate, has to go), or the class of its role (``s``, ``u``, ``a``, ``o`` for any
other), as a capital where the text is cut off. A conversation is the word of its symbols. Words that end alike share their
end: the automaton has one node for each different suffix of all words, and since a node has exactly one way to the end, two
nodes are equal only if their suffixes are. Per node and state of the grammar it keeps the cost to go and the first edit of
the best audit, whose rest belongs to the next node. The four edits have different letters, so ties between audits of one
cost are settled by the first letter alone (the ASCII-least), and no audit is ever compared or copied.

Different words are sorted from their ends and dealt by ranges, so words with a common end meet in one task, one after the
other: a task keeps the nodes of the word at hand and drops those that no later word can share. Each node is worked out
once (once more where a range is cut). What a symbol does to the cost to go depends on cost differences alone, of which
there are few, so that step is remembered.

Rows are dealt by conversation and block of ``BLOCK_TURNS`` turn numbers, after equal rows were added up: conversations of
any length are spread over tasks, which close segments beyond ``SEGMENT_ROWS`` rows or ``SEGMENT_CHARS`` characters. The
audit and the digest of a whole conversation are one value in order, so its segments stream through one task at last; only
the state of the hash, the audit and one segment are held there.

Defined cases: a null role or text is one space; a null conversation id is a conversation of its own; rows come by turn
(nulls first), then role and text; rows equal in all of these are copies of one another, of which the first may stay. A role
with no letters cannot be kept. Of a conversation without rows the audit is empty. Extra columns are ignored; an empty table
has no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetrics.llm.common import prepare
from albumetrics.sources.workspace import Scratch

# Costs of the edits, and the white space of the fault rules.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DAMAGE_CLASSES = 20

BLOCK_TURNS = 64
SEGMENT_ROWS = 4096
SEGMENT_CHARS = 1 << 18

#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: What a new turn or a turn with a new role has to be in a state, and the state after it.
WANTED = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
LEGAL = {"su", "ua", "au"}


def move(state: int, kind: str) -> int | None:
    """The state after a kept turn of that role class; None where the grammar has no such turn."""
    if kind == "s":
        return SYSTEM if state == START else None
    return AFTER[state] if WANTED[state][0] == kind else None


#: Cost to go at the end of a word: a system turn alone lacks two turns, a user turn one.
END_COSTS = (0, 2 * INSERT, INSERT, 0)


@lru_cache(maxsize=1 << 16)
def _step(symbol: str, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Costs to go before a symbol and the best first edit, per state, from the costs to go after it."""
    kind, cut = symbol.lower(), CUT_OFF if symbol.isupper() else 0
    costs, edits = [0] * 4, [""] * 4
    for state in STATES:
        options = [(DELETE + ahead[state], "D")]
        if symbol != "x":
            kept = move(state, kind)
            if kept is not None:
                options.append((cut + ahead[kept], "K"))
            options.append((REROLE + cut + ahead[AFTER[state]], "R"))
        costs[state], edits[state] = min(options)
    # An insertion stays before the symbol; two in a row are enough to reach every state that can be reached.
    for _ in range(2):
        for state in STATES:
            option = (INSERT + costs[AFTER[state]], "I")
            if option < (costs[state], edits[state]):
                costs[state], edits[state] = option
    return tuple(costs), "".join(edits)


class SuffixAutomaton:
    """Nodes of the word at hand, from its end; words must come sorted by their reversals."""

    def __init__(self):
        self._word = ""
        self._edits: list[str] = []
        #: Per node the costs to go less the least of them, and that least cost.
        self._relative = [END_COSTS]
        self._least = [0]
        self.made = 0

    def solve(self, backward: str) -> tuple[int, str]:
        """Cost and audit of the word whose reversal is given."""
        shared = 0
        for mine, theirs in zip(self._word, backward):
            if mine != theirs:
                break
            shared += 1
        del self._edits[shared:], self._relative[shared + 1:], self._least[shared + 1:]
        for symbol in backward[shared:]:
            costs, edits = _step(symbol, self._relative[-1])
            least = min(costs)
            self._edits.append(edits)
            self._relative.append(tuple(c - least for c in costs))
            self._least.append(self._least[-1] + least)
            self.made += 1
        self._word = backward
        return self._least[-1] + self._relative[-1][START], self._audit()

    def _audit(self) -> str:
        out, state, node = [], START, len(self._edits)
        while node:
            edit = self._edits[node - 1][state]
            out.append(edit)
            if edit == "I":
                state = AFTER[state]
                continue
            node -= 1
            if edit == "K":
                state = move(state, self._word[node].lower())
            elif edit == "R":
                state = AFTER[state]
        return "".join(out) + "I" * (END_COSTS[state] // INSERT)


def damage(turns: DataFrame) -> DataFrame:
    """The rows after damage by crc32(``conv_id:turn``) % 20, with ``copies`` (0: dropped); nulls count as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(key) % DAMAGE_CLASSES).alias("_class"))
    kind = F.col("_class")
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", f"[{ENDS}]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def intact(turns: DataFrame) -> DataFrame:
    """Rows as they are, with ``copies`` 1."""
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(1).cast("long").alias("copies"))


_FIRST = -(1 << 63)


def _turn_key() -> Column:
    return F.coalesce("turn", F.lit(_FIRST))


def _marked(rows: DataFrame) -> DataFrame:
    """Equal rows added up, each with its block, whether its text ends, and whether an earlier turn said the same."""
    digest = F.unhex(F.sha2("text", 256))
    said = rows.filter("copies > 0").select("conv_id", "role", digest.alias("digest"), _turn_key().alias("at"))
    # Only what several turns say; repetition within a turn is settled where its rows meet.
    repeated = (
        said.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .filter("first < last").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), "digest", "first"))
    added = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("_digest", digest)
    joined = added.join(
        repeated,
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_digest") == F.col("digest")),
        "left")
    body = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(body == "", "b").when(_turn_key() > F.col("first"), "d")
        .when(~F.right(body, F.lit(1)).isin(*ENDS), "t").otherwise(""))
    return joined.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS).cast("long"), F.lit(-(1 << 62))).alias("block"),
        "turn", "role", "text", "copies", fault.alias("fault"))


SEGMENTS_DDL = ("conv_id long, block long, part long, symbols string, roles array<string>, texts array<string>, "
                "copies array<long>, blank long, duplicate long, truncated long, turns long, first_turn long, last_turn long")


def symbols_of(role: str, fault: str, copies: int) -> str:
    """The symbols of a row and its copies, which are duplicates of it."""
    if fault in ("b", "d"):
        return "x" * copies
    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (kind.upper() if fault == "t" else kind) + "x" * (copies - 1)


class _Segment:
    def __init__(self, conv: int | None, block: int, part: int):
        self.row = {
            "conv_id": conv, "block": block, "part": part, "symbols": [], "roles": [], "texts": [], "copies": [],
            "blank": 0, "duplicate": 0, "truncated": 0, "turns": 0, "first_turn": None, "last_turn": None}
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str, new_turn: bool) -> None:
        row = self.row
        row["symbols"].append(symbols_of(role, fault, copies))
        row["roles"].append(role)
        row["texts"].append(text)
        row["copies"].append(copies)
        if fault == "b":
            row["blank"] += copies
        elif fault == "d":
            row["duplicate"] += copies
        else:
            row["duplicate"] += copies - 1
            row["truncated"] += fault == "t"
        if turn is not None:
            row["turns"] += new_turn
            row["first_turn"] = turn if row["first_turn"] is None else row["first_turn"]
            row["last_turn"] = turn
        self.size += len(text)

    def full(self) -> bool:
        return self.size >= SEGMENT_CHARS or len(self.row["roles"]) >= SEGMENT_ROWS

    def close(self) -> pa.RecordBatch:
        row = self.row | {"symbols": "".join(self.row["symbols"])}
        return pa.RecordBatch.from_pylist([row], _SEGMENTS)


_LONGS = ["blank", "duplicate", "truncated", "turns", "first_turn", "last_turn"]
_SEGMENTS = pa.schema(
    [(n, pa.int64()) for n in ("conv_id", "block", "part")] + [("symbols", pa.string())]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64()))]
    + [(n, pa.int64()) for n in _LONGS])


def _cut_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, segment, previous = None, None, None
    for batch in batches:
        for conv, block, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if segment is None or (conv, block) != key:
                if segment is not None:
                    yield segment.close()
                key, segment, previous = (conv, block), _Segment(conv, block, 0), None
            elif segment.full():
                yield segment.close()
                segment = _Segment(conv, block, segment.row["part"] + 1)
            if copies:
                segment.add(turn, role, text, copies, fault, turn != previous)
                previous = turn
    if segment is not None:
        yield segment.close()


def segments(rows: DataFrame) -> DataFrame:
    """Segments of conversations in order, each with its symbols, rows and counts; at least one per conversation."""
    dealt = _marked(rows).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return dealt.mapInArrow(_cut_sorted, SEGMENTS_DDL)


def _solve_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton()
    for batch in batches:
        words = batch.column(0).to_pylist()
        solved = [automaton.solve(word) for word in words]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())],
            ["backward", "cost", "audit"])


def audits(cut: DataFrame) -> DataFrame:
    """Per conversation of the segments its ``cost`` and ``audit``; every different signature is solved once."""
    parts = F.array_sort(F.collect_list(F.struct("block", "part", "symbols")))
    words = cut.groupBy("conv_id").agg(F.reverse(F.array_join(F.transform(parts, lambda p: p["symbols"]), "")).alias("backward"))
    solved = (
        words.select("backward").distinct().repartitionByRange("backward").sortWithinPartitions("backward")
        .mapInArrow(_solve_sorted, "backward string, cost long, audit string"))
    return words.join(solved, "backward").select("conv_id", "cost", "audit")


class _Replay:
    """The edits of one conversation, row by row."""

    def __init__(self, head: dict):
        self.conv, self.audit, self.cost = head["conv_id"], head["audit"], head["cost"]
        self._at, self._state = 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self._at < len(self.audit) and self.audit[self._at] == "I":
            role = WANTED[self._state]
            self._state = AFTER[self._state]
            self._at += 1
            yield "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What the edits make of a row: turns put in before it, then the row unless it goes."""
        yield from self.inserted()
        edit = self.audit[self._at]
        self._at += 1
        if edit == "R":
            role = WANTED[self._state]
            self._state = AFTER[self._state]
        elif edit == "K":
            self._state = move(self._state, role[:1])
        if edit != "D":
            yield edit, role, text


def _with_heads(cut: DataFrame) -> DataFrame:
    """Segments by conversation in order, before them a row with the audit."""
    heads = audits(cut)
    both = cut.unionByName(heads, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("block"), "part")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Replay | None, dict | None]]:
    """(replay, None) at the start of a conversation, (replay, segment) per segment."""
    replay = None
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["block"] is None:
                replay = _Replay(row)
                yield replay, None
            else:
                yield replay, row


def _repair_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, position, edit, role, text) of the repaired conversations."""
    names = ["conv_id", "position", "edit", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), *((n, pa.string()) for n in names[2:])])
    held: list[dict] = []
    last, position = None, 0

    def put(replay: _Replay, turns: Iterator[tuple[str, str, str]]) -> None:
        nonlocal position
        for turn in turns:
            held.append(dict(zip(names, (replay.conv, position, *turn))))
            position += 1

    for replay, segment in _events(batches):
        if segment is None:
            if last is not None:
                put(last, last.inserted())
            last, position = replay, 0
            continue
        for role, text, copies in zip(segment["roles"], segment["texts"], segment["copies"]):
            for _ in range(copies):
                put(replay, replay.row(role, text))
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)
            held.clear()
    if last is not None:
        put(last, last.inserted())
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


REPORT_DDL = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string, repaired_turns long")


class _Report:
    def __init__(self, replay: _Replay):
        self._replay, self._hash, self._initial = replay, hashlib.sha256(), None
        self._turns, self._first, self._last = 0, None, None
        self.row = {"conv_id": replay.conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                    "cost": replay.cost, "audit": replay.audit, "repaired_sha256": "", "repaired_turns": 0}

    def _write(self, turns: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in turns:
            self._hash.update(f"{chr(10) if self.row['repaired_turns'] else ''}{role}:{text}".encode())
            self.row["repaired_turns"] += 1

    def add(self, segment: dict) -> None:
        for name in ("blank", "duplicate", "truncated"):
            self.row[name] += segment[name]
        self._turns += segment["turns"]
        if segment["first_turn"] is not None:
            self._first = segment["first_turn"] if self._first is None else self._first
            self._last = segment["last_turn"]
        for role, text, copies in zip(segment["roles"], segment["texts"], segment["copies"]):
            initial = role[:1]
            self.row["illegal"] += copies - 1 + (self._initial is not None and self._initial + initial not in LEGAL)
            self._initial = initial
            for _ in range(copies):
                self._write(self._replay.row(role, text))

    def close(self) -> dict:
        self._write(self._replay.inserted())
        if self._first is not None:
            self.row["gaps"] = self._last - self._first + 1 - self._turns
        return self.row | {"repaired_sha256": self._hash.hexdigest()}


def _report_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in REPORT_DDL.split(", "))])
    report, rows = None, []
    for replay, segment in _events(batches):
        if segment is not None:
            report.add(segment)
            continue
        if report is not None:
            rows.append(report.close())
        report = _Report(replay)
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if report is not None:
        rows.append(report.close())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def repair(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The repaired conversations as rows (conv_id, position, edit, role, text); ``rows`` come from ``intact`` or ``damage``."""
    prepare(rows.sparkSession)
    cut = scratch.table(segments(rows), "segments")
    return _with_heads(cut).mapInArrow(_repair_sorted, "conv_id long, position long, edit string, role string, text string")


def report(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Per conversation its faults, the cost and audit of the repair and the digest of the repaired turns."""
    prepare(rows.sparkSession)
    cut = scratch.table(segments(rows), "segments")
    return _with_heads(cut).mapInArrow(_report_sorted, REPORT_DDL)
