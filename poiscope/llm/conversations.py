"""Repair of conversations: the cheapest edits that give alternating turns, by a lightest-derivation agenda.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`. An item (i, state) says that the first
i rows can be edited into a sequence that leaves the form in that state. Deductions lead from item to item by one
edit: K keeps a row, R gives it the role wanted, D deletes it, I inserts an empty turn. An item's value is its cost
and its audit, the edits' initials in order. Adding an edit never makes a value smaller, and keeps the order of two
values of one item (audits of equal cost of one item never begin one another, as insertions cost). These are superior
functions, so items popped from an agenda in the order of (cost, audit) are final, and so is the goal.

A task reads its conversations as a stream sorted by turn. A long conversation passes through the agenda in
segments: the items at a segment's end are the axioms of the next, each with the digest of what it leaves so far.
Items that can no longer win (another state is ahead by more than any ending can make up) go, and so at most four
remain. Memory holds the rows of a segment and one letter per edit. A digest is by nature a sequential pass of one
task. Rows that repeat an earlier one are marked beforehand by a join on digests; no task remembers what it has seen.

Defined results: null roles and texts count as one space, null turns come first, rows without conversation id form
one conversation. Rows of one turn come by role, then by the digest of role and text. An empty role fits nowhere and is
never kept. A conversation that loses all rows has zeros, an empty audit and the digest of the empty string. An empty
table gives an empty result. Only the four columns are read; no other column name matters.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os.path
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SEGMENT = 256
REMEMBERED = 100_000
ROWS = 500

# White space, what may end a text, costs, roles by initial.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}

# States of the form: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: What is wanted in each state, and the state after it; a system's turn may only come first.
WANTED = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
KEPT = {(START, "s"): SYSTEM, **{(state, role): after for state, (role, after) in WANTED.items()}}
#: The most by which an ending from the first state can be dearer than the same ending from the second.
LEAD = {
    (ASSISTANT, START): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT,
    (USER, START): INSERT + DELETE, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
}

Value = tuple[int, str]


def lightest(rows: str, axioms: dict[int, Value], last: bool) -> dict[int, tuple[int, str, int]]:
    """Final values of the items after the rows, by state, and the axiom each comes from; with `last`, only the goal's.

    A row is a letter: its role's initial, or x; in capitals if truncated; d if it must go.
    """
    agenda = [(cost, audit, 0, state, state) for state, (cost, audit) in axioms.items()]
    heapq.heapify(agenda)
    final, ends, n, limit = set(), {}, len(rows), None
    while agenda:
        cost, audit, i, state, axiom = heapq.heappop(agenda)
        if limit is not None and cost > limit:
            break
        if (i, state) in final:
            continue
        final.add((i, state))
        wanted, after = WANTED[state]
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, after, axiom))
        if i == n:
            if last and state in ACCEPTED:
                return {state: (cost, audit, axiom)}
            ends[state] = cost, audit, axiom
            if limit is None:
                limit = cost + INSERT + DELETE
            continue
        row = rows[i]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state, axiom))
        if row != "d":
            role = row.lower()
            more = cost + TRUNCATED * (row != role)
            heapq.heappush(agenda, (more + REROLE, audit + "R", i + 1, after, axiom))
            if (state, role) in KEPT:
                heapq.heappush(agenda, (more, audit + "K", i + 1, KEPT[state, role], axiom))
    return {s: v for s, v in ends.items() if not any(v[0] > ends[t][0] + lead for (t, u), lead in LEAD.items() if u == s and t in ends)}


class Track:
    """What edits leave of a conversation: the state of the form and the digest of `role:text` lines."""

    def __init__(self):
        self.state, self.digest, self.any = START, hashlib.sha256(), False

    def after(self, edits: str, rows: list[tuple[str, str]], tell: Callable[[str, str, str], None] | None = None) -> Track:
        """The track after further edits of rows, some of which may be left over."""
        new, left = Track(), iter(rows)
        new.state, new.digest, new.any = self.state, self.digest.copy(), self.any
        for edit in edits:
            role, text = ("", "") if edit == "I" else next(left)
            if edit == "K":
                new.state = KEPT[new.state, role[0]]
            elif edit != "D":
                wanted, new.state = WANTED[new.state]
                role = ROLES[wanted]
            if edit != "D":
                new.digest.update(f"{chr(10) * new.any}{role}:{text}".encode())
                new.any = True
            if tell:
                tell(edit, role, text)
        return new


class Repair:
    """One conversation, row by row. `tell` gets every edit with the role and text it leaves, once no item disputes it;
    only for it are rows in dispute held."""

    whole: dict[str, tuple[int, str, int]] = {}

    def __init__(self, tell: Callable[[str, str, str], None] | None = None):
        self.tell = tell
        self.rows: list[tuple[str, str]] = []
        self.letters: list[str] = []
        self.items: dict[int, Value] = {START: (0, "")}
        self.tracks = {START: Track()}
        self.settled: list[str] = []
        self.held: list[tuple[str, str]] = []
        self.told = Track()

    def add(self, letter: str, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.letters.append(letter)
        if len(self.rows) >= SEGMENT:
            self._advance(False)

    def close(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the whole."""
        self._advance(True)
        (cost, _), = self.items.values()
        (track,) = self.tracks.values()
        return cost, "".join(self.settled), track.digest.hexdigest()

    def _advance(self, last: bool) -> None:
        key = "".join(self.letters)
        if last and not self.settled and len(key) < 40:  # short conversations often have the same faults
            if key not in self.whole:
                if len(self.whole) > REMEMBERED:
                    self.whole.clear()
                self.whole[key] = next(iter(lightest(key, self.items, True).values()))
            ends = {START: self.whole[key]}
        else:
            ends = lightest(key, self.items, last)
        self.tracks = {
            s: self.tracks[axiom].after(audit[len(self.items[axiom][1]) :], self.rows) for s, (_, audit, axiom) in ends.items()
        }
        sure = os.path.commonprefix([audit for _, audit, _ in ends.values()])
        self.items = {s: (cost, audit[len(sure) :]) for s, (cost, audit, _) in ends.items()}
        self.settled.append(sure)
        if self.tell:
            self.held += self.rows
            self.told = self.told.after(sure, self.held, self.tell)
            del self.held[: len(sure) - sure.count("I")]
        self.rows, self.letters = [], []


def fault_of(text: str, repeated: bool) -> str:
    """First fault of a row: blank, duplicate, truncated, or none."""
    said = text.rstrip(SPACE)
    if not said:
        return "blank"
    if repeated:
        return "duplicate"
    return "" if said[-1] in ENDS else "truncated"


def letter_of(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "d"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return letter.upper() if fault else letter


class Report:
    """What is counted of one conversation."""

    def __init__(self, tell: Callable[[str, str, str], None] | None = None):
        self.low = self.high = self.turn = None
        self.distinct = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.before: tuple | None = None
        self.marked: tuple | None = None
        self.initial: str | None = None
        self.repair = Repair(tell)

    def add(self, turn: int | None, role: str, text: str, digest: bytes) -> None:
        if turn is not None and (self.low is None or turn != self.turn):
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turn, self.distinct = turn, self.distinct + 1
        here = (turn, digest)
        fault = fault_of(text, here == self.before or here == self.marked)
        self.before = here
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.repair.add(letter_of(role, fault), role, text)

    def close(self) -> dict:
        cost, audit, digest = self.repair.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


REPORTED = [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
REPORTED += [("audit", pa.string()), ("repaired_sha256", pa.string())]
# Kinds of rows in a stream: a conversation is there, the row that follows repeats an earlier one, a row.
PRESENT, REPEATS, ROW = range(3)


def _told(batches: Iterator[pa.RecordBatch], schema: pa.Schema, begin: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Passes a stream of rows through a report per conversation; `begin` and `end` put what is told into a list."""
    at, report, done = None, None, []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            for conv, turn, role, digest, kind, text in zip(*(c.to_pylist() for c in whole.slice(k, ROWS).columns)):
                if report is None or conv != at:
                    if report is not None:
                        end(at, report, done)
                    at, report = conv, begin(conv, done)
                if kind == REPEATS:
                    report.marked = (turn, digest)
                elif kind == ROW:
                    report.add(turn, role, text, digest)
            if len(done) >= ROWS:
                yield packed()
                done.clear()
    if report is not None:
        end(at, report, done)
    yield packed()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def end(conv: int | None, report: Report, done: list) -> None:
        done.append((conv, *report.close().values()))

    return _told(batches, pa.schema([("conv", pa.int64()), *REPORTED]), lambda conv, done: Report(), end)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def begin(conv: int | None, done: list) -> Report:
        places = itertools.count()
        return Report(lambda edit, role, text: done.append((conv, next(places), edit, role, text)))

    schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _told(batches, schema, begin, lambda conv, report, done: report.close())


def _columns(conversations: DataFrame, names: dict[str, str] | None) -> DataFrame:
    """(conv, turn, role, text) of a table."""
    names = {c: c for c in ("conv_id", "turn", "role", "text")} | (names or {})
    space = F.lit(" ")
    return conversations.select(
        F.col(names["conv_id"]).cast("long").alias("conv"),
        F.col(names["turn"]).cast("long").alias("turn"),
        F.coalesce(F.col(names["role"]), space).alias("role"),
        F.coalesce(F.col(names["text"]), space).alias("text"),
    )


def damaged(conversations: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(conv, turn, role, text) with faults put in by a checksum of `conv:turn`; a dropped row leaves a null role.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    rows = _columns(conversations, names)
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    rows = rows.withColumn("fault", F.crc32(key) % 20)
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").when(fault != 0, F.col("role"))
    times = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def _stream(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) in order within their conversation, marks before those that repeat earlier ones."""
    there = F.col("role").isNotNull()
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    marked = rows.withColumn("digest", F.when(there, digest))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("when")
    said = marked.filter(there).select("conv", "digest", when, "role").distinct()
    first = said.groupBy(F.col("conv").alias("in"), F.col("digest").alias("of")).agg(
        F.min("when").alias("first"), F.max("when").alias("end")
    )
    again = said.join(first.filter("first < end"), F.col("conv").eqNullSafe(F.col("in")) & (F.col("digest") == F.col("of")))
    repeats = again.filter("when > first").select(
        "conv", F.col("when.turn").alias("turn"), "role", "digest", F.lit(REPEATS).alias("kind"), F.lit(None).cast("string").alias("text")
    )
    everything = marked.select(
        "conv", "turn", "role", "digest", F.when(there, ROW).otherwise(PRESENT).alias("kind"), F.when(there, F.col("text")).alias("text")
    ).unionByName(repeats)
    return everything.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind")


def repair_reports(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv, turn, role, text): faults, cost, audit, digest of what is repaired."""
    kinds = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in REPORTED)
    return _stream(rows).mapInArrow(_reports, f"conv long, {kinds}")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): every edit in order, with the role and text it leaves; D shows what goes."""
    return _stream(rows).mapInArrow(_edits, "conv long, place long, edit string, role string, text string")
