"""Conversations repaired by the cheapest edits: bidirectional Dijkstra over the edit lattice.

A repaired conversation's roles begin with ``s``, ``u`` and ``a`` as ``(s?(ua)+)?``: perhaps a system turn,
then user and assistant in turn, the last word with the assistant; or nothing at all. Rows may be kept
(cost 0), given the role user or assistant (3) or deleted (4), and empty user or assistant rows may be inserted
anywhere (3). Blank rows and rows seen before must go; a truncated row that stays adds 3.

- **Lattice.** A node is (rows read, state of the pattern): start, after system, after user, after assistant.
- **Search.** One heap runs from the first node, one from the accepting last nodes against the edges; the
  nearer of both advances. Once they meet, both go on while their least costs together do not pass
  the best meeting, so every node of every cheapest path is settled from one side at least, and all
  equal-cost crossings are known.
- **Choice.** Of all cheapest paths through any crossing the one with the ASCII-least audit (the edits' initials in order: ``D``,
  ``I``, ``K``, ``R``) is walked: at each step the least letter that a cheapest path can take, with all nodes
  it leads to. No cheapest audit is a prefix of another, for the rest would cost nothing; the audit fixes every
  role, for its length does.

Rows are dealt by conversation and sorted; a task streams them and holds, of the conversation at hand, one letter
and one hash a row. The texts are only streamed. The audit is one string for each conversation, so one
conversation's edits stay in one task by the nature of the result; equal patterns are solved once by a worker.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: The state after a letter, by state: 0 start, 1 after s, 2 after u, 3 after a. Start and 3 may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
BACK = tuple([(q, letter) for q in range(4) for letter, to in NEXT[q].items() if to == state] for state in range(4))
MUST_GO = "-"
ROWS_AT_ONCE = 2_000


class Lattice:
    """Edges of one conversation. ``rows`` has a letter a row: its role's initial (``x``: none of s, u, a), upper
    case if it is truncated, or ``MUST_GO``. Node 4 * i + q: i rows read, state q."""

    def __init__(self, rows: str):
        self.rows = rows
        self.start, self.ends = 0, (4 * len(rows), 4 * len(rows) + 3)

    def _over(self, row: str, letter: str) -> Iterator[tuple[int, str]]:
        """(cost, edit) of the ways in which a row can stand for a letter."""
        if row != MUST_GO:
            extra = TRUNCATED if row.isupper() else 0
            if row.lower() == letter:
                yield KEEP + extra, "K"
            if letter != "s":
                yield REROLE + extra, "R"

    def ahead(self, node: int) -> Iterator[tuple[int, str, int]]:
        i, q = divmod(node, 4)
        for letter, to in NEXT[q].items():
            if letter != "s":
                yield INSERT, "I", 4 * i + to
            if i < len(self.rows):
                for cost, edit in self._over(self.rows[i], letter):
                    yield cost, edit, 4 * i + 4 + to
        if i < len(self.rows):
            yield DELETE, "D", node + 4

    def behind(self, node: int) -> Iterator[tuple[int, str, int]]:
        i, q = divmod(node, 4)
        for start, letter in BACK[q]:
            if letter != "s":
                yield INSERT, "I", 4 * i + start
            if i:
                for cost, edit in self._over(self.rows[i - 1], letter):
                    yield cost, edit, 4 * i - 4 + start
        if i:
            yield DELETE, "D", node - 4


@lru_cache(maxsize=50_000)
def _cheapest(rows: str) -> tuple[int, str]:
    return cheapest(rows)


def cheapest(rows: str) -> tuple[int, str]:
    """(least cost, least audit of that cost) of a conversation as ``Lattice`` takes it."""
    lattice = Lattice(rows)
    edges = (lattice.ahead, lattice.behind)
    reached = ({lattice.start: 0}, dict.fromkeys(lattice.ends, 0))
    heaps = [[(0, v) for v in side] for side in reached]
    settled: tuple[dict[int, int], dict[int, int]] = ({}, {})
    best = min((0 for v in lattice.ends if v == lattice.start), default=float("inf"))
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, v = heapq.heappop(heaps[side])
        if v in settled[side]:
            continue
        settled[side][v] = cost
        for w, _, u in edges[side](v):
            if cost + w < reached[side].get(u, float("inf")):
                reached[side][u] = cost + w
                heapq.heappush(heaps[side], (cost + w, u))
                if u in reached[1 - side]:
                    best = min(best, cost + w + reached[1 - side][u])

    # The first and last nodes' distances are known even where a search ended before it took them up.
    forward, reverse = {lattice.start: 0} | settled[0], dict.fromkeys(lattice.ends, 0) | settled[1]
    # Forward nodes of cheapest paths: those at a crossing, and those that lead to them.
    todo = [v for v, cost in forward.items() if cost + reverse.get(v, best + 1) == best
            or any(cost + w + reverse.get(u, best + 1) == best for w, _, u in lattice.ahead(v))]
    leads = set(todo)
    while todo:
        v = todo.pop()
        for w, _, u in lattice.behind(v):
            if u not in leads and u in forward and forward[u] + w == forward[v]:
                leads.add(u)
                todo.append(u)

    nodes, cost, audit = {lattice.start}, 0, []
    while not (cost == best and any(v in lattice.ends for v in nodes)):
        steps = [(edit, cost + w, u) for v in nodes for w, edit, u in lattice.ahead(v)
                 if cost + w + reverse.get(u, best + 1) == best or (u in leads and forward[u] == cost + w)]
        least, cost, _ = min(steps)
        nodes = {u for edit, _, u in steps if edit == least}
        audit.append(least)
    return best, "".join(audit)


def final_roles(audit: str) -> Iterator[str | None]:
    """For each edit that leaves a row: the role it gives; None where it keeps a system row."""
    left = len(audit) - audit.count("D")
    yield from ([None] if left % 2 else [])
    for i in range(left - left % 2):
        yield "assistant" if i % 2 else "user"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped): conversations with faults set by crc32(``conv:turn``) mod 20.

    0 drops the row (it stays as a marker), 1 empties its text, 2 takes its ``[.!?]``, 3 repeats it, 4 makes its role user. A null
    key part, role or text is one space. Equal (conv, turn) are damaged alike. Other columns are left out.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(part(conv), F.lit(":"), part(turn)), "UTF-8")) % 20
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), part(role).alias("role"),
                       part(text).alias("text"), fault.alias("fault"))
    rows = rows.select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("dropped"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("print")]


def _sorted(rows: DataFrame, *first: Column) -> DataFrame:
    """Conversations whole in one task, their rows in order; rows of one turn by role and the text's hash."""
    return rows.repartition("conv").sortWithinPartitions(F.col("conv"), *first, *_order())


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv, open_ = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "print", "blank", "complete", "dropped")]
        for key, turn, role, text, blank, complete, dropped in zip(*columns):
            if open_ is None or key != conv:
                if open_ is not None:
                    out.append((conv, *open_.report()))
                conv, open_ = key, _Open()
            if not dropped:
                open_.add(turn, role, text, blank, complete)
            if len(out) >= ROWS_AT_ONCE:
                yield _batch(out, batch.schema.field("conv").type)
                out = []
        kind = batch.schema.field("conv").type
    if open_ is not None:
        yield _batch([*out, (conv, *open_.report())], kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [kind, *[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class _Open:
    """The conversation that a task is reading."""

    def __init__(self):
        self.letters, self.seen, self.before = [], set(), None
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, complete: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        row = hashlib.blake2b(f"{text}{role}".encode(), digest_size=16).digest()
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if blank:
            self.blank, letter = self.blank + 1, MUST_GO
        elif row in self.seen:
            self.duplicate, letter = self.duplicate + 1, MUST_GO
        elif not complete:
            self.truncated, letter = self.truncated + 1, letter.upper()
        self.seen.add(row)
        self.letters.append(letter)

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        rows = "".join(self.letters)
        cost, audit = _cheapest(rows) if len(rows) <= 200 else cheapest(rows)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _printed(rows: DataFrame) -> DataFrame:
    """Rows with the hash of their text (``print``); without their own rows' order nothing else is added."""
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    return rows.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), "dropped").withColumn("print", F.md5("text"))


def plan(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation of ``rows``.

    ``rows`` are (conv, turn, role, text), and dropped where rows are markers of a conversation only. Rows are taken
    by turn, nulls first; those of one turn by role and the md5 of their text. A row's first fault counts: blank (no character but ASCII
    white space), duplicate (role and text seen before), truncated (its last such character is not ``.``, ``!`` or ``?``).
    A null role or text is one space. A null conv is a conversation of its own. A conversation without
    rows has zeros and an empty audit; an empty table gives none. Any other columns are ignored.
    """
    rows = _printed(rows)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select("conv", "turn", "role", "print", (bare == "").alias("blank"),
                       F.substring(bare, -1, 1).isin(".", "!", "?").alias("complete"), "dropped")
    return _sorted(slim).mapInArrow(_reports, f"conv {rows.schema['conv'].dataType.simpleString()}, {REPORT}")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(conv, place, edit, role, text) of every row that stays or comes in, in order, in lists by batch.

    Before a conversation's rows comes its audit. A conversation's end is (conv, -1, None, None, None).
    """
    conv, audit, at, place, roles = None, None, 0, 0, iter(())
    out: list[tuple] = []

    def inserted(end: bool) -> None:
        nonlocal at, place
        while audit is not None and audit[at:at + 1] == "I":
            out.append((conv, place, "I", next(roles), ""))
            at, place = at + 1, place + 1
        if end and audit is not None:
            out.append((conv, -1, None, None, None))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text")]
        for key, plan_, role, text in zip(*columns):
            if plan_ is not None:
                inserted(end=True)
                conv, audit, at, place, roles = key, plan_, 0, 0, final_roles(plan_)
                continue
            inserted(end=False)
            edit, at = audit[at], at + 1
            if edit != "D":
                given = next(roles)
                out.append((conv, place, edit, role if edit == "K" else given, text))
                place += 1
        yield out
        out = []
    inserted(end=True)
    yield out


def _with_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Every conversation's audit and behind it its rows, in order, whole in one task."""
    rows = _printed(rows).where(~F.col("dropped")).select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "print")
    none = F.lit(None).cast("string")
    audits = plans.select("conv", "audit", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), none.alias("print"))
    return _sorted(rows.unionByName(audits), F.col("audit").isNull()).select("conv", "audit", "role", "text")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the rows of the repaired conversations, ``place`` from 0.

    ``edit`` is K, R or I. Inserted rows have an empty text. ``plans`` is what ``plan`` gives for ``rows``.
    """
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal arrow
            for b in batches:
                arrow = b.schema.field("conv").type
                yield b

        for part in _edited(typed()):
            if part := [r for r in part if r[1] >= 0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*part), (arrow, pa.int64(), pa.string(), pa.string(), pa.string()))],
                    names=["conv", "place", "edit", "role", "text"])

    return _with_plans(rows, plans).mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, sha256): of the lines ``role:text`` of each repaired conversation, joined by line feeds."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, hashed, out = None, hashlib.sha256(), []

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal arrow
            for b in batches:
                arrow = b.schema.field("conv").type
                yield b

        for part in _edited(typed()):
            for conv, place, _, role, text in part:
                if place < 0:
                    out.append((conv, hashed.hexdigest()))
                    hashed = hashlib.sha256()
                else:
                    hashed.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (arrow, pa.string()))],
                                                 names=["conv", "sha256"])
                out = []

    return _with_plans(rows, plans).mapInArrow(run, f"conv {kind}, sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """The columns of ``plan`` and ``sha256`` of the repaired rows, for every conversation of ``rows``."""
    plans = stage(plan(rows), "repair-plans")
    found = digests(rows, plans).withColumnRenamed("conv", "__conv")
    return plans.join(found, F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv")
