"""Repair of conversation structure by a cheapest edit script.

A conversation's rows, by turn, become role initials ``(s?(ua)+)?``: a row is kept, given
the role user or assistant, or deleted, and rows with an empty text may be inserted. The
edit lattice has a node for each number of rows consumed and each state of that expression.
It is searched from both ends: a forward and a reverse heap settle nodes until no cheaper
or equally cheap path can be open, all crossings of the least cost are finished, and of
those the one with the least concatenated audit (the edits' initials) is taken.

Long conversations are cut: rows are dealt by ranges of (conversation, turn), so that a
conversation of any length is spread over many tasks. A stretch of rows is solved from each
entry state to each exit state; inserts stand before a row, never after a stretch, so that
no audit of a stretch is the beginning of another and audits of stretches can be compared by
rank. Stretches at the borders of tasks, at most two a task, are composed per conversation
from costs and ranks alone.

Faults, the first that holds: blank (no character but ASCII blanks), duplicate (role and text
stand in an earlier row of the conversation), truncated (the last other character is none of
``.!?``). Blank and duplicate rows have to be deleted; an undeleted truncated row costs more.

Defined results: null roles and texts are one space; null turns come first; equal turns are
ordered by role, then text; repeated rows are rows of their own (the later ones duplicates);
rows with a null id form one conversation; an empty table gives empty results; columns are
selected by name, others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import arrow_map, importable, written

EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Costs of the edits.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
_INITIALS = "sua"
#: Where a row of each initial may stand, and what follows it.
_KEEP = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_NEXT = (USER, USER, ASSISTANT, USER)
#: What ends a conversation from each state: letters of inserts, or None where nothing has to follow.
_TAIL = ("", "II", "I", "")
_STRETCH = 256
_FAR = 1 << 60


def code(initial: str, fault: int) -> int:
    """A row as the search sees it: its role's initial (0 for any other) and its first fault."""
    return 4 * fault + 1 + _INITIALS.find(initial) if initial else 4 * fault


@functools.cache
def _moves(row: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of such a row: letter, cost, next state."""
    initial, fault = " sua"[row % 4], row // 4
    out = []
    for state in STATES:
        edits = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            more = LEFT_TRUNCATED if fault == TRUNCATED else 0
            if (initial, state) in _KEEP:
                edits.append(("K", more, _KEEP[initial, state]))
            edits.append(("R", REROLE + more, _NEXT[state]))
        out.append(edits)
    return out


@functools.cache
def _moves_back(row: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of such a row that lead to it: letter, cost, state before."""
    out = [[] for _ in STATES]
    for state, edits in enumerate(_moves(row)):
        for letter, cost, to in edits:
            out[to].append((letter, cost, state))
    return out


_BEFORE = [[s for s in STATES if _NEXT[s] == to] for to in STATES]


class _Front:
    """One direction of the search: labels (cost, audit) of nodes, final once settled. Nodes of equal cost
    are settled in the order in which edits without cost lead from one to the next."""

    def __init__(self, sources: list[tuple[int, int]], step: int):
        self.step, self.labels, self.settled = step, {s: (0, "") for s in sources}, set()
        self.heap = [(0, step * i, state) for i, state in sources]
        heapq.heapify(self.heap)

    def top(self) -> int:
        while self.heap and (self.step * self.heap[0][1], self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else _FAR

    def settle(self) -> tuple[int, int]:
        self.top()
        _, i, state = heapq.heappop(self.heap)
        node = (self.step * i, state)
        self.settled.add(node)
        return node

    def relax(self, node: tuple[int, int], cost: int, audit: str) -> None:
        old = self.labels.get(node)
        if old is None or (cost, audit) < old:
            if old is None or cost < old[0]:
                heapq.heappush(self.heap, (cost, self.step * node[0], node[1]))
            self.labels[node] = (cost, audit)


@functools.lru_cache(maxsize=1 << 16)
def cheapest(rows: bytes, start: int, ends: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits of ``rows`` (codes) from state ``start`` to one of ``ends``;
    None if there are none. ``tail``: rows may be inserted after the last one too."""
    n = len(rows)

    def edits(i: int, state: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
        if i < n or tail:
            yield "I", INSERT, (i, _NEXT[state])
        if i < n:
            for letter, cost, to in _moves(rows[i])[state]:
                yield letter, cost, (i + 1, to)

    def edits_back(i: int, state: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
        if i < n or tail:
            for before in _BEFORE[state]:
                yield "I", INSERT, (i, before)
        if i > 0:
            for letter, cost, before in _moves_back(rows[i - 1])[state]:
                yield letter, cost, (i - 1, before)

    ahead, back = _Front([(0, start)], 1), _Front([(n, e) for e in ends], -1)
    least = _FAR
    first = True
    while first or ahead.top() + back.top() <= least < _FAR or (least == _FAR and ahead.top() < _FAR and back.top() < _FAR):
        for front, other, of in ((ahead, back, edits), (back, ahead, edits_back)):
            if front.top() == _FAR or (not first and front.top() > other.top()):
                continue
            node = front.settle()
            cost, audit = front.labels[node]
            if node in other.labels:
                least = min(least, cost + other.labels[node][0])
            for letter, more, to in of(*node):
                if to not in front.settled:
                    front.relax(to, cost + more, audit + letter if front is ahead else letter + audit)
        first = False
    best = None
    for node in ahead.settled:
        cost, audit = ahead.labels[node]
        found = [(cost + back.labels[node][0], audit + back.labels[node][1])] if node in back.settled else []
        for letter, more, to in edits(*node):
            if to in back.settled:
                rest = back.labels[to]
                found.append((cost + more + rest[0], audit + letter + rest[1]))
        for f in found:
            if best is None or f < best:
                best = f
    return best


def _matrix(rows: bytes) -> list[tuple[int, str] | None]:
    """Cost and audit of a stretch from each entry state to each exit state."""
    return [cheapest(rows, a, (b,), False) for a in STATES for b in STATES]


def _ranks(matrix: list[tuple[int, str] | None]) -> list[int]:
    order = {a: k for k, a in enumerate(sorted({m[1] for m in matrix if m}))}
    return [order[m[1]] if m else -1 for m in matrix]


def fold(parts: list[tuple[list[int], list[int]]], start: int) -> dict[int, tuple[int, list[int]]]:
    """Over stretches in order, given the costs (-1: no way) and audits' ranks of each: per state reached from
    ``start``, the cost and the states after each stretch of the cheapest way with the least audit."""
    held = {start: (0, 0)}  # state: cost, rank among the audits so far
    back = []
    for costs, ranks in parts:
        found = {}
        for a, (cost, rank) in held.items():
            for b in STATES:
                if costs[4 * a + b] >= 0:
                    label = (cost + costs[4 * a + b], (rank, ranks[4 * a + b]), a)
                    if b not in found or label < found[b]:
                        found[b] = label
        order = {r: k for k, r in enumerate(sorted({x[1] for x in found.values()}))}
        held = {b: (cost, order[r]) for b, (cost, r, _) in found.items()}
        back.append({b: a for b, (_, _, a) in found.items()})
    out = {}
    for b, (cost, _) in held.items():
        states, at = [], b
        for step in reversed(back):
            states.append(at)
            at = step[at]
        out[b] = (cost, states[::-1])
    return out


def ended(ways: dict[int, tuple[int, list[int]]], audits: dict[int, object]) -> int:
    """The state whose way is the cheapest to an end; ties by ``audits``, which order the ways."""
    return min(ways, key=lambda b: (ways[b][0] + INSERT * len(_TAIL[b]), audits[b]))


def solve(rows: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if len(rows) <= _STRETCH:
        return cheapest(rows, EMPTY, (EMPTY, ASSISTANT), True)
    matrix = composed(rows)[:4]
    return min((m[0] + INSERT * len(_TAIL[b]), m[1] + _TAIL[b]) for b, m in enumerate(matrix) if m)


def composed(rows: bytes) -> list[tuple[int, str] | None]:
    """``_matrix`` of any number of rows, by stretches."""
    pieces = [_matrix(rows[k : k + _STRETCH]) for k in range(0, len(rows), _STRETCH)]
    if len(pieces) == 1:
        return pieces[0]
    parts = [([m[0] if m else -1 for m in p], _ranks(p)) for p in pieces]
    out = []
    for a in STATES:
        ways = fold(parts, a)
        for b in STATES:
            if b not in ways:
                out.append(None)
                continue
            cost, states = ways[b]
            out.append((cost, "".join(p[4 * x + y][1] for p, x, y in zip(pieces, [a, *states], states, strict=False))))
    return out


def applied(rows: bytes, start: int, audit: str) -> Iterator[tuple[int, int, str, str | None]]:
    """Per edit: number of the row it stands at (inserts: the row before which they stand, or the last one), its
    place there, its letter, and the role's initial that it leaves (None: deleted)."""
    i, place, state = 0, 0, start
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
        else:
            state = next(to for x, _, to in _moves(rows[i])[state] if x == letter)
        yield min(i, len(rows) - 1), place, letter, None if letter == "D" else "?sua"[state]
        place += 1
        if letter != "I":
            i += 1
            place = place if i == len(rows) else 0


def illegal(initials: str) -> int:
    """Neighbours that do not follow each other."""
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


# Spark -------------------------------------------------------------------------
_BLANKS = r"\x20\x09-\x0D"


def _placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows in order (``at``), written, with what the search needs of their texts. Rows are dealt by
    ranges: a long conversation lies in several of them."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    # Range bounds hold the beginning of a text only: whole ones would go to the driver.
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 100)).sortWithinPartitions(*order, "text")
    fault = F.when(~F.col("text").rlike(f"[^{_BLANKS}]"), BLANK).when(~F.col("text").rlike(rf"[.!?][{_BLANKS}]*\z"), TRUNCATED).otherwise(CLEAN)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return written(dealt.select(F.monotonically_increasing_id().alias("at"), "*", fault.cast("int").alias("fault"), F.unhex(same).alias("same")), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """``(at, conv, initial, fault)``: rows that are not the first of their role and text are duplicates."""
    firsts = rows.filter(F.col("fault") != BLANK).groupBy("conv", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    found = rows.select("at", "conv", F.substring("role", 1, 1).alias("initial"), "fault").join(firsts, "at", "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    return found.select("at", "conv", "initial", fault.alias("fault"))


def _stretches(rows: DataFrame) -> DataFrame:
    """A row for each conversation, or for what a task has of it: rows' numbers and codes, whether it may go on in
    another task; solved, or with costs and audits from each state to each state. Written."""
    conv = rows.schema["conv"].dataType.simpleString()
    schema = (f"conv {conv}, at array<long>, rows binary, open boolean, cost long, audit string, illegal long, first string, last string, "
              "costs array<long>, ranks array<int>, audits array<string>")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for b in batches:
            for at, conv, initial, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        yield now
                    now = (conv, [], bytearray(), [])
                now[1].append(at)
                now[2].append(code(initial, fault))
                now[3].append(initial or " ")
        if now is not None:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema.field(1).type]
                yield b

        def batch(out: list[tuple]) -> pa.RecordBatch:
            types = [kinds[0], pa.list_(pa.int64()), pa.binary(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(),
                     pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
            names = ["conv", "at", "rows", "open", "cost", "audit", "illegal", "first", "last", "costs", "ranks", "audits"]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

        def row(one: tuple, is_open: bool) -> tuple:
            conv, at, codes, initials = one
            codes, line = bytes(codes), "".join(initials)
            head = (conv, at, codes, is_open)
            if not is_open:
                return (*head, *solve(codes), illegal(line), None, None, None, None, None)
            m = composed(codes)
            return (*head, None, None, illegal(line), line[0], line[-1], [x[0] if x else -1 for x in m], _ranks(m), [x[1] if x else None for x in m])

        out, held, size, is_first = [], None, 0, True
        for one in runs(seen()):
            if held is not None:
                out.append(row(held, is_first))
                is_first, size = False, size + len(held[1])
            held = one
            if size >= 1 << 14:
                yield batch(out)
                out, size = [], 0
        if held is not None:
            out.append(row(held, True))
            yield batch(out)

    dealt = rows.repartitionByRange("at").sortWithinPartitions("at")
    return written(arrow_map(dealt.select("at", "conv", "initial", "fault"), run, schema), "stretches")


def _chosen(stretches: DataFrame) -> DataFrame:
    """The stretches of conversations that may lie in several tasks, each with its state of entry and its audit.
    A group is of two rows a task at most, without texts or audits."""
    conv = stretches.schema["conv"].dataType.simpleString()
    parts = stretches.filter("open").select("conv", F.get("at", F.lit(0)).alias("start"), "first", "last", "costs", "ranks")
    importable(stretches.sparkSession)

    def choose(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start")
        parts = list(zip(rows.column("costs").to_pylist(), rows.column("ranks").to_pylist(), strict=True))
        first, last = rows.column("first").to_pylist(), rows.column("last").to_pylist()
        ways = fold(parts, EMPTY)
        audits = {b: [r[4 * x + y] for (_, r), x, y in zip(parts, [EMPTY, *states], states, strict=False)] for b, (_, states) in ways.items()}
        end = ended(ways, audits)
        cost, states = ways[end]
        n = len(parts)
        entries = [EMPTY, *states[:-1]]
        return pa.table({
            "start": rows.column("start"), "entry": pa.array(entries, pa.int32()), "exit": pa.array(states, pa.int32()),
            "tail": pa.array([""] * (n - 1) + [_TAIL[end]], pa.string()),
            "cost": pa.array([cost + INSERT * len(_TAIL[end])] + [0] * (n - 1), pa.int64()),
            "joints": pa.array([0] + [illegal(a + b) for a, b in zip(last, first[1:], strict=False)], pa.int64())})

    picked = parts.groupBy("conv").applyInArrow(choose, "start long, entry int, exit int, tail string, cost long, joints long")
    whole = stretches.filter("open").withColumn("start", F.get("at", F.lit(0))).drop("cost").join(picked, "start")
    audit = F.concat(F.get("audits", 4 * F.col("entry") + F.col("exit")), "tail")
    return whole.select(F.col("conv").cast(conv), "at", "rows", "entry", "cost", audit.alias("audit"), (F.col("illegal") + F.col("joints")).alias("illegal"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(report, repaired)``.

    The report has a row for each conversation: ``conv``, ``gaps`` (missing turn numbers), ``blank``,
    ``duplicate``, ``truncated``, ``illegal`` (neighbours that do not follow each other), ``cost``, ``audit``.
    The repaired rows are ``(conv, at, place, turn, edit, role, text)``, in order of ``at`` and ``place``; an
    inserted row has a null turn.
    """
    rows = _placed(turns, conv_col, turn_col, role_col, text_col)
    faults = written(_faults(rows), "faults")
    stretches = _stretches(faults)
    closed = stretches.filter("not open").select("conv", "at", "rows", F.lit(EMPTY).alias("entry"), "cost", "audit", "illegal")
    solved = written(closed.unionByName(_chosen(stretches)), "solved")

    def number(fault: int, name: str) -> Column:
        return F.count_if(F.col("fault") == fault).alias(name)

    counted = faults.groupBy("conv").agg(number(BLANK, "blank"), number(DUPLICATE, "duplicate"), number(TRUNCATED, "truncated"))
    spread = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0).cast("long")).alias("gaps"))
    pieces = F.array_sort(F.collect_list(F.struct(F.get("at", F.lit(0)).alias("start"), "audit")))
    edits = solved.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    report = spread
    for side in (counted, edits):
        other = side.withColumnRenamed("conv", "conv_")
        report = report.join(other, report["conv"].eqNullSafe(other["conv_"])).drop("conv_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ats, codes, entry, audit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = list(applied(codes, entry, audit))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ats[i] for i, *_ in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string()),
                     pa.array([x[3] for x in out], pa.string())], ["at", "place", "edit", "becomes"])

    script = arrow_map(solved.select("at", "rows", "entry", "audit"), run, "at long, place int, edit string, becomes string").filter("edit != 'D'")
    inserted, name = F.col("edit") == "I", F.when(F.col("becomes") == "u", "user").otherwise("assistant")
    repaired = rows.select("at", "conv", "turn", "role", "text").join(script, "at").select(
        "conv", "at", "place", F.when(~inserted, F.col("turn")).alias("turn"), "edit",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(name).alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"))
    return report.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), repaired


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` of the repaired ``role:text`` joined by line ends. A digest takes its bytes in
    order: each conversation's rows pass through one task, sorted, and none are held there."""
    schema = f"conv {repaired.schema['conv'].dataType.simpleString()}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                line = f"{role}:{text}".encode()
                if state is not None and conv == now:
                    state.update(b"\n" + line)
                    continue
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state, kind = conv, hashlib.sha256(line), b.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field(0).type), pa.array([x[1] for x in out], pa.string())], ["conv", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], ["conv", "repaired_sha256"])

    rows = repaired.select("conv", "at", "place", "role", "text").repartition("conv").sortWithinPartitions("conv", "at", "place")
    return arrow_map(rows.select("conv", "role", "text"), run, schema)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The faults that the registered query plants, by crc32 of ``conversation:turn`` modulo 20: 0 drops the row,
    1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(conv_col), F.col(turn_col), text(role_col).alias(role_col), text(text_col).alias(text_col), kind.alias("kind_")).filter("kind_ != 0")
    rows = rows.withColumns({
        text_col: F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col)),
        role_col: F.when(F.col("kind_") == 4, "user").otherwise(F.col(role_col))})
    return rows.select(conv_col, turn_col, role_col, text_col, F.explode(F.sequence(F.lit(1), F.when(F.col("kind_") == 3, 2).otherwise(1))).alias("copy_")).drop("copy_")
