"""Cheapest repair of conversations to ``(system? (user assistant)+)?``, by Viterbi with survivors that coalesce.

Four states say which role may come next; a step takes one row and may insert rows before it. Of all ways to a state the
cheapest survives, of equally cheap ones the one whose letters come first. Survivors that began alike share their letters
in a tree whose nodes count the branches behind them: a branch without survivors is cut off, and what all survivors share
is emitted and forgotten. A survivor also ends once another can do whatever it may still do at a lower total. Unresolved
rows cost a byte for each survivor that disagrees, never their text.

Ties are settled by the complete unresolved letters. Every step ends in a letter other than I, so letters of two survivors
that took the same rows differ somewhere, neither begins the other, and what follows cannot change their order. It is
enough to keep the survivors' ranks: the order after a step is that of (rank before, letters of the step).

Spark sorts the rows of a conversation; three passes stream through them: one decides and hands on each row with the
edits of its chunk, one applies the edits after a second sort has put them before the rows, one sums up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import in_workers, pick

BLANKS = " \t\n\x0b\x0c\r"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What may come next in a state: start; after system; after user; after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Inserts that end a conversation in a state.
ENDS = {START: b"", SYSTEM: b"II", USER: b"I", ASSISTANT: b""}
#: DEARER[y][x]: what a survivor in state y pays at most to do all that one in state x may still do.
DEARER = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
#: Rows whose edits travel as one record.
CHUNK = 4096


def steps(initial: str, fault: int) -> list[list[tuple[int, int, bytes]]]:
    """For every new state: (old state, cost, letters) of the cheapest ways to take a row."""
    ways: dict[tuple[int, int], tuple[int, bytes]] = {}

    def offer(old: int, new: int, cost: int, letters: bytes) -> None:
        ways[old, new] = min(ways.get((old, new), (cost, letters)), (cost, letters))

    extra = UNFINISHED if fault == TRUNCATED else 0
    for old in range(4):
        state = old
        for inserts in range(3):
            before, cost = b"I" * inserts, INSERT * inserts
            offer(old, state, cost + DELETE, before + b"D")
            if fault in (NO_FAULT, TRUNCATED):
                if (kept := KEEPS.get((initial, state))) is not None:
                    offer(old, kept, cost + KEEP + extra, before + b"K")
                offer(old, NEXT[state], cost + REROLE + extra, before + b"R")
            state = NEXT[state]
    return [[(old, *ways[old, new]) for old in range(4) if (old, new) in ways] for new in range(4)]


STEPS = {(initial, fault): steps(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}


class Node:
    """Letters shared by all survivors behind it; a leaf belongs to one survivor."""

    __slots__ = ("parent", "letters", "branches")

    def __init__(self, parent: Node | None, letters: bytes = b""):
        self.parent, self.letters, self.branches = parent, bytearray(letters), []


class Survivors:
    """The decisions on one conversation, row by row."""

    def __init__(self):
        self.root = Node(None)
        self.nodes: list[Node | None] = [self.root, None, None, None]
        self.costs = [0, 0, 0, 0]
        self.ranks = [0, 0, 0, 0]

    def step(self, initial: str, fault: int) -> bytes:
        """Take a row; the letters now certain, perhaps none."""
        found: list[tuple[int, int, bytes, int, int] | None] = []
        for ways in STEPS[initial if initial in ("s", "u", "a") else "", fault]:
            best = None
            for old, cost, letters in ways:
                if self.nodes[old] is not None:
                    way = (self.costs[old] + cost, self.ranks[old], letters, old)
                    if best is None or way < best:
                        best = way
            found.append(best)
        alive = [x for x in range(4) if found[x] is not None]
        alive = [x for x in alive if not any(found[y][0] + DEARER[y][x] < found[x][0] for y in alive)]
        grown: dict[int, list[int]] = {}
        for x in alive:
            grown.setdefault(found[x][3], []).append(x)
        order = sorted(alive, key=lambda x: found[x][1:3])
        nodes: list[Node | None] = [None] * 4
        for old, node in enumerate(self.nodes):
            if node is None:
                continue
            heirs = grown.get(old, [])
            if len(heirs) == 1:
                node.letters += found[heirs[0]][2]
                nodes[heirs[0]] = node
            for x in heirs if len(heirs) > 1 else ():
                nodes[x] = Node(node, found[x][2])
                node.branches.append(nodes[x])
        for old, node in enumerate(self.nodes):
            if node is not None and old not in grown:
                self.cut(node)
        self.nodes = nodes
        self.costs = [found[x][0] if nodes[x] is not None else 0 for x in range(4)]
        self.ranks = [order.index(x) if nodes[x] is not None else 0 for x in range(4)]
        return self.agreed()

    def cut(self, leaf: Node) -> None:
        """Remove a survivor's branch; a node left with one branch joins it."""
        parent = leaf.parent
        if parent is None:
            return
        parent.branches.remove(leaf)
        if len(parent.branches) == 1 and parent.parent is not None:
            heir = parent.branches[0]
            parent.letters += heir.letters
            heir.letters, heir.parent = parent.letters, parent.parent
            siblings = parent.parent.branches
            siblings[siblings.index(parent)] = heir

    def agreed(self) -> bytes:
        out = b""
        while len(self.root.branches) == 1:
            out += bytes(self.root.letters)
            self.root = self.root.branches[0]
            self.root.parent = None
        if not self.root.branches:
            out += bytes(self.root.letters)
            self.root.letters = bytearray()
        return out

    def finish(self) -> bytes:
        """The conversation ends: all letters not emitted yet."""
        ends = [(self.costs[x] + INSERT * len(ENDS[x]), self.ranks[x], x) for x in range(4) if self.nodes[x] is not None]
        x = min(ends)[2]
        parts, node = [ENDS[x]], self.nodes[x]
        while node is not None:
            parts.append(bytes(node.letters))
            node = node.parent
        return b"".join(reversed(parts))


class Chunks:
    """Letters of a conversation cut into the edits of ``CHUNK`` rows each."""

    FULL = re.compile(rb"(?:I*[DKR]){%d}" % CHUNK)

    def __init__(self):
        self.letters, self.rows, self.number = bytearray(), 0, 0

    def add(self, letters: bytes) -> Iterator[tuple[int, str]]:
        self.letters += letters
        self.rows += len(letters) - letters.count(b"I")
        while self.rows >= 2 * CHUNK:
            yield self.take(self.FULL.match(self.letters).end())
            self.rows -= CHUNK

    def finish(self) -> Iterator[tuple[int, str]]:
        while self.rows > CHUNK:
            yield self.take(self.FULL.match(self.letters).end())
            self.rows -= CHUNK
        yield self.take(len(self.letters))

    def take(self, end: int) -> tuple[int, str]:
        out, self.letters = self.letters[:end].decode(), self.letters[end:]
        self.number += 1
        return self.number - 1, out


def same(a, b) -> bool:
    return a == b or (a != a and b != b)


NOTHING = object()


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (conv, turn, role, text) as they are, numbered, and the edits of their chunks as rows of kind 0."""
    conv, survivors, chunks, pos, kinds = NOTHING, None, None, 0, None

    def ended() -> list[tuple]:
        return [(conv, *x) for x in chunks.add(survivors.finish())] + [(conv, *x) for x in chunks.finish()]

    for batch in batches:
        kinds = {c: batch.schema.field(c).type for c in ("conv", "turn", "role", "text")}
        numbers, decided = [], []
        for c, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "initial", "fault"))):
            if conv is NOTHING or not same(c, conv):
                if survivors is not None:
                    decided += ended()
                conv, survivors, chunks, pos = c, Survivors(), Chunks(), 0
            numbers.append(pos)
            pos += 1
            if certain := survivors.step(initial, fault):
                decided += [(conv, *x) for x in chunks.add(certain)]
        n = len(numbers)
        columns = [batch.column("conv"), pa.array([p // CHUNK for p in numbers], pa.int64()), pa.array([1] * n, pa.int32()), pa.array(numbers, pa.int64())]
        columns += [batch.column(c) for c in ("turn", "role", "text", "fault")] + [pa.nulls(n, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, DECIDED)
        if decided:
            yield edit_records(decided, kinds)
    if survivors is not None:
        yield edit_records(ended(), kinds)


DECIDED = ["conv", "chunk", "kind", "pos", "turn", "role", "text", "fault", "letters"]


def edit_records(decided: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    n = len(decided)
    convs, chunks, letters = zip(*decided)
    columns = [pa.array(convs, kinds["conv"]), pa.array(chunks, pa.int64()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64())]
    columns += [pa.nulls(n, kinds["turn"]), pa.nulls(n, kinds["role"]), pa.nulls(n, kinds["text"]), pa.nulls(n, pa.int32()), pa.array(letters, pa.string())]
    return pa.RecordBatch.from_arrays(columns, DECIDED)


def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits in order, each chunk's letters being read before its rows."""
    conv, state, step = NOTHING, START, 0
    steps: list[str] = []
    at = 0
    for batch in batches:
        source, numbers, made, roles = [], [], [], []

        def put(row: int, edit: str, role: str | None) -> None:
            nonlocal step
            source.append(row)
            numbers.append(step)
            made.append(edit)
            roles.append(role)
            step += 1

        def insert(row: int, n: int) -> None:
            nonlocal state
            for _ in range(n):
                state = NEXT[state]
                put(row, "I", ROLE[state])

        for i, (c, kind, letters, role) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "letters", "role")))):
            if conv is NOTHING or not same(c, conv):
                conv, state, step = c, START, 0
            if kind == 0:
                steps, at = re.findall("I*[DKR]|I+$", letters), 0
                continue
            taken = steps[at]
            at += 1
            insert(i, len(taken) - 1)
            if taken[-1] == "K":
                state = KEEPS[role[:1], state]
                put(i, "K", role)
            elif taken[-1] == "R":
                state = NEXT[state]
                put(i, "R", ROLE[state])
            else:
                put(i, "D", None)
            if at < len(steps) and steps[at][-1] == "I":  # inserts behind the last row
                insert(i, len(steps[at]))
        rows = batch.take(pa.array(source, pa.int64()))
        new = pc.equal(pa.array(made, pa.string()), "I")
        roles = pa.array(roles, pa.string())
        old = lambda c: pc.if_else(new, pa.nulls(len(rows), rows.schema.field(c).type), rows.column(c))
        text = pc.if_else(new, "", rows.column("text"))
        text = pc.if_else(pc.is_null(roles), pa.nulls(len(rows), pa.string()), text)
        columns = [rows.column("conv"), pa.array(numbers, pa.int64()), pa.array(made, pa.string()), old("turn"), roles, text, old("role"), old("fault")]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "step", "edit", "turn", "role", "text", "was_role", "fault"])


def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation from its edits in order."""
    total: Total | None = None
    for batch in batches:
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "edit", "turn", "role", "text", "was_role", "fault"))):
            if total is None or not same(row[0], total.conv):
                if total is not None:
                    done.append(total.result())
                total = Total(row[0])
            total.add(*row[1:])
        if done:
            yield results(done, batch.schema.field("conv").type)
        kind = batch.schema.field("conv").type
    if total is not None:
        yield results([total.result()], kind)


def results(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class Total:
    """What the summary needs of one conversation; the audit string is all that grows with it."""

    def __init__(self, conv):
        self.conv = conv
        self.first = self.last = self.before = None
        self.distinct = self.illegal = self.cost = 0
        self.faults = [0, 0, 0, 0]
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, edit, turn, role, text, was_role, fault) -> None:
        self.audit.append(edit)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (UNFINISHED if fault == TRUNCATED and edit != "D" else 0)
        if len(self.audit) >= 1 << 16:
            self.audit = ["".join(self.audit)]
        if edit != "I":
            self.faults[fault] += 1
            if self.before is not None:
                self.illegal += self.before[:1] + was_role[:1] not in ("su", "ua", "au")
            self.before = was_role
            if turn is not None:
                self.distinct += turn != self.last
                self.first = turn if self.first is None else self.first
                self.last = turn
        if role is not None:
            self.digest.update(f"{'\n' if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def result(self) -> tuple:
        gaps = 0 if self.first is None else int(self.last - self.first + 1 - self.distinct)
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def damage(rows: DataFrame, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The faults of the contract, by crc32 of ``conv:turn``. Null roles, texts and parts of the key count as one space."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumns({"_case": F.crc32(F.concat(as_text(conv), F.lit(":"), as_text(turn)).cast("binary")) % 20, role: as_text(role), text: as_text(text)})
    case = F.col("_case")
    rows = rows.filter(case != 0).withColumns(
        {
            text: F.when(case == 1, F.lit("")).when(case == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)),
            role: F.when(case == 4, F.lit("user")).otherwise(F.col(role)),
            "_copy": F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    return rows.drop("_case", "_copy")


def fault_of(text: Column, number: Column) -> Column:
    """The first fault of a row; ``number``: which of the equal rows of its conversation it is."""
    ending = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    return F.when(ending == "", BLANK).when(number > 1, DUPLICATE).when(~ending.isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT).cast("int")


def edits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits of every conversation: conv, step (from 0), edit (K, R, D or I), turn, role, text, was_role, fault.

    role and text are those of the repaired row, null where it is deleted; was_role and fault (0 none, 1 blank, 2 duplicate,
    3 truncated) those of the input row, null where a row is inserted. Rows come by (turn with nulls first, role, text).
    Null roles and texts count as one space, the rows with a null conversation are one conversation. Repeated rows are
    duplicates of each other, empty tables give empty ones, and other columns, of whatever name, are not carried along.

    A conversation streams through one task, since its edits depend on each other to its end, but neither it nor an
    unresolved part of it is held in memory but for the letters; Spark's sorts spill.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = pick(rows, conv=conv_col, turn=turn_col, role=role_col, text=text_col).withColumns({"role": as_text("role"), "text": as_text("text")})
    by_turn = F.col("turn").asc_nulls_first()
    # dealt by conversation once; the window and both sorts stay within those partitions
    number = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(by_turn))
    rows = rows.repartition("conv").withColumn("fault", fault_of(F.col("text"), number)).withColumn("initial", F.substring("role", 1, 1))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    rows = rows.sortWithinPartitions("conv", by_turn, "role", "text")
    decided = in_workers(rows, decide, f"conv {kind['conv']}, chunk long, kind int, pos long, turn {kind['turn']}, role string, text string, fault int, letters string")
    decided = decided.sortWithinPartitions("conv", "chunk", "kind", "pos")
    return in_workers(decided, apply, f"conv {kind['conv']}, step long, edit string, turn {kind['turn']}, role string, text string, was_role string, fault int")


def audit(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation of ``rows`` from its :func:`edits`: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    made = edits(rows, conv_col, turn_col, role_col, text_col)
    kind = made.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return in_workers(made, sum_up, f"conv {kind}, {counts}, audit string, repaired_sha256 string").withColumnRenamed("conv", conv_col)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The contract's query: every original conversation, damaged and audited."""
    rows = pick(conversations, conv="conv_id", turn="turn", role="role", text="text")
    found = audit(damage(rows), "conv").withColumnRenamed("conv", "_conv")
    ids = rows.select("conv").distinct()
    empty = hashlib.sha256(b"").hexdigest()
    out = ids.join(found, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv").withColumnRenamed("conv", "conv_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
