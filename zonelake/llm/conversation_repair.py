"""Conversation structure repair: the cheapest edits that turn each conversation into (system?)(user assistant)+ or nothing.

Rows may be kept, given the role user or assistant, deleted, and empty turns inserted; a weighted automaton of four states reads
a conversation's rows. It is determinised as it is needed: a vector of the four states' costs, less its minimum, is
one state of the deterministic automaton, found under (state, kind of row) in a table that fills with the first conversations.
A scan through the table gives the cost; a trace back over arcs that are tight (cost before + arc = cost after), cached in the
same way, marks which states lie on a cheapest way and the least letter in each, and following these letters from the
front gives the least audit string.

Spark deals rows by conversation and sorts them, so a task streams a conversation: first its narrow rows (role, kind), of which some
ten bytes each stay in memory, then the same rows with texts, which are hashed and let go. First occurrences come from a
group-by over all rows before, so copies within a conversation are neither gathered nor compared here. One conversation is one
audit string and one running SHA-256, which can't be split; conversations share a task but never wait for others.

Defined results: see damage() for nulls. A null conv_id is a conversation like any other; rows of equal turn come by role, then by the
MD5 of their text; an empty role has no legal place and is no initial; a null role is a space; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States by what was produced last, and what rows may be.
START, SYSTEM, USER, ASSISTANT = range(4)
FINE, TRUNCATED, DELETE = range(3)
INITIALS, ROLES = "sua", ("system", "user", "assistant")
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 40

Arc = tuple[str, int, int]  # letter, state that it leads to, cost


def row_arcs(state: int, kind: int) -> list[Arc]:
    """Ways to read one row; kind is 3 * (place in INITIALS, or 3) + status."""
    initial, status = divmod(kind, 3)
    arcs = [("D", state, DELETE_COST)]
    if status != DELETE:
        extra = TRUNCATED_COST if status == TRUNCATED else 0
        makes = ASSISTANT if state == USER else USER
        arcs.append(("K", makes, extra) if initial == makes - 1 else ("R", makes, extra + REROLE_COST))
        if state == START and initial == 0:
            arcs.append(("K", SYSTEM, extra))
    return arcs


def insertion(state: int) -> Arc:
    return "I", ASSISTANT if state == USER else USER, INSERT_COST


class Automaton:
    """The deterministic automaton, as far as it was needed."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.traces: dict[tuple[int, int, int], tuple[int, tuple[Arc | None, ...]]] = {}
        self.first, self.first_cost = self.add([0, NEVER, NEVER, NEVER])

    def add(self, costs: list[int]) -> tuple[int, int]:
        """(state, minimum) of a vector, closed under insertions.

        A start that costs over DELETE_COST more than a finished pair is on no cheapest way, as what may follow it may follow the pair
        if a system row is deleted; nor is a system row that costs more than a pair. So there are finitely many vectors.
        """
        for _ in range(2):
            for state in range(4):
                _, to, cost = insertion(state)
                costs[to] = min(costs[to], costs[state] + cost)
        if costs[START] > costs[ASSISTANT] + DELETE_COST:
            costs[START] = NEVER
        if costs[SYSTEM] > costs[ASSISTANT]:
            costs[SYSTEM] = NEVER
        least = min(costs)
        vector = tuple(min(c - least, NEVER) if c < NEVER else NEVER for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * 12)
        return self.ids[vector], least

    def step(self, state: int, kind: int) -> tuple[int, int]:
        found = self.table[state][kind]
        if found is None:
            costs = [NEVER] * 4
            for at, cost in enumerate(self.vectors[state]):
                for _, to, more in row_arcs(at, kind) if cost < NEVER else ():
                    costs[to] = min(costs[to], cost + more)
            found = self.table[state][kind] = self.add(costs)
        return found

    def trace(self, state: int, kind: int, alive: int) -> tuple[int, tuple[Arc | None, ...]]:
        """States before a row that lie on a cheapest way, given those after it, and the least letter in each; kind -1: the end."""
        key = (state, kind, alive)
        if key not in self.traces:
            vector, choices, on = self.vectors[state], [None] * 4, 0
            if kind >= 0:
                after, least = self.step(state, kind)
                for at in range(4):
                    tight = [a for a in row_arcs(at, kind) if alive >> a[1] & 1 and vector[at] < NEVER and vector[at] + a[2] == self.vectors[after][a[1]] + least]
                    if tight:
                        choices[at], on = min(tight), on | 1 << at
            else:
                on = alive
            for _ in range(2):
                for at in range(4):
                    arc = insertion(at)
                    if on >> arc[1] & 1 and vector[at] < NEVER and vector[at] + arc[2] == vector[arc[1]]:
                        if not (kind < 0 and alive >> at & 1) and (choices[at] is None or arc < choices[at]):
                            choices[at] = arc
                        on |= 1 << at
            self.traces[key] = on, tuple(choices)
        return self.traces[key]


class Repair:
    """Scan, trace and edits of one conversation."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.state, self.cost = automaton.first, automaton.first_cost
        self.states, self.kinds = array("I", [self.state]), bytearray()

    def read(self, kind: int) -> None:
        self.state, least = self.automaton.step(self.state, kind)
        self.cost += least
        self.states.append(self.state)
        self.kinds.append(kind)

    def finish(self) -> None:
        """Traces back; then ``cost`` is final and edits() can be asked for."""
        vector = self.automaton.vectors[self.state]
        best = min(vector[START], vector[ASSISTANT])
        self.cost += best
        alive = sum(1 << q for q in (START, ASSISTANT) if vector[q] == best)
        self.masks = bytearray(len(self.kinds) + 1)
        for i in range(len(self.kinds), -1, -1):
            self.masks[i] = alive
            alive, _ = self.automaton.trace(self.states[i], self.kinds[i] if i < len(self.kinds) else -1, alive)

    def edits(self) -> Iterator[tuple[str, int]]:
        """(letter, state that it leads to), in order."""
        at = START
        for i in range(len(self.states)):
            kind = self.kinds[i] if i < len(self.kinds) else -1
            choices = self.automaton.trace(self.states[i], kind, self.masks[i])[1]
            while (arc := choices[at]) is not None:
                yield arc[0], arc[1]
                at = arc[1]
                if arc[0] != "I":
                    break


class Conversation:
    """What is known of the conversation that a task is streaming."""

    def __init__(self, key, automaton: Automaton) -> None:
        self.key, self.repair = key, Repair(automaton)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn = self.before = self.mark = None
        self.walk = None
        self.hash, self.empty = hashlib.sha256(), True

    def row(self, turn, role: str, digest: bytes, status: int, kind: int) -> None:
        """A narrow row; kind -1 marks the first of equal rows that follow."""
        same = (turn, role, digest)
        if kind < 0:
            self.mark = same
            return
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.turn, self.high = turn, turn
            self.low = turn if self.low is None else self.low
        first, self.mark = self.mark == same, None
        if status == DELETE:
            self.blank += 1
        elif not first:
            self.duplicate += 1
        elif status == TRUNCATED:
            self.truncated += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.repair.read(3 * kind + (status if first else DELETE))

    def write(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else '\n'}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def edit(self, role: str | None, text: str | None) -> None:
        """Applies the edits up to and with the next row, or the insertions at the end (role None)."""
        if self.walk is None:
            self.repair.finish()
            self.walk = self.repair.edits()
        for letter, to in self.walk:
            if letter == "I":
                self.write(ROLES[to - 1], "")
                continue
            if letter != "D":
                self.write(role if letter == "K" else ROLES[to - 1], text)
            return

    def result(self) -> tuple:
        self.edit(None, None)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        audit = "".join(letter for letter, _ in self.repair.edits())
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.repair.cost, audit, self.hash.hexdigest()


def damage(talks: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32(`conv_id:turn`) % 20: 0 drops the row (text and role null here, so
    that its conversation stays known), 1 empties the text, 2 removes its [.!?], 3 repeats the row, 4 makes the role user.

    A null role or text is one space, and so is a null conv_id or turn within the checksum; conv_id and turn stay null else."""
    c = lambda name: F.col(f"`{name}`")
    shown = lambda name: F.coalesce(c(name).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(shown(id_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    rows = talks.select(c(id_col).alias("conv_id"), c(turn_col).cast("long").alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    gone = F.col("harm") == 0
    rows = rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(~gone, text).alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def status_of(text: Column) -> Column:
    """Blank rows must go; truncated ones don't end with a full stop, exclamation or question mark."""
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), DELETE).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(FINE)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): faults, cost, audit and the digest of the repaired rows.

    A row with a null role isn't there, but its conversation is.
    """
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    narrow = rows.select("conv_id", "turn", "role", digest.alias("digest"), status_of(F.col("text")).alias("status"))
    # The first row of each (role, text): of equal rows at its turn, which come one after another, the first one.
    firsts = narrow.where("role IS NOT NULL").groupBy("conv_id", "role", "digest").agg(F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("turn"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    nothing = F.lit(None).cast("string")
    streams = [
        firsts.select("conv_id", F.lit(0).alias("phase"), F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), "role", "digest", F.lit(-1).alias("kind"), F.lit(0).alias("status"), nothing.alias("text")),
        rows.select("conv_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("phase"), "turn", "role", "text").where("phase = 0 OR role IS NOT NULL").select(
            "conv_id", "phase", "turn", "role", digest.alias("digest"), kind.alias("kind"), F.when(F.col("phase") == 0, status_of(F.col("text"))).alias("status"), F.when(F.col("phase") == 1, F.col("text")).alias("text")
        ),
    ]
    every = streams[0].unionByName(streams[1]).repartition("conv_id").sortWithinPartitions("conv_id", "phase", "turn", "role", "digest", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, schema = Automaton(), None, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *((n, pa.int64()) for n in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            done = []
            for key, phase, turn, role, digest, kind, status, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(key, automaton)
                if role is None:
                    continue
                if phase == 0:
                    now.row(turn, role, digest, status, kind)
                else:
                    now.edit(role, text)
            yield made(done, schema)
        if now is not None:
            yield made([now.result()], schema)

    key_type = rows.schema["conv_id"].dataType.simpleString()
    return every.mapInArrow(run, f"conv_id {key_type}, {', '.join(f'{n} bigint' for n in NUMBERS)}, audit string, repaired_sha256 string")


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema, strict=True)], schema=schema)
