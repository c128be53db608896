"""Repair of conversations with the fewest costs, by Four-Russians block tables.

A repaired conversation's role initials read `(s?(ua)+)?`.  What may still
come depends on four states only: nothing yet (0), after the system turn (1),
after a user's turn (2), after an assistant's (3).  Every row after faults is
one of nine symbols, and a vector holds for each state what the rest of the
conversation costs at least.  Less its least entry, such a vector is one of
few, because inserted turns lead from state to state at a bounded cost.  So
for each of these vectors and each block of BLOCK symbols a table says which
vector comes before the block and what it costs: a conversation is read from
its end to its start, one lookup a block.  To find the edits, a block's
vectors are made again one symbol at a time from the stored one behind it,
and the rows are then walked from the front: from a state each edit's initial
leads to one next state, so taking at every step the least initial that keeps
the least cost gives, of all cheapest repairs, that with the least audit.

How it scales: rows are put in order by one range sort, cut into chunks of
CHUNK rows (one letter a row); the first pass sees chunks only.  A
conversation's turns stream through a task, which holds one chunk's letters
and one Arrow batch of rows, however long the conversation is.  Repeats of a
turn are found by an aggregation and a join on the row's own number, so
neither a long conversation nor a text that is common in it makes a hot key.

Defined cases: a null conv_id, role or text counts as one space where it is
compared or written (rows without conv_id are one conversation), null turns
come first and count in no gap; rows of the same turn go by role and SHA-256
of the text; repeated rows are faults; an empty table gives no rows; long
texts stay whole; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm.shared import BLANKS, written

BLOCK = 4
#: Rows of a chunk: 2 ** CHUNK_BITS at most.
CHUNK_BITS = 12

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
INITIALS = "sua"
#: Of a row: 4 * (place of its role's initial in INITIALS, else 3) + its fault.
LETTERS = "ABCDEFGHIJKLMNOP"
FAULTS = (None, "blank", "duplicate", "truncated")
#: The state after a turn of a user or assistant that is put in, by state.
ONWARD = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: What may be kept: (state, initial) to state.
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: Cost from each state if no row comes any more.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Symbols: no row, a row that must go, then clean and truncated by initial.
NO_ROW, MUST_GO, SYMBOLS = 0, 1, 10

CHUNKS = "conv_id bigint, at bigint, symbols string, behind int"
EDITS = (
    "conv_id bigint, step bigint, edit string, role string, text string, was_role string, turn bigint, fault string, cost bigint"
)
AUDITS = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


def symbol(letter: int) -> int:
    initial, fault = divmod(letter, 4)
    return MUST_GO if fault in (1, 2) else 2 + 2 * initial + (fault == 3)


def before(costs: tuple[int, ...], sym: int) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """(costs, least cheapest edit by state) in front of a symbol, from the costs behind it."""
    if sym == NO_ROW:
        return costs, ("",) * 4
    initial, cut = divmod(sym - 2, 2)
    options = []
    for state in range(4):
        here = {"D": DELETE + costs[state]}
        if sym != MUST_GO:
            if (state, initial) in KEPT:
                here["K"] = TRUNCATED * cut + costs[KEPT[state, initial]]
            here["R"] = REROLE + TRUNCATED * cut + costs[ONWARD[state]]
        options.append(here)
    out = [min(o.values()) for o in options]
    # two rounds: a turn put in leads to a state from which another may be
    for _ in range(2):
        out = [min(c, INSERT + out[ONWARD[s]]) for s, c in enumerate(out)]
    for state, here in enumerate(options):
        here["I"] = INSERT + out[ONWARD[state]]
    return tuple(out), tuple(min(e for e, c in o.items() if c == out[s]) for s, o in enumerate(options))


class Blocks:
    """Transitions of all normalised cost vectors over every block of symbols."""

    def __init__(self):
        self.vectors = [AT_END]
        number = {AT_END: 0}
        step, self.edits = [], []
        for costs in self.vectors:
            row, edits = [], []
            for sym in range(SYMBOLS):
                got, best = before(costs, sym)
                least = min(got)
                key = tuple(c - least for c in got)
                if key not in number:
                    number[key] = len(self.vectors)
                    self.vectors.append(key)
                row.append((number[key], least))
                edits.append(best)
            step.append(row)
            self.edits.append(edits)
        table = np.array(step, np.int32)
        self.step = table[:, :, 0].tolist()
        to, cost = table[:, :, 0], table[:, :, 1]
        for _ in range(BLOCK - 1):
            # a symbol in front of all blocks so far: digits run from the front of a block
            cost = (cost[:, None, :] + table[:, :, 1][to].transpose(0, 2, 1)).reshape(len(self.vectors), -1)
            to = table[:, :, 0][to].transpose(0, 2, 1).reshape(len(self.vectors), -1)
        self.to, self.cost = to, cost

    @staticmethod
    def blocks(symbols: list[int]) -> list[list[int]]:
        """Blocks of the symbols, the first one filled up in front."""
        filled = [NO_ROW] * (-len(symbols) % BLOCK) + symbols
        return [filled[i : i + BLOCK] for i in range(0, len(filled), BLOCK)]

    @staticmethod
    def key(block: list[int]) -> int:
        out = 0
        for sym in block:
            out = out * SYMBOLS + sym
        return out

    def backward(self, symbols: list[int], behind: int) -> tuple[int, int, list[int]]:
        """(vector before all symbols, its cost, vector behind each block) from the vector behind all of them."""
        cost, seen = 0, []
        for block in reversed(self.blocks(symbols)):
            seen.append(behind)
            key = self.key(block)
            cost += int(self.cost[behind, key])
            behind = int(self.to[behind, key])
        return behind, cost, seen[::-1]

    def forward(self, symbols: list[int], behind: int, state: int) -> tuple[list[str], int]:
        """(edits of each row, state) of a walk over symbols: the cheapest, of these the least initials."""
        found = []
        for block, last in zip(self.blocks(symbols), self.backward(symbols, behind)[2], strict=True):
            vectors = [last]
            for sym in reversed(block[1:]):
                vectors.append(self.step[vectors[-1]][sym])
            for sym, vector in zip(block, reversed(vectors), strict=True):
                if sym == NO_ROW:
                    continue
                edits = ""
                while not edits or edits[-1] == "I":
                    edits += self.edits[vector][sym][state]
                    if edits[-1] == "K":
                        state = KEPT[state, (sym - 2) // 2]
                    elif edits[-1] != "D":
                        state = ONWARD[state]
                found.append(edits)
        return found, state


def _vectors_behind(batches):
    """Chunks (conv_id, at, symbols), each conversation's last one first: with the number of the vector behind each."""
    tables, conv, behind = Blocks(), object(), 0
    for batch in batches:
        out = []
        for conv_id, letters in zip(batch["conv_id"].to_pylist(), batch["symbols"].to_pylist(), strict=True):
            if conv_id != conv:
                conv, behind = conv_id, 0
            out.append(behind)
            behind = tables.backward([symbol(LETTERS.index(c)) for c in letters], behind)[0]
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["at"], batch["symbols"], pa.array(out, pa.int32())], names=["conv_id", "at", "symbols", "behind"]
        )


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(named)
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def _edits(batches):
    """Rows sorted by conversation and place, chunks in front of their rows: one row an edit."""
    tables, nothing, state, step, plan = Blocks(), object(), 0, -1, iter(())
    conv = nothing

    def put_in():
        nonlocal state, step
        state = ONWARD[state]
        step += 1
        return conv, step, "I", ROLES[state], "", None, None, None, INSERT

    def finish():
        if step < 0:
            return [] if conv is nothing else [(conv, 0, *[None] * 6, 0)]
        return [put_in() for _ in range(AT_END[state] // INSERT)]

    for batch in batches:
        out = []
        for conv_id, kind, turn, role, text, letters, behind in zip(*(
            batch[c].to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "symbols", "behind")
        ), strict=True):
            if conv_id != conv:
                out += finish()
                conv, state, step = conv_id, 0, -1
            if kind == 1:
                symbols = [symbol(LETTERS.index(c)) for c in letters]
                # the state runs on by itself, row by row, below
                plan = iter(list(zip(letters, tables.forward(symbols, behind, state)[0], strict=True)))
            elif kind == 2:
                letter, edits = next(plan)
                out += [put_in() for _ in edits[:-1]]
                initial, fault = divmod(LETTERS.index(letter), 4)
                edit, step, cost, new = edits[-1], step + 1, DELETE, role
                if edit == "K":
                    state, cost = KEPT[state, initial], 0
                elif edit == "R":
                    state, cost = ONWARD[state], REROLE
                    new = ROLES[state]
                if edit != "D" and fault == 3:
                    cost += TRUNCATED
                out.append((conv, step, edit, new, text, role, turn, FAULTS[fault], cost))
        yield _batch(out, EDITS)
    yield _batch(finish(), EDITS)


def repair(chats: DataFrame) -> DataFrame:
    """(conv_id, step, edit, role, text, was_role, turn, fault, cost): the edits of each conversation, in order.

    edit is K(eep), R(erole), D(elete) or I(nsert); rows but the deleted ones
    are the repaired conversation.  Conversations lie whole and in order in a
    partition; where one has no rows, one row says so by a null edit.  conv_id
    may stand alone, with null turn, role, text and a true `gone`, to be named.
    """
    gone = F.col("gone") if "gone" in chats.columns else F.lit(False)
    own = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", gone.alias("gone"))
    convs = own.select("conv_id").distinct()
    filled = own.filter("NOT gone").select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    initial, end = F.left("role", F.lit(1)), F.rtrim("text", F.lit(BLANKS))
    rows = filled.select(
        "*", F.sha2("text", 256).alias("text_key"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.nullif(F.instr(F.lit(INITIALS), initial), F.lit(0)) - 1, F.lit(3)).alias("initial"),
        F.when(end == "", 1).when(~F.right(end, F.lit(1)).isin(*".!?"), 3).otherwise(0).alias("fault"),
    ).withColumn("initial", F.when(F.col("role") == "", 3).otherwise(F.col("initial")))
    order = ["conv_id", "turn", "role", "text_key", "row"]
    # the id counts on within a sorted partition, so its leading bits name a chunk of neighbours
    placed = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id()), "turns"
    )
    firsts = placed.groupBy("conv_id", "role", "text_key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    seen = placed.select("conv_id", "at", "initial", "fault").join(firsts, "at", "left")
    fault = F.when((F.col("fault") != 1) & F.col("first").isNull(), 2).otherwise(F.col("fault"))
    letter = F.substring(F.lit(LETTERS), F.col("initial") * 4 + fault + 1, F.lit(1))
    chunks = seen.groupBy("conv_id", F.shiftright("at", CHUNK_BITS).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("at", letter.alias("letter")))).alias("rows")
    ).select("conv_id", F.col("rows")[0]["at"].alias("at"), F.array_join("rows.letter", "").alias("symbols"))
    behind = chunks.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("at").desc()).mapInArrow(_vectors_behind, CHUNKS)

    def shaped(df: DataFrame, kind: int, at="at") -> DataFrame:
        names = {"turn": "long", "role": "string", "text": "string", "symbols": "string", "behind": "int"}
        return df.select("conv_id", F.lit(kind).alias("kind"), F.expr(str(at)).cast("long").alias("at"),
                         *[F.col(n) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in names.items()])

    together = shaped(convs, 0, -1).union(shaped(behind, 1)).union(shaped(placed, 2))
    return together.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind").mapInArrow(_edits, EDITS)


def _audits(batches):
    conv, held = object(), None

    def row():
        gaps = held["last"] - held["least"] + 1 - held["turns"] if held["turns"] else 0
        faults = [held["faults"].get(f, 0) for f in FAULTS[1:]]
        return conv, gaps, *faults, held["illegal"], held["cost"], "".join(held["audit"]), held["sha"].hexdigest()

    for batch in batches:
        out = []
        for conv_id, edit, role, text, was, turn, fault, cost in zip(*(
            batch[c].to_pylist() for c in ("conv_id", "edit", "role", "text", "was_role", "turn", "fault", "cost")
        ), strict=True):
            if conv_id != conv:
                if held:
                    out.append(row())
                conv = conv_id
                held = {"least": 0, "last": None, "turns": 0, "faults": {}, "illegal": 0, "cost": 0, "audit": [],
                        "sha": hashlib.sha256(), "lines": 0, "role": None}
            if edit is None:
                continue
            held["audit"].append(edit)
            held["cost"] += cost
            if edit != "D":
                held["sha"].update(f"{chr(10) if held['lines'] else ''}{role}:{text}".encode())
                held["lines"] += 1
            if edit == "I":
                continue
            held["faults"][fault] = held["faults"].get(fault, 0) + 1
            if held["role"] is not None and held["role"] + was[:1] not in ("su", "ua", "au"):
                held["illegal"] += 1
            held["role"] = was[:1]
            if turn is not None and turn != held["last"]:
                held["least"] = held["least"] if held["turns"] else turn
                held["last"], held["turns"] = turn, held["turns"] + 1
        yield _batch(out, AUDITS)
    yield _batch([row()] if held else [], AUDITS)


def audits(edits: DataFrame) -> DataFrame:
    """One row per conversation of repair()'s edits: faults, least cost, audit, digest of the repaired turns."""
    return edits.mapInArrow(_audits, AUDITS)


def damage(chats: DataFrame) -> DataFrame:
    """chats (conv_id, turn, role, text) with faults put in, the same for a conv_id and turn each time; see op11's contract.

    Nulls become one space.  Rows that are dropped stay as `gone`, so that
    their conversation is still named.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(drawn == 1, "").when(drawn == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    return chats.select(
        "conv_id", "turn", F.when(drawn == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"),
        (drawn == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(drawn == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
