"""Repair of conversation structure by dynamic programming on grammar-compressed sequences.

A conversation without its texts is a sequence of symbols, one a row: whose turn it is and what is
wrong with it.  Pairs of symbols that occur often in the whole corpus become rules (Re-Pair, a batch
of pairs a round), so that all conversations share their parts.  The cheapest repair is a walk over
four states; what a symbol does is a min-plus matrix between the states, with the audit of the
edits as a rope in each cell.  The matrix of a rule is the product of its two, made once, bottom-up;
a conversation is the product of its few symbols.

Of equal costs between the same states the least audit may be kept: all audits of a matrix end in the
edit of its last row, so none begins another, and what follows doesn't change their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_arrow, summed_over_tasks

INITIALS = "sua"  # system, user, assistant; all other roles are one kind
ENDS = ".!?"
WHITE = " \t\n\x0b\x0c\r"
FINE, GOES, CUT = range(3)  # a row without fault, one that has to go, one that breaks off
TERMINALS = 4 * 3  # role kind * 3 + fault
FOLLOWS = {(0, 1), (1, 2), (2, 1)}  # role kinds that may stand next to each other
RULES_A_ROUND, ROUNDS = 40, 6  # symbols stay one byte
STATES = 4  # nothing yet; system said; user said; pairs complete
STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, role kind) -> state
FINAL = (0, 3)
NEXT_ROLE = {0: 1, 1: 1, 2: 2, 3: 1}  # the kind that a state asks for, where an edit may choose
ROLE_NAMES = ("system", "user", "assistant")
REROLE, DELETE, INSERT, BROKEN = 3, 4, 3, 3  # costs
LEAF = 4096  # letters of an audit that are joined at once

Rope = str | tuple
Matrix = list[tuple[int, Rope] | None]  # STATES * STATES cells


def joined(a: Rope, b: Rope) -> Rope:
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= LEAF else (a, b)


def flat(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += (x[1], x[0])
    return "".join(out)


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    if a is None or b is None or a[0] != b[0]:
        return b if a is None or (b is not None and b[0] < a[0]) else a
    return a if a[1] == b[1] or flat(a[1]) <= flat(b[1]) else b


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = [None] * (STATES * STATES)
    for p in range(STATES):
        for m in range(STATES):
            a = x[p * STATES + m]
            if a is None:
                continue
            for q in range(STATES):
                b = y[m * STATES + q]
                old = out[p * STATES + q]
                if b is not None and (old is None or a[0] + b[0] <= old[0]):
                    out[p * STATES + q] = better(old, (a[0] + b[0], joined(a[1], b[1])))
    return out


def insertions() -> Matrix:
    """The fewest inserted rows that lead from a state to another."""
    out: Matrix = [None] * (STATES * STATES)
    for p in range(STATES):
        q, text = p, ""
        while out[p * STATES + q] is None:
            out[p * STATES + q] = (INSERT * len(text), text)
            q, text = STEP[q, NEXT_ROLE[q]], text + "I"
    return out


def terminal(symbol: int) -> Matrix:
    """Insertions, then the edit of one row."""
    kind, fault = divmod(symbol, 3)
    out: Matrix = [None] * (STATES * STATES)
    for p in range(STATES):
        edits = [(p, (DELETE, "D"))]
        if fault != GOES:
            more = BROKEN if fault == CUT else 0
            if (p, kind) in STEP:
                edits.append((STEP[p, kind], (more, "K")))
            if NEXT_ROLE[p] != kind:
                edits.append((STEP[p, NEXT_ROLE[p]], (REROLE + more, "R")))
        for q, e in edits:
            out[p * STATES + q] = better(out[p * STATES + q], e)
    return product(insertions(), out)


@dataclass(frozen=True)
class Grammar:
    """Rule k puts the symbol TERMINALS + k in the place of a pair of symbols."""

    rules: tuple[bytes, ...] = ()

    def compress(self, symbols: bytes) -> bytes:
        for k, pair in enumerate(self.rules):
            symbols = symbols.replace(pair, bytes([TERMINALS + k]))
        return symbols

    def matrices(self) -> list[Matrix]:
        out = [terminal(t) for t in range(TERMINALS)]
        for a, b in self.rules:
            out.append(product(out[a], out[b]))
        return out


def learn_grammar(sequences: DataFrame) -> Grammar:
    """Rules from all sequences (``symbols``, ``weight``).  Tasks count pairs of symbols into 2^16 counters;
    each round turns the most frequent into rules."""
    rules: tuple[bytes, ...] = ()
    for _ in range(ROUNDS):
        g = Grammar(rules)

        def count(batches: Iterator[pa.RecordBatch], g: Grammar = g) -> np.ndarray:
            total = np.zeros(1 << 16, np.int64)
            for b in batches:
                found = [g.compress(s) for s in b.column("symbols").to_pylist()]
                size = np.array([len(s) for s in found])
                flat_ = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
                row = np.repeat(np.arange(len(found)), size)
                inside = row[1:] == row[:-1]
                weight = b.column("weight").to_numpy()
                np.add.at(total, (flat_[:-1] << 8 | flat_[1:])[inside], weight[row[1:][inside]])
            return total

        total = summed_over_tasks(sequences, count, 1 << 16)
        best = [int(k) for k in np.lexsort((np.arange(len(total)), -total))[:RULES_A_ROUND] if total[k] > 1]
        if not best:
            break
        rules += tuple(bytes(divmod(k, 256)) for k in best)
    return Grammar(rules)


def cheapest(symbols: bytes, grammar: Grammar, matrices: list[Matrix]) -> tuple[int, str]:
    """Cost and audit of the best repair.  Products are made of neighbours of equal span, so ropes
    stay balanced however long the conversation is."""
    stack: list[tuple[int, Matrix]] = []
    for s in grammar.compress(symbols):
        stack.append((1, matrices[s]))
        while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (n, y), (_, x) = stack.pop(), stack.pop()
            stack.append((2 * n, product(x, y)))
    total = insertions()
    while stack:
        total = product(stack.pop()[1], total)
    best = None
    for q in FINAL:
        best = better(best, total[q])
    return best[0], flat(best[1])


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[bool, tuple]]:
    """(whether a new conversation begins, the row's values) in the order of the partition."""
    last = None
    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in names), strict=True):
            yield last is None or row[0] != last[0], row
            last = row


class _Out:
    """Rows that leave as Arrow batches of a bounded number of rows and bytes."""

    def __init__(self, schema: pa.Schema, rows: int = 2048, size: int = 1 << 20):
        self.schema, self.most, self.most_size = schema, rows, size
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= self.most or self.size >= self.most_size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.rows, self.size = [], 0


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The columns that count, nulls of role and text as one space, and the digest that breaks ties."""
    out = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    named = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    return out.withColumn("digest", F.unhex(F.sha2(named.cast("binary"), 256)))


def _symbol() -> Column:
    """Role kind and fault of a row taken by itself."""
    initial = F.substring("role", 1, 1)
    kind = F.coalesce(*(F.when(initial == c, F.lit(i)) for i, c in enumerate(INITIALS)), F.lit(len(INITIALS)))
    said = F.rtrim("text", F.lit(WHITE))
    fault = F.when(said == "", GOES).when(F.substring(said, -1, 1).isin(*ENDS), FINE).otherwise(CUT)
    return (kind * 3 + fault).cast("int")


def _in_order(rows: DataFrame) -> DataFrame:
    """One conversation's rows in one task, sorted on disk if need be and read as a stream."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "tag", F.col("turn").asc_nulls_first(), "role", "digest")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _sequences(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, counts, symbols) of every conversation of ``ids``; texts stay behind."""
    empty = ids.select("conv_id").distinct().select("conv_id", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("symbol"))
    real = rows.select("conv_id", F.lit(1).alias("tag"), "turn", "role", "digest", _symbol().alias("symbol"))
    schema = pa.schema([("conv_id", _arrow_type(rows, "conv_id")), *((c, pa.int64()) for c in COUNTS), ("symbols", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, begun = _Out(schema), None, False
        symbols, seen, turns, low, high, count = bytearray(), set(), 0, None, None, [0] * 4

        def row() -> tuple:
            return (conv, high - low + 1 - turns if turns else 0, *count, bytes(symbols))

        for new, (c, tag, turn, _, digest, symbol) in _grouped(batches, ["conv_id", "tag", "turn", "role", "digest", "symbol"]):
            if new:
                if begun:
                    yield from out.add(row(), len(symbols))
                conv, begun = c, True
                symbols, seen, turns, low, high, count = bytearray(), set(), 0, None, None, [0] * 4
            if tag == 0:
                continue
            if turn is not None and turn != high:
                turns, low, high = turns + 1, turn if low is None else low, turn
            kind, fault = divmod(symbol, 3)
            if fault == GOES:
                count[0] += 1
            elif digest in seen:
                count[1] += 1
                fault = GOES
            elif fault == CUT:
                count[2] += 1
            seen.add(digest)
            if symbols and (symbols[-1] // 3, kind) not in FOLLOWS:
                count[3] += 1
            symbols.append(kind * 3 + fault)
        if begun:
            yield from out.add(row(), len(symbols))
        yield from out.flush()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_arrow(_in_order(empty.union(real)), run, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, symbols binary")


def judge_conversations(rows: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``rows``
    and of every ``conv_id`` of ``ids``: faults found and the edits of the cheapest repair.

    Rows come by turn (nulls first), those of one turn by role and then by a digest of their text.  Null roles and
    texts are one space; a null id is a conversation like any other.  A row's first fault counts: blank
    (white space alone), duplicate (role and text stood before), truncated (no ``.!?`` at the end).
    Faults do not depend on the length of a text.  A conversation without rows has zeros and an empty
    audit; repeated rows are duplicates; further columns do not matter; no rows give no rows.

    A conversation's symbols pass one task in order, without texts (its audit, one letter a row, has to
    fit in a row of the result anyway).  The result is a table in the checkpoint folder.
    """
    plain = _plain(rows, conv, turn, role, text)
    all_ids = plain.select("conv_id") if ids is None else ids.select("conv_id").union(plain.select("conv_id"))
    found = cut_lineage(_sequences(plain, all_ids))
    sequences = found.groupBy("symbols").agg(F.count(F.lit(1)).alias("weight"))
    grammar = learn_grammar(cut_lineage(sequences))
    names = ["conv_id", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, known = grammar.matrices(), {}
        for b in batches:
            known.clear()  # repeats within a batch are solved once
            solved = [known[s] if s in known else known.setdefault(s, cheapest(s, grammar, matrices)) for s in b.column("symbols").to_pylist()]
            cost, audit = pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), cost, audit], names=[*names, "cost", "audit"])

    kind = plain.schema["conv_id"].dataType.simpleString()
    return cut_lineage(map_arrow(found, run, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string"))


def repaired_turns(rows: DataFrame, judged: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the rows of each conversation after its audit's edits
    (K kept, R given another role, I inserted without text or turn), numbered from 0.  ``rows`` are those that were
    judged.  A conversation's rows stand together in a partition, in order; they pass as a stream."""
    plain = _plain(rows, conv, turn, role, text)
    audits = judged.select("conv_id", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    both = audits.union(plain.select("conv_id", F.lit(1).alias("tag"), "turn", "role", "text", "digest"))
    schema = pa.schema([("conv_id", _arrow_type(plain, "conv_id")), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv_now, audit, at, place, state = _Out(schema), None, "", 0, 0, 0

        def emit(turn_: int | None, kind: int, name: str, text_: str, edit: str) -> Iterator[pa.RecordBatch]:
            nonlocal place, state
            yield from out.add((conv_now, place, turn_, name, text_, edit), len(text_))
            place, state = place + 1, STEP[state, kind]

        def inserted() -> Iterator[pa.RecordBatch]:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                kind = NEXT_ROLE[state]
                yield from emit(None, kind, ROLE_NAMES[kind], "", "I")
                at += 1

        for new, (c, tag, turn_, role_, text_) in _grouped(batches, ["conv_id", "tag", "turn", "role", "text"]):
            if new:
                yield from inserted()
                conv_now, audit, at, place, state = c, "", 0, 0, 0
            if tag == 0:
                audit = text_
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                yield from emit(turn_, INITIALS.index(role_[0]), role_, text_, "K")
            elif edit == "R":
                kind = NEXT_ROLE[state]
                yield from emit(turn_, kind, ROLE_NAMES[kind], text_, "R")
        yield from inserted()
        yield from out.flush()

    kind = plain.schema["conv_id"].dataType.simpleString()
    return map_arrow(_in_order(both).drop("digest"), run, f"conv_id {kind}, place long, turn long, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired_turns``, in the order in which they stand: ``role:text`` joined by new lines."""
    schema = pa.schema([("conv_id", _arrow_type(turns, "conv_id")), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, h = _Out(schema), None, None
        for new, (c, role, text) in _grouped(batches, ["conv_id", "role", "text"]):
            if new:
                if h is not None:
                    yield from out.add((conv, h.hexdigest()), 64)
                conv, h = c, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if h is not None:
            yield from out.add((conv, h.hexdigest()), 64)
        yield from out.flush()

    kind = turns.schema["conv_id"].dataType.simpleString()
    return map_arrow(turns.select("conv_id", "role", "text"), run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame, one_in: int = 20) -> DataFrame:
    """Conversations with faults, chosen by crc32 of ``conv_id:turn``: rows dropped, emptied, robbed of their
    ends, repeated, or given to the user.  Nulls are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % one_in).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return rows.drop("copy")


def conversation_report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``judge_conversations`` with ``repaired_sha256``, the digest of the repaired text (of nothing where
    no row is left)."""
    judged = judge_conversations(rows, ids)
    made = digests(repaired_turns(rows, judged)).withColumnRenamed("conv_id", "_conv")
    out = judged.join(made, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return out.select(*judged.columns, F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
