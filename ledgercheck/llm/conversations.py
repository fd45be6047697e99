"""Cheapest repair of conversations: run-length dynamic programming over role and fault symbols.

A row is one symbol: the initial of its role (s, u, a or any other) and its first fault (none,
blank, duplicate, truncated).  Wanted are role initials `(s?(ua)+)?`, so where a conversation
stands is one of four states.  An edit costs: Keep 0, Rerole (to the role that fits) 1, Delete 2,
Insert (of the role that fits, without text) 5; a truncated row that stays costs 5 more, blank and
duplicate rows must go.  One symbol is a 4 x 4 min-plus matrix.  Equal neighbours are one run, and
a run of n rows is advanced by the cached binary powers of its matrix, from the end to the start;
then the choices are unrolled from the start, halving runs with the same powers.  Of equally cheap
edits the audit is the least in ASCII order; a state and a letter leave no choice, so taking the
least letter at every step gives it.

Jobs: rows without their texts are counted by content, told apart by the md5 of role and text,
sorted by range and turned into runs in pieces, so that a conversation with a third of all rows is
spread over tasks; the runs of a conversation meet in one row, which is no longer than its audit.
The texts move once, to be walked in order beside the audit: a SHA-256 can only be taken in order,
so one task passes the texts of a conversation, but it streams them and holds one batch.

Defined results: null roles and texts count as one space, null conv_ids are one conversation,
null turns come first; rows of one turn are ordered by role, the first 64 characters of the text
and the md5 of both.  Equal rows are as many rows.  Very long texts are one row each, streamed.
Conversations without rows get zeros, an empty audit and the hash of nothing; an empty table gives
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgercheck.llm.common import small_batches, to_batch

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
ROLES = "sua"            # initials that may stay; any other is class 3
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
RUNS_PER_ROW = 1 << 16   # runs of one conversation sent in one row
FAR = 1 << 60            # more than any cost
STEP_MEMO = 1 << 16      # remembered unrolled blocks of a task

# Where the next user or assistant leads from each state: nothing, s, ..u, ..a
NEXT = (2, 2, 3, 2)


def symbol_matrix(symbol: int) -> np.ndarray:
    """Cost of passing one row, with any inserts before it, from state to state."""
    role, fault = divmod(symbol, 4)
    step = np.full((4, 4), FAR, np.int64)
    insert = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        step[s, s] = 2
        insert[s, s] = 0
        if fault in (OK, TRUNCATED):
            stay = 5 if fault == TRUNCATED else 0
            step[s, NEXT[s]] = 1 + stay
            kept = kept_state(s, role)
            if kept is not None:
                step[s, kept] = stay
    for s in range(4):
        insert[s, NEXT[s]] = 5
    return times(closure(insert), step)


def kept_state(state: int, role: int) -> int | None:
    """The state after a row is kept, if its role fits."""
    if role == 0:
        return 1 if state == 0 else None
    if role == 1:
        return 2 if state != 2 else None
    return 3 if role == 2 and state == 2 else None


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


def closure(step: np.ndarray) -> np.ndarray:
    for _ in range(2):
        step = times(step, step)
    return step


class Solver:
    """Least costs and audits of conversations given as runs; keeps powers between them."""

    def __init__(self) -> None:
        self.powers: dict[int, list[np.ndarray]] = {}
        self.memo: dict[tuple, tuple[str, int]] = {}
        self.before: dict[tuple, tuple[tuple, int]] = {}

    def power(self, symbol: int, k: int) -> np.ndarray:
        """The matrix of 2^k rows of one symbol."""
        known = self.powers.setdefault(symbol, [symbol_matrix(symbol)])
        while len(known) <= k:
            known.append(times(known[-1], known[-1]))
        return known[k]

    def back(self, symbol: int, k: int, rest: tuple) -> tuple[tuple, int]:
        """Costs ahead of 2^k rows from those after them, less their least, and that."""
        known = self.before.get((symbol, k, rest))
        if known is None:
            cost = (self.power(symbol, k) + np.array(rest)).min(axis=1)
            known = tuple((cost - cost.min()).tolist()), int(cost.min())
            if len(self.before) >= STEP_MEMO:
                self.before.clear()
            self.before[symbol, k, rest] = known
        return known

    def solve(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[int, str]:
        blocks = [(s, k) for s, n in zip(map(int, symbols), map(int, lengths))
                  for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
        ahead, total = [(0, 10, 5, 0)], 0   # inserts up to an end that is allowed
        for symbol, k in reversed(blocks):
            costs, least = self.back(symbol, k, ahead[-1])
            ahead.append(costs)
            total += least
        ahead.reverse()
        audit, state = [], 0
        for (symbol, k), rest in zip(blocks, ahead[1:]):
            letters, state = self.unroll(symbol, k, state, rest)
            audit.append(letters)
        audit.append("I" * (0, 2, 1, 0)[state])
        return total + ahead[0][0], "".join(audit)

    def unroll(self, symbol: int, k: int, state: int, rest: tuple) -> tuple[str, int]:
        """Edits of 2^k rows from a state, and the state after; `rest` is the cost from there."""
        key = (symbol, k, state, rest)
        known = self.memo.get(key)
        if known is None:
            if k == 0:
                known = self.choose(symbol, state, np.array(rest))
            else:
                half, _ = self.back(symbol, k - 1, rest)
                first, middle = self.unroll(symbol, k - 1, state, half)
                second, last = self.unroll(symbol, k - 1, middle, rest)
                known = first + second, last
            if k <= 10:
                if len(self.memo) >= STEP_MEMO:
                    self.memo.clear()
                self.memo[key] = known
        return known

    def choose(self, symbol: int, state: int, rest: np.ndarray) -> tuple[str, int]:
        """The edit of one row, with the inserts before it."""
        role, fault = divmod(symbol, 4)
        cost = (self.power(symbol, 0) + rest).min(axis=1)
        letters = ""
        while True:
            if 2 + rest[state] == cost[state]:
                return letters + "D", state
            if 5 + cost[NEXT[state]] == cost[state]:
                letters, state = letters + "I", NEXT[state]
                continue
            stay = 5 if fault == TRUNCATED else 0
            kept = kept_state(state, role)
            if kept is not None and stay + rest[kept] == cost[state]:
                return letters + "K", kept
            return letters + "R", NEXT[state]


def marked(df: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, turn, role and text with the order of rows of one turn (p, h); `copies` says how
    often a row counts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return df.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies")).select(
        "*", F.substring("text", 1, 64).alias("p"),
        F.md5(F.concat(F.col("role"), F.lit("\x00"), F.col("text")).cast("binary")).alias("h"))


def damaged(df: DataFrame) -> DataFrame:
    """Rows with the faults the query plants, by a checksum of conversation and turn: dropped
    (copies 0), emptied, without end marks, repeated (copies 2) or spoken by the user."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    changed = df.select(
        "conv_id", "turn", code.alias("code"),
        F.when(code == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"))
    return marked(changed, F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1))


def symbols(rows: DataFrame) -> DataFrame:
    """Different rows without their texts: order, number of copies, symbol of the first one."""
    rest = F.rtrim("text", F.lit(BLANKS))
    role = F.substring("role", 1, 1)
    fault = F.when(rest == "", BLANK) \
        .when(F.substring(rest, -1, 1).isin(*".!?"), OK).otherwise(TRUNCATED)
    kinds = rows.where(F.col("copies") > 0).select(
        "conv_id", "turn", "role", "p", "h", "copies",
        (F.coalesce(F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2), F.lit(3))
         * 4 + fault).alias("symbol"))
    kinds = kinds.groupBy("conv_id", "turn", "role", "p", "h", "symbol").agg(
        F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = kinds.groupBy(F.col("conv_id").alias("_c"), F.col("h").alias("_h")).agg(
        F.min(place).alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    later = F.coalesce(place != F.col("_first"), F.lit(False)) & (F.col("symbol") % 4 != BLANK)
    return kinds.join(again, F.col("conv_id").eqNullSafe(F.col("_c"))
                      & (F.col("h") == F.col("_h")), "left").select(
        "conv_id", "turn", "role", "p", "h", "copies",
        F.when(later, F.col("symbol") - F.col("symbol") % 4 + DUPLICATE)
        .otherwise(F.col("symbol")).alias("symbol"))


def runs(kinds: DataFrame) -> DataFrame:
    """Runs of equal symbols, in pieces: conv_id, piece, part, symbols, lengths."""
    order = ["conv_id", "turn", "role", "p", "h"]
    kind = kinds.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind),
                           *T.StructType.fromDDL("piece int, part int, symbols binary, "
                                                 "lengths array<bigint>").fields])
    types = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, part, conv, found, counts = TaskContext.get().partitionId(), 0, None, [], []
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = to_batch({f.name: [row[i] for row in done] for i, f in enumerate(schema)}, types)
            done.clear()
            return out

        for rows in batches:
            columns = (rows.column(c).to_pylist() for c in ("conv_id", "symbol", "copies"))
            for key, symbol, n in zip(*columns):
                if found and (key != conv or len(found) >= RUNS_PER_ROW):
                    done.append((conv, piece, part, bytes(found), counts))
                    part, found, counts = part + 1 if key == conv else 0, [], []
                conv = key
                first = symbol if symbol % 4 == BLANK else symbol - symbol % 4 + DUPLICATE
                for s, times_ in ((symbol, 1), (first, n - 1)):
                    if times_ and found and found[-1] == s:
                        counts[-1] += times_
                    elif times_:
                        found.append(s)
                        counts.append(times_)
            if len(done) >= 1000 or sum(len(d[3]) for d in done) >= RUNS_PER_ROW:
                yield batch()
        if found:
            done.append((conv, piece, part, bytes(found), counts))
        if done:
            yield batch()

    dealt = kinds.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "symbol", "copies").mapInArrow(work, schema)


def solved(pieces: DataFrame) -> DataFrame:
    """Per conversation: numbers of faults, cost, audit."""
    kind = pieces.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(
        "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
        "audit string").fields])
    types = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for rows in batches:
            out = []
            for conv, parts in zip(rows.column("conv_id").to_pylist(), rows.column("parts")):
                parts = parts.as_py()
                found = np.frombuffer(b"".join(p["symbols"] for p in parts), np.uint8)
                counts = np.concatenate([np.asarray(p["lengths"], np.int64) for p in parts])
                faults = [int(counts[found % 4 == f].sum()) for f in (BLANK, DUPLICATE, TRUNCATED)]
                roles = found // 4
                fits = np.isin(roles[:-1] * 4 + roles[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
                illegal = int((counts - 1).sum() + (~fits).sum())
                out.append((conv, *faults, illegal, *solver.solve(found, counts)))
            yield to_batch({f.name: [r[i] for r in out] for i, f in enumerate(schema)}, types)

    parts = F.array_sort(F.collect_list(F.struct("piece", "part", "symbols", "lengths")))
    small_batches(pieces.sparkSession)
    # few bytes, much work: as many tasks as a shuffle has, not as its bytes would fill
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, "conv_id").groupBy("conv_id").agg(parts.alias("parts")).mapInArrow(work, schema)


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation that occurs: gaps, faults, cost and audit."""
    there = F.when(F.col("copies") > 0, F.col("turn"))
    told = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.coalesce(
        F.max(there) - F.min(there) + 1 - F.countDistinct(there), F.lit(0)).cast("long")
        .alias("gaps"))
    numbers = ("blank", "duplicate", "truncated", "illegal", "cost")
    return told.join(solved(runs(symbols(rows))), F.col("_c").eqNullSafe(F.col("conv_id")),
                     "left").select(
        F.col("_c").alias("conv_id"), "gaps",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"))


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _in_order(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one task per conversation."""
    texts = rows.where(F.col("copies") > 0).select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "p", "h", "copies", "text",
        F.lit(None).cast("string").alias("audit"),
        F.array().cast("array<bigint>").alias("numbers"))
    heads = edits.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType)
        .alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "p", "h")],
        F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("text"),
        "audit", F.array(*NUMBERS).alias("numbers"))
    small_batches(rows.sparkSession)
    return heads.union(texts).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "turn", "role", "p", "h").drop("p", "h", "turn")


def _walk(batches: Iterator[pa.RecordBatch]):
    """(conv_id, audit, numbers) at the start of a conversation, then its lines that stay as
    (edit, role, text), then None."""
    audit, at, state = "", 0, 0

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield "I", "assistant" if state == 2 else "user", ""
            state, at = NEXT[state], at + 1

    started = False
    for rows in batches:
        names = ("conv_id", "kind", "role", "copies", "text", "audit", "numbers")
        for i in range(rows.num_rows):
            conv, kind, role, copies, text, letters, numbers = (
                rows.column(c)[i].as_py() for c in names)
            if kind == 0:
                if started:
                    yield from inserts()
                    yield None
                audit, at, state, started = letters, 0, 0, True
                yield conv, letters, numbers
                continue
            for _ in range(copies):
                yield from inserts()
                edit, at = audit[at], at + 1
                if edit == "R":
                    yield edit, "assistant" if state == 2 else "user", text
                    state = NEXT[state]
                elif edit == "K":
                    yield edit, role, text
                    state = kept_state(state, ROLES.index(role[0]))
    if started:
        yield from inserts()
        yield None


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The audits with the SHA-256 of the repaired `role:text` lines."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(
        ", ".join(f"{c} bigint" for c in NUMBERS)
        + ", audit string, repaired_sha256 string").fields])
    types = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        head = digest = None
        lines = 0
        for step in _walk(batches):
            if step is None:
                out.append((head[0], *head[2], head[1], digest.hexdigest()))
                head, size = None, size + len(out[-1][-2])
                if len(out) >= 1000 or size >= 1 << 20:
                    yield to_batch({f.name: [r[i] for r in out]
                                    for i, f in enumerate(schema)}, types)
                    out, size = [], 0
            elif head is None:
                head, digest, lines = step, hashlib.sha256(), 0
            else:
                digest.update((b"\n" if lines else b"") + f"{step[1]}:{step[2]}".encode())
                lines += 1
        if out:
            yield to_batch({f.name: [r[i] for r in out] for i, f in enumerate(schema)}, types)

    return _in_order(rows, edits).mapInArrow(work, schema)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), edit, role, text."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(
        "place bigint, edit string, role string, text string").fields])
    types = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, head, place = [], 0, None, 0
        for step in _walk(batches):
            if step is None:
                head = None
            elif head is None:
                head, place = step, 0
            else:
                place += 1
                out.append((head[0], place, *step))
                size += len(step[2])
                if len(out) >= 1000 or size >= 1 << 20:
                    yield to_batch({f.name: [r[i] for r in out]
                                    for i, f in enumerate(schema)}, types)
                    out, size = [], 0
        if out:
            yield to_batch({f.name: [r[i] for r in out] for i, f in enumerate(schema)}, types)

    return _in_order(rows, edits).mapInArrow(work, schema)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits of conversations as they are, and the repaired rows."""
    rows = marked(conversations)
    edits = audits(rows)
    return edits, repaired(rows, edits)
