"""Conversation structure repair: damage for tests, faults, and Wagner-Fischer alignment to an alternating grammar.

A repaired conversation's role initials read ``(s?(ua)+)?``. Turns are aligned to the grammar's string of
each length that can still be cheapest, inside a band that the best cost so far allows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
FAR = 1 << 29
BLANKS = " \t\n\x0b\x0c\r"
EXTRA = pa.list_(pa.struct([("pos", pa.int32()), ("nth", pa.int32()), ("role", pa.string())]))


class Alignment:
    """Suffix costs of ``turns`` against the last m letters of ``...uaua``, for all m in a band.

    A turn is its role's initial ("o" for other roles), in upper case if truncated, or "d" if it must go.

    The strings of all lengths share their ends, so one table serves them all; a leading "s" takes a
    column of costs for each length besides. Row i, column k stands for m = k + (turns from i on that
    may stay) - deletions: a path that deletes or inserts more than the band's width cannot be cheaper
    than the incumbent. Quadratic in turns only as far as faults widen the band.
    """

    def __init__(self, turns: str, deletions: int, insertions: int):
        deletions += 1  # a leading "s" is a letter more than m tells
        n, width = len(turns), deletions + insertions + 1
        self.turns, self.deletions, self.n = turns, deletions, n
        self.left = [0] * (n + 1)  # turns from i on that may stay
        for i in range(n - 1, -1, -1):
            self.left[i] = self.left[i + 1] + (turns[i] != "d")
        column = np.arange(width)
        step = INSERT * column
        self.plain = np.full((n + 1, width), FAR, np.int64)
        self.headed = np.full((n + 1, width), FAR, np.int64)  # an "s" comes before the m letters
        self.plain[n] = np.where(column >= deletions, INSERT * (column - deletions), FAR)
        for i in range(n - 1, -1, -1):
            below, head = self.plain[i + 1], self.headed[i + 1]
            m = column - deletions + self.left[i]
            turn = turns[i]
            if turn == "d":
                row, top = below + DELETE, head + DELETE
            else:
                row, top = np.full(width, FAR), np.full(width, FAR)
                row[:-1], top[:-1] = below[1:] + DELETE, head[1:] + DELETE
                fixed = CUT_OFF if turn.isupper() else 0
                initial = turn.lower()
                change = np.where(m % 2 == 0, initial != "u", initial != "a") * REROLE
                row = np.minimum(row, np.where(m > 0, below + change + fixed, FAR))
                if initial == "s":  # keeps the m letters, so the column moves by one
                    top[:-1] = np.minimum(top[:-1], below[1:] + fixed)
            row = np.where(m >= 0, row, FAR)
            self.plain[i] = np.minimum(FAR, np.minimum.accumulate(row - step) + step)
            self.headed[i] = np.minimum(FAR, top)

    def _at(self, table: np.ndarray, i: int, m: int) -> int:
        k = m - self.left[i] + self.deletions
        return int(table[i, k]) if m >= 0 and 0 <= k < table.shape[1] else FAR

    def lengths(self):
        """(cost, m, headed) for each length of the grammar's string within the band."""
        for k in range(self.plain.shape[1]):
            m = k - self.deletions + self.left[0]
            if m >= 0 and m % 2 == 0:
                yield int(self.plain[0, k]), m, False
                if m:
                    yield int(self.headed[0, k]), m, True

    def audit(self, m: int, headed: bool) -> str:
        """The ASCII-least cheapest edits for that string, from the front: a letter leads to one cell, so the least letter is right."""
        i, out = 0, []
        while i < self.n or m > 0:
            if headed:
                turn = self.turns[i]
                if self._at(self.headed, i + 1, m) + DELETE == self._at(self.headed, i, m):
                    out.append("D")
                else:
                    headed = False
                    out.append("K")
                i += 1
                continue
            here = self._at(self.plain, i, m)
            if i < self.n and self._at(self.plain, i + 1, m) + DELETE == here:
                out.append("D")
                i += 1
            elif m and self._at(self.plain, i, m - 1) + INSERT == here:
                out.append("I")
                m -= 1
            else:
                turn = self.turns[i].lower()
                out.append("K" if turn == "au"[m % 2 == 0] else "R")
                i, m = i + 1, m - 1
        return "".join(out)


def align(turns: str) -> tuple[int, str, bool]:
    """Least cost, its ASCII-least audit, and whether the repaired conversation begins with a system turn.

    The band comes from the incumbent: at first a few deletions beside those of truncated turns, then
    every number of deletions and insertions that its cost leaves possible.
    """
    must = turns.count("d")
    broken = sum(t.isupper() for t in turns)
    may = len(turns) - must

    def least(deleted: int) -> int:
        return DELETE * (must + deleted) + CUT_OFF * max(0, broken - deleted)

    deletions, insertions = min(may, broken + 3), 0
    while True:
        table = Alignment(turns, deletions, insertions)
        found = list(table.lengths())
        cost = min([c for c, _, _ in found] + [DELETE * len(turns)])
        most = max((d for d in range(may + 1) if least(d) <= cost), default=0)
        inserted = max(0, (cost - min(least(d) for d in range(may + 1))) // INSERT)
        if most <= deletions and inserted <= insertions:
            break
        deletions, insertions = max(most, deletions), max(inserted, insertions)
    audit, headed = min((table.audit(m, h), h) for c, m, h in found if c == cost)
    return cost, audit, headed


def edits(turns: str) -> tuple[int, str, str, list[dict]]:
    """Cost, audit, a letter for each turn ("-" deleted, "k" kept, "u" or "a" its new role), and the inserted turns.

    An inserted turn has the place of the turn that it comes before, and its number among those that stand there.
    """
    cost, audit, headed = align(turns)
    fate, extra, at, nth = [], [], -headed, 0
    for e in audit:
        role = "ua"[at % 2]
        if e == "I":
            extra.append({"pos": len(fate), "nth": nth, "role": role})
        else:
            fate.append("-" if e == "D" else "k" if e == "K" else role)
        nth = nth + 1 if e == "I" else 0
        at += e != "D"
    return cost, audit, "".join(fate), extra


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy (0, or 1 for the repetition), gone: the rows with faults put in by CRC-32 of ``conv_id:turn``.

    Null role or text counts as one space, and so does a null conv_id or turn in the key. A dropped row stays, marked ``gone``.
    """
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(words("conv_id"), F.lit(":"), words("turn")), "UTF-8")) % 20
    text = words("text")
    return (
        conversations.withColumn("_fault", fault)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_fault") == 4, "user").otherwise(words("role")).alias("role"),
            F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
            (F.col("_fault") == 0).alias("gone"),
        )
    )


def faults(rows: DataFrame) -> DataFrame:
    """The kept rows with pos (from 0, by turn, nulls first), whether their turn is a new one, the role's initial, the one before, and the fault.

    Rows of one turn come in the order of role and text. Duplicates are told by role and text in full.
    """
    by = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    same = W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    visible = F.rtrim(F.col("text"), F.lit(BLANKS))
    kept = rows.filter(~F.col("gone")).withColumn("again", F.row_number().over(same) > 1)
    initial = F.substring("role", 1, 1)
    return kept.select(
        "conv_id",
        "turn",
        "role",
        "text",
        (F.row_number().over(by) - 1).alias("pos"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(by))).alias("fresh"),
        initial.alias("initial"),
        F.lag(initial).over(by).alias("before"),
        F.when(visible == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(visible, -1, 1).isin(".", "!", "?"), "truncated").alias("fault"),
    )


def letter() -> Column:
    """A faulted row as the letter that ``align`` takes."""
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)


def _aligned(batches):
    """Cost, audit, fates and insertions for strings of turns; most conversations share theirs with others of the batch."""
    for batch in batches:
        turns = batch.column("turns").to_pylist()
        known = {t: edits(t) for t in set(turns)}
        found = [known[t] for t in turns]
        out = batch.drop_columns(["turns"])
        for k, (name, kind) in enumerate((("cost", pa.int64()), ("audit", pa.string()), ("fate", pa.string()), ("extra", EXTRA))):
            out = out.append_column(name, pa.array([x[k] for x in found], kind))
        yield out


def _hashed(batches):
    """SHA-256 of the repaired rows of each conversation, from rows in order: no more than a batch is held."""
    held, key, state = False, None, None
    for batch in batches:
        done: list[tuple] = []
        for k, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if not held or k != key:
                if held:
                    done.append((key, state.hexdigest()))
                held, key, state, first = True, k, hashlib.sha256(), True
            if not first:
                state.update(b"\n")
            state.update(piece.encode("utf-8", "surrogatepass"))
            first = False
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def plans(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``faults``'s rows: gaps, fault counts, illegal neighbours, cost, audit, the turns' fates and insertions.

    Of a conversation's rows a place and a letter each come together; texts don't.
    """
    count = lambda c: F.count(F.when(c, 1))
    grouped = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("fresh")), F.lit(0)).alias("gaps"),
        *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter().alias("l")))), lambda x: x["l"]), "").alias("turns"),
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema if f.name != "turns")
    return grouped.mapInArrow(_aligned, f"{kept}, cost bigint, audit string, fate string, extra array<struct<pos: int, nth: int, role: string>>")


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, pos, nth, role, text: the turns of the repaired conversations, in the order of pos and nth.

    A turn's fate meets it by conversation and place, so a long conversation is spread over tasks. Inserted
    turns are empty; their nth is below that of the turn they precede.
    """
    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    fates = planned.select(F.col("conv_id").alias("c"), F.posexplode(F.split("fate", "")).alias("at", "f")).filter("f <> '-'")
    stay = rows.join(fates, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("at")))
    stay = stay.select("conv_id", "pos", F.lit(2**31 - 1).alias("nth"), F.when(F.col("f") == "k", F.col("role")).otherwise(name(F.col("f"))).alias("role"), "text")
    new = planned.select("conv_id", F.inline("extra")).select("conv_id", "pos", "nth", name(F.col("role")).alias("role"), F.lit("").alias("text"))
    return stay.unionByName(new)


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations``, repairs them, and gives the digest row of every original conversation.

    Null conv_ids are one conversation. Repeated rows are duplicates, blank texts are deleted, roles beyond
    the three can only be deleted or get another role. A conversation without rows after damage has zeros, an
    empty audit and the empty string's hash; an empty table gives no rows; other columns are ignored. Texts
    pass the hashing task as a stream: no task holds all texts of a conversation.
    """
    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = materialize(faults(damaged(base)), "turns")
    planned = materialize(plans(rows), "audits")
    pieces = repaired(rows, planned).select("conv_id", "pos", "nth", F.concat("role", F.lit(":"), "text").alias("piece"))
    hashes = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "nth").select("conv_id", "piece").mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string")
    ids = base.select("conv_id").distinct().alias("i")
    out = ids.join(planned.alias("p"), F.col("i.conv_id").eqNullSafe(F.col("p.conv_id")), "left").join(hashes.alias("h"), F.col("i.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("i.conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
