"""Conversation structure repair by target alignment (operator 11).

A repaired conversation's role initials follow the grammar ``(s?(ua)+)?``.  Rows
may be kept (0), reroled to user or assistant (1) or deleted (2), and empty
user or assistant turns inserted (5); blank and duplicate rows must go, a
truncated row that stays costs 5 more.

The grammar has one string of each length from one state to another, all
alternating.  ``align`` takes each feasible length, the nearest to the number of rows
first, and fills a Wagner-Fischer table of rows against that string.  The
incumbent cost bounds how far a path may leave the diagonal (Ukkonen's band)
and which lengths are worth a table at all; among equal costs the backtraced
audit that sorts first wins.

Rows are sorted over the cluster and cut into pieces of at most ``PIECE`` rows.  A
conversation in one piece is aligned from start to end.  One in more pieces has
each piece aligned between all states; folds over the pieces' costs, from
the last to the first and back, choose the states at the cuts.  A piece ends
with a row's edit (inserts belong to the next row), so no audit of a piece is the beginning
of another one and comparing piece by piece compares whole audits.  No task holds the
texts of a conversation: rows meet their edits by row number, and digests read
sorted rows one after another.

Results for odd input: a null role or text counts as one space; a null
conv_id is a conversation of its own; null turns come first; rows of one turn
are ordered by role and text; repeated rows are duplicates; texts may have any
length; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.shared import dropped, staged, table

PIECE = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, or the initial that came last.
STATES = "0sua"
#: Cost and audit that end a conversation after its last row.
ENDS = {"0": (0, ""), "a": (0, ""), "u": (INSERT, "I"), "s": (2 * INSERT, "II")}
_FAR = 1 << 40
SPACE = " \t\n\x0b\x0c\r"


def target(begin: str, end: str, length: int) -> str | None:
    """The grammar's only string of ``length`` initials between two states."""
    if length == 0:
        return "" if begin == end else None
    if end == "s":
        return "s" if begin == "0" and length == 1 else None
    if end == "0":
        return None
    string = ("ua" if end == "a" else "au") * (length // 2 + 1)
    string = string[-length:]
    if begin == "0" and string[0] == "a" and length > 1:
        return "s" + string[1:]
    return string if string[0] == ("a" if begin == "u" else "u") else None


def align(rows: str, to: str, most: int) -> tuple[int, str] | None:
    """Least cost, up to ``most``, and first audit of turning rows into ``to``
    without an insert after the last row.

    A row is two characters: its initial (``s``, ``u``, ``a``, else ``-``) and
    ``x`` if it must go, ``t`` if it is truncated, ``.`` otherwise.
    """
    n, m = len(rows) // 2, len(to)
    gone = [0]
    for i in range(n):
        gone.append(gone[-1] + (rows[2 * i + 1] == "x"))
    slack, apart = most - DELETE * gone[n], m - (n - gone[n])
    if (INSERT * apart if apart > 0 else -DELETE * apart) > slack:
        return None
    # leaving the diagonal by x and coming back to the corner costs at least 7 more for each step beyond it
    low, high = -((slack - INSERT * apart) // (INSERT + DELETE)), (slack + DELETE * apart) // (INSERT + DELETE)
    cost = [dict() for _ in range(n + 1)]
    cost[n][m] = 0
    for i in range(n - 1, -1, -1):
        diagonal, below, here = i - gone[i], cost[i + 1], cost[i]
        initial, fault = rows[2 * i], rows[2 * i + 1]
        more = TRUNCATED if fault == "t" else 0
        for j in range(min(m, diagonal + high), max(0, diagonal + low) - 1, -1):
            best = DELETE + below.get(j, _FAR)
            if j < m:
                t = to[j]
                if t != "s":
                    best = min(best, INSERT + here.get(j + 1, _FAR))
                if fault != "x" and (initial == t or t != "s"):
                    best = min(best, (KEEP if initial == t else REROLE) + more + below.get(j + 1, _FAR))
            if best <= most:
                here[j] = best
    if 0 not in cost[0]:
        return None
    i = j = 0
    audit = []
    while i < n:  # of the edits that keep the cost, the one that sorts first: D, I, K, R
        left, t = cost[i][j], to[j] if j < m else ""
        more = TRUNCATED if rows[2 * i + 1] == "t" else 0
        if DELETE + cost[i + 1].get(j, _FAR) == left:
            audit.append("D")
            i += 1
        elif t and t != "s" and INSERT + cost[i].get(j + 1, _FAR) == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if rows[2 * i] == t and KEEP + more + cost[i + 1].get(j + 1, _FAR) == left else "R")
            i, j = i + 1, j + 1
    return cost[0][0], "".join(audit)


def _lengths(n: int, most: int) -> list[int]:
    """Lengths that ``most`` can reach from n rows, the cheapest first."""
    reach = range(max(0, n - most // DELETE), n + most // INSERT + 1)
    return sorted(reach, key=lambda m: INSERT * (m - n) if m > n else DELETE * (n - m))


@lru_cache(50_000)
def whole(rows: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    n = len(rows) // 2
    best = DELETE * n, "D" * n
    for m in _lengths(n, best[0]):
        for end, (cost, audit) in ENDS.items():
            to = target("0", end, m)
            found = to is not None and align(rows, to, best[0] - cost)
            if found:
                best = min(best, (found[0] + cost, found[1] + audit))
    return best


def between(rows: str) -> dict[tuple[str, str], tuple[int, str]]:
    """Least cost and first audit of a piece from each state to each state."""
    n, out = len(rows) // 2, {}
    for begin in STATES:
        for end in STATES:
            most = DELETE * n + 2 * INSERT  # delete all after at most two inserts
            for m in _lengths(n, most):
                to = target(begin, end, m)
                found = to is not None and align(rows, to, min(most, out.get((begin, end), (most,))[0]))
                if found and found < out.get((begin, end), (_FAR,)):
                    out[begin, end] = found
    return out


def chosen(pieces: list[dict[tuple[str, str], tuple[int, str]]]) -> tuple[int, list[tuple[str, str]]]:
    """Cost of a conversation, and (state before, audit) of each of its pieces."""
    after = [{q: ENDS[q][0] for q in STATES}]
    for piece in reversed(pieces):
        after.append({p: min([c + after[-1][q] for (b, q), (c, _) in piece.items() if b == p], default=_FAR) for p in STATES})
    after.reverse()
    state, out = "0", []
    for piece, later in zip(pieces, after[1:]):
        _, audit, end = min((c + later[q], a, q) for (b, q), (c, a) in piece.items() if b == state)
        out.append((state, audit))
        state = end
    out[-1] = out[-1][0], out[-1][1] + ENDS[state][1]
    return after[0]["0"], out


def edits(rows: str, state: str, audit: str) -> list[tuple[str, str, str, str]]:
    """Per row: initials inserted before it, its edit, its initial then, initials
    inserted after it (only after the last row)."""
    out, before = [], ""
    for edit in audit:
        turn = "a" if state == "u" else "u"
        if edit == "I":
            before, state = before + turn, turn
        elif edit == "D":
            out.append((before, "D", "", ""))
            before = ""
        else:
            state = rows[2 * len(out)] if edit == "K" else turn
            out.append((before, edit, state, ""))
            before = ""
    if before:
        out[-1] = (*out[-1][:3], before)
    return out


def ordered(conversations: DataFrame) -> DataFrame:
    """Staged rows in order: conv_id, turn, role, text, ``at`` (their order over
    all tasks), ``run`` and ``i`` (the task and the row's place among the conversation's rows in it)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    key = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33).cast("int"))
    schema = T.StructType([*rows.schema, T.StructField("i", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, any_yet = None, 0, False
        for batch in batches:
            place = np.empty(batch.num_rows, np.int64)
            for k, conv in enumerate(batch.column(0).to_pylist()):
                count = count + 1 if any_yet and conv == last else 0
                last, any_yet, place[k] = conv, True, count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "i"])

    return staged(rows.mapInArrow(number, schema), "repair-rows")


def with_faults(rows: DataFrame) -> DataFrame:
    """Staged (at, conv_id, run, i, turn, initial, fault); fault is the row's
    first of blank, duplicate, truncated."""
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    ends = ~F.substring(said, -1, 1).isin(".", "!", "?")
    first = F.substring("role", 1, 1)
    known = rows.select("at", "conv_id", "run", "i", "turn", F.when(first.isin("s", "u", "a"), first).otherwise("-").alias("initial"),
                        (said == "").alias("blank"), ends.alias("open"),
                        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"))
    known = staged(known, "repair-known")
    # the first row of each saying, found with partial sums; rows meet it by their own number
    first_at = known.groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("open"), "truncated")
    out = staged(known.join(first_at, "at", "left").select("at", "conv_id", "run", "i", "turn", "initial", fault.alias("fault")), "repair-faults")
    dropped(known)
    return out


def aligned(faults: DataFrame) -> DataFrame:
    """Staged audits per piece: conv_id, at (of its first row), rows (their
    codes), state (before it), audit, cost (of the conversation, in its first
    piece; 0 in others), illegal."""
    code = F.concat("initial", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("."))
    # pandas has no integers with nulls: ids pass it as text, a null as none
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    pieces = faults.groupBy(conv.alias("conv"), "run", F.floor(F.col("i") / PIECE).alias("piece")).agg(
        F.min("at").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", code.alias("c")))), lambda x: x["c"]), "").alias("rows"))
    cut = pieces = staged(pieces, "repair-pieces")
    pieces = pieces.join(pieces.groupBy("conv").agg((F.count("*") > 1).alias("many")), "conv")

    def illegal(rows: str) -> int:
        return sum(rows[k] + rows[k + 2] not in ("su", "ua", "au") for k in range(0, len(rows) - 2, 2))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            got = [whole(r) for r in part["rows"]]
            yield part[["conv", "at", "rows"]].assign(state="0", audit=[a for _, a in got], cost=[c for c, _ in got], illegal=part["rows"].map(illegal))

    def costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part[["conv", "at", "rows"]].assign(
                paths=[[{"begin": b, "end": e, "cost": c, "audit": a} for (b, e), (c, a) in between(r).items()] for r in part["rows"]])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        cost, chain = chosen([{(x["begin"], x["end"]): (x["cost"], x["audit"]) for x in paths} for paths in group["paths"]])
        # a pair of rows across a cut counts with the later piece
        before = group["rows"].str[-2:].shift(fill_value="")
        return group[["conv", "at", "rows"]].assign(
            state=[s for s, _ in chain], audit=[a for _, a in chain], cost=[cost] + [0] * (len(group) - 1), illegal=(before + group["rows"]).map(illegal))

    schema = "conv string, at long, rows string, state string, audit string, cost long, illegal long"
    one = pieces.filter("not many").mapInPandas(solve, schema)
    many = staged(pieces.filter("many").repartition("conv", "at").mapInPandas(
        costs, "conv string, at long, rows string, paths array<struct<begin:string,end:string,cost:long,audit:string>>"), "repair-costs")
    both = one.unionByName(many.groupBy("conv").applyInPandas(fold, schema))
    out = staged(both.select(F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), "at", "rows", "state", "audit", "cost", "illegal"), "repair-audits")
    dropped(many, cut)
    return out


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Edited rows: conv_id, at, sub (order), edit, role, text.  Deleted rows
    are among them with their edit ``D``."""
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [(at + k, *e) for at, *x in zip(part["at"], part["rows"], part["state"], part["audit"]) for k, e in enumerate(edits(*x))]
            yield pd.DataFrame(out, columns=["at", "before", "edit", "now", "after"])

    by_row = audits.select("at", "rows", "state", "audit").mapInPandas(spread, "at long, before string, edit string, now string, after string")
    role = lambda c: F.when(c == "u", "user").otherwise("assistant")
    empty = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(
        F.lit("I").alias("edit"), role(x).alias("role"), F.lit("").alias("text")))
    own = F.struct("edit", F.when(F.col("edit") == "R", role(F.col("now"))).otherwise(F.col("role")).alias("role"), "text")
    return rows.join(by_row, "at").select("conv_id", "at", F.posexplode(F.concat(empty(F.col("before")), F.array(own), empty(F.col("after")))).alias("sub", "x")).select(
        "conv_id", "at", "sub", "x.*")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, rows).  The summary has conv_id, gaps, blank, duplicate,
    truncated, illegal and cost of each conversation; the rows are those of ``repaired``."""
    rows = ordered(conversations)
    faults = with_faults(rows)
    audits = aligned(faults)
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = faults.groupBy("conv_id").agg(gaps.alias("gaps"), *map(count, ("blank", "duplicate", "truncated")))
    totals = audits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    summary = counts.alias("c").join(totals.alias("t"), F.col("c.conv_id").eqNullSafe(F.col("t.conv_id"))).select("c.*", "illegal", "cost")
    return summary, repaired(rows, audits)


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): sorted rows are read one after another,
    so a task keeps one digest and one audit at a time."""
    rows = edited.select("conv_id", "at", "sub", "edit", F.when(F.col("edit") != "D", F.concat_ws(":", "role", "text")).alias("line"))
    # one conversation's rows in one task and in order: its digest can't be computed apart
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "sub").select("conv_id", "edit", "line")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # conv_id, audit, digest, whether a line came
        for batch in batches:
            done = []
            for conv, edit, line in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, bytearray(), hashlib.sha256(), False]
                now[1] += edit.encode()
                if line is not None:
                    now[2].update(("\n" * now[3] + line).encode())
                    now[3] = True
            yield result(done)
        if now is not None:
            yield result([now])

    def result(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1].decode() for x in done], pa.string()),
                                           pa.array([x[2].hexdigest() for x in done], pa.string())], ["conv_id", "audit", "repaired_sha256"])

    return rows.mapInArrow(read, "conv_id long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32('conv_id:turn') % 20``; nulls become one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def op11_target_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    summary, rows = repair(damaged(given))
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    found = given.select("conv_id").distinct().alias("g").join(summary.alias("s"), same("g", "s"), "left").join(digests(rows).alias("d"), same("g", "d"), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select("g.conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
