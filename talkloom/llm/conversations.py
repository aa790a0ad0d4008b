"""Conversation structure repair: cheapest edits to system? (user assistant)*, by dynamic programming over runs."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from talkloom.llm.support import small_batches, stored, table

#: Costs of edits; a kept row that is cut off costs CUT_OFF more.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Rows of a run whose choices are unrolled together.
STRETCH = 1024
BLANKS = " \t\n\v\f\r"
ENDS = (".", "!", "?")
#: What a symbol tells of a row: its role's initial (or another), and whether it is sound, cut off or to be deleted.
ROLES, SOUND, BROKEN, GONE = ("s", "u", "a", ""), 0, 1, 2
#: States: nothing said, after the system's row, after a user's, after an assistant's. Where a role leads from each.
STATES = range(4)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state that the only possible row of a user or assistant leads to.
ON = tuple(x.get("u", x.get("a")) for x in NEXT)
NEVER = float("inf")
Matrix = tuple[tuple[float, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def _apply(a: Matrix, v: tuple[float, ...]) -> tuple[float, ...]:
    return tuple(min(a[i][k] + v[k] for k in STATES) for i in STATES)


def row_edits(symbol: int, state: int) -> list[tuple[str, float, int]]:
    """The edits of a row in a state, in the order of their letters: letter, cost, state after it."""
    role, fault = ROLES[symbol // 3], symbol % 3
    found: list[tuple[str, float, int]] = [("D", DELETE, state)]
    if fault != GONE:
        more = CUT_OFF if fault == BROKEN else 0
        if role in NEXT[state]:
            found.append(("K", more, NEXT[state][role]))
        found.append(("R", REROLE + more, ON[state]))
    return found


def _inserts() -> Matrix:
    """Cheapest insertions between two states; more than two in a row lead nowhere new."""
    once = tuple(tuple(0 if i == j else INSERT if ON[i] == j else NEVER for j in STATES) for i in STATES)
    return _times(once, once)


#: What it costs to end in each state: a user's row has to be answered, and a system's row needs a pair.
AT_END = _apply(_inserts(), (0, NEVER, NEVER, 0))


@functools.cache
def power(symbol: int, k: int) -> Matrix:
    """The transition of 2 ** k rows of a symbol: each is preceded by insertions and then edited."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    edits = [[NEVER] * 4 for _ in STATES]
    for state in STATES:
        for _, cost, after in row_edits(symbol, state):
            edits[state][after] = min(edits[state][after], cost)
    return _times(_inserts(), tuple(map(tuple, edits)))


def before_run(symbol: int, n: int, after: tuple[float, ...]) -> tuple[float, ...]:
    """Costs to go from each state before n rows of a symbol, given those behind them, by binary powers."""
    k = 0
    while n:
        if n & 1:
            after = _apply(power(symbol, k), after)
        n, k = n >> 1, k + 1
    return after


def cheapest_edits(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """The least cost of repairing a conversation of runs (symbol, rows), and the ASCII-least of its edits' initials.

    Runs are crossed backwards by powers of their transition; what is kept is the cost to go before each stretch of
    them. Then choices are unrolled forwards: in each state a letter leads to one other only, so the least letter that
    keeps to the least cost is right.
    """
    stretches = [(s, min(STRETCH, n - at)) for s, n in runs for at in range(0, n, STRETCH)]
    ahead = [AT_END]
    for symbol, n in reversed(stretches):
        ahead.append(before_run(symbol, n, ahead[-1]))
    ahead.reverse()
    state, letters = 0, []
    for (symbol, n), behind in zip(stretches, ahead[1:]):
        one = power(symbol, 0)
        costs = [behind]
        for _ in range(n):
            costs.append(_apply(one, costs[-1]))
        for here, after in zip(costs[:0:-1], costs[-2::-1]):
            while True:
                edits = [(x, c + after[q], q) for x, c, q in row_edits(symbol, state)]
                edits.append(("I", INSERT + here[ON[state]], ON[state]))
                letter, _, state = min(e for e in edits if e[1] == here[state])
                letters.append(letter)
                if letter != "I":
                    break
    letters.append("I" * (int(AT_END[state]) // INSERT))
    return int(ahead[0][0]), "".join(letters)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a conversation table with faults put in, by a checksum of conversation and turn: of
    twenty rows one is dropped, emptied, robbed of .!?, repeated, or said by the user. A null role or text is a space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(space("text"), "".join(ENDS), "")).otherwise(space("text"))
    rows = df.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def with_symbols(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with at, their place from 0 by turn (nulls first, then role and text), their fault
    (blank, duplicate, truncated or null), whether they follow their predecessor illegally, and their symbol."""
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    initial = F.substring(F.coalesce("role", F.lit("")), 1, 1)
    placed = rows.withColumns({
        "at": F.row_number().over(in_order) - 1, "pair": F.concat(F.lag(initial).over(in_order), initial),
    })
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("at")) > 1
    said = F.rtrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))
    fault = F.when(said == "", "blank").when(F.col("seen"), "duplicate").when(~F.substring(said, -1, 1).isin(*ENDS), "truncated")
    marked = placed.withColumn("seen", seen).withColumn("fault", fault)
    kind = F.when(F.col("fault").isNull(), SOUND).when(F.col("fault") == "truncated", BROKEN).otherwise(GONE)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    illegal = F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False))
    return marked.select(
        "conv_id", "turn", F.col("at").cast("long").alias("at"), "role", "text", "fault", illegal.alias("illegal"), (role * 3 + kind).alias("symbol")
    )


def symbol_runs(rows: DataFrame) -> DataFrame:
    """conv_id, start, symbol, n: runs of equal symbols."""
    island = F.col("at") - F.row_number().over(Window.partitionBy("conv_id", "symbol").orderBy("at"))
    runs = rows.select("conv_id", "at", "symbol").withColumn("island", island).groupBy("conv_id", "symbol", "island")
    return runs.agg(F.min("at").alias("start"), F.count("*").alias("n")).drop("island")


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def edits_of(runs: DataFrame) -> DataFrame:
    """conv_id, cost, audit of conversations given as runs (conv_id, start, symbol, n)."""

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, []

        def done() -> pa.RecordBatch:
            cost, audit = cheapest_edits(held)
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], ids), "cost": pa.array([cost], pa.int64()), "audit": [audit]})

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for key, symbol, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "symbol", "n"))):
                if held and key != conv:
                    yield done()
                    held = []
                conv = key
                held.append((symbol, n))
        if held:
            yield done()

    kind = dict(runs.dtypes)["conv_id"]
    return _in_order(runs, "start").mapInArrow(edited, f"conv_id {kind}, cost long, audit string")


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit (K, R or I): the repaired conversations in order, partitions by conversation.

    Each conversation's edits come first in its partition, then its rows, which stream by: one is held at a time.
    """
    head = edits.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    kind = dict(rows.dtypes)["conv_id"]
    names = {2: "user", 3: "assistant"}

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, step, state, place = "", 0, 0, 0
        for batch in batches:
            out: list[tuple] = []

            def insert(key: object) -> None:
                nonlocal step, state, place
                while step < len(audit) and audit[step] == "I":
                    state = ON[state]
                    out.append((key, place, names[state], "", "I"))
                    step, place = step + 1, place + 1

            for key, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "text"))):
                if at < 0:
                    audit, step, state, place = text, 0, 0, 0
                    insert(key)
                    continue
                edit = audit[step]
                step += 1
                if edit != "D":
                    state = ON[state] if edit == "R" else NEXT[state][role[:1]]
                    out.append((key, place, names[state] if edit == "R" else role, text, edit))
                    place += 1
                insert(key)
            columns = list(zip(*out)) or [()] * 5
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "place", "role", "text", "edit"])

    met = _in_order(rows.select("conv_id", "at", "role", "text").union(head), "at")
    return met.mapInArrow(applied, f"conv_id {kind}, place long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of `role:text` lines of repaired_rows(), taken as they stream by."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            ids = batch.schema.field("conv_id").type
            done: list[tuple] = []
            for key, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = key, hashlib.sha256()
                digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], ids), pa.array([x[1] for x in done], pa.string())], ["conv_id", "sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conv], ids), pa.array([digest.hexdigest()])], ["conv_id", "sha256"])

    return repaired.mapInArrow(hashed, f"conv_id {dict(repaired.dtypes)['conv_id']}, sha256 string")


def repair_report(df: DataFrame, every: DataFrame) -> DataFrame:
    """A row for each conversation of every (conv_id): its faults, the cheapest edits that leave role initials
    (s?(ua)+)?, and a digest of what they leave.

    df holds conv_id, turn, role, text. gaps counts turns missing between the least and the greatest; blank, duplicate
    and truncated count rows by their first fault, illegal those whose initial may not follow that before. Null turns
    come first and leave no gap; rows of one turn go by role and text; a null role or text is empty; a null conv_id is
    a conversation of its own. A conversation without rows has zeros, no edits and the digest of the empty text.
    Symbols and edits of one conversation are held by one task, its texts are not: they stream by.
    """
    small_batches(df.sparkSession)
    plain = df.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    rows = stored(with_symbols(plain), "symbols")
    edits = stored(edits_of(symbol_runs(rows)), "edits")
    marks = digests(repaired_rows(rows, edits))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    of = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    # Turns are made distinct first, so that a long conversation's are no set in one row.
    turns = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")
    )
    faults = rows.groupBy("conv_id").agg(*map(of, ("blank", "duplicate", "truncated")), F.count(F.when(F.col("illegal"), 1)).alias("illegal"))
    known = every.select("conv_id").distinct()
    for part in (turns, faults, edits, marks):
        known = known.unionByName(part, allowMissingColumns=True)
    return known.groupBy("conv_id").agg(
        *(whole(F.max(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)
