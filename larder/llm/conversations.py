"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed lazily. The input acceptor reads a conversation's rows one after the
other; the edit transducer keeps, reroles or deletes a row or inserts one; the grammar acceptor
takes what comes out. A state of the composition is a position, the insertions made there and a
grammar state, so the composition has no cycles and a backward pass in topological order gives the
cost from each state to the end. Weights are ordered by cost and then by the string of labels: a
forward walk over tight arcs that always takes the least label spells the least string.

Rows are put in order by ranges of (conversation, turn), so that a long conversation is spread over
tasks; faults are found there. What is gathered for a conversation is two signs a row, as long as
its audit. Texts pass through one stream for each conversation, in batches, since a digest of the
repaired text needs them in order.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpoint, parallelism, ship

ship(__name__)

RESPONDENTS = {"u": "user", "a": "assistant"}
#: What ends a whole text, and what counts as a sign of a text at all.
STOPS, SIGN = ".!?", r"[^\x20\x09-\x0D]"

#: The grammar acceptor of (s?(ua)+)?: arcs by state and role initial.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
GRAMMAR = {START: {"s": AFTER_SYSTEM, "u": AFTER_USER}, AFTER_SYSTEM: {"u": AFTER_USER}, AFTER_USER: {"a": AFTER_ASSISTANT}, AFTER_ASSISTANT: {"u": AFTER_USER}}
FINAL = (START, AFTER_ASSISTANT)
#: The edit transducer's costs, and the most insertions in one place: three lead where one does.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
INSERTIONS = 2
_STATES = (INSERTIONS + 1) * len(GRAMMAR)
_FAR = 1 << 60


def arcs(symbol: str | None, inserted: int, state: int) -> Iterator[tuple[str, str, int, int, int]]:
    """Arcs of the composition that leave a state: (label, output, cost, rows read, next state's number).

    ``symbol`` is the row that stands next, its role's initial and its fault (``.`` none, ``b`` blank, ``d`` duplicate,
    ``t`` truncated), or None at the end. Arcs come in the order of their labels.
    """
    if symbol is not None:
        yield "D", "", DELETE, 1, state
    for out in RESPONDENTS:
        if inserted < INSERTIONS and out in GRAMMAR[state]:
            yield "I", out, INSERT, 0, (inserted + 1) * len(GRAMMAR) + GRAMMAR[state][out]
    if symbol is not None and symbol[1] in ".t":
        more = TRUNCATED if symbol[1] == "t" else 0
        if symbol[0] in GRAMMAR[state]:
            yield "K", symbol[0], KEEP + more, 1, GRAMMAR[state][symbol[0]]
        for out in RESPONDENTS:
            if out in GRAMMAR[state]:
                yield "R", out, REROLE + more, 1, GRAMMAR[state][out]


def _composed() -> dict[str | None, list[list[tuple[str, str, int, int, int]]]]:
    symbols = [None, *(c + f for c in "suax" for f in ".bdt")]
    return {x: [list(arcs(x, s // len(GRAMMAR), s % len(GRAMMAR))) for s in range(_STATES)] for x in symbols}


_ARCS = _composed()


def cheapest(symbols: str) -> tuple[int, str, str]:
    """(cost, audit, plan) of a conversation written as two signs a row.

    The audit has one label an edit. The plan says the same with roles: ``K`` and ``D``, ``u`` or ``a``
    for a row that gets that role, ``U`` or ``A`` for an inserted one.
    """
    rows = [symbols[i : i + 2] for i in range(0, len(symbols), 2)]
    n = len(rows)
    to_go = np.full((n + 1, _STATES), _FAR, np.int64)
    after = [_FAR] * _STATES
    for i in range(n, -1, -1):
        here = [_FAR] * _STATES
        moves = _ARCS[rows[i] if i < n else None]
        for s in range(_STATES - 1, -1, -1):  # more insertions come later in topological order
            best = 0 if i == n and s % len(GRAMMAR) in FINAL else _FAR
            for _, _, cost, read, to in moves[s]:
                best = min(best, cost + (after if read else here)[to])
            here[s] = best
        to_go[i] = after = here
    at, s, labels, plan = 0, 0, [], []
    while True:
        left = int(to_go[at, s])
        if at == n and s % len(GRAMMAR) in FINAL and left == 0:
            return int(to_go[0, 0]), "".join(labels), "".join(plan)
        for label, out, cost, read, to in _ARCS[rows[at] if at < n else None][s]:
            if cost + to_go[at + read, to] == left:
                labels.append(label)
                plan.append({"R": out, "I": out.upper()}.get(label, label))
                at, s = at + read, to
                break


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at): rows in order by turn, nulls first, then role and text; ``at`` numbers them throughout.

    Rows are dealt to ranges of that order, so no conversation is gathered; null roles and texts are one space.
    """
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "tie")]
    spread = rows.repartitionByRange(parallelism(turns.sparkSession), *order).sortWithinPartitions(*order)
    return checkpoint(spread.drop("tie").withColumn("at", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, at, turn, symbol) of ``ordered`` rows: each row's role initial (``x`` unless s, u or a) and first fault."""
    same = [F.xxhash64("conv_id", "role", "text").alias("h1"), F.xxhash64(F.lit(11), "text", "role", "conv_id").alias("h2")]
    filled = F.col("text").rlike(SIGN)
    keyed = rows.where(filled).select(*same, "at")
    first = keyed.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = keyed.join(first, ["h1", "h2"]).where("at > first").select(F.col("at").alias("again"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~F.col("filled"), "b").when(F.col("again").isNotNull(), "d").when(~F.col("whole"), "t").otherwise(".")
    narrow = rows.select("conv_id", "at", "turn", initial.alias("initial"), filled.alias("filled"), whole.alias("whole"))
    return narrow.join(again, F.col("at") == F.col("again"), "left").select("conv_id", "at", "turn", F.concat("initial", fault).alias("symbol"))


def plans(symbols: DataFrame, remembered: int = 20_000) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, plan) of each conversation of ``faults``.

    Symbols are joined within ranges first; what is gathered is as long as the audit that comes out.
    """
    parts = symbols.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("own"))
    parts = parts.select("conv_id", "part", F.array_join("own.symbol", "").alias("symbols"))
    joined = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "symbols"))).alias("own")).select("conv_id", F.array_join("own.symbols", "").alias("symbols"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, tuple] = OrderedDict()
        legal = {"su", "ua", "au"}
        for batch in batches:
            out = []
            for s in batch.column(1).to_pylist():
                if s not in known:
                    roles, kinds = s[::2], s[1::2]
                    illegal = sum(a + b not in legal for a, b in zip(roles, roles[1:], strict=False))
                    known[s] = (kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, *cheapest(s))
                    if len(known) > remembered:
                        known.popitem(last=False)
                out.append(known[s])
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "plan"])

    found = joined.mapInArrow(run, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, plan string")
    turns = symbols.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("of")).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    return found.join(turns, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of").withColumn("gaps", F.coalesce("gaps", F.lit(0)))


def _streamed(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, in one partition."""
    none = F.lit(None)
    heads = planned.select("conv_id", F.lit(-1).cast("long").alias("at"), "plan", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    tails = rows.select("conv_id", "at", none.cast("string").alias("plan"), "turn", "role", "text")
    return heads.unionByName(tails).repartition(parallelism(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(event, conv_id, turn, role, text, edit) in order: ``row`` for every edit, ``end`` after a conversation's last, ``batch`` after each batch."""
    plan, place, conv_id, open_ = "", 0, None, False

    def inserts() -> Iterator[tuple]:
        nonlocal place
        while place < len(plan) and plan[place] in "UA":
            yield "row", conv_id, None, RESPONDENTS[plan[place].lower()], "", "I"
            place += 1

    for batch in batches:
        for own_id, at, own_plan, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at == -1:
                if open_:
                    yield from inserts()
                    yield "end", conv_id, None, None, None, None
                plan, place, conv_id, open_ = own_plan, 0, own_id, True
                continue
            yield from inserts()
            act = plan[place]
            place += 1
            yield "row", conv_id, turn, RESPONDENTS.get(act, role), text, "R" if act in RESPONDENTS else act
        yield "batch", None, None, None, None, None
    if open_:
        yield from inserts()
        yield "end", conv_id, None, None, None, None
    yield "batch", None, None, None, None, None


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the turns of each repaired conversation, ``edit`` K, R or I; inserted turns have no number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place = 0
        for event, conv_id, turn, role, text, edit in _edited(batches):
            if event == "row" and edit != "D":
                out.append((conv_id, place, turn, role, text, edit))
                place += 1
            elif event == "end":
                place = 0
            elif event == "batch":
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                kinds = [pa.int64()] * 3 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "turn", "role", "text", "edit"])
                out = []

    return _streamed(rows, planned).mapInArrow(run, "conv_id long, place long, turn long, role string, text string, edit string")


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of each conversation's repaired ``role:text``, joined by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        sha, first = hashlib.sha256(), True
        for event, conv_id, _, role, text, edit in _edited(batches):
            if event == "row" and edit != "D":
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            elif event == "end":
                out.append((conv_id, sha.hexdigest()))
                sha, first = hashlib.sha256(), True
            elif event == "batch":
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["conv_id", "repaired_sha256"])
                out = []

    return _streamed(rows, planned).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """The turns of all conversations after their cheapest edits: conv_id, place, turn, role, text, edit.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Rows go by turn, nulls first,
    then by role and text. Null roles and texts are one space: such a text is blank, such a role must
    change. Blank rows and those whose role and text stood earlier in their conversation are deleted;
    a null conv_id is a conversation of its own. Conversations that lose every row have no turns left,
    an empty table gives an empty result.
    """
    rows = ordered(turns)
    return repaired(rows, checkpoint(plans(faults(rows))))


def report(turns: DataFrame, every: DataFrame) -> DataFrame:
    """One row per conv_id of ``every``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Conversations of ``every`` without a row in ``turns`` have zeros, an empty audit and the hash of nothing.
    """
    rows = ordered(turns)
    planned = checkpoint(plans(faults(rows)))
    found = planned.drop("plan").join(digests(rows, planned).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of").withColumnRenamed("conv_id", "of")
    ids = every.select(F.col("conv_id").cast("long").alias("conv_id")).groupBy("conv_id").agg(F.lit(1).alias("one"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by the CRC of their id and turn, so that there is something to repair.

    Of twenty rows one each is dropped, emptied, robbed of its stops, repeated, or made the user's. Nulls count as one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")
