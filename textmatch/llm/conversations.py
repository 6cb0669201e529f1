"""Conversation structure repair: run-length dynamic programme over min-plus transitions, with an audit of its edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.llm.common import stored

SPACE = " \t\n\x0b\x0c\r"
ROLES = "sua"
#: Faults of a row, and the symbol of a row: 4 * (place of its role's initial in ROLES, or 3) + fault.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
#: States: nothing written yet, behind the system turn, behind a user's turn, behind an assistant's (where an end is legal).
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
#: Where a turn of a user or an assistant leads that is put in or given its role, and what a kept turn of each role does.
ONWARD = (USER, USER, ASSISTANT, USER)
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
#: Rows of a run that are unrolled at once.
STRETCH = 1024

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _times(m: Matrix, v: Vector) -> Vector:
    """Cheapest cost from each state through a transition and on."""
    return tuple(min(c + x for c, x in zip(row, v, strict=True)) for row in m)


def _product(a: Matrix, b: Matrix) -> Matrix:
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min(NEVER, *(x + y for x, y in zip(row, col, strict=True))) for col in columns) for row in a)


def _edge(costs: dict[tuple[int, int], int]) -> Matrix:
    return tuple(tuple(costs.get((q, r), NEVER) for r in range(4)) for q in range(4))


def _closed(m: Matrix) -> Matrix:
    """With any number of inserted turns before it."""
    steps = {(q, q): 0 for q in range(4)} | {(q, ONWARD[q]): INSERT for q in range(4)}
    one = _edge(steps)
    return _product(_product(_product(one, one), one), m)


IDENTITY = _edge({(q, q): 0 for q in range(4)})
#: Cost of ending in each state: only nothing at all, or an assistant's turn, is a legal end; turns may be put in first.
END: Vector = _times(_closed(IDENTITY), (0, NEVER, NEVER, 0))


def _kept(symbol: int, state: int) -> tuple[int, int] | None:
    """Where a kept row of this symbol leads, and what it costs; None where it may not be kept."""
    to = KEPT.get((state, symbol // 4))
    return None if symbol % 4 >= BLANK or to is None else (to, UNFINISHED * (symbol % 4 == TRUNCATED))


def _rerole(symbol: int, state: int) -> tuple[int, int] | None:
    return None if symbol % 4 >= BLANK else (ONWARD[state], REROLE + UNFINISHED * (symbol % 4 == TRUNCATED))


@lru_cache(maxsize=1024)
def power(symbol: int, exponent: int) -> Matrix:
    """Min-plus transition of 2 ** exponent rows of one symbol, turns put in before each where that is cheapest."""
    if exponent:
        half = power(symbol, exponent - 1)
        return _product(half, half)
    costs: dict[tuple[int, int], int] = {(q, q): DELETE for q in range(4)}
    for q in range(4):
        for step in (_kept(symbol, q), _rerole(symbol, q)):
            if step:
                costs[q, step[0]] = min(costs.get((q, step[0]), NEVER), step[1])
    return _closed(_edge(costs))


def before(symbol: int, length: int, after: Vector) -> Vector:
    """Cheapest costs before a run, from those behind it."""
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            after = _times(power(symbol, bit), after)
    return after


def transition(symbols: list[int], lengths: list[int]) -> Matrix:
    """Min-plus transition of all runs of a slice: its columns are the costs before it of being in one state behind it."""
    columns = []
    for q in range(4):
        v = IDENTITY[q]
        for s, n in zip(reversed(symbols), reversed(lengths), strict=True):
            v = before(s, n, v)
        columns.append(v)
    return tuple(zip(*columns, strict=True))


def unrolled(symbols: list[int], lengths: list[int], start: int, after: Vector, last: bool) -> tuple[str, int, int]:
    """Letters of the cheapest edits of a slice (of these the least in ASCII), its end state, and what they cost.

    after: costs behind the slice. Costs behind every run are kept; those inside a run come from powers for every stretch
    and from single steps inside it, so memory goes with the runs, not the rows. Any edit leads to one state, so taking
    the smallest letter that is still cheapest at each place gives the least of all cheapest audits.
    """
    behind = [after]
    for s, n in zip(reversed(symbols[1:]), reversed(lengths[1:]), strict=True):
        behind.append(before(s, n, behind[-1]))
    behind.reverse()
    letters, state, cost = [], start, 0
    for s, n, after_run in zip(symbols, lengths, behind, strict=True):
        for left in range(n, 0, -STRETCH):
            rows = min(left, STRETCH)
            costs = [before(s, left - rows, after_run)]
            for _ in range(rows):
                costs.append(_times(power(s, 0), costs[-1]))
            for now, then in zip(reversed(costs[1:]), reversed(costs[:-1]), strict=True):
                letter = ""
                while letter in ("", "I"):
                    letter, state, price = _choice(s, state, now, then)
                    letters.append(letter)
                    cost += price
    while last and END[state] > 0:
        letters.append("I")
        state, cost = ONWARD[state], cost + INSERT
    return "".join(letters), state, cost


def _choice(symbol: int, state: int, now: Vector, then: Vector) -> tuple[str, int, int]:
    if DELETE + then[state] == now[state]:
        return "D", state, DELETE
    if INSERT + now[ONWARD[state]] == now[state]:
        return "I", ONWARD[state], INSERT
    for letter, step in (("K", _kept(symbol, state)), ("R", _rerole(symbol, state))):
        if step and step[1] + then[step[0]] == now[state]:
            return letter, *step
    raise AssertionError("no edit has the cheapest cost")


def _runs(symbols: np.ndarray, lengths: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of a slice, neighbours of one symbol as one."""
    starts = np.flatnonzero(np.diff(symbols, prepend=-1))
    return symbols[starts].tolist(), np.add.reduceat(lengths, starts).tolist()


def _illegal(symbols: list[int], lengths: list[int]) -> int:
    """Neighbours inside a slice that may not follow each other: a role never follows itself."""
    roles = [s // 4 for s in symbols]
    return sum(n - 1 for n in lengths) + sum(not _follows(a, b) for a, b in zip(roles, roles[1:], strict=False))


def _follows(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


_MATRIX = T.ArrayType(T.LongType())
_PIECES = T.StructType(
    [T.StructField("audits", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("ends", "costs", "faults")]
    + [T.StructField(c, T.LongType()) for c in ("illegal", "first", "last")]
)


@F.pandas_udf(_MATRIX)
def _transition(symbols: pd.Series, lengths: pd.Series) -> pd.Series:
    return pd.Series([[x for row in transition(*_runs(s, n)) for x in row] for s, n in zip(symbols, lengths, strict=True)])


@F.pandas_udf(T.ArrayType(_MATRIX))
def _costs_behind(matrices: pd.Series) -> pd.Series:
    """Costs behind each slice of a conversation, from the transitions of its slices in order."""
    out = []
    for many in matrices:
        v, behind = END, []
        for flat in reversed([m.tolist() for m in many]):
            behind.append(list(v))
            v = _times(tuple(tuple(flat[4 * q : 4 * q + 4]) for q in range(4)), v)
        out.append(behind[::-1])
    return pd.Series(out)


@F.pandas_udf(_PIECES)
def _unrolled(symbols: pd.Series, lengths: pd.Series, behind: pd.Series, is_last: pd.Series) -> pd.DataFrame:
    """What a slice says from each state it can be met in: only the first one where the slice is a whole conversation."""
    rows = []
    for s, n, v, last in zip(symbols, lengths, behind, is_last, strict=True):
        s, n = _runs(s, n)
        after = END if v is None else tuple(v.tolist())
        found = [unrolled(s, n, q, after, bool(last)) for q in (range(1) if v is None else range(4))]
        faults = [sum(k for x, k in zip(s, n, strict=True) if x % 4 == f) for f in range(4)]
        audits, ends, costs = (list(c) for c in zip(*found, strict=True))
        rows.append((audits, ends, costs, faults, _illegal(s, n), s[0] // 4, s[-1] // 4))
    return pd.DataFrame(rows, columns=_PIECES.names)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by rule: of every twenty turns one is dropped, emptied, left without its sentence
    ends, said twice or given to the user, chosen by a checksum of conv_id and turn. Nulls are read as one space.

    rows: conv_id, turn, role, text; other columns are not kept.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce("text", space)
    out = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies", "copy")


def _named(rows: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))




def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h").asc()]


def _ordered(rows: DataFrame) -> DataFrame:
    """Facts of rows without their texts, in order: conv_id, turn, seq (ascending over everything), part, and the runs
    (symbol, length) of equal rows, which are one row here however often they occur."""
    stripped = F.rtrim("text", F.lit(SPACE))
    facts = _named(rows).select(
        "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("h"), (stripped == "").alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    same = ["conv_id", "turn", "role", "h"]
    once = facts.groupBy(*same).agg(F.max("blank").alias("blank"), F.max("truncated").alias("truncated"), F.count(F.lit(1)).alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    seen = once.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("hh"))
    seen = seen.agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1").drop("turns")
    own = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("hh"))
    told = once.join(seen.hint("merge"), own, "left").withColumn("again", F.coalesce(turn > F.col("first"), F.lit(False)))
    place = F.instr(F.lit(ROLES), F.substring("role", 1, 1)) - 1
    role = F.when((F.col("role") == "") | (place < 0), 3).otherwise(place) * 4
    first = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(SOUND)
    more = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    one = F.struct((role + first).cast("int").alias("s"), F.lit(1).cast("long").alias("n"))
    rest = F.struct((role + more).cast("int").alias("s"), (F.col("n") - 1).alias("n"))
    told = told.withColumn("runs", F.when(F.col("n") > 1, F.array(one, rest)).otherwise(F.array(one)))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = told.select("conv_id", "turn", "role", "h", "runs").repartitionByRange(parts, *_order()).sortWithinPartitions(*_order())
    return stored(told.select("conv_id", "turn", "runs", F.monotonically_increasing_id().alias("seq")))


def plans(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The cheapest repair of every conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    rows: conv_id, turn, role, text. every: a table whose conv_id are all to be told of, also those without rows. Turns
    are taken in order, nulls first; those of one turn by role and by a hash of the text. A row is faulty by the first
    that holds: blank (white space only), duplicate (role and text seen earlier), truncated (no sentence end at its end).
    Edits: keep (free), give another role (2), delete (3; a must for blank and duplicate rows), put in an empty turn (2);
    a truncated row that stays costs 1. The result has at most one system turn first, and then turns of user and
    assistant in pairs, or nothing. The audit has the initials of the cheapest edits, of these the least in ASCII.

    Rows are told by symbols of role and fault, without their texts, and put in order by ranges, so a conversation of
    any length is spread over the partitions; equal rows are counted before they move. A slice of a conversation in one
    partition is a list of runs. Whole conversations are solved where they are. Of those cut by a partition's edge (two a
    partition at most) the min-plus transitions of the slices are put together first, then every slice is unrolled
    from each state it may be met in, and the pieces are chained.

    Defined results: null role and text are one space; a null conv_id is a conversation; null turns come first and don't
    count in gaps; a conversation without rows has zeros and an empty audit; an empty table gives an empty table.
    """
    ordered = _ordered(rows)
    part = F.shiftright("seq", 33).alias("part")
    group = F.sort_array(F.collect_list(F.struct("seq", "turn", "runs"))).alias("rows")  # a part of a partition at most
    slices = ordered.groupBy("conv_id", part).agg(group)
    turns = F.filter(F.col("rows.turn"), lambda t: t.isNotNull())
    slices = slices.select(
        "conv_id", "part", F.flatten("rows.runs").alias("runs"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"),
        F.size(F.array_distinct(turns)).cast("long").alias("turns"),
    )
    slices = stored(slices)
    spans = slices.groupBy(F.col("conv_id").alias("c")).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    spans = stored(spans)  # two conversations a partition's edge at most
    own = F.col("conv_id").eqNullSafe(F.col("c"))
    cut = slices.join(F.broadcast(spans), own).select("c", "part", "hi", _transition("runs.s", "runs.n").alias("m"))
    chain = cut.groupBy("c", "hi").agg(F.sort_array(F.collect_list(F.struct("part", "m"))).alias("ms"))
    behind = chain.select("c", "hi", F.explode(F.arrays_zip(F.col("ms.part").alias("p"), _costs_behind("ms.m").alias("v"))).alias("x"))
    behind = stored(behind.select("c", "hi", F.col("x.p").alias("p"), F.col("x.v").alias("v")))
    pieces = slices.join(F.broadcast(behind), own & (F.col("part") == F.col("p")), "left")  # two slices a partition at most
    last = F.coalesce(F.col("part") == F.col("hi"), F.lit(True))
    pieces = pieces.select("conv_id", "part", "low", "high", "turns", _unrolled("runs.s", "runs.n", "v", last).alias("u"))
    told = pieces.select("conv_id", F.struct("part", "low", "high", "turns", "u.*").alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    out = told.select("conv_id", F.aggregate("xs", _nothing(), _chained).alias("y"))
    gaps = F.coalesce(F.col("y.high") - F.col("y.low") + 1 - F.col("y.turns"), F.lit(0)).cast("long")
    counts = [F.col(f"y.{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    out = out.select("conv_id", gaps.alias("gaps"), *counts, F.concat_ws("", "y.audit").alias("audit"))
    if every is None:
        return out
    out = every.select("conv_id").distinct().join(out.withColumnRenamed("conv_id", "c").hint("merge"), own, "left").drop("c")
    return out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"])


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")


def _nothing() -> Column:
    none = F.lit(None).cast("long")
    return F.struct(
        F.lit(0).cast("long").alias("state"), F.array().cast("array<string>").alias("audit"), none.alias("role"), none.alias("low"), none.alias("high"),
        *[F.lit(0).cast("long").alias(c) for c in _COUNTS],
    )


def _chained(done: Column, x: Column) -> Column:
    """What is known of a conversation with one more slice behind it."""
    at = (done["state"] + 1).cast("int")
    meet = done["role"] * 4 + x["first"]
    wrong = F.when(done["role"].isNull() | meet.isin(0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1), F.lit(0)).otherwise(1)
    both = F.coalesce((done["high"] == x["low"]).cast("long"), F.lit(0))
    fault = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATED}
    more = {c: F.element_at(x["faults"], f + 1) for c, f in fault.items()}
    more |= {"illegal": x["illegal"] + wrong, "cost": F.element_at(x["costs"], at), "turns": x["turns"] - both}
    return F.struct(
        F.element_at(x["ends"], at).alias("state"), F.concat(done["audit"], F.array(F.element_at(x["audits"], at))).alias("audit"), x["last"].alias("role"),
        F.least(done["low"], x["low"]).alias("low"), F.greatest(done["high"], x["high"]).alias("high"),
        *[(done[c] + more[c]).cast("long").alias(c) for c in _COUNTS],
    )


def _together(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows with texts in their order, each conversation's plan in front, without a join: a text moves once."""
    conv = F.col("conv_id").cast("string").alias("conv")
    texts = _named(rows).select(conv, F.lit(1).alias("kind"), "turn", "role", F.unhex(F.md5("text")).alias("h"), "text")
    none = F.lit(None)
    heads = planned.select(
        conv, F.lit(0).alias("kind"), none.cast("long").alias("turn"), F.to_json(F.struct(*[c for c in planned.columns if c not in ("conv_id", "audit")])).alias("role"),
        none.cast("binary").alias("h"), F.col("audit").alias("text"),
    )
    keys = [F.col("conv").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "h"]
    return texts.unionByName(heads).repartition("conv").sortWithinPartitions(*keys).select("conv", "kind", "role", "text")


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Conversations in turn: (conv, plan, audit) at their start, (role, text, letter) for every row left, None at the end."""
    audit, at, state, plan = "", 0, START, None

    def put(letter: str, role: str, text: str) -> tuple:
        nonlocal state
        if letter == "K":
            state = KEPT[state, ROLES.index(role[0])]
        else:
            state = ONWARD[state]
            role = "user" if state == USER else "assistant"
        return role, text, letter

    def inserted() -> Iterator[tuple]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield put("I", "", "")

    for frame in frames:
        for conv, kind, role, text in zip(frame["conv"], frame["kind"], frame["role"], frame["text"], strict=True):
            if kind == 0:
                if plan is not None:
                    yield from inserted()
                    yield ()
                audit, at, state, plan = text, 0, START, role
                yield conv, plan, audit, None
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter != "D":
                yield put(letter, role, text)
    if plan is not None:
        yield from inserted()
        yield ()


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text, edit (K, R or I). Deleted rows are left out.

    planned: plans() of the same rows. Texts are streamed through a task in order and none is held, so a conversation
    may have any number of them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv", "position", "role", "text", "edit"]
        held: list[tuple] = []
        conv, position = None, 0
        for step in _edited(frames):
            if len(step) == 4:
                conv, position = step[0], 0
            elif step:
                held.append((conv, position, *step))
                position += 1
            if len(held) >= 1000:
                yield pd.DataFrame(held, columns=names)
                held = []
        yield pd.DataFrame(held, columns=names)

    out = _together(rows, planned).mapInPandas(run, "conv string, position long, role string, text string, edit string")
    return out.select(F.col("conv").cast(planned.schema["conv_id"].dataType).alias("conv_id"), "position", "role", "text", "edit")


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """planned with repaired_sha256, the digest of each repaired conversation's role:text lines. A digest is made in order,
    so the texts of one conversation pass through one task, one batch at a time; everything else about it is shared out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        head, sha, first = (), hashlib.sha256(), True
        for step in _edited(frames):
            if len(step) == 4:
                head, sha, first = step[:3], hashlib.sha256(), True
            elif step:
                sha.update(f"{'' if first else chr(10)}{step[0]}:{step[1]}".encode("utf-8", "surrogatepass"))
                first = False
            else:
                held.append((*head, sha.hexdigest()))
                if len(held) >= 1000:
                    yield pd.DataFrame(held, columns=["conv", "plan", "audit", "sha"])
                    held = []
        yield pd.DataFrame(held, columns=["conv", "plan", "audit", "sha"])

    kinds = {f.name: f.dataType for f in planned.schema}
    plan = T.StructType([T.StructField(c, k) for c, k in kinds.items() if c not in ("conv_id", "audit")])
    out = _together(rows, planned).mapInPandas(run, "conv string, plan string, audit string, sha string")
    out = out.select(F.col("conv").cast(kinds["conv_id"]).alias("conv_id"), F.from_json("plan", plan).alias("p"), "audit", "sha")
    return out.select("conv_id", "p.*", "audit", F.col("sha").alias("repaired_sha256"))
