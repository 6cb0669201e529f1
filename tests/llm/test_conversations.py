"""Conversation repair against a plain dynamic programme over rows, and its slices against whole conversations."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmatch.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """(cost, audit, repaired lines) of rows (role, text) by keeping the best for each state, a row at a time."""
    best = {0: (0, "", ())}

    def opened(best):
        best = dict(best)
        for _ in range(3):
            for q, (c, a, t) in list(best.items()):
                to = (2, 2, 3, 2)[q]
                role = "user" if to == 2 else "assistant"
                best[to] = min(best.get(to, (9**9,)), (c + 2, a + "I", (*t, f"{role}:")))
        return best

    seen = set()
    for role, text in rows:
        gone = not re.search(r"[^\x20\x09-\x0D]", text) or (role, text) in seen
        seen.add((role, text))
        cut = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        new = {}
        for q, (c, a, t) in opened(best).items():
            ways = [(q, c + 3, a + "D", t)]
            if not gone:
                to = (2, 2, 3, 2)[q]
                ways.append((to, c + 2 + cut, a + "R", (*t, f"{'user' if to == 2 else 'assistant'}:{text}")))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, role[:1]))
                if to is not None:
                    ways.append((to, c + cut, a + "K", (*t, f"{role}:{text}")))
            for to, *rest in ways:
                new[to] = min(new.get(to, (9**9,)), tuple(rest))
        best = new
    return min(v for q, v in opened(best).items() if q in (0, 3))


def plain_facts(rows):
    seen, faults = set(), []
    for role, text in rows:
        blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        seen.add((role, text))
        faults.append("blank" if blank else "duplicate" if again else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return {f: faults.count(f) for f in ("blank", "duplicate", "truncated")} | {"illegal": illegal}


def in_order(rows):
    named = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(named, key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), hashlib.md5(row[2].encode()).digest()))


def expected(rows):
    ordered = in_order(rows)
    turns = [t for t, _, _ in ordered if t is not None]
    pairs = [(r, x) for _, r, x in ordered]
    cost, audit, lines = plain_repair(pairs)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return {"gaps": gaps, **plain_facts(pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def made(n, seed):
    draw = random.Random(seed)
    texts = ["a.", "b", "c!", "", " \t", "d? ", "e", "f.\n", None] + [f"{i}." for i in range(n)]
    return [(draw.choice([None, *range(n)]), draw.choice(["system", "user", "assistant", "tool", "", None, "user", "assistant"]), draw.choice(texts)) for _ in range(n)]


@pytest.fixture(scope="module")
def convs():
    out = {i: made(n, i) for i, n in enumerate([1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 20] * 3)}
    out[100] = [(i, "user", f"question {i}.") for i in range(3000)]  # a run longer than a stretch
    out[101] = made(1500, 101)  # cut by the edges of partitions
    out[None] = made(9, 7)
    out[2**60 + 1] = [(0, "user", "same."), (1, "user", "same."), (1, "assistant", "x."), (1, "assistant", "x."), (1, "assistant", "x.")]
    return out


def test_plans_and_digests(spark, convs):
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"seq": F.lit(1), "c": F.lit("x"), "h": F.lit(0), "part": F.lit(2)})
    every = spark.createDataFrame([(c,) for c in convs] + [(-5,)], "conv_id long")
    planned = C.plans(table, every)
    slices = C._ordered(table).select("conv_id", F.shiftright("seq", 33).alias("p")).distinct().groupBy("conv_id").count()
    assert slices.where("count > 1 and conv_id in (100, 101)").count() == 2  # so slices are chained here
    got = {r["conv_id"]: r.asDict() for r in C.digests(table, planned).collect()}
    assert set(got) == {*convs, -5}
    for c, rs in convs.items():
        want = expected(rs)
        assert {k: got[c][k] for k in want} == want, c
    assert got[-5]["audit"] == "" and got[-5]["cost"] == got[-5]["gaps"] == 0
    assert got[-5]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repaired_rows_are_legal(spark, convs):
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    table = spark.createDataFrame(rows, SCHEMA)
    out = C.repaired(table, C.plans(table)).collect()
    assert {r["conv_id"] for r in out} <= set(convs)
    for c, rs in convs.items():
        mine = sorted((r["position"], r["role"], r["text"]) for r in out if r["conv_id"] == c)
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in mine))
        lines = "\n".join(f"{role}:{text}" for _, role, text in mine)
        assert hashlib.sha256(lines.encode()).hexdigest() == expected(rs)["repaired_sha256"]


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert C.digests(table, C.plans(table, table)).count() == 0
    assert C.repaired(C.damaged(table), C.plans(table)).count() == 0


def test_damage(spark):
    import zlib

    rows = [(i, t, "assistant", "One. Two!") for i in range(20) for t in range(9)] + [(None, None, None, None), (3, None, "user", None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = [tuple(r) for r in C.damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) != len(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(1, 7)), min_size=1, max_size=8), st.integers(1, 7))
def test_slices_chain_to_the_whole(runs, cut):
    symbols, lengths = [s for s, _ in runs], [n for _, n in runs]
    whole = C.unrolled(symbols, lengths, C.START, C.END, True)
    cut = min(cut, len(runs) - 1)
    if cut > 0:
        behind = C._times(C.transition(symbols[cut:], lengths[cut:]), C.END)
        a = C.unrolled(symbols[:cut], lengths[:cut], C.START, behind, False)
        b = C.unrolled(symbols[cut:], lengths[cut:], a[1], C.END, True)
        assert (a[0] + b[0], b[1], a[2] + b[2]) == whole
    texts = {0: "x{}.", 1: "x{}", 2: "", 3: "same."}
    rows, i = [("user", "same."), ("assistant", "same."), ("system", "same."), ("tool", "same.")], 0
    for s, n in runs:
        for _ in range(n):
            rows.append((["system", "user", "assistant", "tool"][s // 4], texts[s % 4].format(i)))
            i += 1
    lead = C.unrolled([4, 8, 0, 12, *symbols], [1, 1, 1, 1, *lengths], C.START, C.END, True)
    assert (lead[2], lead[0]) == plain_repair(rows)[:2]


def test_long_runs_take_logarithmic_steps():
    assert C.before(4, 1 << 40, C.END)[C.START] == 1 << 40  # user after user: every second one becomes the answer
    assert C.power.cache_info().currsize <= 1024
