"""Mixing, sharding and fingerprints against plain Python versions, and their odd cases."""

import base64
import hashlib
import random
import re
import struct
import zlib

import pytest
import xxhash

from textmatch.llm import fingerprints, mixing, sharding
from textmatch.llm.common import components, lookup_join, stored

DOCS = "doc_id long, text string, source string, size int, shard string"


def odd_docs(spark, n=60):
    """Nulls, empty texts, ties, repeated rows, a long text, and columns whose names clash with results."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 40))) + ".", rng.choice(["a", "b", "ü", None]), 7, "x") for i in range(n)]
    rows += [(n, None, "a", 1, None), (n + 1, "", "b", None, "y"), (n + 2, "word " * 30_000, "b", 0, ""), (5, rows[5][1], rows[5][2], 7, "x"), (None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_level_where_none_is_above_its_cap(spark):
    rows = [("a", 100, 3.0), ("b", 1000, 1.0), ("c", 10, 2.0), (None, 40, 3.0)]
    by_source = spark.createDataFrame(rows, "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(by_source).collect()}
    want, left, open_ = {}, 1.5 * 1150, {s: (n, w) for s, n, w in rows}
    while open_:  # reshare until none is above
        level = left / sum(w for _, w in open_.values())
        above = [s for s, (n, w) in open_.items() if level * w > 2 * n]
        if not above:
            want |= {s: level * w for s, (_, w) in open_.items()}
            break
        for s in above:
            want[s] = 2.0 * open_.pop(s)[0]
            left -= want[s]
    assert got == pytest.approx(want)


def test_mix_takes_what_a_sort_would(spark):
    docs, rows = odd_docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    again = sorted((str(r["doc_id"]), r["__copies"]) for r in mixing.mix(docs).collect())
    assert again == sorted((str(r["doc_id"]), r["__copies"]) for r in got)
    by_source = {}
    for r in got:
        assert r["__size"] == words(r["text"]) and 0 <= r["__copies"] <= 2 and (r["__size"] or r["__target"] >= r["__source_size"] or not r["__copies"])
        by_source.setdefault(r["source"], []).append(r)
    for group in by_source.values():
        target, taken = group[0]["__target"], sum(r["__copies"] * r["__size"] for r in group)
        assert sum(r["__size"] for r in group) == group[0]["__source_size"]
        assert abs(taken - target) <= max(r["__size"] for r in group)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(r["__copies"] for r in got)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mix_takes_some_of_equal_rows(spark, doc_id):
    """Rows that nothing tells apart, or only their texts do, are counted one by one, in the operator and in its SQL."""
    import duckdb

    from textmatch.llm import queries

    rows = [(doc_id, "ten words " * 5, "x")] * 400 + [(i + 1000, "other words " * 4, "y") for i in range(300)] + [(doc_id, f"t{i} is said", "z") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs, (3.0, 1.0, 2.0), share=1.1).collect()
    for source in "xyz":
        mine = [r for r in got if r["source"] == source]
        assert len(mine) == {"x": 400, "y": 300, "z": 200}[source]
        target, size = mine[0]["__target"], mine[0]["__size"]
        assert abs(sum(r["__copies"] * r["__size"] for r in mine) - target) <= size / 2 + 1e-6
        assert max(r["__copies"] for r in mine) <= 2
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").toPandas()  # noqa: F841 - read by the SQL
    sql = sorted(map(tuple, duckdb.sql(f"SELECT source_size, size, taken FROM ({queries.ORACLE['op1_mix']})").fetchall()))
    ours = mixing.mix(docs).selectExpr("__source_size", "__size", "cast(__copies * __size as long)").collect()
    assert sorted(map(tuple, ours)) == sql


def test_mix_of_nothing_and_of_importance(spark):
    docs, _ = odd_docs(spark)
    assert mixing.mix(docs.limit(0)).count() == 0
    heavy = mixing.mix(docs.selectExpr("*", "case when doc_id % 2 = 0 then 50.0 else 0.02 end as w"), importance="w", share=0.4)
    counts = {r[0]: r[1] for r in heavy.where("__size between 1 and 1000").groupBy((heavy.doc_id % 2)).avg("__copies").collect() if r[0] is not None}
    assert counts[0] > counts[1]


def test_mix_by_a_table_of_weights(spark):
    docs, rows = odd_docs(spark)
    weights = spark.createDataFrame([("a", 2.0), (None, 1.0), ("ü", None), ("none such", 5.0)], "source string, weight double")
    got = mixing.mix(docs, weights, share=0.5).collect()
    taken = {}
    for r in got:
        n, target = taken.get(r["source"], (0, r["__target"]))
        taken[r["source"]] = (n + r["__copies"] * r["__size"], target)
    assert len(got) == len(rows) and taken["b"] == taken["ü"] == (0, 0.0)
    assert all(t > 0 and abs(n - t) <= max(r["__size"] for r in got if r["source"] == s) for s, (n, t) in taken.items() if s in ("a", None))
    assert all(r["__copies"] == 0 for r in mixing.mix(docs, weights.limit(0)).collect())


def test_shards_are_contiguous_and_balanced(spark):
    docs, rows = odd_docs(spark)
    got = sharding.shards(docs, 5).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()) if r[1] is not None else -1))
    total = sum(len((r[1] or "").encode()) + 16 for r in rows)
    cum, want = 0, []
    for r in order:
        size = len((r[1] or "").encode()) + 16
        want.append((r[0], size, zlib.crc32(r[1].encode()) if r[1] is not None else None, min(4, (2 * cum + size) * 5 // (2 * total))))
        cum += size
    assert sorted(map(str, ((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got))) == sorted(map(str, want))
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shards(docs.limit(0)).count() == 0


def cut(text):
    return set(re.split(r"\n|(?<=[^.!?\n]{30}[.!?]) ", text or ""))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(data, seed=42):
    return signed(xxhash.xxh64(data, seed=seed).intdigest())


def python_sketch(items, level=0):
    """Cells of a set of paragraph digests, written without Spark: [count, xor of digests, xor of checks]."""
    cells = [[0, 0, 0] for _ in range(24)]
    for x in items:
        data = struct.pack("<q", x)
        mixed = xx(struct.pack("<q", level), seed=xx(data) % (1 << 64))
        check = xx(struct.pack("<q", -1), seed=xx(data) % (1 << 64))
        for j in range(3):
            cell = cells[(mixed >> 3 * j & 7) + 8 * j]
            cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] ^ x, cell[2] ^ check
    return cells


def python_print(text):
    items = {xx(p.encode()) for p in cut(text)}
    cells = b"".join(struct.pack(">iqq", *c) for c in python_sketch(items))
    return f"{len(items)}:{base64.b64encode(cells).decode()}"


def test_fingerprints_and_likeness_equal_plain_python(spark):
    rng = random.Random(5)
    sentences = [f"Sentence {i} of the pool, which is long enough." for i in range(400)] + ["Short one."]
    rows = [(3 * i, "\n".join(" ".join(rng.sample(sentences, rng.randint(1, 6))) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    rows += [(7, None), (8, ""), (1000, " ".join(sentences * 3)), (1001, "one"), (12, rows[4][1]), (13, rows[4][1]), (1002, "a\n" * 3000 + "b")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, near_next string")
    out = fingerprints.edited_likeness(docs).collect()
    got = {(r["doc_id"], r["n_chars"]): r for r in out}
    ids = sorted({d for d, _ in rows})
    first = {d: t or "" for d, t in rows}
    assert len(out) == len(rows)
    for d, t in rows:
        t = t or ""
        r, after = got[(d, len(t))], first[ids[(ids.index(d) + 1) % len(ids)]]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert r["fingerprint"] == python_print(t)
        if d != 9:  # its next document has two texts
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["edited_fingerprint"] == python_print(edited)
            assert r["near_edited"] == pytest.approx(len(cut(t) & cut(edited)) / len(cut(t) | cut(edited)))
            assert r["near_next"] == pytest.approx(len(cut(t) & cut(after)) / len(cut(t) | cut(after)))
    assert got[(12, len(rows[4][1]))]["fingerprint"] == got[(13, len(rows[4][1]))]["fingerprint"] != got[(3, len(rows[1][1]))]["fingerprint"]
    assert fingerprints.edited_likeness(docs.limit(0)).count() == 0
    unnamed = spark.createDataFrame([(None, f"text {i % 3} without id") for i in range(9)] + [(1, "named")], "doc_id long, text string")
    assert fingerprints.edited_likeness(unnamed).count() == 10


def test_printed_fingerprints_peel(spark):
    """What two printed fingerprints tell on their own: few differing paragraphs, by subtracting and peeling their cells."""
    a = "\n".join(f"paragraph {i}" for i in range(300))
    b = a.replace("paragraph 7\n", "changed\n").replace("paragraph 250\n", "")
    cells = [[list(c) for c in struct.iter_unpack(">iqq", base64.b64decode(python_print(t).split(":")[1]))] for t in (a, b)]
    left = [[x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]] for x, y in zip(*cells, strict=True)]
    found = {"a": set(), "b": set()}
    while pure := next((c for c in left if abs(c[0]) == 1 and c[2] == xx(struct.pack("<q", -1), seed=xx(struct.pack("<q", c[1])) % (1 << 64))), None):
        n, x, _ = pure
        found["a" if n > 0 else "b"].add(x)
        for c, d in zip(left, python_sketch([x]), strict=True):
            c[:] = c[0] - n * d[0], c[1] ^ d[1], c[2] ^ d[2]
    assert not any(any(c) for c in left)
    assert found == {"a": {xx(p) for p in (b"paragraph 7", b"paragraph 250")}, "b": {xx(b"changed")}}


def test_peeling_recovers_every_digest(spark, monkeypatch):
    rng = random.Random(7)
    rows = []
    for i, (both, a, b) in enumerate([(0, 0, 0), (5, 0, 0), (0, 300, 1), (50, 3, 4), (1, 0, 900), (200, 40, 40)]):
        pool = [rng.randrange(-(2**62), 2**62) for _ in range(both + a + b)]
        rows.append((i, pool[: both + a], pool[:both] + pool[both + a :]))
    pairs = spark.createDataFrame(rows, "id int, a array<long>, b array<long>")
    got = fingerprints.differences(pairs, ["id"]).collect()
    for i, a, b in rows:
        assert {r["digest"] for r in got if r["id"] == i and r["side"] == "a"} == set(a) - set(b)
        assert {r["digest"] for r in got if r["id"] == i and r["side"] == "b"} == set(b) - set(a)
    assert len(got) == sum(len(set(a) ^ set(b)) for _, a, b in rows)
    monkeypatch.setattr(fingerprints, "LEVELS", 1)  # what is never told by a sketch is told by the sets
    few = fingerprints.differences(pairs, ["id"]).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, got))


def test_components_and_lookup_join(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 20), (20, 30), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 7, 30: 7} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    big = spark.range(1000).selectExpr("id", "id % 7 as k")
    small = stored(spark.range(5).selectExpr("id as k", "id * 10 as v"))
    import textmatch.functions.joins as common

    plain = sorted(lookup_join(big, small, ["k"]).collect())
    limit, common.BROADCAST_ROWS = common.BROADCAST_ROWS, 1
    try:
        assert sorted(lookup_join(big, small, ["k"], salt="id").collect()) == plain
    finally:
        common.BROADCAST_ROWS = limit


def test_native_plans_have_no_python(spark, sf):
    from textmatch.llm import queries

    for name in ("op1_mix", "op2_shard", "op10_fingerprint"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan), name
