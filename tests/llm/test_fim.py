"""Fill-in-middle against plain line splitting."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmatch.llm import fim

PARTS = ("<P>", "<S>", "<M>")


def plain_cut(text, first, second):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
    return len(units), any(m in text for m in PARTS), len("".join(units[:a])), len("".join(units[:b]))


def plain_row(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n, marked, a, b = plain_cut(text, h[0], h[1])
    if not text or marked:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 50
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def varied():
    draw = random.Random(5)
    shared = "".join(draw.choice("abcdefgh ,.\né😀") for _ in range(30_000))
    texts = [None, "", "\n", "a", "a\n", "\n\n\n", "<P", "x<P>y", "<" * 50, "a<S", "😀\n😀", shared, "front\n" + shared, shared[7000:] + "end", "z" * 100_000, "ab\n" * 40_000]
    texts += ["y" * k + "<M>" + "z" * 300 for k in (126, 127, 128, 8189, 8190, 8191)]  # markers across forced ends of chunks
    return [*texts, *["".join(draw.choice("ab\n<PSM>") for _ in range(draw.randrange(400))) for _ in range(100)]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n<P>é", max_size=900), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_located(text, first, second):
    assert fim.located(text, first, second, fim.ChunkCache(500)) == plain_cut(text, first, second)


def test_chunks_are_bounded_and_shared():
    draw = random.Random(2)
    shared = "".join(draw.choice("abcdefghij \n") for _ in range(50_000))
    cuts = fim.boundaries(shared)
    sizes = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
    assert cuts[-1] == len(shared) and max(sizes) <= fim.MOST and min(sizes[:-1]) >= fim.LEAST
    assert cuts == fim.boundaries(shared, block=1000) == fim.boundaries(shared, block=17)
    moved = {c - 13 for c in fim.boundaries("x" * 13 + shared)}
    assert len(moved & set(cuts)) > 0.8 * len(cuts)  # the same places behind other text
    cache = fim.ChunkCache(20_000)
    for _ in range(3):
        fim.located(shared[:15_000], 1, 2, cache)
    assert cache.hits >= 2 * len(fim.boundaries(shared[:15_000])) and cache.held <= 20_000
    for at in range(0, len(shared), 5000):
        fim.located(shared[at:], 1, 2, cache)
        assert cache.held <= 20_000 and cache.held == sum(map(len, cache.known))


def test_transformed_and_restored(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(varied())]
    rows += [rows[12], rows[12], (2**60 + 1, "one\ntwo\nthree")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "a": F.lit(2), "marked": F.lit(3)})
    out = fim.transformed(docs).withColumn("back", fim.restored(F.col("__output"), F.col("__form"))).collect()
    assert len(out) == len(rows)
    got = sorted((str(r["doc_id"]), r["text"] or "", r["__n"], r["__form"], str(r["__prefix_chars"]), str(r["__middle_chars"]), r["__output"]) for r in out)
    want = sorted((str(d), t or "", n, form, str(a), str(b), o) for d, t in rows for n, form, a, b, o in [plain_row(d, t)])
    assert got == want
    assert all(r["back"] == (r["text"] or "") for r in out)
    assert {r["__form"] for r in out} == {"plain", "psm", "spm"}


def test_rates_and_empty_table(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(400)], "doc_id long, text string")
    forms = {r["__form"]: r["count"] for r in fim.transformed(docs, rate=50, spm=0).groupBy("__form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 120 < forms["plain"] < 280
    assert fim.transformed(docs.limit(0)).count() == 0
