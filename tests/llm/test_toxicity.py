"""Toxicity: automaton against edit distance, contexts, odd rows, and accuracy on labels that were held out."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmatch.llm import toxicity as X

TERMS = ("moron", "idiot", "scum", "disgusting", "worthless", "vile*", "réeux*")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_found(word, terms):
    best = None
    for i, term in enumerate(terms):
        if term[-1] == "*":
            errors = min((distance(word[:n], term[:-1]) for n in range(1, len(word))), default=99)
        else:
            errors = distance(word, term)
        if errors <= X.allowed_errors(term) and (best is None or (errors, -len(term), i) < best):
            best = (errors, -len(term), i)
    return (best[2], best[0]) if best else None


@settings(max_examples=500, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["", "x", "o", "ee", "é"]), st.booleans()), max_size=3), st.sampled_from(["", "s", "pa"]))
def test_automaton_is_edit_distance(term, edits, tail):
    word = term.rstrip("*") + tail
    for at, put, drop in edits:
        word = word[:at] + put + word[at + drop :]
    assert X.Automaton(TERMS).found(word) == plain_found(word, TERMS)


def test_random_words_against_edit_distance():
    draw, automaton = random.Random(3), X.Automaton(TERMS)
    for _ in range(4000):
        word = "".join(draw.choice("moridtscuvleéx") for _ in range(draw.randrange(1, 9)))
        assert automaton.found(word) == plain_found(word, TERMS), word
    assert len(automaton.states) < X.STATES
    assert X.Automaton(TERMS, frozenset(["oron"])).found("oron") is None and X.Automaton(TERMS).found("oron") == (0, 1)


def test_quotations():
    assert X.words('He said "you idiot" and left "open') == (["he", "said", "you", "idiot", "and", "left", "open"], {2, 3})
    assert X.words("> quoted line\nplain «mot» st*pid") == (["quoted", "line", "plain", "mot", "st*pid"], {0, 1, 3})
    assert X.words("") == ([], set())
    alone = X.features([(10, 4.0, True)], 40)
    plain = X.features([(10, 4.0, False)], 40)
    beside = X.features([(10, 4.0, True), (14, 4.0, False)], 40)
    two = X.features([(10, 4.0, False), (14, 4.0, False)], 40)
    far = X.features([(10, 4.0, False), (900, 4.0, False)], 40)
    assert alone < plain < two and beside == two and far[0] < two[0] and far[1] == two[1]
    assert X.features([], 0) == (0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("abcdefghiklmnoprstu") for _ in range(draw.randrange(2, 9))) for _ in range(400)] + ["oron"] * 20
    rows, labels = [], []
    for i in range(1200):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(30, 120))]
        toxic = i % 8 == 0
        for _ in range(draw.randrange(2, 6) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["moron", "idiot", "worthless"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(rows), dict(labels)


@pytest.fixture(scope="module")
def model(made):
    return X.fit(made[0], made[1])


def test_fit_learns_terms_and_neighbours(model):
    assert {"moron", "idiot", "worthless"} <= set(model.terms)
    assert "oron" in model.other
    assert min(model.weights) >= 0 and max(model.weights) > 0


def test_misspelt_and_quoted(made, model):
    clean = made[2][1].split()[:40]
    base = X.probability(" ".join(clean), model)

    def with_words(*more):
        words = list(clean)
        words[20:20] = more
        return X.probability(" ".join(words), model)

    assert base < 0.1 and with_words("oron", "oron") == pytest.approx(base)
    assert with_words("idiot", "moron") > 0.9
    assert with_words("idi0t", "m0ron", "wortless") > 0.3 > base
    assert with_words('"idiot"') < with_words("idiot")
    assert X.probability("", model) == X.probability("   \n", model) < 0.3


def test_held_out_labels_are_never_seen(spark, made, model):
    docs, labels, _, _ = made
    held = {i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r[0] for r in docs.where(X.held_out(F.col("doc_id"))).select("doc_id").collect()} == held
    turned = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.fit(docs, turned) == model
    out = {r["doc_id"]: r["__score"] for r in X.scored(docs, model).collect()}
    right = [(out[i] >= 0.3) == bool(made[3][i]) for i in held]
    assert np.mean(right) > 0.98


def test_fit_never_reads_more_than_its_bound(spark, made, monkeypatch):
    docs, labels, _, _ = made
    sizes = []
    keep = X.stored
    monkeypatch.setattr(X, "stored", lambda df: (lambda out: (sizes.append(out.count()), out)[1])(keep(df)))
    many = docs.unionByName(spark.range(500).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("idiot "), F.col("id").cast("string")).alias("text")))
    X.fit(many, labels, fit_rows=300)
    assert len(sizes) == 1 and 290 <= sizes[0] <= 300  # the id on 501 rows is left out


def test_odd_rows(spark, model):
    rows = [(None, None), (1, None), (2, ""), (3, "idiot moron"), (3, "idiot moron"), (2**60 + 1, "idiot " * 50_000), (4, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "y": F.lit(2), "kind": F.lit("k")})
    out = X.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["__score"] <= 1 for r in out)
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    assert len({r["__score"] for r in out if r["doc_id"] == 3}) == 1
    assert X.scored(docs.limit(0), model).count() == 0
    none = X.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.terms == () and X.probability("idiot", none) == pytest.approx(0.5)
    one_kind = X.fit(docs, spark.createDataFrame([(i, 0) for i in range(20)] + [(None, 1)], "doc_id long, toxic int"))
    assert one_kind.terms == () and X.probability("idiot", one_kind) < 0.3


def test_accuracy_on_the_given_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = X.scored(docs.join(labels.where(X.held_out(F.col("doc_id"))), "doc_id").select("toxic", "text"), X.fit(docs.select("doc_id", "text"), labels))
    rows = [(r["toxic"], r["__score"]) for r in scored.select("toxic", "__score").collect()]
    hit = sum(t == 1 and s >= 0.3 for t, s in rows)
    assert hit / sum(t for t, _ in rows) > 0.92 and hit / sum(s >= 0.3 for _, s in rows) > 0.95
