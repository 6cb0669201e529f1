"""Containment by rarest runs against every pair."""

import random

from textmatch.operators import postings as P
from textmatch.operators import substrings as S
from textmatch.operators import terms as T


def test_pairs_equal_all_pairs_and_are_few(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    hay = [(k, " ".join(draw.choices(words, k=draw.randint(1, 8)))) for k in (1, 2) for _ in range(600)] + [(1, ""), (1, None), (None, "a")]
    needles = [(k, " ".join(draw.choices(words, k=draw.randint(1, 2)))) for k in (1, 2, 3) for _ in range(150)]
    needles += [(1, x) for x in ("a", "ab", "é", "", None, "j ", "zzzzz")] + [(2, h[1][3:11]) for h in hay[600:640]] + [(None, "a")]
    a, b = spark.createDataFrame(needles, "k long, needle string"), spark.createDataFrame(hay, "k long, haystack string")
    want = {(k, n, h) for k, n in needles for j, h in hay if k is not None and k == j and n is not None and h is not None and n in h}
    got = [tuple(r) for r in S.substring_pairs(a, b, ["k"]).select("k", "needle", "haystack").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    tried = S.substring_candidates(a, b, ["k"]).where("length(needle) >= 4").count()
    every = sum(len(n) >= 4 for _, n in needles if n) * 600
    assert tried < 0.1 * every
    alone = S.substring_pairs(a.select("needle"), b.select("haystack"))
    assert {tuple(r) for r in alone.select("needle", "haystack").collect()} == {(n, h) for _, n in needles for _, h in hay if n is not None and h is not None and n in h}


def test_containment_join_keeps_rows(spark):
    claims = spark.createDataFrame([(1, "python", "x"), (1, "python", "y"), (1, "go", "z"), (2, "c", "w"), (1, None, "n")], "k long, claim string, who string")
    reqs = spark.createDataFrame([(1, "python 3", 1), (1, "yth", 2), (1, "yth", 3), (2, "python", 4), (1, "", 5), (2, "c", 6)], "k long, req string, n long")
    got = sorted((r["who"], r["n"]) for r in P.containment_join(claims, reqs, ["k"], "claim", "req").collect())
    assert got == [("w", 6), ("x", 1), ("x", 2), ("x", 3), ("x", 5), ("y", 1), ("y", 2), ("y", 3), ("y", 5), ("z", 5)]


def test_terms_with_white_space(spark):
    texts = spark.createDataFrame([(1, "Data  Engineer\nBig data"), (2, "subdata engine"), (3, "data\nengineer"), (4, "")], "doc_id long, text string")
    terms = spark.createDataFrame([("data engine",), ("Big Data",), ("data",), ("a\teng",), ("ata eng",)], "term string")
    got = sorted(map(tuple, T.contained_terms(texts, terms).collect()))
    assert got == [(1, "Big Data"), (1, "data"), (2, "ata eng"), (2, "data"), (2, "data engine"), (3, "data")]
