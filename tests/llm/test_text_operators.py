"""Line dedup, BPE, HTML, language, quality, Jaccard and neighbours against plain Python versions, and their odd cases."""

import hashlib
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textmatch.llm import ann, bpe, html, jaccard, language, lines, quality

SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def test_lines_found_in_ten_documents_go(spark):
    rng = random.Random(1)
    pool = ["Shared LINE", " shared line\t", "Été", "été", "", "  ", "rare", "x"] + [f"own {i}" for i in range(50)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(80, None, "k"), (81, "", None), (3, texts[3], "k"), (82, "x\n" * 5000, "k")]
    rows += [(i % 9, f"in nine\nunder nine ids {i}", "r") for i in range(12)] + [(None, "in nine\nwithout id", None)] * 3 + [(100 + i % 9, f"nine ids only\n{i}", "r") for i in range(12)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, pos string"), batches=3, fanout=3).collect()
    found = {}
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            found.setdefault(ascii_lower(line.strip(SPACE)), set()).add(d)
    gone = {k for k, docs in found.items() if len(docs) >= 10 and len(k) >= 1}
    assert gone and len(got) == len(rows) and "in nine" in gone and "nine ids only" not in gone
    for r in got:
        ls = (r["text"] or "").split("\n")
        kept = [x for x in ls if ascii_lower(x.strip(SPACE)) not in gone]
        assert (r["__kept"], r["__n_lines"], r["__n_dropped"]) == ("\n".join(kept), len(ls), len(ls) - len(kept))
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_compact_and_settle(spark):
    runs = lines.LineRuns(5, fanout=2)
    total = Counter()
    for b in range(5):
        batch = {k: (k + b) % 4 for k in range(20)}
        total.update(batch)
        new = spark.createDataFrame([(k, 0, n) for k, n in batch.items() if n], "h1 long, h2 int, n long")
        runs.add(new)
        assert all(len(level) < 2 for level in runs.levels) and len(runs.settled) < 2
        assert {r["h1"] for r in runs.frequent().collect()} == {k for k, n in total.items() if n >= 5}
    kept = runs._run(new)
    for frame in (runs.counted(kept), runs.merged(kept, runs.settled[0])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan  # runs are merged where they lie


def test_bpe_of_chunks_is_that_of_the_whole(spark):
    rng = random.Random(2)
    alphabet = ["a", "b", "é", "你", " ", "  ", "\n", "\n\n", "1", "23", "'s", "!", "...", "\t", "the ", " ", "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    texts += [None, "", "a" * 700, " " * 500, "x" * 150 + " " * 150 + "y" * 300, "<|endoftext|>" * 30, texts[0], "word " * 300]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (67, texts[67], 1)]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder, _, _ = bpe._coder(path, public_tokenizers.PATTERN)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.digests(docs, path, public_tokenizers.PATTERN, chunk=64, overlap=24).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(coder.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)
    back = bpe.encoded(docs, path, public_tokenizers.PATTERN, chunk=64, overlap=24).collect()
    assert sorted((r["doc_id"], bytes(r["decoded"]).decode()) for r in back) == sorted((i, t or "") for i, t, _ in rows)
    assert bpe.digests(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_keeps_ids_beside_nulls(spark):
    ids = [2**60 + 1, None, 2**60 + 3, 5, -(2**62) + 1, None]
    rows = [(i, t) for i in ids for t in ("short", "long text " * 40)]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for out in (bpe.digests(docs, path, public_tokenizers.PATTERN, chunk=64, overlap=24), bpe.encoded(docs, path, public_tokenizers.PATTERN, chunk=64, overlap=24)):
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([i for i in ids for _ in range(2)], key=str)
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType


@pytest.mark.parametrize("ids", ["null", "own"])
def test_rows_without_id_are_documents(spark, ids):
    """Twelve rows that share a line lose it, with ids or without, alike texts or not; SQL agrees."""
    import duckdb

    from textmatch.llm import queries

    rows = [(None if ids == "null" else i, f"shared\nown {i % 11}") for i in range(12)] + [(100 + i, "nine\nnine") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in lines.dedup_lines(docs, min_docs=10).collect())
    assert got == sorted([(str(d), 2, 1, t.split("\n")[1]) for d, t in rows[:12]] + [(str(d), 2, 0, t) for d, t in rows[12:]])
    documents = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841 - read by the SQL
    sql = duckdb.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.ORACLE['op8_lines']})").fetchall()
    assert sorted((str(d), n, m, h) for d, n, m, h in sql) == sorted((d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in got)


@pytest.mark.parametrize("rows_of_one", [1, 400])
def test_samples_hold_their_bound(spark, rows_of_one):
    from textmatch.llm.common import sampled

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(7, f"more {i}") for i in range(rows_of_one)] + [(None, "x")], "doc_id long, text string")
    ids = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, y int")
    out = sampled(docs, ids, 210).collect()
    assert len(out) == (201 if rows_of_one == 1 else 199) and len({r["doc_id"] for r in out}) >= 199
    assert len(sampled(docs, ids, 50).collect()) <= 50


def test_fits_see_no_more_rows_than_they_say(spark, monkeypatch):
    from textmatch.llm import common

    sizes = []
    keep = common.sampled
    for module in (quality, language):
        monkeypatch.setattr(module, "sampled", lambda *a: (lambda out: (sizes.append(out.count()), out)[1])(keep(*a)))
    docs = spark.createDataFrame([(i, f"a text {i}", "en") for i in range(100)] + [(3, f"one id {i}", "de") for i in range(900)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    quality.fit(docs, labels, fit_rows=60, steps=2)
    language.fit(docs, fit_rows=60)
    assert len(sizes) == 2 and max(sizes) <= 60 and min(sizes) > 0


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("<nav><a href=x>Menu</a></nav>", ""),
        ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav>m</nav><div class=ad>buy</div><article><h1>A &amp; B</h1><p>One,\n two<p>Three<b> four</article><footer>f</footer>", "A & B\nOne, two\nThree four"),
        ("<body><div id='content'><p>A long first paragraph, with commas, in the main part of it.</p><ul><li>point one</li><li>point two</ul></div><div class='comments'><p>I, a reader, say, something long, about the article here.</p></div>", "A long first paragraph, with commas, in the main part of it.\npoint one\npoint two"),
        ("<main><p>kept</p><form><p>not kept</p></form><aside>no</aside><p>also &#233; &copy</main>", "kept\nalso é ©"),
        ("<article><p>unended <!-- comment", "unended"), ("<article><p>a < b</p>", "a < b"), ("<article><p>x</p><div hidden>secret</div></article>", "x"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


LONG = "A real paragraph, with commas, that says what the page is about, at some length."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article class='post has-sidebar'><p>{LONG}</p></article>", LONG),
        (f"<div id='page' class='with-comments'><div class=entry><p>{LONG}</p></div></div>", LONG),
        (f"<div class='content-ad-free'><p>{LONG}</p></div>", LONG),
        (f"<div class='no-search'><main><p>{LONG}</p></main></div>", LONG),
        (f"<article class='promo'><p>{LONG}</p></article>", LONG),
        (f"<div class='sidebar layout'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='widget-text'><p>{LONG}</p></div>", LONG),
        (f"<div class='modal'><p>{LONG}</p></div><div><p>Short.</p></div>", LONG),
        (f"<body><article><p>{LONG}</p></article><article><p>Part two, the same story.</p></article></body>", f"{LONG}\nPart two, the same story."),
        (f"<main><article><p>{LONG}</p></article><section id='comments'><article class='comment'><p>{LONG} {LONG}</p></article></section></main>", LONG),
        (f"<article><p>{LONG}</p></article><div class='cookie-banner'><p>{LONG}</p></div>", LONG),
        ("<div class=ad>buy</div>", ""),
    ],
)
def test_names_do_not_cost_the_article(page, want):
    assert html.main_text(page) == want


def filler(i, sentences=3):
    return " ".join(f"Sentence {i}.{k} goes on, with a comma, for about as long as sentences do." for k in range(sentences))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><form action=x><div><p>{filler(1)}</p><input name=q><p>{filler(2)}</p></div></form></body>", f"{filler(1)}\n{filler(2)}"),
        (f"<body><div class='search-results-article'><p>{filler(1)}</p></div></body>", filler(1)),
        (f"<main><article><p>{filler(1)}</p></article><article><p>{filler(2)}</p></article></main>", f"{filler(1)}\n{filler(2)}"),
        (f"<article><p>intro</p></article><div class=content><p>{filler(1)}</p><p>{filler(2)}</p></div>", f"intro\n{filler(1)}\n{filler(2)}"),
        (f"<div><h1>Title</h1></div><div><p>{filler(1)}</p><p>Short.</p><p>{filler(2)}</p></div><div><p>Imprint and such.</p></div>", f"Title\n{filler(1)}\nShort.\n{filler(2)}"),
        (f"<article><section><p>{filler(1)}</p><p>{filler(2)}</p></section><section><h2>End</h2><p>Bye.</p></section></article>", f"{filler(1)}\n{filler(2)}\nEnd\nBye."),
        (f"<div><ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a></ul><p>{filler(1)}</p><p>{filler(2)}</p></div>", f"{filler(1)}\n{filler(2)}"),
        (f"<div><p>{filler(1)}</p></div><div class=comments><p>{filler(2, 9)}</p><p>{filler(3, 9)}</p></div>", filler(1)),
        (f"<div><p>{filler(1)}</p></div><h3>More</h3><div><p><a href=x>{filler(2)}</a></p></div>", filler(1)),
    ],
)
def test_scores_choose_the_article(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><section id='introduction'><p>{filler(1)}</p></section><section id='related-work'><h2>Related work</h2><p>{filler(2)}</p></section></article>", f"{filler(1)}\nRelated work\n{filler(2)}"),
        (f"<article><p>Take <span class='alert'>great care</span> of it.</p><p>{filler(1)}</p></article>", f"Take great care of it.\n{filler(1)}"),
        (f"<article><p>See <a class=related href=x>this one</a> too.</p><p>{filler(1)}</p></article>", f"See this one too.\n{filler(1)}"),
        (f"<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><p>{filler(1)}</p></article>", f"So x=1 holds.\n{filler(1)}"),
        (f"<body><section><h2>One</h2><p>{filler(1, 9)}</p></section>" + "".join(f"<section><h2>S{i}</h2><p>Short part {i}.</p></section>" for i in range(4)) + "</body>", f"One\n{filler(1, 9)}\n" + "\n".join(f"S{i}\nShort part {i}." for i in range(4))),
        ("<article><p>a &am<b>p;b</b> c &amp; d</p></article>", "a &amp;b c & d"),
        (f"<article><p>{filler(1)}</p><div class='related'><a href=a>One more story</a> <a href=b>And one more</a></div><div class='newsletter-box'><p>Join us today, all of you.</p></div></article>", filler(1)),
        (f"<article><p>{filler(1)}</p><div class='comments'><p>{filler(2)}</p></div></article>", filler(1)),
    ],
)
def test_text_of_an_article_stays(page, want):
    assert html.main_text(page) == want


def test_given_pages_without_their_article_elements(spark, sf):
    """What elements are called is taken away, so that points have to choose."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    same = [html.main_text(re.sub(r"<(/?)(article|main|section)\b", r"<\1div", p)) == html.main_text(p) for p in pages]
    assert sum(same) >= 0.95 * len(pages)


def test_scoring_decides_where_no_element_is_an_article(monkeypatch):
    """Pages of plain div elements: text and what stands around it, told apart by points alone; without points they change."""
    rng = random.Random(8)
    pages, wants = [], []
    for i in range(40):
        text = [filler(10 * i + k, rng.randint(2, 4)) for k in range(rng.randint(2, 6))]
        around = [f"<div><div>Box {i} {k}</div><div><a href=x>go</a> to it</div></div>" for k in range(rng.randint(1, 4))]
        parts = [*around, f"<div><div>{''.join(f'<p>{t}' for t in text)}</div></div>"]
        rng.shuffle(parts)
        pages.append(f"<html><body>{''.join(parts)}</body></html>")
        wants.append("\n".join(text))
    assert [html.main_text(p) for p in pages] == wants
    monkeypatch.setattr(html, "REACH", 0)  # no element gets points
    assert [html.main_text(p) for p in pages] != wants


class Articles(HTMLParser):
    """The text of article elements, read by the standard library's parser; enough for pages like the given ones."""

    BREAKS = {"p", "h1", "article"}

    def __init__(self, page):
        super().__init__()
        self.depth, self.blocks = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in self.BREAKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in self.BREAKS:
            self.blocks.append("")

    def handle_data(self, data):
        self.blocks[-1] += data if self.depth else ""

    def text(self):
        return "\n".join(b for b in (" ".join(b.split()) for b in self.blocks) if b)


def test_given_pages_agree_with_another_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["__text"] for r in html.extracted(pages).collect()}
    assert got == {r["page_id"]: Articles(r["html"] or "").text() for r in pages.collect()}


@pytest.mark.parametrize(
    "part",
    ["<div>word ", "<a ", "<p>word ", "<b>x", "</x>", "<div><tr></tr>", "<li><ul><div>", "<!--", "<div class='", '<a b="', "<li>word", "< ", "&amp;", "<span class=ad>x", "a,<br>", "<p><b><i>", "<![", "<script>", "-->", "<div class=comments>text "],
)
def test_hostile_pages_take_time_in_proportion(part):
    took = []
    for size in (250_000, 1_000_000):
        page, began = part * (size // len(part)), time.perf_counter()
        html.main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1  # four times the page; quadratic time would take sixteen times as long, and minutes


def test_extracted_keeps_rows_and_columns(spark):
    article = "<article><p>hi</p></article>"
    rows = [(1, "u", article, "c"), (1, "u", article, "c"), (2, None, None, None), (3, "v", "<p>" + "long text, and more. " * 20_000, "d"), (None, None, "", "e")]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(1, "c", "hi"), (1, "c", "hi"), (2, None, ""), (3, "d", ("long text, and more. " * 20_000).strip()), (None, "e", "")]
    assert sorted(((r["page_id"], r["text"], r["__text"]) for r in got), key=str) == sorted(want, key=str)
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def python_classes(rows, words=5):
    sets, rep = {}, {}
    for d, t in rows:
        w = (t or "").lower().encode().split()
        sets[d] = (b" ".join(w), {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    for d in sorted(sets):
        rep.setdefault(sets[d][0], d)
    parent, links, ids = {r: r for r in rep.values()}, Counter(), sorted(rep.values())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a][1], sets[b][1]
            if x and y and 10 * len(x & y) >= 8 * len(x | y):
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    copies = Counter(sets[d][0] for d in sets)
    return {d: (find(rep[sets[d][0]]), links[rep[sets[d][0]]], copies[sets[d][0]]) for d in sets}


def test_jaccard_finds_all_links(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([1, 2, 9, 40]) if g else 150):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    for t in (None, "", "  \n", "one", "ONE", "two three", "w1 w2 w3 w4 w5 " * 4000):
        rows.append((len(rows), t))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, links int")
    want = python_classes(rows)
    for config in (jaccard.JaccardConfig(), jaccard.JaccardConfig(block=16), jaccard.JaccardConfig(block_chars=3000)):
        got = {r["doc_id"]: (r["class_id"], r["links"], r["copies"]) for r in jaccard.similar(docs, config).collect()}
        assert got == want
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _, _ in want.values()})
    assert jaccard.similar(docs.limit(0)).count() == 0


def test_pruning_bounds_follow_the_posterior():
    config = jaccard.JaccardConfig()
    bounds = config.least_equal()
    assert [n for n, _ in bounds] == [21, 42, 63] and all(0 < m < n * 0.8 for n, m in bounds)


def test_neighbours_recall_order_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[100:500] = x[100]  # one common vector
    rows = [(i, [float(v) for v in r], "z") for i, r in enumerate(x.astype(np.float32))]
    rows += [(2000, None, "z"), (2020, [0.0] * 16, "z"), (2040, [float("nan")] * 16, "z"), (2060, [1.0, 2.0], "z"), (2080, [None] * 16, "z"), (7, rows[7][1], "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    e, hit = x.astype(np.float32).astype(np.float64), 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, found in got.items():
        found.sort()
        score = e @ e[q]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert np.allclose([s for _, _, s in found], score[[v for _, v, _ in found]])
        best = [v for v in sorted(range(1500), key=lambda v: (-round(score[v], 9), v)) if v != q][:20]
        hit += len(set(best) & {v for _, v, _ in found})
    assert hit / (20 * len(got)) >= 0.9
    few = table.where("vec_id < 5")
    assert Counter(r["query_id"] for r in ann.nearest(few, few, 20).collect()) == {i: 4 for i in range(5)}
    assert ann.nearest(table.limit(0), table, 20).count() == 0


def test_neighbours_among_near_copies(spark):
    """A third of all rows lie close to one vector: what lists meet must be ranked exactly, not cut by footrule."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = rng.permutation(9000)[:3000]
    x[near] = x[near[0]] + rng.normal(size=(3000, 64)) * 10 ** rng.uniform(-4, -2, size=(3000, 1))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    asked, e, hit = set(near[:100].tolist()), x.astype(np.float64), 0
    got = {q: set() for q in asked}
    for r in ann.nearest(table, table.where(F.col("vec_id").isin(list(asked))), 20).collect():
        got[r["query_id"]].add(r["vec_id"])
    for q in asked:
        score = e @ e[q]
        score[q] = -2
        hit += len(set(np.argsort(-score)[:20].tolist()) & got[q])
    assert hit / (20 * len(asked)) >= 0.99


def test_neighbours_recall_on_the_given_table(spark, sf):
    """The registered query's table at hand, every query against brute force."""
    from textmatch.llm import queries

    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(rows)
    x, got, hit = np.array([rows[i] for i in ids], np.float64), {}, 0
    for r in queries.op6_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(got) == asked
    for q in asked:
        score = x @ x[ids.index(q)]
        score[ids.index(q)] = -np.inf
        hit += len({ids[j] for j in np.argsort(-score, kind="stable")[:20]} & got[q])
    assert hit / (20 * len(asked)) >= 0.9


def test_footrule_decides_what_is_scored(spark, sf):
    """Far fewer vectors are scored than are met, on the given table and on a clustered one."""
    given = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    met, scored = ann.shares(given, given.where("vec_id % 40 = 0"))
    assert met > 0.8 and scored < 0.5 * met
    rng = np.random.default_rng(8)
    x = (np.repeat(rng.normal(size=(40, 32)), 150, axis=0) + 0.3 * rng.normal(size=(6000, 32))).astype(np.float32)
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    met, scored = ann.shares(table, table.where("vec_id % 100 = 0"))
    assert met > 0.8 and scored < 0.4 * met


def test_footrule_of_files_is_that_of_lists():
    rng = np.random.default_rng(9)
    lists = np.array([rng.permutation(30)[:8] for _ in range(200)], np.uint16)
    query = rng.permutation(30)[:12].astype(np.uint16)
    near = ann._Files(lists, 30).nearness(query, 12)

    def footrule(row):
        place_a, place_b = ({p: i for i, p in enumerate(r.tolist())} for r in (query, row))
        return sum(abs(place_a.get(p, 12) - place_b.get(p, 12)) for p in range(30))

    distances = [footrule(row) for row in lists]
    assert len({d + 2 * int(n) for d, n in zip(distances, near, strict=True)}) == 1


def test_neighbours_of_each_length(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(v) for v in rng.normal(size=4 if i % 3 else 7)]) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(table, table.where("vec_id < 30"), 5).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(30):
        same = [(-sum(a * b for a, b in zip(np.float32(rows[q][1]).tolist(), np.float32(v).tolist(), strict=True)), i) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        assert got[q] == [i for _, i in sorted(same)[:5]]


def test_reranking_goes_on_while_it_finds_better_ones():
    score = np.arange(1000) % 977 * 1.0
    names, spread, tied = np.arange(1000), np.arange(1000), np.zeros(1000, int)

    def found(distance, scores):
        return ann._reranked(names, distance, lambda new: scores[new], lambda new: scores[new], names, 5, 10, 10)[0].tolist()

    assert found(tied, score) == [976, 975, 974, 973, 972]  # all tie, so all are reranked
    assert found(spread, -score) == [0, 1, 2, 3, 4]  # stops after a step without a better one
    assert found(spread, score) == [976, 975, 974, 973, 972]


def test_neighbours_are_complete_where_lists_hold_few(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(400, 16)).astype(np.float32))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    few = ann.nearest(table, table.where("vec_id < 50"), 20, ann.IndexConfig(post=1, probe=1)).collect()
    assert Counter(r["query_id"] for r in few) == dict.fromkeys(range(50), 20)


def test_quality_on_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.scored(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("__quality", "quality").collect()
    right = sum((r["__quality"] >= 0.5) == bool(r["quality"]) for r in rows)
    assert right / len(rows) >= 0.95


def python_sites(rows, prior):
    """rows: (host, path, own probability). Site rate and final probability of each, by the formulas in plain Python."""

    def strength(groups):
        weight, good = sum(n for n, _, _ in groups), sum(s for _, s, _ in groups)
        mean = good / weight
        spread = sum(n * (s / n - rate) ** 2 for n, s, rate in groups) / weight
        between = max(spread - mean * (1 - mean) * len(groups) / weight, 1e-6)
        return min(1000.0, max(2.0, mean * (1 - mean) / between - 1))

    paths, hosts = {}, {}
    for h, p, d in rows:
        for table, key in ((paths, (h, p)), (hosts, h)):
            n, s = table.get(key, (0, 0.0))
            table[key] = (n + 1, s + d)
    rate = sum(s for _, s in hosts.values()) / sum(n for n, _ in hosts.values())
    k = strength([(n, s, rate) for n, s in hosts.values()])
    of_host = {h: (s + k * rate) / (n + k) for h, (n, s) in hosts.items()}
    k = strength([(n, s, of_host[h]) for (h, _), (n, s) in paths.items()])
    out = []
    for h, p, d in rows:
        n, s = paths[(h, p)]
        site = (s - d + k * of_host[h]) / (n - 1 + k)
        safe, own, base = min(max(site, 1e-4), 1 - 1e-4), min(max(d, 1e-9), 1 - 1e-9), min(max(prior, 1e-4), 1 - 1e-4)
        odds = own / (1 - own) * safe / (1 - safe) * (1 - base) / base
        out.append((site, odds / (1 + odds)))
    return out


def test_site_evidence_equals_plain_python(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "lone", None), (2, "same text", "lone", None), (2, "same text", "lone", None)], "doc_id long, text string, lang string, source string")
    docs = docs.select("doc_id", "text", "lang", "source").unionByName(odd).withColumn("rate", F.lit("x"))
    model = quality.fit(docs, labels)
    got = quality.scored(docs, model, keep=("doc_id", "text", "source", "lang", "rate")).collect()
    own = {}
    for r in got:
        x = quality._standardised(quality.features(r["text"])[None, :], model.mean, model.scale)[0]
        own[r["text"]] = 1 / (1 + np.exp(-np.clip(float((x * model.weights).sum(dtype=np.float64)) + model.bias, -12, 12)))
        assert r["__doc"] == pytest.approx(own[r["text"]], abs=1e-6)
    want = python_sites([(r["source"], r["lang"], r["__doc"]) for r in got], model.prior)
    assert len(got) == docs.count()
    for r, (site, final) in zip(got, want, strict=True):
        assert (r["__site"], r["__quality"]) == (pytest.approx(site, rel=1e-6), pytest.approx(final, rel=1e-6))


def test_features_of_odd_texts():
    assert (quality.features(None) == quality.features("")).all() and quality.features("x").shape == (quality.BUCKETS + quality.RATIOS,)
    long = quality.features("Der " * 200_000)
    assert np.isfinite(long).all() and long[quality.BUCKETS + 2] > 0.99 > 0.1 > long[quality.BUCKETS + 1]


def test_sparse_sites_are_shrunk(spark):
    good, bad = "Plain words make a sentence here. " * 8, "SHOUT!! ING!! ALL!! DAY!! "
    rows = [(i, good if i % 3 else bad, f"s{i % 5}", "en") for i in range(200)] + [(500 + i, good, "clean", "en") for i in range(60)] + [(900, good, "lone", None), (901, None, None, None), (902, "", None, "x")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, lang string, quality string")
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(150)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    assert len(got) == len(rows) and got[500]["__site"] > got[900]["__site"] > 0
    assert all((got[i]["__quality"] >= 0.5) == bool(i % 3) for i in range(200))
    assert quality.scored(docs.limit(0), model).count() == 0
    flat = quality.fit(docs, labels.limit(0))
    assert flat.prior == 0.5 and quality.scored(docs, flat).count() == len(rows)


def test_languages_by_text_and_by_site(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").selectExpr("doc_id", "lang as truth", "text", "cast(null as string) html", "cast(null as string) declared", "cast(null as string) suffix", "cast(null as string) domain", "source host")
    rows = language.fused(held, model, keep=("doc_id", "truth")).collect()
    assert sum(r["lang"] == r["truth"] for r in rows) / len(rows) >= 0.95
    german = [r["text"] for r in docs.where("lang = 'de' and length(text) > 300").limit(8).collect()]
    pages = [(i, t, None, "de", "de", "a.de", "www.a.de") for i, t in enumerate(german)] + [(50, "", None, "de", "de", "a.de", "www.a.de"), (51, None, None, None, None, None, None), (52, "1 2 3", None, None, "de", "a.de", "new.a.de")]
    table = spark.createDataFrame(pages, "page_id long, text string, html string, declared string, suffix string, domain string, host string")
    got = {r["page_id"]: r["lang"] for r in language.fused(table, model, keep=("page_id",)).collect()}
    assert len(got) == len(pages) and got[50] == got[52] == "de"
    assert language.fused(table.limit(0), model, keep=("page_id",)).count() == 0
    assert language.fit(docs.limit(0)).languages == ()


def python_fusion(rows, model, fusion=language.Fusion()):
    """rows: (text, declared, suffix, domain, host). Language and probability of each, by the formulas in plain Python."""
    k = len(model.languages)
    ll = []
    for text, *_ in rows:
        at = language.trigrams(text)
        total = model.table[at].sum(axis=0, dtype=np.float64) * min(1.0, fusion.effective / len(at)) if len(at) else np.zeros(k)
        ll.append(np.round(total - total.max(), 6))
    soft = [np.exp(x) / np.exp(x).sum() for x in ll]
    world = sum(soft) + 1.0

    def sums(*at):
        out = {}
        for r, p in zip(rows, soft, strict=True):
            key = tuple(r[i] for i in at)
            out[key] = out.get(key, 0) + p
        return out

    def emission(at):
        def of(seen):
            share = (seen.sum() + fusion.smooth) / (world.sum() + fusion.smooth)
            return fusion.discount * np.log((seen + fusion.smooth * share) / (world + fusion.smooth) / share)

        return {key: np.zeros(k) if key[0] is None else of(seen) for key, seen in sums(at).items()}

    prior = world / world.sum()
    of_domain = {key: (p + fusion.domain * prior) / (p.sum() + fusion.domain) for key, p in sums(3).items()}
    of_host = {key: np.log((p + fusion.host * of_domain[key[:1]]) / (p.sum() + fusion.host)) for key, p in sums(3, 4).items()}
    declared, suffix, out = emission(1), emission(2), []
    for r, x in zip(rows, ll, strict=True):
        score = x + declared[(r[1],)] + suffix[(r[2],)] + of_host[(r[3], r[4])]
        chance = np.exp(score - score.max())
        out.append((model.languages[int(np.argmax(score))], chance.max() / chance.sum()))
    return out


def test_fused_evidence_equals_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    rows = []
    for i, r in enumerate(docs.orderBy("doc_id").limit(120).collect()):
        n = 9 if i % 2 else None
        rows.append(((r["text"] or "")[: 3 if i % 7 == 0 else n], [None, r["lang"], "de", "xx"][i % 4], [None, "de", "com"][i % 3], [None, "a.de", "b.com"][i % 3], [None, f"w{i % 5}.a.de", "b.com"][i % 3]))
    rows += [rows[5]] * 3 + [(None, None, None, None, None), ("", "fr", "fr", "x.fr", "x.fr"), ("mot de la fin " * 60_000, None, None, None, None)]
    table = spark.createDataFrame([(i, "", *r, "c", "c") for i, r in enumerate(rows)], "page_id long, html string, text string, declared string, suffix string, domain string, host string, best string, score string")
    got = language.fused(table, model, keep=("page_id", "score")).orderBy("page_id").collect()
    assert len(got) == len(rows)
    for r, (lang, chance) in zip(got, python_fusion(rows, model), strict=True):
        assert r["probability"] == pytest.approx(chance, rel=1e-5) and (r["lang"] == lang or chance < 0.5001)


def test_page_evidence_is_read(spark):
    rows = [("https://u@WWW.Example.co.uk:80/x?y#z", '<!DOCTYPE html><html class="a" LANG="en-GB"><head>'), ("nonsense", "<p>"), (None, None)]
    table = spark.createDataFrame(rows, "url string, html string")
    got = table.select(*[v.alias(c) for c, v in language.site_columns(F.col("url")).items()], language.declared_language(F.col("html")).alias("l")).collect()
    assert tuple(got[0]) == ("www.example.co.uk", "co.uk", "uk", "en") and tuple(got[1])[0] is None and tuple(got[2]) == (None, None, None, None)


def test_jaccard_of_rows_without_or_with_one_id(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(None, words), (None, "other text of seven words in all"), (4, words + " end"), (4, "one id with a second, different text"), (9, words.upper()), (9, words.upper()), (None, None), (7, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, keep string")
    got = sorted(((r["doc_id"], r["class_id"], r["links"], r["copies"]) for r in jaccard.similar(docs).collect()), key=str)
    want = [(None, 4, 1, 2), (None, None, 0, 1), (4, 4, 1, 1), (4, 4, 0, 1), (9, 4, 1, 2), (9, 4, 1, 2), (None, 7, 0, 2), (7, 7, 0, 2)]
    assert got == sorted(want, key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(4, words + " end"), (4, "one id with a second, different text"), (None, "other text of seven words in all"), (7, "")], key=str)


def test_only_pairs_that_pruning_leaves_are_verified():
    """A long chain of texts of which neighbours have a similarity near 0.6: pairs compared grow with the chain, not its square."""
    rng = random.Random(6)
    words = [f"v{rng.randrange(10**6)}" for _ in range(200 + 45 * 120)]
    texts = [" ".join(words[45 * i : 45 * i + 200]) for i in range(120)]
    config = jaccard.JaccardConfig()
    frame = pd.DataFrame({"key": [str(i).encode() for i in range(120)], "text": texts, "band": 0, "bucket": 0, "i": 0, "j": 0, "home": 0})
    a = np.random.default_rng(1).integers(0, 2**62, config.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sigs = [jaccard._signature(jaccard.shingles(jaccard.normalised(t), 5), a, a[::-1]) for t in texts]
    for s in sigs:
        s[:3] = 7  # all meet in the first band
    frame["sig"] = [s.tobytes() for s in sigs]
    left, right = jaccard._pairs(config, frame)
    assert (right - left <= 2).all() and len(left) <= 130
    assert not list(jaccard._verified(config)(iter([frame])))
