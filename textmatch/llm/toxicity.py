"""Toxicity: a trie of learned terms met by Levenshtein automata, and context windows that tell abuse from quotation."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.llm.common import sampled, stored

#: Labelled rows that the lexicon and the weights are fitted on, at most: those with the smallest hashes of doc_id.
FIT_ROWS = 8_000
#: Terms of the lexicon at most, toxic documents that a term must be found in, and its least evidence in standard errors.
TERMS, SUPPORT, EVIDENCE = 512, 5, 4.0
#: Letters of a term, and of a word's beginning, at least; beginnings are as long as STEM at most.
SHORTEST, STEM = 3, 12
#: Part of a term's evidence that a spelling with one error more carries, while labels don't say otherwise.
MISSPELT = 0.7
#: Tokens on either side that make up a hit's context, and the part of its evidence that a hit inside a quotation keeps.
WINDOW, QUOTED = 12, 0.25
#: States of the automaton that a worker remembers at most.
STATES = 50_000
#: Words that a worker remembers what they are at most.
WORDS = 200_000
#: Words, with signs inside that stand for a letter; marks that open, close, or do both for a quotation.
WORD = re.compile(r"\w+(?:[*@$!]\w+)*")
MARKED = re.compile(WORD.pattern + r"|[\"“”„«»‹›]")
OPENS, CLOSES, EITHER = frozenset("“„«‹"), frozenset("”»›"), '"'
QUOTES = '"“”„«»‹›'
FEATURES = 3


def words(text: str) -> tuple[list[str], set[int]]:
    """Words of a text in lower case, and the places of those in a quotation: between marks in one line, or in a line that
    a mail quotes with >."""
    text = text.lower()
    if not any(mark in text for mark in QUOTES + ">"):
        return WORD.findall(text), set()
    out: list[str] = []
    quoted: set[int] = set()
    for line in text.split("\n"):
        if line.lstrip(" \t").startswith(">"):
            more = WORD.findall(line)
            quoted.update(range(len(out), len(out) + len(more)))
            out += more
        elif any(mark in line for mark in QUOTES):
            inside = False
            for m in MARKED.finditer(line):
                word = m[0]
                if word == EITHER:
                    inside = not inside and line.find('"', m.end()) >= 0
                elif word in OPENS or word in CLOSES:
                    inside = word in OPENS
                else:
                    if inside:
                        quoted.add(len(out))
                    out.append(word)
        else:
            out += WORD.findall(line)
    return out, quoted


@dataclass
class Automaton:
    """All terms within some edits of a word, found by walking the trie of terms and their Levenshtein automata at once.

    A state is a set of (trie node, errors so far). States and their steps are made when they are first met and remembered,
    so a word costs a look-up for each of its letters, and most words end in the dead state after a few. A term that ends
    in * stands for longer words with that beginning. Terms of five letters or more may have one error, and whole words
    of nine or more two; the first letter of a beginning is exact.
    """

    terms: tuple[str, ...]
    other: frozenset[str] = frozenset()  # words that are close to a term but not meant for it
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, list[int]] = field(default_factory=dict)
    reach: list[int] = field(default_factory=lambda: [0])
    steps: list[dict[str, int]] = field(default_factory=list)
    known: dict[str, tuple[int, int]] = field(default_factory=dict)
    clean: set[str] = field(default_factory=set)  # words met that are no term's

    def __post_init__(self) -> None:
        self.allowed = [allowed_errors(t) for t in self.terms]
        for i, term in enumerate(self.terms):
            node = 0
            self.reach[0] = max(self.reach[0], self.allowed[i])
            for letter in term.rstrip("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], self.allowed[i])
            self.ends.setdefault(node, []).append(i)
        self._reset()

    def _reset(self) -> None:
        self.steps.clear()
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.accepts: list[dict[int, int]] = []
        self.start = self._number(self._with_left_out({0: 0}))

    def _with_left_out(self, at: dict[int, int]) -> dict[int, int]:
        """Nodes with fewest errors, also those reached by leaving out letters of a term."""
        todo = list(at.items())
        while todo:
            node, errors = todo.pop()
            for child in self.children[node].values():
                if errors + 1 <= self.reach[child] and errors + 1 < at.get(child, 9):
                    at[child] = errors + 1
                    todo.append((child, errors + 1))
        return at

    def _number(self, at: dict[int, int]) -> int:
        key = frozenset(at.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            found: dict[int, int] = {}
            for node, errors in at.items():
                for i in self.ends.get(node, ()):
                    if errors <= self.allowed[i]:
                        found[i] = errors
            self.accepts.append(found)
        return self.numbers[key]

    def step(self, state: int, letter: str) -> int:
        at: dict[int, int] = {}
        for node, errors in self.states[state]:
            if errors + 1 <= self.reach[node]:  # one letter too many
                at[node] = min(at.get(node, 9), errors + 1)
            for other, child in self.children[node].items():
                cost = errors + (other != letter)
                if cost <= self.reach[child]:
                    at[child] = min(at.get(child, 9), cost)
        return self._number(self._with_left_out(at))

    def found(self, word: str) -> tuple[int, int] | None:
        """The term that a word is, or is a misspelling of, and its errors: fewest errors first, then the longest term."""
        if word in self.other:
            return None
        if len(self.states) > STATES:
            self._reset()
        state, best, last = self.start, None, len(word) - 1
        for place, letter in enumerate(word):
            onward = self.steps[state].get(letter)
            if onward is None:
                onward = self.steps[state][letter] = self.step(state, letter)
            state = onward
            if not self.states[state]:
                break
            for i, errors in self.accepts[state].items():
                term = self.terms[i]
                if (term[-1] == "*") == (place < last):
                    rank = (errors, -len(term), i)
                    best = rank if best is None or rank < best else best
        return (best[2], best[0]) if best else None

    def among(self, many: set[str]) -> dict[str, tuple[int, int]]:
        """Those of some words that are a term or a misspelling of one. Words met lately aren't walked again."""
        out = {}
        for word in many - self.clean:
            match = self.known.get(word) or self.found(word)
            if match is None:
                self.clean.add(word)
            else:
                out[word] = self.known[word] = match
        if len(self.clean) + len(self.known) > WORDS:
            self.clean.clear()
            self.known.clear()
        return out


def allowed_errors(term: str) -> int:
    letters = len(term.rstrip("*"))
    return 0 if letters < 5 else 1 if letters < 9 or term[-1] == "*" else 2


@dataclass(frozen=True)
class Model:
    """Terms with their evidence by number of errors (log odds), words that are close to one but words of their own, and
    the weights of the features of a document."""

    terms: tuple[str, ...]
    other: frozenset[str]
    evidence: tuple[tuple[float, ...], ...]
    weights: tuple[float, ...]
    bias: float


def hits(text: str, automaton: Automaton, evidence) -> tuple[list[tuple[int, float, bool]], int]:
    """(place, evidence, quoted) of every word that is a term or a misspelling of one, and the number of words."""
    every, quoted = words(text)
    weights = {word: evidence[i][errors] for word, (i, errors) in automaton.among(set(every)).items()}
    weights = {word: weight for word, weight in weights.items() if weight > 0}
    if not weights:
        return [], len(every)
    return [(place, weights[word], place in quoted) for place, word in enumerate(every) if word in weights], len(every)


def features(found: list[tuple[int, float, bool]], n_words: int) -> tuple[float, ...]:
    """What the hits of a document say: the evidence of its best window, of all of it, and how dense it is.

    A hit in a quotation keeps a part of its evidence, unless hits outside quotations stand in its window, which make the
    quotation part of the abuse. A window is the evidence of a hit and of those around it, falling with the distance.
    """
    own = []
    for place, weight, quoted in found:
        if quoted and all(q for _, _, q in _near(found, place)):
            weight *= QUOTED
        own.append((place, weight))
    total = sum(w for _, w in own)
    best = lo = 0
    for i, (place, _) in enumerate(own):
        while own[lo][0] < place - WINDOW:
            lo += 1
        window, j = 0.0, lo
        while j < len(own) and own[j][0] <= place + WINDOW:
            window += own[j][1] * (1 - abs(own[j][0] - place) / (WINDOW + 1))
            j += 1
        best = max(best, window)
    return float(np.log1p(best)), float(np.log1p(total)), float(total / np.sqrt(n_words + 20))


def _near(found: list[tuple[int, float, bool]], place: int) -> list[tuple[int, float, bool]]:
    lo = bisect_left(found, place - WINDOW, key=lambda f: f[0])
    hi = bisect_left(found, place + WINDOW + 1, key=lambda f: f[0])
    return found[lo:hi]


def held_out(doc_id: Column) -> Column:
    """Whether a label may not be learned from: checksum of the doc_id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _names(text: str) -> set[str]:
    """Words of a text of SHORTEST letters or more, and their beginnings."""
    many = {word for word in words(text)[0] if len(word) >= SHORTEST}
    return many.union(word[:n] + "*" for word in many for n in range(SHORTEST, min(len(word), STEM + 1)))


def _counts(frames: Iterator[pd.DataFrame], names) -> Iterator[pd.DataFrame]:
    """Documents of each kind that hold each name, summed up by batch; names gives the names of a text."""
    for frame in frames:
        sums: Counter = Counter()
        for text, kind in zip(frame["text"], frame["kind"], strict=True):
            sums.update((name, kind) for name in names(text or ""))
        yield pd.DataFrame([(n, k, c) for (n, k), c in sums.items()], columns=["name", "kind", "docs"])


def _tabled(sample: DataFrame, names) -> DataFrame:
    return sample.select("text", "kind").mapInPandas(lambda frames: _counts(frames, names), "name string, kind int, docs long").groupBy("name", "kind").agg(F.sum("docs").alias("docs"))


def _chosen(counts: dict[str, tuple[int, int]], kinds: list[int]) -> list[str]:
    """Terms found in a larger share of toxic documents than chance allows. counts: toxic and clean documents of a name.

    A beginning is passed over for a longer name that is found in nearly as many toxic documents, so that whole words are
    learned where one word stands behind it; a longer name for a beginning that says nearly as much of more words.
    """
    toxic, clean = kinds
    rated: dict[str, float] = {}
    for name, (t, c) in counts.items():
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        if t >= SUPPORT and odds > 1 and odds / np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= EVIDENCE:
            rated[name] = float(odds)
    most_below: dict[str, int] = {}
    for name in rated:
        for above in _above(name):
            most_below[above] = max(most_below.get(above, 0), counts[name][0])
    own = {name for name in rated if most_below.get(name, 0) < 0.85 * counts[name][0]}
    out = [name for name in own if not any(a in own and rated[a] >= 0.6 * rated[name] for a in _above(name))]
    return sorted(out, key=lambda n: (-rated[n] * np.sqrt(counts[n][0]), n))[:TERMS]


def _above(name: str) -> list[str]:
    letters = name.rstrip("*")
    return [letters[:n] + "*" for n in range(SHORTEST, len(letters))]


def _evidence(term: str, by_errors: list[tuple[int, int]], kinds: list[int]) -> tuple[float, ...]:
    """Log odds of toxic by number of errors: of the term itself from labels; of misspellings, labels with a weak prior."""
    toxic, clean = kinds
    (t, c), *others = by_errors
    own = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
    out = [own]
    for e, (t, c) in enumerate(others, 1):
        prior = 1 / (1 + np.exp(-own * MISSPELT**e))
        share = c * (toxic + 1) / (clean + 1)
        out.append(float(np.log((t + 2 * prior) / (share + 2 * (1 - prior)))))
    return tuple(out)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, ridge: float = 0.02) -> Model:
    """Lexicon and weights from at most fit_rows labelled documents that are not held out (labels: doc_id, toxic 0 or 1).

    Only texts and labels are read. Words and beginnings of words are counted over the sample's toxic documents, those
    with enough support over all of it; what is kept is bounded by TERMS. Words near a term that clean documents use as
    well are words of their own; what is left of its misspellings is counted with the automaton. The weights of the features come from
    terms counted on the other half of the sample. Features are as many numbers a row whatever its length.

    Of equal hashes the smaller doc_id comes first; a doc_id labelled twice counts as toxic if either label does, and one
    on several rows counts with each while these are within the bound, ids on few rows going first. Without labels, or with labels of one kind, the model says its prior everywhere.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    fold = F.pmod(F.shiftright(F.xxhash64("doc_id"), 7), F.lit(2)).cast("int")
    rows = sampled(docs.select("doc_id", "text"), ids, fit_rows)
    sample = stored(rows.select("text", (2 * fold + F.col("y")).cast("int").alias("kind")).repartition(8))
    kinds = {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()}  # four rows at most
    of = [[kinds.get(2 * f + y, 0) for y in (1, 0)] for f in (0, 1)]
    both = [a + b for a, b in zip(*of, strict=True)]
    prior = (both[0] + 1) / (sum(both) + 2)
    nothing = Model((), frozenset(), (), (0.0,) * FEATURES, float(np.log(prior / (1 - prior))))
    if not both[0] or not both[1]:
        return nothing

    often = _tabled(sample.where("kind in (1, 3)"), _names).groupBy("name").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= SUPPORT)
    names = [r["name"] for r in often.orderBy(F.desc("docs"), "name").limit(40 * TERMS).collect()]  # that bounds it
    wanted = frozenset(names)
    counts: dict[str, dict[int, int]] = {n: {} for n in names}
    for r in _tabled(sample, lambda text: _names(text) & wanted).collect():  # four rows a name
        counts[r["name"]][r["kind"]] = r["docs"]

    def of_fold(fold: tuple[int, ...]) -> tuple[list[str], list[int]]:
        n = {name: tuple(sum(c.get(2 * f + y, 0) for f in fold) for y in (1, 0)) for name, c in counts.items()}
        size = [sum(of[f][i] for f in fold) for i in (0, 1)]
        return _chosen(n, size), size

    chosen = {fold: of_fold(fold) for fold in ((0,), (1,), (0, 1))}
    automata = {fold: tuple(sorted(terms)) for fold, (terms, _) in chosen.items()}

    def spelt(text: str, spelling: bool) -> set[str]:
        out = set()
        for fold, terms in automata.items():
            automaton = _automaton(terms, other)
            for word, (i, errors) in automaton.among(set(words(text)[0])).items():
                if errors or not spelling:
                    out.add(word if spelling else f"{fold}\t{terms[i]}\t{errors}")
        return out

    other: frozenset[str] = frozenset()
    seen: dict[tuple[str, int], int] = {}
    if any(automata.values()):
        near = _tabled(sample, lambda text: spelt(text, True)).groupBy("name").agg(*[F.sum(F.when(F.col("kind") % 2 == y, F.col("docs")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
        usual = near.where((F.col("n0") >= SUPPORT) & (F.col("n1") / both[0] < 2.7 * F.col("n0") / both[1]))
        other = frozenset(r["name"] for r in usual.orderBy(F.desc("n0"), "name").limit(40 * TERMS).collect())  # that bounds it
        seen = {(r["name"], r["kind"]): r["docs"] for r in _tabled(sample, lambda text: spelt(text, False)).collect()}  # a few rows a term

    def with_evidence(fold: tuple[int, ...]) -> tuple[tuple[str, ...], tuple[tuple[float, ...], ...]]:
        terms = automata[fold]
        found = []
        for term in terms:
            by_errors = [tuple(sum(seen.get((f"{fold}\t{term}\t{e}", 2 * f + y), 0) for f in fold) for y in (1, 0)) for e in range(allowed_errors(term) + 1)]
            found.append(_evidence(term, by_errors, chosen[fold][1]))
        return terms, tuple(found)

    halves = [with_evidence((f,)) for f in (0, 1)]

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, kind in zip(frame["text"], frame["kind"], strict=True):
                terms, evidence = halves[1 - kind // 2]
                out.append((kind % 2, *features(*hits(text or "", _automaton(terms, other), evidence))))
            yield pd.DataFrame(out, columns=["y", *"abc"])

    table = sample.mapInPandas(featured, "y int, a double, b double, c double").toPandas().sort_values(["y", *"abc"])  # fit_rows rows of four numbers
    terms, evidence = with_evidence((0, 1))
    weights, bias = _logistic(table[list("abc")].to_numpy(), table["y"].to_numpy(np.float64), ridge)
    return Model(terms, other, evidence, weights, bias)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[tuple[float, ...], float]:
    """Weights of a logistic regression by Newton's method. A feature whose weight comes out negative is left out: more
    evidence never makes a document cleaner, and quoted evidence (counted below zero) never makes it more toxic."""
    used = [i for i in range(x.shape[1]) if np.ptp(x[:, i]) > 0]
    while True:
        z = np.column_stack([x[:, used], np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.diag([ridge * len(x) / 100] * len(used) + [1e-9])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-10:
                break
        worst = min(range(len(used)), key=lambda i: w[i], default=None)
        if worst is None or w[worst] >= 0:
            break
        used.pop(worst)
    out = [0.0] * x.shape[1]
    for i, c in zip(used, w[:-1], strict=True):
        out[i] = float(c)
    return tuple(out), float(w[-1])


_AUTOMATA: dict[tuple[tuple[str, ...], frozenset[str]], Automaton] = {}


def _automaton(terms: tuple[str, ...], other: frozenset[str] = frozenset()) -> Automaton:
    """The automaton of some terms, made once a worker process."""
    if (terms, other) not in _AUTOMATA:
        if len(_AUTOMATA) >= 4:
            _AUTOMATA.clear()
        _AUTOMATA[terms, other] = Automaton(terms, other)
    return _AUTOMATA[terms, other]


def probability(text: str, model: Model) -> float:
    x = features(*hits(text, _automaton(model.terms, model.other), model.evidence)) if model.terms else (0.0,) * FEATURES
    z = sum(a * w for a, w in zip(x, model.weights, strict=True)) + model.bias
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Add __score, the probability that the text of a row is toxic, to every row of docs (text and any other columns).

    Every word of the whole text is looked up in the automaton of the model's terms and their misspellings. Hits in
    quotations count in part, unless there is abuse around them; a document's score comes from its best window, all its
    evidence and how dense that is. One pass over the rows and no shuffle; time is linear in the text.

    Defined results: a null text is an empty one, which gets the score of a text without hits; repeated rows and equal
    texts score alike; columns may have any names but __score; an empty table gives an empty table.
    """

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([probability(t or "", model) for t in texts], dtype=float)

    return docs.withColumn("__score", run(F.col("text")))
