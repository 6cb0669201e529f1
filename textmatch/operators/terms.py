"""Terms: extraction, variants, matching and weights."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmatch.functions.joins import fits_broadcast, lookup_join
from textmatch.functions.text import bounded_count, each, matches, normalise_term, protected_tokens, tokens
from textmatch.operators import runs
from textmatch.operators.substrings import Q, substring_pairs
from textmatch.sources.storage import stored

# Names of technologies and practices, grouped by kind; ends are lookarounds so that C++ and C# match.
TECH_GROUPS = (
    r"TypeScript|JavaScript|ES2\d+|ESNext", r"React|Vue|Angular|Svelte|Next\.js|Nuxt|Remix|Astro",
    r"Node\.js|Deno|Bun|Express|Fastify|NestJS|FastAPI|Django|Flask|Rails", r"Python|Go|Rust|Java|Kotlin|Swift|C\+\+|C#|Ruby|PHP|Scala|Elixir",
    r"PostgreSQL|MySQL|SQLite|MongoDB|Redis|Cassandra|DynamoDB|Supabase|PlanetScale", r"Docker|Kubernetes|Helm|Terraform|Pulumi|Ansible|ArgoCD",
    r"AWS|GCP|Azure|Vercel|Cloudflare|Fly\.io|Railway", r"GraphQL|REST|gRPC|WebSocket|tRPC|OpenAPI|Swagger", r"CI\/CD|GitHub Actions|Jenkins|CircleCI|Travis",
    r"TailwindCSS|Tailwind|CSS-in-JS|Styled Components|Sass|PostCSS", r"webpack|Vite|Rollup|Turbopack|esbuild|Parcel",
    r"LLM|RAG|fine-?tuning|RLHF|embeddings?|vector\s+search|LangChain|LangGraph|LlamaIndex", r"Edge Runtime|Web Workers|Service Workers|WebAssembly|WASM",
    r"Core Web Vitals|Lighthouse|Web Performance|INP|LCP|CLS|TTFB", r"microservices|monorepo|monolith|event-driven|serverless|distributed\s+systems?",
    r"system design|technical spec|architecture|scalab\w+|high.availability", r"agile|scrum|kanban|cross-functional|stakeholder|roadmap",
    r"A\/B testing?|feature flags?|observability|monitoring|OpenTelemetry|Datadog|Sentry", r"Git|GitHub|GitLab|Bitbucket|code review|pull request",
    r"accessibility|WCAG|a11y|internationaliz\w+|i18n",
)


# Shapes of a technical word: capitals inside, a run of capitals before small letters, capitals only.
TECHNICAL_WORD = "^(?:[A-Z][a-z]+[A-Z][A-Za-z0-9]*|[A-Z]{2,4}[a-z][A-Za-z0-9]*|[A-Z]{2,})$"


@dataclass(frozen=True)
class WeightConfig:
    required: float = 2.0
    preferred: float = 1.3
    title: float = 2.5
    boost_from: int = 2
    boost_step: float = 0.4
    boost_cap: float = 3.0
    critical_from: int = 3


def tech_terms(text: Column, groups: tuple[str, ...] = TECH_GROUPS) -> Column:
    """Distinct matches of all groups, in any case, sorted."""
    found = F.flatten(F.array(*[matches(text, rf"(?i)(?<![A-Za-z0-9_])(?:{g})(?![A-Za-z0-9_])") for g in groups]))
    return F.sort_array(F.array_distinct(found))


def dictionary_gap(wanted: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """Terms of a posting present in and missing from a document, with their coverage in percent (100 without terms).

    wanted: on, terms (array). have: on, terms. Terms are compared in lower case.
    """
    owned = have.select(*on, F.transform("terms", lambda t: F.lower(t)).alias("__h"))
    out = wanted.join(owned, on, "left").withColumn("__h", F.coalesce("__h", F.array().cast("array<string>")))
    present = F.filter("terms", lambda t: F.array_contains(F.col("__h"), F.lower(t)))
    missing = F.filter("terms", lambda t: ~F.array_contains(F.col("__h"), F.lower(t)))
    n = F.size("terms")
    coverage = F.when(n == 0, F.lit(100)).otherwise(F.floor(F.size(present) * 100 / n + 0.5)).cast("int")
    return out.select(*on, present.alias("present"), missing.alias("missing"), coverage.alias("coverage"))


def skill_whitelist(versions: DataFrame) -> DataFrame:
    """Technical terms of each profile's current version."""
    return versions.where("is_current").groupBy("profile_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(tech_terms(F.col("content")))))).alias("skills"))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks, in order."""
    if n == 1:
        return words
    last = F.size(words) - (n - 1)
    run = (lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])) if n <= 8 else (lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), last) - 1), run)).otherwise(F.array().cast("array<string>"))


def ngram_phrases(lines: DataFrame, n: int = 4, least: int = 2, key: str = "posting_id") -> DataFrame:
    """Phrases of one to n words that occur `least` times in a posting's lines, or hold a technical word: key, phrase, n.

    The lines of a key become one row; their runs of words are numbered and counted there, and written out as words only where
    they are kept. n is below 1024.
    """
    if not 0 < n < 1024:
        raise ValueError("phrases of 1 to 1023 words")
    rows = lines.groupBy(key).agg(F.collect_list("line").alias("__lines"))
    return _by_key(rows, runs.counted(n, least, TECHNICAL_WORD, key), key, "phrase string, n long")


def _by_key(rows: DataFrame, made: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], key: str, result: str) -> DataFrame:
    """What is made from rows in tasks, the key as a string there, as pandas has no null among whole numbers."""
    out = rows.withColumn(key, F.col(key).cast("string")).mapInPandas(made, f"`{key}` string, {result}")
    return out.withColumn(key, F.col(key).cast(rows.schema[key].dataType))


def dedup_subphrases(phrases: DataFrame, key: str = "posting_id") -> DataFrame:
    """Phrases that aren't a contiguous part of a longer one of the same key.

    The phrases of a key become one row, and parts are looked for there. Null keys and phrases are parts of nothing.
    """

    @F.pandas_udf("array<boolean>")
    def stays(phrases: pd.Series) -> pd.Series:
        return phrases.map(lambda some: runs.uncovered(list(some)))

    rows = phrases.groupBy(key).agg(F.collect_list(F.struct(*phrases.columns)).alias("__rows")).withColumn("__stays", stays(F.col("__rows.phrase")))
    both = rows.select(F.explode(F.arrays_zip(F.col("__rows").alias("row"), F.col("__stays").alias("stays"))).alias("__x"))
    return both.where(F.col("__x.stays") | F.col(f"__x.row.{key}").isNull()).select("__x.row.*")


def extract_phrases(lines: DataFrame, stop_words: tuple[str, ...], allowed: DataFrame, n: int = 6, key: str = "posting_id", chunks: str | None = None) -> DataFrame:
    """Protected tokens, and phrases of two to n words that neither start nor end with a stop word; single words only if allowed.

    Phrases stand in for noun chunks, for which a language model would be needed; chunks names a column of them (array of
    strings) to take instead. allowed: a table of single words (term), joined, not collected.
    """
    stops = F.array(*[F.lit(w) for w in stop_words])
    none = F.array().cast("array<string>")
    said = F.filter(F.coalesce(F.col(chunks), none), lambda c: F.size(F.split(c, " ")) <= n) if chunks else none
    # The lines of a key are one row, so that its phrases are told apart there and none is moved.
    rows = lines.groupBy(key).agg(F.collect_list(F.struct("line", said.alias("said"))).alias("__lines"))
    cut = F.transform("__lines", lambda x: F.struct(x["line"].alias("line"), x["said"].alias("said"), tokens(x["line"]).alias("t")))
    # A word's place among those of its line, or 0 for a stop word.
    cut = F.transform(cut, lambda x: F.struct(x["line"].alias("line"), x["said"].alias("said"), x["t"].alias("t"), F.transform(x["t"], lambda w, i: F.when(F.array_contains(stops, w), 0).otherwise(i + 1)).alias("at")))

    def runs(x: Column, i: int) -> Column:
        starts = F.filter(F.slice(x["at"], 1, F.greatest(F.lit(0), F.size(x["t"]) - (i - 1))), lambda j: (j > 0) & (F.get(x["at"], j + i - 2) > 0))
        return F.transform(starts, lambda j: F.concat_ws(" ", *[F.get(x["t"], j + k - 1) for k in range(i)]))

    def several(x: Column) -> Column:
        return F.concat(protected_tokens(x["line"]), x["said"] if chunks else F.concat(*[runs(x, i) for i in range(2, n + 1)], none))

    def long(items: Column) -> Column:
        return F.array_distinct(F.filter(items, lambda c: F.length(c) >= 4))

    made = F.transform(cut, lambda x: F.struct(several(x).alias("several"), x["t"].alias("t")))
    both = rows.select(key, made.alias("__m")).select(key, each(F.concat(
        F.transform(long(F.flatten(F.transform("__m", lambda x: x["several"]))), lambda c: F.struct(c.alias("phrase"), F.lit(True).alias("made"))),
        F.transform(long(F.array_except(F.flatten(F.transform("__m", lambda x: x["t"])), F.flatten(F.transform("__m", lambda x: x["several"])))), lambda c: F.struct(c.alias("phrase"), F.lit(False).alias("made"))),
    )).alias("__p")).where("__p is not null").select(key, "__p.*")
    return _allowed(both, allowed, key)


def _allowed(both: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Phrases that are made of several words, and those single words that are allowed."""
    known = stored(allowed.select(F.col("term").alias("phrase")).distinct().withColumn("__known", F.lit(True)))
    if fits_broadcast(known):  # both kinds in one pass
        return both.join(F.broadcast(known), "phrase", "left").where("made or __known").select(key, "phrase")
    single = lookup_join(both.where("not made"), known, ["phrase"], "left_semi", salt=key)
    return both.where("made").unionByName(single).select(key, "phrase")


def key_terms(lines: DataFrame, stop_words: tuple[str, ...], allowed: DataFrame, n: int = 6, key: str = "posting_id", chunks: str | None = None) -> DataFrame:
    """The phrases of extract_phrases() that aren't a contiguous part of a longer one of the same key.

    Parts are told by where they stand in their line, in the one row that a key's lines are, so that of the phrases only those that stay are made.
    """
    none = F.array().cast("array<string>")
    said = F.filter(F.coalesce(F.col(chunks), none), lambda c: F.size(F.split(c, " ")) <= n) if chunks else none
    rows = lines.groupBy(key).agg(F.collect_list("line").alias("__lines"), F.flatten(F.collect_list(said)).alias("__said"))
    return _allowed(_by_key(rows, runs.longest(n, stop_words, key, chunks is not None), key, "phrase string, made boolean"), allowed, key)


def _bounded(text: str, term: str) -> int:
    """How often a term occurs without a letter or digit beside it; see bounded_count()."""
    n, at = 0, text.find(term)
    while at >= 0:
        end = at + len(term)
        alone = text[at - 1 : at] not in ALNUM and text[end : end + 1] not in ALNUM
        n, at = n + alone, text.find(term, end if alone else at + 1)
    return n


ALNUM = {*"abcdefghijklmnopqrstuvwxyz0123456789"}


def _counts(text: str, terms: list[str]) -> list[int]:
    """How often each term occurs in a text, without overlap. Many terms of letters and digits are looked up among the parts of the text's distinct words."""
    if len(text) * len(terms) < 1 << 20:
        return [text.count(t) for t in terms]
    wanted = {t for t in terms if re.fullmatch("[a-z0-9]+", t)}
    found: dict[str, int] = dict.fromkeys(wanted, 0)
    sizes = {len(t) for t in wanted}
    for word, times in Counter(re.findall("[a-z0-9]+", text)).items():
        for size in sizes:
            for part in wanted.intersection([word[i : i + size] for i in range(len(word) - size + 1)]):
                found[part] += times * word.count(part)
    return [found[t] if t in found else text.count(t) for t in terms]


def _occurrences(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """How often each of a text's terms occurs in it, all in lower case, without overlap."""

    def counted(text: str | None, some: list[str | None]) -> list[int | None]:
        if text is None:
            return [None if t else 0 for t in some]
        known = dict(zip(real := [t for t in some if t], _counts(text, real), strict=True))
        return [known[t] if t else 0 for t in some]

    return pd.Series([counted(None if pd.isna(text) else text, some) for text, some in zip(texts, terms, strict=True)], dtype=object)


def _alone(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """As _occurrences(), of those without a letter or digit beside them."""
    return pd.Series([[0 if pd.isna(text) or not t else _bounded(text, t) for t in some] for text, some in zip(texts, terms, strict=True)], dtype=object)


def in_texts(terms: DataFrame, texts: DataFrame, on: list[str], columns: list[str], measures: dict, counts: Callable[[pd.Series, pd.Series], pd.Series] | None = None, text: str = "__d") -> DataFrame:
    """Measures of each term in its posting's texts, with the terms' columns.

    Terms are gathered by posting, as many as a posting has, so a text is read once and not copied for each of them.
    measures: functions from a gathered element to a column over it and the columns of texts. counts: how often the
    elements' terms, in lower case, occur in a column of texts; the element has it as n then.
    """
    gathered = terms.groupBy(*on).agg(F.collect_list(F.struct(*columns)).alias("__terms"))
    rows = gathered.join(texts.hint("merge"), on)
    if counts:
        n = F.pandas_udf(counts, "array<long>")(F.col(text), F.transform("__terms", lambda t: F.lower(t["term"])))
        rows = rows.withColumn("__n", n).withColumn("__terms", F.transform("__terms", lambda t, i: F.struct(*[t[c].alias(c) for c in columns], F.get("__n", i).alias("n"))))
    made = F.transform("__terms", lambda t: F.struct(*[t[c].alias(c) for c in columns], *[f(t).alias(name) for name, f in measures.items()]))
    return rows.select(*on, each(made).alias("__t")).where("__t is not null").select(*on, "__t.*")


def weighted_terms(found: DataFrame, texts: DataFrame, config: WeightConfig = WeightConfig(), stack: bool = False) -> DataFrame:
    """Weight of every term of a posting.

    found: posting_id, term, section (required, preferred or other), maybe several rows a term. texts: posting_id,
    description, title. The first of required, preferred, other decides (stack: both factors apply); repeated terms are
    boosted from the third occurrence on; terms in the title are raised.
    """
    order = F.when(F.col("section") == "required", 0).when(F.col("section") == "preferred", 1).otherwise(2)
    rows = found.repartition("posting_id").groupBy("posting_id", "term").agg(F.min(order).alias("__o"), F.max(order == 1).alias("__p"))
    low = texts.select("posting_id", F.lower("description").alias("__d"), F.lower("title").alias("__title"))
    measures = {"n": lambda t: t["n"], "__in_title": lambda t: F.contains(F.col("__title"), F.lower(t["term"]))}
    rows = in_texts(rows, low, ["posting_id"], ["term", "__o", "__p"], measures, _occurrences)
    n = F.col("n")
    boost = F.when(n >= config.boost_from, F.least(F.lit(config.boost_cap), 1 + config.boost_step * F.least(F.lit(5), n - 2))).otherwise(F.lit(1.0))
    first = F.when(F.col("__o") == 0, config.required).when(F.col("__o") == 1, config.preferred).otherwise(1.0)
    both = F.when(F.col("__o") == 0, config.required).otherwise(1.0) * F.when(F.col("__p"), config.preferred).otherwise(1.0)
    title = F.when(F.col("__in_title"), config.title).otherwise(1.0)
    weight = F.round((boost * (both if stack else first) * title).cast("decimal(18,6)"), 3).cast("double")
    return rows.select("posting_id", "term", (F.col("__o") == 0).alias("is_required"), n.alias("freq"), weight.alias("weight"))


# Endings of plurals and what singulars have instead.
PLURALS = (("ies", "y"), ("ves", "f"), ("ses", "s"), ("s", ""))


def _swap(word: Column, off: str, on: str) -> Column:
    return F.concat(F.substring(word, F.lit(1), F.length(word) - len(off)), F.lit(on))


def _inflected(word: Column) -> Column:
    """Forms of a verb: its base in e, and that with d, with s, and with ing for e; empty for words that end otherwise."""
    stem = F.when(F.endswith(word, F.lit("ing")) & (F.length(word) >= 5), _swap(word, "ing", ""))
    stem = stem.when(F.endswith(word, F.lit("ed")) & (F.length(word) >= 4), _swap(word, "ed", "")).when(F.endswith(word, F.lit("e")) & (F.length(word) >= 3), _swap(word, "e", ""))
    return F.when(stem.isNotNull(), F.array(*[F.concat(stem, F.lit(x)) for x in ("e", "ed", "es", "ing")])).otherwise(F.array().cast("array<string>"))


def term_variants(terms: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """All spellings (term, variant) a term is accepted in.

    The term itself, normalised, hyphened; its abbreviation or expansion (abbreviations: term, expansion, both ways);
    singular and plural of single words; inflections of a phrase's last word, with blank and hyphen.
    """
    base = terms.select("term").distinct().withColumn("__n", normalise_term(F.col("term")))
    n = F.col("__n")
    out = [F.lower(F.trim("term")), n, F.replace(n, F.lit(" "), F.lit("-"))]
    single = ~F.contains(n, F.lit(" "))
    for off, on in PLURALS:
        out.append(F.when(single & F.endswith(n, F.lit(off)) & (F.length(n) > len(off) + 2), _swap(n, off, on)))
    out.append(F.when(single & ~F.endswith(n, F.lit("s")), F.concat(n, F.lit("s"))))
    last, head = F.element_at(F.split(n, " "), -1), F.regexp_replace(n, r" [^ ]+$", "")
    forms = F.when(single, F.array().cast("array<string>")).otherwise(_inflected(last))
    spelled = F.flatten(F.transform(forms, lambda x: F.array(F.concat(head, F.lit(" "), x), F.concat(head, F.lit("-"), x))))
    made = base.select("term", F.explode(F.concat(F.filter(F.array(*out), lambda v: v.isNotNull()), spelled)).alias("variant"))
    short = abbreviations.select(normalise_term(F.col("term")).alias("__n"), F.lower("expansion").alias("variant"))
    long = abbreviations.select(normalise_term(F.col("expansion")).alias("__n"), F.lower("term").alias("variant"))
    named = base.join(short.unionByName(long).hint("shuffle_hash"), "__n").select("term", "variant")
    return made.unionByName(named).distinct()


def find_terms(variants: DataFrame, blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Where each term occurs: by.., doc_id, term, matched_variant, sections_found, last_year.

    Texts become runs of words, of those lengths that occur among the variants, and are joined to the
    variants by equality: no term is tried on a text that lacks it. Hyphens and other marks part words on both sides, so
    spellings that differ in them meet. blocks: doc_id, pos, text, section, recency_year. The first match is the
    earliest block's, then the first in alphabetical order. by: columns of both sides that a match must share, for
    terms that are looked for in some documents only.

    Blocks are dealt to tasks by doc_id, so that all matches of a document are counted where its texts are. With by, the
    variants of a key and the blocks of a document are a row each, and no run of words is moved, however many keys there are.
    """
    if by:
        block = F.struct("pos", "text", "section", "recency_year")
        return find_spelled(spelled_terms(variants, by), blocks.groupBy(*by, "doc_id").agg(F.collect_list(block).alias("blocks")), by)
    order = Window.partitionBy("term").orderBy("variant")
    keyed = variants.withColumn("__g", F.array_join(tokens(F.col("variant")), " ")).where("__g <> ''").withColumn("__v", F.rank().over(order).cast("long"))
    spelled = stored(keyed.select("term", "__v", "variant").distinct())
    keyed = stored(keyed.groupBy("__g", "term").agg(F.min("__v").alias("__v")))
    lengths = sorted(r[0] for r in keyed.select(F.size(F.split("__g", " "))).distinct().collect())  # a row a length
    kept = ["doc_id", "pos", "section", "recency_year"]
    words = blocks.select(*kept, "text").repartition("doc_id").select(*kept, tokens(F.col("text")).alias("__t"))
    grams = F.array_distinct(F.flatten(F.array(*[ngrams(F.col("__t"), i) for i in lengths or [1]])))
    hits = lookup_join(words.select(*kept, each(grams).alias("__g")), keyed, ["__g"], salt="doc_id")
    # The first match as one number: the block's place, then the variant's among those of its term.
    first = F.shiftleft(F.col("pos").cast("long"), 24) + F.col("__v")
    parts = hits.groupBy("doc_id", "term", "section").agg(F.min(first).alias("__first"), F.max("recency_year").alias("last_year"))
    found = parts.groupBy("doc_id", "term").agg(
        F.min("__first").bitwiseAND(F.lit((1 << 24) - 1)).alias("__v"),
        F.sort_array(F.collect_set("section")).alias("sections_found"),
        F.max("last_year").alias("last_year"),
    )
    named = lookup_join(found, spelled, ["term", "__v"], salt="doc_id")
    return named.select("doc_id", "term", F.col("variant").alias("matched_variant"), "sections_found", "last_year")


def spelled_terms(variants: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The variants of each key in one stored row, for find_spelled(): by.., __said, __spelled.

    __spelled: terms and variants, in order. __said: a line for each of them, its term's number and the variant's words.
    """
    rows = variants.select(*by, "term", "variant", F.array_join(tokens(F.col("variant")), " ").alias("__g")).where("__g <> ''").distinct()
    rows = rows.withColumn("__t", F.dense_rank().over(Window.partitionBy(*by).orderBy("term")))
    gathered = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__t", "variant", "term", "__g"))).alias("__s"))
    said = F.array_join(F.transform("__s", lambda x: F.concat_ws(" ", x["__t"].cast("string"), x["__g"])), "\n")
    return stored(gathered.select(*by, said.alias("__said"), F.transform("__s", lambda x: F.struct(x["term"].alias("term"), x["variant"].alias("variant"))).alias("__spelled")))


@lru_cache(256)
def _spelled(said: str) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Terms and places of the variants that some words spell, from a row's __said, and the numbers of words that occur."""
    known: dict[str, list[tuple[int, int]]] = {}
    for at, line in enumerate(said.split("\n")):
        term, _, words = line.partition(" ")
        known.setdefault(words, []).append((int(term), at))
    return known, sorted({words.count(" ") + 1 for words in known})


def _first_spelling(texts: pd.Series, places: pd.Series, said: pd.Series) -> pd.Series:
    """For each term found in some texts its first variant's place in __spelled, then the texts that it is in."""

    def found(some: list[str | None], at: list[int], known: dict[str, list[tuple[int, int]]], sizes: list[int]) -> list[list[int]]:
        first: dict[int, tuple[int, int]] = {}
        held: dict[int, dict[int, None]] = {}
        for i, text in enumerate(some):
            words = re.findall("[a-z0-9]+", text or "")
            for size in sizes:
                for run in known.keys() & (words if size == 1 else [" ".join(words[j : j + size]) for j in range(len(words) - size + 1)]):
                    for term, variant in known[run]:
                        first[term] = min(first.get(term, (at[i], variant)), (at[i], variant))
                        held.setdefault(term, {})[i] = None
        return [[first[term][1], *held[term]] for term in held]

    return pd.Series([found(some, at, *_spelled(line)) for some, at, line in zip(texts, places, said, strict=True)], dtype=object)


def find_spelled(spelled: DataFrame, docs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """find_terms() with the rows of spelled_terms(), in documents whose blocks are in one row, or in several.

    docs: by.., doc_id, blocks (array of pos, text, section, recency_year). No text is moved, as the rows of spelled_terms()
    are sent to every task; if they are too many for that, the documents are sent to them. Keys of docs are counted then.
    """
    asked = docs.where("blocks is not null").select(*by, "doc_id", F.transform("blocks", lambda b: F.struct(
        F.coalesce(b["pos"], F.lit((1 << 31) - 1)).cast("int").alias("pos"), F.lower(b["text"]).alias("text"), b["section"].alias("section"), b["recency_year"].alias("year"),
    )).alias("__b"))
    firsts = F.pandas_udf(_first_spelling, "array<array<int>>")("__b.text", "__b.pos", "__said")
    rows = lookup_join(asked, spelled, list(by), salt="doc_id", keys=docs.select(*by)).withColumn("__found", firsts)

    def of(x: Column, name: str) -> Column:
        return F.transform(F.slice(x, 2, F.size(x) - 1), lambda i: F.get("__b", i)[name])

    made = F.transform("__found", lambda x: F.struct(
        F.get("__spelled", x[0])["term"].alias("term"), F.struct(F.array_min(of(x, "pos")).alias("pos"), F.get("__spelled", x[0])["variant"].alias("variant")).alias("__first"),
        F.array_distinct(of(x, "section")).alias("__sections"), F.array_max(of(x, "year")).alias("last_year"),
    ))
    hits = rows.select(*by, "doc_id", each(made).alias("__x")).where("__x is not null").select(*by, "doc_id", "__x.*")
    # Usually one row each; an id has several only if its document has several rows.
    return hits.groupBy(*by, "doc_id", "term").agg(
        F.min("__first")["variant"].alias("matched_variant"),
        F.sort_array(F.array_compact(F.array_distinct(F.flatten(F.collect_list("__sections"))))).alias("sections_found"),
        F.max("last_year").alias("last_year"),
    )


def found_besides(found: DataFrame, more: DataFrame) -> DataFrame:
    """Results of find_terms on a document and on blocks put at its end, as if found together."""
    both = found.withColumn("__late", F.lit(0)).unionByName(more.withColumn("__late", F.lit(1)))
    return both.groupBy("doc_id", "term").agg(
        F.min(F.struct("__late", "matched_variant"))["matched_variant"].alias("matched_variant"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("sections_found")))).alias("sections_found"),
        F.max("last_year").alias("last_year"),
    )


def contained_terms(texts: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Which of many terms each text contains, in any case: key, term. texts: key, text. terms: term.

    A term without white space is tried against each distinct word of all texts once, if the word shares four characters
    with it (or all of a shorter term), instead of each term against each text. One with blanks or tabs is looked up in
    the distinct lines of all texts by its rarest run of characters. A term that holds a line end is found nowhere.
    A table of terms that can be sent to every task is; texts stay where they are then.
    """
    asked = stored(terms.select("term", F.lower("term").alias("needle")).where("needle <> ''").distinct())
    if fits_broadcast(asked):
        return _by_runs(texts, asked, key)
    spaced = F.col("term").rlike(r"\s")
    lines = stored(texts.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), "\n"))).alias("haystack")))
    several = terms.where(spaced).select("term", F.lower("term").alias("needle"))
    pairs = substring_pairs(several.select("needle"), lines.select("haystack"))
    several = several.join(pairs.hint("shuffle_hash"), "needle").select("term", "haystack")
    return _in_words(texts, terms.where(~spaced), key).unionByName(lines.join(several.hint("merge"), "haystack").select(key, "term").distinct())


def _by_runs(texts: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """contained_terms() of a small table of terms (term, needle), which goes to every task; no text moves.

    A term is tried on a text that holds one run of its characters, that which the fewest other terms have.
    """
    needles = [(r["term"], r["needle"]) for r in asked.where(~F.contains("needle", F.lit("\n"))).collect()]  # as many as can be broadcast

    def pieces(text: str, size: int) -> set[str]:
        return {text[i : i + size] for i in range(len(text) - size + 1)}

    often = Counter(run for _, low in needles for run in pieces(low, min(Q, len(low))))
    keyed: dict[str, list[tuple[str, str]]] = {}
    for term, low in needles:
        keyed.setdefault(min(pieces(low, min(Q, len(low))), key=lambda run: (often[run], run)), []).append((term, low))
    sizes = sorted({len(run) for run in keyed})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, found = [], []
            for at, text in zip(batch[key], batch["__low"], strict=True):
                known = [term for size in sizes for piece in keyed.keys() & pieces(text, size) for term, low in keyed[piece] if low in text]
                found += known
                held += [at] * len(known)
            yield pd.DataFrame({key: pd.Series(held, dtype=object), "term": pd.Series(found, dtype=object)})

    return _by_key(texts.where("text is not null").select(key, F.lower("text").alias("__low")), run, key, "term string").distinct()


def _in_words(texts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """contained_terms() of terms without white space."""
    low = terms.select("term", F.lower("term").alias("__low")).where("__low <> ''").withColumn("__len", F.least(F.lit(4), F.length("__low")))
    lengths = sorted(r[0] for r in low.select("__len").distinct().collect())  # four rows at most
    words = stored(texts.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("__word")))

    def runs(n: int) -> Column:
        last = F.length("__word") - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.substring("__word", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    vocabulary = words.select("__word").distinct()
    parts = vocabulary.select("__word", F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in lengths or [1]])))).alias("__run"))
    keyed = low.select("term", "__low", F.substring("__low", F.lit(1), F.col("__len")).alias("__run"))
    held = stored(parts.join(keyed.hint("shuffle_hash"), "__run").where(F.contains("__word", F.col("__low"))).select("__word", "term").distinct())
    return words.join(held.hint("shuffle_hash"), "__word").select(key, "term").distinct()


def term_present(text: Column, variant: Column) -> Column:
    """A variant without a letter or digit beside it; for a few terms, where a join isn't worth it."""
    return F.coalesce(bounded_count(text, variant) > 0, F.lit(False))


def term_substring(text: Column, variant: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lower(variant)), F.lit(False))


def term_frequency(terms: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """Bounded occurrences of each term in its posting."""
    return in_texts(terms, texts.select(*on, F.lower("description").alias("__d")), on, ["term"], {"freq": lambda t: t["n"]}, _alone)


def present_terms(terms: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """Terms that stand alone in their posting's text: on.., term. texts: on.., description."""
    return term_frequency(terms, texts, on).where("freq > 0").select(*on, "term")


def critical_missing(missing: DataFrame, texts: DataFrame, on: list[str], least: int = 3) -> DataFrame:
    """Missing terms that are required, frequent or in the title, ranked: required first, then by count, then by term."""
    low = texts.select(*on, F.lower("description").alias("__d"), F.lower("title").alias("__title"))
    measures = {"freq": lambda t: F.coalesce(t["n"], F.lit(0)), "__in_title": lambda t: F.contains(F.col("__title"), F.lower(t["term"]))}
    rows = in_texts(missing, low, on, ["term", "is_required"], measures, _occurrences)
    rows = rows.where(F.col("is_required") | (F.col("freq") >= least) | F.col("__in_title"))
    order = Window.partitionBy(*on).orderBy(F.desc("is_required"), F.desc("freq"), "term")
    return rows.select(*on, "term", "is_required", "freq", F.row_number().over(order).alias("rank"))


def missing_by_section(missing: DataFrame, section_texts: DataFrame, on: list[str]) -> DataFrame:
    """Missing terms contained in the required text, or else in the preferred text."""
    low = section_texts.select(*on, F.lower("required_text").alias("__r"), F.lower("preferred_text").alias("__p"))

    def kind(t: Column) -> Column:
        return F.when(F.contains(F.col("__r"), F.lower(t["term"])), "required").when(F.contains(F.col("__p"), F.lower(t["term"])), "preferred")

    return in_texts(missing, low, on, ["term"], {"kind": kind}).where("kind is not null")


def coverage(terms: DataFrame, by: list[str]) -> DataFrame:
    """Percent of weight matched: exact terms in full, semantic ones by credit; 100 without any weight. Two places."""
    total = F.sum("weight")
    got = F.sum(F.when(F.col("exact"), F.col("weight")).otherwise(F.col("weight") * F.coalesce("credit", F.lit(0.0))))
    share = F.round((got / total * 100).cast("decimal(18,6)"), 2).cast("double")
    return terms.groupBy(*by).agg(F.when(total > 0, share).otherwise(F.lit(100.0)).alias("coverage"))


def merge_skill_labels(skills: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Skills with their label, by lower-cased name; of several labels the strictest stays, without one it is missing.

    labels: on, name, label of demonstrated, partial or missing.
    """
    rank = F.when(F.col("label") == "missing", 2).when(F.col("label") == "partial", 1).otherwise(0)
    worst = labels.groupBy(*on, F.lower("name").alias("__k")).agg(F.max(F.struct(rank.alias("r"), "label"))["label"].alias("label"))
    rows = skills.withColumn("__k", F.lower("name")).join(worst, [*on, "__k"], "left").drop("__k")
    return rows.withColumn("label", F.coalesce("label", F.lit("missing")))


def gap_from_labels(skills: DataFrame, config: WeightConfig = WeightConfig()) -> DataFrame:
    """Labelled skills as term rows: demonstrated is exact, partial has credit 0.65 at similarity 0.5, others are missing."""
    partial = F.col("label") == "partial"
    weight = F.when(F.col("is_required"), config.required).otherwise(config.preferred)
    return skills.withColumns({
        "term": F.lower("name"), "display": F.col("name"), "weight": weight, "exact": F.col("label") == "demonstrated",
        "credit": F.when(partial, 0.65).otherwise(0.0), "similarity": F.when(partial, 0.5),
    })


def keyword_cards(gap: DataFrame) -> DataFrame:
    """Term rows as cards: High when matched, Partial with credit, Critical or Missing otherwise."""
    kind = F.when(F.col("exact"), "High").when(F.coalesce("credit", F.lit(0.0)) > 0, "Partial").when(F.col("is_required"), "Critical").otherwise("Missing")
    return gap.withColumns({"kw": F.col("term"), "present": kind.isin("High", "Partial"), "card": kind})


def lemma_tokens(text: Column, stop_words: tuple[str, ...]) -> Column:
    """Stems of a text's tokens without stop words, in order."""
    from textmatch.functions.text import crude_stem

    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.transform(F.filter(tokens(text), lambda t: ~F.array_contains(stops, t)), crude_stem)
