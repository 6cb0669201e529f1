"""Views that bind the given tables to postings, profiles, versions, blocks, terms and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.functions.joins import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer as postings; every status occurs, and some scores are missing."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    open_status = F.when(key % 3 == 0, "Pending").when(key % 3 == 1, "Tailoring").otherwise("Tailored")
    status = F.when(F.col("o_orderstatus") == "F", "Applied").when(F.col("o_orderstatus") == "P", "Skipped").otherwise(open_status)
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        key.alias("posting_id"), F.col("c_name").alias("company"), F.col("o_orderpriority").alias("title"), status.alias("status"),
        F.when(key % 17 != 0, (key % 101).cast("int")).alias("match_score"), F.col("o_orderdate").alias("created_at"),
        F.when(key % 5 == 0, F.concat_ws(":", F.col("c_name"), (key % 7).cast("string"))).otherwise("").alias("composite_key"), (key % 3).alias("profile_id"),
    )


POSTINGS_SQL = """postings AS (
    SELECT o_orderkey AS posting_id, c_name AS company, o_orderpriority AS title,
        CASE o_orderstatus WHEN 'F' THEN 'Applied' WHEN 'P' THEN 'Skipped'
            ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Tailoring' ELSE 'Tailored' END END AS status,
        CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 101 AS INTEGER) END AS match_score, o_orderdate AS created_at,
        CASE WHEN o_orderkey % 5 = 0 THEN c_name || ':' || CAST(o_orderkey % 7 AS VARCHAR) ELSE '' END AS composite_key, o_orderkey % 3 AS profile_id
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword list for each posting: the words of its part names, present where the quantity is above 25."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("kw"))
    lines = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    item = F.struct("kw", (F.col("l_quantity") > 25).alias("present"), F.lit("High").alias("weight"))
    return lines.groupBy(F.col("l_orderkey").alias("posting_id")).agg(F.collect_list(item).alias("keywords"))


KEYWORDS_SQL = """kw AS (SELECT l_orderkey AS posting_id, trim(p_brand) AS name, l_quantity > 25 AS present FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of their user's profile; views carry no content."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("profile_id"), F.col("event_id").alias("version_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") != "view", F.concat_ws(" ", "event_type", "props")).alias("content"), (F.col("event_id") % 4 == 0).alias("is_current"),
    )


VERSIONS_SQL = """versions AS (
    SELECT user_id AS profile_id, event_id AS version_id, ts AS created_at,
        CASE WHEN event_type <> 'view' THEN event_type || ' ' || props END AS content, event_id % 4 = 0 AS is_current FROM events)"""


def words(text: Column) -> Column:
    """Lower-cased ASCII letter and digit runs, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def _code(term: Column) -> Column:
    """A small number that goes with a term's spelling, where a query needs one."""
    return F.ascii(term) + F.length(term)


def _benchmark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("term")).where(F.length("term") >= 4)


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark tokens of four characters or more, with their number; those of an even code are required."""
    counted = _benchmark_tokens(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    return counted.select("term", "freq", _code(F.col("term")).alias("code"), (_code(F.col("term")) % 2 == 0).alias("is_required"))


def posting_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a posting that asks for its tokens: posting_id, term, freq, code, is_required."""
    asked = _benchmark_tokens(spark, sf_dir).select(F.col("item_id").alias("posting_id"), "term").distinct()
    return asked.join(terms(spark, sf_dir).hint("shuffle_hash"), "term").select("posting_id", "term", "freq", "code", "is_required")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of neighbouring benchmark tokens of four characters or more (term)."""
    w = table(spark, sf_dir, "benchmark").select(words(F.col("text")).alias("w"))
    pairs = F.transform(F.arrays_zip(w["w"].alias("a"), F.slice("w", F.lit(2), F.greatest(F.lit(0), F.size("w") - 1)).alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    rows = w.select(F.explode(pairs).alias("p")).where("length(p.a) >= 4 and length(p.b) >= 4")
    return rows.select(F.concat_ws(" ", "p.a", "p.b").alias("term")).distinct()


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and phrases of the benchmark (term)."""
    return terms(spark, sf_dir).select("term").unionByName(phrases(spark, sf_dir))


def posting_of(spark: SparkSession, sf_dir: str) -> Column:
    """The posting that a document's number deals it to."""
    return F.col("doc_id") % max(1, table(spark, sf_dir, "benchmark").count())


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the posting its number deals it to."""
    return table(spark, sf_dir, "documents").where("text is not null").select(posting_of(spark, sf_dir).alias("posting_id"), "doc_id")


TERMS_SQL = """bench_words AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
    bench_tokens AS (SELECT item_id, unnest(w) AS term FROM bench_words),
    terms AS (SELECT term, count(*) AS freq, ascii(term) + length(term) AS code, (ascii(term) + length(term)) % 2 = 0 AS is_required FROM bench_tokens WHERE length(term) >= 4 GROUP BY term),
    posting_terms AS (SELECT DISTINCT b.item_id AS posting_id, t.* FROM bench_tokens b JOIN terms t USING (term)),
    pair_words AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM bench_words)),
    dictionary AS (SELECT term FROM terms UNION SELECT a || ' ' || b FROM pair_words WHERE length(a) >= 4 AND length(b) >= 4),
    pairs AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS posting_id, doc_id, text FROM documents WHERE text IS NOT NULL)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as ordered blocks; the first of a document is a heading."""
    d = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.col("pos") == 0, "h1").when(F.col("pos") % 3 == 1, "bullet").otherwise("paragraph")
    return rows.select("doc_id", "pos", F.concat(F.lit("b"), F.col("pos").cast("string")).alias("block_id"), kind.alias("block_type"), "text")


BLOCKS_SQL = """block_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    blocks AS (
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, 'b' || CAST(pos AS VARCHAR) AS block_id,
            CASE WHEN pos = 0 THEN 'h1' WHEN pos % 3 = 1 THEN 'bullet' ELSE 'paragraph' END AS block_type, text
        FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS text FROM block_lines))"""
