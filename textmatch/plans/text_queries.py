"""Queries over texts: normalisation, sections, terms and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.functions import text as X
from textmatch.functions.embedding import hash_projection
from textmatch.functions.joins import lookup_join, spread
from textmatch.operators import blocks as B
from textmatch.operators import inverted as I
from textmatch.operators import projection as R
from textmatch.operators import retrieval as S
from textmatch.operators import sections as E
from textmatch.operators import terms as T
from textmatch.plans.registry import query
from textmatch.sources import views as V
from textmatch.sources.storage import stored

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
#: A posting text put before each document, so that sections, years and titles occur; the same in both engines.
SPLICE_SQL = """spliced AS (
    SELECT doc_id AS posting_id, 'Required: ' || CAST(doc_id % 9 + 1 AS VARCHAR) || '+ years experience in ' ||
        CASE doc_id % 5 WHEN 0 THEN 'python services' WHEN 1 THEN 'a similar role' WHEN 2 THEN 'data' WHEN 3 THEN 'go and rust' ELSE 'sql modelling work' END ||
        chr(10) || chr(10) || 'Preferred: familiarity with Docker and C++' || chr(10) || chr(10) || text AS description, source AS title
    FROM documents WHERE text IS NOT NULL)"""


def spliced(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(V.table(spark, d, "documents").where("text is not null"))
    k = F.col("doc_id") % 5
    skill = F.when(k == 0, "python services").when(k == 1, "a similar role").when(k == 2, "data").when(k == 3, "go and rust").otherwise("sql modelling work")
    text = F.concat(F.lit("Required: "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("+ years experience in "), skill, F.lit("\n\nPreferred: familiarity with Docker and C++\n\n"), F.col("text"))
    return docs.select(F.col("doc_id").alias("posting_id"), text.alias("description"), F.col("source").alias("title"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(V.table(spark, d, "documents"))


NORMAL = "regexp_replace(regexp_replace(regexp_replace(translate(text, '‘’“”–—', '''''\"\"--'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, md5({NORMAL}) AS normal FROM documents")
def e1_normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(X.normalise_text(F.col("text"))).alias("normal"))


def _footless_sql(source: str) -> str:
    """id and text of a query, the text without its footer as kept."""
    starts = "|".join(E.FOOTER_STARTS)
    return (
        f"footed AS (SELECT *, string_split(text, chr(10)) AS ls FROM ({source})), opened AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: length(trim(x)) < 60 AND regexp_matches(lower(trim(x)), '^({starts})')), true), 0) AS opens FROM footed),"
        " footless AS (SELECT id, text, CASE WHEN opens = 0 THEN trim(text) WHEN length(trim(array_to_string(list_slice(ls, 1, opens - 1), chr(10)))) >= length(text) * 0.2 THEN trim(array_to_string(list_slice(ls, 1, opens - 1), chr(10))) ELSE text END AS kept FROM opened)"
    )


@query("WITH " + _footless_sql("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || 'Industry Type: IT' || chr(10) || 'UG: any' ELSE text END AS text FROM documents") + " SELECT id AS doc_id, md5(kept) AS kept, length(text) - length(kept) AS cut FROM footless")
def e2_strip_footer(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\nIndustry Type: IT\nUG: any"))).otherwise(F.col("text"))
    kept = E.strip_footer(text)
    return _docs(spark, d).select("doc_id", F.md5(kept).alias("kept"), (F.length(text) - F.length(kept)).cast("long").alias("cut"))


def _section_sql(paragraph: str, sections: dict[str, tuple[str, ...]] = E.SECTION_KEYS) -> str:
    scores = {name: " + ".join(f"CASE WHEN contains({paragraph}, '{p.replace(chr(39), chr(39) * 2)}') THEN {len(p.split())} ELSE 0 END" for p in keys) for name, keys in sections.items()}
    best = "greatest(" + ", ".join(f"({s})" for s in scores.values()) + ")"
    cases = " ".join(f"WHEN ({s}) = {best} THEN '{name}'" for name, s in scores.items())
    return f"CASE WHEN {best} = 0 THEN 'general' {cases} END"


PARAGRAPHS = "SELECT posting_id, CAST(unnest(range(len(ps))) AS INTEGER) AS pos, unnest(ps) AS para FROM (SELECT posting_id, regexp_split_to_array(description, '\\n{2,}') AS ps FROM spliced)"


@query(f"WITH {SPLICE_SQL}, p AS ({PARAGRAPHS}) SELECT posting_id, pos, {_section_sql('lower(para)')} AS section, md5(para) AS paragraph FROM p")
def e3_detect_sections(spark: SparkSession, d: str) -> DataFrame:
    return E.detect_sections(spliced(spark, d)).select("posting_id", "pos", "section", F.md5("paragraph").alias("paragraph"))


@query(f"WITH {SPLICE_SQL}, p AS ({PARAGRAPHS}) SELECT posting_id, pos, {_section_sql('lower(para)', E.OLDER_SECTION_KEYS)} AS section FROM p")
def e3b_detect_sections_older(spark: SparkSession, d: str) -> DataFrame:
    return E.detect_sections(spliced(spark, d), E.OLDER_SECTION_KEYS).select("posting_id", "pos", "section")


def _title_sql(text: str, older: bool = False) -> str:
    words, wrong = "|".join(E.TITLE_WORDS[:9] if older else E.TITLE_WORDS), "|".join(E.NOT_TITLES)
    allowed = "true" if older else "NOT regexp_matches(lower({x}), '" + wrong + "')"
    labels = ("(?i)(?:role|position|job title)\\s*[:\\-]\\s*(.+)", "(?i)we(?:''re| are) (?:looking|hiring) for an?\\s+(.+?)(?:\\s+to|\\s+who|\\.|$)")
    said = [f"trim(regexp_extract({text}, '{label}', 1))" for label in labels]
    accepted = [f"CASE WHEN length({x}) > 3 AND length({x}) < 80 AND {allowed.format(x=x)} THEN {x} END" for x in said]
    lines = f"list_transform(string_split({text}, chr(10)), lambda x: trim(x))"
    titled = f"list_filter({lines}, lambda x: length(x) > 0 AND length(x) < 100 AND regexp_matches(lower(x), '{words}') AND {allowed.format(x='x')})[1]"
    first = f"left(list_filter({lines}, lambda x: x <> '')[1], 80)" if older else "''"
    return f"coalesce({', '.join(accepted)}, {titled}, {first}, '')"


@query(f"SELECT doc_id, {_title_sql('text', True)} AS found FROM documents WHERE text IS NOT NULL")
def e4b_extract_title_older(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", E.extract_title(F.col("text"), older=True).alias("found"))


@query(f"WITH {SPLICE_SQL}, x AS (SELECT posting_id, CASE WHEN posting_id % 3 = 0 THEN 'Position: Data Engineer ' || title || chr(10) || description ELSE description END AS text FROM spliced) SELECT posting_id, {_title_sql('text')} AS found FROM x")
def e4_extract_title(spark: SparkSession, d: str) -> DataFrame:
    rows = spliced(spark, d)
    text = F.when(F.col("posting_id") % 3 == 0, F.concat(F.lit("Position: Data Engineer "), F.col("title"), F.lit("\n"), F.col("description"))).otherwise(F.col("description"))
    return rows.select("posting_id", E.extract_title(text).alias("found"))


@query("WITH ls AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(range(len(a))) AS \"at\", trim(regexp_replace(trim(unnest(a)), '^[-•*·▪▸►‣⁃]\\s*', '')) AS line FROM ls) SELECT doc_id AS posting_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY \"at\") - 1 AS INTEGER) AS pos, md5(line) AS line FROM l WHERE line <> ''")
def e5_section_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select(F.col("doc_id").alias("posting_id"), F.lit("general").alias("section"), F.lit(0).alias("pos"), F.col("text").alias("paragraph"))
    return E.section_lines(rows).select("posting_id", "pos", F.md5("line").alias("line"))


STRUCTURED_SQL = (
    f"{SPLICE_SQL}, " + _footless_sql(f"SELECT posting_id AS id, {NORMAL} AS text FROM (SELECT posting_id, description AS text FROM spliced)")
    + ", paras AS (SELECT id, unnest(range(len(ps))) AS pos, unnest(ps) AS para FROM (SELECT id, regexp_split_to_array(kept, '\\n{2,}') AS ps FROM footless)),"
    + f" said AS (SELECT id, pos, {_section_sql('lower(para)')} AS section, string_split(para, chr(10)) AS ls FROM paras),"
    + " every AS (SELECT id, section, pos, unnest(range(len(ls))) AS place, trim(regexp_replace(trim(unnest(ls)), '^[-•*·▪▸►‣⁃]\\s*', '')) AS line FROM said),"
    + " per AS (SELECT id, section, string_agg(line, '|' ORDER BY pos, place) AS lines, count(*) AS n FROM every WHERE line <> '' GROUP BY ALL),"
    + f" structured AS (SELECT f.id AS posting_id, {_title_sql('kept')} AS title, "
    + ", ".join(f"md5(coalesce((SELECT lines FROM per WHERE per.id = f.id AND section = '{'general' if c == 'other' else c}'), '')) AS {c}" for c in (*E.SECTION_KEYS, "other"))
    + ", coalesce((SELECT n FROM per WHERE per.id = f.id AND section = 'required'), 0) AS n_required FROM footless f)"
)


@query(f"WITH {STRUCTURED_SQL} SELECT posting_id, title, {', '.join((*E.SECTION_KEYS, 'other'))}, 'fallback' AS method FROM structured")
def e6_structure_postings(spark: SparkSession, d: str) -> DataFrame:
    rows = E.structure_postings(spliced(spark, d))
    return rows.select("posting_id", "title", *[F.md5(F.array_join(c, "|")).alias(c) for c in (*E.SECTION_KEYS, "other")], "method")


STOPS = ", ".join(f"'{w}'" for w in E.COVERAGE_STOP_WORDS)


@query(f"WITH t AS (SELECT doc_id, list_filter(list_distinct({TOKENS}), lambda x: NOT list_contains([{STOPS}], x)) AS w, regexp_extract_all(lower(substr(text, 1, 500)), '[a-z0-9]+') AS s FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS n_wanted, CAST(len(list_filter(w, lambda x: list_contains(s, x))) AS INTEGER) AS n_covered FROM t")
def e7_token_coverage(spark: SparkSession, d: str) -> DataFrame:
    part = F.substring("text", 1, 500)
    wanted = F.size(F.array_except(F.array_distinct(X.tokens(F.col("text"))), F.array(*[F.lit(w) for w in E.COVERAGE_STOP_WORDS])))
    share = E.token_coverage(F.col("text"), part)
    return _docs(spark, d).select("doc_id", wanted.alias("n_wanted"), F.when(wanted == 0, 0).otherwise(F.round(share * wanted)).cast("int").alias("n_covered"))


SECTION_WORDS = ", ".join(f"('{s}', '{w}', {i})" for i, (s, w) in enumerate((s, w) for s, ws in B.SECTION_WORDS.items() for w in ws))
#: Marks are doubled first, as SQL's pattern engine has no lookaround and a mark between two years would bound only one.
YEARS = "list_transform(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9_])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9_])(20[0-2][0-9]|19[89][0-9])(?:$|[^A-Za-z0-9_])', 1), lambda y: CAST(y AS INTEGER))"


@query(
    f"WITH {V.BLOCKS_SQL}, words(s, w, i) AS (VALUES {SECTION_WORDS}), headed AS (SELECT doc_id, pos, CASE WHEN pos = 0 AND doc_id % 3 < 2 THEN CASE doc_id % 3 WHEN 0 THEN 'Work Experience 20' ELSE 'Skills since 20' END || lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') ELSE text END AS text, CASE WHEN pos % 5 = 3 THEN 'h2' ELSE block_type END AS block_type FROM blocks),"
    " told AS (SELECT doc_id, pos, CASE WHEN block_type IN ('h1', 'h2') THEN (SELECT first(s ORDER BY length(w) DESC, i) FROM words WHERE contains(lower(text), w))" + f" END AS s, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(present|current|now|today|ongoing)([^a-z0-9]|$)') THEN 2025 ELSE list_max({YEARS}) END AS y FROM headed)"
    " SELECT doc_id, pos, coalesce(last_value(s IGNORE NULLS) OVER w, 'other') AS section, last_value(y IGNORE NULLS) OVER w AS recency_year FROM told WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
def e8_section_blocks(spark: SparkSession, d: str) -> DataFrame:
    k, rows = F.col("doc_id") % 3, V.blocks(spark, d)
    named = F.concat(F.when(k == 0, "Work Experience 20").otherwise("Skills since 20"), F.lpad((F.col("doc_id") % 25).cast("string"), 2, "0"))
    rows = rows.withColumn("text", F.when((F.col("pos") == 0) & (k < 2), named).otherwise(F.col("text"))).withColumn("block_type", F.when(F.col("pos") % 5 == 3, "h2").otherwise(F.col("block_type")))
    return B.section_blocks(rows).select("doc_id", "pos", "section", "recency_year")


@query(f"WITH {V.BLOCKS_SQL} SELECT doc_id, block_type AS section, md5(string_agg(text, ' ' ORDER BY pos)) AS joined FROM blocks GROUP BY ALL")
def e9_section_text(spark: SparkSession, d: str) -> DataFrame:
    rows = B.section_text(V.blocks(spark, d).withColumnRenamed("block_type", "section"))
    return rows.select("doc_id", "section", F.md5("text").alias("joined"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 2025 WHEN o_orderkey % 4 = 1 THEN greatest(CAST(year(o_orderdate) AS INTEGER), 1999) END AS latest FROM orders")
def e10_latest_year(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    year = F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(year, F.lit(" - Present"))).when(k == 1, F.concat(F.lit("1999 to "), year, F.lit(" (known)"))).otherwise("no year, code 12024")
    return o.select("o_orderkey", X.latest_year(text).alias("latest"))


RAW_JSON = "struct<title:string,n:bigint>"


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN NULL ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 6 IN (3, 5) THEN NULL ELSE o_custkey END AS n FROM orders")
def e11_salvage_json(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    good = F.concat(F.lit('{"title": "'), F.col("o_orderpriority"), F.lit('", "n": '), F.col("o_custkey").cast("string"), F.lit("}"))
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 1, F.concat(F.lit("Sure:\n```json\n"), good, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Answer "), good, F.lit(" done")))
    raw = raw.when(k == 3, F.concat(F.lit('{"title": "'), F.col("o_orderpriority"), F.lit('", "n"'))).when(k == 5, "no braces at all").otherwise(good)
    return o.select("o_orderkey", X.salvage_json(raw, RAW_JSON).alias("p")).select("o_orderkey", "p.title", "p.n")


@query("SELECT o_orderkey AS posting_id, o_orderpriority AS title, o_orderstatus || '|a ' || o_custkey || '|b' AS required, o_orderstatus || '|a ' || o_custkey || '|b' AS about FROM orders WHERE o_orderkey % 3 <> 0")
def e12_validate_sections(spark: SparkSession, d: str) -> DataFrame:
    """Items with blanks around them, blank ones, and a list inside the list."""
    o = V.table(spark, d, "orders")
    items = F.array(F.concat(F.lit(" "), "o_orderstatus"), F.lit("  "), F.concat(F.lit('["a '), F.col("o_custkey").cast("string"), F.lit('", " b", ""]')))
    required = F.when(F.col("o_orderkey") % 3 != 0, items)
    parsed = F.struct(F.concat(F.lit(" "), "o_orderpriority").alias("title"), items.alias("responsibilities"), required.alias("required"), items.alias("preferred"), items.alias("about"), items.alias("other"))
    rows = E.validate_sections(o.select(F.col("o_orderkey").alias("posting_id"), parsed.alias("parsed")))
    return rows.select("posting_id", "title", F.array_join("required", "|").alias("required"), F.array_join("about", "|").alias("about"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_type || ', ' || p_name || ',,' || chr(10) || p_brand, '[,\\n]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part")
def e13_normalise_list(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    raw = F.concat("p_type", F.lit(", "), "p_name", F.lit(",,\n"), "p_brand")
    return p.select("p_partkey", F.array_join(X.normalise_list(raw), "|").alias("items"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type ELSE 'Skills' END AS category, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 2 END AS n, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size % 5 + 1 AS INTEGER) ELSE 3 END AS level FROM part")
def e14_normalise_skills(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    nested = F.concat(F.lit('[{"category": "'), "p_type", F.lit('", "skills": [{"name": "a", "level": '), (F.col("p_size") % 5 + 1).cast("string"), F.lit('}]}, {"category": "none", "skills": []}]'))
    raw = F.when(k == 0, nested).when(k == 1, '["x", " ", "y"]').otherwise("x, y\n")
    rows = V.table(spark, d, "part").select("p_partkey", X.normalise_skills(raw).alias("c"))
    return rows.select("p_partkey", F.col("c")[0]["category"].alias("category"), F.size(F.col("c")[0]["skills"]).alias("n"), F.col("c")[0]["skills"][0]["level"].alias("level"))


@query("SELECT p_partkey, repeat('●', CAST(greatest(1, least(5, p_size - 20)) AS INTEGER)) || repeat('○', CAST(5 - greatest(1, least(5, p_size - 20)) AS INTEGER)) AS dots FROM part")
def e15_level_dots(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "part").select("p_partkey", X.level_dots(F.col("p_size") - 20).alias("dots"))


@query("SELECT p_partkey, concat_ws(' | ', p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END) AS line FROM part")
def e16_contact_line(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").withColumn("b", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("  "))
    return p.select("p_partkey", X.contact_line("p_brand", "b").alias("line"))


@query(
    f"WITH {STRUCTURED_SQL} SELECT s.posting_id, CASE WHEN p.title IS NULL OR s.posting_id % 3 = 2 THEN 'fallback' WHEN s.posting_id % 3 = 0 THEN 'llm' ELSE 'llm-secondary' END AS method,"
    " CASE WHEN p.title IS NULL OR s.posting_id % 3 = 2 THEN s.n_required ELSE len(list_filter(string_split(p.description, chr(10)), lambda x: trim(x) <> '')) END AS n_required FROM structured s JOIN spliced p USING (posting_id)"
)
def e17_choose_structure(spark: SparkSession, d: str) -> DataFrame:
    posts = spliced(spark, d)
    rules = E.structure_postings(posts)
    lines = F.split("description", "\n")
    said = F.struct(F.col("title").alias("title"), lines.alias("responsibilities"), lines.alias("required"), lines.alias("preferred"), lines.alias("about"), lines.alias("other"))
    first = E.validate_sections(posts.where("posting_id % 3 = 0").select("posting_id", said.alias("parsed")))
    second = E.validate_sections(posts.where("posting_id % 3 < 2").select("posting_id", said.alias("parsed")))
    return E.choose_structure(posts, first, second, rules).select("posting_id", "method", F.size("required").cast("long").alias("n_required"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS BIGINT) AS words FROM documents")
def e18_word_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.word_count(F.col("text")).alias("words"))


PLAIN = "regexp_replace(body, '<[^>]*>', '', 'g')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    PLAIN = f"replace({PLAIN}, '{_name}', '{_char}')"


@query(f"""WITH pieces AS (SELECT page_id, unnest(string_split(html, '<')) AS piece, unnest(range(len(string_split(html, '<')))) AS i FROM pages),
    marked AS (
        SELECT *, sum(CAST(regexp_matches(piece, '(?i)^/?(?:h[1-6]|li|p|ul|ol|div|article|nav|footer|table)\\b') AS INTEGER)) OVER (PARTITION BY page_id ORDER BY i) AS g
        FROM pieces WHERE i > 0),
    parts AS (SELECT page_id, g, string_agg('<' || piece, '' ORDER BY i) AS s FROM marked GROUP BY page_id, g),
    bodies AS (
        SELECT page_id, g, lower(regexp_extract(s, '(?is)^<(h[1-3]|li|p)\\b[^>]*>', 1)) AS tag, regexp_replace(s, '(?is)^<(?:h[1-3]|li|p)\\b[^>]*>', '') AS body
        FROM parts WHERE regexp_matches(s, '(?is)^<(?:h[1-3]|li|p)\\b[^>]*>')),
    texts AS (SELECT page_id, g, tag, trim(regexp_replace({PLAIN}, '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM bodies),
    kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY g) - 1 AS pos FROM texts WHERE text <> '')
    SELECT page_id, CAST(pos AS INTEGER) AS pos, 'b' || CAST(pos AS VARCHAR) AS block_id, CASE tag WHEN 'li' THEN 'bullet' WHEN 'p' THEN 'paragraph' ELSE tag END AS block_type,
        md5(text) AS text, tag IN ('li', 'p') AND length(text) > 15 AS is_editable
    FROM kept""")
def a3_read_blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.read_blocks(V.table(spark, d, "pages")).withColumn("text", F.md5("text"))


@query(f"WITH {V.BLOCKS_SQL}, r AS (SELECT doc_id, block_type AS section, text, row_number() OVER (PARTITION BY doc_id, block_type ORDER BY pos) AS place FROM blocks) SELECT doc_id, section, CAST(place AS INTEGER) AS place, substr(text, 1, 120) AS preview FROM r WHERE place <= 3")
def r8_section_preview(spark: SparkSession, d: str) -> DataFrame:
    return B.section_preview(V.blocks(spark, d).withColumnRenamed("block_type", "section"))


@query()
def t1_tech_terms(spark: SparkSession, d: str) -> DataFrame:
    return spliced(spark, d).select("posting_id", F.array_join(T.tech_terms(F.col("description")), "|").alias("terms"))


@query("WITH w AS (SELECT o_orderkey AS posting_id, o_custkey % 7 AS a, o_orderkey % 5 AS b FROM orders) SELECT posting_id, CAST((CASE WHEN a = b THEN 1 ELSE 0 END) + 1 AS INTEGER) AS n_present, CAST(floor(((CASE WHEN a = b THEN 1 ELSE 0 END) + 1) * 100.0 / 2 + 0.5) AS INTEGER) AS coverage FROM w")
def t2_dictionary_gap(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    a, b = (F.concat(F.lit("SKILL"), x.cast("string")) for x in (F.col("o_custkey") % 7, F.col("o_orderkey") % 5))
    wanted = o.select(F.col("o_orderkey").alias("posting_id"), F.array(a, F.lit("Spark")).alias("terms"))
    have = o.select(F.col("o_orderkey").alias("posting_id"), F.array(F.lower(b), F.lit("spark")).alias("terms"))
    return T.dictionary_gap(wanted, have, ["posting_id"]).select("posting_id", F.size("present").alias("n_present"), "coverage")


@query()
def t3_skill_whitelist(spark: SparkSession, d: str) -> DataFrame:
    v = V.versions(spark, d).withColumn("content", F.concat_ws(" ", "content", F.when(F.col("version_id") % 3 == 0, "Python, C++ and Docker").otherwise("React/Go")))
    return T.skill_whitelist(v).select("profile_id", F.array_join("skills", "|").alias("skills"))


@query()
def t4_protected_tokens(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "c_mktsegment", F.lit("uses Next.js, CI/CD, LangChain, Weights & Biases and full-stack Python 3.11"))
    return V.table(spark, d, "customer").select("c_custkey", F.array_join(X.protected_tokens(text), "|").alias("tokens"))


GRAMS = "unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' ')))"


TECHNICAL = f"list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: length(x) >= 4 AND regexp_matches(x, '{T.TECHNICAL_WORD}')), lambda x: lower(x))"
RUN = "list_slice(w, i, i + {n} - 1)"
PHRASES_SQL = (
    f"{V.BLOCKS_SQL}, w AS (SELECT doc_id, {TOKENS} AS w, {TECHNICAL} AS t FROM blocks), g AS ("
    + " UNION ALL ".join(f"SELECT doc_id, array_to_string({RUN.format(n=n)}, ' ') AS phrase, list_has_any({RUN.format(n=n)}, t) AS technical FROM (SELECT doc_id, w, t, unnest(range(1, CAST(len(w) AS BIGINT) - {n} + 2)) AS i FROM w)" for n in (1, 2, 3, 4))
    + "), phrases AS (SELECT doc_id AS posting_id, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2 OR bool_or(technical))"
)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return V.blocks(spark, d).select(F.col("doc_id").alias("posting_id"), F.col("text").alias("line"))


@query(f"WITH {PHRASES_SQL} SELECT * FROM phrases")
def t6_ngram_phrases(spark: SparkSession, d: str) -> DataFrame:
    return T.ngram_phrases(_lines(spark, d))


@query()
def t5_extract_phrases(spark: SparkSession, d: str) -> DataFrame:
    return T.extract_phrases(_lines(spark, d), tuple(E.COVERAGE_STOP_WORDS), V.terms(spark, d))


@query(
    f"WITH {PHRASES_SQL}, s AS (SELECT posting_id, string_split(phrase, ' ') AS w FROM phrases WHERE contains(phrase, ' ')), parts AS ("
    + " UNION ".join(f"SELECT posting_id, array_to_string({RUN.format(n=n)}, ' ') AS phrase FROM (SELECT posting_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - {n} + 2)) AS i FROM s WHERE len(w) > {n})" for n in (1, 2, 3))
    + ") SELECT posting_id, phrase, n FROM phrases ANTI JOIN parts USING (posting_id, phrase)"
)
def t7_dedup_subphrases(spark: SparkSession, d: str) -> DataFrame:
    return T.dedup_subphrases(T.ngram_phrases(_lines(spark, d)))


@query()
def t8_key_terms(spark: SparkSession, d: str) -> DataFrame:
    return T.key_terms(_lines(spark, d), tuple(E.COVERAGE_STOP_WORDS), V.terms(spark, d))


FIRST_LINE = "split_part(text, chr(10), 1)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as postings: their text, and its first line as title."""
    docs = _docs(spark, d).where("text is not null")
    return docs.select(F.col("doc_id").alias("posting_id"), F.col("text").alias("description"), F.substring_index("text", "\n", 1).alias("title"))


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = _texts(spark, d)
    section = F.when(F.col("is_required"), "required").when(F.col("code") % 3 == 0, "preferred").otherwise("other")
    both = F.col("is_required") & (F.length("term") % 3 == 0)
    hits = texts.select("posting_id", F.explode(F.array_distinct(X.tokens(F.col("description")))).alias("term"))
    found = lookup_join(hits, stored(V.terms(spark, d)), ["term"], salt="posting_id")
    return found.select("posting_id", "term", F.explode(F.when(both, F.array(F.lit("required"), F.lit("preferred"))).otherwise(F.array(section))).alias("section")), texts


WEIGHED_SQL = (
    f"{V.TERMS_SQL}, f AS (SELECT d.doc_id AS posting_id, t.term, t.is_required, t.code, d.text FROM (SELECT doc_id, text, unnest(list_distinct({TOKENS})) AS tok FROM documents WHERE text IS NOT NULL) d JOIN terms t ON t.term = d.tok),"
    " w AS (SELECT *, (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) AS n FROM f)"
)
WEIGHT = (
    "CAST(round(CAST(CASE WHEN n >= 2 THEN least(3.0, 1 + 0.4 * least(5, n - 2)) ELSE 1.0 END * {sections}"
    f" * CASE WHEN contains(lower({FIRST_LINE}), term) THEN 2.5 ELSE 1.0 END AS DECIMAL(18, 6)), 3) AS DOUBLE) AS weight"
)
ONE_SECTION = "CASE WHEN is_required THEN 2.0 WHEN code % 3 = 0 THEN 1.3 ELSE 1.0 END"
BOTH_SECTIONS = "CASE WHEN is_required THEN CASE WHEN length(term) % 3 = 0 THEN 2.6 ELSE 2.0 END WHEN code % 3 = 0 THEN 1.3 ELSE 1.0 END"


@query(f"WITH {WEIGHED_SQL} SELECT posting_id, term, is_required, CAST(n AS BIGINT) AS freq, {WEIGHT.format(sections=ONE_SECTION)} FROM w")
def t9_weighted_terms(spark: SparkSession, d: str) -> DataFrame:
    return T.weighted_terms(*_found(spark, d))


@query(f"WITH {WEIGHED_SQL} SELECT posting_id, term, is_required, CAST(n AS BIGINT) AS freq, {WEIGHT.format(sections=BOTH_SECTIONS)} FROM w")
def t9b_weighted_terms_stacked(spark: SparkSession, d: str) -> DataFrame:
    return T.weighted_terms(*_found(spark, d), stack=True)


@query("SELECT p_partkey, regexp_replace(lower(trim(p_type || '_/ ' || p_name)), '[\\s\\-_/]+', ' ', 'g') AS term FROM part")
def t10_normalise_term(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "part").select("p_partkey", X.normalise_term(F.concat("p_type", F.lit("_/ "), "p_name")).alias("term"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of the benchmark's tokens and phrases; the first four letters of a long token are its abbreviation."""
    short = V.terms(spark, d).where("length(term) > 6").select(F.substring("term", 1, 4).alias("term"), F.col("term").alias("expansion"))
    return T.term_variants(V.dictionary(spark, d), short)


VARIANTS_SQL = f"""{V.TERMS_SQL}, base AS (SELECT term, regexp_replace(lower(trim(term)), '[\\s\\-_/]+', ' ', 'g') AS n FROM dictionary),
    lasts AS (SELECT term, n, list_last(string_split(n, ' ')) AS l FROM base WHERE contains(n, ' ')),
    verbs AS (SELECT term, regexp_replace(n, ' [^ ]+$', '') AS head, CASE WHEN suffix(l, 'ing') AND length(l) >= 5 THEN left(l, length(l) - 3)
        WHEN suffix(l, 'ed') AND length(l) >= 4 THEN left(l, length(l) - 2) WHEN suffix(l, 'e') AND length(l) >= 3 THEN left(l, length(l) - 1) END AS stem FROM lasts),
    short AS (SELECT left(term, 4) AS abbreviation, term AS expansion FROM terms WHERE length(term) > 6),
    variants AS (
        SELECT term, lower(trim(term)) AS variant FROM base UNION SELECT term, n FROM base UNION SELECT term, replace(n, ' ', '-') FROM base
        UNION SELECT term, left(n, length(n) - length(off)) || put FROM base, (VALUES ('ies', 'y'), ('ves', 'f'), ('ses', 's'), ('s', '')) p(off, put)
            WHERE NOT contains(n, ' ') AND suffix(n, off) AND length(n) > length(off) + 2
        UNION SELECT term, n || 's' FROM base WHERE NOT contains(n, ' ') AND NOT suffix(n, 's')
        UNION SELECT term, head || glue || stem || form FROM verbs, (VALUES (' '), ('-')) g(glue), (VALUES ('e'), ('ed'), ('es'), ('ing')) f(form) WHERE stem IS NOT NULL
        UNION SELECT term, expansion FROM base JOIN short ON n = abbreviation UNION SELECT term, abbreviation FROM base JOIN short ON n = expansion)"""


@query(f"WITH {VARIANTS_SQL} SELECT term, variant FROM variants")
def t11_term_variants(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d)


def _section(pos: F.Column) -> F.Column:
    return F.when(pos % 3 == 0, "skills").when(pos % 3 == 1, "experience").otherwise("other")


def _year(pos: F.Column) -> F.Column:
    return F.when(pos % 4 != 0, (2010 + F.col("doc_id") % 12 + pos % 3).cast("int"))


def _sectioned(spark: SparkSession, d: str) -> DataFrame:
    pos = F.col("pos")
    return V.blocks(spark, d).withColumn("section", _section(pos)).withColumn("recency_year", _year(pos))


def _sectioned_texts(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of _sectioned() where their documents are: doc_id, blocks."""
    docs = spread(V.table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    return docs.select("doc_id", F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("text"), _section(i).alias("section"), _year(i).alias("recency_year"))).alias("blocks"))


SECTIONED_SQL = f"""{VARIANTS_SQL}, {V.BLOCKS_SQL},
    sectioned AS (SELECT *, CASE pos % 3 WHEN 0 THEN 'skills' WHEN 1 THEN 'experience' ELSE 'other' END AS section, CASE WHEN pos % 4 <> 0 THEN CAST(2010 + doc_id % 12 + pos % 3 AS INTEGER) END AS recency_year FROM blocks),
    toks AS (SELECT doc_id, pos, section, recency_year, {TOKENS} AS w FROM sectioned),
    grams AS (SELECT doc_id, pos, section, recency_year, unnest(w) AS g FROM toks
        UNION SELECT doc_id, pos, section, recency_year, unnest(list_transform(range(1, CAST(len(w) AS BIGINT)), lambda i: w[i] || ' ' || w[i + 1])) FROM toks),
    keyed AS (SELECT term, variant, array_to_string(regexp_extract_all(variant, '[a-z0-9]+'), ' ') AS g FROM variants),
    found AS (SELECT doc_id, term, first(variant ORDER BY pos, variant) AS matched_variant, list_sort(list(DISTINCT section)) AS sections, max(recency_year) AS last_year FROM grams JOIN keyed USING (g) GROUP BY doc_id, term)"""


@query(f"WITH {SECTIONED_SQL} SELECT doc_id, term, matched_variant, array_to_string(sections, '|') AS sections_found, last_year FROM found")
def t14_find_terms(spark: SparkSession, d: str) -> DataFrame:
    found = T.find_terms(_variants(spark, d), _sectioned(spark, d))
    return found.select("doc_id", "term", "matched_variant", F.array_join("sections_found", "|").alias("sections_found"), "last_year")


@query(f"WITH {SECTIONED_SQL} SELECT term, count(*) AS docs, count(*) FILTER (list_contains(sections, 'skills')) AS in_skills, max(last_year) AS last_year FROM found GROUP BY term")
def d7_dictionary_join(spark: SparkSession, d: str) -> DataFrame:
    found = T.find_terms(_variants(spark, d), _sectioned(spark, d))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.array_contains("sections_found", "skills")).alias("in_skills"), F.max("last_year").alias("last_year"))


@query(f"WITH {V.TERMS_SQL} SELECT term, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct({TOKENS})) AS term FROM documents) JOIN terms USING (term) GROUP BY term")
def t12_term_present(spark: SparkSession, d: str) -> DataFrame:
    """Texts are tried for the terms whose words they share only."""
    texts = _texts(spark, d).select("posting_id", "description")
    words = texts.select("posting_id", F.explode(F.array_distinct(X.tokens(F.col("description")))).alias("term"))
    tried = lookup_join(words, stored(V.terms(spark, d).select("term")), ["term"], salt="posting_id")
    return T.present_terms(tried, texts, ["posting_id"]).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.TERMS_SQL} SELECT term, count(*) AS n FROM documents JOIN dictionary ON contains(lower(text), term) GROUP BY term")
def t13_term_substring(spark: SparkSession, d: str) -> DataFrame:
    held = T.contained_terms(_docs(spark, d).where("text is not null"), V.dictionary(spark, d))
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _missing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The terms of each document's posting, and the document's text."""
    asked = stored(V.posting_terms(spark, d).select("posting_id", "term", "is_required"))
    rows = lookup_join(pairs := V.pairs(spark, d), asked, ["posting_id"], salt="doc_id", keys=pairs.select("posting_id"))
    return rows.select(F.col("doc_id").alias("posting_id"), "term", "is_required"), _texts(spark, d)


MISSING_SQL = f"{V.TERMS_SQL}, missing AS (SELECT p.doc_id AS posting_id, t.term, t.is_required, lower(p.text) AS text FROM pairs p JOIN posting_terms t USING (posting_id))"


@query(f"WITH {MISSING_SQL}, t AS (SELECT doc_id AS posting_id, unnest({TOKENS}) AS term FROM documents), c AS (SELECT posting_id, term, count(*) AS freq FROM t GROUP BY ALL) SELECT m.posting_id, m.term, coalesce(c.freq, 0) AS freq FROM missing m LEFT JOIN c USING (posting_id, term)")
def t15_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    missing, texts = _missing(spark, d)
    return T.term_frequency(missing, texts, ["posting_id"])


@query(f"WITH {MISSING_SQL}, r AS (SELECT posting_id, term, is_required, CAST((length(text) - length(replace(text, term, ''))) // length(term) AS BIGINT) AS freq, contains({FIRST_LINE}, term) AS in_title FROM missing) SELECT posting_id, term, is_required, freq, CAST(row_number() OVER (PARTITION BY posting_id ORDER BY is_required DESC, freq DESC, term) AS INTEGER) AS rank FROM r WHERE is_required OR freq >= 3 OR in_title")
def t16_critical_missing(spark: SparkSession, d: str) -> DataFrame:
    return T.critical_missing(*_missing(spark, d), ["posting_id"])


@query(f"WITH {MISSING_SQL}, r AS (SELECT posting_id, term, contains({FIRST_LINE}, term) AS q, contains(substr(text, length({FIRST_LINE}) + 1), term) AS p FROM missing) SELECT posting_id, term, CASE WHEN q THEN 'required' ELSE 'preferred' END AS kind FROM r WHERE q OR p")
def t17_missing_by_section(spark: SparkSession, d: str) -> DataFrame:
    missing, texts = _missing(spark, d)
    rest = F.substring("description", F.length("title") + 1, F.length("description"))
    return T.missing_by_section(missing, texts.select("posting_id", F.col("title").alias("required_text"), rest.alias("preferred_text")), ["posting_id"])


@query("SELECT l_orderkey AS posting_id, CAST(round(CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity WHEN l_returnflag = 'A' THEN l_quantity * 0.5 ELSE 0 END) / sum(l_quantity) * 100 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS coverage FROM lineitem GROUP BY l_orderkey")
def t18_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("posting_id"), F.col("l_quantity").alias("weight"), (F.col("l_returnflag") == "R").alias("exact"), F.when(F.col("l_returnflag") == "A", 0.5).alias("credit"))
    return T.coverage(rows, ["posting_id"])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    parts = V.table(spark, d, "part")
    skills = parts.select((F.col("p_partkey") % 50).alias("posting_id"), F.col("p_name").alias("name"), (F.col("p_size") % 2 == 0).alias("is_required"))
    label = F.when(F.col("p_size") % 3 == 0, "demonstrated").when(F.col("p_size") % 3 == 1, "partial").otherwise("missing")
    labels = parts.where("p_size % 5 <> 0").select((F.col("p_partkey") % 50).alias("posting_id"), F.upper("p_name").alias("name"), label.alias("label"))
    return T.merge_skill_labels(skills, labels, ["posting_id"])


LABELLED_SQL = "skills AS (SELECT p_partkey % 50 AS posting_id, p_name AS name, p_size % 2 = 0 AS is_required FROM part), worst AS (SELECT p_partkey % 50 AS posting_id, lower(p_name) AS k, max(CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS r FROM part WHERE p_size % 5 <> 0 GROUP BY ALL), labelled AS (SELECT s.*, CASE coalesce(r, 2) WHEN 0 THEN 'demonstrated' WHEN 1 THEN 'partial' ELSE 'missing' END AS label FROM skills s LEFT JOIN worst w ON w.posting_id = s.posting_id AND w.k = lower(s.name))"


@query(f"WITH {LABELLED_SQL} SELECT posting_id, name, is_required, label FROM labelled")
def t20_merge_skill_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d)


@query(f"WITH {LABELLED_SQL} SELECT posting_id, lower(name) AS term, CASE WHEN is_required THEN 2.0::DOUBLE ELSE 1.3::DOUBLE END AS weight, label = 'demonstrated' AS exact, CASE label WHEN 'partial' THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END AS credit FROM labelled")
def t19_gap_from_labels(spark: SparkSession, d: str) -> DataFrame:
    return T.gap_from_labels(_labelled(spark, d)).select("posting_id", "term", "weight", "exact", "credit")


@query(f"WITH {LABELLED_SQL} SELECT posting_id, lower(name) AS kw, label <> 'missing' AS present, CASE label WHEN 'demonstrated' THEN 'High' WHEN 'partial' THEN 'Partial' ELSE CASE WHEN is_required THEN 'Critical' ELSE 'Missing' END END AS card FROM labelled")
def t21_keyword_cards(spark: SparkSession, d: str) -> DataFrame:
    return T.keyword_cards(T.gap_from_labels(_labelled(spark, d))).select("posting_id", "kw", "present", "card")


STEM = "CASE " + " ".join(f"WHEN suffix({{t}}, '{s}') AND length({{t}}) >= {len(s) + 3} THEN left({{t}}, length({{t}}) - {len(s)})" for s in ("ing", "tion", "ed", "er", "es", "s")) + " ELSE {t} END"


@query(f"SELECT doc_id, md5(array_to_string(list_transform(list_filter({TOKENS}, lambda x: NOT list_contains([{STOPS}], x)), lambda x: {STEM.format(t='x')}), ' ')) AS lemmas FROM documents")
def t23_lemma_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(F.array_join(T.lemma_tokens(F.col("text"), tuple(E.COVERAGE_STOP_WORDS)), " ")).alias("lemmas"))


@query(f"WITH {V.TERMS_SQL} SELECT term, {STEM.format(t='term')} AS stem FROM terms")
def s5_crude_stem(spark: SparkSession, d: str) -> DataFrame:
    return V.terms(spark, d).select("term", X.crude_stem(F.col("term")).alias("stem"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return e.where("vec_id >= 5").withColumn("profile_id", F.col("vec_id") % 6), e.where("vec_id < 5").select(F.col("vec_id").alias("profile_id"), "vector")


DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
FIT = "CASE WHEN q.vec_id IS NOT NULL THEN CAST(greatest(0, least(100, round(CAST((" + DOT.format(a="p.embedding", b="q.embedding") + " / (sqrt(" + DOT.format(a="p.embedding", b="p.embedding") + ") * sqrt(" + DOT.format(a="q.embedding", b="q.embedding") + ")) - 0.15) / 0.55 * 100 AS DECIMAL(18, 6)), 0))) AS INTEGER) END"


@query(f"SELECT p.vec_id, {FIT} AS match_score FROM embeddings p LEFT JOIN embeddings q ON q.vec_id = p.vec_id % 6 AND q.vec_id < 5 WHERE p.vec_id >= 5")
def s1_fit_score(spark: SparkSession, d: str) -> DataFrame:
    return S.score_pairs(*_vectors(spark, d), ["profile_id"]).select("vec_id", "match_score")


@query(f"SELECT p.vec_id, p.vec_id % 6 AS profile_id, {FIT} AS match_score, q.vec_id IS NULL AS failed FROM embeddings p LEFT JOIN embeddings q ON q.vec_id = p.vec_id % 6 AND q.vec_id < 5 WHERE p.vec_id >= 5")
def s2_score_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.score_pairs(*_vectors(spark, d), ["profile_id"]).select("vec_id", "profile_id", "match_score", F.col("match_score").isNull().alias("failed"))


@query(f"SELECT p.vec_id, coalesce({FIT}, 7) AS match_score FROM embeddings p LEFT JOIN embeddings q ON q.vec_id = p.vec_id % 6 AND q.vec_id < 5 WHERE p.vec_id >= 5")
def s3_rescore(spark: SparkSession, d: str) -> DataFrame:
    posts, profiles = _vectors(spark, d)
    return S.rescore(posts.withColumn("match_score", F.lit(7)), profiles, ["profile_id"]).select("vec_id", "match_score")


def _bm25_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sentences of each document's posting as queries, and all its lines as phrases."""
    sentences = V.table(spark, d, "benchmark").select(F.col("item_id").alias("posting_id"), F.explode(F.split("text", "[.\n]")).alias("query"))
    sentences = stored(sentences.select("posting_id", F.trim("query").alias("query")).where(F.size(X.tokens(F.col("query"))) > 0).distinct())
    queries = lookup_join(pairs := V.pairs(spark, d), sentences, ["posting_id"], salt="doc_id", keys=pairs.select("posting_id")).select("doc_id", "query")
    return queries, V.blocks(spark, d).select("doc_id", F.col("text").alias("phrase"))


DOC = ("doc_id",)
SIDES_SQL = f"""{V.TERMS_SQL}, {V.BLOCKS_SQL},
    sentences AS (SELECT DISTINCT item_id AS posting_id, trim(s) AS query FROM (SELECT item_id, unnest(string_split_regex(text, '[.\n]')) AS s FROM benchmark) WHERE len(regexp_extract_all(lower(s), '[a-z0-9]+')) > 0),
    q AS (SELECT doc_id, query FROM pairs JOIN sentences USING (posting_id)),
    p AS (SELECT doc_id, phrase, regexp_extract_all(lower(phrase), '[a-z0-9]+') AS w FROM (SELECT DISTINCT doc_id, text AS phrase FROM blocks))"""


@query(f"WITH {SIDES_SQL}, k AS (SELECT doc_id, query AS term, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS t FROM q), j AS (SELECT doc_id, phrase, unnest(w) AS t FROM p), "
       f"ks AS (SELECT doc_id, term, t AS key FROM k UNION SELECT doc_id, term, {STEM.format(t='t')} FROM k), js AS (SELECT doc_id, phrase, t AS key FROM j UNION SELECT doc_id, phrase, {STEM.format(t='t')} FROM j) SELECT doc_id, term, count(DISTINCT phrase) AS n FROM ks JOIN js USING (doc_id, key) GROUP BY ALL")
def s4_lexical_candidates(spark: SparkSession, d: str) -> DataFrame:
    queries, phrases = _bm25_sides(spark, d)
    return S.lexical_candidates(queries.withColumnRenamed("query", "term"), phrases, DOC).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


BM25_SQL = f"""{SIDES_SQL},
    tf AS (SELECT doc_id, phrase, len(w) AS dl, token, count(*) AS tf FROM (SELECT doc_id, phrase, w, unnest(w) AS token FROM p) GROUP BY ALL),
    c AS (SELECT doc_id, count(*) AS n, avg(len(w)) AS avgdl FROM p GROUP BY doc_id),
    raw AS (SELECT doc_id, token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN c USING (doc_id) GROUP BY doc_id, token, n),
    m AS (SELECT doc_id, avg(raw) AS mean FROM raw GROUP BY doc_id),
    idf AS (SELECT doc_id, token, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw JOIN m USING (doc_id)),
    s AS (SELECT doc_id, query, phrase, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM (SELECT doc_id, query, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS token FROM q) JOIN tf USING (doc_id, token) JOIN idf USING (doc_id, token) JOIN c USING (doc_id) GROUP BY ALL),
    top AS (SELECT * FROM (SELECT doc_id, query, phrase, score, row_number() OVER (PARTITION BY doc_id, query ORDER BY score DESC, phrase) AS rank FROM s WHERE score > 0) WHERE rank <= 10)"""


@query(f"WITH {BM25_SQL} SELECT doc_id, query, CAST(rank AS INTEGER) AS rank, CAST(floor(score * 1000 + 0.5) AS BIGINT) AS score_milli FROM top")
def s6_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25_topk(*_bm25_sides(spark, d), by=DOC).select("doc_id", "query", "rank", F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score_milli"))


CORPUS_SQL = f"""{V.TERMS_SQL}, {V.BLOCKS_SQL},
    q AS (SELECT DISTINCT trim(s) AS query FROM (SELECT unnest(string_split_regex(text, '[.\n]')) AS s FROM benchmark) WHERE len(regexp_extract_all(lower(s), '[a-z0-9]+')) > 0),
    p AS (SELECT phrase, regexp_extract_all(lower(phrase), '[a-z0-9]+') AS w FROM (SELECT DISTINCT text AS phrase FROM blocks)),
    tf AS (SELECT phrase, len(w) AS dl, token, count(*) AS tf FROM (SELECT phrase, w, unnest(w) AS token FROM p) GROUP BY ALL),
    c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM p),
    raw AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, c GROUP BY token, n),
    idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    s AS (SELECT query, phrase, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM (SELECT query, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS token FROM q) JOIN tf USING (token) JOIN idf USING (token), c GROUP BY ALL)"""


@query(f"WITH {CORPUS_SQL} SELECT query, CAST(rank AS INTEGER) AS rank, md5(phrase) AS phrase, CAST(floor(score * 1000 + 0.5) AS BIGINT) AS score_milli FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, phrase) AS rank FROM s WHERE score > 0) WHERE rank <= 10")
def s6b_corpus_topk(spark: SparkSession, d: str) -> DataFrame:
    """Best lines of all documents, as one collection behind a stored index, for every sentence of the benchmark."""
    asked = V.table(spark, d, "benchmark").select(F.explode(F.split("text", "[.\n]")).alias("query")).select(F.trim("query").alias("query")).where(F.size(X.tokens(F.col("query"))) > 0)
    top = I.index_topk(asked, I.build_index(V.blocks(spark, d).select(F.col("text").alias("phrase"))))
    return top.select("query", "rank", F.md5("phrase").alias("phrase"), F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score_milli"))


def _hashed(spark: SparkSession, d: str, strings: DataFrame) -> DataFrame:
    """A seeded stand-in for a model: each string takes the vector that its length and first character name."""
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = max(1, e.count())
    number = F.length("text") * 31 + F.ascii("text")
    named = strings.select(F.xxhash64("text").alias("text_key"), (number % n).cast("long").alias("vec_id")).distinct()
    return lookup_join(named, stored(e), ["vec_id"], salt="text_key").select("text_key", "vector")


def _shortlist(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25_topk(*_bm25_sides(spark, d), by=DOC).withColumn("is_required", F.length("query") % 2 == 0)


@query(f"WITH {BM25_SQL}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings), nv AS (SELECT count(*) AS nv FROM embeddings), "
       "x AS (SELECT t.*, round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 6) AS sim FROM top t, nv JOIN v a ON a.vec_id = (length(t.query) * 31 + ascii(t.query)) % nv JOIN v b ON b.vec_id = (length(t.phrase) * 31 + ascii(t.phrase)) % nv), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query ORDER BY sim DESC, rank, phrase DESC) AS k FROM x) "
       "SELECT doc_id, query, length(query) % 2 = 0 AS is_required, md5(phrase) AS phrase, sim AS similarity, sim >= 0.2 AS matched, CASE WHEN length(query) % 2 = 0 OR sim < 0.2 THEN 0.0::DOUBLE ELSE least(0.65::DOUBLE, round(0.65::DOUBLE * sim, 6)) END AS credit FROM r WHERE k = 1")
def s7_semantic_match(spark: SparkSession, d: str) -> DataFrame:
    short = stored(_shortlist(spark, d))
    strings = short.select(F.col("query").alias("text")).unionByName(short.select(F.col("phrase").alias("text")))
    return S.semantic_match(short, _hashed(spark, d, strings), S.RetrievalConfig(threshold=0.2), DOC).withColumn("phrase", F.md5("phrase"))


@query(f"WITH {BM25_SQL}, cc AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id, query) AS n FROM top) SELECT doc_id, query, CAST(rank AS INTEGER) AS rank, md5(phrase) AS phrase FROM cc WHERE total <= 12 OR rank <= greatest(1, floor(n * 12 / total))")
def s8_cap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.cap_pairs(_shortlist(spark, d), "doc_id", 12).select("doc_id", "query", "rank", F.md5("phrase").alias("phrase"))


@query(f"WITH {BM25_SQL} SELECT count(*) AS calls FROM (SELECT query AS s FROM top UNION SELECT phrase FROM top)")
def s9_embedding_calls(spark: SparkSession, d: str) -> DataFrame:
    return S.embedding_calls(stored(_shortlist(spark, d)))


@query(f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round({DOT.format(a='q.embedding', b='c.embedding')}, 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10")
def s10_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return S.cosine_topk(asked, e).select("query_id", "rank", "vec_id", "score")


@query()
def s10b_projected_topk(spark: SparkSession, d: str) -> DataFrame:
    """s10 by random projections: approximate, so tests hold its recall against the exact form."""
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return R.projected_topk(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), e).select("query_id", "rank", "vec_id", "score")


@query(f"""WITH {V.BLOCKS_SQL}, texts AS (SELECT DISTINCT text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM blocks),
    words AS (SELECT text, unnest(w) AS word FROM texts),
    features AS (SELECT text, word AS f FROM words UNION ALL SELECT text, ('_' || word || '_')[i:i + 2] AS f FROM (SELECT text, word, unnest(range(1, length(word) + 1)) AS i FROM words)),
    drawn AS (SELECT text, CAST('0x' || md5('p:' || f)[1 + 4 * k:4 + 4 * k] AS INTEGER) AS n FROM features, range(4) r(k)),
    sums AS (SELECT text, n % 16 AS place, sum(1 - 2 * (n // 16 % 2)) AS v FROM drawn GROUP BY ALL),
    vectors AS (SELECT text, list(coalesce(v, 0) ORDER BY place) AS v FROM (SELECT text, unnest(range(16)) AS place FROM texts) LEFT JOIN sums USING (text, place) GROUP BY text)
    SELECT doc_id, pos, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ' ') AS vector FROM blocks JOIN vectors USING (text)""")
def u1_embedder(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents as sums of hashed features, before they are scaled; the model is made once a worker."""
    run = S.embedder(lambda: hash_projection(dims=16, unit=False))
    made = V.blocks(spark, d).select("doc_id", "pos", F.transform(run("text"), lambda x: x.cast("long").cast("string")).alias("v"))
    return made.select("doc_id", "pos", F.array_join("v", " ").alias("vector"))
