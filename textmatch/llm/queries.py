"""The registered queries of this subpackage, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.llm import ann, bpe, conversations, fim, fingerprints, html, jaccard, language, lines, mixing, quality, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"),
    )


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality.scored(docs, model, keep=("doc_id",))
    return out.select("doc_id", F.col("__doc").alias("document_quality"), F.col("__site").alias("site_quality"), F.col("__quality").alias("quality"), (F.col("__quality") >= 0.5).alias("keep"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages, and documents as pages of their source that declare nothing."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    model = language.fit(docs)
    from_pages = pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", none.alias("text"), "html",
        language.declared_language(F.col("html")).alias("declared"), *[v.alias(c) for c, v in language.site_columns(F.col("url")).items()],
    )
    from_docs = docs.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), F.coalesce("text", F.lit("")).alias("text"), none.alias("html"),
        none.alias("declared"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"),
    )
    return language.fused(from_docs.unionByName(from_pages), model, keep=("doc_id", "page_id"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    bad = conversations.damaged(every)
    return conversations.digests(bad, conversations.plans(bad, every))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transformed(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("__n").alias("n"), F.col("__form").alias("form"), F.col("__prefix_chars").alias("prefix_chars"), F.col("__middle_chars").alias("middle_chars"),
        F.sha2("__output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("__output"), F.col("__form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (op1_mix, op2_shard, op3_jaccard, op4_html, op5_quality, op6_neighbours, op7_bpe, op8_lines, op9_language, op10_fingerprint, op11_repair, op12_toxicity, op13_fim)
}


def _edit(state: str, letter: str, cost: int | str, line: str = "''") -> str:
    """SQL of the cheapest way to a state, one edit longer."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"


_USER, _ASSISTANT, _LINE = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
_KEEP = {k: f"CASE WHEN NOT bad AND kind = '{k[-1]}' THEN {_edit('v' + k[0], 'K', 'unfinished', _LINE)} END" for k in ("0s", "0u", "su", "au", "ua")}
_GIVE = {k: f"CASE WHEN NOT bad THEN {_edit('v' + k[0], 'R', '2 + unfinished', (_ASSISTANT if k[-1] == 'a' else _USER) + ' || text')} END" for k in ("0u", "su", "au", "ua")}

ORACLE = {
    "op1_mix": """
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
            FROM documents),
        src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM src),
        levelled AS (
            SELECT *, source_size * 2.0::DOUBLE / weight AS ratio,
                ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM weighed
            WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        wanted AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, (SELECT max(level) FROM levelled WHERE level <= ratio) * weight) AS target FROM levelled),
        plan AS (
            SELECT *, floor(target / source_size) AS whole, target / source_size - floor(target / source_size) AS part,
                target - floor(target / source_size) * source_size AS rest
            FROM wanted),
        ranked AS (
            SELECT s.doc_id, s.size, p.*, s.u / (1 - s.u) / (p.part / (1 - p.part)) AS rank
            FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
        run AS (
            SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)
        SELECT doc_id, size, source_size, target,
            CAST(size * (whole + CASE WHEN part > 0 AND before + size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM run""",
    "op3_jaccard": """
        WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        named AS (SELECT doc_id, w, array_to_string(w, ' ') AS key FROM split),
        texts AS (SELECT key, min(doc_id) AS rep, count(DISTINCT doc_id) AS copies, any_value(w) AS w FROM named GROUP BY key),
        shingle AS (SELECT DISTINCT rep, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM texts WHERE len(w) > 0),
        total AS (SELECT rep, count(*) AS n FROM shingle GROUP BY rep),
        common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.rep < b.rep GROUP BY ALL),
        link AS (SELECT a, b FROM common JOIN total x ON x.rep = a JOIN total y ON y.rep = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
        both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(node, root) AS (SELECT rep, rep FROM texts UNION SELECT b, root FROM reach JOIN both_ways ON node = a),
        class AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
        links AS (SELECT a, count(*) AS links FROM both_ways GROUP BY a)
        SELECT doc_id, class_id, coalesce(links, 0) AS links, copies
        FROM named JOIN texts USING (key) JOIN class ON node = rep LEFT JOIN links ON a = rep""",
    "op8_lines": """
        WITH named AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id IS NULL THEN row_number() OVER () ELSE 0 END AS nameless FROM documents),
        split AS (SELECT doc_id, nameless, string_split(text, chr(10)) AS ls FROM named),
        l AS (SELECT doc_id, nameless, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
        k AS (SELECT doc_id, nameless, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, nameless)) >= 10),
        m AS (SELECT k.doc_id, nameless, k.pos, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id, nameless""",
    "op11_repair": f"""
        WITH RECURSIVE src AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
            FROM conversations),
        dealt AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
                4294967295::BIGINT) % 20 AS damage
            FROM src),
        bad AS (
            SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
                CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM dealt),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM bad),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered),
        faults AS (
            SELECT conv_id, i, turn, role, text, left(role, 1) AS kind,
                CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
            FROM placed),
        ready AS (SELECT *, fault IN ('blank', 'duplicate') AS bad, CAST(fault = 'truncated' AS INTEGER) AS unfinished FROM faults),
        step(conv_id, i, v0, vs, vu, va) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)),
                {{'c': 2, 'a': 'I', 't': {_USER}}}, {{'c': 4, 'a': 'II', 't': {_USER} || {_ASSISTANT}}}
            FROM conversations
            UNION ALL
            SELECT conv_id, i, v0, vs, vu, list_min([va, {_edit('vu', 'I', 2, _ASSISTANT)}]) FROM (
                SELECT conv_id, i, v0, vs, list_min([vu, {', '.join(_edit(v, 'I', 2, _USER) for v in ('v0', 'vs', 'va'))}]) AS vu, va FROM (
                    SELECT r.conv_id, r.i, {_edit('v0', 'D', 3)} AS v0, list_min([{_edit('vs', 'D', 3)}, {_KEEP['0s']}]) AS vs,
                        list_min([{_edit('vu', 'D', 3)}, {', '.join(d[k] for d in (_KEEP, _GIVE) for k in ('0u', 'su', 'au'))}]) AS vu,
                        list_min([{_edit('va', 'D', 3)}, {_KEEP['ua']}, {_GIVE['ua']}]) AS va
                    FROM step s JOIN ready r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1))),
        counted AS (
            SELECT conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
            FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN (SELECT * RENAME (conv_id AS c) FROM ready) ON conv_id IS NOT DISTINCT FROM c GROUP BY conv_id),
        done AS (SELECT n.* EXCLUDE (n), list_min([v0, va]) AS best FROM counted n JOIN step s ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.n = s.i)
        SELECT * EXCLUDE (best), CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256 FROM done""",
    "op13_fim": """
        WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        units AS (
            SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
            FROM drawn),
        cut AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM units),
        parts AS (
            SELECT doc_id, text, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM cut)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parts""",
}
