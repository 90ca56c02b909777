"""Registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from poiscope.llm.bpe import encode_documents
from poiscope.llm.common import held_out, importable, table
from poiscope.llm.conversations import damaged, repair_reports
from poiscope.llm.decontamination import contaminated
from poiscope.llm.exact_dedup import exact_groups
from poiscope.llm.extraction import extract_main_text
from poiscope.llm.language_id import identify
from poiscope.llm.line_dedup import drop_repeated_lines
from poiscope.llm.near_dedup import near_duplicates
from poiscope.llm.simhash import fingerprint_groups
from poiscope.llm.spelling import spelling_groups
from poiscope.llm.substring_dedup import repeated_passages
from poiscope.llm.toxicity import score_toxicity
from poiscope.llm.url_filter import ALLOW, BLOCK, Rule, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(importable(spark), sf_dir)
    return build


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL["op2_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, p, l, lower_key FROM (
        SELECT doc_id, p, ls[p] AS l, translate(trim(ls[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             LATERAL (SELECT unnest(generate_series(1, len(ls))) AS p))
), held AS (
    SELECT lower_key AS k, max(doc_id) AS last FROM lines WHERE length(lower_key) >= 40
    GROUP BY lower_key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT doc_id, p, l, (k IS NOT NULL AND doc_id <> last) AS gone FROM lines LEFT JOIN held ON lower_key = k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact_groups(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op6_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_documents(docs, decoded_into="decoded")
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = identify(docs, teaches=~held_out(F.col("doc_id")))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# The rules of the registered URL filter.
URL_RULES = (
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    done = score_toxicity(docs, labels, teaches=~held_out(F.col("doc_id")))
    return done.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_reports(damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


# Checksum of a list of bytes as DuckDB expressions: a table of the 256 byte steps, and the fold over it.
CRC_TABLE = """SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))"""


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text of code points below U+0800; `steps` must be in scope."""
    data = f"""flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)]
        ELSE [192 + (ord(ch) >> 6), 128 + (ord(ch) & 63)] END))"""
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295)"


SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
    FROM conversations, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM given, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
    FROM damaged
), judged AS (
    SELECT *, CASE WHEN said = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
    FROM placed
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
    FROM judged GROUP BY conv_id
), inserted(q, q2, more, letters, lines) AS (
    -- States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; none, one or two empty turns put in.
    SELECT q, q, 0, '', '' FROM range(4) r(q)
    UNION ALL VALUES (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'),
        (2, 3, 2, 'I', chr(10) || 'assistant:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
        (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), best AS (
    SELECT c.conv_id, CAST(0 AS BIGINT) AS i, p.q2 AS q, {{'cost': CAST(p.more AS BIGINT), 'audit': p.letters, 'lines': p.lines}} AS v
    FROM counted c, inserted p WHERE p.q = 0
    UNION ALL
    SELECT b.conv_id, b.i + 1, p.q2, min({{'cost': b.v.cost + e.cost + p.more, 'audit': b.v.audit || e.letter || p.letters, 'lines': b.v.lines || e.line || p.lines}})
    FROM best b JOIN judged r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1,
        LATERAL (
            SELECT 'D' AS letter, b.q AS q, CAST(3 AS BIGINT) AS cost, '' AS line
            UNION ALL SELECT 'K', CASE left(r.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
                CAST(r.fault = 'truncated' AS BIGINT), chr(10) || r.role || ':' || r.text
            WHERE r.fault NOT IN ('blank', 'duplicate')
                AND ((left(r.role, 1) = 's' AND b.q = 0) OR (left(r.role, 1) = 'u' AND b.q <> 2) OR (left(r.role, 1) = 'a' AND b.q = 2))
            UNION ALL SELECT 'R', CASE b.q WHEN 2 THEN 3 ELSE 2 END, 2 + CAST(r.fault = 'truncated' AS BIGINT),
                chr(10) || CASE b.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text
            WHERE r.fault NOT IN ('blank', 'duplicate')
        ) e JOIN inserted p ON p.q = e.q
    GROUP BY b.conv_id, b.i, p.q2
), chosen AS (
    SELECT b.conv_id, min(b.v) AS v FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i
    WHERE b.q IN (0, 3) GROUP BY b.conv_id
)
SELECT g.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
    coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(h.v.cost, 0) AS cost,
    coalesce(h.v.audit, '') AS audit, sha256(coalesce(substr(h.v.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM g.conv_id
"""


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_groups(table(spark, sf_dir, "documents"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


SQL["op13_spelling"] = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
        translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
), counted AS (
    SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY id, run
), hashed AS (
    SELECT run, n, {_crc32_sql("id || ':' || run")} AS h FROM counted, crc
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
    SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
), pairs AS (
    SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, w.word FROM cut a JOIN words w ON a.rest = w.word
    UNION SELECT w.word, a.word FROM cut a JOIN words w ON a.rest = w.word
), near AS (
    SELECT a, count(*) AS n_near, max(n) AS best_n, arg_min(b, (-n, b)) AS best FROM pairs JOIN words ON b = word GROUP BY a
), forms AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
    FROM words LEFT JOIN near ON word = a
), followed AS (
    SELECT word, word AS ending, 0 AS steps FROM forms
    UNION ALL SELECT f.word, g.form, f.steps + 1 FROM followed f JOIN forms g ON f.ending = g.word WHERE g.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(ending, steps) AS root FROM followed GROUP BY word) r ON f.word = r.word
"""
