"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, decontamination, filter_audit, hard_negatives, language, line_dedup, near_duplicates, packing, quality, secrets, token_counts, top_k, toxicity
from ledgerloom.llm._shared import held_out, table


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents)
    return language.identify(documents.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), path="source").drop("text_hash")


#: A conversation of control strings that op7 formats besides the table's.
HARD_TURN = "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TURN), (-7, 1, "assistant", HARD_TURN)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.examples(conversations.union(hard)))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), 10, F.col("vec_id") % 100 == 0)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, lexicon).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(embeddings, F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_chat_format": op7_chat_format,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_decontamination": op9_decontamination,
    "op10_top_k": op10_top_k,
    "op11_toxicity": op11_toxicity,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
        ), full_lines AS (
            SELECT doc_id, i - 1 AS place, trim(l[i], E' \t\r\f\x0b') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
            FROM lines, unnest(range(1, len(l) + 1)) u(i) WHERE trim(l[i], E' \t\r\f\x0b') <> ''
        ), windows AS (
            SELECT a.doc_id, a.place AS first, c.place AS last, a.line || chr(10) || b.line || chr(10) || c.line AS w
            FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN full_lines c ON a.doc_id = c.doc_id AND c.k = a.k + 2
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, first) AS r FROM windows
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS place FROM ranked WHERE r > 1
        ), cut AS (
            SELECT doc_id, list(place) AS places FROM covered GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(coalesce(len(l.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(c.places), 0) AS BIGINT) AS n_removed,
               CASE WHEN c.places IS NULL THEN d.text
                    ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(l.l)), lambda i: NOT list_contains(c.places, i)), lambda i: l.l[i + 1]), chr(10)), '') END AS text
        FROM documents d JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN cut c ON d.doc_id = c.doc_id
    """,
    "op9_decontamination": r"""
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), items AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
            FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(i) WHERE len(w) > 0
        ), places AS (
            SELECT d.doc_id, i, k.k, array_to_string(w[i:i + k.k - 1], ' ') AS g
            FROM doc_words d, (SELECT DISTINCT k FROM items) k, unnest(range(1, len(w) - k.k + 2)) u(i)
        ), hits AS (
            SELECT p.doc_id, p.i, p.k, t.item_id FROM places p JOIN items t ON p.g = t.g AND p.k = t.k
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items t ON d.doc_id = t.doc_id
    """,
    "op8_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM words
        ), shingles AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
        ), least AS (
            SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
        )
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM sets s JOIN least c ON s.doc_id = c.doc_id
    """,
    "op7_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), sized AS (
            SELECT *, length('### ') + length(replace(replace(replace(replace(role, '\', '\b'), '### ', '\h## '), '</turn>', '\l/turn>'), ':', '\c')) + length(': ')
                      + length(replace(replace(replace(text, '\', '\b'), '### ', '\h## '), '</turn>', '\l/turn>')) + length('</turn>') + 1 AS chars
            FROM turns
        ), summed AS (
            SELECT *, sum(chars) OVER w AS so_far, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last FROM sized
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(so_far) FILTER (WHERE last OR role = 'assistant') AS BIGINT) AS formatted_chars
        FROM summed GROUP BY conv_id
    """,
    "op10_top_k": r"""
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), known AS (
            SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
        ), flags AS (
            SELECT x.part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic, {
                'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t),
                'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(x.doc_id > min(x.doc_id) OVER (PARTITION BY t), false)} AS f
            FROM texts x LEFT JOIN known k ON x.doc_id = k.doc_id
        ), failed AS (
            SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: CASE c WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails, count(*) AS n FROM flags GROUP BY ALL
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
        ), orders AS (
            SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
        ), steps AS (
            SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS own, list_filter(string_split(filter_order, ''), lambda x: instr(filter_order, x) < s) AS earlier FROM orders, range(1, 6) r(s)
        ), counted AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (WHERE NOT list_has_any(fails, earlier) AND NOT list_contains(fails, own)), 0) AS kept,
                   coalesce(sum(n) FILTER (WHERE NOT list_has_any(fails, earlier) AND list_contains(fails, own)), 0) AS removed,
                   coalesce(sum(n) FILTER (WHERE list_has_any(fails, earlier) AND list_contains(fails, own)), 0) AS redundant,
                   coalesce(sum(n) FILTER (WHERE fails = [own]), 0) AS unique_fails,
                   coalesce(sum(n) FILTER (WHERE good AND NOT list_has_any(fails, earlier) AND list_contains(fails, own)), 0) AS good_lost,
                   coalesce(sum(n) FILTER (WHERE toxic AND NOT list_has_any(fails, earlier) AND list_contains(fails, own)), 0) AS toxic_lost
            FROM failed, steps GROUP BY ALL
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM counted
    """,
    "op13_hard_negatives": r"""
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
            FROM vectors a JOIN vectors c ON a.vec_id % 50 = 0 AND len(a.v) = len(c.v) AND a.vec_id <> c.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), ranked AS (
            SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
            FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
    """,
}
