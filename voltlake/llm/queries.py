"""Queries of the training-data operators and, where SQL can state them, the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltlake.functions.content import STAND_INS
from voltlake.llm import conversations, defects, neighbours, overlap, packing, personal, splitting, tokens
from voltlake.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_history").select("id", "query_vector", "answer_vector")
    return neighbours.similar_pairs(rows, {"query_vector": "query", "answer_vector": "answer"}).select("field", "id_a", "id_b")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.messages(table(spark, d, "llm_chat_table"), table(spark, d, "llm_session_table"))


def p2_clock_offsets(spark: SparkSession, d: str) -> DataFrame:
    turns = conversations.ordered_turns(table(spark, d, "llm_chat_table"), table(spark, d, "llm_session_table"))
    return conversations.clock_offsets(turns)


def p2_corrected(spark: SparkSession, d: str) -> DataFrame:
    turns = conversations.ordered_turns(table(spark, d, "llm_chat_table"), table(spark, d, "llm_session_table"))
    return conversations.corrected_messages(turns)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.chat_defects(table(spark, d, "llm_chat_table")).unionByName(defects.training_defects(table(spark, d, "training_sample")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "samples")).select("id_a", "id_b").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "samples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_kinds(splitting.split_texts(table(spark, d, "chunks"), once=False))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "chunks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(tokens.sizes(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find(table(spark, d, "documents"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (
    p1_found, p2_found, p2_clock_offsets, p2_corrected, p3_found, p4_found, p4_report, p5_found, p5_pieces, p6_ids, p7_containers, p8_found, p8_redacted,
)}

# SQL of has_content() and of the current rows, for DuckDB.
_BARE = r"regexp_replace(regexp_replace({c}, '(?s)<[/!]?[A-Za-z][^<>]*>|<!--.*?-->|<!\[CDATA\[|\]\]>', ' ', 'g'), '&(?:nbsp|amp|lt|gt|quot|apos|ensp|emsp|thinsp|zwnj|zwj|#\d+|#x[0-9a-fA-F]+);', ' ', 'g')"
_SIGNS = r"[\p{P}\p{S}\p{Z}\p{C}\s\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{034F}\x{FE00}-\x{FE0F}]+"
_EDGE = r"^[\p{P}\p{S}\p{Z}\p{C}\s]+|[\p{P}\p{S}\p{Z}\p{C}\s]+$"


def _content_sql(c: str) -> str:
    bare = _BARE.replace("{c}", c)
    words = ", ".join(f"'{w}'" for w in STAND_INS)
    return f"coalesce(regexp_replace({bare}, '{_SIGNS}', '', 'g') <> '' AND lower(regexp_replace({bare}, '{_EDGE}', '', 'g')) NOT IN ({words}), false)"


_DONE = r"coalesce(upper(regexp_replace(status, '^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$', '', 'g')) = 'COMPLETED', false)"
_TURNS = f"""cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY update_time DESC NULLS LAST, create_time DESC NULLS LAST, session_id DESC NULLS LAST, user_id DESC NULLS LAST) AS rn FROM llm_chat_table WHERE chat_id IS NOT NULL) WHERE rn = 1 AND session_id IS NOT NULL),
 own AS (SELECT session_id, max(user_id) AS owner FROM llm_session_table WHERE session_id IS NOT NULL GROUP BY 1),
 kept AS (SELECT c.session_id FROM cur c JOIN own o ON o.session_id = c.session_id GROUP BY 1 HAVING bool_and({_DONE} AND create_time IS NOT NULL AND {_content_sql('question')} AND {_content_sql('answer')} AND coalesce(user_id = owner, false))),
 turns AS (SELECT session_id, chat_id, create_time, update_time, row_number() OVER (PARTITION BY session_id ORDER BY create_time, chat_id) AS n FROM cur WHERE session_id IN (SELECT session_id FROM kept))"""
_NEAR = """u AS (SELECT DISTINCT '{f}' AS field, id, list_transform({c}, lambda z: coalesce(z, 'nan'::DOUBLE)) AS v FROM memory_history WHERE id IS NOT NULL AND len({c}) = 64),
 x AS (SELECT field, id, v, sqrt(list_dot_product(v, v)) AS n FROM u WHERE isfinite(list_dot_product(v, v)) AND list_dot_product(v, v) > 0),
 c AS (SELECT a.field, a.id AS q, b.id AS o, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS cos FROM x a JOIN x b ON a.id <> b.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cos DESC, o) AS rank FROM c WHERE cos >= 0.9::DOUBLE) SELECT DISTINCT field, least(q, o) AS id_a, greatest(q, o) AS id_b FROM r WHERE rank <= 10"""
SQL: dict[str, str] = {
    "p1_found": " UNION ALL ".join(f"SELECT * FROM (WITH {_NEAR.format(f=f, c=c)})" for f, c in (("query", "query_vector"), ("answer", "answer_vector"))),
    "p2_found": f"WITH {_TURNS} SELECT session_id, 2 * n - 1 AS msg_no, 'user' AS role, chat_id FROM turns UNION ALL SELECT session_id, 2 * n, 'assistant', chat_id FROM turns",
    "p5_found": r"""WITH l AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE length(text) > 1500), s AS (SELECT chunk_id, unnest(string_split(regexp_replace(regexp_replace(text, '([\n\r。！？；!?;])', '\1' || chr(1), 'g'), '\.(\s)', '.' || chr(1) || '\1', 'g'), chr(1))) AS part FROM l)
 SELECT chunk_id, CASE WHEN max(length(part)) > 1500 THEN 'hard' ELSE 'natural' END AS cut FROM s GROUP BY 1""",
}
