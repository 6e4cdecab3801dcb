"""Views of the tables that several queries share, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions.content import is_completed
from voltlake.functions.text import TOKEN
from voltlake.operators.prompts import IGNORED
from voltlake.session import table

CHUNK_TEXTS = ["chunk_index", "title", "chapter_title", "section_title", "third_title", "fourth_title", "text", "description"]


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key in as many partitions as the session shuffles into, so that the Python stage behind keeps all cores; the grouping by key reuses it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """One row a chunk_id, without vectors."""
    rows = table(spark, d, "chunks").filter("chunk_id is not null").select("chunk_id", *CHUNK_TEXTS)
    return spread(rows, "chunk_id").groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in CHUNK_TEXTS])


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "embedding").filter("embedding is not null").distinct()


def requests(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: chat rows of the memory whose id is divisible by 20. request_id, text."""
    rows = table(spark, d, "memory_history").filter("memory_type = 'chat'").withColumn("request_id", F.expr("try_cast(id as bigint)"))
    return rows.filter("request_id % 20 = 0").groupBy("request_id").agg(F.max("query").alias("text"), F.max("user_id").alias("user_id"))


def request_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_history").filter("memory_type = 'chat'").withColumn("request_id", F.expr("try_cast(id as bigint)"))
    return rows.filter("request_id % 20 = 0 and query_vector is not null").select("request_id", "query_vector").distinct()


def chats(spark: SparkSession, d: str) -> DataFrame:
    """The current row of each chat."""
    cols = ["update_time", "create_time", "session_id", "user_id", "task_id", "question", "answer", "status", "error_message"]
    rows = table(spark, d, "llm_chat_table").filter("chat_id is not null").groupBy("chat_id").agg(F.max(F.struct(*cols)).alias("s")).select("chat_id", "s.*")
    return rows.withColumn("done", is_completed(F.col("status")))


def memory(spark: SparkSession, d: str) -> DataFrame:
    """One row an id, without vectors."""
    cols = ["user_id", "session_id", "memory_type", "status", "query", "answer", "chat_ids"]
    rows = table(spark, d, "memory_history").filter("id is not null").select("id", *cols)
    return spread(rows, "id").groupBy("id").agg(*[F.max(c).alias(c) for c in cols])


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "title", "source", "lang", "doc_kind")


CHUNKS_SQL = "d AS (SELECT chunk_id, " + ", ".join(f"max({c}) AS {c}" for c in CHUNK_TEXTS) + " FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"
REQUESTS_SQL = "q AS (SELECT try_cast(id AS BIGINT) AS request_id, max(query) AS text, max(user_id) AS user_id FROM memory_history WHERE memory_type = 'chat' AND try_cast(id AS BIGINT) % 20 = 0 GROUP BY 1)"
CHATS_SQL = (
    "c AS (SELECT * EXCLUDE (rn), coalesce(upper(trim(status, e' \\t\\r\\n')) = 'COMPLETED', false) AS done FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY update_time DESC NULLS LAST, create_time DESC NULLS LAST) AS rn "
    "FROM (SELECT DISTINCT * FROM llm_chat_table WHERE chat_id IS NOT NULL)) WHERE rn = 1)"
)
MEMORY_SQL = "m AS (SELECT id, max(user_id) AS user_id, max(session_id) AS session_id, max(memory_type) AS memory_type, max(status) AS status, max(query) AS query, max(answer) AS answer, max(chat_ids) AS chat_ids FROM memory_history WHERE id IS NOT NULL GROUP BY id)"
DOCS_SQL = "t AS (SELECT doc_id, coalesce(text, '') AS text, title, source, lang, doc_kind FROM documents)"


def toks(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), '{TOKEN}')"


# The keywords of a request, as operators.prompts.keywords() makes them: pairs of Han signs are merged inside runs, by turns.
_HAN1 = "regexp_full_match({}, '[\\x{{4e00}}-\\x{{9fff}}]')"
def keywords_sql(asked: str = "q", out: str = "qk", tag: str = "") -> str:
    """CTEs up to ks(request_id, tok, weight, rank) and out(request_id, text, keywords)."""
    t = tag
    return f"""
 kd{t} AS (SELECT tok, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest({toks('text')}) AS tok FROM d) GROUP BY 1),
 kt{t} AS (SELECT request_id, tok, min(i) AS i FROM (SELECT request_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT request_id, {toks('text')} AS t FROM {asked})) GROUP BY 1, 2),
 kw{t} AS (SELECT kt.request_id, i, kt.tok, round(ln(1 + n / coalesce(df, 1)) / ln(1 + n), 6) AS w FROM kt{t} kt LEFT JOIN kd{t} kd ON kd.tok = kt.tok CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM d)
   WHERE kt.tok NOT IN ({', '.join(f"'{w}'" for w in IGNORED)})),
 ko{t} AS (SELECT *, lead(tok) OVER o AS t2, lead(w) OVER o AS w2 FROM kw{t} WHERE w >= 0.05 WINDOW o AS (PARTITION BY request_id ORDER BY i)),
 kb{t} AS (SELECT ko.*, coalesce({_HAN1.format('tok')} AND {_HAN1.format('t2')} AND contains(lower(q.text), tok || t2), false) AS j FROM ko{t} ko JOIN {asked} q ON q.request_id = ko.request_id),
 kr{t} AS (SELECT *, sum(CASE WHEN pj THEN 0 ELSE 1 END) OVER (PARTITION BY request_id ORDER BY i) AS run
   FROM (SELECT *, coalesce(lag(j) OVER (PARTITION BY request_id ORDER BY i), false) AS pj FROM kb{t})),
 kp{t} AS (SELECT *, row_number() OVER (PARTITION BY request_id, run ORDER BY i) AS p FROM kr{t}),
 km{t} AS (SELECT request_id, CASE WHEN j THEN tok || t2 ELSE tok END AS tok, max(CASE WHEN j THEN greatest(w, w2) ELSE w END) AS weight FROM kp{t} WHERE p % 2 = 1 GROUP BY 1, 2),
 ks{t} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY weight DESC, tok) AS rank FROM km{t}) WHERE rank <= 8),
 kx{t} AS (SELECT request_id, string_agg(tok, ' ' ORDER BY rank) AS keywords FROM ks{t} GROUP BY 1),
 {out} AS (SELECT q.request_id, q.text, kx.keywords FROM {asked} q LEFT JOIN kx{t} kx ON kx.request_id = q.request_id)"""


def bm25_sql(fields: list[str], docs: str = "d", key: str = "chunk_id", asked: str = "q", tag: str = "", keywords: bool = False) -> str:
    """CTEs up to hits(request_id, key, field, score, matched, asked[, kscore: with keywords at 1.2]); tag makes their names differ."""
    union = " UNION ALL ".join(f"SELECT {key}, '{f}' AS field, {toks(f)} AS tk FROM {docs}" for f in fields)
    more = f" UNION ALL SELECT request_id, unnest({toks('keywords')}), 0.0::DOUBLE, 1.2::DOUBLE FROM {asked}" if keywords else ""
    t = tag
    w = "ln(1 + (n.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / ln.avgdl))"
    return f"""
 p0{t} AS (SELECT {key}, field, len(tk) AS dl, unnest(tk) AS tok FROM ({union})),
 p{t} AS (SELECT {key}, field, tok, count(*) AS tf, max(dl) AS dl FROM p0{t} GROUP BY 1, 2, 3),
 a{t} AS (SELECT request_id, tok, max(plain) AS plain, max(extra) AS extra FROM (SELECT request_id, unnest({toks('text')}) AS tok, 1.0::DOUBLE AS plain, 0.0::DOUBLE AS extra FROM {asked}{more}) GROUP BY 1, 2),
 an{t} AS (SELECT request_id, count(*) AS asked FROM a{t} WHERE plain > 0 GROUP BY 1),
 ln{t} AS (SELECT field, avg(dl) AS avgdl FROM (SELECT DISTINCT {key}, field, dl FROM p{t}) GROUP BY 1),
 df{t} AS (SELECT field, tok, count(*) AS df FROM p{t} GROUP BY 1, 2),
 n{t} AS (SELECT count(*) AS n FROM {docs}),
 hits{t} AS (SELECT a.request_id, p.{key}, p.field, round(sum(plain * {w}), 6) AS score, round(sum((plain + extra) * {w}), 6) AS kscore,
   count(*) FILTER (plain > 0) AS matched, any_value(an.asked) AS asked
   FROM a{t} a JOIN p{t} p ON p.tok = a.tok JOIN df{t} df ON df.field = p.field AND df.tok = p.tok JOIN ln{t} ln ON ln.field = p.field CROSS JOIN n{t} n JOIN an{t} an ON an.request_id = a.request_id GROUP BY 1, 2, 3)"""


# The stand-in embedding of a text, as functions.vectors.embedded() makes it: (key, dim, v) and its norm.
def embedded_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs name(key, dim, v) and name_n(key, norm) of non-zero vectors."""
    h = "md5(tok)"
    return f""" {name} AS (SELECT {key}, ('0x' || substr({h}, 1, 4))::INTEGER % 64 AS dim, sum(CASE WHEN ('0x' || substr({h}, 5, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE) AS v FROM (SELECT {key}, unnest({toks(text)}) AS tok FROM {source}) GROUP BY 1, 2),
 {name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name} GROUP BY 1 HAVING sum(v * v) > 0)"""
