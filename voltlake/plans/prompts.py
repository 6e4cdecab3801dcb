"""Keywords, merged answers and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.operators import lexical
from voltlake.operators import prompts as P
from voltlake.plans.base import CHATS_SQL, CHUNKS_SQL, REQUESTS_SQL, bm25_sql, chats, chunk_texts, keywords_sql, requests
from voltlake.plans.retrieval import keywords_of
from voltlake.session import cut, table


def request_keywords(spark, d):
    """RET-8, 9"""
    stats = cut(lexical.statistics(chunk_texts(spark, d), ["text"]))
    return keywords_of(requests(spark, d), stats).select("request_id", "tok", "weight", "rank")


def merged_answers(spark, d):
    """FUS-18, 19: the answers of one task, in order of the chat."""
    c = chats(spark, d).filter("done and task_id is not null").select("task_id", "chat_id", "answer")
    return P.joined_answers(c, "task_id", "chat_id", "answer").select("task_id", F.md5("answer").alias("digest"))


def compact_context(spark, d):
    """FUS-20, 21: the first five text hits of a request, blank ones dropped after the cut, as source blocks."""
    c = chunk_texts(spark, d)
    hits = lexical.search(requests(spark, d), c, "chunk_id", {"c": lexical.Channel({"text": 1.0})}, 5)
    top = hits.join(c.select("chunk_id", "title", F.trim("text").alias("text")), "chunk_id").filter("text <> ''")
    packed = top.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "chunk_id", "text"))).alias("a"))
    return packed.select("request_id", F.md5(P.source_blocks(F.col("a"))).alias("digest"), F.size("a").alias("n"))


def training_rows(spark, d):
    """EVL-19, 21"""
    rows = P.training_rows(table(spark, d, "samples").distinct())
    return rows.select("sample_id", F.size("prompt").alias("n_prompt"), F.md5("completion").alias("digest"))


QUERIES = {f.__name__: f for f in (request_keywords, merged_answers, compact_context, training_rows)}

SQL = {
    "request_keywords": f"WITH {CHUNKS_SQL}, {REQUESTS_SQL}, {keywords_sql()} SELECT request_id, tok, weight, rank FROM ks",
    "merged_answers": rf"WITH {CHATS_SQL} SELECT task_id, md5(string_agg(answer, e'\n\n\n' ORDER BY chat_id)) AS digest FROM c WHERE done AND task_id IS NOT NULL AND regexp_replace(coalesce(answer, ''), '[ \t\r\n\x{{3000}}]+', '', 'g') <> '' GROUP BY 1",
    "compact_context": rf"""WITH {CHUNKS_SQL}, {REQUESTS_SQL}, {bm25_sql(['text'])}, tp AS (SELECT x.request_id, x.rank, d.title, d.chunk_id, trim(d.text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS rank FROM hits) x JOIN d USING (chunk_id) WHERE x.rank <= 5 AND trim(d.text) <> ''),
 z AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS i FROM tp) SELECT request_id, md5(string_agg('[source_' || i || e']\ndocument_title: ' || coalesce(title, '') || e'\nchunk_id: ' || chunk_id || e'\n' || text, e'\n\n' ORDER BY i)) AS digest, CAST(count(*) AS INTEGER) AS n FROM z GROUP BY 1""",
    "training_rows": "WITH s AS (SELECT DISTINCT messages AS m, metadata FROM samples) SELECT metadata.sample_id AS sample_id, 2 AS n_prompt, md5(m[3].content) AS digest FROM s WHERE list_transform(m, lambda x: x.role) = ['system', 'user', 'assistant']",
}
