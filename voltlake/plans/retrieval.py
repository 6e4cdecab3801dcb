"""Retrieval: lexical and vector channels, fusion, merging, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions import vectors as V
from voltlake.functions.text import clean_title_query, stripped, tokens
from voltlake.operators import fusion, lexical
from voltlake.operators import prompts as P
from voltlake.operators.knn import exact_knn
from voltlake.operators.lexical import Channel
from voltlake.plans.base import CHUNKS_SQL, MEMORY_SQL, REQUESTS_SQL, bm25_sql, chunk_texts, chunk_vectors, embedded_sql, keywords_sql, memory, request_vectors, requests, toks
from voltlake.session import cut

TOPK = 4
DEPTH = fusion.candidate_depth(TOPK)
TITLE = {"chapter_title": 5.0, "section_title": 3.0, "third_title": 1.5, "fourth_title": 1.0}
PLOT_TITLE = {"title": 3.0, "chapter_title": 2.5, "section_title": 2.0, "third_title": 1.5, "fourth_title": 1.0}
PLOT_TEXT = {"description": 2.0, "text": 1.0}
KEYWORDS = 1.2
CHANNELS = {
    "document_title": Channel({"title": 1.0}),
    "title": Channel(TITLE, share=0.6),
    "text": Channel({"text": 1.0}, keywords=KEYWORDS),
    "description_text": Channel({"description": 1.0}, keywords=KEYWORDS),
}


def _found(spark: SparkSession, d: str, channels: dict[str, Channel], k: int, asked: DataFrame | None = None, carry: tuple[str, str] | None = None) -> DataFrame:
    """Hits of the channels; the statistics of the chunks are counted once, for the keywords and for the scores."""
    c = chunk_texts(spark, d)
    asked = cut(requests(spark, d) if asked is None else asked)  # read for the keywords, the frequencies and the scores
    if not any(x.keywords for x in channels.values()):
        return lexical.search(asked, c, "chunk_id", channels, k, carry=carry)
    fields = list(dict.fromkeys(["text", *(f for x in channels.values() for f in x.boosts)]))
    stats = cut(lexical.statistics(c, fields))
    return lexical.search(cut(P.with_keywords(asked, keywords_of(asked, stats))), c, "chunk_id", channels, k, stats=stats, carry=carry)


def keywords_of(asked: DataFrame, stats: DataFrame) -> DataFrame:
    """Keywords of requests by the statistics of the chunks' texts."""
    head = stats.filter("field = 'text' and tok = ''").collect()  # one row
    return P.keywords(asked, stats.filter("field = 'text' and tok <> ''").select("tok", "df"), head[0]["rows"] if head else 0)


def _channel(spark: SparkSession, d: str, channel: Channel, k: int) -> DataFrame:
    return _found(spark, d, {"c": channel}, k).drop("channel")


def bm25_text(spark, d):
    """RET-1: the request and, at 1.2, its keywords."""
    return _channel(spark, d, CHANNELS["text"], 10).select("request_id", "chunk_id", "score", "rank")


def bm25_titles_msm(spark, d):
    """RET-2: best field of the boosted titles, 60 % of the tokens in one field; asked with the chunks' own headings (ids by place in the title)."""
    c = chunk_texts(spark, d)
    asked = c.filter("chunk_index % 20 = 0").groupBy("section_title").agg(F.count(F.lit(1)).alias("n")).filter("section_title is not null")
    asked = asked.select(F.xxhash64("section_title").alias("request_id"), F.col("section_title").alias("text"))
    found = lexical.search(asked, c, "chunk_id", {"c": CHANNELS["title"]}, 10)
    return found.join(asked, "request_id").select("text", "chunk_id", "score", "rank")


def bm25_document_title(spark, d):
    """RET-3"""
    return _channel(spark, d, CHANNELS["document_title"], 10).select("request_id", "chunk_id", "score", "rank")


def bm25_description(spark, d):
    """RET-5: the request and, at 1.2, its keywords."""
    return _channel(spark, d, CHANNELS["description_text"], 10).select("request_id", "chunk_id", "score", "rank")


def _knn(spark: SparkSession, d: str, k: int) -> DataFrame:
    found = exact_knn(request_vectors(spark, d), chunk_vectors(spark, d), "request_id", "query_vector", "chunk_id", "embedding", k)
    return found.select(F.col("request_id").cast("bigint").alias("request_id"), "chunk_id", ((1 + F.col("cosine")) / 2).alias("score"), "rank")


def _described(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """RET-4 and 12 on descriptions: requests and descriptions by the stand-in model (the tables hold no description vectors)."""
    q = asked.select("request_id", V.embedded(F.col("text")).alias("v"))
    c = chunks.select("chunk_id", V.embedded(F.col("description")).alias("v"))
    found = exact_knn(q, c, "request_id", "v", "chunk_id", "v", k)
    return found.select(F.col("request_id").cast("bigint").alias("request_id"), "chunk_id", ((1 + F.col("cosine")) / 2).alias("score"), "rank")


def knn_chunks(spark, d):
    """RET-4: score (1 + cosine) / 2."""
    return _knn(spark, d, 10)


def knn_descriptions(spark, d):
    """RET-4, 12, UDF-1: nearest descriptions by the stand-in embedding."""
    return _described(requests(spark, d), chunk_texts(spark, d), 10)


def minmax_text(spark, d):
    """RET-6"""
    top = _channel(spark, d, CHANNELS["text"], DEPTH)
    return top.select("request_id", "chunk_id", F.round(fusion.min_max(F.col("score"), "request_id"), 6).alias("score"))


def plot_fusion(spark, d):
    """RET-10 to 13, FUS-11: maximum-normalised title (0.3), text (0.2) and vector (0.5) channels, summed."""
    weight = F.when(F.col("channel") == "title", 0.3).otherwise(0.2)
    lex = _found(spark, d, {"title": Channel(PLOT_TITLE), "text": Channel(PLOT_TEXT)}, 20)
    lex = lex.select("request_id", "chunk_id", fusion.max_norm(F.col("score"), weight, "request_id", "channel").alias("s"))
    v = _described(requests(spark, d), chunk_texts(spark, d), 20).select("request_id", "chunk_id", fusion.max_norm(F.col("score"), 0.5, "request_id").alias("s"))
    s = lex.unionByName(v).groupBy("request_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score"))
    return lexical.top(s, "chunk_id", 10).select("request_id", "chunk_id", "score", "rank")


def doc_rank_dense(spark, d):
    """FUS-2"""
    top = _channel(spark, d, CHANNELS["document_title"], 10).withColumn("channel", F.lit("document_title")).join(chunk_texts(spark, d).select("chunk_id", "title"), "chunk_id")
    return fusion.first_seen_rank(top, "title").select("request_id", "chunk_id", "rank", "doc_rank")


def hybrid(spark: SparkSession, d: str, asked: DataFrame, vectors: DataFrame, k: int, depth: int, threshold: float | None = None) -> DataFrame:
    """FUS-1 to 4 and FLT-6, 7: six channels of requests (request_id, text) with vectors (request_id, query_vector), fused, cut at a threshold, the k best."""
    c = chunk_texts(spark, d)
    v = exact_knn(vectors, chunk_vectors(spark, d), "request_id", "query_vector", "chunk_id", "embedding", depth)
    v = v.select(F.col("request_id").cast("bigint").alias("request_id"), F.lit("text_vector").alias("channel"), "chunk_id", ((1 + F.col("cosine")) / 2).alias("score"), "rank")
    dv = _described(asked, c, depth).withColumn("channel", F.lit("description_vector"))
    # only document_title ranks by titles, so only its hits bring theirs along; all that follows goes by request and is shuffled once
    hits = _found(spark, d, CHANNELS, depth, asked, ("title", "document_title")).unionByName(v, True).unionByName(dv, True).repartition("request_id")
    fused = fusion.rrf_fuse(hits, "chunk_id", fusion.normalised_weights(fusion.WEIGHTS), title="title", threshold=threshold)
    return lexical.top(fused, "chunk_id", k, ties=("first",)).select("request_id", "chunk_id", "score", "channels", "rank")


def rrf_hybrid(spark, d):
    """FUS-1 to 4 and FLT-6, 7 over the stated requests."""
    return hybrid(spark, d, requests(spark, d), request_vectors(spark, d), TOPK, DEPTH, 0.1)


def split_queries(spark, d):
    """FUS-5"""
    return fusion.split_query(requests(spark, d), extra="，,")


def _subs(spark: SparkSession, d: str) -> DataFrame:
    return fusion.split_query(requests(spark, d), extra="，,")


def _sub_hits(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid search of each sub-query, to a depth that follows the number of sub-queries; all of a request share its vector (text_vector)."""
    subs = _subs(spark, d)
    # sub-queries stand in for requests: one number for each
    number = (F.col("request_id") * 10 + F.col("sub_no")).alias("request_id")
    asked = subs.select(number, F.col("sub_query").alias("text"))
    vectors = subs.select("request_id", "sub_no").join(request_vectors(spark, d), "request_id").select(number, "query_vector")
    depth = subs.groupBy("request_id").agg(fusion.sub_depth(TOPK, F.count(F.lit(1))).alias("depth"))
    found = hybrid(spark, d, asked, vectors, max(5, TOPK), fusion.candidate_depth(5))
    found = found.select(F.floor(F.col("request_id") / 10).alias("request_id"), F.pmod("request_id", F.lit(10)).cast("int").alias("sub_no"), "chunk_id", "score", "rank")
    return found.join(depth, "request_id").filter("rank <= depth").select("request_id", "sub_no", "chunk_id", "score")


def merge_subqueries(spark, d):
    """FUS-6, 7"""
    return fusion.merge_candidates(_sub_hits(spark, d), "chunk_id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their sub-query and the tokens of their text, made once a chunk, not once a pair."""
    bodies = chunk_texts(spark, d).filter(stripped(F.col("text")) != "").select("chunk_id", F.array_distinct(tokens(F.col("text"))).alias("body"))
    return _sub_hits(spark, d).join(_subs(spark, d), ["request_id", "sub_no"]).join(bodies, "chunk_id")


def rerank_candidates(spark, d):
    """FUS-8 with the token scorer."""
    return fusion.rerank(_pairs(spark, d), "chunk_id", fusion.held)


def full_find(spark, d):
    """FUS-5 to 10: split, hybrid search, merge, rerank, balanced top-k."""
    return fusion.balanced_topk(fusion.scored_pairs(_pairs(spark, d), fusion.held), "chunk_id", TOPK)


def second_round_trigger(spark, d):
    """FUS-16: at most one usable result."""
    r = requests(spark, d).select("request_id").join(fusion.rerank(_pairs(spark, d), "chunk_id", fusion.held), "request_id", "left")
    return r.groupBy("request_id").agg(F.count("chunk_id").alias("usable")).select("request_id", "usable", (F.col("usable") <= 1).alias("second_round"))


def two_round_merge(spark, d):
    """FUS-15: text hits as the first round, description hits as the second."""
    both = _found(spark, d, {c: CHANNELS[c] for c in ("text", "description_text")}, 4).groupBy("request_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("channel") == c, F.struct("rank", "chunk_id")))).alias(n) for n, c in (("a", "text"), ("b", "description_text"))]
    )
    return both.select("request_id", F.posexplode(fusion.two_rounds(F.col("a.chunk_id"), F.col("b.chunk_id"))).alias("pos", "chunk_id"))


def context_pack(spark, d):
    """FUS-14: distinct non-blank texts of the best hits, cut to 800, the first four."""
    top = _channel(spark, d, CHANNELS["text"], 10).join(chunk_texts(spark, d).select("chunk_id", F.trim("text").alias("body")), "chunk_id").filter("body <> ''")
    first = top.groupBy("request_id", "body").agg(F.min("rank").alias("rank"))
    ranked = lexical.top(first.withColumn("score", -F.col("rank")), "body", 4)
    return ranked.select("request_id", F.col("rank").alias("pos"), F.substring("body", 1, 800).alias("context"))


def title_query_clean(spark, d):
    """RET-7"""
    return requests(spark, d).select("request_id", clean_title_query(F.col("text")).alias("cleaned"))


def memory_keyword(spark, d):
    """RET-15: the memories of the request's user, keyword channel, best three, maximum-normalised to 0.4."""
    m = memory(spark, d).filter("memory_type = 'chat'")
    found = lexical.search(requests(spark, d), m, "id", {"c": Channel({"query": 1.0, "answer": 1.0})}, 3, group="user_id")
    return found.select("request_id", "id", F.round(fusion.max_norm(F.col("score"), 0.4, "request_id"), 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (
    bm25_text, bm25_titles_msm, bm25_document_title, bm25_description, knn_chunks, knn_descriptions, minmax_text, plot_fusion, doc_rank_dense, rrf_hybrid, split_queries,
    merge_subqueries, rerank_candidates, full_find, second_round_trigger, two_round_merge, context_pack, title_query_clean, memory_keyword,
)}

_BASE = f"WITH {CHUNKS_SQL}, {REQUESTS_SQL},"
_KEYED = f"{_BASE} {keywords_sql()},"


def _best(boosts: dict[str, float], share: float = 0.0, src: str = "hits", key: str = "chunk_id", score: str = "score") -> str:
    case = " ".join(f"WHEN '{f}' THEN {b}::DOUBLE" for f, b in boosts.items())
    names = ", ".join(f"'{f}'" for f in boosts)
    return (
        f"SELECT request_id, {key}, round(max({score} * CASE field {case} END), 6) AS score FROM {src} "
        f"WHERE field IN ({names}) AND {score} > 0 AND matched >= greatest(floor(asked * {share}::DOUBLE), 1) GROUP BY 1, 2"
    )


def _ranked(inner: str, k: int, key: str = "chunk_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, {key}) AS rank FROM ({inner})) WHERE rank <= {k}"


def _lex(boosts: dict[str, float], k: int, share: float = 0.0) -> str:
    return f"{_BASE} {bm25_sql(list(boosts))} {_ranked(_best(boosts, share), k)}"


def _keyed(field: str, k: int) -> str:
    return _ranked(_best({field: 1.0}, score="kscore"), k)


def _lex_keyed(field: str, k: int) -> str:
    return f"{_KEYED} {bm25_sql([field], asked='qk', keywords=True)} {_keyed(field, k)}"


_QV = "SELECT DISTINCT try_cast(id AS BIGINT) AS request_id, list_transform(query_vector, lambda z: coalesce(z, 'nan'::DOUBLE)) AS v FROM memory_history WHERE memory_type = 'chat' AND try_cast(id AS BIGINT) % 20 = 0 AND len(query_vector) = 64"


def _knn_sql(asked: str = _QV) -> str:
    cos = "round(list_dot_product(qv.v, cv.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(cv.v, cv.v))), 6)"
    return f"""qv AS ({asked}),
 cv AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS v FROM chunks WHERE len(embedding) = 64 AND chunk_id IS NOT NULL),
 kn AS (SELECT request_id, chunk_id, (1 + {cos}) / 2 AS score, {cos} AS cosine FROM qv, cv
   WHERE list_dot_product(qv.v, qv.v) > 0 AND isfinite(list_dot_product(qv.v, qv.v)) AND list_dot_product(cv.v, cv.v) > 0 AND isfinite(list_dot_product(cv.v, cv.v)))"""


def _described_sql(asked: str, k: int) -> str:
    """CTEs up to dn(request_id, chunk_id, score, rank)."""
    return f"""{embedded_sql('qe', asked, 'request_id', 'text')}, {embedded_sql('ce', 'd', 'chunk_id', 'description')},
 dc AS (SELECT qn.request_id, cn.chunk_id, round(coalesce(sum(qe.v * ce.v), 0) / (max(qn.norm) * max(cn.norm)), 6) AS cosine FROM qe_n qn CROSS JOIN ce_n cn
   LEFT JOIN (qe JOIN ce ON qe.dim = ce.dim) ON qe.request_id = qn.request_id AND ce.chunk_id = cn.chunk_id GROUP BY 1, 2),
 dn AS (SELECT request_id, chunk_id, (1 + cosine) / 2 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cosine DESC, chunk_id) AS rank FROM dc) WHERE rank <= {k})"""


_MINMAX = "CASE WHEN max(score) OVER w = min(score) OVER w THEN CASE WHEN score <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
_MAXN = "CASE WHEN max(score) OVER (PARTITION BY request_id) > 0 THEN score / max(score) OVER (PARTITION BY request_id) * {w}::DOUBLE ELSE score END"
_WEIGHT = "CASE channel " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in fusion.WEIGHTS.items()) + " END"
_PLACE = "CASE channel " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(fusion.ORDER)) + " END"


def hybrid_sql(asked: str, vectors: str, depth: int, k: int, threshold: float) -> str:
    """CTEs up to hy(request_id, chunk_id, score, channels, rank); asked: request_id, text, keywords."""
    return f"""{bm25_sql(['title', 'text', 'description', *TITLE], asked=asked, keywords=True)}, {_knn_sql(vectors)}, {_described_sql(asked, depth)},
 ch AS (SELECT 'document_title' AS channel, * FROM ({_ranked(_best({'title': 1.0}), depth)}) UNION ALL SELECT 'title', * FROM ({_ranked(_best(TITLE, 0.6), depth)})
   UNION ALL SELECT 'text', * FROM ({_keyed('text', depth)}) UNION ALL SELECT 'description_text', * FROM ({_keyed('description', depth)})
   UNION ALL SELECT 'text_vector', request_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cosine DESC, chunk_id) AS rank FROM kn) WHERE rank <= {depth}
   UNION ALL SELECT 'description_vector', request_id, chunk_id, score, rank FROM dn),
 h AS (SELECT ch.*, min(rank) OVER (PARTITION BY request_id, channel, d.title) AS fr FROM ch JOIN d ON d.chunk_id = ch.chunk_id),
 r AS (SELECT *, dense_rank() OVER (PARTITION BY request_id, channel ORDER BY fr) AS dr, {_MINMAX} AS norm FROM h WINDOW w AS (PARTITION BY request_id, channel)),
 f AS (SELECT request_id, chunk_id, round(sum({_WEIGHT} * (0.8::DOUBLE * norm + 0.2::DOUBLE * 21 / (20 + CASE channel WHEN 'document_title' THEN dr ELSE rank END))), 6) AS score,
   count(*) AS channels, min(({_PLACE}) * 100000 + rank) AS first FROM r GROUP BY 1, 2),
 hy AS (SELECT request_id, chunk_id, score, channels, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, first, chunk_id) AS rank FROM f WHERE score >= {threshold}::DOUBLE) WHERE rank <= {k})"""


_SUBS = r"""sp AS (SELECT request_id, text, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[？?。；;！!\n，,]+'), lambda s: regexp_replace(s, '^[ ，,]+|[ ，,]+$', '', 'g')), lambda s: length(s) >= 2) AS l FROM q),
 un AS (SELECT request_id, s, min(i) AS i FROM (SELECT request_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM sp) GROUP BY 1, 2),
 sq AS (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY i) AS INTEGER) AS sub_no, s AS sub_query FROM un
   UNION ALL SELECT request_id, 1, coalesce(text, '') FROM sp WHERE len(l) = 0),
 subs AS (SELECT * FROM sq WHERE sub_no <= 5)"""
SUBS_SQL = _SUBS
_SUBV = f"SELECT s.request_id * 10 + s.sub_no AS request_id, x.v FROM subs s JOIN ({_QV}) x ON x.request_id = s.request_id"
_SUBHITS = f"""{_BASE} {_SUBS}, sr AS (SELECT request_id * 10 + sub_no AS request_id, sub_query AS text FROM subs), {keywords_sql('sr', 'srk')}, {hybrid_sql('srk', _SUBV, fusion.candidate_depth(5), max(5, TOPK), -1.0)},
 dp AS (SELECT request_id, greatest(5, CAST(ceil({TOPK} / count(*)::DOUBLE) AS BIGINT)) AS depth FROM subs GROUP BY 1),
 sh AS (SELECT dp.request_id, CAST(hy.request_id % 10 AS INTEGER) AS sub_no, chunk_id, score FROM hy JOIN dp ON dp.request_id = hy.request_id // 10 WHERE rank <= depth)"""
_SHARE = f"round(len(list_intersect({toks('sub_query')}, {toks('body')})) / nullif(len(list_distinct({toks('sub_query')})), 0)::DOUBLE, 6)"
_RR = f"""{_SUBHITS}, pr AS (SELECT sh.request_id, sh.sub_no, sub_query, sh.chunk_id, d.text AS body FROM sh JOIN subs ON subs.request_id = sh.request_id AND subs.sub_no = sh.sub_no JOIN d ON d.chunk_id = sh.chunk_id),
 sc AS (SELECT request_id, sub_no, chunk_id, coalesce({_SHARE}, 0) AS s FROM pr WHERE regexp_replace(body, '[ \\t\\r\\n\\x{{3000}}]+', '', 'g') <> ''),
 rr AS (SELECT request_id, chunk_id, max(s) AS score, arg_min(sub_no, (-s, sub_no)) AS sub_no FROM sc GROUP BY 1, 2 HAVING max(s) >= 0.2::DOUBLE)"""
_TITLED = f"WITH {CHUNKS_SQL}, q AS (SELECT section_title AS request_id, section_title AS text FROM d WHERE chunk_index % 20 = 0 AND section_title IS NOT NULL GROUP BY 1),"
_GREEDY = f"""{_RR}, ca AS (SELECT request_id, sub_no, chunk_id, s FROM sc WHERE s >= 0.2::DOUBLE),
 pk AS (SELECT request_id, 0 AS pick, ''::VARCHAR AS chunk_id, 0 AS sub_no, []::VARCHAR[] AS taken FROM (SELECT DISTINCT request_id FROM ca)
   UNION ALL SELECT request_id, pick + 1, b.c, b.n, list_append(taken, b.c) FROM (SELECT pk.request_id, pk.pick, pk.taken, arg_min({{'c': ca.chunk_id, 'n': ca.sub_no}}, ((ca.sub_no - pk.sub_no + 9) % 10, -ca.s, ca.chunk_id)) AS b
     FROM pk JOIN ca ON ca.request_id = pk.request_id AND NOT list_contains(pk.taken, ca.chunk_id) WHERE pk.pick < {TOPK} GROUP BY 1, 2, 3))"""

SQL = {
    "bm25_text": _lex_keyed("text", 10),
    "bm25_titles_msm": f"{_TITLED} {bm25_sql(list(TITLE))} SELECT request_id AS text, chunk_id, score, rank FROM ({_ranked(_best(TITLE, 0.6), 10)})",
    "bm25_document_title": _lex({"title": 1.0}, 10),
    "bm25_description": _lex_keyed("description", 10),
    "knn_chunks": f"WITH {_knn_sql()} SELECT request_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cosine DESC, chunk_id) AS rank FROM kn) WHERE rank <= 10",
    "knn_descriptions": f"{_BASE} {_described_sql('q', 10)} SELECT * FROM dn",
    "minmax_text": f"{_KEYED} {bm25_sql(['text'], asked='qk', keywords=True)} SELECT request_id, chunk_id, round({_MINMAX}, 6) AS score FROM ({_keyed('text', DEPTH)}) WINDOW w AS (PARTITION BY request_id)",
    "plot_fusion": f"{_BASE} {bm25_sql([*PLOT_TITLE, *PLOT_TEXT])}, {_described_sql('q', 20)}, s AS (SELECT request_id, chunk_id, {_MAXN.format(w=0.3)} AS s FROM ({_ranked(_best(PLOT_TITLE), 20)}) "
    f"UNION ALL SELECT request_id, chunk_id, {_MAXN.format(w=0.2)} AS s FROM ({_ranked(_best(PLOT_TEXT), 20)}) UNION ALL SELECT request_id, chunk_id, {_MAXN.format(w=0.5)} AS s FROM dn) "
    + _ranked("SELECT request_id, chunk_id, round(sum(s), 6) AS score FROM s GROUP BY 1, 2", 10),
    "doc_rank_dense": f"{_BASE} {bm25_sql(['title'])}, h AS (SELECT x.*, d.title, min(rank) OVER (PARTITION BY request_id, d.title) AS fr FROM ({_ranked(_best({'title': 1.0}), 10)}) x JOIN d USING (chunk_id)) "
    "SELECT request_id, chunk_id, rank, dense_rank() OVER (PARTITION BY request_id ORDER BY fr) AS doc_rank FROM h",
    "rrf_hybrid": f"{_KEYED} {hybrid_sql('qk', _QV, DEPTH, TOPK, 0.1)} SELECT * FROM hy",
    "split_queries": f"WITH {REQUESTS_SQL}, {_SUBS} SELECT request_id, sub_no, sub_query FROM subs",
    "merge_subqueries": f"{_SUBHITS} SELECT request_id, chunk_id, max(score) AS score, arg_min(sub_no, (-score, sub_no)) AS sub_no, count(*) AS matched, string_agg(printf('%d:%.6f', sub_no, score), ',' ORDER BY sub_no) AS scores FROM sh GROUP BY 1, 2",
    "rerank_candidates": f"{_RR} SELECT request_id, chunk_id, score, sub_no FROM rr",
    "full_find": f"{_GREEDY.replace('WITH ', 'WITH RECURSIVE ', 1)} SELECT request_id, pick, chunk_id, sub_no FROM pk WHERE pick > 0",
    "second_round_trigger": f"{_RR} SELECT q.request_id, count(rr.chunk_id) AS usable, count(rr.chunk_id) <= 1 AS second_round FROM q LEFT JOIN rr ON rr.request_id = q.request_id GROUP BY 1",
    "two_round_merge": f"""{_KEYED} {bm25_sql(['text', 'description'], asked='qk', keywords=True)}, a4 AS ({_keyed('text', 4)}), b4 AS ({_keyed('description', 4)}),
 o AS (SELECT request_id, chunk_id, CASE WHEN rank <= 2 THEN 10 + rank ELSE 30 + rank END AS k FROM b4 UNION ALL SELECT request_id, chunk_id, CASE WHEN rank <= 2 THEN 20 + rank ELSE 40 + rank END FROM a4),
 g AS (SELECT request_id, chunk_id, min(k) AS k FROM o GROUP BY 1, 2), z AS (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY k) - 1 AS INTEGER) AS pos, chunk_id FROM g) SELECT * FROM z WHERE pos < 4""",
    "context_pack": f"""{_KEYED} {bm25_sql(['text'], asked='qk', keywords=True)}, tp AS (SELECT request_id, trim(d.text) AS body, min(rank) AS r FROM ({_keyed('text', 10)}) x JOIN d USING (chunk_id) WHERE trim(d.text) <> '' GROUP BY 1, 2),
 z AS (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY r) AS INTEGER) AS pos, body FROM tp) SELECT request_id, pos, substring(body, 1, 800) AS context FROM z WHERE pos <= 4""",
    "title_query_clean": f"WITH {REQUESTS_SQL}, s AS (SELECT request_id, text, " + "replace(" * 7 + r"regexp_replace(text, '[？?！!，,。；;：:\s\x{3000}]+', '', 'g')"
    + "".join(f", '{p}', '')" for p in ["请问", "请介绍一下", "介绍一下", "讲一下", "什么是", "有哪些", "有什么"])
    + r" AS x FROM q) SELECT request_id, CASE WHEN x = '' THEN regexp_replace(text, '^[ \t\r\n\x{3000}]+|[ \t\r\n\x{3000}]+$', '', 'g') ELSE x END AS cleaned FROM s",
    "memory_keyword": f"WITH {MEMORY_SQL}, {REQUESTS_SQL}, mc AS (SELECT * FROM m WHERE memory_type = 'chat'), {bm25_sql(['query', 'answer'], docs='mc', key='id')}, "
    f"own AS (SELECT hits.* FROM hits JOIN q ON q.request_id = hits.request_id JOIN mc ON mc.id = hits.id WHERE q.user_id = mc.user_id), x AS ({_ranked(_best({'query': 1.0, 'answer': 1.0}, 0.0, 'own', 'id'), 3, 'id')}) "
    f"SELECT request_id, id, round({_MAXN.format(w=0.4)}, 6) AS score, rank FROM x",
}
