"""Chats, sessions, memory, graph and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions import vectors as V
from voltlake.functions.content import is_completed
from voltlake.functions.text import session_name as name_of
from voltlake.functions.text import stripped
from voltlake.operators import fusion, lexical
from voltlake.operators import graph as G
from voltlake.operators import memory as M
from voltlake.operators.knn import exact_knn
from voltlake.plans.base import CHATS_SQL, MEMORY_SQL, REQUESTS_SQL, bm25_sql, chats, memory, request_vectors, requests
from voltlake.session import cut, table
from voltlake.streaming import events as E


def recent_turns(spark, d):
    """WIN-4: of the last 20 chats of a session those completed, the newest three first."""
    c = chats(spark, d).filter("session_id is not null")
    last = M.last_of(c, "session_id", [F.col("create_time").desc_nulls_last(), F.desc("chat_id")], 20).filter("done")
    return M.last_of(last, "session_id", [F.col("back")], 3, "pos").select("session_id", "pos", "chat_id")


def summary_groups(spark, d):
    """AGG-15"""
    done = chats(spark, d).filter("done and session_id is not null and create_time is not null and user_id is not null").select("user_id", "session_id", "chat_id", "create_time")
    return M.summary_groups(done)


def pending_summaries(spark, d):
    """AGG-15, JOIN-3: groups that no abstract of the memory has yet."""
    have = memory(spark, d).filter("memory_type = 'abstract' and chat_ids is not null").select(F.concat(F.lit("["), F.array_join("chat_ids", ","), F.lit("]")).alias("chat_ids")).distinct()
    return summary_groups(spark, d).join(have, "chat_ids", "left_anti").select("user_id", "session_id", "chat_ids")


def chat_list(spark, d):
    """SQL-1: numbered in order of time, then id, in each session."""
    c = chats(spark, d).filter("session_id is not null and create_time is not null").withColumn("s", F.unix_timestamp(F.col("create_time").cast("timestamp")))
    return M.numbered(c, ["session_id"], ["create_time", "chat_id"], "s").select("session_id", "n", "chat_id")


def completed_chats(spark, d):
    """SQL-13"""
    return chats(spark, d).filter("done and answer <> ''").select("user_id", "session_id", "chat_id", F.length("answer").alias("chars"))


def session_names(spark, d):
    """Names of sessions from their chats' questions."""
    return chats(spark, d).select("chat_id", name_of(F.coalesce("question", F.lit(""))).alias("name"))


def sessions_of_user(spark, d):
    """SQL-8, FUS-22: one row a session, newest first, nulls last."""
    s = table(spark, d, "llm_session_table").filter("session_id is not null").groupBy("session_id").agg(*[F.max(c).alias(c) for c in ("user_id", "session_name", "create_time", "update_time")])
    # numbered in two levels by the day of the last change, newest first; those without one come last
    seconds = F.coalesce(-F.unix_timestamp(F.col("update_time").cast("timestamp")), F.lit(1 << 40))
    order = [F.col("update_time").desc_nulls_last(), F.col("create_time").desc_nulls_last(), F.desc("session_id")]
    return M.numbered(s.withColumn("_s", seconds), ["user_id"], order, "_s", "pos").select("user_id", F.col("pos").cast("int").alias("pos"), "session_id", "session_name")


def ownership(spark, d):
    """SQL-9, FK check: chats whose session is missing or of another user."""
    s = table(spark, d, "llm_session_table").filter("session_id is not null").groupBy("session_id").agg(F.max("user_id").alias("owner"))
    c = chats(spark, d).select("chat_id", "session_id", "user_id").join(s, "session_id", "left")
    return c.select("chat_id", F.when(F.col("owner").isNull(), "missing").when(F.col("owner") != F.col("user_id"), "other").otherwise("own").alias("state"))


def chat_points(spark, d):
    """SQL-4, 5, 14: the chat of each (user, task)."""
    return chats(spark, d).filter("task_id is not null").groupBy("user_id", "task_id").agg(F.max("chat_id").alias("chat_id"))


def status_fold(spark, d):
    """STR-7, SQL-6, 7"""
    return M.status_fold(table(spark, d, "llm_chat_table").select("task_id", "update_time", "status").distinct())


def history_filter(spark, d):
    """FLT-9: rows whose status isn't failed or generating; a missing one counts as failed."""
    s = F.coalesce(F.upper(F.trim("status")), F.lit("FAILED"))
    return chats(spark, d).filter(~s.isin("FAILED", "GENERATING")).groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _abstract_scores(spark: SparkSession, d: str) -> DataFrame:
    a = memory(spark, d).filter("memory_type = 'abstract'")
    r = requests(spark, d)
    # the user is part of the search: a request meets only its user's summaries
    kw = lexical.search(r, a, "id", {"c": lexical.Channel({"query": 1.0})}, 10, group="user_id")
    v = table(spark, d, "memory_history").filter("memory_type = 'abstract' and query_vector is not null").select("id", "user_id", "query_vector").distinct()
    vec = exact_knn(request_vectors(spark, d).join(r.select("request_id", "user_id"), "request_id"), v, "request_id", "query_vector", "id", "query_vector", 10, group="user_id")
    vec = vec.select(F.col("request_id").cast("bigint").alias("request_id"), "id", ((1 + F.col("cosine")) / 2).alias("score"))
    return M.fused_search(kw, vec, "id")


def abstract_search(spark, d):
    """RET-17: summaries of the user, keyword 0.4 and vector 0.6, above 0.4, best two."""
    return lexical.top(_abstract_scores(spark, d), "id", 2).select("request_id", "id", "score", "rank")


def _named(spark: SparkSession, d: str) -> DataFrame:
    """request_id, id: chats of the user that the matched summaries name."""
    m = memory(spark, d)
    hit = abstract_search(spark, d).join(m.select("id", "chat_ids"), "id").select("request_id", F.explode("chat_ids").alias("id")).distinct()
    own = m.filter("memory_type = 'chat'").select("id", F.col("user_id").alias("owner"))
    return hit.join(requests(spark, d).select("request_id", "user_id"), "request_id").join(own, "id").filter("user_id = owner").select("request_id", "id")


def history_keyword(spark, d):
    """Keyword channel of FUS-17, raw scores: only the named chats are scored."""
    m = memory(spark, d).filter("memory_type = 'chat'")
    return lexical.pair_scores(_named(spark, d), requests(spark, d), m, "id", {"query": 1.0, "answer": 1.0})


def history_search(spark, d):
    """FUS-17, FLT-8, RET-16: chats of the user named by the matched summaries, three best by keyword 0.4 and three completed ones by vector 0.6, above 0.4."""
    named = cut(_named(spark, d))  # read by both channels
    m = memory(spark, d).filter("memory_type = 'chat'")
    kw = lexical.pair_scores(named, requests(spark, d), m, "id", {"query": 1.0, "answer": 1.0})
    vec = named_vectors(named, request_vectors(spark, d), table(spark, d, "memory_history").filter(is_completed(F.col("status"))))
    return M.fused_search(lexical.top(kw, "id", 3), lexical.top(vec, "id", 3), "id")


def memory_vector(spark, d):
    """RET-16, FLT-8: the user's completed chats by query_vector, best three, maximum-normalised to 0.6; the filters come before the ranking."""
    v = table(spark, d, "memory_history").filter((F.col("memory_type") == "chat") & is_completed(F.col("status"))).select("id", "user_id", "query_vector").distinct()
    q = request_vectors(spark, d).join(requests(spark, d).select("request_id", "user_id"), "request_id")
    found = exact_knn(q, v, "request_id", "query_vector", "id", "query_vector", 3, group="user_id")
    found = found.select(F.col("request_id").cast("bigint").alias("request_id"), "id", ((1 + F.col("cosine")) / 2).alias("score"), "rank")
    return found.select("request_id", "id", F.round(fusion.max_norm(F.col("score"), 0.6, "request_id"), 6).alias("score"), "rank")


def named_vectors(named: DataFrame, asked: DataFrame, rows: DataFrame) -> DataFrame:
    """request_id, id, score of the named chats by their query_vector; ties and repeats as in exact_knn."""
    q = asked.filter(V.usable(F.col("query_vector"), 64)).select("request_id", F.col("query_vector").alias("q"))
    v = rows.filter((F.col("memory_type") == "chat") & V.usable(F.col("query_vector"), 64)).select("id", F.col("query_vector").alias("v")).distinct()
    near = named.join(q, "request_id").join(v, "id").select("request_id", "id", ((1 + F.round(V.cosine(F.col("q"), F.col("v")), 6)) / 2).alias("score"))
    return near.groupBy("request_id", "id").agg(F.max("score").alias("score"))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "nation").select(F.concat(F.lit("rn"), "n_nationkey").alias("edge_id"), F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("ns"), "s_suppkey").alias("edge_id"), F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    c = table(spark, d, "customer").select(F.concat(F.lit("nc"), "c_custkey").alias("edge_id"), F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return r.unionByName(s).unionByName(c)


def graph_trails(spark, d):
    """GRA-2: all trails from regions to customers."""
    e = _graph(spark, d)
    starts = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    ends = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return G.trails(e, starts, ends, 3).select("start", "node", F.array_join("nodes", ">").alias("path"))


def graph_via_paths(spark, d):
    """GRA-1, 3: regions to suppliers via nations, with evidence text."""
    e = _graph(spark, d)
    node = lambda t, k, x: table(spark, d, t).select(F.concat(F.lit(x), k).alias("node"))
    n = node("nation", "n_nationkey", "n")
    p = G.chained([G.trails(e, node("region", "r_regionkey", "r"), n, 2), G.trails(e, n, node("supplier", "s_suppkey", "s"), 2)])
    say = G.evidence(F.transform("nodes", lambda x: F.struct(x.alias("name"), F.concat(F.lit("node "), x).alias("description"))))
    return p.select("start", "node", say.alias("evidence"))


def entity_align(spark, d):
    """RET-14, GRA-4: the best entity of each request, if its score reaches 0.4."""
    e = table(spark, d, "doc_sources").select("source", "title")
    hits = lexical.search(requests(spark, d), e, "source", {"c": lexical.Channel({"title": 1.0})}, 1)
    return hits.filter("score >= 0.4").select("request_id", "source", "score")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))


def anchored_limiter(spark, d):
    """STR-5: two hits in an hour's window that starts at the first."""
    return E.limiter(_hits(spark, d), "user_id", "seconds", "event_id", 2, 3600.0).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("hits"))


def dedupe_delivery(spark, d):
    """STR-6: one delivery in ten minutes for each user."""
    return E.limiter(_hits(spark, d), "user_id", "seconds", "event_id", 1, 600.0).filter("allowed").select("user_id", "event_id")


def guarded_delivery(spark, d):
    """STR-6: as dedupe_delivery, where errors are failed deliveries that release the lock."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return E.guarded(rows.withColumn("failed", F.col("event_type") == "error"), "user_id", "seconds", "event_id", "failed").select("user_id", "event_id")


def hit_islands(spark, d):
    """Runs of hits with pauses under six hours."""
    return E.islands(_hits(spark, d), "user_id", "seconds", 21_600.0).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Stream events of the completed chats: start, slices of 40 signs, done."""
    from voltlake.functions.text import fixed_slices

    c = chats(spark, d).filter("done and answer is not null").select(F.col("chat_id").cast("string").alias("task_id"), fixed_slices(F.col("answer")).alias("p"))
    ev = F.concat(
        F.array(F.struct(F.lit(0).alias("sequence"), F.lit("start").alias("event_type"), F.lit("").alias("content"))),
        F.transform("p", lambda x, i: F.struct((i + 1).alias("sequence"), F.lit("delta").alias("event_type"), x.alias("content"))),
        F.array(F.struct((F.size("p") + 1).alias("sequence"), F.lit("done").alias("event_type"), F.lit("").alias("content"))),
    )
    return c.select("task_id", F.inline(ev))


def stream_assemble(spark, d):
    """STR-1, 2, DOC-28: answers put together again from their slices."""
    return E.assemble(_stream(spark, d)).select("task_id", F.length("content").alias("chars"), F.md5("content").alias("digest"), "state")


def stream_retention(spark, d):
    """STR-4: the last five entries of each task."""
    return E.retained(_stream(spark, d), 5).select("task_id", "sequence", "event_type")


def profile_fold(spark, d):
    """SQL-16, 17: updates and deletes of profile fields, here from events: errors delete the field that clicks set."""
    e = table(spark, d, "events").select(
        "user_id", F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("operation"),
        F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type")).alias("field"), F.get_json_object("props", "$.k").alias("value"),
    )
    return M.profile_fold(e)


def message_validation(spark, d):
    """FLT-15, 16: reasons to reject a queued message."""
    ok = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    why = F.concat_ws("|", F.when(F.coalesce(F.trim("task_id"), F.lit("")) == "", "task_id"), F.when(stripped(F.coalesce("question", F.lit(""))) == "", "question"), F.when(~ok("user_id"), "user_id"), F.when(~ok("session_id"), "session_id"))
    return chats(spark, d).select("chat_id", why.alias("errors")).filter("errors <> ''")


def event_windows(spark, d):
    """Counts and values of events in tumbling windows of a day."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


QUERIES = {f.__name__: f for f in (
    recent_turns, summary_groups, pending_summaries, chat_list, completed_chats, session_names, sessions_of_user, ownership, chat_points, status_fold, history_filter, abstract_search, history_keyword, history_search, memory_vector,
    graph_trails, graph_via_paths, entity_align, anchored_limiter, dedupe_delivery, guarded_delivery, hit_islands, stream_assemble, stream_retention, profile_fold, message_validation, event_windows,
)}

_C = f"WITH {CHATS_SQL}"
_NUM = "row_number() OVER (PARTITION BY user_id, session_id ORDER BY create_time, chat_id)"
_GROUPS = f"g0 AS (SELECT *, {_NUM} AS n FROM c WHERE done AND session_id IS NOT NULL AND create_time IS NOT NULL AND user_id IS NOT NULL), g AS (SELECT user_id, session_id, (n - 1) // 5 AS group_no, '[' || string_agg(chat_id, ',' ORDER BY n) || ']' AS chat_ids FROM g0 GROUP BY 1, 2, 3 HAVING count(*) = 5)"
_BEST = lambda f: f"SELECT request_id, id, max(score) AS score FROM hits WHERE field IN ({f}) GROUP BY 1, 2"
_MAXN = "CASE WHEN max(score) OVER (PARTITION BY request_id) > 0 THEN score / max(score) OVER (PARTITION BY request_id) * {w}::DOUBLE ELSE score END"
_ABS = f"""WITH {MEMORY_SQL}, {REQUESTS_SQL}, ab AS (SELECT * FROM m WHERE memory_type = 'abstract'), {bm25_sql(['query'], docs='ab', key='id')},
 kw AS (SELECT * FROM (SELECT x.request_id, x.id, x.score, row_number() OVER (PARTITION BY x.request_id ORDER BY x.score DESC, x.id) AS r FROM ({_BEST("'query'")}) x JOIN q ON q.request_id = x.request_id JOIN ab ON ab.id = x.id WHERE q.user_id = ab.user_id) WHERE r <= 10),
 qv AS (SELECT DISTINCT try_cast(id AS BIGINT) AS request_id, user_id, list_transform(query_vector, lambda z: coalesce(z, 'nan'::DOUBLE)) AS v FROM memory_history WHERE memory_type = 'chat' AND try_cast(id AS BIGINT) % 20 = 0 AND len(query_vector) = 64),
 av AS (SELECT DISTINCT id, user_id, list_transform(query_vector, lambda z: coalesce(z, 'nan'::DOUBLE)) AS v FROM memory_history WHERE memory_type = 'abstract' AND len(query_vector) = 64),
 kn AS (SELECT request_id, id, (1 + round(list_dot_product(qv.v, av.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(av.v, av.v))), 6)) / 2 AS score FROM qv JOIN av ON qv.user_id = av.user_id
   WHERE list_dot_product(qv.v, qv.v) > 0 AND isfinite(list_dot_product(qv.v, qv.v)) AND list_dot_product(av.v, av.v) > 0 AND isfinite(list_dot_product(av.v, av.v))),
 vc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS r FROM kn) WHERE r <= 10),
 fu AS (SELECT request_id, id, round(sum(s), 6) AS score FROM (SELECT request_id, id, {_MAXN.format(w=0.4)} AS s FROM kw UNION ALL SELECT request_id, id, {_MAXN.format(w=0.6)} AS s FROM vc) GROUP BY 1, 2),
 abs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS rank FROM fu WHERE score > 0.4::DOUBLE) WHERE rank <= 2)"""
_NAMED = f"""{_ABS}, mc AS (SELECT * FROM m WHERE memory_type = 'chat'),
 nm AS (SELECT x.request_id, x.id FROM (SELECT DISTINCT request_id, unnest(chat_ids) AS id FROM abs JOIN m USING (id)) x JOIN q ON q.request_id = x.request_id JOIN mc ON mc.id = x.id WHERE q.user_id = mc.user_id),
 {bm25_sql(['query', 'answer'], docs='mc', key='id', tag='2')},
 kwc AS (SELECT h.request_id, h.id, max(h.score) AS score FROM hits2 h JOIN nm ON nm.request_id = h.request_id AND nm.id = h.id GROUP BY 1, 2)"""
_OWNV = """ov AS (SELECT DISTINCT id, user_id, list_transform(query_vector, lambda z: coalesce(z, 'nan'::DOUBLE)) AS v FROM memory_history WHERE memory_type = 'chat' AND len(query_vector) = 64 AND upper(trim(status, e' \\t\\r\\n')) = 'COMPLETED'),
 vown AS (SELECT qv.request_id, ov.id, max((1 + round(list_dot_product(qv.v, ov.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(ov.v, ov.v))), 6)) / 2) AS score FROM qv JOIN q ON q.request_id = qv.request_id JOIN ov ON ov.user_id = q.user_id
   WHERE list_dot_product(qv.v, qv.v) > 0 AND isfinite(list_dot_product(qv.v, qv.v)) AND list_dot_product(ov.v, ov.v) > 0 AND isfinite(list_dot_product(ov.v, ov.v)) GROUP BY 1, 2)"""
_LIMIT = """WITH RECURSIVE h AS (SELECT event_id, user_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events {where}),
 l AS (SELECT user_id, event_id, i, s AS st, 1 AS n FROM h WHERE i = 1
   UNION ALL SELECT h.user_id, h.event_id, h.i, CASE WHEN h.s - l.st >= {w} THEN h.s ELSE l.st END, CASE WHEN h.s - l.st >= {w} THEN 1 ELSE l.n + 1 END FROM l JOIN h ON h.user_id = l.user_id AND h.i = l.i + 1)"""

SQL = {
    "recent_turns": f"{_C}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY create_time DESC NULLS LAST, chat_id DESC) AS b FROM c WHERE session_id IS NOT NULL), k AS (SELECT session_id, chat_id, row_number() OVER (PARTITION BY session_id ORDER BY b) AS pos FROM l WHERE b <= 20 AND done) SELECT * FROM k WHERE pos <= 3",
    "summary_groups": f"{_C}, {_GROUPS} SELECT * FROM g",
    "pending_summaries": f"{_C}, {_GROUPS}, {MEMORY_SQL} SELECT user_id, session_id, chat_ids FROM g WHERE chat_ids NOT IN (SELECT '[' || array_to_string(chat_ids, ',') || ']' FROM m WHERE memory_type = 'abstract' AND chat_ids IS NOT NULL)",
    "chat_list": f"{_C} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY create_time, chat_id) AS n, chat_id FROM c WHERE session_id IS NOT NULL AND create_time IS NOT NULL",
    "completed_chats": f"{_C} SELECT user_id, session_id, chat_id, length(answer) AS chars FROM c WHERE done AND answer <> ''",
    "session_names": rf"{_C} SELECT chat_id, substring(regexp_replace(regexp_extract(coalesce(question, ''), '^[\s\x{{3000}}]*([^？?；;。！!\r\n]*)', 1), '^[ \t\r\n\x{{3000}}]+|[ \t\r\n\x{{3000}}]+$', '', 'g'), 1, 30) AS name FROM c",
    "sessions_of_user": "WITH s AS (SELECT session_id, max(user_id) AS user_id, max(session_name) AS session_name, max(create_time) AS create_time, max(update_time) AS update_time FROM llm_session_table WHERE session_id IS NOT NULL GROUP BY 1) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY update_time DESC NULLS LAST, create_time DESC NULLS LAST, session_id DESC) AS pos, session_id, session_name FROM s",
    "ownership": f"{_C}, s AS (SELECT session_id, max(user_id) AS owner FROM llm_session_table WHERE session_id IS NOT NULL GROUP BY 1) SELECT chat_id, CASE WHEN owner IS NULL THEN 'missing' WHEN owner <> c.user_id THEN 'other' ELSE 'own' END AS state FROM c LEFT JOIN s ON s.session_id = c.session_id",
    "chat_points": f"{_C} SELECT user_id, task_id, max(chat_id) AS chat_id FROM c WHERE task_id IS NOT NULL GROUP BY 1, 2",
    "status_fold": r"WITH r AS (SELECT DISTINCT task_id, update_time, status FROM llm_chat_table WHERE task_id IS NOT NULL), x AS (SELECT task_id, update_time, upper(regexp_replace(status, '[ \t\r\n]', '', 'g')) AS s FROM r), y AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY update_time DESC NULLS LAST, s DESC NULLS LAST) AS rn FROM x) "
    "SELECT task_id, CASE WHEN bool_or(coalesce(s = 'COMPLETED', false)) THEN 'COMPLETED' ELSE max(s) FILTER (rn = 1) END AS status, count(*) FILTER (s = 'FAILED') AS failures, count(*) AS states FROM y GROUP BY 1",
    "history_filter": f"{_C}, x AS (SELECT coalesce(upper(trim(status)), 'FAILED') AS status FROM c) SELECT status, count(*) AS n FROM x WHERE status NOT IN ('FAILED', 'GENERATING') GROUP BY 1",
    "abstract_search": f"{_ABS} SELECT request_id, id, score, rank FROM abs",
    "history_keyword": f"""{_NAMED} SELECT x.request_id, x.id, x.score FROM kwc x""",
    "history_search": f"""{_NAMED}, {_OWNV},
 kt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS r FROM kwc) WHERE r <= 3),
 vt AS (SELECT * FROM (SELECT v.request_id, v.id, v.score, row_number() OVER (PARTITION BY v.request_id ORDER BY v.score DESC, v.id) AS r FROM vown v JOIN nm ON nm.request_id = v.request_id AND nm.id = v.id) WHERE r <= 3),
 fs AS (SELECT request_id, id, round(sum(s), 6) AS score FROM (SELECT request_id, id, {_MAXN.format(w=0.4)} AS s FROM kt UNION ALL SELECT request_id, id, {_MAXN.format(w=0.6)} AS s FROM vt) GROUP BY 1, 2)
 SELECT * FROM fs WHERE score > 0.4::DOUBLE""",
    "memory_vector": f"""WITH {REQUESTS_SQL}, qv AS (SELECT DISTINCT try_cast(id AS BIGINT) AS request_id, list_transform(query_vector, lambda z: coalesce(z, 'nan'::DOUBLE)) AS v FROM memory_history WHERE memory_type = 'chat' AND try_cast(id AS BIGINT) % 20 = 0 AND len(query_vector) = 64), {_OWNV},
 vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS rank FROM vown) WHERE rank <= 3) SELECT request_id, id, round({_MAXN.format(w=0.6)}, 6) AS score, rank FROM vt""",
    "graph_trails": "SELECT 'r' || n_regionkey AS start, 'c' || c_custkey AS node, 'r' || n_regionkey || '>n' || n_nationkey || '>c' || c_custkey AS path FROM nation JOIN customer ON c_nationkey = n_nationkey",
    "graph_via_paths": "SELECT 'r' || n_regionkey AS start, 's' || s_suppkey AS node, '首先，r' || n_regionkey || ':node r' || n_regionkey || ',其次，n' || n_nationkey || ':node n' || n_nationkey || ',最后，s' || s_suppkey || ':node s' || s_suppkey AS evidence FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    "entity_align": f"WITH {REQUESTS_SQL}, {bm25_sql(['title'], docs='doc_sources', key='source')} SELECT request_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, source) AS r FROM hits) WHERE r = 1 AND score >= 0.4::DOUBLE",
    "anchored_limiter": _LIMIT.format(w=3_600_000_000, where="") + " SELECT user_id, count(*) FILTER (n <= 2) AS allowed, count(*) AS hits FROM l GROUP BY 1",
    "dedupe_delivery": _LIMIT.format(w=600_000_000, where="") + " SELECT user_id, event_id FROM l WHERE n = 1",
    "guarded_delivery": _LIMIT.format(w=600_000_000, where="WHERE event_type IS DISTINCT FROM 'error'") + ", g AS (SELECT user_id, event_id FROM l WHERE n = 1), k AS (SELECT g.*, epoch_us(e.ts) AS s FROM g JOIN events e ON e.event_id = g.event_id)"
    " SELECT user_id, event_id FROM g UNION ALL SELECT user_id, event_id FROM events e WHERE event_type = 'error' AND user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = e.user_id AND (k.s, k.event_id) < (epoch_us(e.ts), e.event_id) AND epoch_us(e.ts) - k.s < 600000000)",
    "hit_islands": "WITH h AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, event_id FROM events), x AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) < 21600 THEN 0 ELSE 1 END AS b FROM h), y AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS island FROM x) SELECT user_id, island, count(*) AS n FROM y GROUP BY 1, 2",
    "stream_assemble": f"{_C} SELECT CAST(chat_id AS VARCHAR) AS task_id, length(answer) AS chars, md5(answer) AS digest, 'done' AS state FROM c WHERE done AND answer IS NOT NULL",
    "stream_retention": f"{_C}, n AS (SELECT CAST(chat_id AS VARCHAR) AS task_id, CAST(ceil(length(answer) / 40.0) AS INTEGER) AS k FROM c WHERE done AND answer IS NOT NULL), e AS (SELECT task_id, k, unnest(range(0, k + 2)) AS sequence FROM n) SELECT task_id, sequence, CASE WHEN sequence = 0 THEN 'start' WHEN sequence = k + 1 THEN 'done' ELSE 'delta' END AS event_type FROM e WHERE sequence > k - 4",
    "profile_fold": "WITH o AS (SELECT user_id, ts, event_id, event_type = 'error' AS del, CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END AS field, props->>'$.k' AS value FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY ts DESC, event_id DESC) AS r FROM o) SELECT user_id, field, value FROM l WHERE r = 1 AND NOT del",
    "message_validation": rf"{_C}, x AS (SELECT chat_id, concat_ws('|', CASE WHEN coalesce(trim(task_id), '') = '' THEN 'task_id' END, CASE WHEN regexp_replace(coalesce(question, ''), '[ \t\r\n\x{{3000}}]+', '', 'g') = '' THEN 'question' END, CASE WHEN NOT coalesce(user_id > 0, false) THEN 'user_id' END, CASE WHEN NOT coalesce(session_id > 0, false) THEN 'session_id' END) AS errors FROM c) SELECT * FROM x WHERE errors <> ''",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
