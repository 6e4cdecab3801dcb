"""Queries over hits, profiles, answers, charts and samples as records."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.text import han_count, parts
from voltlake.operators import fusion
from voltlake.operators import graph as G
from voltlake.operators import quality as Q
from voltlake.operators import records as R
from voltlake.plans.base import CHATS_SQL, CHUNKS_SQL, REQUESTS_SQL, chats, chunk_texts, requests
from voltlake.plans.quality import AN_SQL, COVERAGE_SQL, FORM_SQL, HAN_SQL, REL_SQL, SAMPLES_SQL, SIGNALS_SQL, answers, samples
from voltlake.plans.retrieval import SUBS_SQL
from voltlake.session import table

FIELDS = ["click", "view", "purchase"]


def hit_projection(spark, d):
    """FLT-4"""
    h = table(spark, d, "chunks").select(F.when(F.col("chunk_index") % 7 != 0, F.col("chunk_id")).alias("chunk_id"), F.concat(F.lit("store-"), "chunk_index").alias("_id"), "section_title")
    return R.projected_hits(h, "chunk_id", "_id", {"section_title": ""}).distinct()


def hit_flatten(spark, d):
    """FLT-5: hits of a title as a map, flattened again."""
    c = chunk_texts(spark, d).filter("title is not null and chunk_index < 50")
    m = c.groupBy("title").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", F.struct("chunk_index", "chapter_title")))).alias("hits"))  # at most 50 a title
    return R.flattened(m, "hits", "chunk_id").select("title", "chunk_id", "chunk_index", "chapter_title")


def _fields(spark, d):
    e = table(spark, d, "events").filter("user_id is not null")
    last = e.groupBy("user_id", "event_type").agg(F.max_by(F.get_json_object("props", "$.k"), F.struct("ts", "event_id")).alias("value"))
    return last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("fields"))  # a few fields a user


def profile_illegal(spark, d):
    """SET-3: fields of profiles that are not allowed."""
    return _fields(spark, d).select("user_id", F.array_join(R.illegal_fields(F.col("fields"), FIELDS), ",").alias("illegal")).filter("illegal <> ''")


def profile_allowed(spark, d):
    """FLT-13, SQL-15: profiles without other fields, blanks and nulls."""
    m = R.present(R.allowed_fields(F.col("fields"), FIELDS))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return _fields(spark, d).select("user_id", text.alias("profile"))


def profile_top_field(spark, d):
    """Argmax over a map: the field with the greatest value."""
    m = F.transform_values("fields", lambda k, v: v.try_cast("double"))
    return _fields(spark, d).select("user_id", R.map_argmax(R.present(m)).alias("field"))


def session_name_counts(spark, d):
    """AGG-1: sessions by name, each counted once."""
    s = table(spark, d, "llm_session_table").filter("session_id is not null").groupBy("session_id").agg(F.max("session_name").alias("session_name"))
    return s.groupBy("session_name").agg(F.count(F.lit(1)).alias("n"))


def first_pairs(spark, d):
    """SET-5: distinct pairs of question and answer, by their first chat."""
    p = R.first_of_pairs(chats(spark, d).filter("question is not null and answer is not null").select("chat_id", "question", "answer"), ["question", "answer"], "chat_id")
    return p.select("chat_id", F.md5("question").alias("question"))


def device_topk(spark, d):
    """FUS-20"""
    return table(spark, d, "part").select("p_partkey", R.clamped(F.col("p_size") - 20).alias("k"))


def skill_routes(spark, d):
    """UDF-4"""
    return chats(spark, d).select("chat_id", R.skill_of(F.when(F.col("chat_id") % 3 == 0, " Plot ").when(F.col("chat_id") % 3 == 1, F.col("status"))).alias("skill"))


def assembled_answers(spark, d):
    """FUS-19: chats of a session as sub-tasks; every fifth is a plot's JSON, failed ones give their error."""
    c = chats(spark, d).filter("session_id is not null and chat_id % 4 = 0")
    plot = F.col("chat_id") % 20 == 0
    rows = c.select(
        F.col("session_id").alias("request_id"), F.col("chat_id").alias("task_no"), F.when(F.col("chat_id") % 8 == 0, F.col("question")).alias("question"), F.when(plot, "plot").otherwise("chat").alias("skill"),
        F.when(plot, F.concat(F.lit('{"answer": "chart '), "chat_id", F.lit('", "artifacts": []}'))).otherwise(F.col("answer")).alias("answer"), F.col("error_message").alias("error"),
    )
    return R.assembled_answers(rows).select("request_id", F.md5("answer").alias("digest"))


def chart_checks(spark, d):
    """FLT-17: charts of monthly sums; some are made wrong."""
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = l.groupBy("p_brand", F.year("l_shipdate").alias("y")).agg(F.array_sort(F.collect_set(F.month("l_shipdate").cast("string"))).alias("xs"))
    kind = F.when(F.col("y") % 4 == 0, "LINE ").when(F.col("y") % 4 == 1, "pie").when(F.col("y") % 4 == 2, "table").otherwise("radar")
    ys = F.when(F.col("y") % 8 == 5, F.transform("xs", lambda x: F.concat(F.lit("-"), x))).when(F.col("y") % 8 == 4, F.slice("xs", 1, 1)).otherwise(F.col("xs"))
    return g.select("p_brand", "y", F.coalesce(R.chart_error(kind, F.col("xs"), ys), F.lit("ok")).alias("state"))


def plot_points(spark, d):
    """FUS-13, FLT-3, 10: series with points, normalised and flattened; a series without points is skipped."""
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = l.groupBy("p_brand", "l_returnflag", F.date_format("l_shipdate", "yyyy").alias("x")).agg(F.round(F.sum("l_quantity"), 4).alias("value"))
    blank = F.when(F.col("x") == "1995", " ").otherwise(F.col("x"))
    s = p.groupBy("p_brand", "l_returnflag").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("label"), blank.alias("x"), "value")).alias("points"))  # a few years a series
    none = F.lit(None).cast("string")
    series = F.struct(none.alias("topic"), F.concat(F.lit(" "), "p_brand").alias("entity"), F.lit("quantity").alias("metric"), F.lit("year").alias("dimension"), none.alias("dimension_unit"), F.lit(" pcs ").alias("value_unit"),
                      F.array(F.lit(" "), F.lit("a")).alias("conditions"), "points")
    return R.flat_points(s.select(R.normalised_series(series).alias("series")))


def exact_metrics(spark, d):
    """FUS-12: for each query vector and label the metric of the wanted name, else the nearest."""
    from voltlake.operators.knn import exact_knn

    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label").filter("vec_id is not null and label is not null")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    labels = sorted(r.label for r in e.select("label").distinct().collect())  # a fixed set of few
    asked = q.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels] or [F.lit(0)]))).select(F.concat_ws(":", "query_id", "label").alias("qk"), "qv", "label")
    near = exact_knn(asked, e, "qk", "qv", "vec_id", "embedding", 1, group="label").select(F.split("qk", ":")[0].cast("bigint").alias("query_id"), F.split("qk", ":")[1].cast("int").alias("doc"), F.col("vec_id").cast("bigint").alias("pos"), "cosine")
    wanted = q.select("query_id", (F.col("query_id") + 1).alias("pos")).join(e.select(F.col("vec_id").alias("pos"), F.col("label").alias("doc")), "pos").select("query_id", "doc", "pos", F.lit(None).cast("double").alias("cosine"))
    both = near.unionByName(wanted).select("query_id", "doc", "pos", "cosine", F.concat(F.lit("M"), "pos").alias("name"), F.concat(F.lit(" m"), F.col("query_id") + 1).alias("wanted"))
    return R.picked_metrics(both).select("query_id", "doc", "pos", "exact")


def parsed_blocks(spark, d):
    """EVL-18: the source blocks of the samples' user messages."""
    p = samples(spark, d).filter("user is not null").select("sample_id", R.parsed_user(F.col("user")).alias("p")).filter("p is not null")
    x = p.select("sample_id", F.posexplode("p.blocks").alias("pos", "b"))
    return x.select("sample_id", "pos", "b.document_title", "b.chunk_id", F.md5("b.text").alias("digest"))


def quality_records(spark, d):
    """EVL-15: the whole evaluation record of an answer."""
    q, a = F.col("query"), F.coalesce("answer", F.lit(""))
    required, covered = Q.requirement_counts(q, F.col("answer"))
    x = answers(spark, d).select(
        "request_id", F.coalesce(fusion.jaccard(q, F.col("answer")), F.lit(0.0)).alias("relevance"), required.alias("required"), covered.alias("covered"), Q.coverage(q, F.col("answer")).alias("coverage"),
        Q.form_quality(F.col("answer"), required).alias("form"), F.length(a).alias("chars"), han_count(a).alias("han"), F.size(parts(a, "[。！？!?；;\n]+")).alias("sentences"), Q.hits(a, Q.REFUSAL_SIGNALS).alias("signals"),
    )
    x = x.withColumn("score", Q.overall(F.col("relevance"), F.col("coverage"), F.col("form")))
    return x.withColumn("level", Q.level(F.col("score")))


def entity_lists(spark, d):
    """GRA-5: entity lists, cleaned; two at least."""
    rows = table(spark, d, "training_sample").select("request_id", "used_sources").distinct()
    return rows.select("request_id", F.array_join(G.entities(F.col("used_sources")), "|").alias("entities")).filter("entities is not null")


def gathered_subqueries(spark, d):
    """STR-11: sub-queries fanned out and gathered again in order."""
    s = fusion.split_query(requests(spark, d), extra="，,")
    g = s.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("sub_no", "sub_query"))).alias("a"))  # at most five
    return g.select("request_id", F.array_join(F.transform("a", lambda x: x["sub_query"]), " / ").alias("joined"))


def zone_times(spark, d):
    """Milliseconds since the epoch of local times in a fixed zone."""
    return chats(spark, d).filter("create_time is not null").select("chat_id", R.zone_millis(F.col("create_time")).alias("millis"))


def routed_paths(spark, d):
    """GRA-1, 4: start, via and end of aligned entities, weak ones dropped; all trails of each route."""
    name = lambda x, k: F.concat(F.lit(x), F.col(k).cast("string"))
    n = table(spark, d, "nation")
    e = n.select(name("rn", "n_nationkey").alias("edge_id"), name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    s = table(spark, d, "supplier")
    e = e.unionByName(s.select(name("ns", "s_suppkey").alias("edge_id"), name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst")))
    e = e.unionByName(s.filter("s_suppkey % 3 = 0").select(name("sr", "s_suppkey").alias("edge_id"), name("s", "s_suppkey").alias("src"), F.lit("r0").alias("dst")))  # some lead back: cycles
    hit = lambda node, score: F.struct(node.alias("node"), score.alias("score"))
    asked = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("request_id"), F.array(hit(name("r", "n_regionkey"), F.lit(0.9)), hit(name("n", "n_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, 0.7).otherwise(0.1)), hit(name("s", "s_suppkey"), F.when(F.col("s_suppkey") % 5 == 0, 0.2).otherwise(0.8))).alias("hits")
    )
    r = G.routed(e, asked.select("request_id", G.route(F.col("hits")).alias("stops")), 2)
    return r.groupBy("request_id").agg(F.count(F.lit(1)).alias("trails"), F.min(F.array_join("nodes", ">")).alias("first"))


QUERIES = {f.__name__: f for f in (
    hit_projection, hit_flatten, profile_illegal, profile_allowed, profile_top_field, session_name_counts, first_pairs, device_topk, skill_routes, assembled_answers, chart_checks, plot_points,
    exact_metrics, parsed_blocks, quality_records, entity_lists, gathered_subqueries, zone_times, routed_paths,
)}

_FIELDS = "f AS (SELECT user_id, event_type AS field, arg_max(props->>'$.k', (ts, event_id)) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2)"
_ALLOWED = ", ".join(f"'{x}'" for x in FIELDS)
_STRIP = r"regexp_replace({t}, '^[ \t\r\n\x{{3000}}]+|[ \t\r\n\x{{3000}}]+$', '', 'g')"
_BLOCK_TEXT = r"regexp_replace(t, '(?m)^(?:document_title|chunk_id):.*(?:\n|\z)', '', 'g')"
SQL = {
    "hit_projection": f"WITH x AS (SELECT coalesce(nullif({_STRIP.format(t='CASE WHEN chunk_index % 7 <> 0 THEN chunk_id END')}, ''), 'store-' || chunk_index) AS chunk_id, coalesce(section_title, '') AS section_title FROM chunks) SELECT DISTINCT * FROM x WHERE chunk_id IS NOT NULL",
    "hit_flatten": f"WITH {CHUNKS_SQL} SELECT title, chunk_id, chunk_index, chapter_title FROM d WHERE title IS NOT NULL AND chunk_index < 50",
    "profile_illegal": f"WITH {_FIELDS} SELECT user_id, string_agg(field, ',' ORDER BY field) AS illegal FROM f WHERE field NOT IN ({_ALLOWED}) GROUP BY 1",
    "profile_allowed": f"WITH {_FIELDS} SELECT user_id, coalesce(string_agg(field || '=' || value, ',' ORDER BY field) FILTER (field IN ({_ALLOWED}) AND trim(coalesce(value, '')) <> ''), '') AS profile FROM f GROUP BY 1",
    "profile_top_field": f"WITH {_FIELDS} SELECT user_id, arg_min(field, (-try_cast(value AS DOUBLE), field)) FILTER (try_cast(value AS DOUBLE) IS NOT NULL) AS field FROM f GROUP BY 1",
    "session_name_counts": "SELECT session_name, count(*) AS n FROM (SELECT session_id, max(session_name) AS session_name FROM llm_session_table WHERE session_id IS NOT NULL GROUP BY 1) GROUP BY 1",
    "first_pairs": f"WITH {CHATS_SQL} SELECT min(chat_id) AS chat_id, md5(question) AS question FROM c WHERE question IS NOT NULL AND answer IS NOT NULL GROUP BY c.question, c.answer",
    "device_topk": "SELECT p_partkey, greatest(1, least(p_size - 20, 10)) AS k FROM part",
    "skill_routes": f"WITH {CHATS_SQL}, x AS (SELECT chat_id, lower(trim(coalesce(CASE WHEN chat_id % 3 = 0 THEN ' Plot ' WHEN chat_id % 3 = 1 THEN status END, ''))) AS s FROM c) SELECT chat_id, CASE WHEN s IN ('rag', 'light-rag', 'plot', 'chat') THEN s ELSE 'chat' END AS skill FROM x",
    "assembled_answers": f"""WITH {CHATS_SQL}, x AS (SELECT session_id, chat_id, CASE WHEN chat_id % 8 = 0 THEN trim(coalesce(question, ''), ' ') ELSE '' END AS q, CASE WHEN chat_id % 20 = 0 THEN 'chart ' || chat_id ELSE trim(coalesce(answer, ''), ' ') END AS t, trim(coalesce(error_message, ''), ' ') AS e FROM c WHERE session_id IS NOT NULL AND chat_id % 4 = 0),
 y AS (SELECT *, CASE WHEN t = '' AND e <> '' THEN '子任务执行失败：' || e ELSE t END AS u FROM x) SELECT session_id AS request_id, md5(string_agg(CASE WHEN q <> '' THEN chat_id || '. ' || q || chr(10) || u ELSE u END, chr(10) || chr(10) ORDER BY chat_id)) AS digest FROM y WHERE u <> '' GROUP BY 1""",
    "chart_checks": "WITH g AS (SELECT p_brand, year(l_shipdate)::INTEGER AS y, count(DISTINCT month(l_shipdate)) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT p_brand, y, CASE WHEN y % 4 = 3 THEN 'kind' WHEN y % 8 = 4 AND n > 1 THEN 'lengths' WHEN y % 8 = 5 THEN 'negative' ELSE 'ok' END AS state FROM g",
    "plot_points": "SELECT p_brand AS equipment, l_returnflag AS label, 'year' AS dimension, round(sum(l_quantity), 4) AS value, 'pcs' AS value_unit, strftime(l_shipdate, '%Y') AS x FROM lineitem JOIN part ON p_partkey = l_partkey WHERE strftime(l_shipdate, '%Y') <> '1995' GROUP BY p_brand, l_returnflag, strftime(l_shipdate, '%Y')",
    "exact_metrics": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL), p AS (SELECT q.vec_id AS query_id, e.label AS doc, e.vec_id AS pos, e.vec_id = q.vec_id + 1 AS exact, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS c FROM e q, e WHERE q.vec_id % 20 = 0)
 SELECT query_id, doc, pos, exact FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY exact DESC, c DESC, CAST(pos AS VARCHAR)) AS r FROM p) WHERE r = 1""",
    "parsed_blocks": rf"""WITH {SAMPLES_SQL}, x AS (SELECT sample_id, string_split("user", '【问题】') AS l FROM s WHERE contains("user", '【问题】')),
 h AS (SELECT sample_id, {_STRIP.format(t="replace(array_to_string(l[:len(l) - 1], '【问题】'), '【检索资料】', '')")} AS head FROM x WHERE {_STRIP.format(t='l[-1]')} <> ''),
 b AS (SELECT sample_id, head, list_filter(list_transform(string_split_regex(head, '(?:^|\n)\s*\[source_\d+\]\s*')[2:], lambda t: {{'d': trim(regexp_extract(t, '(?m)^document_title:[ \t]*(.*?)[ \t]*$', 1)), 'c': trim(regexp_extract(t, '(?m)^chunk_id:[ \t]*(.*?)[ \t]*$', 1)),
   't': {_STRIP.format(t=_BLOCK_TEXT)}}}), lambda z: z.t <> '') AS bl FROM h),
 w AS (SELECT sample_id, CASE WHEN len(bl) = 0 AND head <> '' THEN [{{'d': '', 'c': '', 't': head}}] ELSE bl END AS bl FROM b)
 SELECT sample_id, i - 1 AS pos, z.d AS document_title, z.c AS chunk_id, md5(z.t) AS digest FROM (SELECT sample_id, unnest(bl) AS z, generate_subscripts(bl, 1) AS i FROM w)""",
    "quality_records": f"""WITH {AN_SQL}, o AS (SELECT request_id, {REL_SQL} AS relevance, {COVERAGE_SQL[0]} AS required, {COVERAGE_SQL[1]} AS covered, {COVERAGE_SQL[2]} AS coverage, {FORM_SQL} AS form, length(coalesce(answer, '')) AS chars, {HAN_SQL} AS han,
   len(list_filter(list_transform(string_split_regex(coalesce(answer, ''), '[。！？!?；;\\n]+'), lambda s: regexp_replace(s, '^[ \\t\\r\\n\\x{{3000}}]+|[ \\t\\r\\n\\x{{3000}}]+$', '', 'g')), lambda s: s <> '')) AS sentences, {SIGNALS_SQL} AS signals FROM an),
 z AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN coverage IS NULL THEN 0.65::DOUBLE * relevance + 0.35::DOUBLE * form ELSE 0.35::DOUBLE * relevance + 0.45::DOUBLE * coverage + 0.20::DOUBLE * form END)), 6) AS score FROM o)
 SELECT *, CASE WHEN score >= 0.85::DOUBLE THEN 'excellent' WHEN score >= 0.70::DOUBLE THEN 'good' WHEN score >= 0.55::DOUBLE THEN 'needs_improvement' ELSE 'poor' END AS level FROM z""",
    "entity_lists": f"WITH r AS (SELECT DISTINCT request_id, used_sources FROM training_sample), x AS (SELECT row_number() OVER () AS k, request_id, used_sources AS l FROM r), u AS (SELECT k, request_id, {_STRIP.format(t='unnest(l)')} AS s, generate_subscripts(l, 1) AS i FROM x), f AS (SELECT k, request_id, s, min(i) AS i FROM u WHERE s <> '' GROUP BY 1, 2, 3) SELECT request_id, string_agg(s, '|' ORDER BY i) AS entities FROM f GROUP BY k, request_id HAVING count(*) >= 2",
    "zone_times": f"WITH {CHATS_SQL} SELECT chat_id, epoch_ms(create_time) - 28800000 AS millis FROM c WHERE create_time IS NOT NULL",
    "routed_paths": """WITH s AS (SELECT s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0)
 SELECT s_suppkey AS request_id, 1 AS trails, 'r' || n_regionkey || '>n' || n_nationkey || '>s' || s_suppkey AS first FROM s""",
}
SQL["gathered_subqueries"] = f"WITH {REQUESTS_SQL}, {SUBS_SQL} SELECT request_id, string_agg(sub_query, ' / ' ORDER BY sub_no) AS joined FROM subs GROUP BY 1"
