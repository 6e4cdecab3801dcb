"""Answer quality, evaluation metrics and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions.text import han_count, parts, similarity_form, stripped
from voltlake.operators import fusion
from voltlake.operators import quality as Q
from voltlake.plans.base import CHATS_SQL, chats, toks
from voltlake.session import table


def answers(spark: SparkSession, d: str) -> DataFrame:
    """One row a request: query, answer, sufficient."""
    return table(spark, d, "training_sample").groupBy("request_id").agg(*[F.max(c).alias(c) for c in ("query", "answer", "content_sufficient", "difficulty", "question_type")])


def _a():
    return F.col("answer")


def _q():
    return F.col("query")


def _s():
    return F.col("content_sufficient")



def _one(name, column):
    def query(spark, d):
        return answers(spark, d).select("request_id", F.round(column(), 6).alias("score"))

    query.__name__ = name
    return query


basic_quality = _one("basic_quality", lambda: Q.basic_quality(_a()))
meta_penalty = _one("meta_penalty", lambda: Q.meta_penalty(_a()))
repetition_penalty = _one("repetition_penalty", lambda: Q.repetition_penalty(_a()))
completion_reward = _one("completion_reward", lambda: Q.completion_reward(_a()))
refusal_consistency = _one("refusal_consistency", lambda: Q.refusal_consistency(_a(), _s()))
requirement_coverage = _one("requirement_coverage", lambda: Q.coverage(_q(), _a()))
form_quality = _one("form_quality", lambda: Q.form_quality(_a(), Q.requirement_counts(_q(), _a())[0]))
copy_penalty = _one("copy_penalty", lambda: Q.query_copy_penalty(_q(), _a()))


def relevance():
    return F.coalesce(fusion.jaccard(_q(), _a()), F.lit(0.0))


def combined_reward(spark, d):
    """The six rules of EVL-9 that SQL can state, with the token scorer in place of the model. full_reward has all eight."""
    rewards = [Q.basic_quality(_a()), Q.meta_penalty(_a()), Q.repetition_penalty(_a()), Q.completion_reward(_a()), Q.refusal_consistency(_a(), _s()), relevance()]
    return answers(spark, d).select("request_id", Q.combined(rewards).alias("score"))


def training_reward(spark, d):
    """EVL-10: all eight rules over samples with their shares. Rows only."""
    return grounded(samples(spark, d)).select("sample_id", Q.weighted(_eight()).alias("score"))


def full_reward(spark, d):
    """EVL-9: all eight rules over samples, whose retrieved material gives the contexts. Rows only."""
    return grounded(samples(spark, d)).select("sample_id", Q.combined(_eight()).alias("score"))


def _eight():
    return [Q.basic_quality(_a()), Q.meta_penalty(_a()), Q.repetition_penalty(_a()), Q.completion_reward(_a()), Q.refusal_consistency(_a(), _s()), relevance(), Q.query_copy_penalty(_q(), _a()), Q.grounding(_a(), _s(), F.col("copied"), F.col("related"))]


def grounded(rows: DataFrame) -> DataFrame:
    """sample_id, query, answer, content_sufficient, and over the contexts of each sample the least copy penalty and the greatest relevance (EVL-7, 8)."""
    p = F.split(F.coalesce("user", F.lit("")), "【问题】")
    blocks = F.split(F.array_join(F.slice(p, 1, F.size(p) - 1), "【问题】"), r"\[source_\d+\]")
    bare = F.transform(F.slice(blocks, 2, 1_000_000), lambda x: stripped(F.regexp_replace(x, r"(?m)^(?:document_title|chunk_id):.*$", "")))
    own = ["sample_id", "query", "answer", "content_sufficient"]
    x = rows.select("sample_id", stripped(F.element_at(p, -1)).alias("query"), F.coalesce("assistant", F.lit("")).alias("answer"), F.col("context_sufficiency").alias("content_sufficient"), F.filter(bare, lambda x: x != "").alias("contexts"))
    x = x.select(*own, F.explode_outer("contexts").alias("context"))
    there = F.col("context").isNotNull()
    x = x.select(*own, F.when(there, Q.context_copy_penalty(F.col("context"), _a())).alias("copied"), F.when(there, F.coalesce(fusion.jaccard(F.col("context"), _a()), F.lit(0.0))).alias("related"))
    return x.groupBy(*own).agg(F.min("copied").alias("copied"), F.max("related").alias("related"))


def overall_quality(spark, d):
    form = Q.form_quality(_a(), Q.requirement_counts(_q(), _a())[0])
    out = answers(spark, d).select("request_id", Q.overall(relevance(), Q.coverage(_q(), _a()), form).alias("score"))
    return out.withColumn("level", Q.level(F.col("score")))


def diagnostics(spark, d):
    """EVL-13"""
    a = F.coalesce(_a(), F.lit(""))
    return answers(spark, d).select(
        "request_id", F.length(a).alias("chars"), han_count(a).alias("han"), F.size(parts(a, "[。！？!?；;\n]+")).alias("sentences"), Q.hits(a, Q.REFUSAL_SIGNALS).alias("signals")
    )


def similarity_forms(spark, d):
    """EVL-16"""
    return answers(spark, d).select("request_id", similarity_form(F.coalesce(_a(), F.lit(""))).alias("form"))


def memory_need(spark, d):
    """EVL-17"""
    return chats(spark, d).select("chat_id", Q.needs_memory(F.col("question")).alias("needs"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    one = lambda role: F.try_element_at(F.filter("messages", lambda x: x["role"] == role), F.lit(1))["content"]
    rows = table(spark, d, "samples").select(
        m["sample_id"].alias("sample_id"), m["dataset_split"].alias("dataset_split"), m["context_sufficiency"].alias("context_sufficiency"), m["difficulty"].alias("difficulty"), m["question_type"].alias("question_type"),
        F.size(F.coalesce(m["chunk_ids"], F.array())).alias("n_chunks"), F.array_join(F.transform("messages", lambda x: F.coalesce(x["role"], F.lit("?"))), ",").alias("roles"), one("user").alias("user"), one("assistant").alias("assistant"),
    )
    return rows.distinct()


def split_counts(spark, d):
    """AGG-2"""
    s = F.lower(F.trim(F.regexp_replace("dataset_split", r"[\t\r\n]", "")))
    return samples(spark, d).groupBy(s.alias("split"), "difficulty", "question_type").agg(F.count(F.lit(1)).alias("n"))


def context_counts(spark, d):
    """AGG-3"""
    return samples(spark, d).groupBy("question_type").agg(F.min("n_chunks").alias("least"), F.max("n_chunks").alias("most"), F.count(F.lit(1)).alias("n"))


def index_split(spark, d):
    """WIN-10: idx % 10 is 9 for validation, 0 for test, else train."""
    i = F.pmod("request_id", F.lit(10))
    return answers(spark, d).select("request_id", F.when(i == 9, "validation").when(i == 0, "test").otherwise("train").alias("split"))


def sft_filter(spark, d):
    """FLT-11: kept are samples whose context is sufficient and that have chunks."""
    kept = F.coalesce(F.col("context_sufficiency"), F.lit(False)) & (F.col("n_chunks") > 0)
    return samples(spark, d).groupBy(F.when(kept, "kept").otherwise("skipped").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def sample_errors(spark, d):
    """FLT-12, SRC-7: structure of the samples."""
    bad = F.lower(F.trim("dataset_split")).isin("train", "validation", "test")
    e = F.concat_ws(
        "|", F.when(F.coalesce(F.col("roles"), F.lit("")) != "system,user,assistant", "roles"), F.when(F.trim(F.coalesce("user", F.lit(""))) == "", "user"), F.when(F.trim(F.coalesce("assistant", F.lit(""))) == "", "assistant"),
        F.when(~F.coalesce(bad, F.lit(False)), "split"),
    )
    return samples(spark, d).select("sample_id", e.alias("errors")).filter("errors <> ''")


def parsed_user(spark, d):
    """EVL-18: the question after the last mark and the number of source blocks."""
    q = F.trim(F.element_at(F.split("user", "【问题】"), -1))
    return samples(spark, d).filter("user is not null").select("sample_id", q.alias("question"), F.size(F.regexp_extract_all("user", F.lit(r"\[source_[0-9]+\]"), F.lit(0))).alias("sources"))


def _gold(spark, d):
    """Expected: the label; predicted: no refusal phrase in the answer."""
    return answers(spark, d).select("request_id", _s().alias("expected"), (~Q.any_of(F.coalesce(_a(), F.lit("")), Q.REFUSAL_SIGNALS)).alias("predicted"))


def binary_metrics(spark, d):
    """AGG-4: missing values are no hit; a share of nothing is 0."""
    e, p = F.coalesce("expected", F.lit(False)), F.coalesce("predicted", F.lit(False))
    c = _gold(spark, d).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(F.col("expected") == F.col("predicted")).alias("same"), F.count(F.lit(1)).alias("n"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    prec, rec = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", F.round(share(F.col("same"), F.col("n")), 6).alias("accuracy"), F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(share(2 * prec * rec, prec + rec), 6).alias("f1"))


def eval_summary(spark, d):
    """AGG-5: rates for each kind of question."""
    g = _gold(spark, d).join(answers(spark, d).select("request_id", "question_type"), "request_id")
    exact = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)).cast("double")
    return g.groupBy("question_type").agg(F.round(F.avg(exact), 6).alias("exact_match_rate"), F.round(F.avg(F.col("expected").isNotNull().cast("double")), 6).alias("valid_rate"), F.count(F.lit(1)).alias("n"))


def cited_sources(spark, d):
    """JOIN-5, SET-1: sources of each answer, stripped, each once, with their places."""
    s = F.array_distinct(F.filter(F.transform("used_sources", stripped), lambda x: x.isNotNull() & (x != "")))
    rows = table(spark, d, "training_sample").filter("used_sources is not null").select("request_id", F.posexplode(s).alias("pos", "source"))
    return rows.distinct()


QUERIES = {f.__name__: f for f in (
    basic_quality, meta_penalty, repetition_penalty, completion_reward, refusal_consistency, requirement_coverage, form_quality, copy_penalty, combined_reward, full_reward, training_reward, overall_quality,
    diagnostics, similarity_forms, memory_need, split_counts, context_counts, index_split, sft_filter, sample_errors, parsed_user, binary_metrics, eval_summary, cited_sources,
)}

_AN = "an AS (SELECT request_id, max(query) AS query, max(answer) AS answer, max(content_sufficient) AS content_sufficient, max(difficulty) AS difficulty, max(question_type) AS question_type FROM training_sample GROUP BY 1)"
_T = r"regexp_replace(coalesce(answer, ''), '^[ \t\r\n\x{3000}]+|[ \t\r\n\x{3000}]+$', '', 'g')"


def _has(text: str, phrases: list[str], how: str = " OR ") -> str:
    return "(" + how.join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _count(text: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{p}') AS INTEGER)" for p in phrases) + ")"


_ASKED = {k: _has("coalesce(query, '')", a) for k, (a, _) in Q.REQUIREMENTS.items()}
_REQUIRED = "(" + " + ".join(f"CAST({x} AS INTEGER)" for x in _ASKED.values()) + ")"
_COVERED = "(" + " + ".join(f"CAST({_ASKED[k]} AND {_has('lower(coalesce(answer, chr(32)))', [w.lower() for w in m])} AS INTEGER)" for k, (_, m) in Q.REQUIREMENTS.items()) + ")"
_BASIC = f"CASE WHEN length({_T}) = 0 THEN -1.0 WHEN length({_T}) < 10 THEN -0.6 WHEN length({_T}) > 2500 THEN -0.5 WHEN length({_T}) > 1500 THEN 0.0 ELSE 0.3 END::DOUBLE"
_META = f"greatest(-1.0::DOUBLE, -0.25::DOUBLE * {_count(_T, Q.META_PHRASES)})"
_PARTS = rf"list_filter(list_transform(string_split_regex({_T}, '[。！？!?\n]+'), lambda s: regexp_replace(s, '^[ \t\r\n\x{{3000}}]+|[ \t\r\n\x{{3000}}]+$', '', 'g')), lambda s: s <> '')"
_REP = f"CASE WHEN len({_PARTS}) < 2 THEN 0.0 ELSE greatest(-1.0::DOUBLE, -0.25::DOUBLE * (len({_PARTS}) - len(list_distinct({_PARTS})))) END"
_END = rf"""regexp_replace({_T}, '[ \t\r\n*_~`”’"》〉）)\]}}]+$', '')"""
_COMP = f"CASE WHEN {_T} = '' THEN -1.0 WHEN regexp_matches({_END}, '[。.！!？?]$') THEN 0.3 ELSE -0.8 END::DOUBLE"
_REF = f"CASE WHEN {_T} = '' THEN -1.0 WHEN coalesce(content_sufficient, false) THEN CASE WHEN {_has(_T, Q.REFUSAL_PHRASES)} THEN -1.0 ELSE 0.3 END ELSE CASE WHEN {_has(_T, Q.REFUSAL_PHRASES)} THEN 1.0 ELSE -1.0 END END::DOUBLE"
_COV = f"round({_COVERED} / nullif({_REQUIRED}, 0)::DOUBLE, 6)"
_HANS = r"length(regexp_replace(coalesce(answer, ''), '[^\x{4e00}-\x{9fff}]', '', 'g'))"
_SIG = _has("coalesce(answer, '')", Q.REFUSAL_SIGNALS)
_LOW, _HIGH = f"(CASE WHEN {_SIG} THEN 40 ELSE 120 + 80 * {_REQUIRED} END)", f"(CASE WHEN {_SIG} THEN 350 ELSE 600 + 150 * {_REQUIRED} END)"
_DONE = rf"""CASE WHEN regexp_matches(regexp_replace({_T}, '(?:\*\*|__|`)+[ \t\r\n]*$', ''), '[。！？!?；;][”’"''）)\]】》]*$') THEN 1.0 ELSE 0.6 END::DOUBLE"""
_FORM = f"round(0.75::DOUBLE * CASE WHEN {_HANS} < {_LOW} THEN {_HANS} / {_LOW}::DOUBLE WHEN {_HANS} > {_HIGH} THEN {_HIGH} / {_HANS}::DOUBLE ELSE 1.0 END + 0.25::DOUBLE * {_DONE}, 6)"
_REL = f"coalesce(round(len(list_intersect({toks('query')}, {toks('answer')})) / nullif(len(list_distinct(list_concat({toks('query')}, {toks('answer')}))), 0)::DOUBLE, 6), 0)"
_SAMPLES = """s AS (SELECT DISTINCT metadata.sample_id AS sample_id, metadata.dataset_split AS dataset_split, metadata.context_sufficiency AS context_sufficiency, metadata.difficulty AS difficulty, metadata.question_type AS question_type,
 coalesce(len(metadata.chunk_ids), 0) AS n_chunks, array_to_string(list_transform(messages, lambda x: coalesce(x.role, '?')), ',') AS roles, list_filter(messages, lambda x: x.role = 'user')[1].content AS "user", list_filter(messages, lambda x: x.role = 'assistant')[1].content AS assistant FROM samples)"""
_GOLD = f"g AS (SELECT request_id, question_type, content_sufficient AS e, NOT {_SIG} AS p FROM an)"
_Q = r"regexp_replace(coalesce(question, ''), '^[ \t\r\n\x{3000}]+|[ \t\r\n\x{3000}]+$', '', 'g')"


# Shared with the evaluation record and the parsed messages.
SAMPLES_SQL = _SAMPLES
AN_SQL, REL_SQL, COVERAGE_SQL, FORM_SQL, HAN_SQL, SIGNALS_SQL = _AN, _REL, (_REQUIRED, _COVERED, _COV), _FORM, _HANS, _count("coalesce(answer, '')", Q.REFUSAL_SIGNALS)


def _score(expr: str) -> str:
    return f"WITH {_AN} SELECT request_id, round({expr}, 6) AS score FROM an"


SQL = {
    "basic_quality": _score(_BASIC), "meta_penalty": _score(_META), "repetition_penalty": _score(_REP), "completion_reward": _score(_COMP), "refusal_consistency": _score(_REF),
    "requirement_coverage": _score(_COV), "form_quality": _score(_FORM), "combined_reward": _score(f"greatest(-2.0::DOUBLE, least(2.0::DOUBLE, {_BASIC} + {_META} + {_REP} + {_COMP} + {_REF} + {_REL}))"),
    "overall_quality": f"WITH {_AN}, o AS (SELECT request_id, {_REL} AS r, {_COV} AS c, {_FORM} AS f FROM an), z AS (SELECT request_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN c IS NULL THEN 0.65::DOUBLE * r + 0.35::DOUBLE * f ELSE 0.35::DOUBLE * r + 0.45::DOUBLE * c + 0.20::DOUBLE * f END)), 6) AS score FROM o) "
    "SELECT request_id, score, CASE WHEN score >= 0.85::DOUBLE THEN 'excellent' WHEN score >= 0.70::DOUBLE THEN 'good' WHEN score >= 0.55::DOUBLE THEN 'needs_improvement' ELSE 'poor' END AS level FROM z",
    "diagnostics": rf"WITH {_AN} SELECT request_id, length(coalesce(answer, '')) AS chars, {_HANS} AS han, len(list_filter(list_transform(string_split_regex(coalesce(answer, ''), '[。！？!?；;\n]+'), lambda s: regexp_replace(s, '^[ \t\r\n\x{{3000}}]+|[ \t\r\n\x{{3000}}]+$', '', 'g')), lambda s: s <> '')) AS sentences, {_count(_BARE := 'coalesce(answer, chr(32))', Q.REFUSAL_SIGNALS)} AS signals FROM an",
    "similarity_forms": rf"WITH {_AN} SELECT request_id, regexp_replace(lower(coalesce(answer, '')), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS form FROM an",
    "memory_need": f"WITH {CHATS_SQL} SELECT chat_id, ({_has(_Q, Q.STRONG_PHRASES)} OR {' OR '.join(f"regexp_matches({_Q}, '{p}')" for p in Q.REFERS)}) AND NOT regexp_matches({_Q}, '{Q.OWN_ANTECEDENT}') AS needs FROM c",
    "split_counts": rf"WITH {_SAMPLES} SELECT lower(trim(regexp_replace(dataset_split, '[\t\r\n]', '', 'g'))) AS split, difficulty, question_type, count(*) AS n FROM s GROUP BY 1, 2, 3",
    "context_counts": f"WITH {_SAMPLES} SELECT question_type, min(n_chunks) AS least, max(n_chunks) AS most, count(*) AS n FROM s GROUP BY 1",
    "index_split": f"WITH {_AN} SELECT request_id, CASE request_id % 10 WHEN 9 THEN 'validation' WHEN 0 THEN 'test' ELSE 'train' END AS split FROM an",
    "sft_filter": f"WITH {_SAMPLES} SELECT CASE WHEN coalesce(context_sufficiency, false) AND n_chunks > 0 THEN 'kept' ELSE 'skipped' END AS state, count(*) AS n FROM s GROUP BY 1",
    "sample_errors": f"""WITH {_SAMPLES}, e AS (SELECT sample_id, concat_ws('|', CASE WHEN coalesce(roles, '') <> 'system,user,assistant' THEN 'roles' END, CASE WHEN trim(coalesce("user", '')) = '' THEN 'user' END, CASE WHEN trim(coalesce(assistant, '')) = '' THEN 'assistant' END,
 CASE WHEN NOT coalesce(lower(trim(dataset_split)) IN ('train', 'validation', 'test'), false) THEN 'split' END) AS errors FROM s) SELECT * FROM e WHERE errors <> ''""",
    "parsed_user": f"""WITH {_SAMPLES} SELECT sample_id, trim(string_split("user", '【问题】')[-1]) AS question, len(regexp_extract_all("user", '\\[source_[0-9]+\\]')) AS sources FROM s WHERE "user" IS NOT NULL""",
    "binary_metrics": f"""WITH {_AN}, {_GOLD}, z AS (SELECT count(*) FILTER (coalesce(e, false) AND coalesce(p, false)) AS tp, count(*) FILTER (NOT coalesce(e, false) AND coalesce(p, false)) AS fp, count(*) FILTER (coalesce(e, false) AND NOT coalesce(p, false)) AS fn, count(*) FILTER (e = p) AS same, count(*) AS n FROM g),
 y AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS rc FROM z) SELECT tp, fp, fn, round(coalesce(same / nullif(n, 0)::DOUBLE, 0), 6) AS accuracy, round(pr, 6) AS precision, round(rc, 6) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1 FROM y""",
    "eval_summary": f"WITH {_AN}, {_GOLD} SELECT question_type, round(avg(CASE WHEN coalesce(e = p, false) THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS exact_match_rate, round(avg(CASE WHEN e IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS valid_rate, count(*) AS n FROM g GROUP BY 1",
    "cited_sources": r"WITH x AS (SELECT DISTINCT request_id, list_filter(list_transform(used_sources, lambda s: regexp_replace(s, '^[ \t\r\n\x{3000}]+|[ \t\r\n\x{3000}]+$', '', 'g')), lambda s: s IS NOT NULL AND s <> '') AS l FROM training_sample WHERE used_sources IS NOT NULL), y AS (SELECT request_id, unnest(l) AS source, generate_subscripts(l, 1) AS i FROM x), z AS (SELECT request_id, source, min(i) AS i FROM y GROUP BY 1, 2) SELECT request_id, source, CAST(row_number() OVER (PARTITION BY request_id ORDER BY i) - 1 AS INTEGER) AS pos FROM z",
}
