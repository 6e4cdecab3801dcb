"""Small operators on records: hits, samples' messages, charts, routing metrics, answers put together, models that are called, maps and keys."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.text import stripped

# Fields of a profile, kinds of charts, skills, marks of a sample's user message.
CHARTS = ["bar", "plot", "pie", "table"]
SKILLS = ["rag", "light-rag", "plot", "chat"]
QUESTION_MARKS = ["【问题】", "【用户问题】"]


def identifier(name: str) -> str:
    """The name if it is a plain SQL identifier (a letter or underscore, then letters, digits, underscores); ValueError otherwise."""
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def projected_hits(hits: DataFrame, key: str, store_id: str, defaults: dict[str, str]) -> DataFrame:
    """key and the fields of defaults: a missing key falls back to the store's id, missing fields to their default; rows without either id are dropped."""
    one = F.coalesce(F.nullif(stripped(F.col(key)), F.lit("")), F.nullif(stripped(F.col(store_id)), F.lit("")))
    return hits.select(one.alias(key), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()]).filter(F.col(key).isNotNull())


def flattened(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Rows of a column map<key, struct> as one row for each entry (key and the struct's fields beside the other columns); rows that are flat already pass."""
    if not dict(rows.dtypes)[column].startswith("map<"):
        return rows
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.explode(column).alias(key, "_v")).select(*others, key, "_v.*")


def map_argmax(m: Column) -> Column:
    """The key of the greatest value, the least of equal ones; null for an empty map."""
    first = F.array_sort(F.map_entries(m), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    return F.try_element_at(first, F.lit(1))["key"]


def allowed_fields(fields: Column, allowed: list[str]) -> Column:
    """A map<string, string> without fields outside the list and without blank values."""
    return F.map_filter(fields, lambda k, v: k.isin(*allowed) & (F.trim(F.coalesce(v, F.lit(""))) != ""))


def illegal_fields(fields: Column, allowed: list[str]) -> Column:
    """Names of the map that are not allowed, in order."""
    return F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(a) for a in allowed])))


def present(fields: Column) -> Column:
    """The map without null values."""
    return F.map_filter(fields, lambda k, v: v.isNotNull())


def first_of_pairs(rows: DataFrame, pair: list[str], order: str) -> DataFrame:
    """One row for each distinct pair, the one of the least order."""
    rest = [c for c in rows.columns if c not in pair]
    return rows.groupBy(*pair).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(*pair, "_r.*")


def clamped(k: Column, low: int = 1, high: int = 10) -> Column:
    return F.greatest(F.lit(low), F.least(F.coalesce(k, F.lit(low)), F.lit(high)))


def skill_of(name: Column) -> Column:
    """A known skill, else chat."""
    s = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(s.isin(*SKILLS), s).otherwise("chat")


def answer_text(skill: Column, answer: Column, error: Column) -> Column:
    """The text of a sub-task's answer: a plot's is unwrapped from its JSON object (as it stands if it is none); an empty one with an error gives the error's line."""
    raw, bad = F.trim(F.coalesce(answer, F.lit(""))), F.trim(F.coalesce(error, F.lit("")))
    is_object = F.coalesce(F.startswith(raw, F.lit("{")) & F.try_parse_json(raw).isNotNull(), F.lit(False))
    text = F.when((skill_of(skill) == "plot") & is_object, F.coalesce(F.get_json_object(raw, "$.answer"), F.lit(""))).otherwise(raw)
    return F.when((text == "") & (bad != ""), F.concat(F.lit("子任务执行失败："), bad)).otherwise(text)


def assembled_answers(rows: DataFrame) -> DataFrame:
    """request_id, answer of sub-tasks (request_id, task_no, question, skill, answer, error): numbered with their questions, in order, blank ones left out. A request's answers are one group."""
    text, q = answer_text(F.col("skill"), F.col("answer"), F.col("error")), F.trim(F.coalesce("question", F.lit("")))
    x = rows.select("request_id", "task_no", q.alias("q"), text.alias("t")).filter("t <> ''")
    one = F.when(F.col("q") != "", F.concat(F.col("task_no").cast("string"), F.lit(". "), F.col("q"), F.lit("\n"), F.col("t"))).otherwise(F.col("t"))
    g = x.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("task_no", one.alias("t")))).alias("a"))
    return g.select("request_id", F.array_join(F.transform("a", lambda s: s["t"]), "\n\n").alias("answer"))


def chart_error(kind: Column, labels: Column, values: Column) -> Column:
    """Why a chart (labels and values as arrays of strings) can't be drawn, null if it can; line means plot."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    k = F.when(k == "line", "plot").otherwise(k)
    numbers = F.transform(values, lambda v: F.expr("null") if v is None else v.try_cast("double"))
    finite = F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    total = F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v)
    n, m = F.coalesce(F.size(labels), F.lit(0)), F.coalesce(F.size(values), F.lit(0))
    return (
        F.when(~k.isin(*CHARTS), "kind").when((n <= 0) | (m <= 0), "empty").when(n != m, "lengths").when(n > 1000, "too many")
        .when(k == "table", F.when(F.exists(values, lambda v: F.trim(F.coalesce(v, F.lit(""))) == ""), "blank value"))
        .when(~finite, "not numeric").when((k == "pie") & F.exists(numbers, lambda v: v < 0), "negative").when((k == "pie") & (total <= 0), "no sum")
    )


def normalised_series(series: Column) -> Column:
    """A series struct (topic, entity, metric, dimension, dimension_unit, value_unit: strings, conditions: array of strings, points: array of (label, x, value)): strings trimmed,
    null ones empty, null conditions an empty list, blank conditions and points without x or a finite value left out."""
    text = lambda c: F.trim(F.coalesce(series[c], F.lit(""))).alias(c)
    conditions = F.filter(F.transform(F.coalesce(series["conditions"], F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
    ok = lambda p: (F.trim(F.coalesce(p["x"], F.lit(""))) != "") & p["value"].isNotNull() & ~F.isnan(p["value"]) & (F.abs(p["value"]) < float("inf"))
    return F.struct(*[text(c) for c in ("topic", "entity", "metric", "dimension", "dimension_unit", "value_unit")], conditions.alias("conditions"), F.filter(series["points"], ok).alias("points"))


def flat_points(docs: DataFrame) -> DataFrame:
    """equipment, label, dimension, value, value_unit, x of the points of documents with a series column; documents without points are skipped."""
    s = F.col("series")
    x = docs.select(s["entity"].alias("equipment"), s["dimension"].alias("dimension"), s["value_unit"].alias("value_unit"), F.explode(s["points"]).alias("p"))
    return x.select("equipment", F.col("p.label").alias("label"), "dimension", F.col("p.value").alias("value"), "value_unit", F.col("p.x").alias("x"))


def picked_metrics(metrics: DataFrame) -> DataFrame:
    """Of metrics (query_id, doc, pos, name, wanted, cosine) one a query and document: the first whose name is the wanted one, whatever its case and outer blanks; else that of the
    greatest cosine, the first of equal ones. Metrics without name and cosine take no part."""
    same = F.lower(F.trim("name")) == F.lower(F.trim("wanted"))
    x = metrics.withColumn("exact", F.coalesce(same, F.lit(False))).filter(F.col("exact") | F.col("cosine").isNotNull())
    best = F.max(F.struct("exact", F.when(F.col("exact"), 0.0).otherwise(F.col("cosine")).alias("c"), (-F.col("pos")).alias("p"), "name", "cosine"))
    return x.groupBy("query_id", "doc").agg(best.alias("b")).select("query_id", "doc", (-F.col("b.p")).alias("pos"), "b.name", "b.exact")


def parsed_user(content: Column) -> Column:
    """question and blocks (array of document_title, chunk_id, text) of a user message: the question after the last mark, the numbered source blocks before it; without
    blocks what stands there is one. Null without a mark or with a blank question."""
    mark = F.when(content.contains(QUESTION_MARKS[0]), F.lit(QUESTION_MARKS[0])).when(content.contains(QUESTION_MARKS[1]), F.lit(QUESTION_MARKS[1]))
    at = F.length(content) - F.instr(F.reverse(content), F.reverse(mark)) - F.length(mark) + 2  # where the last mark begins
    question, head = stripped(F.substring(content, at + F.length(mark), F.length(content))), F.substring(content, F.lit(1), at - 1)
    head = stripped(F.regexp_replace(head, "^([^【]*)【检索资料】", "$1"))
    pieces = F.split(head, r"(?:^|\n)\s*\[source_\d+\]\s*")

    def block(t: Column) -> Column:
        field = lambda name: F.trim(F.regexp_extract(t, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)).alias(name)
        text = stripped(F.regexp_replace(t, r"(?m)^(?:document_title|chunk_id):.*?(?:\n|\z)", ""))
        return F.struct(field("document_title"), field("chunk_id"), text.alias("text"))

    blocks = F.filter(F.transform(F.slice(pieces, 2, 1_000_000), block), lambda b: b["text"] != "")
    whole = F.array(F.struct(F.lit("").alias("document_title"), F.lit("").alias("chunk_id"), head.alias("text")))
    return F.when(mark.isNotNull() & (question != ""), F.struct(question.alias("question"), F.when((F.size(blocks) == 0) & (head != ""), whole).otherwise(blocks).alias("blocks")))


def cited_chunks(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, pos, chunk_id of cited labels (answer_id, labels) by the table (answer_id, label, chunk_id): labels trimmed, each once, in order; an unknown label has a null
    chunk_id, which unknown_labels() tells."""
    trimmed = F.array_distinct(F.filter(F.transform("labels", stripped), lambda x: x.isNotNull() & (x != "")))
    asked = answers.select("answer_id", F.posexplode(trimmed).alias("pos", "label"))
    return asked.join(sources.select("answer_id", "label", "chunk_id"), ["answer_id", "label"], "left")


def unknown_labels(cited: DataFrame) -> DataFrame:
    return cited.filter("chunk_id is null").select("answer_id", "label")


def routing_summary(gold: DataFrame, predicted: DataFrame, fields: tuple[str, ...] = ("short", "long")) -> DataFrame:
    """One row over gold (id, short, long, operations) and predicted (id, and the same as of its JSON; null where that was no JSON): rates of valid, exact and equal operations, and
    precision, recall and f1 of each field. A missing prediction counts as no hit."""
    p = predicted.select("id", F.lit(True).alias("_there"), *[F.col(f).alias(f"p_{f}") for f in (*fields, "operations")])
    x = gold.join(p, "id", "left")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    valid = F.coalesce(F.col("_there") & F.col(f"p_{fields[0]}").isNotNull(), F.lit(False))
    ops = valid & (F.to_json(F.struct(F.coalesce("operations", F.array()).alias("o"))) == F.to_json(F.struct(F.coalesce("p_operations", F.array()).alias("o"))))
    exact = ops
    for f in fields:
        exact = exact & F.coalesce(F.col(f) == F.col(f"p_{f}"), F.lit(False))
    rates = [F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6).alias(n) for c, n in ((valid, "json_valid_rate"), (exact, "exact_match_rate"), (ops, "operations_exact_rate"))]
    counts = []
    for f in fields:
        e, q = F.coalesce(f, F.lit(False)), F.coalesce(f"p_{f}", F.lit(False))
        counts += [F.count_if(e & q).alias(f"{f}_tp"), F.count_if(~e & q).alias(f"{f}_fp"), F.count_if(e & ~q).alias(f"{f}_fn")]
    out = x.agg(F.count(F.lit(1)).alias("n"), *rates, *counts)
    for f in fields:
        tp, fp, fn = (F.col(f"{f}_{k}") for k in ("tp", "fp", "fn"))
        out = out.withColumns({f"{f}_precision": F.round(share(tp, tp + fp), 6), f"{f}_recall": F.round(share(tp, tp + fn), 6), f"{f}_f1": F.round(share(2 * tp, 2 * tp + fp + fn), 6)})
    return out


def with_retries(call: Callable, attempts: int = 3, wait: float = 1.0, sleep: Callable = time.sleep) -> Callable:
    """The callable, tried again after wait, 2 * wait, ... seconds if it raises; the last error goes through."""

    def run(*args):
        for i in range(attempts):
            try:
                return call(*args)
            except Exception:
                if i + 1 == attempts:
                    raise
                sleep(wait * 2**i)

    return run


def sent(message, sender: Callable, attempts: int = 3):
    """The receipt of sender(message): asked again, at most `attempts` times, while there is none; an error goes through at once."""
    for _ in range(attempts):
        if (receipt := sender(message)) is not None:
            return receipt
    raise RuntimeError(f"no receipt after {attempts} attempts")


def replies(prompt: Column, model: Callable[[list[str]], list[str]], attempts: int = 2, wait: float = 1.0) -> Column:
    """A model's replies to a column of prompts, a batch at a time, each batch tried again on errors; null prompts give null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = with_retries(model, attempts, wait)
        for s in batches:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            there = s.notna()
            if there.any():
                out[there] = ask(s[there].tolist())
            yield out

    return run(prompt)


def task_key(user: Column, session: Column) -> Column:
    """user:…:session:… and a random identifier."""
    return F.concat(F.lit("user:"), user.cast("string"), F.lit(":session:"), session.cast("string"), F.lit(":"), F.uuid())


def zone_millis(local: Column, zone: str = "Asia/Shanghai") -> Column:
    """Milliseconds since the epoch of a local time in a zone."""
    return F.unix_millis(F.convert_timezone(F.lit(zone), F.lit("UTC"), local).cast("timestamp"))
