"""Keywords of requests, and texts put together for answers and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.text import stripped, tokens

# Words that are no keywords.
IGNORED = ["什么", "什么是", "怎么", "如何", "请问", "一下", "介绍", "说明", "又是", "？", "?", "。", "，", ",", "；", ";", "！", "!"]


def clean_token(token: Column) -> Column:
    """Piece marks off, and edges that are no word signs."""
    bare = F.trim(F.replace(F.replace(token, F.lit("▁"), F.lit("")), F.lit("</w>"), F.lit("")))
    return F.regexp_replace(bare, r"(?U)^[\W_]+|[\W_]+$", "")


def merged_tokens(weighted: Column, text: Column) -> Column:
    """Neighbours in an array<struct<tok, w>> that are single Han signs and stand side by side in the text become a pair of the greater weight; others
    pass. A pair takes part in no other pair. A fold over one request."""
    han = lambda t: (F.length(t) == 1) & t.rlike(r"[\x{4e00}-\x{9fff}]")
    kind = "array<struct<tok: string, w: double>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.array().cast(kind).alias("open"))

    def add(s: Column, x: Column) -> Column:
        prev = F.get(s["open"], 0)
        join = prev.isNotNull() & han(prev["tok"]) & han(x["tok"]) & text.contains(F.concat(prev["tok"], x["tok"]))
        pair = F.struct(F.concat(prev["tok"], x["tok"]).alias("tok"), F.greatest(prev["w"], x["w"]).alias("w"))
        none = F.array().cast(kind)
        return F.when(F.coalesce(join, F.lit(False)), F.struct(F.concat(s["done"], F.array(pair)).alias("done"), none.alias("open"))).otherwise(F.struct(F.concat(s["done"], s["open"]).alias("done"), F.array(x).alias("open")))

    return F.aggregate(weighted, start, add, lambda s: F.concat(s["done"], s["open"]))


def keywords(requests: DataFrame, frequencies: DataFrame, n_docs: int, topk: int = 8, least: float = 0.05) -> DataFrame:
    """request_id, tok, weight, rank: the topk keywords by inverse document frequency, scaled to at most 1 (tok, df of frequencies). Neighbouring Han signs
    that stand so in the request are merged."""
    import math

    t = requests.select("request_id", F.lower("text").alias("text"), F.posexplode(F.array_distinct(tokens(F.col("text")))).alias("pos", "tok"))
    t = t.withColumn("tok", clean_token(F.col("tok"))).filter((F.col("tok") != "") & ~F.col("tok").isin(*IGNORED))
    idf = F.log(1 + F.lit(float(n_docs)) / F.coalesce(F.col("df"), F.lit(1))) / F.lit(math.log(1 + n_docs) or 1.0)
    w = t.join(frequencies, "tok", "left").select("request_id", "text", "pos", "tok", F.round(idf, 6).alias("w")).filter(F.col("w") >= least)
    one = w.groupBy("request_id").agg(F.max("text").alias("text"), F.array_sort(F.collect_list(F.struct("pos", "tok", "w"))).alias("a"))  # the distinct tokens of one request
    pairs = merged_tokens(F.transform("a", lambda x: F.struct(x["tok"].alias("tok"), x["w"].alias("w"))), F.col("text"))
    best = one.select("request_id", F.explode(pairs).alias("x")).groupBy("request_id", F.col("x.tok").alias("tok")).agg(F.max("x.w").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("weight"), "tok"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= topk)


def with_keywords(requests: DataFrame, words: DataFrame) -> DataFrame:
    """Adds keywords, the request's keywords in one text (null without any)."""
    text = words.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tok"))).alias("a")).select("request_id", F.array_join(F.col("a.tok"), " ").alias("keywords"))
    return requests.join(text, "request_id", "left")


def joined_answers(rows: DataFrame, key: str, order: str, answer: str, separator: str = "\n\n\n") -> DataFrame:
    """key, answer: non-blank answers in order, joined. For groups that are one request's answers."""
    kept = rows.filter(stripped(F.coalesce(answer, F.lit(""))) != "")
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(answer).alias("answer")))).alias("a")).select(key, F.array_join(F.transform("a", lambda x: x["answer"]), separator).alias("answer"))


def source_blocks(chunks: Column) -> Column:
    """[source_i] blocks of an array of (title, chunk_id, text) structs."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("[source_"), (i + 1).cast("string"), F.lit("]\ndocument_title: "), F.coalesce(c["title"], F.lit("")), F.lit("\nchunk_id: "), c["chunk_id"], F.lit("\n"), c["text"])), "\n\n")


def training_rows(samples: DataFrame) -> DataFrame:
    """prompt (all messages but the last) and completion (the assistant's message) of well-formed samples."""
    roles = F.transform("messages", lambda m: m["role"])
    ok = samples.filter(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")))
    return ok.select(F.col("metadata.sample_id").alias("sample_id"), F.slice("messages", 1, 2).alias("prompt"), F.element_at("messages", 3)["content"].alias("completion"))


def completion_of(full: Column, prompt: Column) -> Column:
    """What follows the prompt in a text that starts with it; null otherwise."""
    return F.when(F.startswith(full, prompt), F.substring(full, F.length(prompt) + 1, F.length(full)))
