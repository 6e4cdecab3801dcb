"""Channel normalisation, reciprocal-rank fusion, merging of sub-queries, reranking and balanced top-k."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.text import stripped, tokens

# Shares of the channels, the mix of raw score and rank, and the rank constant.
WEIGHTS = {"document_title": 0.10, "title": 0.20, "text": 0.02, "text_vector": 0.18, "description_vector": 0.42, "description_text": 0.08}
RAW, RANK, RRF_K = 0.8, 0.2, 20
ORDER = ["document_title", "title", "text", "text_vector", "description_vector", "description_text"]  # ties of the fused score go to the first channel


def normalised_weights(weights: dict[str, float]) -> dict[str, float]:
    """Non-negative weights with sum 1; ValueError otherwise impossible."""
    if any(w < 0 for w in weights.values()) or not (total := sum(weights.values())) > 0:
        raise ValueError("weights must be non-negative and not all zero")
    return {k: w / total for k, w in weights.items()}


def candidate_depth(topk: int) -> int:
    return max(5 * topk, 50)


def min_max(score: Column, *group: str) -> Column:
    """(s - min) / (max - min) in the group; a constant group gives 1 where it isn't zero, else 0."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.when(score != 0, 1.0).otherwise(0.0)).otherwise((score - low) / (high - low))


def max_norm(score: Column, weight: Column | float, *group: str) -> Column:
    """weight * s / max in the group; unchanged where the maximum isn't positive."""
    high = F.max(score).over(Window.partitionBy(*group))
    return F.when(high > 0, score / high * weight).otherwise(score)


def first_seen_rank(hits: DataFrame, title: str) -> DataFrame:
    """Adds doc_rank: dense order of the first appearance of the hit's title in its request and channel."""
    first = F.min("rank").over(Window.partitionBy("request_id", "channel", title))
    return hits.withColumn("first_rank", first).withColumn("doc_rank", F.dense_rank().over(Window.partitionBy("request_id", "channel").orderBy("first_rank"))).drop("first_rank")


def rrf_fuse(hits: DataFrame, key: str, weights: dict[str, float] = WEIGHTS, title: str | None = None, threshold: float | None = None) -> DataFrame:
    """request_id, key, score, channels, first of hits (request_id, channel, key, score, rank[, title]); first orders ties by channel and rank.

    One union and one aggregation over all channels: no outer joins. The document channel ranks by first appearance of the title."""
    rank = F.col("rank")
    if title:
        hits = first_seen_rank(hits, title)
        rank = F.when(F.col("channel") == "document_title", F.col("doc_rank")).otherwise(rank)
    weight = F.coalesce(*[F.when(F.col("channel") == c, F.lit(float(w))) for c, w in weights.items()])
    term = weight * (RAW * F.col("norm") + RANK * (RRF_K + 1) / (RRF_K + rank))
    place = F.coalesce(*[F.when(F.col("channel") == c, F.lit(i)) for i, c in enumerate(ORDER)], F.lit(len(ORDER)))
    out = hits.withColumn("norm", min_max(F.col("score"), "request_id", "channel")).groupBy("request_id", key).agg(
        F.round(F.sum(term), 6).alias("score"), F.count(F.lit(1)).alias("channels"), F.min(place * 100_000 + F.col("rank")).alias("first")
    )
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def split_query(requests: DataFrame, most: int = 5, extra: str = "") -> DataFrame:
    """request_id, sub_no, sub_query: parts between end signs, of two signs or more, each once, at most `most`; the whole query if none."""
    cut = F.split(F.coalesce("text", F.lit("")), f"[？?。；;！!\n{extra}]+")
    parts = F.array_distinct(F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^[ ，,]+|[ ，,]+$", "")), lambda s: F.length(s) >= 2))
    subs = F.when(F.size(parts) > 0, F.slice(parts, 1, most)).otherwise(F.array(F.coalesce("text", F.lit(""))))
    return requests.select("request_id", F.posexplode(subs).alias("sub_no", "sub_query")).withColumn("sub_no", F.col("sub_no") + 1)


def sub_depth(topk: int, subs: Column) -> Column:
    """Hits of each sub-query: max(5, ceil(topk / number of sub-queries))."""
    return F.greatest(F.lit(5), F.ceil(F.lit(topk) / subs))


def merge_candidates(subs: DataFrame, key: str) -> DataFrame:
    """One row for each request and candidate of (request_id, sub_no, key, score): the best score, its sub-query (the first of equals), the number of sub-queries
    and scores, those of each sub-query in order (sub_no:score)."""
    best = F.max(F.struct(F.col("score"), (-F.col("sub_no")).alias("n"))).alias("b")
    each = F.array_sort(F.collect_list(F.struct("sub_no", "score"))).alias("a")  # at most one a sub-query
    text = F.array_join(F.transform("a", lambda x: F.format_string("%d:%.6f", x["sub_no"], x["score"])), ",")
    out = subs.groupBy("request_id", key).agg(best, F.count(F.lit(1)).alias("matched"), each)
    return out.select("request_id", key, F.col("b.score").alias("score"), (-F.col("b.n")).alias("sub_no"), "matched", text.alias("scores"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct tokens over all distinct tokens."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.round(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)).cast("double"), F.lit(0.0)), 6)


def contained(a: Column, b: Column) -> Column:
    """Default pair scorer: the share of the distinct tokens of the question (a) that the text (b) has."""
    x = F.array_distinct(tokens(a))
    return F.round(F.size(F.array_intersect(x, tokens(b))) / F.nullif(F.size(x).cast("double"), F.lit(0.0)), 6)


def held(a: Column, known: Column) -> Column:
    """contained() of a text whose distinct tokens are known."""
    x = F.array_distinct(tokens(a))
    return F.round(F.size(F.array_intersect(x, known)) / F.nullif(F.size(x).cast("double"), F.lit(0.0)), 6)


def scored_pairs(pairs: DataFrame, scorer=contained, threshold: float = 0.2) -> DataFrame:
    """Adds score to pairs (request_id, sub_no, sub_query, key, body), kept from threshold on; blank bodies are dropped. For held(), body has the tokens of texts that aren't blank."""
    if dict(pairs.dtypes)["body"] == "string":
        pairs = pairs.filter(stripped(F.col("body")) != "")
    return pairs.withColumn("score", F.coalesce(scorer(F.col("sub_query"), F.col("body")), F.lit(0.0))).filter(F.col("score") >= threshold)


def rerank(pairs: DataFrame, key: str, scorer=contained, threshold: float = 0.2) -> DataFrame:
    """Best scorer value over the matched sub-queries of (request_id, sub_no, sub_query, key, body), kept from threshold on; blank bodies are dropped."""
    best = scored_pairs(pairs, scorer, threshold).groupBy("request_id", key).agg(F.max(F.struct("score", (-F.col("sub_no")).alias("n"))).alias("b"))
    return best.select("request_id", key, F.col("b.score").alias("score"), (-F.col("b.n")).alias("sub_no"))


def take_turns(rows: list[tuple], k: int) -> list[tuple]:
    """(candidate, sub_no) picked from (sub_no, score, candidate) rows: sub-queries take turns by their order, each its best that is not taken yet."""
    queues: dict = {}
    for n, score, c in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        queues.setdefault(n, []).append(c)
    taken: dict = {}
    while len(taken) < k and queues:
        for n in sorted(queues):
            left = [c for c in queues[n] if c not in taken]
            if left and len(taken) < k:
                taken[left[0]] = n
            queues[n] = left[1:]
        queues = {n: q for n, q in queues.items() if q}
    return list(taken.items())


def balanced_topk(scored: DataFrame, key: str, k: int) -> DataFrame:
    """request_id, pick, key, sub_no of (request_id, sub_no, key, score): sub-queries take turns by their own order, skipping what is taken.

    What is skipped shifts later picks, so the turns are a fold; it runs in Arrow batches of many requests. A request holds at most sub-queries x depth rows."""
    types = dict(scored.dtypes)
    one = scored.groupBy("request_id").agg(F.collect_list(F.struct(F.col("sub_no").alias("n"), F.col("score").alias("s"), F.col(key).cast("string").alias("c"))).alias("a"))

    def run(batches):
        for pdf in batches:
            rows = [(r, i, c, n) for r, a in zip(pdf.request_id, pdf.a) for i, (c, n) in enumerate(take_turns([(x["n"], x["s"], x["c"]) for x in a], k), 1)]
            yield pd.DataFrame(rows, columns=["request_id", "pick", key, "sub_no"])

    return one.mapInPandas(run, f"request_id {types['request_id']}, pick int, `{key}` string, sub_no int").withColumn(key, F.col(key).cast(types[key]))


def two_rounds(first: Column, second: Column, most: int = 4) -> Column:
    """second[:2] + first[:2] + second[2:] + first[2:], each once, at most `most`."""
    rest = lambda a: F.slice(a, 3, F.greatest(F.size(a), F.lit(1)))
    return F.slice(F.array_distinct(F.concat(F.slice(second, 1, 2), F.slice(first, 1, 2), rest(second), rest(first))), 1, most)
