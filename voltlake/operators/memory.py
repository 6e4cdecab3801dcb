"""Layered conversation memory and state folds over chat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators import fusion, lexical

DAY = 86_400


def last_of(rows: DataFrame, group: str, order: list, n: int, name: str = "back") -> DataFrame:
    """The n last rows of each group, numbered from the newest; Spark limits each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn(name, rank).filter(F.col(name) <= n)


def numbered(rows: DataFrame, keys: list[str], order: list[str], seconds: str, name: str = "n") -> DataFrame:
    """Running number of each row in its group, from 1, in two levels: inside a day, and over the counts of the days, so
    that a group of any size is spread over its days."""
    day = F.floor(F.col(seconds) / DAY)
    rows = rows.withColumn("_day", F.coalesce(day, F.lit(-1)))
    days = rows.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(*order))
    return rows.join(days, [*keys, "_day"]).withColumn(name, inside + F.col("_before")).drop("_day", "_before")


def summary_groups(done: DataFrame, size: int = 5) -> DataFrame:
    """user_id, session_id, group_no, chat_ids (JSON list) of each full group of `size` completed chats (user_id, session_id, chat_id, create_time)."""
    rows = done.withColumn("_s", F.unix_timestamp(F.col("create_time").cast("timestamp")))
    n = numbered(rows, ["user_id", "session_id"], ["create_time", "chat_id"], "_s")
    g = n.withColumn("group_no", F.floor((F.col("n") - 1) / size)).groupBy("user_id", "session_id", "group_no")
    out = g.agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_list(F.struct("n", "chat_id"))).alias("x"))  # at most `size` rows a group
    return out.filter(F.col("c") == size).select("user_id", "session_id", "group_no", F.to_json(F.col("x.chat_id")).alias("chat_ids"))


def fused_search(keyword: DataFrame, vector: DataFrame, key: str, least: float = 0.4, weights: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """Maximum-normalised channels (request_id, key, score) summed; scores above `least` stay."""
    a = keyword.select("request_id", key, fusion.max_norm(F.col("score"), weights[0], "request_id").alias("s"))
    b = vector.select("request_id", key, fusion.max_norm(F.col("score"), weights[1], "request_id").alias("s"))
    return a.unionByName(b).groupBy("request_id", key).agg(F.round(F.sum("s"), 6).alias("score")).filter(F.col("score") > least)


def status_fold(states: DataFrame) -> DataFrame:
    """Final status of each task of (task_id, update_time, status), its number of states and of failures: COMPLETED absorbs all, else the latest counts."""
    s = F.upper(F.regexp_replace("status", r"[ \t\r\n]", ""))
    g = states.filter("task_id is not null").withColumn("s", s).groupBy("task_id")
    out = g.agg(F.max(F.struct("update_time", "s")).alias("last"), F.max(F.coalesce(F.col("s") == "COMPLETED", F.lit(False))).alias("done"), F.count_if(F.col("s") == "FAILED").alias("failures"), F.count(F.lit(1)).alias("states"))
    return out.select("task_id", F.when(F.col("done"), "COMPLETED").otherwise(F.col("last.s")).alias("status"), "failures", "states")


def profile_fold(ops: DataFrame) -> DataFrame:
    """user_id, field, value after all operations (user_id, seq, operation, field, value): the last of each field wins, a delete leaves
    nothing, blank values and unknown fields are ignored by the caller's filter."""
    last = ops.groupBy("user_id", "field").agg(F.max(F.struct("seq", "operation", "value")).alias("l"))
    return last.filter(F.col("l.operation") == "update").select("user_id", "field", F.col("l.value").alias("value"))


__all__ = ["fused_search", "last_of", "lexical", "numbered", "profile_fold", "status_fold", "summary_groups"]
