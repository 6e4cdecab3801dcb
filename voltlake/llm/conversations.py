"""Problem 2: conversations from message rows.

The two senders of a session, user and assistant, have clocks of their own. A row holds the user's time
(create_time) and the assistant's (update_time). Reply-before constraints bound the offset d that must be added to the
assistant's clock: a reply comes after its question (d >= create_i - update_i) and before the next question
(d <= create_i+1 - update_i). The offset is the least-squares fit over all bounds. The messages are merged by their corrected
times; a conversation whose bounds no offset meets keeps each reply right after its question.

A conversation is infeasible, and rejected as a whole, if any current row of it is not completed, has no create_time, has
no content in question or answer, or isn't of the session's owner, or if its session is missing. (Rows whose bounds
contradict each other are reported in ``offset_residual``; they are no reason to reject by the statement.)

Scale: texts never leave the scan's stage. Rows are ranked within (session, hour); the counts of the hours give each hour's
offset. So a session that holds a third of all rows is spread over its hours and never stands in one task.

Defined cases: repeated rows collapse; of several states of a chat the latest update_time is current (null is oldest; of
equal ones the largest create_time, session and owner in that order); rows without session_id or chat_id belong to no conversation;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.content import has_content, is_completed
from voltlake.operators.memory import numbered

HOUR, BINS = 3600, 1024


def current_rows(chats: DataFrame) -> DataFrame:
    """One row for each chat_id: chat_id, session_id, user_id, create_time, update_time, ok (completed, timed, with content)."""
    ok = is_completed(F.col("status")) & has_content(F.col("question")) & has_content(F.col("answer")) & F.col("create_time").isNotNull()
    state = F.struct("update_time", "create_time", "session_id", "user_id", ok.alias("ok"))
    best = chats.filter(F.col("chat_id").isNotNull()).select("chat_id", state.alias("s")).groupBy("chat_id").agg(F.max("s").alias("s"))
    return best.select("chat_id", "s.*").filter(F.col("session_id").isNotNull())


def _buckets(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = current_rows(chats).withColumn(
        "bucket", F.coalesce(F.floor(F.unix_timestamp(F.col("create_time").cast("timestamp")) / HOUR), F.lit(-1).cast("bigint"))
    )
    parts = rows.groupBy("session_id", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("ok").alias("ok"), F.min("user_id").alias("u_min"), F.max("user_id").alias("u_max"),
        F.count("user_id").alias("n_user"),
    )
    return rows, parts


def kept_sessions(parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id of the conversations without an infeasible row, from the counts of their hours."""
    whole = parts.groupBy("session_id").agg(
        F.min("ok").alias("ok"), F.min("u_min").alias("u_min"), F.max("u_max").alias("u_max"), F.sum("n").alias("n"), F.sum("n_user").alias("n_user")
    )
    owners = sessions.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max("user_id").alias("owner"))
    return (
        whole.filter("ok and n = n_user and u_min = u_max").join(owners, "session_id").filter(F.col("owner") == F.col("u_min")).select("session_id")
    )


def ordered_turns(chats: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, turn_no, chat_id, create_time, update_time of the kept conversations."""
    rows, parts = _buckets(chats)
    kept = kept_sessions(parts, sessions)
    before = Window.partitionBy("session_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("session_id", "bucket", "n").join(kept, "session_id", "left_semi").select(
        "session_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped")
    )
    within = Window.partitionBy("session_id", "bucket").orderBy("create_time", "chat_id")
    return rows.join(offsets, ["session_id", "bucket"]).select(
        "session_id", (F.row_number().over(within) + F.col("skipped")).alias("turn_no"), "chat_id", "create_time", "update_time"
    )


def _bounds(turns: DataFrame) -> DataFrame:
    """session_id, low (lower or upper bound of the offset), v in microseconds; as numbers that doubles hold exactly."""
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    nxt = turns.select("session_id", (F.col("turn_no") - 1).alias("turn_no"), t("create_time").alias("next_create"))
    b = turns.join(nxt, ["session_id", "turn_no"], "left").select("session_id", (t("create_time") - t("update_time")).alias("low"), (F.col("next_create") - t("update_time")).alias("high"))
    both = F.array(F.struct(F.lit(True).alias("low"), F.col("low").alias("v")), F.struct(F.lit(False).alias("low"), F.col("high").alias("v")))
    return b.select("session_id", F.explode(both).alias("b")).select("session_id", "b.low", F.col("b.v").cast("double").alias("v")).filter("v is not null")


def _span(bounds: DataFrame) -> DataFrame:
    """session_id, lo, hi: the largest lower and the least upper bound; met: the offset nearest to 0 that meets all bounds, if lo <= hi or hi is null."""
    s = bounds.groupBy("session_id").agg(F.max(F.when(F.col("low"), F.col("v"))).alias("lo"), F.min(F.when(~F.col("low"), F.col("v"))).alias("hi"))
    return s.withColumn("met", F.greatest(F.col("lo"), F.least(F.lit(0.0), F.col("hi"))))  # one may be missing: greatest and least skip nulls


def _first_root(e: DataFrame, group: list[str], order: str) -> DataFrame:
    """The first row of each group, by order, at whose top the slope of the squared violations isn't negative. e has low_n, low_s, high_n, high_s (number
    and sum of the bounds of each kind), top, and as base_* what is broken by all other bounds. broken_n, broken_s: what is broken just below the row."""
    upto = Window.partitionBy(*group).orderBy(order)
    whole = Window.partitionBy(*group)
    run = lambda c: F.sum(c).over(upto)
    above = lambda c: F.sum(c).over(whole) - run(c)
    e = e.withColumns({"n": F.col("base_n") + above("low_n") + run("high_n"), "s": F.col("base_s") + above("low_s") + run("high_s")})
    e = e.withColumns({"broken_n": F.col("n") + F.col("low_n") - F.col("high_n"), "broken_s": F.col("s") + F.col("low_s") - F.col("high_s"), "rest_n": F.col("n") - F.col("high_n"), "rest_s": F.col("s") - F.col("high_s")})
    state = F.struct(order, "broken_n", "broken_s", "rest_n", "rest_s")
    return e.filter(F.col("n") * F.col("top") >= F.col("s")).groupBy(*group).agg(F.min(state).alias("r")).select(*group, "r.*")


def clock_offsets(turns: DataFrame) -> DataFrame:
    """session_id, offset_s, offset_residual, constraints: the assistant's clock against the user's, in seconds.

    The offset d has the least sum of squared violations, max(0, low - d) and max(0, d - high), over all bounds. Where all can be met, that is
    the d between the largest lower and the least upper bound that is nearest to 0, so a session with sound clocks gets exactly 0. Where not, the sum
    has one minimum between them, found in two levels: BINS counts a session, then the bounds of one bin. The residual
    is the root mean square of the violations over all bounds: 0 if the session is feasible."""
    e = _bounds(turns)
    span = _span(e)
    bad = span.filter("lo > hi").select("session_id", "lo", "hi")
    x = e.join(bad, "session_id").filter((F.col("low") & (F.col("v") > F.col("hi"))) | (~F.col("low") & (F.col("v") < F.col("lo"))))
    x = x.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("hi")) / (F.col("lo") - F.col("hi")) * BINS)))
    sums = [F.coalesce(F.sum(F.when(k, y)), F.lit(0.0)).alias(n) for n, k, y in (("low_n", F.col("low"), F.lit(1.0)), ("low_s", F.col("low"), F.col("v")), ("high_n", ~F.col("low"), F.lit(1.0)), ("high_s", ~F.col("low"), F.col("v")))]
    none = {"base_n": F.lit(0.0), "base_s": F.lit(0.0)}
    bins = x.groupBy("session_id", "bin").agg(F.max("v").alias("top"), *sums).withColumns(none)
    # broken throughout the bin: the lower bounds of later bins and the upper ones of earlier ones
    at = _first_root(bins, ["session_id"], "bin").select("session_id", "bin", F.col("rest_n").alias("base_n"), F.col("rest_s").alias("base_s"))
    inside = x.join(at, ["session_id", "bin"]).groupBy("session_id", "v", "base_n", "base_s").agg(*sums).withColumn("top", F.col("v"))
    best = _first_root(inside, ["session_id"], "v").select("session_id", (F.col("broken_s") / F.col("broken_n")).alias("best"))
    d = span.join(best, "session_id", "left").select("session_id", F.coalesce("best", "met").alias("d"))
    broken = F.when(F.col("low"), F.col("v") - F.col("d")).otherwise(F.col("d") - F.col("v"))
    left = e.join(d, "session_id").select("session_id", "d", F.greatest(broken, F.lit(0.0)).alias("x")).groupBy("session_id").agg(F.first("d").alias("d"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("r"), F.count(F.lit(1)).alias("constraints"))
    return left.select("session_id", (F.col("d") / 1e6).alias("offset_s"), (F.col("r") / 1e6).alias("offset_residual"), "constraints")


def corrected_messages(turns: DataFrame, reject: bool = True) -> DataFrame:
    """session_id, msg_no, role, chat_id, at: the messages of the conversations, merged by their corrected times.

    Conversations whose bounds no offset meets are left out, or, without reject, keep each reply right after its question. So does a reply without time. Numbers are
    made in two levels, by day."""
    feasible = F.col("hi").isNull() | F.col("lo").isNull() | (F.col("lo") <= F.col("hi"))
    kept = _span(_bounds(turns)).select("session_id", F.col("met").cast("bigint").alias("d"), feasible.alias("feasible"))
    kept = kept.filter("feasible") if reject else kept
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = t("create_time")
    reply = F.when(F.col("feasible"), F.coalesce(t("update_time") + F.col("d"), own)).otherwise(own)
    role = F.array(F.struct(F.lit(1).alias("k"), F.lit("user").alias("role"), own.alias("us")), F.struct(F.lit(2).alias("k"), F.lit("assistant").alias("role"), reply.alias("us")))
    rows = turns.join(kept, "session_id").select("session_id", "turn_no", "chat_id", F.explode(role).alias("r")).select("session_id", "turn_no", "chat_id", "r.*", F.floor(F.col("r.us") / 1_000_000).alias("s"))
    out = numbered(rows, ["session_id"], ["us", "turn_no", "k"], "s", "msg_no")
    return out.select("session_id", F.col("msg_no").cast("bigint").alias("msg_no"), "role", "chat_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("at"))


def messages(chats: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, msg_no, role, chat_id: the kept conversations, merged by corrected times. Contradicting bounds are no reason to reject by the statement; where they can
    be met, the corrected order is the statement's (question i, its reply, question i + 1)."""
    return corrected_messages(ordered_turns(chats, sessions), reject=False).select("session_id", "msg_no", "role", "chat_id")
