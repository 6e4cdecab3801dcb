"""Event operators, each for a batch and for a stream: ordered assembly, retention, anchored limiter, duplicate guard.

The streaming twins give the batch results once all input is read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("done", "error")


def assemble(events: DataFrame) -> DataFrame:
    """task_id, content, state of events (task_id, sequence, event_type, content): deltas in order; a done event's own content, if not empty, stands
    for all; the first terminal event decides the state; repeated sequences count once. A task's deltas are one answer, so a group is bounded by an answer."""
    once = events.filter("task_id is not null").groupBy("task_id", "sequence").agg(F.max(F.struct("event_type", "content")).alias("e")).select("task_id", "sequence", "e.*")
    g = once.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("event_type") == "delta", F.struct("sequence", F.coalesce("content", F.lit("")).alias("content"))))).alias("d"),
        F.min(F.when(F.col("event_type").isin(*TERMINAL), F.struct("sequence", "event_type"))).alias("end"),
        F.min(F.when((F.col("event_type") == "done") & (F.coalesce("content", F.lit("")) != ""), F.struct("sequence", "content"))).alias("own"),
    )
    text = F.array_join(F.transform("d", lambda x: x["content"]), "")
    return g.select("task_id", F.coalesce(F.col("own.content"), text).alias("content"), F.coalesce(F.col("end.event_type"), F.lit("open")).alias("state"))


def retained(events: DataFrame, most: int = 2000, now: float | None = None, ttl: float = 300.0) -> DataFrame:
    """The last `most` entries of each task; with now, a time in the unit of the column seconds, tasks whose last entry is more than ttl older are gone."""
    if now is not None:
        last = F.max("seconds").over(Window.partitionBy("task_id"))
        events = events.withColumn("_last", last).filter(F.col("_last") >= now - ttl).drop("_last")
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("sequence")))
    return events.withColumn("r", rank).filter(F.col("r") <= most).drop("r")


def islands(hits: DataFrame, key: str, seconds: str, gap: float) -> DataFrame:
    """Adds island: the number of the hit's run in its key; a pause of `gap` or more starts a new one.

    Two levels: inside a day, and over the days' first and last hits, so a busy key is spread over its days."""
    d = hits.withColumn("_day", F.floor(F.col(seconds) / 86_400))
    days = d.groupBy(key, "_day").agg(F.max(seconds).alias("_last"))
    days = days.withColumn("_prev", F.lag("_last").over(Window.partitionBy(key).orderBy("_day"))).drop("_last")
    day = Window.partitionBy(key, "_day").orderBy(seconds)
    x = d.join(days, [key, "_day"]).withColumn("_p", F.coalesce(F.lag(seconds).over(day), F.col("_prev")))
    x = x.withColumn("_new", F.coalesce((F.col(seconds) - F.col("_p") >= gap).cast("int"), F.lit(1)))
    sums = x.groupBy(key, "_day").agg(F.sum("_new").alias("_s"))
    sums = sums.select(key, "_day", F.coalesce(F.sum("_s").over(Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    run = F.sum("_new").over(day.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumn("_run", run).join(sums, [key, "_day"]).withColumn("island", F.col("_run") + F.col("_b")).drop("_day", "_prev", "_p", "_new", "_run", "_b")


def _exits(times, window: int):
    """Of sorted times: (upto, exits, after). A window that opens at a time up to upto[i] (and after upto[i - 1]) leads, window after window, to the last one,
    that opens at exits[i] and holds after[i] of the times. Where windows meet they stay together, so these are few."""
    import numpy as np

    n = len(times)
    following = np.searchsorted(times, times + window)
    last = list(range(n))
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            last[i] = last[following[i]]
    ends = [i for i in range(n) if i == n - 1 or last[i + 1] != last[i]]
    return [int(times[i]) for i in ends], [int(times[last[i]]) for i in ends], [n - last[i] for i in ends]


def limiter(hits: DataFrame, key: str, seconds: str, order: str, most: int, window: float) -> DataFrame:
    """Adds allowed: fixed windows that start at the first hit after the last window's end; denied hits don't extend it.

    Where a window opens depends on all hits before it, so time is cut into chunks of four windows (an hour at least). Each chunk by itself tells where it leads
    from any window it may be entered with; these short tables are composed along a key, and then each chunk is judged from its true entry. So a key that never pauses is
    spread over its chunks. The folds run in Arrow batches of many chunks. Times are compared in microseconds, ties go by order; rows without key
    or time take no part; equal rows count each."""
    size, w = int(max(4 * window, 3600) * 1_000_000), int(round(window * 1_000_000))
    t = F.round(F.col(seconds) * 1_000_000).cast("bigint")
    names = hits.columns
    rows = hits.filter(F.col(key).isNotNull() & F.col(seconds).isNotNull()).select(F.col(key).alias("_k"), F.floor(t / size).alias("_c"), F.struct(t.alias("t"), F.col(order).alias("o"), F.struct(*names).alias("row")).alias("h"))
    chunks = rows.groupBy("_k", "_c").agg(F.sort_array(F.collect_list("h")).alias("h"))
    kind = dict(chunks.dtypes)["_k"]

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            found = [_exits(np.array(x, np.int64), w) for x in b.column(2).to_pylist()]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, pa.array([len(x) for x in b.column(2)], pa.int64())], names=["_k", "_c", "upto", "exits", "after", "n"])

    tables = chunks.select("_k", "_c", F.col("h.t").alias("t")).mapInArrow(leads, f"_k {kind}, _c bigint, upto array<bigint>, exits array<bigint>, after array<bigint>, n bigint")
    along = tables.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_c", "upto", "exits", "after", "n"))).alias("x"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        for b in batches:
            out = []
            for chunks_of in b.column(1).to_pylist():
                start, n, entries = None, 0, []
                for c in chunks_of:
                    entries.append({"_c": c["_c"], "start": start, "n": n})
                    i = 0 if start is None else bisect_left(c["upto"], start + w)
                    if i == len(c["upto"]):
                        n += c["n"]
                    else:
                        start, n = c["exits"][i], c["after"][i]
                out.append(entries)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("_c", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])))], names=["_k", "e"])

    entries = along.mapInArrow(compose, f"_k {kind}, e array<struct<_c: bigint, start: bigint, n: bigint>>").select("_k", F.inline("e"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for times, start, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                one = []
                for x in times:
                    if start is None or x - start >= w:
                        start, n = x, 0
                    n += 1
                    one.append(n <= most)
                out.append(one)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.bool_()))], names=["row", "allowed"])

    inner = chunks.schema["h"].dataType.elementType["row"].dataType.simpleString()
    judged = chunks.join(entries, ["_k", "_c"]).select(F.col("h.row").alias("row"), F.col("h.t").alias("t"), "start", "n").mapInArrow(judge, f"row array<{inner}>, allowed array<boolean>")
    return judged.select(F.explode(F.arrays_zip("row", "allowed")).alias("x")).select("x.row.*", "x.allowed")


def guarded(deliveries: DataFrame, key: str, seconds: str, order: str, failed: str, window: float = 600.0) -> DataFrame:
    """Deliveries (with a boolean failed) that pass the duplicate guard: the first locks its key for window seconds, a failed one sets it free at once.

    A failed delivery changes nothing for those after it, so it passes whenever the key is free: the guard is the limiter over the others, and failed ones pass
    where no lock of theirs is open."""
    good = limiter(deliveries.filter(~F.coalesce(failed, F.lit(False))), key, seconds, order, 1, window).filter("allowed").drop("allowed")
    locks = good.select(F.col(key).alias("_k"), F.struct(F.col(seconds).alias("t"), F.col(order).alias("o")).alias("_at"))
    bad = deliveries.filter(F.coalesce(failed, F.lit(False)) & F.col(key).isNotNull() & F.col(seconds).isNotNull())
    both = bad.select(F.col(key).alias("_k"), F.struct(F.col(seconds).alias("t"), F.col(order).alias("o")).alias("_at"), F.struct(*deliveries.columns).alias("row")).unionByName(locks, allowMissingColumns=True)
    both = both.withColumn("_c", F.floor(F.col("_at.t") / window))
    tops = both.filter("row is null").groupBy("_k", "_c").agg(F.max("_at").alias("_top")).withColumn("_c", F.col("_c") + 1)
    own = Window.partitionBy("_k", "_c").orderBy("_at")
    x = both.withColumn("_last", F.max(F.when(F.col("row").isNull(), F.col("_at"))).over(own)).join(tops, ["_k", "_c"], "left")  # a lock may reach from the chunk before
    last = F.coalesce("_last", "_top")
    free = x.filter(F.col("row").isNotNull() & (last.isNull() | (F.col("_at.t") - last["t"] >= window))).select("row.*")
    return good.unionByName(free.select(*good.columns))


def assemble_stream(events: DataFrame, ttl: float | None = None) -> DataFrame:
    """Streaming twin of assemble(): a row for a task when its terminal event is there and all sequences before it; late repeats are dropped.

    The state is lists of what came, and the mark of a finished task. With ttl, both go `ttl` seconds (of processing) after the task's last event, and a
    task that goes without its end gives a row with state timeout and what stands without a gap. A stream that lasts needs it; one that only reads what
    there is (available now) ends only without it."""

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seqs, kinds, texts, out = state.get if state.exists else ([], [], [], False)
        if ttl and state.hasTimedOut:
            state.remove()
            if not out:
                have = dict(zip(seqs, zip(kinds, texts)))
                n = next(i for i in range(len(have) + 1) if i not in have)
                yield pd.DataFrame({"task_id": [key[0]], "content": ["".join(have[i][1] for i in range(n) if have[i][0] == "delta")], "state": ["timeout"]})
            return
        if not out:
            seqs, kinds, texts = list(seqs), list(kinds), list(texts)
            for pdf in batches:
                seqs += [int(x) for x in pdf.sequence]
                kinds += list(pdf.event_type)
                texts += [x or "" for x in pdf.content]
            have = dict(zip(seqs, zip(kinds, texts)))
            end = min((s for s, k in zip(seqs, kinds) if k in TERMINAL), default=None)
            if end is not None and all(i in have for i in range(end + 1)):
                order = sorted(have)
                own = next((have[s][1] for s in order if have[s][0] == "done" and have[s][1]), None)
                text = own if own is not None else "".join(have[s][1] for s in order if have[s][0] == "delta")
                yield pd.DataFrame({"task_id": [key[0]], "content": [text], "state": [have[end][0]]})
                seqs, kinds, texts, out = [], [], [], True
        state.update((seqs, kinds, texts, out))
        if ttl:
            state.setTimeoutDuration(int(ttl * 1000))

    from pyspark.sql.streaming.state import GroupStateTimeout

    kept = "seqs array<int>, kinds array<string>, texts array<string>, out boolean"
    return events.groupBy("task_id").applyInPandasWithState(fold, "task_id string, content string, state string", kept, "append", GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)


def tailed(events: DataFrame, user: str | None = None) -> DataFrame:
    """What a reader of one stream sees (task_id, sequence, event_type, content[, user_id], seconds since the reader came): all events in order up to the
    first done; an error event does not end it. With user, events of another user's task give one error event instead. Without done within 600 seconds a
    time-out event closes it. One row each: task_id, sequence, event_type, content."""
    limit = 600.0
    rows = events.filter("task_id is not null")
    end = F.min(F.when((F.col("event_type") == "done") & (F.col("seconds") <= limit), F.col("sequence")))
    ends = rows.groupBy("task_id").agg(end.alias("end"), F.max("sequence").alias("last"), (F.max((F.col("user_id") != user).cast("int")) == 1 if user else F.lit(False)).alias("other"))
    seen = rows.join(ends, "task_id").filter(~F.coalesce("other", F.lit(False)) & (F.col("seconds") <= limit) & (F.col("sequence") <= F.coalesce("end", "last")))
    closing = ends.filter(F.coalesce("other", F.lit(False)) | F.col("end").isNull()).select(
        "task_id", F.when(F.col("other"), 0).otherwise(F.col("last") + 1).cast("int").alias("sequence"), F.when(F.col("other"), "error").otherwise("timeout").alias("event_type"),
        F.when(F.col("other"), "user mismatch").otherwise("no end in time").alias("content"),
    )
    return seen.select("task_id", F.col("sequence").cast("int").alias("sequence"), "event_type", "content").unionByName(closing)


def limiter_stream(hits: DataFrame, key: str, seconds: str, order: str, most: int, window: float, ttl: float | None = None) -> DataFrame:
    """Streaming twin of limiter() over hits that come in order of time within a key: key, order, allowed. With ttl, a key's state goes `ttl` seconds
    (of processing) after its last hit, which a stream that lasts needs."""

    def fold(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if ttl and state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values([seconds, order])
        out = []
        for t in pdf[seconds]:
            if start is None or t - start >= window:
                start, n = float(t), 0
            n += 1
            out.append(n <= most)
        state.update((start, n))
        if ttl:
            state.setTimeoutDuration(int(max(ttl, window) * 1000))
        yield pd.DataFrame({key: [k[0]] * len(pdf), order: pdf[order], "allowed": out})

    from pyspark.sql.streaming.state import GroupStateTimeout

    types = dict(hits.dtypes)
    return hits.groupBy(key).applyInPandasWithState(fold, f"{key} {types[key]}, {order} {types[order]}, allowed boolean", "start double, n int", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)


def first_deliveries(events: DataFrame, keys: list[str], time: str = "ts", within: str = "10 minutes") -> DataFrame:
    """Streaming duplicate guard: one delivery of a key within the watermark."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drives a stream over all input there is now into Parquet files, exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
