"""Problem 7: items of varying length in containers of fixed capacity, by hierarchical residual packing.

1. An item larger than a container gets as many full containers as it fills; its rest is packed like any other item. Items
   without size are left out.
2. Level 0: each partition packs its items best-fit decreasing. Bins with at most SLACK of the capacity unused are emitted;
   the others, underfull, become items.
3. Each further level gathers the underfull bins of FAN partitions and packs them again: bins join bins, and bins that stay
   poor (under half full) are opened so that their parts can move. This goes on until one partition is left; what it leaves
   underfull is emitted. As a partition leaves no two bins that would fit into one, each is over half full but one, and a level passes on at
   most KEEP bins of each partition: all others are emitted as they are, so no task gets more than FAN * KEEP bins at any size. KEEP is a bound on a task, not on the items: nothing is
   lost by it, only a bin beyond it may go out with more than SLACK unused (with PARTITION_ITEMS of 8,000 items a partition seldom leaves that many).

Only (id, size, bin) rows are shuffled, never texts. Containers are named by their least item.

Defined cases: repeated rows of an item count once (the larger size); null ids take no part; ties go by id, so
the result is the same whatever the partitioning's order inside a partition; an empty table gives no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, SLACK, FAN, KEEP, PARTITION_ITEMS = 4096, 0.004, 8, 2000, 8000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of the items in each bin: by falling size, each into the fullest bin that has room."""
    from bisect import bisect_left, insort

    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        if left > sizes[i]:
            insort(room, (left - sizes[i], b))
    return bins


def pack_level(pdf: pd.DataFrame, capacity: int, slack: float, keep: int, last: bool) -> pd.DataFrame:
    """Rows (item, tokens, bin, done) of one partition packed again; bin is the least item of a bin."""
    order = pdf.sort_values(["bin", "item"], kind="stable")
    items, tokens, bins = order["item"].to_numpy(), order["tokens"].to_numpy(), order["bin"].to_numpy()
    heads = [i for i in range(len(bins)) if i == 0 or bins[i] != bins[i - 1]]
    units: list[tuple[list[int], list[int]]] = []
    for a, b in zip(heads, [*heads[1:], len(bins)]):
        own, size = items[a:b].tolist(), tokens[a:b].tolist()
        if sum(size) * 2 < capacity:
            units += [([i], [t]) for i, t in zip(own, size)]
        else:
            units.append((own, size))
    units.sort(key=lambda u: u[0][0])
    packed = best_fit([sum(t) for _, t in units], capacity)
    full = [(sum(sum(units[k][1]) for k in b), b) for b in packed]
    full.sort(key=lambda x: (-x[0], units[x[1][0]][0][0]))
    open_from = 0 if last else max(0, len(full) - keep)
    rows = []
    for n, (total, b) in enumerate(full):
        items = [i for k in b for i in units[k][0]]
        done = last or total >= capacity * (1 - slack) or n < open_from
        rows += [(i, t, min(items), done) for k in b for i, t in zip(*units[k])]
    return pd.DataFrame(rows, columns=["item", "tokens", "bin", "done"])


def containers(sizes: DataFrame, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """doc_id, part, tokens, container: part numbers the pieces of an item larger than a container, else 0."""
    spark = sizes.sparkSession
    items = sizes.filter(F.col("doc_id").isNotNull() & (F.col("tokens") > 0)).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    from voltlake.session import cut

    items = cut(items)  # numbers only; the texts are tokenised once
    whole = F.floor(F.col("tokens") / capacity)
    pieces = items.filter(F.col("tokens") > capacity).select("doc_id", F.explode(F.sequence(F.lit(1), whole.cast("int"))).alias("part"))
    full = pieces.select("doc_id", "part", F.lit(capacity).cast("bigint").alias("tokens"), F.concat_ws("-", "doc_id", "part").alias("container"))
    rest = items.select("doc_id", F.when(F.col("tokens") > capacity, whole + 1).otherwise(0).cast("int").alias("part"), F.when(F.col("tokens") > capacity, F.col("tokens") % capacity).otherwise(F.col("tokens")).alias("tokens"))
    rest = rest.filter("tokens > 0").select(F.col("doc_id").alias("item"), "part", "tokens")
    n = max(1, -(-rest.count() // PARTITION_ITEMS))

    def level(df: DataFrame, last: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(batches)
            if parts:
                yield pack_level(pd.concat(parts), capacity, slack, KEEP, last)

        return df.mapInPandas(run, "item bigint, tokens bigint, bin bigint, done boolean")

    spread = rest.select("item", "tokens", F.col("item").alias("bin")).repartition(n, F.xxhash64("item"))
    now = cut(level(spread, n == 1))
    out = now.filter("done")
    while n > 1:
        n = -(-n // FAN)
        now = cut(level(now.filter("not done").select("item", "tokens", "bin").repartition(n, F.xxhash64("bin")), n == 1))
        out = out.unionByName(now.filter("done"))
    placed = rest.select(F.col("item").alias("doc_id"), "part", F.col("tokens").alias("t")).join(out.select(F.col("item").alias("doc_id"), "bin"), "doc_id")
    placed = placed.select("doc_id", "part", F.col("t").alias("tokens"), F.col("bin").cast("string").alias("container"))
    return full.unionByName(placed)
