"""Exact nearest neighbours of a stated query set, in blocks.

The corpus stays where it is scanned: each Arrow batch of it meets the queries in matrix products of BLOCK queries, and a task passes on only the k
best of each query. Queries are sent to the executors if they are at most SENT and have at most HITS neighbours (counted first), as each task passes on that many;
beyond, each pack of queries goes to one task, and the corpus comes by it (packs.py). With a group column, a query meets only vectors of its group.

Defined cases: unusable vectors (null, other width, not finite, all zero) and null keys take no part; ties go by id (as strings); empty
tables give no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators import packs as P

BLOCK, SENT, HITS, GATHERED, BESIDE = 1024, 50_000, 200_000, 16_000, 256  # the last two: vectors of the corpus at once beside a pack, and queries of a block there


def _rows(df: DataFrame, key: str, vector: str, width: int, group: str | None) -> DataFrame:
    grp = F.col(group).cast("string") if group else F.lit("")
    return df.filter(F.col(key).isNotNull() & (F.size(vector) == width) & grp.isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(vector).cast("array<double>").alias("v"), grp.alias("g"))


def _matrix(ids, vectors, groups, width: int):
    """(ids, unit vectors, groups) of the usable rows of Arrow columns, ordered by group and id."""
    import numpy as np

    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    names, g = np.array(ids.to_pylist(), str), np.array(groups.to_pylist(), str)
    n = np.sqrt((m * m).sum(1))
    ok = np.isfinite(n) & (n > 0)
    names, m, g = names[ok], m[ok] / n[ok][:, None], g[ok]
    order = np.lexsort((names, g))
    return names[order], m[order], g[order]


def _ranges(g):
    import numpy as np

    heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    return {str(g[a]): (int(a), int(b)) for a, b in zip(heads, np.r_[heads[1:], len(g)])}


def _nearest(best: dict, queries, corpus, k: int, block: int = BLOCK) -> None:
    """Keeps the k best (cosine, id) of each query in best: {(group, first query): (ids, cosines, names)}."""
    import numpy as np

    qi, qv, qg = queries
    mi, mv, mg = corpus
    there = _ranges(mg)
    for g, (qa, qb) in _ranges(qg).items():
        if g not in there:
            continue
        a, b = there[g]
        for s in range(qa, qb, block):
            e = min(qb, s + block)
            cos = qv[s:e] @ mv[a:b].T
            if b - a > k:
                # only what comes near the k best is rounded
                kth = np.partition(cos, b - a - k, axis=1)[:, b - a - k]
                rows, cols = np.nonzero(cos >= kth[:, None] - 2e-6)
                close = np.round(cos[rows, cols], 6)
                order = np.lexsort((cols, -close, rows))
                taken = order[np.searchsorted(rows, np.arange(e - s))[:, None] + np.arange(k)]
                near, cols = close[taken], cols[taken]
            else:
                cos = np.round(cos, 6)
                cols = np.argsort(-cos, axis=1, kind="stable")
                near = np.take_along_axis(cos, cols, 1)
            names = mi[a:b][cols]
            slot = (g, qi[s])
            if slot in best:
                _, c0, n0 = best[slot]
                near, names = np.hstack([c0, near]), np.hstack([n0, names])
                order = np.lexsort((names, -near), axis=1)[:, :k]
                near, names = np.take_along_axis(near, order, 1), np.take_along_axis(names, order, 1)
            best[slot] = (qi[s:e], near, names)


def exact_knn(queries: DataFrame, corpus: DataFrame, query_key: str, query_vector: str, corpus_key: str, corpus_vector: str, k: int, width: int = 64, group: str | None = None, sent: int = SENT) -> DataFrame:
    """query_key, corpus_key (strings), cosine (rounded to 6), rank. With group, a column of both sides, only rows of equal group are compared."""
    q, c = _rows(queries, query_key, query_vector, width, group), _rows(corpus, corpus_key, corpus_vector, width, group)
    n = q.count()

    schema = "q string, m string, cosine double"

    def rows_of(best: dict) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for ids, near, names in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, near.shape[1]).tolist(), pa.string()), pa.array(names.ravel().tolist(), pa.string()), pa.array(near.ravel())], names=["q", "m", "cosine"])

    def matrix(table):
        return _matrix(table.column("k"), table.column("v"), table.column("g"), width)

    if n <= sent and n * k <= HITS:
        asked = c.sparkSession.sparkContext.broadcast(matrix(q.toArrow()))  # at most `sent` vectors

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict = {}
            for b in batches:
                _nearest(best, asked.value, matrix(b), k)
            yield from rows_of(best)

        found = c.mapInArrow(scan, schema)
    else:

        def beside(blobs: Iterator[tuple[bool, pa.Table]]) -> Iterator[pa.RecordBatch]:
            asked_, queries, here, best = [], None, [], {}

            def done() -> None:
                if here:
                    _nearest(best, queries, matrix(P.whole(here)), k, BESIDE)
                here.clear()

            for is_asked, x in blobs:
                if is_asked:
                    asked_.append(_lengthened(x))
                elif asked_:
                    if queries is None:
                        queries = matrix(P.whole(asked_))
                    here.append(_lengthened(x))
                    if sum(map(len, here)) > GATHERED:
                        done()
            done()
            yield from rows_of(best)

        packs = P.number(c.sparkSession, n, SENT)
        found = P.meet(P.packed(q, "k", packs), P.blobs(c, lambda b: _shortened(pa.Table.from_batches([b])), 4000), packs, beside, schema)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "m"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("m").alias(corpus_key), "cosine", "rank")


def _shortened(table: pa.Table) -> pa.Table:
    """Vectors as floats where that loses nothing."""
    import numpy as np

    v = table.column("v").combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    wide = v.values.to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        short = wide.astype(np.float32)
    if v.values.null_count or not np.array_equal(short.astype(np.float64), wide, equal_nan=True):
        return table
    return table.set_column(table.schema.get_field_index("v"), "v", pa.ListArray.from_arrays(v.offsets, pa.array(short)))


def _lengthened(table: pa.Table) -> pa.Table:
    return table.set_column(table.schema.get_field_index("v"), "v", table.column("v").cast(pa.list_(pa.float64())))
