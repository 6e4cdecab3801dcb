"""Problem 1: the most similar vectors of every vector, by a forest of random-projection trees.

1. Fit: from a bounded sample (SAMPLE vectors a field) each of TREES trees gets random directions and, at each node, the
   sample's median as threshold. The depth follows the number of rows, as far as the sample reaches (8 of its vectors a leaf).
2. Route: every vector goes to its home leaf in each tree. Then one priority queue shared by all trees, ordered by the sum of the distances
   to the thresholds that a path crosses, gives its PROBES next leaves, best first; a leaf taken from the queue puts its own deviations into it. Rows travel as
   4-bit codes, packed into one row for each (leaf, batch).
3. Search: a leaf of over 2 * LEAF members is split further in its task, by random directions at the medians of its own members, so leaves stay near LEAF at any size of the
   table. Each leaf compares its vectors in blocks and keeps, for each vector, all that may be among its k nearest and may reach
   the least similarity: coded cosines err by at most SLACK, so these are the ones within 2 * SLACK of the k-th best.
4. Rerank: candidate pairs meet the vectors' 16-bit codes once more (error of the cosine below 1e-4) and the k best of each
   vector are taken.

Copies: thresholds are medians, so only vectors of one code can overfill a leaf (vectors that differ but share a 4-bit code are compared with each other). Of equal
vectors only the k + 1 least ids enter the comparison; any other copy's k most similar are the k least ids, at cosine 1. Groups that hold over 1 / HOT of all
rows (so at most HOT a field) leave before the search, all others inside their leaf.

Usable vectors have WIDTH finite values, not all zero. Defined cases: null or unusable vectors and null ids take no part; an id counts once
(repeated rows have the same vector; of different ones each counts for itself); equal similarities are ordered by id; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH, K, LEAST = 64, 10, 0.90
SAMPLE, TREES, LEAF, PROBES, HOT, SEED = 20_000, 7, 1500, 3, 1000, 17
SLACK = 0.06  # three standard errors of a cosine of 4-bit codes


def _unit(column: pa.Array, width: int):
    """Rows of the list column as unit vectors (float32), with the positions of the usable ones."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, int)
    right = np.asarray(column.is_valid()) & (lengths == width)
    at = np.flatnonzero(right)
    if not len(at):
        return np.zeros((0, width), np.float32), at
    flat = column.take(pa.array(at)).flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norm = np.sqrt((v * v).sum(1))
    big = ~np.isfinite(norm) & np.isfinite(v).all(1)
    if big.any():
        v[big] /= np.abs(v[big]).max(1)[:, None]
        norm[big] = np.sqrt((v[big] ** 2).sum(1))
    tiny = (norm == 0) & (v != 0).any(1)
    if tiny.any():
        v[tiny] /= np.abs(v[tiny]).max(1)[:, None]
        norm[tiny] = np.sqrt((v[tiny] ** 2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return (v[good] / norm[good][:, None]).astype(np.float32), at[good]


def fit_forest(sample, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> dict:
    """Directions (width x trees*depth) and thresholds (trees x nodes, in heap order, node 1 being the root) from the sample (n x width)."""
    import numpy as np

    reach = max(0, int(math.log2(max(1, len(sample)) / 8))) if len(sample) >= 8 else 0
    depth = max(0, min(reach, math.ceil(math.log2(max(1, rows) / leaf))))
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((sample.shape[1], trees * depth)).astype(np.float32)
    directions /= np.maximum(np.linalg.norm(directions, axis=0, keepdims=True), 1e-9) if depth else 1
    proj = sample @ directions
    cuts = np.zeros((trees, 1 << depth), np.float32)
    for t in range(trees):
        node = np.ones(len(sample), np.int64)
        for d in range(depth):
            x = proj[:, t * depth + d]
            order = np.lexsort((x, node))
            groups, first, count = np.unique(node[order], return_index=True, return_counts=True)
            cuts[t, groups] = (x[order][first + (count - 1) // 2] + x[order][first + count // 2]) / 2
            node = 2 * node + (x > cuts[t, node])
    return {"directions": directions, "cuts": cuts, "depth": depth, "trees": trees}


def route(forest: dict, unit, probes: int = PROBES):
    """(tree, leaf) of each vector: homes (n x trees), and the probes best leaves of the queue shared by all trees (n x probes)."""
    import numpy as np

    n, depth, trees = len(unit), forest["depth"], forest["trees"]
    if not depth:
        return np.zeros((n, trees), np.int64) + np.arange(trees), np.zeros((n, 0), np.int64)
    proj, row = unit @ forest["directions"], np.arange(n)

    def walk(tree, node, start):
        """Down from a node at level start (each an array): the leaf, the margins crossed and the siblings left aside at each level."""
        margins, aside = np.full((n, depth), np.inf, np.float32), np.zeros((n, depth), np.int64)
        for d in range(depth):
            go = d >= start
            x = proj[row, tree * depth + d] - forest["cuts"][tree, np.where(go, node, 1)]
            down = 2 * node + (x > 0)
            margins[:, d] = np.where(go, np.abs(x), np.inf)
            aside[:, d] = np.where(go, down ^ 1, 0)
            node = np.where(go, down, node)
        return node, margins, aside

    homes, costs, nodes, of = np.empty((n, trees), np.int64), [], [], []
    for t in range(trees):
        leaf, margins, aside = walk(np.full(n, t), np.ones(n, np.int64), np.zeros(n, np.int64))
        homes[:, t] = leaf * trees + t
        costs.append(margins)
        nodes.append(aside)
        of += [t * depth + d for d in range(depth)]
    cost, node, place = np.hstack(costs), np.hstack(nodes), np.tile(np.array(of), (n, 1))
    probed = np.empty((n, probes), np.int64)
    for p in range(probes):
        best = cost.argmin(1)
        spent, side, at = cost[row, best], node[row, best], place[row, best]
        cost[row, best] = np.inf
        tree, level = at // depth, at % depth
        leaf, margins, aside = walk(tree, side, level + 1)
        probed[:, p] = leaf * trees + tree
        if p + 1 < probes:  # the leaf's own deviations join the queue
            cost, node = np.hstack([cost, spent[:, None] + margins]), np.hstack([node, aside])
            place = np.hstack([place, tree[:, None] * depth + np.arange(depth)])
    return homes, probed


def code4(unit):
    """4-bit codes of unit vectors, two a byte; only their directions matter."""
    import numpy as np

    c = (np.rint(unit * (7.49 / np.abs(unit).max(1, keepdims=True))) + 8).astype(np.uint8)
    if c.shape[1] % 2:
        c = np.hstack([c, np.full((len(c), 1), 8, np.uint8)])
    return c[:, ::2] << 4 | c[:, 1::2]


def decode4(code):
    import numpy as np

    out = np.empty((len(code), 2 * code.shape[1]), np.float32)
    out[:, ::2], out[:, 1::2] = code >> 4, code & 15
    return out - 8


def code16(unit):
    import numpy as np

    return np.rint(unit * (32767 / np.abs(unit).max(1, keepdims=True))).astype(np.int16)


def keys(unit):
    """A 64-bit key for each vector, equal for equal ones."""
    import numpy as np

    odd = np.random.default_rng(5).integers(1, 1 << 62, unit.shape[1], dtype=np.int64) * 2 + 1
    x = np.ascontiguousarray(unit + np.float32(0)).view(np.int32).astype(np.int64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> 15)) * np.int64(0x2545F4914F6CDD1D)
        return ((x ^ (x >> 29)) * odd).sum(1)


def _packed(forest_of: dict, fields: list[str], width: int, probes: int):
    """Batches of (id, vectors) to rows (field, leaf, block, ids, members, codes): one for each leaf and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for f in fields:
                unit, at = _unit(b.column(b.schema.get_field_index(f)), width)
                ids = b.column(b.schema.get_field_index("id")).take(pa.array(at))
                if not len(at):
                    continue
                homes, probed = route(forest_of[f], unit, probes)
                code, key = code4(unit), keys(unit).astype(np.int32)
                leaf = np.concatenate([homes.ravel(), probed.ravel()])
                row = np.concatenate([np.repeat(np.arange(len(at)), homes.shape[1]), np.repeat(np.arange(len(at)), probed.shape[1])])
                member = np.arange(len(leaf)) < homes.size
                order = np.argsort(leaf, kind="stable")
                leaf, row, member = leaf[order], row[order], member[order]
                starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
                ends = np.r_[starts[1:], len(leaf)]
                offsets = pa.array(np.r_[starts, len(leaf)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f] * len(starts), pa.string()), pa.array(leaf[starts]),
                        pa.ListArray.from_arrays(offsets, ids.take(pa.array(row))),
                        pa.array([member[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                        pa.array([code[row[s:e]].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                        pa.array([key[row[s:e]].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                    ],
                    names=["field", "leaf", "ids", "member", "codes", "keys"],
                )

    return run


PACKED = "field string, leaf bigint, ids array<string>, member binary, codes binary, keys binary"


def leaf_pairs(codes, m, query, ids, k: int, least: float, slack: float = SLACK):
    """(i, j) of candidates among positions (members m, queries): j may be among the k members nearest to i and no further than least, by the coding error. In blocks of 512 queries."""
    import numpy as np

    def unit(at):
        u = decode4(codes[at])
        return u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-9)

    members, left, right = unit(m), [], []
    for s in range(0, len(query), 512):
        q = query[s : s + 512]
        c = unit(q) @ members.T
        i, j = np.nonzero(c >= least - slack)
        other = ids[q[i]] != ids[m[j]]
        i, j = i[other], j[other]
        if not len(i):
            continue
        order = np.lexsort((-c[i, j], i))
        i, j = i[order], j[order]
        near, first = c[i, j], np.searchsorted(i, np.arange(len(q) + 1))
        kth = np.full(len(q), least, np.float32)  # with fewer than k all stay
        full = np.diff(first) >= k
        kth[full] = near[first[:-1][full] + k - 1]
        near = near >= kth[i] - 2 * slack
        left.append(q[i[near]])
        right.append(m[j[near]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def split_leaf(codes, member, query, most: int, seed: int = SEED):
    """Parts (members, queries) of a leaf with at most `most` members each, as positions: split by random directions at the medians of the members. A part whose members
    all have one code stays whole."""
    import numpy as np

    rng = np.random.default_rng(seed)
    todo, out = [(np.flatnonzero(member), query)], []
    while todo:
        m, q = todo.pop()
        if len(m) <= most:
            out.append((m, q))
            continue
        for _ in range(4):
            w = rng.standard_normal(2 * codes.shape[1]).astype(np.float32)
            xm = decode4(codes[m]) @ w
            cut = np.median(xm)
            high = xm > cut
            if not high.any():  # more than half share the greatest value
                high = xm >= cut
            if high.any() and not high.all():
                break
        else:
            out.append((m, q))
            continue
        xq = decode4(codes[q]) @ w
        above = xq > cut if (xm[high] > cut).all() else xq >= cut
        todo += [(m[high], q[above]), (m[~high], q[~above])]
    return out


def _search(k: int, least: float, width: int, leaf: int = LEAF):
    def run(key, table):
        import numpy as np

        field = key[0].as_py()
        ids = np.array(table.column("ids").combine_chunks().flatten().to_pylist(), object)
        member = np.concatenate([np.frombuffer(x, bool) for x in table.column("member").to_pylist()])
        codes = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, (width + 1) // 2) for x in table.column("codes").to_pylist()])
        vector = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("keys").to_pylist()])
        # an id counts once, at home if it is; rows go by id, so that of copies the least ids come first
        order = np.lexsort((~member, ids.astype(str)))
        ids, member, codes, vector = ids[order], member[order], codes[order], vector[order]
        once = ~pd.DataFrame({"i": ids, "v": vector, "c": codes[:, 0]}).duplicated().to_numpy()
        ids, member, codes, vector = ids[once], member[once], codes[once], vector[once]
        vector = pd.factorize(pd.Series([c.tobytes() + v.tobytes() for c, v in zip(codes, vector)]))[0]
        v = pd.Series(vector)
        nth = v.groupby(v).cumcount().to_numpy()
        extra = np.flatnonzero(nth > k)
        heads = pd.Series(np.flatnonzero(nth < k)).groupby(vector[nth < k]).apply(list) if len(extra) else {}
        copies = [(e, h) for e in extra for h in heads[vector[e]]]
        query = np.flatnonzero(nth <= k)
        member &= nth <= k
        i, j = (np.concatenate(x) for x in zip(*(leaf_pairs(codes, m, q, ids, k, least) for m, q in split_leaf(codes, member, query, 2 * leaf)), strict=True))
        if copies:
            i, j = np.r_[i, [x for x, _ in copies]], np.r_[j, [x for _, x in copies]]
        # ids are sorted, so their numbers compare as they do; a dense leaf may give millions of pairs
        number = np.cumsum(np.r_[True, ids[1:] != ids[:-1]])[: len(ids)] - 1
        names = pa.array(ids[np.r_[True, ids[1:] != ids[:-1]][: len(ids)]], pa.string())
        a, b = number[i], number[j]
        pairs = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
        id_a, id_b = names.take(pa.array(pairs // len(ids))), names.take(pa.array(pairs % len(ids)))
        return pa.table({"field": pa.array([field] * len(pairs), pa.string()), "id_a": id_a, "id_b": id_b})

    return run


def _codes16(fields: list[str], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in fields:
                unit, at = _unit(b.column(b.schema.get_field_index(f)), width)
                if len(at):
                    ids = b.column(b.schema.get_field_index("id")).take(pa.array(at))
                    code = code16(unit)
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(at), pa.string()), ids, pa.array([x.tobytes() for x in code], pa.binary())], names=["field", "id", "code"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    def unit(column):
        v = np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), -1).astype(np.float64)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    for b in batches:
        if b.num_rows:
            c = (unit(b.column(3)) * unit(b.column(4))).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(c)], names=["field", "id_a", "id_b", "cosine"])


def _without_copies(data: DataFrame, fields: list[str], k: int, width: int, total: int):
    """(rows to search, pairs of the copies left out): at most HOT groups a field, each with k + 1 ids, reach the driver."""
    spark, left_out = data.sparkSession, []
    for f in fields:
        wide = data.filter(F.size(f) == width).select("id", F.xxhash64(f).alias("h"), F.hash(f).alias("g"), f)
        hot = wide.groupBy("h", "g").count().filter(F.col("count") > max(total / HOT, 4 * k))
        if not (groups := hot.collect()):
            continue
        small = F.broadcast(spark.createDataFrame([(r.h, r.g) for r in groups], "h bigint, g int"))  # at most HOT rows
        finite = F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(f, lambda x: x != 0)
        own = wide.join(small, ["h", "g"]).filter(finite).select("id", "h", "g").distinct()
        head = own.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).filter(F.col("r") <= k + 1)
        heads = head.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("heads")).toArrow()  # at most HOT * (k + 1) ids
        heads = F.broadcast(spark.createDataFrame(heads.to_pandas(), "h bigint, g int, heads array<string>"))
        rest = own.join(heads, ["h", "g"]).filter(~F.array_contains("heads", F.col("id")))
        pairs = rest.select("id", F.explode(F.slice("heads", 1, k)).alias("o")).select(
            F.lit(f).alias("field"), F.least("id", "o").alias("id_a"), F.greatest("id", "o").alias("id_b"), F.lit(1.0).alias("cosine")
        )
        left_out.append(pairs)
        marked = data.withColumns({"h": F.xxhash64(f), "g": F.hash(f)}).join(heads, ["h", "g"], "left")
        gone = F.col("heads").isNotNull() & ~F.array_contains("heads", F.col("id"))
        data = marked.select("id", *(F.when(~F.coalesce(gone, F.lit(False)), F.col(f)).alias(f) if x == f else F.col(x) for x in fields))
    if not left_out:
        return data, None
    out = left_out[0]
    for x in left_out[1:]:
        out = out.unionByName(x)
    return data, out


def similar_pairs(
    rows: DataFrame, vectors: dict[str, str], k: int = K, least: float = LEAST, trees: int = TREES, leaf: int = LEAF, probes: int = PROBES, width: int = WIDTH
) -> DataFrame:
    """field, id_a < id_b, cosine: one of the two is among the other's k most similar, with a cosine of least or more.

    rows has id and the vector columns; vectors maps a column to its field's name."""
    spark = rows.sparkSession
    fields = list(vectors.values())
    data = rows.filter(F.col("id").isNotNull()).select("id", *(F.col(c).cast("array<double>").alias(f) for c, f in vectors.items()))
    total = rows.count()
    forests = {}
    for f in fields:
        some = data.filter(F.size(f) == width).select(f).sample(min(1.0, 1.3 * SAMPLE / max(1, total)), seed=SEED).limit(SAMPLE).toArrow()
        forests[f] = fit_forest(_unit(some.column(0), width)[0], total, trees, leaf)
    search, copies = _without_copies(data, fields, k, width, total)
    sent = spark.sparkContext.broadcast(forests)  # directions and at most SAMPLE / 4 thresholds a tree: under 1 MB

    def packed(batches):
        return _packed(sent.value, fields, width, probes)(batches)

    packs = search.mapInArrow(packed, PACKED)
    found = packs.groupBy("field", "leaf").applyInArrow(_search(k, least, width, leaf), "field string, id_a string, id_b string")
    pairs = found.distinct()
    codes = search.mapInArrow(_codes16(fields, width), "field string, id string, code binary").groupBy("field", "id").agg(F.max("code").alias("code"))
    a = codes.select("field", F.col("id").alias("id_a"), F.col("code").alias("code_a"))
    b = codes.select("field", F.col("id").alias("id_b"), F.col("code").alias("code_b"))
    cos = pairs.join(a, ["field", "id_a"]).join(b, ["field", "id_b"]).select("field", "id_a", "id_b", "code_a", "code_b")
    cos = cos.mapInArrow(_cosines, "field string, id_a string, id_b string, cosine double").filter(F.col("cosine") >= least)
    both = cos.select("field", F.explode(F.array(F.struct(F.col("id_a").alias("q"), F.col("id_b").alias("o")), F.struct(F.col("id_b").alias("q"), F.col("id_a").alias("o")))).alias("p"), "cosine")
    rank = F.row_number().over(Window.partitionBy("field", "p.q").orderBy(F.desc("cosine"), "p.o"))
    best = both.withColumn("rank", rank).filter(F.col("rank") <= k).select("field", F.least("p.q", "p.o").alias("id_a"), F.greatest("p.q", "p.o").alias("id_b"), "cosine")
    if copies is not None:
        best = best.unionByName(copies)
    return best.groupBy("field", "id_a", "id_b").agg(F.max("cosine").alias("cosine"))
