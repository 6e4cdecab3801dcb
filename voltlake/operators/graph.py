"""Trails in a property graph: bounded paths that repeat no edge, through via nodes, and their evidence text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.text import stripped

MOST = 10


def reachable(edges: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """node, left: nodes from which a target can be reached, and the least number of hops. Goes backwards from the targets, a cut front a hop."""
    from voltlake.session import cut

    found = front = cut(targets.select("node").distinct().withColumn("left", F.lit(0)))
    for h in range(1, hops + 1):
        step = edges.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        front = cut(step.join(found.select("node"), "node", "left_anti").withColumn("left", F.lit(h)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def trails(edges: DataFrame, starts: DataFrame, targets: DataFrame, hops: int = MOST) -> DataFrame:
    """start, node, nodes, edge_ids: all directed trails of 1 to `hops` edges (edge_id, src, dst) from the start nodes to the targets.

    An edge may not repeat, a node may. Each step is an equi-join on the last node; trails that can no longer reach a target in the hops left
    are dropped first. Each step's lineage is cut in the shared folder, so no step is computed twice."""
    from voltlake.session import cut

    near = reachable(edges, targets, hops)
    now = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edge_ids")).distinct()
    ends, out = targets.select("node").distinct(), None
    e = edges.select(F.col("edge_id").cast("string").alias("edge_id"), F.col("src").alias("node"), "dst").distinct()
    for h in range(1, hops + 1):
        step = now.join(e, "node").filter(~F.array_contains("edge_ids", F.col("edge_id")))
        step = step.select("start", F.col("dst").alias("node"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"))
        now = cut(step.join(near.filter(F.col("left") <= hops - h).select("node"), "node", "left_semi"))
        if now.isEmpty():
            break
        hit = now.join(ends, "node", "left_semi")
        out = hit if out is None else out.unionByName(hit)
    return now.select("start", "node", "nodes", "edge_ids") if out is None else out.select("start", "node", "nodes", "edge_ids")


def chained(legs: list[DataFrame]) -> DataFrame:
    """Trails of consecutive legs joined where one ends and the next starts; over the whole no edge repeats."""
    out = legs[0]
    for leg in legs[1:]:
        b = leg.select(F.col("start").alias("node"), F.col("node").alias("end"), F.col("nodes").alias("n2"), F.col("edge_ids").alias("e2"))
        j = out.join(b, "node").filter(~F.arrays_overlap("edge_ids", "e2"))
        out = j.select("start", F.col("end").alias("node"), F.concat("nodes", F.slice("n2", 2, F.size("n2"))).alias("nodes"), F.concat("edge_ids", "e2").alias("edge_ids"))
    return out


def evidence(trail_nodes: Column) -> Column:
    """First, next, ..., last: description of each node of (name, description) structs."""
    n = F.size(trail_nodes)
    said = F.transform(trail_nodes, lambda x, i: F.concat(F.when(i == 0, "首先，").when(i == n - 1, "最后，").otherwise("其次，"), x["name"], F.lit(":"), F.coalesce(x["description"], F.lit(""))))
    return F.array_join(said, ",")


def entities(names: Column) -> Column:
    """Trimmed, non-blank, each once, in order; null for fewer than two."""
    out = F.array_distinct(F.filter(F.transform(names, stripped), lambda s: s.isNotNull() & (s != "")))
    return F.when(F.size(out) >= 2, out)


def route(hits: Column, least: float = 0.4) -> Column:
    """Nodes to pass of aligned entities (array of node, score, in order): the first is the start, the last the end. Null if either is under `least`; weak ones between are dropped."""
    n = F.size(hits)
    good = lambda h: h["node"].isNotNull() & (h["score"] >= least)
    between = F.filter(F.slice(hits, 2, F.greatest(n - 2, F.lit(0))), good)
    stops = F.transform(F.concat(F.slice(hits, 1, 1), between, F.slice(hits, -1, 1)), lambda h: h["node"])
    return F.when((n >= 2) & F.coalesce(good(hits[0]) & good(F.element_at(hits, -1)), F.lit(False)), stops)


def named_nodes(nodes: DataFrame, names: list[str], labels: list[str]) -> list[DataFrame]:
    """For each stop the nodes (node_id, label, name) of its label and name; ValueError if the lists differ in length or have fewer than two."""
    if len(names) != len(labels) or len(names) < 2:
        raise ValueError("as many labels as names, and two at least")
    return [nodes.filter((F.col("label") == lb) & (F.col("name") == nm)).select(F.col("node_id").alias("node")) for nm, lb in zip(names, labels)]


def routed(edges: DataFrame, routes: DataFrame, hops: int = MOST) -> DataFrame:
    """request_id, nodes, edge_ids: all trails that pass the stops of each route (request_id, stops) in order, each leg of 1 to `hops` edges; over the whole no edge repeats.

    The legs of all routes are searched at once; then each route puts its legs together, one after the other."""
    from voltlake.session import cut

    r = routes.filter(F.size("stops") >= 2)
    i = F.sequence(F.lit(1), F.size("stops") - 1)
    legs = cut(r.select("request_id", F.posexplode(F.transform(i, lambda k: F.struct(F.element_at("stops", k).alias("a"), F.element_at("stops", k + 1).alias("b")))).alias("leg", "ab")).select("request_id", "leg", "ab.a", "ab.b"))
    found = trails(edges, legs.select(F.col("a").alias("node")), legs.select(F.col("b").alias("node")), hops)
    found = cut(found.select(F.col("start").alias("a"), F.col("node").alias("b"), F.col("nodes").alias("n2"), F.col("edge_ids").alias("e2")).join(legs.select("a", "b").distinct(), ["a", "b"], "left_semi"))
    longest = legs.agg(F.max("leg")).first()[0]
    walked = legs.groupBy("request_id").agg(F.max("leg").alias("last"))
    now = legs.filter("leg = 0").join(found, ["a", "b"]).select("request_id", F.col("n2").alias("nodes"), F.col("e2").alias("edge_ids"))
    out = None
    for k in range((longest if longest is not None else -1) + 1):
        if k:
            nxt = legs.filter(F.col("leg") == k).join(found, ["a", "b"]).select("request_id", "n2", "e2")
            now = now.join(nxt, "request_id").filter(~F.arrays_overlap("edge_ids", "e2")).select("request_id", F.concat("nodes", F.slice("n2", 2, F.size("n2"))).alias("nodes"), F.concat("edge_ids", "e2").alias("edge_ids"))
        done = now.join(walked.filter(F.col("last") == k).select("request_id"), "request_id", "left_semi")
        out = done if out is None else out.unionByName(done)
    return now.limit(0) if out is None else out


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component: the least node reachable over edges (a, b) either way, by propagation of the least label with doubling."""
    from voltlake.session import cut

    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("node"), F.least("node", "l").alias("l")))
    for _ in range(rounds):
        seen = both.join(label.select(F.col("node").alias("b"), "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("m"))
        step = label.join(seen, "node").select("node", F.least("l", "m").alias("l"))
        jump = step.select(F.col("node").alias("l"), F.col("l").alias("ll"))
        new = cut(step.join(jump, "l", "left").select("node", F.least(F.coalesce("ll", "l"), "l").alias("l")))
        moved = new.join(label.select("node", F.col("l").alias("old")), "node").filter("l <> old").isEmpty()
        label = new
        if moved:
            break
    return label.select("node", F.col("l").alias("component"))
