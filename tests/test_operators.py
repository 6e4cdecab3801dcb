"""Operators against hand-computed tables and their edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from voltlake.functions.content import has_content, is_completed
from voltlake.functions.text import fixed_slices, greedy_concat, heading_level, session_name, strip_heading_number, tokens
from voltlake.operators import etl, fusion, graph, lexical, memory, prompts, quality
from voltlake.operators.knn import exact_knn


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("scores,expected", [([4.0, 2.0, 3.0], [1.0, 0.0, 0.5]), ([5.0, 5.0], [1.0, 1.0]), ([0.0, 0.0], [0.0, 0.0]), ([7.0], [1.0])])
def test_min_max(spark, scores, expected):
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(scores)], "request_id string, i int, score double")
    assert [r.n for r in df.withColumn("n", fusion.min_max(F.col("score"), "request_id")).orderBy("i").collect()] == expected


def test_max_norm(spark):
    df = spark.createDataFrame([("a", 4.0), ("a", 1.0), ("b", -1.0), ("b", 0.0)], "request_id string, score double")
    assert sorted(round(r.n, 6) for r in df.withColumn("n", fusion.max_norm(F.col("score"), 0.4, "request_id")).collect()) == [-1.0, 0.0, 0.1, 0.4]


def test_weights():
    assert fusion.normalised_weights({"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75}
    for bad in ({"a": -1, "b": 2}, {"a": 0}):
        with pytest.raises(ValueError):
            fusion.normalised_weights(bad)
    assert fusion.candidate_depth(4) == 50 and fusion.candidate_depth(40) == 200


def test_document_channel_rank(spark):
    df = spark.createDataFrame([("r", "c", t, i) for i, t in enumerate("AABAC", 1)], "request_id string, channel string, title string, rank int")
    assert [r.doc_rank for r in fusion.first_seen_rank(df, "title").orderBy("rank").collect()] == [1, 1, 2, 1, 3]


def test_split_query(spark):
    df = spark.createDataFrame([(1, "变压器过热？ 断路器拒动。变压器过热；a"), (2, "no end"), (3, None), (4, "？？"), (5, "aa?bb?cc?dd?ee?ff")], "request_id long, text string")
    got = {}
    for r in fusion.split_query(df).orderBy("request_id", "sub_no").collect():
        got.setdefault(r.request_id, []).append(r.sub_query)
    assert got == {1: ["变压器过热", "断路器拒动"], 2: ["no end"], 3: [""], 4: ["？？"], 5: ["aa", "bb", "cc", "dd", "ee"]}


def test_balanced_topk(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.9), (1, 1, "b", 0.8), (1, 1, "c", 0.7), (1, 2, "a", 0.9), (1, 2, "d", 0.5)], "request_id long, sub_no int, chunk_id string, score double")
    pick = lambda k: [r.chunk_id for r in fusion.balanced_topk(df, "chunk_id", k).orderBy("pick").collect()]
    assert pick(3) == ["a", "d", "b"] and pick(9) == ["a", "d", "b", "c"]


def test_two_rounds(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 4, 5]), ([], [1]), ([1], [])], "a array<int>, b array<int>")
    assert [r.y for r in df.select(fusion.two_rounds(F.col("a"), F.col("b")).alias("y")).collect()] == [[2, 4, 1, 5], [1], [1]]


def test_merge_keeps_first_of_equal_scores(spark):
    df = spark.createDataFrame([(1, 2, "a", 0.5), (1, 1, "a", 0.5), (1, 3, "a", 0.4)], "request_id long, sub_no int, chunk_id string, score double")
    r = fusion.merge_candidates(df, "chunk_id").first()
    assert (r.score, r.sub_no, r.matched) == (0.5, 1, 3)


def test_bm25_formula(spark):
    docs = spark.createDataFrame([("d1", "a b b"), ("d2", "a c"), ("d3", None)], "chunk_id string, text string")
    req = spark.createDataFrame([(1, "B"), (2, "zzz"), (3, None)], "request_id long, text string")
    rows = lexical.search(req, docs, "chunk_id", {"c": lexical.Channel({"text": 1.0})}, 5).collect()
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert [(r.request_id, r.chunk_id) for r in rows] == [(1, "d1")]
    assert rows[0].score == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5)), abs=1e-6)


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([], "chunk_id string, text string")
    req = spark.createDataFrame([(1, "b")], "request_id long, text string")
    assert lexical.search(req, docs, "chunk_id", {"c": lexical.Channel({"text": 1.0})}, 5).count() == 0


def bm25_plain(requests, docs, boosts, k, share=0.0, grouped=False):
    """{(request, rank): (key, score)} by the formula, document after document."""
    out, toks = {}, {d["k"]: {f: (d[f] or "").lower().split() for f in boosts} for d in docs}
    avg = {f: (lambda n: sum(n) / len(n) if n else 1)([len(t[f]) for t in toks.values() if t[f]]) for f in boosts}
    for r, g, q in requests:
        q, scores = set(q.split()), {}
        for d in docs:
            if grouped and d["g"] != g:
                continue
            best = 0
            for f, b in boosts.items():
                t, hit = toks[d["k"]][f], [x for x in q if x in toks[d["k"]][f]]
                if len(hit) < max(int(len(q) * share), 1):
                    continue
                s = 0.0
                for x in hit:
                    df = sum(x in y[f] for y in toks.values())
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * t.count(x) * 2.2 / (t.count(x) + 1.2 * (0.25 + 0.75 * len(t) / avg[f]))
                best = max(best, round(round(s, 6) * b, 6))
            if best > 0:
                scores[d["k"]] = best
        for i, (key, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out[r, i] = (key, s)
    return out


@pytest.mark.parametrize("share,group,sent", [(0.0, None, 10**6), (0.5, None, 10**6), (0.0, "g", 10**6), (0.0, None, 0), (0.0, "g", 0)])
def test_search_against_every_document(spark, share, group, sent):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(40)], k=n))
    docs = [{"k": f"d{i:03d}", "g": i % 3, "a": text(rng.randint(0, 30)), "b": text(5) if i % 4 else None} for i in range(300)]
    req = [(i, i % 3, " ".join(set(text(6).split()))) for i in range(12)]
    df = spark.createDataFrame([(d["k"], d["g"], d["a"], d["b"]) for d in docs], "k string, g int, a string, b string").repartition(3)
    asked = spark.createDataFrame(req, "request_id long, g int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # several batches a task, so that earlier ones prune later ones
    try:
        boosts = {"a": 1.0, "b": 2.0}
        rows = lexical.search(asked, df, "k", {"c": lexical.Channel(boosts, share)}, 4, group=group, sent=sent).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.request_id, r["rank"]): (r.k, r.score) for r in rows}
    want = bm25_plain(req, docs, boosts, 4, share, bool(group))
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-5 for x in want)


def test_packs_of_requests_rank_in_their_task(spark):
    docs = spark.createDataFrame([(f"d{i:02d}", f"a {'b ' * (i % 7)}", f"t{i % 3}") for i in range(60)], "k string, x string, title string").repartition(5)
    asked = spark.createDataFrame([(i, "a b") for i in range(30)], "request_id long, text string")
    channels = {"x": lexical.Channel({"x": 1.0}), "y": lexical.Channel({"x": 2.0})}
    far, near = (lexical.search(asked, docs, "k", channels, 4, sent=n, carry=("title", "y")) for n in (0, 10**6))
    assert "Window" not in far._jdf.queryExecution().executedPlan().toString()  # no task passes on hits that another one would rank
    rows = lambda df: sorted(map(str, df.select("request_id", "channel", "k", "score", "rank", "title").collect()))
    assert rows(far) == rows(near) and len(rows(far)) == 240
    assert all((r.title is None) == (r.channel == "x") for r in far.collect())


def test_pruned_scores_are_the_full_ones():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (30, 3000):  # few documents are added, many looked up
        has = [np.flatnonzero(rng.random(n) < p) for p in (0.01, 0.1, 0.5, 0.9)]
        tf = np.concatenate([rng.integers(1, 5, len(x)) for x in has])
        lists = lexical._lists(np.repeat(np.arange(4), list(map(len, has))), np.concatenate(has), tf, rng.integers(5, 50, n).astype(float), 4, 20.0)
        terms = [[i, idf, 1.0, 0.0] for i, idf in enumerate((5.0, 2.0, 0.6, 0.1))]
        full = lexical._field_scores(lists, terms, lexical.Channel({"x": 1.0}), 0, n, 0.0, 4)
        for least in np.sort(full)[[-20, -5]]:
            some = lexical._field_scores(lists, terms, lexical.Channel({"x": 1.0}), 0, n, least - 1e-6, 4)
            assert np.allclose(some[full >= least], full[full >= least])


def test_known_tokens_score_as_texts(spark):
    from voltlake.functions.text import tokens

    rows = [(1, 1, "变压器 abc", "k1", "变压 ABC abc 器"), (1, 2, "油温", "k2", " \u3000\n"), (1, 3, "油温", "k3", None), (2, 1, "ab", "k4", "abc")]
    df = spark.createDataFrame(rows, "request_id long, sub_no int, sub_query string, k string, body string")
    known = df.filter(fusion.stripped(F.col("body")) != "").withColumn("body", F.array_distinct(tokens(F.col("body"))))
    rows_of = lambda x: sorted((r.k, r.sub_no, r.score) for r in x.collect())
    assert rows_of(fusion.rerank(known, "k", fusion.held)) == rows_of(fusion.rerank(df, "k")) == [("k1", 1, 1.0)]


def test_pair_scores_are_those_of_the_search(spark):
    docs = spark.createDataFrame([("d1", "a b b", None), ("d2", "a c", "b"), ("d3", None, "a b")], "k string, x string, y string")
    req = spark.createDataFrame([(1, "B a"), (2, "c")], "request_id long, text string")
    all_hits = {(r.request_id, r.k): r.score for r in lexical.search(req, docs, "k", {"c": lexical.Channel({"x": 1.0, "y": 2.0})}, 9).collect()}
    named = spark.createDataFrame([(1, "d1"), (1, "d3"), (2, "d1"), (2, "d2")], "request_id long, k string")
    got = {(r.request_id, r.k): r.score for r in lexical.pair_scores(named, req, docs, "k", {"x": 1.0, "y": 2.0}).collect()}
    assert got == {x: all_hits[x] for x in [(1, "d1"), (1, "d3"), (2, "d2")]}


def test_keyword_pairs_stand_in_the_request(spark):
    req = spark.createDataFrame([(1, "电压和电流"), (2, "µm 级"), (3, None)], "request_id long, text string")
    df = spark.createDataFrame([], "tok string, df long")
    got = {}
    for r in prompts.keywords(req, df, 10).collect():
        got.setdefault(r.request_id, set()).add(r.tok)
    assert got == {1: {"电压", "和", "流"}, 2: {"µm", "级"}}  # the second 电 is no new token, and 和流 stands nowhere


def test_take_turns():
    rows = [(1, 0.9, "a"), (1, 0.8, "b"), (1, 0.7, "c"), (2, 0.9, "a"), (2, 0.5, "d")]
    assert fusion.take_turns(rows, 9) == [("a", 1), ("d", 2), ("b", 1), ("c", 1)]
    assert fusion.take_turns([], 4) == []


@pytest.mark.parametrize("sent", [10, 0])
def test_knn_against_brute_force(spark, sent):
    import numpy as np

    rng = np.random.default_rng(1)
    c, q = rng.integers(-2, 3, (80, 4)).astype(float), rng.integers(-2, 3, (5, 4)).astype(float) + 0.5
    corpus = spark.createDataFrame([(f"c{i:02d}", v.tolist(), i % 2) for i, v in enumerate(c)], "k string, v array<double>, g int").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(q)], "i long, v array<double>, g int")
    for group in (None, "g"):
        got = {(int(r.i), r["rank"]): r.k for r in exact_knn(asked, corpus, "i", "v", "k", "v", 3, width=4, group=group, sent=sent).collect()}
        for i, v in enumerate(q):
            n = np.linalg.norm(c, axis=1)
            cos = np.round((c @ v) / np.where(n > 0, n, 1) / np.linalg.norm(v), 6)
            ok = [j for j in range(80) if n[j] > 0 and (not group or j % 2 == i % 2)]
            best = sorted(ok, key=lambda j: (-cos[j], j))[:3]
            assert [got[i, r] for r in (1, 2, 3)] == [f"c{j:02d}" for j in best]


def test_knn_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, float("nan")])], "i long, v array<double>")
    c = spark.createDataFrame([("b", [2.0, 0.0]), ("a", [3.0, 0.0]), ("c", [0.0, 1.0]), ("w", [1.0, 1.0, 1.0]), ("z", [0.0, 0.0])], "k string, v array<double>")
    got = [(r.i, r.k, r["rank"]) for r in exact_knn(q, c, "i", "v", "k", "v", 2, width=2).orderBy("rank").collect()]
    assert got == [("1", "a", 1), ("1", "b", 2)]


def test_tokens(spark):
    assert one(spark, "变压器 T-12 Ölprobe", tokens) == ["变", "压", "器", "t", "12", "ölprobe"]
    assert one(spark, None, tokens) == []


@pytest.mark.parametrize("line,level", [("第一章 总则", 1), ("1.2.3 要求", 3), ("1.2 范围", 2), ("3、检查", 1), ("一、概述", 1), ("（二）方法", 2), ("71.3%的样本", None), ("正文", None), ("", None)])
def test_heading_level(spark, line, level):
    assert one(spark, line, heading_level) == level


def test_small_text_functions(spark):
    assert one(spark, "1.2 第三章 断 路 器", strip_heading_number) == "断路器"
    assert one(spark, "  断路器拒动怎么办？请说明", session_name) == "断路器拒动怎么办"
    assert one(spark, "a" * 85, fixed_slices) == ["a" * 40, "a" * 40, "a" * 5]
    assert one(spark, "", fixed_slices) == []
    assert one(spark, ["aa", "bb", "cccccc", "d"], lambda c: greedy_concat(c, 4), "array<string>") == ["aabb", "cccccc", "d"]


@pytest.mark.parametrize("text", [None, "", " \n\t", "​﻿", "<br/>\n<p></p>", "&nbsp;", "N/A", "null", "（空）", "---", "**", "```\n```", "……"])
def test_no_content(spark, text):
    assert one(spark, text, has_content) is False


@pytest.mark.parametrize("text", ["a", "是", "1", "<b>x</b>", "none of these", "无功补偿"])
def test_content(spark, text):
    assert one(spark, text, has_content) is True


def test_completed(spark):
    assert [one(spark, s, is_completed) for s in ("COMPLETED", " completed\n", "FAILED", "", None)] == [True, True, False, False, False]


def test_rewards(spark):
    rows = [("",), ("短",), ("结论成立。**",), ("没有句号的一段足够长的文字",), ("资料不足，无法判断这一点。",), ("甲句。甲句。乙句。" * 2,), (None,)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string")
    a = F.col("a")
    got = df.select("i", quality.basic_quality(a).alias("b"), quality.completion_reward(a).alias("c"), quality.refusal_consistency(a, F.lit(False)).alias("r"), quality.repetition_penalty(a).alias("p")).orderBy("i").collect()
    assert [r.b for r in got] == [-1.0, -0.6, -0.6, 0.3, 0.3, 0.3, -1.0]
    assert [r.c for r in got] == [-1.0, -0.8, 0.3, -0.8, 0.3, 0.3, -1.0]
    assert [r.r for r in got] == [-1.0, -1.0, -1.0, -1.0, 1.0, -1.0, -1.0]
    assert got[5].p == -1.0 and got[2].p == 0.0


def test_form_and_overall(spark):
    a = "断" * 99 + "路。"
    df = spark.createDataFrame([(a, 0.8)], "a string, r double")
    r = df.select(quality.form_quality(F.col("a"), F.lit(0)).alias("f"), quality.overall(F.col("r"), F.lit(None).cast("double"), F.lit(0.875)).alias("o")).first()
    assert r.f == pytest.approx(0.875) and r.o == pytest.approx(0.82625)


def test_query_copy_tiers(spark):
    rows = [("断路器为什么拒动", "断路器为什么拒动？"), ("abcd", "dcba"), ("abcdefghij", "abcdefghijxyz"), ("断路器", "完全不同的一段说明文字，讲的是别的事情"), (None, "x"), ("x", None)]
    df = spark.createDataFrame(rows, "q string, a string")
    assert [r.p for r in df.select(quality.query_copy_penalty(F.col("q"), F.col("a")).alias("p")).collect()] == [-1.0, -0.8, -0.4, 0.0, 0.0, 0.0]


def test_trails_repeat_no_edge(spark):
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "a"), ("3", "b", "c"), ("4", "a", "b")], "edge_id string, src string, dst string")
    node = lambda x: spark.createDataFrame([(x,)], "node string")
    got = sorted("".join(r.edge_ids) for r in graph.trails(e, node("a"), node("c"), 10).collect())
    assert got == ["123" if x == "x" else x for x in sorted(["13", "43", "1243", "4213"])]
    assert graph.trails(e, node("c"), node("a"), 10).count() == 0


def test_long_chain(spark):
    e = spark.createDataFrame([(str(i), str(i), str(i + 1)) for i in range(11)], "edge_id string, src string, dst string")
    node = lambda x: spark.createDataFrame([(x,)], "node string")
    assert graph.trails(e, node("0"), node("10"), 10).count() == 1
    assert graph.trails(e, node("0"), node("11"), 10).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert {got[i] for i in range(21)} == {0} and got[101] == 100


def test_summary_groups(spark):
    rows = [(1, 7, i, f"2026-01-{1 + i // 4:02d} 00:00:00") for i in range(12)]
    df = spark.createDataFrame(rows, "user_id long, session_id long, chat_id long, create_time string").withColumn("create_time", F.col("create_time").cast("timestamp_ntz"))
    assert sorted(r.chat_ids for r in memory.summary_groups(df).collect()) == ["[0,1,2,3,4]", "[5,6,7,8,9]"]


def test_profile_fold(spark):
    ops = spark.createDataFrame([(1, 1, "update", "major", "a"), (1, 2, "update", "major", "b"), (1, 3, "update", "profession", "c"), (1, 4, "delete", "profession", None)], "user_id long, seq long, operation string, field string, value string")
    assert [(r.field, r.value) for r in memory.profile_fold(ops).collect()] == [("major", "b")]


def test_status_fold(spark):
    df = spark.createDataFrame([("t", 1, "COMPLETED "), ("t", 2, "FAILED"), ("u", 1, "GENERATING"), ("u", 2, "failed"), (None, 1, "x")], "task_id string, update_time int, status string")
    assert {r.task_id: (r.status, r.failures) for r in memory.status_fold(df).collect()} == {"t": ("COMPLETED", 1), "u": ("FAILED", 1)}


def test_json_recovery(spark):
    df = spark.createDataFrame([('x {"a": 1} y {"b": 2}',), ('```json\n{"c": [1]}\n```',), ("none",), (None,), ('{"a": {"b"',)], "t string")
    assert [r.o for r in df.select(etl.first_json_object("t").alias("o")).collect()] == ['{"a": 1}', '{"c": [1]}', None, None, None]


def test_mojibake(spark):
    bad = "断路器".encode("gb18030").decode("latin-1")
    df = spark.createDataFrame([(f"a {bad} b",), ("plain café",), (None,)], "t string")
    assert [r.o for r in df.select(etl.repair_mojibake("t").alias("o")).collect()] == ["a 断路器 b", "plain café", None]
    for word in ("凍結", "國產繼電器", "x凍y結z"):  # trail bytes that are ASCII
        assert etl.repaired(word.encode("gb18030").decode("latin-1")) == word
    assert etl.repaired("") == "" and etl.repaired("变压器 ok") == "变压器 ok"


def test_object_name(spark):
    r = spark.createDataFrame([("图/1:\x01a",), ("长" * 100,)], "t string").select(etl.object_name(F.col("t")).alias("o")).collect()
    assert r[0].o == "图／1：a" and len(r[1].o.encode()) <= 240 and r[1].o.startswith("长")


def test_packing_with_overlap():
    text = "第一句。" * 10 + "很长的一句" * 10 + "。" + "末句。"
    packs = etl.pack_with_overlap(text, 20)
    assert all(len(p) <= 20 for p in packs) and packs[1].startswith("第一句。")
    assert etl.pack_with_overlap("", 20) == []


def test_long_split_keeps_text(spark):
    t = "甲乙丙。" * 30 + "丁" * 50 + "。尾"
    assert "".join(one(spark, t, lambda c: etl.long_split(c, 20))) == t
    assert max(map(len, one(spark, t, lambda c: etl.long_split(c, 20)))) <= 20


def test_trailing_and_margins(spark):
    p = spark.createDataFrame([("s", 1, 100), ("s", 2, 10), ("s", 3, 50), ("s", 4, 3), ("s", 5, 0)], "g string, page int, chars int")
    assert sorted(r.page for r in etl.trailing(p, "g", "page", "chars").collect()) == [4, 5]
    rows = spark.createDataFrame([("s", i, f"第 {i} 页") for i in range(23)] + [("s", 1, "正文")], "g string, page int, line string")
    assert [r.pages for r in etl.repeated_margins(rows, "g", "page").collect()] == [23]


def test_fused_history_vectors(spark):
    from voltlake.operators import memory as M
    from voltlake.plans.memory import named_vectors

    unit = lambda x, y: [float(x), float(y)] + [0.0] * 62
    named = spark.createDataFrame([(20, "a"), (20, "b"), (20, "c"), (20, "d")], "request_id long, id string")
    asked = spark.createDataFrame([(20, unit(1, 0))], "request_id long, query_vector array<double>")
    rows = spark.createDataFrame([("a", "chat", unit(2, 0)), ("a", "chat", unit(2, 0)), ("b", "chat", unit(-1, 0)), ("c", "chat", None), ("x", "chat", unit(1, 0)), ("d", "chat", unit(0, 3))], "id string, memory_type string, query_vector array<double>")
    near = named_vectors(named, asked, rows)
    assert {(r.id, r.score) for r in near.collect()} == {("a", 1.0), ("b", 0.0), ("d", 0.5)}
    kw = spark.createDataFrame([(20, "c", 7.0), (20, "d", 3.5)], "request_id long, id string, score double")
    # a is found by its vector only; c, by keyword only, does not exceed 0.4
    assert {(r.id, r.score) for r in M.fused_search(kw, near, "id").collect()} == {("a", 0.6), ("d", 0.5)}


def test_eight_rewards(spark):
    from voltlake.operators import quality as Q
    from voltlake.plans import quality as P

    c = "变压器油温升高时应检查冷却器并复测绝缘电阻，确认无误后方可恢复送电。"
    user = "【检索资料】\n[source_1]\ndocument_title: 甲\nchunk_id: 甲_1\n" + c + "\n\n[source_2]\ndocument_title: 乙\nchunk_id: 乙_2\n无关材料。\n\n【问题】\n"
    q = "变压器油温升高时应当怎样处理为好？"
    rows = [("copy", True, user + q, c), ("question", True, user + q, q), ("own", True, user + q, "应先检查冷却器。"), ("short", False, user + q, "无法确定，资料不足。"), ("none", True, q, "应先检查冷却器。")]
    df = P.grounded(spark.createDataFrame(rows, "sample_id string, context_sufficiency boolean, user string, assistant string"))
    eighth = Q.grounding(F.col("answer"), F.col("content_sufficient"), F.col("copied"), F.col("related"))
    got = {r.sample_id: r for r in df.select("sample_id", "query", eighth.alias("ground"), Q.combined(P._eight()).alias("all"), Q.combined(P._eight()[:6]).alias("six"), Q.query_copy_penalty(F.col("query"), F.col("answer")).alias("copy")).collect()}
    assert got["copy"].ground == -1.0 and got["short"].ground == 0.0 and got["none"].ground == 0.0 and 0 < got["own"].ground < 1
    assert got["question"].query == q and got["question"].copy == -1.0 and got["question"]["all"] < got["question"].six
    assert got["copy"]["all"] == pytest.approx(got["copy"].six - 1, abs=1e-6)


def test_index_of_gathered_postings_takes_little_memory():
    """A task that meets a pack holds one index at a time; at its greatest it takes some 20 bytes a posting (it took over 70)."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [[words[i] for i in rng.integers(0, 3000, 300)] for _ in range(1500)] + [["w1"] * 300, [], ["other"]]
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(len(rows))]), pa.array([""] * len(rows)), pa.array(rows, pa.list_(pa.string()))], names=["key", "grp", "t0"])
    terms = lexical.Terms([1], [""], [1], [0, 1], None, None, None, None, None, words)
    blobs = [lexical._compact(batch.slice(i, 501).take(pa.array(range(min(501, len(rows) - i)))), ["t0"], False) for i in range(0, len(rows), 501)]
    tracemalloc.start()
    index = lexical._gathered(blobs, terms, ["t0"], {"t0": 300.0}, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    doc, w, starts, top, n = index.lists[0]
    assert most < 35 * len(doc) and n == len(rows)
    plain = lexical._indexed(batch, terms, ["t0"], {"t0": 300.0}, False)
    assert (index.keys == plain.keys).all() and (doc == plain.lists[0][0]).all() and (w == plain.lists[0][1]).all() and (starts, top) == plain.lists[0][2:4]
    at = {t: i for i, t in enumerate(words)}["w1"]
    here = {index.keys[d]: x for d, x in zip(doc[starts[at] : starts[at + 1]], w[starts[at] : starts[at + 1]])}
    assert here["d1500"] == pytest.approx(300 * 2.2 / (300 + 1.2)) and "d1501" not in here
