"""Training-data operators on small fixtures, against brute force and exact round trips."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.llm import conversations, defects, neighbours, overlap, packing, personal, splitting, tokens

CHAT = "chat_id long, session_id long, user_id long, question string, answer string, status string, create_time string, update_time string, extra string"
SESSION = "session_id long, user_id long, extra string"


def chats(spark, rows):
    df = spark.createDataFrame(rows, CHAT)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("create_time", "update_time")})


# 1 ---------------------------------------------------------------------------------------------------------------


def brute_pairs(rows, k=10, least=0.9):
    vec = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vec[i] = np.array(v) / np.linalg.norm(v)
    out = set()
    for a, x in vec.items():
        best = sorted(((-float(x @ y), b) for b, y in vec.items() if b != a and x @ y >= least))[:k]
        out |= {tuple(sorted((a, b))) for _, b in best}
    return out


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(64)
        rows += [(f"{c}-{i}", (centre + rng.standard_normal(64) * 0.2).tolist()) for i in range(8)]
    rows += [("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("short", [1.0] * 32), ("null", None), (None, rows[0][1]), rows[0], rows[0]]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], "id string, v array<double>, field string")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, {"v": "x"}, leaf=60).collect()}
    want = brute_pairs(rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_copies_of_one_vector(spark):
    v = np.random.default_rng(2).standard_normal(64).tolist()
    df = spark.createDataFrame([(f"{i:03d}", v) for i in range(90)], "id string, v array<double>")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, {"v": "x"}).collect()}
    assert got == brute_pairs([(f"{i:03d}", v) for i in range(90)])


@pytest.mark.parametrize("n,cosine", [(200, 0.99), (750, 0.99), (1500, 0.997)])
def test_dense_group_keeps_the_nearest(n, cosine):
    rng = np.random.default_rng(6)
    centre, noise = rng.standard_normal(64), rng.standard_normal((n, 64))
    unit = centre + noise * np.sqrt(1 / cosine - 1)
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    at = np.arange(n)
    i, j = neighbours.leaf_pairs(neighbours.code4(unit), at, at, at.astype(str).astype(object), 10, 0.9)
    kept = set(zip(i.tolist(), j.tolist()))
    c = unit.astype(float) @ unit.T.astype(float)
    np.fill_diagonal(c, -1)
    want = [(a, b) for a in range(n) for b in np.argsort(-c[a])[:10].tolist()]
    assert sum(x in kept for x in want) >= 0.999 * len(want)


def test_queue_gives_the_nearest_leaves_of_all_trees():
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((400, 16)).astype(np.float32)
    trees, probes = 3, 5
    forest = neighbours.fit_forest(unit, 400, trees, 50)
    depth = forest["depth"]
    assert depth == 3
    homes, probed = neighbours.route(forest, unit[:40], probes)
    proj = unit[:40] @ forest["directions"]
    for i in range(40):
        cost = {}
        for t in range(trees):
            for leaf in range(1 << depth, 2 << depth):
                path = [leaf >> (depth - d) for d in range(depth + 1)]
                x = [proj[i, t * depth + d] - forest["cuts"][t, path[d]] for d in range(depth)]
                cost[leaf * trees + t] = sum(abs(x[d]) for d in range(depth) if (x[d] > 0) != bool(path[d + 1] & 1))
        assert {k for k, c in cost.items() if c == 0} == set(homes[i].tolist())
        want = sorted(c for c in cost.values() if c > 0)[:probes]
        assert np.allclose([cost[x] for x in probed[i].tolist()], want, atol=1e-5)


def test_clustered_vectors_leave_no_overfull_leaf():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 64))
    unit = centres[rng.integers(0, 200, 60_000)] + 0.3 * rng.standard_normal((60_000, 64))
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    # the sample reaches 3 levels, a tenth of the depth that the table would need
    forest = neighbours.fit_forest(unit[:64], 60_000, 2, 100)
    homes, _ = neighbours.route(forest, unit, 0)
    codes = neighbours.code4(unit)
    for t in range(2):
        for leaf in np.unique(homes[:, t]):
            at = np.flatnonzero(homes[:, t] == leaf)
            parts = neighbours.split_leaf(codes[at], np.ones(len(at), bool), np.arange(len(at)), 200)
            assert max(len(m) for m, _ in parts) <= 200 and sum(len(m) for m, _ in parts) == sum(len(q) for _, q in parts) == len(at)
            assert all(set(m.tolist()) == set(q.tolist()) for m, q in parts)
    same = neighbours.split_leaf(np.repeat(codes[:1], 500, 0), np.ones(500, bool), np.arange(500), 200)
    assert len(same) == 1 and len(same[0][0]) == 500


def test_no_vectors(spark):
    assert neighbours.similar_pairs(spark.createDataFrame([], "id string, v array<double>"), {"v": "x"}).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def test_conversations(spark):
    t = "2026-01-01 10:00:0"
    ok = ("问题", "回答", "COMPLETED")
    rows = [
        (2, 1, 9, *ok, t + "1", t + "2", "x"), (1, 1, 9, *ok, t + "1", t + "2", "x"), (1, 1, 9, *ok, t + "1", t + "2", "x"), (3, 1, 9, "q", "a", " completed\n", t + "0", t + "1", "x"),
        (4, 2, 9, "q", "&nbsp;", "COMPLETED", t + "1", t + "2", "x"), (5, 2, 9, *ok, t + "1", t + "2", "x"),  # no reply
        (6, 3, 9, *ok, None, t + "2", "x"), (7, 4, 8, *ok, t + "1", t + "2", "x"), (8, 5, 9, *ok, t + "1", t + "2", "x"),  # no time, not the owner, no session
        (9, 6, 9, "q", "a", "FAILED", t + "1", t + "2", "x"), (9, 6, 9, "q", "a", "COMPLETED", t + "1", t + "3", "x"), (10, None, 9, *ok, t + "1", t + "2", "x"), (11, 7, 9, *ok, t + "1", t + "2", "x"), (11, 7, 9, "q", None, "COMPLETED", t + "1", t + "3", "x"),
    ]
    sessions = spark.createDataFrame([(i, 9, "y") for i in (1, 1, 2, 3, 4, 6, 7)], SESSION)
    got = [(r.session_id, r.msg_no, r.role, r.chat_id) for r in conversations.messages(chats(spark, rows), sessions).orderBy("session_id", "msg_no").collect()]
    assert got == [(1, 1, "user", 3), (1, 2, "assistant", 3), (1, 3, "user", 1), (1, 4, "assistant", 1), (1, 5, "user", 2), (1, 6, "assistant", 2), (6, 1, "user", 9), (6, 2, "assistant", 9)]
    assert conversations.messages(chats(spark, []), sessions).count() == 0


def test_numbers_run_over_hours(spark):
    rows = [(i, 1, 9, "q", "a", "COMPLETED", f"2026-01-0{1 + i // 20} {i % 20:02d}:00:00", "2026-02-01 00:00:00", "x") for i in range(60)]
    got = conversations.ordered_turns(chats(spark, rows), spark.createDataFrame([(1, 9, "y")], SESSION)).orderBy("turn_no").collect()
    assert [(r.turn_no, r.chat_id) for r in got] == [(i + 1, i) for i in range(60)]


def test_clock_offset(spark):
    rows = [(i, 1, 9, "q", "a", "COMPLETED", f"2026-01-01 10:{i:02d}:00", f"2026-01-01 09:{i:02d}:30", "x") for i in range(10)]
    r = conversations.clock_offsets(conversations.ordered_turns(chats(spark, rows), spark.createDataFrame([(1, 9, "y")], SESSION))).first()
    assert r.offset_s == pytest.approx(3570) and r.offset_residual == pytest.approx(0, abs=1e-6)


def test_clock_offset_over_all_bounds(spark):
    rng = random.Random(8)
    rows, n = [], 0
    # one reply a minute early among sound ones; sound; shifted; at random
    for s, shift in ((1, lambda i: -60 if i == 4 else 5), (2, lambda i: 5), (3, lambda i: -3000), (4, lambda i: rng.randint(-200, 200)), (5, lambda i: rng.choice([-90, 5, 90]))):
        for i in range(12):
            n += 1
            m, x = divmod(i * 60 + 3600 + shift(i), 60)
            rows.append((n, s, 9, "q", "a", "COMPLETED", f"2026-01-01 11:{i:02d}:00", f"2026-01-01 {10 + m // 60:02d}:{m % 60:02d}:{x:02d}", "x"))
    df, sessions = chats(spark, rows), spark.createDataFrame([(s, 9, "y") for s in range(1, 6)], SESSION)
    turns = conversations.ordered_turns(df, sessions)
    got = {r.session_id: r for r in conversations.clock_offsets(turns).collect()}
    for s in range(1, 6):
        t = [tuple(np.datetime64(x.replace(" ", "T")).astype("datetime64[s]").astype(int) for x in r[6:8]) for r in rows if r[1] == s]
        low, high = np.array([c - u for c, u in t]), np.array([c - u for (c, _), (_, u) in zip(t[1:], t)])
        cost = lambda d: (np.maximum(0, low - d) ** 2).sum() + (np.maximum(0, d - high) ** 2).sum()  # noqa: B023, E731
        grid = np.arange(-400, 4000, 0.01)
        best = min(grid, key=lambda d: (round(cost(d), 3), abs(d))) if s < 4 else min(np.arange(-400, 400, 0.01), key=cost)
        assert cost(got[s].offset_s) <= cost(best) + 1e-3 and got[s].offset_s == pytest.approx(best, abs=0.02)
        assert got[s].offset_residual == pytest.approx(np.sqrt(cost(got[s].offset_s) / 23), abs=1e-6) and got[s].constraints == 23
    # with corrected times the feasible conversations are in the statement's order, the others left out
    key = ["session_id", "msg_no", "role", "chat_id"]
    merged = {tuple(r) for r in conversations.corrected_messages(turns).select(key).collect()}
    assert merged == {tuple(r) for r in conversations.messages(df, sessions).select(key).collect() if r.session_id in (2, 3)}


# 3 ---------------------------------------------------------------------------------------------------------------

Q = "为什么密封老化会引起冷却器的通信中断，芷桥站的88次记录能说明什么？"


@pytest.mark.parametrize(
    "q,a,want",
    [
        (Q, Q, "copied"), (Q, "> " + Q, "copied"), (Q, "芷桥站的88次记录能说明什么，为什么密封老化会引起冷却器的通信中断？", "copied"), (Q, Q.replace("密封", "密"), "copied"), (Q, Q + "\n密封老化会使接触电阻逐步恶化，最终导致误动，应及时更换密封垫并复测绝缘。", None),
        (Q, "抱歉，缺少依据，暂不作判断。建议另行查证。", "refusal"), (Q, "抱歉让您久等。仅凭油温无法确定冷却器的缺陷部位，还应红外测温后综合判断。", None), ("How is it done at Penden?", "Unfortunately, I must pass on this one.", "refusal"),
        (Q, "Service experience shows that a loose terminal slowly leads to overheating of the bushing.", "other_language"), (Q + "请用英文回答。", "Service experience shows that a loose terminal slowly leads to overheating.", None),
        (Q, "主要有三个方面：\n1. 检查油位。\n2. 清扫外壳。", "truncated"), (Q, "主要有两个方面：\n1. 检查油位。\n2. 清扫外壳。", None), (Q, "应立即更换密封垫，并把结果记入", "truncated"), (Q, "应更换密封垫（其中", "truncated"), (Q, "应更换密封垫。\n- 降低负荷\n- ", "truncated"),
        (Q, "应更换密封垫。\n- 降低负荷\n- 核对相序", None), (Q, "应更换密封垫。\nZ = U / I", None), (Q, "应更换密封垫。\n```\nU = ", "truncated"), ("", "应更换密封垫并复测绝缘电阻。", None), (None, "应更换密封垫并复测绝缘电阻。", None),
    ],
)
def test_defects(q, a, want):
    assert defects.defect(q, a, bool(q)) == want


@pytest.mark.parametrize("q,a,want", [("电压多少", "电压多少", True), ("电压多少？", "电压多少？电压多少？", True), ("电压多少", "多少电压", True), ("电压多少", "电压为 10 kV", False), ("U?", "U?", False), ("请说明断路器拒动的原因，并给出处理步骤和注意事项", "注意事项和处理步骤，断路器拒动的原因请说明并给出", True)])
def test_short_and_turned_copies(q, a, want):
    assert defects.is_copy(q, a) == want


LONG = "第三号主变压器在雷雨季节连续运行期间油中溶解气体含量与环境湿度和负荷率之间的相互关系" * 5


@pytest.mark.parametrize(
    "q,a,want",
    [
        (Q, f"我手头的材料里查不到{LONG}的相关内容。", "refusal"), (Q, f"我手头的材料里查不到{LONG * 3}的相关内容。", "refusal"), (Q, Q * 6, "copied"), (Q, (Q + "\n\n---\n\n") * 8, "copied"),
        (Q, Q + ("\n" + "=" * 40) * 12, "copied"), (Q, Q * 2 + LONG, None), (Q, LONG + "。" + Q * 6, None), (Q, f"{LONG}时，材料里查不到的内容应由{LONG}的人员补充。", None),
    ],
)
def test_long_refusals_and_copies(q, a, want):
    got = defects.defect(q, a, True)
    assert (got if got in ("refusal", "copied") else None) == want


def test_defect_rows(spark):
    t = "2026-01-01 10:00:0"
    rows = [(1, 1, 1, Q, None, "COMPLETED", t + "1", t + "1", "x"), (2, 1, 1, Q, "N/A", " completed", t + "1", t + "1", "x"), (3, 1, 1, Q, None, "FAILED", t + "1", t + "1", "x"), (4, 1, 1, Q, "", "COMPLETED", t + "1", t + "1", "x"), (4, 1, 1, Q, "好的，已更换密封垫并复测合格。", "COMPLETED", t + "1", t + "2", "x"), (None, 1, 1, Q, None, "COMPLETED", t + "1", t + "1", "x")]
    got = sorted((r.record_id, r.defect) for r in defects.chat_defects(chats(spark, rows)).collect())
    assert got == [(1, "empty"), (2, "empty")]
    tr = spark.createDataFrame([(1, Q, None), (1, Q, None), (2, None, None), (3, Q, "已更换密封垫，绝缘合格。" * 4000)], "request_id long, query string, answer string")
    assert sorted((r.record_id, r.defect) for r in defects.training_defects(tr).collect()) == [(1, "empty"), (2, "empty")]


# 4 ---------------------------------------------------------------------------------------------------------------


def sample(i, split, q, a, titles=("甲",)):
    return ([("system", "s"), ("user", "材料\n【问题】\n" + q), ("assistant", a)], (i, list(titles), None, True, "x", "easy", split))


SAMPLES = "messages array<struct<role: string, content: string>>, metadata struct<sample_id: string, document_titles: array<string>, chunk_ids: array<string>, context_sufficiency: boolean, question_type: string, difficulty: string, dataset_split: string>"
ANSWER = "录波显示故障发生后48毫秒接地变压器跳闸，直流屏未动作，行为正确。设备序列号为207044109952，出厂试验中谐波畸变率升至3.63 %。为保证热稳定性，建议每36天测量接触电阻一次。"


def test_overlaps(spark):
    q = "寒潮来临前调度员发现岚崖站储能变流器的环境湿度升至98%，12分钟后仍未恢复，应当怎样判断？"
    parts = ANSWER.split("。")
    rows = [
        sample("a", "train", q, ANSWER), sample("b", " TEST ", q.replace("，", ","), ANSWER.replace("。", ". ")), sample("c", "validation", q, "。".join([parts[2], parts[0], parts[1]]) + "。"), sample("d", "test", q, ANSWER.replace("36天", "39天")),
        sample("e", "test", q, "完全不同的回答，与原来的内容没有任何关系，只谈检修计划。"), sample("f", "train", q, ANSWER), (None, ("g", None, None, None, None, None, "test")), sample("h", "other", q, ANSWER), sample("b", " TEST ", q.replace("，", ","), ANSWER.replace("。", ". ")), sample("i", "test", "", ""),
    ]
    df = spark.createDataFrame(rows, SAMPLES)
    got = {(r.id_a, r.id_b) for r in overlap.overlaps(df).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "f"), ("c", "f")}
    rep = {r.split: (r.records, r.overlapping) for r in overlap.report(df).collect()}
    assert rep["train"] == (2, 2) and rep["validation"] == (1, 1)
    assert overlap.overlaps(spark.createDataFrame([], SAMPLES)).count() == 0


def test_frequent_seeds_and_numbering(spark):
    rng = random.Random(3)
    q, signs = "寒潮来临前调度员发现岚崖站储能变流器的环境湿度持续升高，应当怎样判断？", [chr(0x4E00 + i) for i in range(900)]
    base = "".join(rng.choices(signs, k=220))

    def edited():  # two signs in each 28 are exchanged
        t = list(base)
        for s in range(0, len(t) - 28, 28):
            for k in rng.sample(range(28), 2):
                t[s + k] = rng.choice(signs)
        return "".join(t) + "。"

    texts = [edited() for _ in range(240)]
    rows = [sample(f"{i:03d}", "train" if i % 2 else "test", q, t) for i, t in enumerate(texts)]
    rows += [sample("x", "train", "1. 密封垫老化怎样处理？\n2. 湿度升至98%应当怎样判断？", ANSWER), sample("y", "test", "密封垫老化怎样处理？\n湿度升至98%应当怎样判断？", ANSWER.replace("，", ","))]
    got = {(r.id_a, r.id_b) for r in overlap.overlaps(spark.createDataFrame(rows, SAMPLES)).collect()}
    assert ("x", "y") in got
    folds = [set(overlap.seeds(overlap.folded(q), overlap.folded(t)).tolist()) for t in texts]
    # pairs that share over 1 - RARE of their seeds, and are cases by alignment
    want = {(f"{i:03d}", f"{j:03d}") for i in range(240) for j in range(i + 1, 240) if (i + j) % 2 and len(folds[i] & folds[j]) > 0.45 * max(len(folds[i]), len(folds[j]))}
    want = {(a, b) for a, b in want if overlap.same_record(q, texts[int(a)], q, texts[int(b)])[2]}
    assert len(want) > 100 and want <= got


def test_seeds_of_all_records_are_not_broadcast(spark, tmp_path):
    """Of a table from files Spark takes the seeds as small as the files; from about 60 MB on they overran the driver."""
    rows = [sample("a", "train", "主变油温升至98 ℃，如何判断？", ANSWER), sample("b", "test", "主变油温升至98 ℃，如何判断？", ANSWER.replace("。", ". "))]
    spark.createDataFrame(rows, SAMPLES).write.parquet(str(tmp_path / "samples"))
    found, _ = overlap.class_overlaps(spark.read.parquet(str(tmp_path / "samples")))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[key#\d+L?\]", plan) and not re.search(r"BroadcastHashJoin \[key#\d+L?\]", plan)


def test_chains_in_any_order():
    a = "变压器油温升高时应当先检查冷却回路，再核对油位计读数，最后取油样做色谱分析，并把全部结果记入运行台账"
    b = a[24:] + a[:24]  # two parts that have changed places
    x, y = overlap.Fingerprint(a), overlap.Fingerprint(b)
    assert overlap.chained(x, x) >= 0.8 * x.length and overlap.chained(x, y) >= 0.5 * x.length
    slip = a.replace("核对", "仔细核对").replace("色谱", "气相色谱")
    assert overlap.chained(x, overlap.Fingerprint(slip)) >= 0.5 * x.length
    assert overlap.chained(x, overlap.Fingerprint("完全无关的另外一段文字")) == 0 and overlap.chained(x, overlap.Fingerprint("")) == 0
    assert overlap.is_chained(a, a, b, slip) and not overlap.is_chained(a, a, "别的问题是什么", "别的回答没有相同之处")


def test_seeds_of_many_texts_at_once():
    import random

    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("变压器油温abc0") for _ in range(n))
    rows = [(text(rng.choice([0, 1, 3, 9, 10, 11, 40, 300])), text(rng.choice([1, 5, 12, 200]))) for _ in range(200)]
    assert [x.tolist() for x in overlap.seeds_of(rows)] == [sorted({h ^ 17 for h in overlap.minima(q)} | set(overlap.minima(a))) for q, a in rows]
    assert overlap.seeds_of([]) == []


def test_winnowing_guarantee():
    text = "".join(random.Random(1).choices("甲乙丙丁戊己庚辛壬癸子丑寅卯", k=300))
    shared = text[100 : 100 + overlap.WINDOW + overlap.GRAM - 1]
    other = "".join(random.Random(2).choices("天地玄黄", k=80)) + shared + "".join(random.Random(3).choices("宇宙洪荒", k=80))
    assert set(overlap.minima(text)) & set(overlap.minima(other))
    assert overlap.minima("") == [] and len(overlap.minima("甲")) == 1


# 5 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["句子。" * 2000, "x" * 5000, "a. b.c! " * 900, "甲" * 1500 + "。", "甲" * 1499 + "。" + "乙" * 1501, ("行\r\n" + "很长的一行文字" * 30 + "\n") * 40])
def test_pieces_round_trip(text):
    p = splitting.pieces(text)
    assert "".join(piece[lap:] for _, lap, piece, _ in p) == text
    assert max(len(piece) for _, _, piece, _ in p) <= 1500
    b = [0, *splitting.boundaries(text), len(text)]
    hard = max(y - x for x, y in zip(b, b[1:])) > 1500
    assert any(h for *_, h in p) == hard
    ends = set(splitting.boundaries(text))
    assert all(s + len(piece) - lap in ends or h or s + len(piece) - lap == len(text) for s, lap, piece, h in p)


@pytest.mark.parametrize("end", ["。\n", "！！\r\n", "。\n\n  \n", "。"])
def test_overlap_is_the_last_sentence(end):
    rng = random.Random(9)
    said = ["".join(rng.choices("甲乙丙丁戊己庚辛壬癸", k=rng.randint(5, 40))) + end for _ in range(400)]
    p = splitting.pieces("".join(said))
    assert len(p) > 3
    for (_, lap0, before, _), (_, lap, piece, _) in zip(p, p[1:]):
        last = before[lap0:].rstrip("。！\r\n ").replace("！", "。").replace("\n", "。").split("。")[-1]
        if len(piece) - lap + len(last) + 8 <= 1500:
            assert piece[:lap].startswith(last) and last


def test_edit_alters_neighbours_only():
    rng = random.Random(4)
    text = "".join("".join(rng.choices("甲乙丙丁戊己庚辛壬癸", k=rng.randint(5, 40))) + "。" for _ in range(800))
    a, b = {t[lap:] for _, lap, t, _ in splitting.pieces(text)}, {t[lap:] for _, lap, t, _ in splitting.pieces(text[:200] + "新插入的一句。" + text[200:])}
    assert len(a - b) <= 4


def test_split_rows(spark):
    df = spark.createDataFrame([("a", "句。" * 1000, "章", None), ("a", "句。" * 1000, "章", None), ("b", None, None, None), ("c", "", None, None), ("d", "短。", None, None), ("e", "长" * 1501, None, "节")], "chunk_id string, text string, chapter_title string, section_title string")
    got = {r.chunk_id: r.cut for r in splitting.cut_kinds(splitting.split_texts(df)).collect()}
    assert got == {"a": "natural", "e": "hard"}


# 6 and 7 ---------------------------------------------------------------------------------------------------------

TEXTS = ["", None, "hello world", "系统中，断路器  拒动。\n\n it's 12,5 kV <|endoftext|>", "   ", "é🙂" * 50, "aaaa" * 3000]


def test_token_ids(spark):
    import tiktoken

    r = tokens.ranks()
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=r, special_tokens={})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {x.doc_id: list(x.ids) for x in tokens.encoded(df).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    by_id = {i: t for t, i in r.items()}
    assert all(tokens.decode(got[i], by_id) == t for i, t in enumerate(TEXTS) if t)


def test_merges_agree_with_the_plain_fold():
    import random

    rng, r = random.Random(5), tokens.ranks()
    words = ["hello", " world", "断路器的环境湿度", "ééé", "123456", "transformer", "a", "aaaa", "aaaaaaaaaaaaaaa", "ababababa", "😀😀😀", " " * 40, "=" * 33, "变" * 50]
    words += ["".join(rng.choice("aeiountrs电压器测试é") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    raw = [w.encode() for w in words] + [bytes(rng.randrange(256) for _ in range(rng.randint(1, 20))) for _ in range(200)]
    assert tokens.Merges(r).fold(raw) == [tokens.fold(w, r) for w in raw]
    assert tokens.Merges(r).fold([]) == []


def test_batches_and_full_cache(monkeypatch):
    r = tokens.ranks()
    texts = [f"断路器{i}号 breaker number {i} of bay {i % 3}." for i in range(60)] + [None, "", "x" * 200]
    want = [[x for w in tokens.WordFolder()._words.findall(t or "") for x in tokens.fold(w.encode(), r)] for t in texts]
    monkeypatch.setattr(tokens, "CHUNK", 40)
    monkeypatch.setattr(tokens, "CACHE", 15)
    f = tokens.WordFolder()
    assert f.batch(texts) == want and f.batch(texts) == want and f.batch([]) == []


def test_containers(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 3000)) for i in range(20_000)] + [(90_000, 10_000), (90_001, 4096), (90_002, 0), (90_003, None), (None, 5), (5, rng.randint(1, 1))]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    out = packing.containers(df).toPandas()
    want = {}
    for i, n in rows:
        if i is not None and n:
            want[i] = max(n, want.get(i, 0))
    assert out.groupby("doc_id").tokens.sum().to_dict() == want
    assert (out[out.doc_id != 90_000].groupby("doc_id").size() == 1).all()
    fill = out.groupby("container").tokens.sum()
    assert fill.max() <= 4096 and fill.sum() / (4096 * len(fill)) > 0.98
    assert packing.containers(spark.createDataFrame([], "doc_id long, tokens long")).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [
        ("写信到C-XIQI@EXAMPLE.COM。", {("email", "C-XIQI@EXAMPLE.COM")}), ("邮箱: noor.hald(at)ops.lanru.example", {("email", "noor.hald(at)ops.lanru.example")}), ("k_6 [at] wen-power [dot] test wrote", {("email", "k_6 [at] wen-power [dot] test")}),
        ("额定值 5A@220V，登录名 relay@bay-26", set()), ("联系人：王璟，电话（0420）1901831。", {("name", "王璟"), ("phone", "（0420）1901831")}), ("手机：+86 15422369720转73", {("phone", "+86 15422369720")}), ("可拨打１４３２１０００６１２或", {("phone", "１４３２１０００６１２")}),
        ("工单号20254494855已关闭。设备序列号为61602654321691664384，地址 192.0.2.81，端口 2404", set()), ("证件 592161199512047474 已核验。", {("id_number", "592161199512047474")}), ("证件 592161199513047474 已核验。", set()), ("signed the permit (ID 666-43-5884)", {("id_number", "666-43-5884")}),
        ("地址为岭堰市溪湖街287号18栋3单元2865室。", {("address", "岭堰市溪湖街287号18栋3单元2865室")}), ("500kV青溪线8号塔至9号塔之间", set()), ("A resident of 7139 Uxwell Lane, Apt. 20B, Caldwell heard", {("address", "7139 Uxwell Lane, Apt. 20B, Caldwell")}),
        ("gehen an Linus B. Achterhof, Mühlbacher Str. 119b, 82779 Neuenforst.", {("name", "Linus B. Achterhof"), ("address", "Mühlbacher Str. 119b, 82779 Neuenforst")}), ("envoyer à Ines Ostrowell, 135 rue des Tilleuls-Bleus, 15465 Saint-Orphie.", {("name", "Ines Ostrowell"), ("address", "135 rue des Tilleuls-Bleus, 15465 Saint-Orphie")}),
        ("The foreman and Mr. Brown's crew agreed.", set()), ("值班员欧阳绮于当日3时完成交接。", {("name", "欧阳绮")}), ("", set()), ("无" * 100_000, set()),
    ],
)
def test_personal(text, want):
    assert {(k, text[s:e]) for s, e, k in personal.spans(text, personal.automaton())} == want


def test_long_addresses_and_names_come_out_whole():
    anchors, found = personal.automaton(), lambda t: [(t[s:e], k) for s, e, k in personal.spans(t, anchors)]
    long = "江苏省苏州市工业园区" + "星湖" * 40 + "金鸡湖大道88号3栋2单元501室"
    assert found(f"本人住在{long}，请联系。") == [(long, "address")]
    street = "14 N" + "ordheimerwalde" * 6 + " Hill Road, Kingsbridge"
    assert found(f"Send it to {street} please") == [(street, "address")]
    name = "Maria-" + "-".join(["Luisenhofgarten"] * 6) + " Achterhof"
    assert found(f"Yesterday\n{name} signed the permit.") == [(name, "name")]
    mail = "relay@" + ".".join(["substation"] * 40) + ".example.com"
    assert found(f"Write to {mail}") == [(mail, "email")]


def test_personal_rows(spark):
    df = spark.createDataFrame([(1, "写信到a.b@example.com。又写信到a.b@example.com。", "x"), (1, "写信到a.b@example.com。又写信到a.b@example.com。", "x"), (2, None, "x"), (3, "", "x"), (None, "a.b@example.com", "x")], "doc_id long, text string, kind string")
    assert [(r.doc_id, r.kind, r.value) for r in personal.find(df).collect()] == [(1, "email", "a.b@example.com")]
    out = {r.doc_id: r.text for r in personal.redacted(df).filter("doc_id is not null").collect()}
    assert out == {1: "写信到[EMAIL]。又写信到[EMAIL]。", 2: None, 3: ""}


def test_check_character():
    assert personal.valid_id18("592161199512047474") and not personal.valid_id18("592161199512047475") and not personal.valid_id18("592161199502307474")
