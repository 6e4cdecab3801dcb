"""Page-level and record-level operators on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from voltlake.operators import graph as G
from voltlake.operators import pages as P
from voltlake.operators import records as R

LINES = "doc_id long, page int, pos int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"
BODY = "变压器在运行中应定期检查油位和油温，并把结果记入台账，发现异常应立即上报。"


def body(k):
    """Text of a line that stands on one page only."""
    return BODY[:-1] + "甲乙丙丁戊己庚辛"[k] + "。"


def document(doc_id, pages):
    """Rows of pages of (text, size, bold), sixteen points apart."""
    return [
        (doc_id, p, i, t, size, bold, 72.0, 60.0 + 16 * i, 72.0 + min(450.0, 10.5 * len(t)), 72.0 + 16 * i, 595.0, 842.0)
        for p, page in enumerate(pages, 1) for i, (t, size, bold) in enumerate(page, 1)
    ]


BOOK = [
    [("变压器运行手册", 24.0, True)],
    [("目录", 16.0, True), *[(f"{i} 章节名称{i} ......... {i}", 10.5, False) for i in range(1, 6)]],
    [(f"{i}.1 小节名称{i} ......... {i}", 10.5, False) for i in range(1, 6)],
    [("编写说明", 16.0, True), (body(0) + "说明", 10.5, False), ("第一章 总则", 18.0, True), (body(1), 10.5, False), (body(2), 10.5, False), ("1.1 检查", 14.0, True), (body(3), 10.5, False), ("12", 10.5, False)],
    [("1.1.1 油位应在两条线之间", 10.5, True), (body(4), 10.5, False), ("习题", 14.0, True), ("问题一：油位为什么会降低，应当怎样处理，请写出三条。", 10.5, False), ("第二章 试验", 18.0, True), (body(5), 10.5, False)],
    [("附录A 记录表", 18.0, True), (body(6), 10.5, False), (body(7), 10.5, False)],
    [("广告", 30.0, True)],
]


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame(document(1, BOOK), LINES)


def test_kinds_of_pages(spark, book):
    sizes = P.body_size(book)
    assert {r.doc_id: r.body for r in sizes.collect()} == {1: 10.5}
    assert sorted(r.page for r in P.contents_pages(book).collect()) == [2, 3]
    assert [r.page for r in P.cover_pages(book, sizes).collect()] == [1]
    marked = P.with_noise(book, sizes)
    assert [r.page for r in P.trailing_pages(marked).collect()] == [7]
    assert {r.text for r in marked.filter("noise").collect()} == {"12"}
    assert P.title_lines(marked, P.contents_pages(book)).first().title == "变压器运行手册"
    none = spark.createDataFrame([], LINES)
    assert P.body_size(none).count() == P.contents_pages(none).count() == P.split_documents(none).count() == 0


def test_noise(spark):
    pages = [[("某某公司内部资料", 9.0, False), (BODY, 10.5, False), (f"第 {p} 页", 9.0, False), ("图 1-2 接线", 10.5, False)] for p in range(1, 6)]
    df = spark.createDataFrame(document(1, pages), LINES)
    assert {r.text for r in P.with_noise(df, P.body_size(df)).filter("not noise").collect()} == set()
    one = spark.createDataFrame([(*r, [[72.0, 150.0, 300.0, 400.0]]) for r in document(1, [[("图 1 接线", 14.0, True), (BODY, 10.5, False), ("样本", 20.0, True)]])], LINES + ", image_rects array<array<double>>")
    got = {r.text for r in P.with_noise(one, P.body_size(one), ["样本文件"]).filter("noise").collect()}
    assert got == {"图 1 接线", "样本"}


@pytest.mark.parametrize("text,size,bold,level", [
    ("第一章 总则", 10.5, False, 1), ("1 总则", 16.0, True, 1), ("1. 总则", 14.0, False, 2), ("1. 检查", 10.5, True, 3), ("1. 检查油位", 10.5, False, 0), ("1.2.3 检查", 10.5, False, 3), ("1.2.3 检查", 14.0, True, 2),
    ("71.3%的样本", 10.5, False, 0), ("2 = 常数", 14.0, True, 0), ("（一）检查", 10.5, True, 4), ("（一）检查", 10.5, False, 0), ("（一）检查", 12.0, False, 2), ("前言", 16.0, False, 1), ("检查要求", 12.0, False, 2), (BODY, 14.0, True, 0),
    ("第1部分：通用要求》GB/T 1094", 10.5, False, 0), ("正文", 10.5, True, 0),
])
def test_line_level(spark, text, size, bold, level):
    df = spark.createDataFrame([(text, size, bold, 300.0, 842.0, 10.5)], "text string, size double, bold boolean, y0 double, page_height double, body double")
    assert df.select(P.line_level().alias("l")).first().l == level


def test_split_documents(spark, book):
    got = P.split_documents(book, spark.createDataFrame([(1, "变压器运行手册（第二版）")], "doc_id long, title string")).orderBy("chunk_no").collect()
    assert [(r.chunk_id, r.chapter_title, r.section_title, r.third_title) for r in got] == [
        ("变压器运行手册_000001", "总则", "", ""), ("变压器运行手册_000002", "总则", "检查", ""), ("变压器运行手册_000003", "总则", "检查", "油位应在两条线之间"), ("变压器运行手册_000004", "试验", "", "")
    ]
    assert got[0].text == body(1) + "\n" + body(2) and got[2].text.startswith("油位应在两条线之间\n") and got[1].context == f"变压器运行手册\n总则\n检查\n{body(3)}"
    assert not any("问题一" in r.text or "说明" in r.text for r in got)


def test_front_matter_terminal_and_wrapped(spark):
    pages = [[("发布日期：", 10.5, False), ("2024年5月1日", 10.5, False), ("附：微信公众号文章", 10.5, False), ("图书在版编目（CIP）数据", 10.5, False), (BODY + "出版", 10.5, False), ("前言", 18.0, True), (BODY, 10.5, False),
              ("一、变压器的长标题分成", 18.0, True), ("一、两行的标题", 18.0, True), (BODY, 10.5, False), ("参考资料", 16.0, True), (BODY + "后", 10.5, False)]]
    got = P.split_documents(spark.createDataFrame(document(1, pages), LINES), spark.createDataFrame([(1, "手册")], "doc_id long, title string")).orderBy("chunk_no").collect()
    assert [(r.title, r.chapter_title, r.text) for r in got] == [("手册", "前言", BODY), ("手册", "变压器的长标题分成一、两行的标题", BODY)]


def test_titles_and_formulas(spark):
    t = spark.createDataFrame([("变压器手册", "《变压器手册》"), ("第一节", "变压器手册"), (None, "甲"), ("乙", " "), (None, None)], "a string, b string")
    assert [r.t for r in t.select(P.reconciled_title(F.col("a"), F.col("b")).alias("t")).collect()] == ["变压器手册", "变压器手册", "甲", "乙", ""]
    spans = [(1, 1, 1, 1, "功率 ", "SimSun"), (1, 1, 1, 2, "P=U", "Cambria Math"), (1, 1, 1, 3, "I", "CMMI10"), (1, 1, 2, 1, "x", "CMSY"), (1, 1, 3, 1, "y", "CMSY"), (1, 1, 4, 1, "kV", "SimSun"), (1, 1, 4, 2, "⋅", "Symbol"), (1, 1, 4, 3, "A", "SimSun")]
    df = spark.createDataFrame(spans, "doc_id long, page int, pos int, span_no int, text string, font string")
    assert [r.text for r in P.formula_lines(df).orderBy("pos").collect()] == ["功率 [公式]", "[公式]", "kV⋅A"]


def test_references_and_pictures(spark):
    df = spark.createDataFrame([("见图 1-1。正常。如图 1-12所示。", ["图 1-1", "图 1-12"]), ("无", []), (None, None)], "t string, r array<string>")
    assert [r.o for r in df.select(P.without_cited(F.col("t"), F.col("r")).alias("o")).collect()] == ["正常。", "无", None]
    names = spark.createDataFrame([("图 3-2 接线", ".PNG"), ("图表1 总览", "jpg"), ("a/b", None), (None, "png")], "c string, e string")
    assert [r.o for r in names.select(P.picture_name(F.col("c"), F.col("e")).alias("o")).collect()] == ["图3-2.png", "图表1 总览.jpg", "a／b.png", "image.png"]
    rects = [(1, 1, i, float(x0), float(y0), float(x1), float(y1)) for i, (x0, y0, x1, y1) in enumerate([(0, 0, 100, 50), (0, 51, 100, 90), (101, 52, 200, 90), (300, 300, 310, 310), (0, 200, 10, 210)], 1)]
    df = spark.createDataFrame(rects, "doc_id long, page int, rect_id long, x0 double, y0 double, x1 double, y1 double")
    assert {r.rect_id: (r.region, r.x1, r.y1) for r in P.picture_regions(df).collect()} == {1: (1, 200.0, 90.0), 2: (1, 200.0, 90.0), 3: (1, 200.0, 90.0), 4: (4, 310.0, 310.0), 5: (5, 10.0, 210.0)}


def test_identifiers_and_models(spark):
    assert R.identifier("user_name") == "user_name"
    for bad in ("a b", "1x", "x;drop", "", None):
        with pytest.raises(ValueError):
            R.identifier(bad)
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert R.with_retries(flaky, 3, 1.0, waits.append)("p") == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        calls.clear()
        R.with_retries(flaky, 2, 0.0, waits.append)("p")
    receipts = iter([None, "r"])
    assert R.sent("m", lambda m: next(receipts)) == "r"
    with pytest.raises(RuntimeError):
        R.sent("m", lambda m: None)
    df = spark.createDataFrame([("a",), (None,)], "p string")
    assert [r.o for r in df.select(R.replies(F.col("p"), lambda ps: [p + "!" for p in ps]).alias("o")).collect()] == ["a!", None]


def test_charts(spark):
    rows = [("LINE", ["a"], ["1"], None), ("radar", ["a"], ["1"], "kind"), ("bar", [], [], "empty"), ("bar", None, None, "empty"), ("bar", ["a"], ["1", "2"], "lengths"), ("bar", ["a"], ["x"], "not numeric"), ("pie", ["a", "b"], ["1", "-1"], "negative"),
            ("pie", ["a"], ["0"], "no sum"), ("table", ["a"], [" "], "blank value"), ("table", ["a"], ["x"], None), ("bar", ["a"], [None], "not numeric"), ("plot", ["a"] * 1001, ["1"] * 1001, "too many")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, x array<string>, y array<string>, want string")
    assert [r.e for r in df.select("i", R.chart_error(F.col("k"), F.col("x"), F.col("y")).alias("e")).orderBy("i").collect()] == [r[3] for r in rows]


def test_user_messages(spark):
    blocks = "【检索资料】\n[source_1]\ndocument_title: 甲\nchunk_id: c1\n第一段\n\n[source_2]\ndocument_title: 乙\nchunk_id: c2\n第二段\n\n"
    df = spark.createDataFrame([(1, blocks + "【问题】\n为什么【问题】是什么？"), (2, "资料原文\n【用户问题】问"), (3, "没有标记"), (4, "甲【问题】 "), (5, "【问题】问"), (6, None)], "i int, c string")
    got = {r.i: r.p for r in df.select("i", R.parsed_user(F.col("c")).alias("p")).collect()}
    assert got[1].question == "是什么？" and [(b.document_title, b.chunk_id) for b in got[1].blocks] == [("甲", "c1"), ("乙", "c2")] and got[1].blocks[0].text == "第一段"
    assert got[2].question == "问" and [b.text for b in got[2].blocks] == ["资料原文"]
    assert got[3] is None and got[4] is None and got[6] is None and got[5].blocks == []


def test_answers_maps_and_labels(spark):
    rows = [(1, 2, "q2", "chat", "b", None), (1, 1, None, "plot", '{"answer": "图", "artifacts": []}', None), (1, 3, "q3", "chat", " ", "超时"), (1, 4, "q4", "chat", None, None), (2, 1, "q", "plot", "no json", None)]
    df = spark.createDataFrame(rows, "request_id int, task_no int, question string, skill string, answer string, error string")
    assert {r.request_id: r.answer for r in R.assembled_answers(df).collect()} == {1: "图\n\n2. q2\nb\n\n3. q3\n子任务执行失败：超时", 2: "1. q\nno json"}
    m = spark.createDataFrame([({"a": 1.0, "b": 2.0, "c": 2.0},), ({},), (None,)], "m map<string, double>")
    assert [r.k for r in m.select(R.map_argmax(F.col("m")).alias("k")).collect()] == ["b", None, None]
    p = spark.createDataFrame([({"name": "x", "age": " ", "evil": "1"},)], "m map<string, string>")
    r = p.select(R.allowed_fields(F.col("m"), ["name", "age"]).alias("a"), R.illegal_fields(F.col("m"), ["name", "age"]).alias("i")).first()
    assert (r.a, r.i) == ({"name": "x"}, ["evil"])
    cited = R.cited_chunks(spark.createDataFrame([(1, ["source_2", " source_1 ", "source_2", "source_9", None])], "answer_id int, labels array<string>"), spark.createDataFrame([(1, "source_1", "c1"), (1, "source_2", "c2")], "answer_id int, label string, chunk_id string"))
    assert [(r.pos, r.chunk_id) for r in cited.orderBy("pos").collect()] == [(0, "c2"), (1, "c1"), (2, None)]
    assert [r.label for r in R.unknown_labels(cited).collect()] == ["source_9"]
    flat = spark.createDataFrame([(1, "x")], "a int, hits string")
    assert R.flattened(flat, "hits", "k").collect() == flat.collect()
    k = spark.createDataFrame([(7, 9)], "u int, s int").select(R.task_key(F.col("u"), F.col("s")).alias("k")).first().k
    assert k.startswith("user:7:session:9:") and len(k) == len("user:7:session:9:") + 36


def test_routing_summary(spark):
    op = "array<struct<operation: string, field: string, value: string>>"
    gold = spark.createDataFrame([(1, True, False, []), (2, True, True, [("update", "name", "x")]), (3, False, False, [])], f"id int, short boolean, long boolean, operations {op}")
    pred = spark.createDataFrame([(1, True, False, []), (2, False, True, [("update", "name", "y")])], f"id int, short boolean, long boolean, operations {op}")
    r = R.routing_summary(gold, pred).first()
    assert (r.n, r.json_valid_rate, r.exact_match_rate, r.operations_exact_rate) == (3, 0.666667, 0.333333, 0.333333)
    assert (r.short_tp, r.short_fp, r.short_fn, r.short_precision, r.short_recall, r.long_f1) == (1, 0, 1, 1.0, 0.5, 1.0)


def test_series(spark):
    s = "struct<topic: string, entity: string, metric: string, dimension: string, dimension_unit: string, value_unit: string, conditions: array<string>, points: array<struct<label: string, x: string, value: double>>>"
    nan = float("nan")
    row = (None, " e ", "m", "d", None, "u", None, [("l", "1", 2.0), ("l", " ", 1.0), ("l", "2", nan), ("l", "3", None)])
    df = spark.createDataFrame([(row,), ((None, "z", "m", "d", None, "u", ["a ", " "], []),)], f"s {s}").select(R.normalised_series(F.col("s")).alias("series"))
    got = [r.series for r in df.collect()]
    assert got[0].topic == "" and got[0].entity == "e" and got[0].conditions == [] and got[1].conditions == ["a"]
    assert [tuple(r) for r in R.flat_points(df).collect()] == [("e", "l", "d", 2.0, "u", "1")]


def test_routes(spark):
    hit = "array<struct<node: string, score: double>>"
    df = spark.createDataFrame([(1, [("a", 0.9), ("x", 0.1), ("b", 0.5), ("c", 0.4)]), (2, [("a", 0.3), ("c", 0.9)]), (3, [("a", 0.9)]), (4, [("a", 0.9), ("c", 0.9)])], f"request_id int, h {hit}")
    r = df.select("request_id", G.route(F.col("h")).alias("stops"))
    assert {x.request_id: x.stops for x in r.collect()} == {1: ["a", "b", "c"], 2: None, 3: None, 4: ["a", "c"]}
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "b", "a"), ("e4", "a", "c")], "edge_id string, src string, dst string")
    got = sorted((x.request_id, ">".join(x.nodes)) for x in G.routed(edges, r, 3).collect())
    assert got == [(1, "a>b>a>c"), (1, "a>b>c"), (4, "a>b>a>c"), (4, "a>b>c"), (4, "a>c")]
    nodes = spark.createDataFrame([("n1", "设备", "变压器"), ("n2", "故障", "变压器")], "node_id string, label string, name string")
    assert [x.node for x in G.named_nodes(nodes, ["变压器", "变压器"], ["设备", "故障"])[1].collect()] == ["n2"]
    with pytest.raises(ValueError):
        G.named_nodes(nodes, ["a"], ["b", "c"])
