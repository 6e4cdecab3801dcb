"""Streams against their batch twins, and sources and sinks on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from voltlake.sources import readers, sinks
from voltlake.streaming import events as E

EVENTS = [("a", 0, "start", ""), ("a", 2, "delta", "b"), ("a", 1, "delta", "a"), ("a", 1, "delta", "a"), ("a", 3, "done", ""), ("b", 0, "start", ""), ("b", 1, "delta", "x"), ("b", 2, "error", "bad"), ("b", 3, "done", ""), ("c", 0, "start", None), ("d", 0, "delta", "q"), ("d", 1, "done", "own")]
SCHEMA = "task_id string, sequence int, event_type string, content string"


def test_assemble(spark):
    got = {r.task_id: (r.content, r.state) for r in E.assemble(spark.createDataFrame(EVENTS, SCHEMA)).collect()}
    assert got == {"a": ("ab", "done"), "b": ("x", "error"), "c": ("", "open"), "d": ("own", "done")}


def test_assemble_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame(EVENTS, SCHEMA).repartition(3).write.json(str(tmp_path / "in"))
    E.run_available(E.assemble_stream(readers.stream(spark, str(tmp_path / "in"), SCHEMA, 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.task_id: (r.content, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.task_id: (r.content, r.state) for r in E.assemble(spark.createDataFrame(EVENTS, SCHEMA)).filter("state <> 'open'").collect()}
    assert got == batch


HITS = [("u", i, float(t)) for i, t in enumerate([0, 5, 10, 21, 22, 30])] + [("v", 10, 0.0), ("v", 11, 20.0), ("v", 12, 20.0), ("v", 13, 20.0)]


def test_limiter(spark):
    df = spark.createDataFrame(HITS, "k string, i int, s double")
    got = {r.i: r.allowed for r in E.limiter(df, "k", "s", "i", 2, 20.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 10: True, 11: True, 12: True, 13: False}


def fixed_windows(times, most, window):
    start, n, out = None, 0, []
    for t in times:
        if start is None or t - start >= window:
            start, n = t, 0
        n += 1
        out.append(n <= most)
    return out


def test_limiter_of_a_key_that_never_pauses(spark):
    import random

    rng, rows, want = random.Random(2), [], {}
    for k in range(3):
        t, times = 0.0, []
        for _ in range(1500):
            t += rng.choice([1.0, 5.0, 30.0, 400.0 if k else 9.0])
            times.append(t)
        rows += [(f"k{k}", 10_000 * k + i, x) for i, x in enumerate(times)]
        want |= {10_000 * k + i: a for i, a in enumerate(fixed_windows(times, 3, 60.0))}
    df = spark.createDataFrame([*rows, (None, 90_000, 1.0), ("k0", 90_001, None)], "k string, i int, s double")
    assert {r.i: r.allowed for r in E.limiter(df, "k", "s", "i", 3, 60.0).collect()} == want


def test_guard_is_released_by_a_failure(spark):
    rows = [("t", 1, 0.0, True), ("t", 2, 5.0, False), ("t", 3, 9.0, True), ("t", 4, 700.0, True), ("t", 5, 701.0, False), ("t", 6, 900.0, False), ("u", 7, 3.0, False)]
    df = spark.createDataFrame(rows, "k string, i int, s double, failed boolean")
    assert sorted(r.i for r in E.guarded(df, "k", "s", "i", "failed").collect()) == [1, 2, 4, 5, 7]


def test_tailed(spark):
    rows = [("a", 0, "start", "", 7, 1.0), ("a", 1, "error", "e", 7, 2.0), ("a", 2, "done", "", 7, 3.0), ("a", 3, "delta", "late", 7, 4.0), ("b", 0, "start", "", 8, 1.0), ("c", 0, "start", "", 7, 1.0), ("c", 1, "done", "", 7, 700.0)]
    df = spark.createDataFrame(rows, "task_id string, sequence int, event_type string, content string, user_id long, seconds double")
    got = sorted((r.task_id, r.sequence, r.event_type) for r in E.tailed(df, 7).collect())
    assert got == [("a", 0, "start"), ("a", 1, "error"), ("a", 2, "done"), ("b", 0, "error"), ("c", 0, "start"), ("c", 2, "timeout")]


def test_retention_time(spark):
    df = spark.createDataFrame([("t", 1, 10.0), ("t", 2, 400.0), ("old", 1, 50.0)], "task_id string, sequence int, seconds double")
    assert {r.task_id for r in E.retained(df, now=500.0).collect()} == {"t"}


def test_limiter_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(HITS, "k string, i int, s double")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = readers.stream(spark, str(tmp_path / "in"), "k string, i int, s double")
    E.run_available(E.limiter_stream(stream, "k", "s", "i", 2, 20.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.i: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.i: r.allowed for r in E.limiter(df, "k", "s", "i", 2, 20.0).collect()}


def test_first_deliveries(spark, tmp_path):
    rows = [("t", "2026-01-01T00:00:00"), ("t", "2026-01-01T00:00:05"), ("w", "2026-01-01T00:00:01")]
    spark.createDataFrame(rows, "task_id string, ts string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = readers.stream(spark, str(tmp_path / "in"), "task_id string, ts timestamp")
    E.run_available(E.first_deliveries(stream, ["task_id"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_retained(spark):
    df = spark.createDataFrame([("t", i) for i in range(2001)], "task_id string, sequence int")
    got = E.retained(df)
    assert got.count() == 2000 and got.agg(F.min("sequence")).first()[0] == 1


def test_json_array(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"chunk_id": "x"}, {"chunk_id": "y"}]))
    assert readers.json_array(spark, str(p), "chunk_id string", "chunk_id").count() == 2
    p.write_text(json.dumps([{"chunk_id": "x"}, {"chunk_id": "x"}]))
    with pytest.raises(readers.InvalidInput):
        readers.json_array(spark, str(p), "chunk_id string", "chunk_id")


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"query": "a"}\n\n{"query": " "}\n')
    assert [r.query for r in readers.json_lines(spark, str(p), "query string", ("query",)).collect()] == ["a"]
    p.write_text('{"query": "a"}\n{"query"\n')
    with pytest.raises(readers.InvalidInput):
        readers.json_lines(spark, str(p), "query string")


def test_text_lines(spark, tmp_path):
    p = tmp_path / "q.txt"
    p.write_text("﻿b\n a \n\nb\n")
    assert [r.line for r in readers.text_lines(spark, str(p)).orderBy("first").collect()] == ["b", "a"]


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>章</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>正</w:t><w:t>文</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "b.docx").write_bytes(b"no zip")
    rows = readers.docx_paragraphs(spark, str(tmp_path)).orderBy("path", "pos").collect()
    assert [(r.style, r.text) for r in rows] == [("Heading1", "章"), (None, "正文"), (None, None)]


def test_visual_lines(spark):
    spans = spark.createDataFrame([(1, 1, "右", 10.0, 300.0, 10.0, 310.0, 20.0), (1, 1, "甲", 10.0, 10.0, 10.0, 20.0, 20.0), (1, 1, "乙", 10.0, 21.0, 11.0, 31.0, 21.0), (1, 1, "下", 10.0, 10.0, 40.0, 20.0, 50.0)], "doc_id long, page int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in readers.merged_visual_lines(spans).orderBy("pos").collect()] == ["甲乙", "右", "下"]


def test_upsert_and_export(spark, tmp_path):
    t = str(tmp_path / "t")
    a = spark.createDataFrame([("x", 1), ("y", 1)], "k string, v int")
    assert sinks.upsert(a, t, "k") == {"created": True, "rows": 2, "vector_dims": {}}
    assert sinks.upsert(spark.createDataFrame([("y", 2), ("z", 2)], "k string, v int"), t, "k") == {"created": False, "rows": 3, "vector_dims": {}}
    assert {r.k: r.v for r in sinks.keyed(spark, t).collect()} == {"x": 1, "y": 2, "z": 2}
    with pytest.raises(sinks.SchemaMismatch):
        sinks.upsert(spark.createDataFrame([("y", "2")], "k string, v string"), t, "k")
    with pytest.raises(ValueError):
        sinks.upsert(spark.createDataFrame([("y", 2), ("y", 3)], "k string, v int"), t, "k")
    sinks.export_ndjson(sinks.keyed(spark, t), str(tmp_path / "nd"), "k")
    assert sinks.import_ndjson(spark, str(tmp_path / "nd"), "k string, v int").count() == 3
    assert sinks.verify(spark, {"t": t, "none": str(tmp_path / "none")}) == {"t": 3, "none": "MISSING"}


def test_broken_swap_is_put_back(spark, tmp_path):
    t = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([(f"k{i}", i) for i in range(20)], "k string, v int"), t, "k")
    part = next(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part="))
    part.rename(str(part) + ".old")  # as a crash between the two renames leaves it
    assert sinks.keyed(spark, t).count() == 20
    sinks.upsert(spark.createDataFrame([("k1", 100)], "k string, v int"), t, "k")
    assert {r.k: r.v for r in sinks.keyed(spark, t).collect()} == {f"k{i}": 100 if i == 1 else i for i in range(20)}


def test_inserts_updates_deletes(spark, tmp_path):
    t, a = str(tmp_path / "t"), str(tmp_path / "a")
    assert sinks.create_if_missing(spark, a, "k string, v int") and not sinks.create_if_missing(spark, a, "k string, v int")
    sinks.append(spark.createDataFrame([("x", 1)], "k string, v int"), a)
    with pytest.raises(sinks.SchemaMismatch):
        sinks.append(spark.createDataFrame([("x",)], "k string"), a)
    assert spark.read.parquet(a).count() == 1
    got = sinks.upsert(spark.createDataFrame([("x", "one", [1.0, 2.0]), ("y", "two", None)], "k string, name string, v array<double>"), t, "k", vectors=("v",))
    assert got["vector_dims"] == {"v": 2}
    assert sinks.update(spark, t, "k", spark.createDataFrame([("x", "new"), ("zz", "no")], "k string, name string")) == 1
    assert sinks.delete(spark, t, "k", spark.createDataFrame([("y",), ("q",)], "k string")) == 1
    assert [(r.k, r.name) for r in sinks.keyed(spark, t).collect()] == [("x", "new")]
    opened = sinks.opened_chats(spark.createDataFrame([(1, "q")], "chat_id long, question string")).first()
    assert (opened.status, opened.answer) == ("GENERATING", None)
    rows = spark.createDataFrame([("1", "abstract", "", [1.0]), ("2", "chat", "a", [1.0])], "id string, memory_type string, answer string, answer_vector array<double>")
    assert {r.doc_key: r.answer_vector for r in sinks.memory_rows(rows).collect()} == {"abstract:1": None, "2": [1.0]}
    nested = spark.createDataFrame([], "p array<struct<x: string, y: double>>")
    sinks.check_nested(nested, "p", {"x": "string"})
    with pytest.raises(sinks.SchemaMismatch):
        sinks.check_nested(nested, "p", {"y": "string"})
    e = str(tmp_path / "e")
    sinks.evaluation_lines(rows, e)
    sinks.evaluation_lines(rows.limit(1), e)
    assert spark.read.json(e).count() == 1


def test_bad_line_has_its_number(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"a": 1}\n\nno json\n')
    with pytest.raises(readers.InvalidInput, match="'line': 3"):
        readers.json_lines(spark, str(f), "a int")
    g = tmp_path / "y.json"
    g.write_text("[]")
    with pytest.raises(readers.InvalidInput, match="no rows"):
        readers.json_array(spark, str(g), "a int", some=True)


def test_upsert_stream(spark, tmp_path):
    spark.createDataFrame([("x", 1, 1), ("x", 2, 5), ("y", 3, 1)], "k string, v int, o int").coalesce(1).write.json(str(tmp_path / "in"))
    s = readers.stream(spark, str(tmp_path / "in"), "k string, v int, o int")
    sinks.upsert_batches(s, str(tmp_path / "t"), "k", "o", str(tmp_path / "cp")).awaitTermination()
    assert {r.k: r.v for r in sinks.keyed(spark, str(tmp_path / "t")).collect()} == {"x": 2, "y": 3}
