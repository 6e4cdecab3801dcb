"""Scans: JSON arrays, JSON lines, text lines, NDJSON, DOCX paragraphs, and span tables of paged documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltlake.functions.text import stripped


class InvalidInput(ValueError):
    """A file that breaks its contract; the message names the first rows."""


def _reject(bad: DataFrame, what: str) -> None:
    if rows := bad.limit(5).collect():
        raise InvalidInput(f"{what}: {[r.asDict() for r in rows]}")


def _line_number(spark: SparkSession, file: str, value: str) -> int | None:
    """The number of the first line with this text in a file. Only a file that broke the read is looked through."""
    whole = spark.read.text(file, wholetext=True).select(F.array_position(F.split("value", "\r\n|\n|\r"), value).alias("n")).first()
    return int(whole.n) if whole and whole.n else None


def json_array(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None, some: bool = False) -> DataFrame:
    """Rows of files that hold one JSON array each; with key, ids must be there and differ; with some, there must be rows."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
    if some and df.isEmpty():
        raise InvalidInput(f"{path}: no rows")
    if key:
        _reject(df.filter(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "").select(key), f"{key} is missing")
        _reject(df.groupBy(key).count().filter("count > 1"), f"{key} is not unique")
    return df


def json_lines(spark: SparkSession, path: str, schema: StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a line that isn't JSON stops the read with its file, number and text; rows with a blank required field are left out."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    if bad := text.filter(F.try_parse_json("value").isNull()).select(F.input_file_name().alias("file"), "value").limit(5).collect():
        raise InvalidInput(f"not JSON: {[{'file': r.file, 'line': _line_number(spark, r.file, r.value), 'text': r.value[:80]} for r in bad]}")
    df = text.select(F.from_json("value", schema if isinstance(schema, str) else schema.json()).alias("r")).select("r.*")
    for c in required:
        df = df.filter(F.coalesce(F.trim(c), F.lit("")) != "")
    return df


def routing_labels(spark: SparkSession, path: str) -> DataFrame:
    """query, expected of a gold set; the keys of expected must be short, long and operations."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.array_sort(F.json_object_keys(F.get_json_object("value", "$.expected")))
    _reject(text.filter(~F.coalesce(keys == F.array(F.lit("long"), F.lit("operations"), F.lit("short")), F.lit(False))).select(F.substring("value", 1, 80).alias("line")), "keys of expected")
    return text.select(F.from_json("value", "query string, expected struct<short: boolean, long: boolean, operations: array<struct<operation: string, field: string, value: string>>>").alias("r")).select("r.*")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, first: stripped non-blank lines, each once, with the place of their first appearance; a byte order mark is dropped."""
    rows = spark.read.text(path).select(stripped(F.regexp_replace("value", "^\\x{FEFF}", "")).alias("line"), F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).alias("at"))
    return rows.filter("line <> ''").groupBy("line").agg(F.min("at").alias("first"))


def sample_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Samples of several files; sample ids differ over all of them."""
    df = spark.read.schema(schema).json(paths)
    _reject(df.groupBy(F.col("metadata.sample_id").alias("sample_id")).count().filter("count > 1"), "sample_id is not unique")
    return df


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, style, text of the non-blank paragraphs of DOCX files; a file that can't be read gives one row with a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        from xml.etree import ElementTree

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for pdf in batches:
            rows = []
            for p, data in zip(pdf.path, pdf.content):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(bytes(data))).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows.append((p, 0, None, None))
                    continue
                for i, x in enumerate(root.iter(f"{w}p"), 1):
                    text = "".join(t.text or "" for t in x.iter(f"{w}t")).strip()
                    style = x.find(f"{w}pPr/{w}pStyle")
                    if text:
                        rows.append((p, i, None if style is None else style.get(f"{w}val"), text))
            yield pd.DataFrame(rows, columns=["path", "pos", "style", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, pos int, style string, text string")


def merged_visual_lines(spans: DataFrame, overlap: float = 0.55, drop: float = 2.5) -> DataFrame:
    """doc_id, page, pos, text, size of spans (doc_id, page, text, size, x0, y0, x1, y1): spans of one baseline join unless a wide gap parts them.

    A page is one group, bounded by what fits on a page."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for s in pdf.sort_values(["y0", "x0"]).itertuples():
            for r in rows:
                low, high = max(r[0].y0, s.y0), min(r[0].y1, s.y1)
                if (high - low) >= overlap * min(r[0].y1 - r[0].y0, s.y1 - s.y0) or abs(r[0].y1 - s.y1) <= drop:
                    r.append(s)
                    break
            else:
                rows.append([s])
        out = []
        for r in rows:
            r.sort(key=lambda s: s.x0)
            now = [r[0]]
            for s in r[1:]:
                if s.x0 - now[-1].x1 > max(18.0, 1.8 * s.size):
                    out.append(now)
                    now = []
                now.append(s)
            out.append(now)
        out.sort(key=lambda r: (r[0].y0, r[0].x0))
        return pd.DataFrame({"doc_id": pdf.doc_id.iloc[0], "page": pdf.page.iloc[0], "pos": range(1, len(out) + 1), "text": ["".join(s.text for s in r) for r in out], "size": [max(s.size for s in r) for r in out]})

    return spans.groupBy("doc_id", "page").applyInPandas(merge, "doc_id long, page int, pos int, text string, size double")


def outline_map(outline: DataFrame) -> DataFrame:
    """number, title of outline rows (number, title); numbers with several titles are dropped."""
    return outline.groupBy("number").agg(F.countDistinct("title").alias("n"), F.min("title").alias("title")).filter("n = 1").select("number", "title")


def stream(spark: SparkSession, path: str, schema: str, files: int = 40) -> DataFrame:
    """Tail of an append-only folder of JSON events, at most `files` files a step, from the checkpointed place on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
