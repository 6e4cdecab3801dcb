"""Document ETL: lines, headings, margins, packing of sentences, JSON and mojibake repair, lookups that carry work forward."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voltlake.functions.text import effective_length, greedy_concat, heading_level, stripped


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, line: stripped non-blank lines in order, numbered from 1."""
    l = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), stripped), lambda s: s != "")
    return docs.select(key, F.posexplode(l).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def carried_headings(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds level, h1, h2, h3 to lines: the headings in force; a heading resets all deeper ones. A document is one group, bounded by its text."""
    x = rows.withColumn("level", heading_level(F.col("line")))
    w = Window.partitionBy(key).orderBy("pos")
    last = lambda n: F.last(F.when(F.col("level") == n, F.struct("pos", "line")), ignorenulls=True).over(w)
    x = x.withColumns({f"_{n}": last(n) for n in (1, 2, 3)})
    p = lambda n: F.coalesce(F.col(f"_{n}.pos"), F.lit(0))
    return x.withColumns({
        "h1": F.coalesce("_1.line", F.lit("")),
        "h2": F.when(p(2) > p(1), F.col("_2.line")).otherwise(""),
        "h3": F.when((p(3) > p(2)) & (p(3) > p(1)), F.col("_3.line")).otherwise(""),
    }).drop("_1", "_2", "_3")


def sentence_units(text: Column) -> Column:
    """Units that end at an end sign, with closing quotes."""
    return F.filter(F.split(text, "(?<=[。！？!?；;])(?![”’」』）)])|(?<=[。！？!?；;][”’」』）)])"), lambda s: s != "")


def long_split(text: Column, limit: int) -> Column:
    """Sentences joined up to limit; a sentence over the limit is sliced hard, after what was open."""
    hard = F.transform(sentence_units(text), lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: F.substring(s, i * limit + 1, F.lit(limit)))))
    return greedy_concat(F.flatten(hard), limit)


def pack_with_overlap(text: str, limit: int) -> list[str]:
    """Sentence units packed up to limit; a pack starts with the last sentence of the one before if that ends a sentence, is at most a fifth of the limit and still fits."""
    import re

    units = [u for s in re.findall(r"[^。！？!?；;]*[。！？!?；;]+[”’」』）)]*|[^。！？!?；;]+$", text) for u in ([s] if len(s) <= limit else [x for x in re.findall(rf"[^，,、：:]{{1,{limit}}}[，,、：:]?", s)])]
    out: list[str] = []
    now: list[str] = []
    for u in units:
        if now and sum(map(len, now)) + len(u) > limit:
            out.append("".join(now))
            lap = now[-1]
            now = [lap] if re.search(r"[。！？!?；;][”’」』）)]*$", lap) and len(lap) <= limit / 5 and len(lap) + len(u) <= limit else []
        now.append(u)
    return [*out, "".join(now)] if now else out


def packed_sections(docs: DataFrame, key: str, limit: int = 800) -> DataFrame:
    """key, piece_no, piece: greedy packs with overlap. The fold depends on each pack before it, so it runs in Arrow batches, a text at a time."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, p) for k, t in zip(pdf[key], pdf.text) if t for i, p in enumerate(pack_with_overlap(t, limit), 1)]
            yield pd.DataFrame(rows, columns=[key, "piece_no", "piece"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, piece_no int, piece string")


def repeated_margins(rows: DataFrame, group: str, page: str) -> DataFrame:
    """group, form, pages of lines whose digits differ at most, on max(2, (pages of the group + 4) // 5) pages or more."""
    form = F.regexp_replace("line", "[0-9]+", "#")
    seen = rows.select(group, page, form.alias("form")).distinct().groupBy(group, "form").agg(F.count(F.lit(1)).alias("pages"))
    total = rows.select(group, page).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    return seen.join(total, group).filter(F.col("pages") >= F.greatest(F.lit(2), F.floor((F.col("total") + 4) / 5))).select(group, "form", "pages")


def weighted_quantile(rows: DataFrame, group: str, size: str, weight: str, share: float = 0.75) -> DataFrame:
    """group, size: the least size at which the running weight reaches the share."""
    g = rows.groupBy(group, size).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(group).orderBy(size)
    x = g.withColumns({"run": F.sum("w").over(w), "all": F.sum("w").over(Window.partitionBy(group))})
    return x.filter(F.col("run") >= F.col("all") * share).groupBy(group).agg(F.min(size).alias(size))


def trailing(rows: DataFrame, group: str, page: str, chars: str, least: int = 40) -> DataFrame:
    """Rows after the last page of the group that has `least` characters or more."""
    last = rows.groupBy(group).agg(F.max(F.when(F.col(chars) >= least, F.col(page))).alias("last"))
    return rows.join(last, group).filter(F.col("last").isNull() | (F.col(page) > F.col("last"))).drop("last")


def contextual_text(df: DataFrame) -> Column:
    """Title, headings and body that aren't empty, a line each."""
    fields = ["title", "chapter_title", "section_title", "third_title", "fourth_title", "text"]
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in fields]), lambda s: s != ""), "\n")


def is_small(text: Column, least: int = 8) -> Column:
    return effective_length(F.coalesce(text, F.lit(""))) < least


def file_kind(name: Column) -> Column:
    n = F.lower(name)
    return F.when(name.isNull() | (name == ""), "null").when(n.contains(".pdf"), "pdf").when(n.contains(".docx"), "docx").when(n.contains(".doc"), "doc").otherwise("unsupported")


def object_name(name: Column, limit: int = 240) -> Column:
    """Control signs off, separators full-width; over the byte limit a cut name with part of its digest."""
    clean = F.translate(F.regexp_replace(name, r"[\x00-\x1f\x7f]", ""), ":/\\", "：／＼")

    @F.pandas_udf(StringType())
    def cut(s: pd.Series) -> pd.Series:
        import hashlib

        def one(x):
            b = x.encode()
            return x if len(b) <= limit else b[: limit - 13].decode("utf-8", "ignore") + "_" + hashlib.sha256(b).hexdigest()[:12]

        return s.map(one, na_action="ignore")

    return F.when(F.octet_length(clean) <= limit, clean).otherwise(cut(clean))


@F.pandas_udf(StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    """The first JSON object of a text, fence or words around it off; null if there is none."""
    import json
    import re

    def one(t):
        if t is None:
            return None
        m = re.search(r"```(?:json)?\s*(.*?)```", t, re.S)
        for s in ([m[1]] if m else []) + [t]:
            i = s.find("{")
            while i >= 0:
                try:
                    o, _ = json.JSONDecoder().raw_decode(s[i:])
                    if isinstance(o, dict):
                        return json.dumps(o, ensure_ascii=False, sort_keys=True)
                except ValueError:
                    pass
                i = s.find("{", i + 1)
        return None

    return text.map(one)


def greedy_json(text: Column) -> Column:
    """From the first to the last brace, if that is a JSON object."""
    s = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when((s != "") & F.try_parse_json(s).isNotNull(), s)


def repaired(text: str) -> str:
    """Stretches of signs below 256 with at least one above 127 are read as GB18030 if that works and gives a Han sign. A stretch is taken whole, as trail bytes may be ASCII."""
    out, start = [], 0
    bounds = [i for i in range(1, len(text)) if (text[i] < "\u0100") != (text[i - 1] < "\u0100")]
    for end in [*bounds, len(text)]:
        piece, start = text[start:end], end
        if piece and piece[0] < "\u0100" and not piece.isascii():
            try:
                read = piece.encode("latin-1").decode("gb18030")
            except UnicodeDecodeError:
                read = ""
            piece = read if any("\u4e00" <= c <= "\u9fff" for c in read) else piece
        out.append(piece)
    return "".join(out)


@F.pandas_udf(StringType())
def repair_mojibake(text: pd.Series) -> pd.Series:
    return text.map(repaired, na_action="ignore")


def with_old_values(new: DataFrame, old: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds the value that an old row of the same keys had (null keys count as empty; the greatest of several)."""
    k = [F.coalesce(c, F.lit("")).alias(f"_k{i}") for i, c in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    found = old.filter(F.col(value).isNotNull()).select(*k, F.col(value).alias(f"old_{value}")).groupBy(*names).agg(F.max(f"old_{value}").alias(f"old_{value}"))
    return new.withColumns({n: F.coalesce(c, F.lit("")) for n, c in zip(names, keys)}).join(found, names, "left").drop(*names)


def chunk_errors(chunks: DataFrame, width: int = 64) -> Column:
    """Reasons against a chunk, parted by bars; empty if there is none."""
    v = F.col("embedding")
    return F.concat_ws(
        "|", F.when(F.coalesce(F.trim("chunk_id"), F.lit("")) == "", "chunk_id"), F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "text"), F.when(F.coalesce(F.trim("description"), F.lit("")) == "", "description"),
        F.when(v.isNull(), "no vector").when(F.size(v) != width, "width").when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "value"),
    )


def series_status(points: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """keys, n, total, status of series of (x, value): checks of a chart's data."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    g = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(~bad, F.col("value"))), 4).alias("total"), F.count_if(bad).alias("bad"), F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.coalesce(F.trim("x"), F.lit("")) == "").alias("blank"))
    s = F.when(F.col("bad") > 0, "not numeric").when(F.col("blank") > 0, "blank x").when(F.col("n") > most, "too many").when(F.col("negative") > 0, "negative").when(F.col("total") <= 0, "empty").otherwise("ok")
    return g.select(*keys, "n", "total", s.alias("status"))
