"""Paged documents as a table of lines: body size, kinds of pages, noise, titles, headings, and the splitter built of them.

A line has doc_id, page, pos, text, size, bold, x0, y0, x1, y1, page_width, page_height. Every state of the reading order (a contents list that goes on, a section
left out, the headings in force) is a window over the document's lines: what a line's state is follows from the last line that set it. A document is one group,
bounded by its text. Documents without lines give no rows; null texts count as empty; repeated lines count each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.text import effective_length, han_count, is_caption, is_page_number, stripped
from voltlake.operators.etl import pack_with_overlap

ORDER = ["page", "pos"]
# Patterns of lines (Java syntax).
NUM = "一二三四五六七八九十百千万"
CHAPTER = rf"^\s*(?:第\s*[{NUM}0-9]+\s*[章节篇部]\s*\S+|[{NUM}]+、\s*\S+)"
NUMBERED = r"^\s*(\d+(?:\.\d+){0,3})(?!\d)(?:\s*[、．.]\s*|\s+|(?=[A-Za-z\x{4e00}-\x{9fff}]))(\S.*)$"
PARENTHESISED = rf"^\s*[（(](?:[{NUM}]+|\d+)[）)]\s*\S+"
APPENDIX = r"(?i)^\s*(?:附\s*录|Appendix)"
LEADERS = r"[.．…·]{4,}"
LISTED = r"^\s*\d+(?:\.\d+){0,3}(?:\s+|(?=[\x{4e00}-\x{9fff}]))\S+"
STANDARD = r"(?i)(?:GB(?:/T)?|DL(?:/T)?|NB(?:/T)?|IEC|IEEE)\s*[/.-]?\s*\d"
PUBLICATION = r"(?i)^\s*(?:图书在版编目(?:[（(]?\s*CIP\s*[）)]?)?数据|CIP\s*数据|中国版本图书馆\s*CIP\s*数据)"
RESTART = "^(?:前言|序言|绪论|引言)$"
NOTE = r"^\s*附[：:].*(?:微信公众(?:号|平台)|技术文章集锦)"
DATE_LABEL = r"^\s*(?:发布|出版)日期\s*[：:]?\s*$"
DATE_VALUE = r"^\s*\d{4}\s*(?:[/.-]\s*\d{1,2}\s*[/.-]\s*\d{1,2}|年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)\s*$"
EXERCISES = r"^(?:\d+(?:\.\d+)*[、.]?)?(?:习题|练习题|复习题|思考题|自测题)\d*$"
COVER_HEADING = r"(?i)出版社|出版集团|出版发行|第\s*\d+\s*版|ISBN"
COVER_TEXT = r"(?i)版权所有|盗版必究|翻印必究|ISBN"
# Titles of sections that end the content, or are left out.
TERMINAL = ["缩略词列表", "图示清单", "参考资料", "微信公众号技术文章集锦"]
EXCLUDED = ["编写说明"]
CONTENTS = ["目录", "目次", "contents"]
# Parts of the names of formula fonts.
FORMULA_FONTS = ["cambriamath", "math", "symbol", "mtextra", "mathtype", "euclid", "stix", "asana", "xits", "libertinusmath", "latinmodernmath", "cmsy", "cmmi", "cmex", "msam", "msbm", "timesnewromanpsitalicmt"]


def compact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{3000}\x{00a0}]+", "")


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the size at three quarters of the prose by weight (at most 120 a line); without prose the size of most characters, the least of equal ones."""
    n, size = effective_length(F.coalesce("text", F.lit(""))), F.round("size", 1)
    prose = (han_count(F.col("text")) >= 8) & (n >= 15) & (F.col("x1") - F.col("x0") >= F.col("page_width") * 0.25)
    prose = prose & ~is_page_number(F.col("text")) & ~is_caption(F.col("text")) & ~F.col("text").rlike(LEADERS)
    g = lines.groupBy("doc_id", size.alias("size")).agg(F.sum(F.when(prose, F.least(n, F.lit(120))).otherwise(0)).alias("w"), F.sum(F.greatest(n, F.lit(1))).alias("all"))
    run, total = F.sum("w").over(Window.partitionBy("doc_id").orderBy("size")), F.sum("w").over(Window.partitionBy("doc_id"))
    at = F.min(F.when((F.col("total") > 0) & (F.col("w") > 0) & (F.col("run") >= F.col("total") * 0.75), F.col("size")))
    out = g.withColumns({"run": run, "total": total}).groupBy("doc_id").agg(at.alias("prose"), F.max(F.struct("all", (-F.col("size")).alias("s"))).alias("most"))
    return out.select("doc_id", F.coalesce("prose", -F.col("most.s")).alias("body"))


def contents_pages(lines: DataFrame) -> DataFrame:
    """doc_id, page of the contents list: a page titled so, and the pages that go on with it."""
    t, n = F.col("text"), F.length(compact(F.col("text")))
    pages = lines.groupBy("doc_id", "page").agg(
        F.max((F.lower(compact(t)).isin(*CONTENTS) & ~is_page_number(t)).cast("int")).alias("title"), F.count_if(t.rlike(LISTED) & (F.length(t) <= 100)).alias("items"),
        F.count_if(n >= 45).alias("prose"), F.count_if((n >= 20) & t.rlike("[，。；：,;:]")).alias("sentences"), F.count_if(t.rlike(r"(?:\.{4,}|·{4,})\s*\d+\s*$")).alias("leaders"),
    )
    goes_on = (F.col("leaders") >= 4) | ((F.col("items") >= 4) & (F.col("prose") <= 2) & (F.col("sentences") <= 3))
    w = Window.partitionBy("doc_id").orderBy("page")
    island = F.sum(((F.col("title") == 0) & ~goes_on).cast("int")).over(w)
    x = pages.withColumn("island", island).withColumn("started", F.max("title").over(Window.partitionBy("doc_id", "island").orderBy("page")))
    return x.filter((F.col("title") == 1) | (goes_on & (F.col("started") == 1))).select("doc_id", "page")


def cover_pages(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, page: a first page of at most 180 characters with a line of 1.8 times the body size in its upper 55 %."""
    big = (F.col("size") >= F.col("body") * 1.8) & (F.col("y0") <= F.col("page_height") * 0.55)
    g = lines.filter("page = 1").join(sizes, "doc_id").groupBy("doc_id", "page").agg(F.sum(F.when(is_page_number(F.col("text")), 0).otherwise(F.length(compact(F.col("text"))))).alias("n"), F.max(big).alias("big"))
    return g.filter("big and n <= 180").select("doc_id", "page")


def near_image(gap: float = 90.0) -> Column:
    """The line stands within gap points of a rectangle of image_rects, above or below, and is level with it sideways."""
    middle = (F.col("x0") + F.col("x1")) / 2

    def close(r: Column) -> Column:
        apart = F.least(F.abs(F.col("y0") - r[3]), F.abs(r[1] - F.col("y1")))
        beside = ((F.col("x1") >= r[0] - 30) & (F.col("x0") <= r[2] + 30)) | ((middle >= r[0] - 60) & (middle <= r[2] + 60))
        return (apart <= gap) & beside

    return F.coalesce(F.exists("image_rects", close), F.lit(False))


def with_noise(lines: DataFrame, sizes: DataFrame, watermarks: list[str] | None = None) -> DataFrame:
    """Adds body and noise: watermarks, page numbers, lines repeated over the pages, small lines in the outer margin, captions."""
    form = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\d+", "#"))
    x = lines.join(sizes, "doc_id").withColumn("form", form)
    pages = lines.groupBy("doc_id").agg(F.max("page").alias("pages"))
    repeated = x.filter("form <> ''").groupBy("doc_id", "form").agg(F.countDistinct("page").alias("n")).join(pages, "doc_id")
    repeated = repeated.filter(F.col("n") >= F.greatest(F.lit(2), F.floor((F.col("pages") + 4) / 5))).select("doc_id", "form", F.lit(True).alias("again"))
    t, bare = F.col("text"), compact(F.col("text"))
    marked = F.lit(False)
    for w in watermarks or []:
        marked = marked | F.lit(w).contains(bare) | bare.contains(w)
    outer = (F.col("y0") <= F.col("page_height") * 0.05) | (F.col("y1") >= F.col("page_height") * 0.95)
    small = F.col("size") <= F.col("body") * 1.05
    noise = (marked & (F.col("size") >= F.col("body") * 1.5)) | is_page_number(t) | F.coalesce("again", F.lit(False)) | (outer & small)
    noise = noise | (is_caption(t) & ((near_image() if "image_rects" in lines.columns else F.lit(False)) | small))
    return x.join(repeated, ["doc_id", "form"], "left").withColumn("noise", F.coalesce(noise, F.lit(True))).drop("form", "again")


def trailing_pages(marked: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, page: the last pages in a row with under `least` characters of body text (marked: with_noise())."""
    n = F.sum(F.when(~F.col("noise") & (F.col("size") <= F.col("body") * 1.12), F.length(compact(F.col("text")))).otherwise(0))
    pages = marked.groupBy("doc_id", "page").agg(n.alias("n"))
    last = pages.groupBy("doc_id").agg(F.max(F.when(F.col("n") >= least, F.col("page"))).alias("last"))
    return pages.join(last, "doc_id").filter(F.col("last").isNull() | (F.col("page") > F.col("last"))).select("doc_id", "page")


def title_lines(marked: DataFrame, contents: DataFrame) -> DataFrame:
    """doc_id, page, pos, title: the best title candidate of the first three pages, by size, place in the middle and place at the top; the first of equal ones."""
    ok = (F.col("page") <= 3) & (F.length("text") <= 80) & ~F.col("noise") & ~F.col("text").rlike(CHAPTER) & ~F.col("text").rlike(NUMBERED) & (F.col("size") >= F.col("body") * 1.25)
    half = F.col("page_width") / 2
    centred = 1 - F.least(F.abs((F.col("x0") + F.col("x1")) / 2 - half) / half, F.lit(1.0))
    score = F.col("size") / F.col("body") + centred * 0.8 + F.greatest(F.lit(0.0), 1 - F.col("y0") / (F.col("page_height") * 0.5)) * 0.4
    best = F.max_by(F.struct("page", "pos", F.col("text").alias("title")), F.struct(F.round(score, 9), -F.col("page"), -F.col("pos")))
    return marked.filter(ok).join(contents, ["doc_id", "page"], "left_anti").groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.*")


def reconciled_title(detected: Column, configured: Column) -> Column:
    """The configured title unless it is blank or one of the two (letters and digits) holds the other; then the detected one."""
    d, c = F.trim(F.coalesce(detected, F.lit(""))), F.trim(F.coalesce(configured, F.lit("")))
    a, b = (F.regexp_replace(x, r"[^0-9A-Za-z\x{4e00}-\x{9fff}]+", "") for x in (d, c))
    agree = (a != "") & (b != "") & (a.contains(b) | b.contains(a))
    return F.when((c != "") & ~agree, c).otherwise(F.coalesce(F.nullif(d, F.lit("")), c))


def line_level() -> Column:
    """Level of a line (1 to 4) by its form and its type against the body size; 0 for text. Columns text, size, bold, y0, page_height, body."""
    t, size, body, bold = F.col("text"), F.col("size"), F.col("body"), F.coalesce("bold", F.lit(False))
    number, rest = F.regexp_extract(t, NUMBERED, 1), F.trim(F.regexp_extract(t, NUMBERED, 2))
    depth = F.least(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1, F.lit(4))
    part = t.rlike(rf"^\s*第\s*[{NUM}0-9]+\s*部(?:分)?\s*[：:]") & t.contains("》") & t.rlike(STANDARD) & ~bold & (size < body * 1.12)
    no_heading = ~rest.rlike(r"[0-9A-Za-z\x{4e00}-\x{9fff}]") | rest.rlike(r"^[%％‰(\[{（=≈~<>≤≥+\-×÷*/]") | rest.rlike(r"[。！？!?；;]\s*$") | (F.length(compact(rest)) < 2)
    single = (
        F.when(~t.rlike(r"^\s*\d+\s*[.．、]") & bold & (size >= body * 1.35), 1).when(size >= body * 1.12, 2).when(bold, 3).otherwise(0)
    )
    numbered = F.when(no_heading, 0).when(depth == 1, single).when((depth >= 3) & bold & (size >= body * 1.12), 2).otherwise(depth)
    bare, han = compact(t), han_count(t)
    plain = (
        F.when(t.rlike(r"^第\s*\d+\s*版$") | ((F.length(bare) < 3) & ~bare.isin("前言", "序言", "绪论", "概述")), 0)
        .when(~bare.rlike(r"[0-9A-Za-z\x{4e00}-\x{9fff}]") | (F.length(t) > 100) | t.rlike("[。！？!?；;]$"), 0)
        .when((size >= body * 1.4) & bare.isin("前言", "序言"), 1)
        .when((size >= body * 2.0) & (han >= 2) & (bold | (F.col("y0") <= F.col("page_height") * 0.25)), 1)
        .when((size >= body * 1.4) & ~bold & (han < 3), 0)
        .when(size >= body * 1.4, 2)
        .when((size >= body * 1.12) & (bold | (F.length(t) <= 60)), 2)
        .otherwise(0)
    )
    return (
        F.when(t.rlike(CHAPTER), F.when(part, 0).otherwise(1)).when(number != "", numbered)
        .when(t.rlike(PARENTHESISED), F.when(size >= body * 1.12, 2).when(bold, 4).otherwise(0)).otherwise(plain)
    )


def clean_heading(text: Column) -> Column:
    """The heading without its number."""
    return stripped(F.regexp_replace(F.regexp_replace(text, rf"^\s*(?:第\s*[{NUM}0-9]+\s*[章节篇部]|[{NUM}]+、|[（(](?:[{NUM}]+|\d+)[）)])\s*", ""), r"^\s*\d+(?:\.\d+)*\s*[、．.]?\s*", ""))


def _until(rows: DataFrame, start: Column, stop: Column, keep_start: bool = False) -> DataFrame:
    """Rows of each document outside the stretches that begin with a start row and end before a stop row; a start inside a stretch is part of it."""
    w = Window.partitionBy("doc_id").orderBy(*ORDER)
    x = rows.withColumn("_e", F.when(stop & ~start, 2).when(start, 1)).withColumn("_s", F.last("_e", ignorenulls=True).over(w))
    return x.filter((F.coalesce("_s", F.lit(2)) == 2) | (start if keep_start else F.lit(False))).drop("_e", "_s")


def _before(rows: DataFrame, end: Column) -> DataFrame:
    """Rows of each document before its first end row."""
    first = F.min(F.when(end, F.struct(*ORDER))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("_end", first).filter(F.col("_end").isNull() | (F.struct(*ORDER) < F.col("_end"))).drop("_end")


def content_lines(lines: DataFrame, titles: DataFrame | None = None, watermarks: list[str] | None = None) -> DataFrame:
    """The lines of the content with body, level and title: contents list, cover, last pages, front matter notes and dates, publication data, sections left out, exercises,
    noise, and all from the appendix or a terminal section on are gone. titles: configured titles (doc_id, title)."""
    from voltlake.session import cut

    lines = cut(lines)  # read for sizes, contents, covers and repeated lines
    sizes = cut(body_size(lines))
    marked = cut(with_noise(lines, sizes, watermarks))  # read for last pages, titles and the content
    contents = cut(contents_pages(lines))
    detected = title_lines(marked, contents)
    gone = contents.unionByName(cover_pages(lines, sizes)).unionByName(trailing_pages(marked)).distinct()
    x = marked.join(gone, ["doc_id", "page"], "left_anti").withColumn("level", line_level())
    t, bare = F.col("text"), compact(F.col("text"))
    # front matter of the first three pages: notes, and a date with the label before it
    before = F.lag(F.when(F.col("page") <= 3, t)).over(Window.partitionBy("doc_id").orderBy(*ORDER))
    front = (F.col("page") <= 3) & (t.rlike(NOTE) | t.rlike(DATE_LABEL) | (t.rlike(DATE_VALUE) & F.coalesce(before.rlike(DATE_LABEL), F.lit(False))))
    x = x.withColumn("_front", front).filter("not _front").drop("_front")
    x = _before(x, t.rlike(APPENDIX) & (F.col("size") >= F.col("body") * 1.15) & ~t.rlike(LEADERS))
    names = lines.select("doc_id").distinct().join(detected.select("doc_id", F.col("title").alias("seen"), F.col("page").alias("_p"), F.col("pos").alias("_i")), "doc_id", "left")
    names = names.join(titles.select("doc_id", F.col("title").alias("set")), "doc_id", "left") if titles is not None else names.withColumn("set", F.lit(None).cast("string"))
    title = reconciled_title(F.col("seen"), F.col("set"))
    names = names.select("doc_id", title.alias("title"), *[F.when(F.coalesce(title == F.col("seen"), F.lit(False)), F.col(c)).alias(c) for c in ("_p", "_i")])
    x = x.join(names, "doc_id").filter(~F.coalesce((F.col("page") == F.col("_p")) & (F.col("pos") == F.col("_i")), F.lit(False)) & (t != F.col("title"))).drop("_p", "_i")
    x = x.filter(~F.col("noise")).drop("noise")
    heading = (F.col("level") > 0) & clean_heading(t).isin(*EXCLUDED)
    x = _until(x, heading, F.col("level") == 1)
    x = _until(x, t.rlike(PUBLICATION), (F.col("level") == 1) & (clean_heading(t).rlike(RESTART) | t.rlike(CHAPTER)))
    x = _before(x, (F.col("level") > 0) & F.regexp_replace(t, r"[\s:：]+", "").isin(*TERMINAL))
    return _until(x, bare.rlike(EXERCISES), F.col("level") == 1)


def sections(content: DataFrame) -> DataFrame:
    """doc_id, title, section_no, h1 to h4, text: the content's lines under the headings in force. Lines of one heading that is broken over lines are joined; a numbered
    heading of level 3 or 4 is also the first line of its text."""
    w = Window.partitionBy("doc_id").orderBy(*ORDER)
    lag = lambda c: F.lag(c).over(w)
    wrapped = (
        (F.col("level") > 0) & (lag("level") == F.col("level")) & (lag("page") == F.col("page")) & (F.abs(lag("size") - F.col("size")) <= F.greatest(lag("size"), F.col("size")) * 0.05)
        & (F.abs(lag("x0") - F.col("x0")) <= 20) & (F.col("y0") - lag("y1")).between(F.lit(0.0), F.col("body") * 1.5) & ~(lag("level").isin(3, 4) & lag("text").rlike(NUMBERED))
    )
    x = content.withColumn("_new", ((F.col("level") > 0) & ~F.coalesce(wrapped, F.lit(False))).cast("int"))
    x = x.withColumn("section_no", F.sum("_new").over(w))
    place = F.struct("page", "pos")
    rows = x.groupBy("doc_id", "section_no").agg(
        F.max("title").alias("title"), F.min(place).alias("at"), F.max(F.when(F.col("_new") == 1, F.col("level"))).alias("level"),
        F.array_sort(F.collect_list(F.when(F.col("level") > 0, F.struct("page", "pos", "text")))).alias("heads"), F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("page", "pos", "text")))).alias("body_lines"),
    )  # one section's lines
    whole = F.aggregate(F.transform("heads", lambda h: h["text"]), F.lit(""), lambda s, h: F.when(s.rlike("[A-Za-z0-9]$") & h.rlike("^[A-Za-z0-9]"), F.concat(s, F.lit(" "), h)).otherwise(F.concat(s, h)))
    rows = rows.withColumn("_whole", whole).withColumn("heading", clean_heading(F.col("_whole")))
    own = F.when((F.col("level") >= 3) & F.col("_whole").rlike(NUMBERED), F.array(F.trim(F.regexp_extract("_whole", NUMBERED, 2)))).otherwise(F.array().cast("array<string>"))
    by = Window.partitionBy("doc_id").orderBy("section_no")
    last = lambda n: F.last(F.when(F.col("level") == n, F.struct("section_no", "heading")), ignorenulls=True).over(by)
    rows = rows.withColumns({f"_{n}": last(n) for n in range(1, 5)})
    no = lambda n: F.coalesce(F.col(f"_{n}.section_no"), F.lit(-1))
    heads = {"h1": F.coalesce("_1.heading", F.lit(""))}
    for n in range(2, 5):
        heads[f"h{n}"] = F.when(no(n) > F.greatest(*[no(k) for k in range(1, n)], F.lit(-1)), F.col(f"_{n}.heading")).otherwise("")
    text = F.array_join(F.concat(own, F.transform("body_lines", lambda b: b["text"])), "\n")
    return rows.withColumns(heads).select("doc_id", "title", "section_no", "h1", "h2", "h3", "h4", text.alias("text"))


def split_documents(lines: DataFrame, titles: DataFrame | None = None, limit: int = 1500, watermarks: list[str] | None = None) -> DataFrame:
    """chunk_id, doc_id, chunk_no, title, chapter_title, section_title, third_title, fourth_title, text, context: the chunks of documents.

    Parts of under 8 characters, or that repeat a heading, and the first chunks in a row that are cover or copyright are left out; context puts title and headings before
    the text."""
    s = sections(content_lines(lines, titles, watermarks)).filter("text <> ''")
    names = ["doc_id", "title", "section_no", "h1", "h2", "h3", "h4"]
    kinds = dict(s.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*[getattr(r, c) for c in names], i, p) for r in pdf.itertuples() for i, p in enumerate(pack_with_overlap(r.text, limit), 1)]
            yield pd.DataFrame(rows, columns=[*names, "part_no", "text"])

    parts = s.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", part_no int, text string")
    same = F.lit(False)
    for h in ("h1", "h2", "h3", "h4"):
        same = same | ((F.col(h) != "") & (clean_heading(stripped(F.col("text"))) == F.col(h)))
    parts = parts.filter((F.length(compact(F.col("text"))) >= 8) & ~(same & (F.length("text") < 30)))
    w = Window.partitionBy("doc_id").orderBy("section_no", "part_no")
    cover = F.concat_ws(" ", "h1", "h2", "h3", "h4").rlike(COVER_HEADING) | F.col("text").rlike(COVER_TEXT)
    parts = parts.withColumn("_c", F.max((~cover).cast("int")).over(w)).filter("_c = 1").withColumn("chunk_no", F.row_number().over(w))
    context = F.array_join(F.filter(F.array("title", "h1", "h2", "h3", "h4", "text"), lambda x: x != ""), "\n")
    return parts.select(
        F.format_string("%s_%06d", F.coalesce("title", F.lit("")), F.col("chunk_no")).alias("chunk_id"), "doc_id", "chunk_no", "title", F.col("h1").alias("chapter_title"), F.col("h2").alias("section_title"),
        F.col("h3").alias("third_title"), F.col("h4").alias("fourth_title"), "text", context.alias("context"),
    )


def is_formula_font(font: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(font, F.lit(""))), "[^a-z0-9]+", "")
    out = F.lit(False)
    for f in FORMULA_FONTS:
        out = out | bare.contains(f)
    return out


def formula_lines(spans: DataFrame, mark: str = "[公式]") -> DataFrame:
    """doc_id, page, pos, text of spans (doc_id, page, pos, span_no, text, font): spans in formula fonts become one mark a run, and lines that are nothing but marks are one line a
    run. A multiplication dot between letters or digits stays what it is."""
    w = Window.partitionBy("doc_id", "page", "pos").orderBy("span_no")
    left, right = F.coalesce(F.lag("text").over(w), F.lit("")), F.coalesce(F.lead("text").over(w), F.lit(""))
    dot = F.trim("text").isin("⋅", "·") & left.rlike(r"[\p{L}\p{N}]$") & right.rlike(r"^[\p{L}\p{N}]")
    x = spans.withColumn("_f", is_formula_font(F.col("font")) & ~dot & (F.trim("text") != ""))
    g = x.groupBy("doc_id", "page", "pos").agg(F.array_sort(F.collect_list(F.struct("span_no", F.when(F.col("_f"), F.lit(mark)).otherwise(F.col("text")).alias("t")))).alias("a"))  # one line's spans
    quoted = mark.replace("[", r"\[").replace("]", r"\]")
    text = F.trim(F.regexp_replace(F.array_join(F.transform("a", lambda s: s["t"]), ""), rf"(?:{quoted}\s*)+", mark))
    rows = g.select("doc_id", "page", "pos", text.alias("text")).filter("text <> ''")
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy(*ORDER))
    return rows.withColumn("_b", before).filter(~((F.col("text") == mark) & F.coalesce(F.col("_b") == mark, F.lit(False)))).drop("_b")


def without_cited(text: Column, references: Column) -> Column:
    """The text without the sentences that cite one of the references (an array), longest first."""
    def drop(t: Column, r: Column) -> Column:
        sign = F.regexp_replace(r, r"([^\p{L}\p{N}\s])", r"\\$1")
        return F.regexp_replace(t, F.concat(F.lit(r"(?i)[^。！？.!?\n]*"), sign, F.lit(r"[^。！？.!?\n]*[。！？.!?]?")), F.lit(""))

    order = F.array_sort(F.filter(references, lambda r: r.isNotNull() & (r != "")), lambda a, b: F.length(b) - F.length(a))
    out = F.aggregate(order, text, drop)
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n"))


def picture_name(caption: Column, extension: Column) -> Column:
    """The first figure or table reference of a caption, without white space, else the caption, else image; with the extension (png without one)."""
    found = F.regexp_replace(F.regexp_extract(caption, r"(?:图|表|Figure|Fig\.|Table)\s*[0-9]+(?:[.-][0-9]+)*", 0), r"\s+", "")
    base = F.when(caption.rlike(r"^图表\d"), F.lit("")).otherwise(F.coalesce(found, F.lit("")))
    clean = F.translate(F.regexp_replace(F.trim(F.coalesce(caption, F.lit(""))), r"[\x00-\x1f\x7f]", ""), ":/\\", "：／＼")
    end = F.regexp_replace(F.lower(F.coalesce(extension, F.lit(""))), r"^\.+", "")
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.nullif(clean, F.lit("")), F.lit("image")), F.lit("."), F.coalesce(F.nullif(end, F.lit("")), F.lit("png")))


def touching(rects: DataFrame, gap: float = 1.5, share: float = 0.8) -> DataFrame:
    """a, b of rectangles (doc_id, page, rect_id, x0, y0, x1, y1) of one page that touch: gap points apart at most and level by `share` of the narrower side.

    An equi-join on cells of CELL points that a rectangle reaches with its gap, not of all pairs of a page."""
    cell = 64.0
    span = lambda a, b: F.sequence(F.floor((a - gap) / cell), F.floor((b + gap) / cell))
    r = rects.withColumn("cx", F.explode(span(F.col("x0"), F.col("x1")))).withColumn("cy", F.explode(span(F.col("y0"), F.col("y1"))))
    a = r.select("doc_id", "page", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("rect_id", "x0", "y0", "x1", "y1")])
    b = r.select("doc_id", "page", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("rect_id", "x0", "y0", "x1", "y1")])
    j = a.join(b, ["doc_id", "page", "cx", "cy"]).filter("a_rect_id < b_rect_id")
    over = lambda s: F.greatest(F.lit(0.0), F.least(f"a_{s}1", f"b_{s}1") - F.greatest(f"a_{s}0", f"b_{s}0"))
    apart = lambda s: F.greatest(F.lit(0.0), F.greatest(f"a_{s}0", f"b_{s}0") - F.least(f"a_{s}1", f"b_{s}1"))
    least = lambda s: F.least(F.col(f"a_{s}1") - F.col(f"a_{s}0"), F.col(f"b_{s}1") - F.col(f"b_{s}0")) * share
    ok = ((apart("y") <= gap) & (over("x") >= least("x"))) | ((apart("x") <= gap) & (over("y") >= least("y")))
    return j.filter(ok).select(F.col("a_rect_id").alias("a"), F.col("b_rect_id").alias("b")).distinct()


def picture_regions(rects: DataFrame) -> DataFrame:
    """rect_id, region, x0, y0, x1, y1: the region (its least rectangle) and its bounds of rectangles that touch, directly or through others."""
    from voltlake.operators.graph import components

    linked = components(touching(rects)).select(F.col("node").alias("rect_id"), F.col("component").alias("region"))
    x = rects.join(linked, "rect_id", "left").withColumn("region", F.coalesce("region", "rect_id"))
    bounds = x.groupBy("region").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return x.select("rect_id", "region").join(bounds, "region")
