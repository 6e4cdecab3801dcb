"""Page-level queries. Documents stand for paged files: forty lines a page, larger and bold type for numbered headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions import text as T
from voltlake.operators import etl as X
from voltlake.operators import pages as P
from voltlake.plans.base import DOCS_SQL, docs
from voltlake.plans.etl import LEVEL_SQL, LINES_SQL

PAGE = 40


# A tenth of the documents get a cover and a contents list in front.
FRONT = ["目录", *(f"{i} 第{n}部分 ......... {i * 7}" for i, n in enumerate("一二三四五六", 1))]


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d)
    fronted = F.col("doc_id") % 10 == 0
    l = X.lines(t).withColumn("level", T.heading_level(F.col("line")))
    size = F.when(F.col("level") == 1, 18.0).when(F.col("level") == 2, 14.0).when(F.col("level") == 3, 12.0).otherwise(10.5)
    page = (F.floor((F.col("pos") - 1) / PAGE) + F.when(fronted, 3).otherwise(1)).cast("int")
    body = l.select("doc_id", page.alias("page"), (F.pmod(F.col("pos") - 1, F.lit(PAGE)) + 1).alias("pos"), F.col("line").alias("text"), size.alias("size"), F.col("level").isNotNull().alias("bold"))
    line = lambda p, i, x, s, b: F.struct(F.lit(p).alias("page"), F.lit(i).alias("pos"), x.alias("text"), F.lit(s).alias("size"), F.lit(b).alias("bold"))
    name = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("手册"))
    front = F.array(line(1, 1, name, 24.0, True), *[line(2, i, F.lit(x), 16.0 if i == 1 else 10.5, i == 1) for i, x in enumerate(FRONT, 1)])
    l = body.unionByName(t.filter(fronted).select("doc_id", F.inline(front)))
    y0 = 50.0 + (F.col("pos") - 1) * 18.0
    return l.withColumns({"x0": F.lit(72.0), "y0": y0, "x1": 72.0 + F.least(F.length("text") * 10.5, F.lit(450.0)), "y1": y0 + 12.0, "page_width": F.lit(595.0), "page_height": F.lit(842.0)})


def page_body_size(spark, d):
    """AGG-6, WIN-7: the body size of each document."""
    return P.body_size(page_lines(spark, d))


def page_contents(spark, d):
    """AGG-8, DOC-10, WIN-8: pages of contents lists."""
    return P.contents_pages(page_lines(spark, d))


def page_cover(spark, d):
    """AGG-9, DOC-10: cover pages."""
    l = page_lines(spark, d)
    return P.cover_pages(l, P.body_size(l))


def page_ignored(spark, d):
    """SET-4, DOC-10: pages of any kind that hold no content, each once."""
    l = page_lines(spark, d)
    sizes = P.body_size(l)
    return P.contents_pages(l).unionByName(P.cover_pages(l, sizes)).unionByName(P.trailing_pages(P.with_noise(l, sizes))).distinct()


def page_noise(spark, d):
    """DOC-8: lines of each document and how many are noise."""
    l = page_lines(spark, d)
    return P.with_noise(l, P.body_size(l)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("noise").alias("noise"))


def page_titles(spark, d):
    """AGG-13, DOC-11: the detected title against the configured one."""
    l = page_lines(spark, d)
    found = P.title_lines(P.with_noise(l, P.body_size(l)), P.contents_pages(l)).select("doc_id", F.col("title").alias("seen"))
    return docs(spark, d).select("doc_id", "title").distinct().join(found, "doc_id", "left").select("doc_id", "seen", P.reconciled_title(F.col("seen"), F.col("title")).alias("title"))


def page_levels(spark, d):
    """DOC-1, 7: lines by their level, from form and type."""
    l = page_lines(spark, d)
    return l.join(P.body_size(l), "doc_id").withColumn("level", P.line_level()).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def page_chunks(spark, d):
    """DOC-2, 12, 13, 14, 15, 25: the chunks of all documents."""
    titles = docs(spark, d).groupBy("doc_id").agg(F.max("title").alias("title"))
    return P.split_documents(page_lines(spark, d), titles)


def cited_sentences(spark, d):
    """DOC-20: texts of chunks without the sentences that cite a figure or table of their own, where there are any."""
    t = docs(spark, d).select("doc_id", F.concat("text", F.lit("接线见图 3-1。")).alias("text"))
    return t.select("doc_id", F.md5(P.without_cited(F.col("text"), T.references(F.col("text")))).alias("digest"))


def picture_names(spark, d):
    """DOC-22: object names of pictures from captions."""
    caption = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("图 "), F.col("doc_id") % 9 + 1, F.lit("-2 "))).otherwise(""), F.coalesce("title", F.lit("")))
    return docs(spark, d).select("doc_id", P.picture_name(caption, F.when(F.col("doc_id") % 2 == 0, ".PNG")).alias("name"))


QUERIES = {f.__name__: f for f in (page_body_size, page_contents, page_cover, page_ignored, page_noise, page_titles, page_levels, page_chunks, cited_sentences, picture_names)}

_N = r"length(regexp_replace(text, '[\s\x{3000}\x{00a0}]+', '', 'g'))"
_BARE = r"regexp_replace(text, '[\s\x{3000}\x{00a0}]+', '', 'g')"
_NUMBER = r"regexp_matches(text, '^[ \x{3000}]*(?:-[ ]*)?(?:第[ ]*)?[0-9]{1,4}(?:[ ]*页)?(?:[ ]*-)?[ \x{3000}]*$')"
_CAPTION = r"regexp_matches(text, '^[ \x{3000}]*(?:图|表|附图|附表|Figure|Fig\.|Table)[ \x{3000}]*[0-9]+')"
_FRONT = ", ".join(f"({i}, '{x}')" for i, x in enumerate(FRONT, 1))
_PL = f"""WITH {DOCS_SQL}, {LINES_SQL}, pw AS (SELECT doc_id, CAST((pos - 1) // {PAGE} + CASE WHEN doc_id % 10 = 0 THEN 3 ELSE 1 END AS INTEGER) AS page, CAST((pos - 1) % {PAGE} + 1 AS INTEGER) AS pos, line AS text,
   CASE lv WHEN 1 THEN 18.0 WHEN 2 THEN 14.0 WHEN 3 THEN 12.0 ELSE 10.5 END::DOUBLE AS size FROM (SELECT *, {LEVEL_SQL} AS lv FROM ln)
   UNION ALL SELECT doc_id, 1, 1, coalesce(nullif(trim(title), ''), '手册'), 24.0 FROM t WHERE doc_id % 10 = 0
   UNION ALL SELECT doc_id, 2, i, x, CASE WHEN i = 1 THEN 16.0 ELSE 10.5 END FROM t, (VALUES {_FRONT}) v(i, x) WHERE doc_id % 10 = 0),
 pl AS (SELECT *, 50.0 + (pos - 1) * 18.0 AS y0, 72.0 + least(length(text) * 10.5, 450.0) AS x1 FROM pw),
 g AS (SELECT doc_id, size, sum(CASE WHEN length(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) >= 8 AND {_N} >= 15 AND x1 - 72.0 >= 595.0 * 0.25 AND NOT {_NUMBER} AND NOT {_CAPTION} AND NOT regexp_matches(text, '[.．…·]{{4,}}') THEN least({_N}, 120) ELSE 0 END) AS w,
   sum(greatest({_N}, 1)) AS al FROM pl GROUP BY 1, 2),
 rn AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY size) AS run, sum(w) OVER (PARTITION BY doc_id) AS total FROM g),
 bs AS (SELECT doc_id, coalesce(min(size) FILTER (total > 0 AND w > 0 AND run >= total * 0.75), arg_min(size, (-al, size))) AS body FROM rn GROUP BY 1)"""
_CONTENTS = rf"""pg AS (SELECT doc_id, page, bool_or(lower({_BARE}) IN ('目录', '目次', 'contents') AND NOT {_NUMBER}) AS title, count(*) FILTER (regexp_matches(text, '^\s*\d+(\.\d+){{0,3}}(\s+\S+|[\x{{4e00}}-\x{{9fff}}]\S*)') AND length(text) <= 100) AS items,
   count(*) FILTER ({_N} >= 45) AS prose, count(*) FILTER ({_N} >= 20 AND regexp_matches(text, '[，。；：,;:]')) AS sentences, count(*) FILTER (regexp_matches(text, '(?:\.{{4,}}|·{{4,}})\s*\d+\s*$')) AS leaders FROM pl GROUP BY 1, 2),
 gn AS (SELECT *, leaders >= 4 OR (items >= 4 AND prose <= 2 AND sentences <= 3) AS cont FROM pg), isl AS (SELECT *, sum(CASE WHEN title OR cont THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page) AS i FROM gn),
 cp AS (SELECT doc_id, page FROM (SELECT *, bool_or(title) OVER (PARTITION BY doc_id, i ORDER BY page) AS started FROM isl) WHERE title OR (cont AND started))"""
_COVER = f"""cv AS (SELECT pl.doc_id, page FROM pl JOIN bs ON bs.doc_id = pl.doc_id WHERE page = 1 GROUP BY 1, 2 HAVING sum(CASE WHEN {_NUMBER} THEN 0 ELSE {_N} END) <= 180 AND bool_or(size >= body * 1.8 AND y0 <= 842.0 * 0.55))"""
SQL = {
    "page_body_size": f"{_PL} SELECT doc_id, body FROM bs",
    "page_contents": f"{_PL}, {_CONTENTS} SELECT doc_id, page FROM cp",
    "page_cover": f"{_PL}, {_COVER} SELECT doc_id, page FROM cv",
    "picture_names": r"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '图 ' || (doc_id % 9 + 1) || '-2 ' ELSE '' END || coalesce(title, '') AS c, CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'png' END AS e FROM documents),
 y AS (SELECT *, regexp_replace(regexp_extract(c, '(?:图|表|Figure|Fig\.|Table)\s*[0-9]+(?:[.-][0-9]+)*'), '\s+', '', 'g') AS f FROM x)
 SELECT doc_id, CASE WHEN f <> '' AND NOT regexp_matches(c, '^图表\d') THEN f WHEN trim(c) <> '' THEN translate(regexp_replace(trim(c), '[\x00-\x1f\x7f]', '', 'g'), ':/\', '：／＼') ELSE 'image' END || '.' || e AS name FROM y""",
}
