"""Document ETL, validation and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions import text as T
from voltlake.operators import etl as X
from voltlake.operators.knn import exact_knn
from voltlake.plans.base import CHUNK_TEXTS, CHUNKS_SQL, DOCS_SQL, chunk_texts, docs
from voltlake.session import table

CITES = "接线见图 3-1，数据见表 2-4.1、图 3-1。"
HEADINGS = ["title", "chapter_title", "section_title", "third_title", "fourth_title", "text"]


def document_lines(spark, d):
    """SRC-6, DOC-18: lines a document, characters and distinct lines."""
    l = X.lines(docs(spark, d))
    return l.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("line").alias("distinct_lines"), F.sum(F.length("line")).alias("chars"))


def heading_levels(spark, d):
    """DOC-1, 7"""
    l = X.lines(docs(spark, d)).filter(F.length("line") <= 60).withColumn("level", T.heading_level(F.col("line"))).filter("level is not null")
    return l.select("doc_id", "pos", "level", T.strip_heading_number(F.col("line")).alias("heading"))


def heading_carry(spark, d):
    """WIN-5"""
    c = X.carried_headings(X.lines(docs(spark, d)))
    return c.groupBy("doc_id").agg(F.countDistinct("h1").alias("h1"), F.countDistinct("h2").alias("h2"), F.countDistinct("h3").alias("h3"), F.count_if(F.col("h2") != "").alias("under_h2"))


def chunk_ids(spark, d):
    """WIN-9: identity of a chunk from title and place."""
    w = F.row_number().over(X.Window.partitionBy("title").orderBy("chunk_index", "chunk_id"))
    c = chunk_texts(spark, d).filter("title is not null").withColumn("n", w)
    return c.select("chunk_id", F.format_string("%s_%06d", F.col("title"), F.col("n")).alias("new_id"))


def context_text(spark, d):
    """DOC-14"""
    return chunk_texts(spark, d).select("chunk_id", F.md5(X.contextual_text(None)).alias("digest"))


def short_descriptions(spark, d):
    """DOC-24: a text of few signs is its own description; others keep theirs."""
    t = F.coalesce("text", F.lit(""))
    return chunk_texts(spark, d).select("chunk_id", F.when(T.effective_length(t) < 50, T.stripped(t)).otherwise(F.col("description")).alias("description"))


def small_parts(spark, d):
    """DOC-13: parts too small, or no more than a heading."""
    t = T.stripped(F.coalesce("text", F.lit("")))
    same = F.greatest(*[(T.strip_heading_number(t) == T.strip_heading_number(F.coalesce(h, F.lit("")))).cast("int") for h in HEADINGS[1:5]]) == 1
    return chunk_texts(spark, d).select("chunk_id", X.is_small(F.col("text")).alias("small"), (same & (F.length(t) < 30) & (t != "")).alias("heading_only"))


def margin_repeat(spark, d):
    """AGG-7: documents of a source as its pages."""
    rows = X.lines(docs(spark, d)).join(docs(spark, d).select("doc_id", "source"), "doc_id")
    return X.repeated_margins(rows, "source", "doc_id")


def line_size_quantile(spark, d):
    """AGG-6, WIN-7: line lengths stand for font sizes, weights are at most 120."""
    rows = X.lines(docs(spark, d)).join(docs(spark, d).select("doc_id", "source"), "doc_id").select("source", F.least(F.length("line"), F.lit(400)).alias("size"), F.least(F.length("line"), F.lit(120)).alias("w"))
    return X.weighted_quantile(rows, "source", "size", "w")


def trailing_pages(spark, d):
    """AGG-10"""
    p = docs(spark, d).select("source", "doc_id", T.effective_length(F.col("text")).alias("chars"))
    return X.trailing(p, "source", "doc_id", "chars", 400).select("source", "doc_id")


def toc_pages(spark, d):
    """AGG-8: counts a page that tell a table of contents."""
    l = X.lines(docs(spark, d))
    return l.groupBy("doc_id").agg(
        F.count_if(F.col("line").rlike(r"[.…·]{3,}[ ]*[0-9]+$")).alias("leaders"), F.count_if(F.col("line").rlike("[。！？!?]")).alias("sentences"), F.count_if(T.heading_level(F.col("line")).isNotNull()).alias("headings"),
        F.count_if(T.is_page_number(F.col("line"))).alias("page_numbers"), F.count_if(T.is_caption(F.col("line"))).alias("captions"),
    )


def reference_lists(spark, d):
    """DOC-20: figure and table references in order, each once; a third of the texts cite some."""
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, CITES).otherwise(""))
    return docs(spark, d).select("doc_id", F.array_join(T.references(text), ",").alias("refs")).filter("refs <> ''")


def answer_slices(spark, d):
    """DOC-28"""
    return docs(spark, d).select("doc_id", F.posexplode(T.fixed_slices(F.col("text"), 400)).alias("pos", "slice")).select("doc_id", "pos", F.md5("slice").alias("digest"))


def long_splits(spark, d):
    """DOC-3, 4: rows only; joined pieces are the text."""
    return docs(spark, d).filter("text <> ''").select("doc_id", F.posexplode(X.long_split(F.col("text"), 1800)).alias("pos", "piece"))


def chunk_pack(spark, d):
    """DOC-2, 5, WIN-6: rows only."""
    return X.packed_sections(docs(spark, d), "doc_id", 800)


def file_routes(spark, d):
    """SRC-11"""
    return docs(spark, d).select("doc_id", X.file_kind(F.col("title")).alias("kind"))


def object_names(spark, d):
    """DOC-21: rows only."""
    return docs(spark, d).select("doc_id", X.object_name(F.concat_ws("/", "source", "title")).alias("name"))


def mojibake(spark, d):
    """DOC-27: rows only."""
    return docs(spark, d).select("doc_id", F.length(X.repair_mojibake(F.col("text"))).alias("chars"))


def json_recover(spark, d):
    """FLT-18, 20: rows only."""
    e = table(spark, d, "events")
    return e.select("event_id", X.first_json_object(F.concat(F.lit("result: "), "props", F.lit(" end"))).alias("object"))


def json_greedy(spark, d):
    """FLT-19"""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object(X.greedy_json(F.concat(F.lit("x "), "props", F.lit(" y"))), "$.k").alias("k"))


def heading_strip(spark, d):
    """DOC-16"""
    return chunk_texts(spark, d).select("chunk_id", T.strip_heading_number(F.coalesce("chapter_title", F.lit(""))).alias("chapter"), T.strip_heading_number(F.coalesce("section_title", F.lit(""))).alias("section"))


def validate_chunks(spark, d):
    """FLT-1, 2: rows of the table as they stand."""
    return table(spark, d, "chunks").distinct().select("chunk_id", X.chunk_errors(None).alias("errors")).filter("errors <> ''")


def duplicate_chunks(spark, d):
    """SRC-1: ids in more than one row."""
    return table(spark, d, "chunks").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def vector_widths(spark, d):
    """SNK-4, 5: widths of the vectors."""
    return table(spark, d, "chunks").distinct().groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).filter("width >= 0")


def pending_vectors(spark, d):
    """JOIN-3, DOC-26: chunks still without a usable vector."""
    have = table(spark, d, "chunks").filter("size(embedding) = 64").select("chunk_id").distinct()
    return chunk_texts(spark, d).select("chunk_id").join(have, "chunk_id", "left_anti")


def carried_descriptions(spark, d):
    """JOIN-4: descriptions of chunks with the same title and headings."""
    c = chunk_texts(spark, d)
    keys = HEADINGS[:5]
    return X.with_old_values(c.select("chunk_id", *keys), c.select(*keys, "description"), keys, "description").select("chunk_id", F.md5("old_description").alias("digest"))


def table_counts(spark, d):
    """SNK-11, AGG-12"""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "chunks"]
    out = None
    for n in names:
        c = table(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def _points(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return l.select(F.col("p_brand").alias("entity"), F.col("l_returnflag").alias("metric"), F.date_format("l_shipdate", "yyyy-MM").alias("x"), F.col("l_quantity").alias("value"))


def series_points(spark, d):
    """FUS-13: points of each series."""
    return _points(spark, d).groupBy("entity", "metric", "x").agg(F.round(F.sum("value"), 4).alias("value"))


def series_validate(spark, d):
    """FLT-3, 10, 17"""
    return X.series_status(_points(spark, d), ["entity", "metric"])


def metric_pick(spark, d):
    """FUS-12: for each query vector the nearest vector of each label, an equal id first."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label").filter("vec_id is not null")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    # one search a label: the label is the group, and each query asks every label (a fixed set of few)
    labels = sorted(r.label for r in e.select("label").distinct().collect() if r.label is not None)
    asked = q.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels] or [F.lit(0)]))).select(F.concat_ws(":", "query_id", "label").alias("qk"), "qv", "label")
    found = exact_knn(asked, e, "qk", "qv", "vec_id", "embedding", 1, group="label")
    return found.select(F.split("qk", ":")[0].cast("bigint").alias("query_id"), F.split("qk", ":")[1].cast("int").alias("label"), F.col("vec_id").cast("bigint").alias("vec_id"), "cosine")


QUERIES = {f.__name__: f for f in (
    document_lines, heading_levels, heading_carry, chunk_ids, context_text, short_descriptions, small_parts, margin_repeat, line_size_quantile, trailing_pages, toc_pages, reference_lists, answer_slices,
    long_splits, chunk_pack, file_routes, object_names, mojibake, json_recover, json_greedy, heading_strip, validate_chunks, duplicate_chunks, vector_widths, pending_vectors, carried_descriptions, table_counts,
    series_points, series_validate, metric_pick,
)}

_WS = r"[ \t\r\n\x{3000}]+"
_STRIP = lambda x: rf"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"
_LINES = rf"""ln AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, source, list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda s: {_STRIP('s')}), lambda s: s <> '') AS l FROM t))"""
_EFF = lambda x: rf"length(regexp_replace({x}, '[ \t\r\n\x{{3000}}\x{{00a0}}]+', '', 'g'))"
_H = r"^[ \x{3000}]*"
_LEVEL = rf"""CASE WHEN regexp_matches(line, '{_H}第[一二三四五六七八九十百零]+章') THEN 1 WHEN regexp_matches(line, '{_H}[0-9]+\.[0-9]+\.[0-9]+') THEN 3 WHEN regexp_matches(line, '{_H}[0-9]+\.[0-9]+([^0-9%．.]|$)') THEN 2
 WHEN regexp_matches(line, '{_H}[0-9]+[.、]([^0-9]|$)') THEN 1 WHEN regexp_matches(line, '{_H}[一二三四五六七八九十]+、') THEN 1 WHEN regexp_matches(line, '{_H}（[一二三四五六七八九十]+）') THEN 2 END"""


def _bare(x: str) -> str:
    for _ in range(3):
        x = rf"regexp_replace({x}, '^[ \x{{3000}}]*(?:第[一二三四五六七八九十百零0-9]+[章节篇部][ \x{{3000}}]*|[0-9]+(?:\.[0-9]+)*[.、． \x{{3000}}]+|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十0-9]+[）)])', '')"
    return rf"regexp_replace(trim({x}), '([\x{{4e00}}-\x{{9fff}}])[ \x{{3000}}]+', '\1', 'g')"


LINES_SQL, LEVEL_SQL = _LINES, _LEVEL  # shared with the page queries
_D = f"WITH {DOCS_SQL}, {_LINES}"
_CH = f"WITH {CHUNKS_SQL}"
SQL = {
    "document_lines": f"{_D} SELECT doc_id, count(*) AS lines, count(DISTINCT line) AS distinct_lines, sum(length(line))::BIGINT AS chars FROM ln GROUP BY 1",
    "heading_levels": f"{_D} SELECT doc_id, pos, level, {_bare('line')} AS heading FROM (SELECT *, {_LEVEL} AS level FROM ln WHERE length(line) <= 60) WHERE level IS NOT NULL",
    "heading_carry": f"""{_D}, a AS (SELECT *, {_LEVEL} AS level FROM ln), b AS (SELECT *, {', '.join(f"coalesce(max(CASE WHEN level = {n} THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS p{n}" for n in (1, 2, 3))} FROM a),
 c AS (SELECT b.doc_id, coalesce(x.line, '') AS h1, CASE WHEN p2 > p1 THEN y.line ELSE '' END AS h2, CASE WHEN p3 > p2 AND p3 > p1 THEN z.line ELSE '' END AS h3 FROM b LEFT JOIN a x ON x.doc_id = b.doc_id AND x.pos = p1 LEFT JOIN a y ON y.doc_id = b.doc_id AND y.pos = p2 LEFT JOIN a z ON z.doc_id = b.doc_id AND z.pos = p3)
 SELECT doc_id, count(DISTINCT h1) AS h1, count(DISTINCT h2) AS h2, count(DISTINCT h3) AS h3, count(*) FILTER (h2 <> '') AS under_h2 FROM c GROUP BY 1""",
    "chunk_ids": f"{_CH} SELECT chunk_id, title || '_' || lpad(CAST(row_number() OVER (PARTITION BY title ORDER BY chunk_index NULLS FIRST, chunk_id) AS VARCHAR), 6, '0') AS new_id FROM d WHERE title IS NOT NULL",
    "context_text": f"{_CH} SELECT chunk_id, md5(array_to_string(list_filter([{', '.join(f'trim(coalesce({c}, {chr(39)}{chr(39)}))' for c in HEADINGS)}], lambda s: s <> ''), chr(10))) AS digest FROM d",
    "short_descriptions": f"{_CH} SELECT chunk_id, CASE WHEN {_EFF('coalesce(text, chr(32))')} < 50 THEN {_STRIP('coalesce(text, chr(32))')} ELSE description END AS description FROM d",
    "small_parts": f"{_CH}, x AS (SELECT *, {_STRIP('coalesce(text, chr(32))')} AS b FROM d) SELECT chunk_id, {_EFF('coalesce(text, chr(32))')} < 8 AS small, ({' OR '.join(f'{_bare(chr(98))} = {_bare(f"coalesce({h}, {chr(39)}{chr(39)})")}' for h in HEADINGS[1:5])}) AND length(b) < 30 AND b <> '' AS heading_only FROM x",
    "margin_repeat": f"{_D}, s AS (SELECT source, regexp_replace(line, '[0-9]+', '#', 'g') AS form, count(DISTINCT doc_id) AS pages FROM ln GROUP BY 1, 2), n AS (SELECT source, count(DISTINCT doc_id) AS total FROM ln GROUP BY 1) SELECT s.source, form, pages FROM s JOIN n ON n.source = s.source WHERE pages >= greatest(2, (total + 4) // 5)",
    "line_size_quantile": f"{_D}, g AS (SELECT source, least(length(line), 400) AS size, sum(least(length(line), 120)) AS w FROM ln WHERE source IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY source ORDER BY size) AS run, sum(w) OVER (PARTITION BY source) AS al FROM g) SELECT source, min(size) AS size FROM r WHERE run >= al * 0.75 GROUP BY 1",
    "trailing_pages": f"WITH {DOCS_SQL}, p AS (SELECT source, doc_id, {_EFF('text')} AS chars FROM t), l AS (SELECT source, max(doc_id) FILTER (chars >= 400) AS last FROM p GROUP BY 1) SELECT p.source, doc_id FROM p JOIN l ON l.source = p.source WHERE last IS NULL OR doc_id > last",
    "toc_pages": rf"{_D} SELECT doc_id, count(*) FILTER (regexp_matches(line, '[.…·]{{3,}}[ ]*[0-9]+$')) AS leaders, count(*) FILTER (regexp_matches(line, '[。！？!?]')) AS sentences, count(*) FILTER (({_LEVEL}) IS NOT NULL) AS headings, count(*) FILTER (regexp_matches(line, '^[ \x{{3000}}]*(?:-[ ]*)?(?:第[ ]*)?[0-9]{{1,4}}(?:[ ]*页)?(?:[ ]*-)?[ \x{{3000}}]*$')) AS page_numbers, count(*) FILTER (regexp_matches(line, '^[ \x{{3000}}]*(?:图|表|附图|附表|Figure|Fig\.|Table)[ \x{{3000}}]*[0-9]+')) AS captions FROM ln GROUP BY 1",
    "reference_lists": rf"WITH {DOCS_SQL}, x AS (SELECT doc_id, regexp_extract_all(text || CASE WHEN doc_id % 3 = 0 THEN '接线见图 3-1，数据见表 2-4.1、图 3-1。' ELSE '' END, '[图表][ ]?[0-9]+(?:[.-][0-9]+)*') AS l FROM t), y AS (SELECT doc_id, v, min(i) AS i FROM (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM x) GROUP BY 1, 2) SELECT doc_id, string_agg(v, ',' ORDER BY i) AS refs FROM y GROUP BY 1",
    "answer_slices": f"WITH {DOCS_SQL}, n AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 400.0) AS BIGINT))) AS i FROM t) SELECT doc_id, i::INTEGER AS pos, md5(substring(text, i * 400 + 1, 400)) AS digest FROM n",
    "file_routes": f"WITH {DOCS_SQL} SELECT doc_id, CASE WHEN title IS NULL OR title = '' THEN 'null' WHEN contains(lower(title), '.pdf') THEN 'pdf' WHEN contains(lower(title), '.docx') THEN 'docx' WHEN contains(lower(title), '.doc') THEN 'doc' ELSE 'unsupported' END AS kind FROM t",
    "json_greedy": "SELECT event_id, props->>'$.k' AS k FROM events",
    "heading_strip": f"{_CH} SELECT chunk_id, {_bare('coalesce(chapter_title, chr(32))')} AS chapter, {_bare('coalesce(section_title, chr(32))')} AS section FROM d",
    "validate_chunks": "WITH x AS (SELECT DISTINCT * FROM chunks), e AS (SELECT chunk_id, concat_ws('|', CASE WHEN coalesce(trim(chunk_id), '') = '' THEN 'chunk_id' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'text' END, CASE WHEN coalesce(trim(description), '') = '' THEN 'description' END, CASE WHEN embedding IS NULL THEN 'no vector' WHEN len(embedding) <> 64 THEN 'width' WHEN len(list_filter(embedding, lambda v: v IS NULL OR isnan(v))) > 0 THEN 'value' END) AS errors FROM x) SELECT * FROM e WHERE errors <> ''",
    "duplicate_chunks": "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "vector_widths": "WITH x AS (SELECT DISTINCT * FROM chunks) SELECT CAST(len(embedding) AS INTEGER) AS width, count(*) AS n FROM x WHERE embedding IS NOT NULL GROUP BY 1",
    "pending_vectors": f"{_CH} SELECT chunk_id FROM d WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE len(embedding) = 64 AND chunk_id IS NOT NULL)",
    "carried_descriptions": f"{_CH}, o AS (SELECT {', '.join(f'coalesce({c}, {chr(39)}{chr(39)}) AS k{i}' for i, c in enumerate(HEADINGS[:5]))}, max(description) AS old FROM d WHERE description IS NOT NULL GROUP BY ALL) SELECT chunk_id, md5(old) AS digest FROM d LEFT JOIN o ON {' AND '.join(f'coalesce(d.{c}, {chr(39)}{chr(39)}) = o.k{i}' for i, c in enumerate(HEADINGS[:5]))}",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "chunks"]),
    "series_points": "SELECT p_brand AS entity, l_returnflag AS metric, strftime(l_shipdate, '%Y-%m') AS x, round(sum(l_quantity), 4) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3",
    "series_validate": "SELECT p_brand AS entity, l_returnflag AS metric, count(*) AS n, round(sum(l_quantity), 4) AS total, CASE WHEN count(*) > 1000 THEN 'too many' WHEN min(l_quantity) < 0 THEN 'negative' WHEN sum(l_quantity) <= 0 THEN 'empty' ELSE 'ok' END AS status FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
    "metric_pick": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.label, e.vec_id, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS cosine FROM e q, e WHERE q.vec_id % 20 = 0) SELECT query_id, label, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY cosine DESC, CAST(vec_id AS VARCHAR)) AS r FROM p) WHERE r = 1",
}
