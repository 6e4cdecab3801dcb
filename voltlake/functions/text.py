"""Text columns: tokens, sentences, normal forms, counts. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One token for each Han sign, one for each run of other letters and digits.
TOKEN = r"[\x{4e00}-\x{9fff}]|[0-9a-z\x{00b5}\x{00c0}-\x{024f}\x{0370}-\x{03ff}\x{0400}-\x{04ff}]+"
HAN = r"[^\x{4e00}-\x{9fff}]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def stripped(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, r"^[ \t\r\n\x{3000}]+|[ \t\r\n\x{3000}]+$", "")


def han_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, HAN, ""))


def effective_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"[ \t\r\n\x{3000}\x{00a0}]+", ""))


def similarity_form(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and Han signs."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")


def clean_spaces(text: Column) -> Column:
    """No-break and ideographic spaces become spaces, runs of spaces one, ends are trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, " 　", "  "), "[ \t]+", " "))


def parts(text: Column, pattern: str) -> Column:
    """Non-blank stripped parts between separators."""
    return F.filter(F.transform(F.split(text, pattern), stripped), lambda s: s != "")


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)


# Stock phrases that a title query loses, in this order.
TITLE_PHRASES = ["请问", "请介绍一下", "介绍一下", "讲一下", "什么是", "有哪些", "有什么"]


def clean_title_query(query: Column) -> Column:
    """End signs, commas, colons, white space and stock phrases off; the trimmed query itself if nothing is left."""
    out = F.regexp_replace(query, r"[？?！!，,。；;：:\s\x{3000}]+", "")
    for p in TITLE_PHRASES:
        out = F.replace(out, F.lit(p), F.lit(""))
    return F.when(out == "", stripped(query)).otherwise(out)


def session_name(question: Column, limit: int = 30) -> Column:
    """The question up to its first end sign or line break, at most limit signs."""
    return F.substring(stripped(F.regexp_extract(question, r"^[\s\x{3000}]*([^？?；;。！!\r\n]*)", 1)), 1, limit)


def strip_heading_number(heading: Column, rounds: int = 3) -> Column:
    """Leading heading numbers off, repeatedly (bounded), and spaces between Han signs."""
    for _ in range(rounds):
        heading = F.regexp_replace(heading, r"^[ \x{3000}]*(?:第[一二三四五六七八九十百零0-9]+[章节篇部][ \x{3000}]*|[0-9]+(?:\.[0-9]+)*[.、． \x{3000}]+|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十0-9]+[）)])", "")
    return F.regexp_replace(F.trim(heading), r"([\x{4e00}-\x{9fff}])[ \x{3000}]+", "$1")


def heading_level(line: Column) -> Column:
    """Level of a heading by its form, null for other lines; the first form that matches wins."""
    h = r"^[ \x{3000}]*"
    return (
        F.when(line.rlike(h + "第[一二三四五六七八九十百零]+章"), 1)
        .when(line.rlike(h + r"[0-9]+\.[0-9]+\.[0-9]+"), 3)
        .when(line.rlike(h + r"[0-9]+\.[0-9]+(?:[^0-9%．.]|$)"), 2)
        .when(line.rlike(h + r"[0-9]+[.、](?:[^0-9]|$)"), 1)
        .when(line.rlike(h + "[一二三四五六七八九十]+、"), 1)
        .when(line.rlike(h + "（[一二三四五六七八九十]+）"), 2)
    )


def is_caption(line: Column) -> Column:
    return line.rlike(r"^[ \x{3000}]*(?:图|表|附图|附表|Figure|Fig\.|Table)[ \x{3000}]*[0-9]+")


def is_page_number(line: Column) -> Column:
    return line.rlike(r"^[ \x{3000}]*(?:-[ ]*)?(?:第[ ]*)?[0-9]{1,4}(?:[ ]*页)?(?:[ ]*-)?[ \x{3000}]*$")


def references(text: Column) -> Column:
    """Figure and table references in a text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[图表][ ]?[0-9]+(?:[.-][0-9]+)*"), F.lit(0)))


def fixed_slices(text: Column, size: int = 40) -> Column:
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def greedy_concat(units: Column, limit: int) -> Column:
    """Neighbouring units joined while they fit into limit: a higher-order fold, one text at a time."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, u: Column) -> Column:
        fits = F.length(s["open"]) + F.length(u) <= limit
        return F.struct(
            F.when(fits | (s["open"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"),
            F.when(fits, F.concat(s["open"], u)).otherwise(u).alias("open"),
        )

    return F.aggregate(units, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
