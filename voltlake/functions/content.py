"""Columns that say whether a text has content and whether a status means completed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stand-ins for a missing value, compared in lower case after mark-up is gone.
STAND_INS = ["null", "none", "nan", "nil", "n/a", "na", "undefined", "nul", "tbd", "todo", "nat", "无", "空", "暂无", "不适用", "无内容", "没有"]

_ENTITY = r"&(?:nbsp|amp|lt|gt|quot|apos|ensp|emsp|thinsp|zwnj|zwj|#\d+|#x[0-9a-fA-F]+);"
_TAG = r"<[/!]?[A-Za-z][^<>]*>|<!--.*?-->|<!\[CDATA\[|\]\]>"
_SIGNS = r"[\p{P}\p{S}\p{Z}\p{C}\s\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{034F}\x{FE00}-\x{FE0F}]+"


# Four Han letters or three words in a row, in a text without mark-up, are content at a glance.
_PLAIN = r"[\x{4E00}-\x{9FFF}]{4}|[A-Za-z]{2,}[ ,]+[A-Za-z]{2,}[ ,]+[A-Za-z]{2,}"


def has_content(text: Column) -> Column:
    """False for null, and for white space, invisible signs, mark-up, punctuation or a stand-in for a missing value."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)" + _TAG, " "), _ENTITY, " ")
    letters = F.regexp_replace(bare, _SIGNS, "")
    stand_in = F.lower(F.regexp_replace(bare, r"^[\p{P}\p{S}\p{Z}\p{C}\s]+|[\p{P}\p{S}\p{Z}\p{C}\s]+$", ""))
    at_a_glance = ~text.contains("<") & ~text.contains("&") & text.rlike(_PLAIN)
    return F.coalesce(F.when(at_a_glance, True).otherwise((letters != "") & ~stand_in.isin(*STAND_INS)), F.lit(False))


def is_completed(status: Column) -> Column:
    """Status COMPLETED, whatever its case and the white space around it."""
    return F.coalesce(F.upper(F.regexp_replace(status, r"^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$", "")) == "COMPLETED", F.lit(False))
