"""Transparent scores of answers: rewards, coverage of requirements, form, overall quality. Built-in expressions but for the ratio of matching blocks.

Null answers count as empty. Every function takes and gives columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from voltlake.functions.text import han_count, parts, similarity_form, stripped

# Phrases of the rules.
META_PHRASES = ["根据检索资料", "根据提供的资料", "根据上述资料", "从检索结果来看", "作为一个人工智能", "作为 AI"]
REFUSAL_PHRASES = ["无法确定", "无法判断", "资料不足", "信息不足", "无法从现有资料中确定", "无法从现有信息中确定"]
REFUSAL_SIGNALS = ["资料不足", "信息不足", "无法从现有资料", "现有资料无法", "资料中未", "未提供", "无法确定", "无法分析"]
# Requirement, words of the question that raise it, words of the answer that meet it.
REQUIREMENTS = {
    "principle": (["原理", "机理", "工作机制"], ["原理", "机理", "通过", "由于", "过程"]),
    "characteristics": (["特性", "特点", "主要性能"], ["特性", "特点", "具有", "表现为"]),
    "factors": (["影响因素", "考虑哪些因素", "关键因素"], ["因素", "影响", "取决于", "与", "有关"]),
    "risks": (["风险", "隐患", "可能故障"], ["风险", "隐患", "故障", "可能", "导致", "避免"]),
    "engineering_requirements": (["工程要求", "注意事项", "应强调", "重点检查", "运行维护"], ["应", "必须", "需要", "注意", "检查", "校核", "维护"]),
    "comparison": (["比较", "区别", "差异", "不同之处"], ["相比", "区别", "差异", "不同", "分别", "而"]),
    "logic": (["逻辑关系", "为什么", "原因", "因果关系"], ["因为", "由于", "因此", "从而", "关系", "决定", "基础"]),
    "standards": (["标准", "规程", "规范"], ["标准", "规程", "规范", "GB", "IEC", "IEEE"]),
}


def text_of(answer: Column) -> Column:
    return stripped(F.coalesce(answer, F.lit("")))


def hits(text: Column, phrases: list[str]) -> Column:
    out = F.lit(0)
    for p in phrases:
        out = out + text.contains(p).cast("int")
    return out


def any_of(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def basic_quality(answer: Column, least: int = 10, ideal: int = 1500, most: int = 2500) -> Column:
    n = F.length(text_of(answer))
    return F.when(n == 0, -1.0).when(n < least, -0.6).when(n > most, -0.5).when(n > ideal, 0.0).otherwise(0.3)


def meta_penalty(answer: Column) -> Column:
    return F.greatest(F.lit(-1.0), hits(text_of(answer), META_PHRASES) * F.lit(-0.25))


def repetition_penalty(answer: Column) -> Column:
    s = parts(text_of(answer), "[。！？!?\n]+")
    return F.when(F.size(s) < 2, 0.0).otherwise(F.greatest(F.lit(-1.0), (F.size(s) - F.size(F.array_distinct(s))) * F.lit(-0.25)))


def completion_reward(answer: Column) -> Column:
    t = text_of(answer)
    end = F.regexp_replace(t, r"""[ \t\r\n*_~`”’"》〉）)\]}]+$""", "")
    return F.when(t == "", -1.0).when(end.rlike("[。.！!？?]$"), 0.3).otherwise(-0.8)


def refusal_consistency(answer: Column, sufficient: Column) -> Column:
    t, refuses = text_of(answer), any_of(text_of(answer), REFUSAL_PHRASES)
    return F.when(t == "", -1.0).when(F.coalesce(sufficient, F.lit(False)), F.when(refuses, -1.0).otherwise(0.3)).otherwise(F.when(refuses, 1.0).otherwise(-1.0))


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks by the sum of the lengths."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def query_copy_penalty(query: Column, answer: Column) -> Column:
    """Tiers for answers that repeat the question."""
    q, a = similarity_form(F.coalesce(query, F.lit(""))), similarity_form(F.coalesce(answer, F.lit("")))
    n, m = F.length(q), F.length(a)
    sorted_signs = lambda t: F.array_sort(F.split(t, ""))
    near = m <= n * 1.8
    ratio = F.when(near, block_ratio(F.when(near, q).otherwise(""), F.when(near, a).otherwise(""))).otherwise(0.0)
    return (
        F.when((n == 0) | (m == 0), 0.0).when(q == a, -1.0).when((n == m) & (sorted_signs(q) == sorted_signs(a)), -0.8)
        .when((m <= n * 1.2) & (ratio >= 0.9), -0.8).when(near & (ratio >= 0.8), -0.4)
        .when(a.contains(q) & (m - n < 10), -0.8).when(a.contains(q) & (m - n < 20), -0.4).otherwise(0.0)
    )


def context_copy_penalty(context: Column, answer: Column) -> Column:
    """-1 for an equal text, -0.8 for one of like length and a block ratio of 0.95 or more."""
    c, a = similarity_form(F.coalesce(context, F.lit(""))), similarity_form(F.coalesce(answer, F.lit("")))
    n, m = F.length(c), F.length(a)
    near = (m >= n * 0.8) & (m <= n * 1.2)
    ratio = F.when(near, block_ratio(F.when(near, c).otherwise(""), F.when(near, a).otherwise(""))).otherwise(0.0)
    return F.when((n == 0) | (m == 0), 0.0).when(c == a, -1.0).when(near & (ratio >= 0.95), -0.8).otherwise(0.0)


def grounding(answer: Column, sufficient: Column, copied: Column, related: Column) -> Column:
    """copied: the least copy penalty of the contexts, related: their greatest relevance; both null without contexts."""
    use = F.coalesce(sufficient, F.lit(False)) & copied.isNotNull()
    return F.when(text_of(answer) == "", -1.0).when(~use, 0.0).when(copied < 0, copied).otherwise(related)


def requirement_counts(query: Column, answer: Column) -> tuple[Column, Column]:
    """(required, covered)"""
    q, a = F.coalesce(query, F.lit("")), F.lower(F.coalesce(answer, F.lit("")))
    required, covered = F.lit(0), F.lit(0)
    for asks, meets in REQUIREMENTS.values():
        asked = any_of(q, asks)
        required = required + asked.cast("int")
        covered = covered + (asked & any_of(a, [w.lower() for w in meets])).cast("int")
    return required, covered


def coverage(query: Column, answer: Column) -> Column:
    """Covered by required, null if nothing is required."""
    required, covered = requirement_counts(query, answer)
    return F.round(covered / F.nullif(required.cast("double"), F.lit(0.0)), 6)


def form_quality(answer: Column, required: Column) -> Column:
    a = F.coalesce(answer, F.lit(""))
    n, refuses = han_count(a), any_of(a, REFUSAL_SIGNALS)
    low, high = F.when(refuses, 40).otherwise(120 + 80 * required), F.when(refuses, 350).otherwise(600 + 150 * required)
    length = F.when(n < low, n / low).when(n > high, high / n).otherwise(1.0)
    bare = F.regexp_replace(stripped(a), r"(?:\*\*|__|`)+[ \t\r\n]*$", "")
    done = F.when(bare.rlike(r"""[。！？!?；;][”’"'）)\]】》]*$"""), 1.0).otherwise(0.6)
    return F.round(0.75 * length + 0.25 * done, 6)


def overall(relevance: Column, cover: Column, form: Column) -> Column:
    score = F.when(cover.isNull(), 0.65 * relevance + 0.35 * form).otherwise(0.35 * relevance + 0.45 * cover + 0.20 * form)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def level(score: Column) -> Column:
    return F.when(score >= 0.85, "excellent").when(score >= 0.70, "good").when(score >= 0.55, "needs_improvement").otherwise("poor")


# Shares of the eight rewards in training.
REWARD_SHARES = [0.10, 0.10, 0.10, 0.10, 0.20, 0.15, 0.10, 0.15]


def combined(rewards: list[Column]) -> Column:
    """Sum of the rules, kept within -2 and 2."""
    total = rewards[0]
    for r in rewards[1:]:
        total = total + r
    return F.round(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), total)), 6)


def weighted(rewards: list[Column], shares: list[float] = REWARD_SHARES) -> Column:
    total = F.lit(0.0)
    for r, w in zip(rewards, shares, strict=True):
        total = total + r * w
    return F.round(total, 6)


# The rules of memory need.
STRONG_PHRASES = ["之前提到的", "前面提到的", "上次说的", "刚才说的", "刚才的内容", "和刚才一样", "继续上一个", "接着说", "继续说", "继续讲", "再说一遍", "再讲一遍", "再详细说", "再详细讲", "再详细讲述", "详细展开", "进一步说明", "补充说明"]
REFERS = [
    "^(?:这个|那个|它|他|她)(?:怎么|是|有|能|可以|需要|为什么|是否|呢|吗|的|和|与|跟|相比|区别|不同)",
    "^(?:这个|那个|它|他|她).*(?:和|与|跟).*(?:区别|不同|差异|相比)",
    "^(?:再|继续|接着|进一步).*(?:说|讲|介绍|解释|说明|展开|分析)",
    "^那(?:能|可以|还能|也能|有没有|是否|怎么|为什么|在哪里|在哪|用什么|如何)",
]
OWN_ANTECEDENT = "[一-鿿A-Za-z0-9]{2,}[，,；;。.!！？?].*(?:这个|那个|它|他|她)"


def needs_memory(question: Column) -> Column:
    """A strong phrase or a referring start, unless the question holds the antecedent itself."""
    q = stripped(F.coalesce(question, F.lit("")))
    refers = any_of(q, STRONG_PHRASES)
    for p in REFERS:
        refers = refers | q.rlike(p)
    return refers & ~q.rlike(OWN_ANTECEDENT)
