"""Vector columns as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def usable(v: Column, width: int) -> Column:
    """width finite values, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == width) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def hashed(texts: list[str], width: int = 64) -> list[list[float]]:
    """The stand-in embedding model: each token adds 1 or -1 at a place, both by its digest."""
    import hashlib
    import re

    from voltlake.functions.text import TOKEN

    pattern = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), TOKEN))
    known: dict[str, tuple[int, float]] = {}
    out = []
    for text in texts:
        v = [0.0] * width
        for tok in pattern.findall(text.lower()):
            at = known.get(tok)
            if at is None:
                h = hashlib.md5(tok.encode()).hexdigest()
                at = known[tok] = (int(h[:4], 16) % width, -1.0 if int(h[4], 16) % 2 else 1.0)
            v[at[0]] += at[1]
        out.append(v)
    return out


def embedded(text: Column, model: Callable[[list[str]], list[list[float]]] = hashed) -> Column:
    """array<double> of a text by the model (list of texts to list of vectors), in Arrow batches; null and empty texts give null."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        there = s.notna() & (s != "")
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        if there.any():
            out[there] = pd.Series(model(s[there].tolist()), index=s.index[there], dtype=object)
        return out

    return run(text)
