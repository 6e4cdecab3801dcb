"""Problem 4: the same or nearly the same records across splits.

1. Text: the question (after the last question mark line of the user message) and the answer (assistant message), folded: NFKC,
   lower case, only letters and digits.
2. Winnowing: rolling hashes of GRAM folded characters; of each window of WINDOW hashes the least is selected. Question and answer
   are winnowed apart. Whatever the order of their sentences, two texts that share WINDOW + GRAM - 1 characters share a selected hash.
3. Join: as a case needs equal figures, the seeds of two records meet only if the figures of their questions are the same, as they stand or
   without numbering. Each record's seeds are ordered by how many records of the same figures have them, and only its RARE rarest share
   meets across splits (never within one). Two records that share more than 1 - RARE of their seeds share one of these (prefix
   filtering), and stock phrases hardly ever meet. A seed that over HOT train records have is spread over salts, one for each HOT
   of them, and meets as any other.
   Records whose folded texts are equal share a class: only one record of each class and split side takes part, and
   classes are expanded at the end.
4. Chain and extend: all seeds of a candidate pair, with their places, are put into collinear chains (which may stand in any order). Only pairs whose chains
   cover CHAINED of both records go on; these are aligned sentence by sentence, each extended by the longest common subsequence. Coverage is the aligned share of
   each record. (A case covers MIN_COVER of both; at CHAINED = 0.3 no case of the tables at hand is lost, at 0.4 one of 1,501.)
5. A pair is a case if question and answer are covered and the figures agree: the figures of aligned sentences are equal,
   and of sentences without partner there are few.

Defined cases: null messages, missing roles and empty contents take no part; split names count whatever their case and
outer blanks; unknown splits take no part; repeated rows count once; a sample_id in two splits is no pair with itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW, HOT, RARE, MIN_SHARED, MIN_COVER = 6, 5, 100, 0.6, 2, 0.7
SHIFT, CHAINED = 12, 0.3  # characters by which a chain may shift from seed to seed, least share of both records under chains
QUESTION_MARK = "【问题】"
# Common traditional characters and their simplified forms.
TRADITIONAL = "電時應為變與壓驗間發關對試現線檢備錄斷記裝測溫護氣結說過樣纜濕還來務個們這國學會點動機開據種類進運規專業東車門頭長書話語請誰讀寫義員號單際難題項頻額風飛馬體處從側傳條構極樓標權決況則別剛創區協單參圖圓場塊塵報擊損換擇擴擔據數"
SIMPLIFIED = "电时应为变与压验间发关对试现线检备录断记装测温护气结说过样缆湿还来务个们这国学会点动机开据种类进运规专业东车门头长书话语请谁读写义员号单际难题项频额风飞马体处从侧传条构极楼标权决况则别刚创区协单参图圆场块尘报击损换择扩担据数"
_SIMPLER = str.maketrans(TRADITIONAL, SIMPLIFIED)


_ANY_TRADITIONAL, _NO_LETTERS, _LETTER = re.compile(f"[{TRADITIONAL}]"), re.compile(r"[\W_]+"), re.compile(r"[^\W_]")


def folded(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).lower()
    return _NO_LETTERS.sub("", text.translate(_SIMPLER) if _ANY_TRADITIONAL.search(text) else text)


def _selected(text: str, gram: int, window: int):
    """(hashes, places) of the minima of all windows; the last of equal minima is taken."""
    import numpy as np

    a = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = min(gram, len(a))
    h = np.zeros(len(a) - g + 1, np.uint64)
    for k in range(g):
        h = h * np.uint64(0x100000001B3) + a[k : k + len(h)] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    n = len(h)
    v = np.lib.stride_tricks.sliding_window_view(h[::-1], min(window, n))
    at = np.unique(n - 1 - (np.arange(len(v)) + v.argmin(1)))
    return h[at].astype(np.int64), at


def minima(text: str, gram: int = GRAM, window: int = WINDOW) -> list[int]:
    """Selected hashes in the order of their places; the last of equal minima is taken."""
    return _selected(text, gram, window)[0].tolist()


def selected_of(texts: list[str], gram: int = GRAM, window: int = WINDOW):
    """(hashes, text numbers) of the minima of all texts, as _selected() gives them one by one; texts too short for a whole window go that way."""
    import numpy as np

    long = [i for i, t in enumerate(texts) if len(t) >= gram + window - 1]
    short = [(i, _selected(t, gram, window)[0]) for i, t in enumerate(texts) if len(t) < gram + window - 1]
    a = np.frombuffer("".join(texts[i] for i in long).encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashes, of = [h for _, h in short], [np.full(len(h), i) for i, h in short]
    if len(a):
        h = np.zeros(len(a) - gram + 1, np.uint64)
        for k in range(gram):
            h = h * np.uint64(0x100000001B3) + a[k : k + len(h)] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        number = np.repeat(np.array(long), [len(texts[i]) for i in long])
        n = len(h) - window + 1  # windows; those that reach into the next text don't count
        best, at = h[:n].copy(), np.arange(n)
        for k in range(1, window):
            better = h[k : k + n] <= best
            best[better] = h[k : k + n][better]
            at[better] = np.flatnonzero(better) + k
        whole = number[:n] == number[window + gram - 2 : window + gram - 2 + n]
        chosen = np.zeros(n + window, bool)
        chosen[at[whole]] = True
        at = np.flatnonzero(chosen)
        hashes.append(h[at].astype(np.int64))
        of.append(number[at])
    return (np.concatenate(hashes), np.concatenate(of)) if hashes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def seeds(question: str, answer: str):
    """Seeds of both texts, each once."""
    return seeds_of([(question, answer)])[0]


def seeds_of(records_: list[tuple[str, str]]) -> list:
    """Seeds of each record's question and answer, each once."""
    import numpy as np

    parts = [selected_of([r[k] for r in records_]) for k in (0, 1)]
    h, of = np.concatenate([parts[0][0] ^ np.int64(17), parts[1][0]]), np.concatenate([parts[0][1], parts[1][1]])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
    h, of = h[first], of[first]
    return np.split(h, np.searchsorted(of, np.arange(1, len(records_)))) if records_ else []


class Fingerprint:
    """What the chains of a text need: its folded length and the places of its seeds."""

    def __init__(self, text: str):
        f = folded(text)
        hashes, places = _selected(f, GRAM, WINDOW)
        self.length, self.seeds = len(f), list(zip(hashes.tolist(), places.tolist()))
        self.at: dict[int, list[int]] = {}
        for h, p in self.seeds:
            self.at.setdefault(h, []).append(p)


def chained(a: Fingerprint, b: Fingerprint) -> int:
    """Characters of a under collinear chains of seeds shared with b.

    Seeds are taken in a's order. A seed goes on with the chain whose last seed stands nearest before it in b, at about the same distance as in a (insertions and slips shift it
    by at most SHIFT); otherwise it opens a chain. Chains may stand in any order in b. A chain of two seeds or more covers all from its first to its last seed."""
    open_: list[list[int]] = []  # first and last place in a, last place in b, seeds
    covered = 0
    for h, pa in a.seeds:
        for pb in b.at.get(h, ()):
            best = None
            for c in reversed(open_[-8:]):
                da, db = pa - c[1], pb - c[2]
                if 0 <= da and 0 <= db and abs(da - db) <= SHIFT and (best is None or abs(da - db) < abs(pa - best[1] - pb + best[2])):
                    best = c
            if best is None:
                open_.append([pa, pa, pb, 1])
            else:
                best[1], best[2], best[3] = pa, pb, best[3] + 1
    end = 0
    for first, last, _, n in sorted(open_):
        stop = min(last + GRAM, a.length)
        if stop > end:
            covered += stop - max(first, end)
            end = stop
    return covered


def records(samples: DataFrame) -> DataFrame:
    """sample_id, side (train/other), split, question, answer, titles of the samples with both texts; one row each."""
    split = F.lower(F.regexp_replace("metadata.dataset_split", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    last = lambda role: F.try_element_at(F.filter("messages", lambda m: F.lower(F.trim(m["role"])) == role), F.lit(-1))["content"]
    rows = samples.filter(F.size("messages") > 0).select(
        F.col("metadata.sample_id").alias("sample_id"), split.alias("split"), last("user").alias("user"), last("assistant").alias("answer"), F.col("metadata.document_titles").alias("titles")
    )
    rows = rows.filter(F.col("sample_id").isNotNull() & F.col("split").isin("train", "validation", "test") & F.col("user").isNotNull() & F.col("answer").isNotNull())
    question = F.element_at(F.split("user", QUESTION_MARK), -1)
    return rows.select("sample_id", "split", F.when(F.col("split") == "train", "train").otherwise("other").alias("side"), question.alias("question"), "answer", "titles").dropDuplicates(["sample_id", "split"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sample_id, split, train, question, answer) of the records with letters in both texts, with their class, the keys of their figures and their seeds.

    The class is a 128-bit digest of the folded texts; figures written apart or together fold alike, so it also holds the plain text without white space."""
    import hashlib

    import numpy as np

    for b in batches:
        texts = [(folded(q), folded(t), re.sub(r"\s+", "", q + "\n" + t), q) for q, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
        keep = [i for i, x in enumerate(texts) if x[0] and x[1]]
        texts = [texts[i] for i in keep]
        classes = [hashlib.md5("\0".join(x[:3]).encode()).digest() for x in texts]
        found = seeds_of([x[:2] for x in texts])
        offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32))
        flat = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
        marks = pa.array([[_key(x) for x in figure_keys(t[3])] for t in texts], pa.list_(pa.int64()))
        rest = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(classes, pa.binary()), pa.array([int.from_bytes(c[:8], "little", signed=True) for c in classes], pa.int64()), marks, flat], names=[*rest.schema.names, "cls", "c", "figures", "seeds"])


def _key(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def sentences(text: str) -> list[str]:
    """Sentences in NFKC form without bullets and numbering."""
    mark = r"^\s*(?:[-*+•>#]+|\(?\d{1,2}[.、)])\s*(?=\D)"
    text = re.sub("(?m)" + mark, "", unicodedata.normalize("NFKC", text))  # before the split, which would part a number from its line at the full stop
    out = [re.sub(mark, "", s).strip() for s in re.split(r"[。！!?？;；\n\r]+|\.(?=\s|$|[一-鿿])", text)]
    return [s for s in out if _LETTER.search(s)]


_FIGURE = re.compile(r"\d+(?:[.,]\d+)*")


def figures(text: str) -> list[str]:
    return sorted(_FIGURE.findall(unicodedata.normalize("NFKC", text)))


def figure_keys(question: str) -> list[str]:
    """The figures of the question without numbering, as aligned() compares them, and as they stand, as same_record() does of the whole; one if they are the same."""
    return sorted({" ".join(figures(" ".join(sentences(question)))), " ".join(figures(question))})


def likeness(a: str, b: str) -> float:
    """Twice the longest common subsequence by the sum of the lengths."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    v = mask = (1 << len(a)) - 1
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & mask
    return 2 * (len(a) - v.bit_count()) / max(1, len(a) + len(b))


@lru_cache(maxsize=4096)
def parted(text: str):
    """(sentences, folded, figures, counts of letters) of a text; a task meets a text in many pairs."""
    s = sentences(text)
    f = [folded(x) for x in s]
    return s, f, [figures(x) for x in s], [Counter(t) for t in f]


def _most(a: str, b: str, gap: int) -> float:
    """A bound of likeness(a, b): gap letters of a at least have no partner in b, and no more letters pair than the shorter text has."""
    return 2 * min(len(a) - gap, len(b)) / (len(a) + len(b))


def _gap(a: str, letters: dict[str, int]) -> int:
    """Letters of a, each as often as it stands there, that a text with these counts lacks."""
    n: dict[str, int] = {}
    for x in a:
        n[x] = n.get(x, 0) + 1
    return sum(max(0, k - letters.get(x, 0)) for x, k in n.items())


def aligned(a: str, b: str) -> tuple[float, bool]:
    """(share of the longer text that is aligned, whether figures agree), sentence by sentence in any order."""
    (sa, fa, na, _), (sb, fb, nb, grams) = parted(a), parted(b)
    total_a, total_b = sum(map(len, fa)), sum(map(len, fb))
    if not total_a or not total_b:
        return 0.0, False
    free, cover_a, cover_b, agree, left_a = set(range(len(fb))), 0, 0, True, []
    for i in sorted(range(len(fa)), key=lambda i: -len(fa[i])):
        best, score = None, 0.55
        for bound, j in sorted(((_most(fa[i], fb[j], _gap(fa[i], grams[j])), j) for j in free), key=lambda x: (-x[0], x[1])):
            if bound + 0.02 <= score:
                break  # no sentence after this one can come up to it
            x = 1.0 if fa[i] == fb[j] else likeness(fa[i], fb[j])
            x += 0.02 * (na[i] == nb[j])
            if x > score:
                best, score = j, x
        if best is None:
            left_a.append(i)
            continue
        free.discard(best)
        cover_a += len(fa[i])
        cover_b += len(fb[best])
        agree &= na[i] == nb[best]
    if not agree:  # sentences joined or parted: then the figures of the whole must be equal
        agree = figures(" ".join(sa)) == figures(" ".join(sb))
    if agree and left_a and free:  # sentences left on both sides may be the same ones, parted elsewhere
        xa, xb = "".join(fa[i] for i in left_a), "".join(fb[j] for j in sorted(free))
        if likeness(xa, xb) > 0.8:
            cover_a, cover_b = total_a, total_b
            agree = figures(" ".join(sa[i] for i in left_a)) == figures(" ".join(sb[j] for j in sorted(free)))
    return min(cover_a / total_a, cover_b / total_b), agree


def same_record(qa: str, aa: str, qb: str, ab: str, least: float = MIN_COVER) -> tuple[float, float, bool]:
    """(coverage of the question, of the answer, whether the pair is a case)."""
    cq, figures_q = aligned(qa, qb)
    if cq < least:
        fa, fb = folded(qa), folded(qb)
        cq = likeness(fa, fb)
        figures_q = figures(qa) == figures(qb)
    if cq < least or not figures_q:
        return cq, 0.0, False
    ca, figures_a = aligned(aa, ab)
    if ca < least:
        x = likeness(folded(aa), folded(ab))
        if x >= 0.85:
            ca, figures_a = x, figures(aa) == figures(ab)
    return cq, ca, ca >= least and figures_a


@lru_cache(maxsize=4096)
def _fingerprint(text: str) -> Fingerprint:
    return Fingerprint(text)


def is_chained(qa: str, aa: str, qb: str, ab: str, least: float = CHAINED) -> bool:
    """Whether chains of shared seeds cover that share of both records (question and answer)."""
    pairs = [(_fingerprint(qa), _fingerprint(qb)), (_fingerprint(aa), _fingerprint(ab))]
    if sum(chained(x, y) for x, y in pairs) < least * sum(x.length for x, _ in pairs):
        return False
    return sum(chained(y, x) for x, y in pairs) >= least * sum(y.length for _, y in pairs)


def _extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        near = [is_chained(*x) for x in zip(pdf.q_a, pdf.a_a, pdf.q_b, pdf.a_b)]
        pdf = pdf[near]
        found = [same_record(*x) for x in zip(pdf.q_a, pdf.a_a, pdf.q_b, pdf.a_b)]
        pdf = pdf.assign(cover_q=[x[0] for x in found], cover_a=[x[1] for x in found])
        yield pdf.loc[[x[2] for x in found], ["cls_a", "cls_b", "cover_q", "cover_a"]]


def class_overlaps(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, members): cls_a (train), cls_b (other), cover_q, cover_a; and cls, train, sample_id, split. A class is one text; its copies aren't expanded."""
    from voltlake.session import cut

    rows = records(samples).select("sample_id", "split", (F.col("side") == "train").alias("train"), "question", "answer")
    text = rows.mapInArrow(_fold, "sample_id string, split string, train boolean, question string, answer string, cls binary, c bigint, figures array<bigint>, seeds array<bigint>")
    text = cut(text)  # one row a record, read for the members, the seeds and the texts
    members = text.select("cls", "train", "sample_id", "split")
    classes = text.groupBy("cls", "train").agg(F.min(F.struct("sample_id", "question", "answer")).alias("r"), *[F.first(c).alias(c) for c in ("c", "figures", "seeds")])
    classes = cut(classes.select("cls", "c", "train", "r.question", "r.answer", "figures", "seeds"))
    # the many rows of seeds are three numbers: c stands for the class (equal ones of two classes give a candidate more, no case less), key for figures and seed, and m
    # for the number of seeds, the place of the figures and the side
    sown = classes.select("c", F.posexplode("figures").alias("place", "figures"), "seeds", (F.size("seeds") * 4 + F.col("train").cast("int")).alias("m"))
    sown = sown.select("c", (F.col("m") + 2 * F.col("place")).alias("m"), "figures", F.explode("seeds").alias("seed")).select("c", "m", F.xxhash64("figures", "seed").alias("key"))
    counts = sown.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") % 2 == 1).alias("trains")).filter("n > 1")
    # estimates of sizes don't see that each record becomes many seeds, so they would send all of them to the driver and to every executor (broadcast)
    met = sown.join(counts.hint("merge"), "key")
    # seeds of one record only are its rarest and meet nothing, so the others are ranked from the most frequent down
    size, down = F.floor(F.col("m") / 4), F.row_number().over(Window.partitionBy("c", "m").orderBy(F.desc("n"), F.desc("key")))
    rare = met.withColumn("rank", size - down + 1).filter((F.col("rank") <= F.ceil(size * RARE) + 1) & (F.col("trains") > 0) & (F.col("n") > F.col("trains")))
    rare = rare.select("c", (F.col("m") % 2 == 1).alias("train"), "key", F.greatest(F.lit(1), F.ceil(F.col("trains") / HOT)).cast("int").alias("salts"))
    # of a hot seed each train record stands under one salt, each other record under all: every pair meets once
    a = rare.filter("train").select(F.col("c").alias("c_a"), "key", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"))
    b = rare.filter("not train").select(F.col("c").alias("c_b"), "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = a.join(b, ["key", "salt"]).filter("c_a != c_b").groupBy("c_a", "c_b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= MIN_SHARED).select("c_a", "c_b")

    def side(train: bool, x: str) -> DataFrame:
        return classes.filter(F.col("train") == train).select(F.col("c").alias(f"c_{x}"), F.col("cls").alias(f"cls_{x}"), F.col("question").alias(f"q_{x}"), F.col("answer").alias(f"a_{x}"))

    near = pairs.join(side(True, "a"), "c_a").join(side(False, "b"), "c_b").mapInPandas(_extend, "cls_a binary, cls_b binary, cover_q double, cover_a double")
    same = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(1.0).alias("cover_q"), F.lit(1.0).alias("cover_a"))
    return near.unionByName(same), members


def overlaps(samples: DataFrame) -> DataFrame:
    """id_a < id_b, split_a, split_b, cover_q, cover_a of the pairs across train and validation or test: class_overlaps() with the copies expanded."""
    found, members = class_overlaps(samples)

    def ids(train: bool, x: str) -> DataFrame:
        return members.filter(F.col("train") == train).select(F.col("cls").alias(f"cls_{x}"), F.col("sample_id").alias(f"id_{x}"), F.col("split").alias(f"split_{x}"))

    out = found.join(ids(True, "a"), "cls_a").join(ids(False, "b"), "cls_b").filter("id_a != id_b")
    swap = F.col("id_a") > F.col("id_b")
    return out.select(
        F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.when(swap, F.col("split_b")).otherwise(F.col("split_a")).alias("split_a"),
        F.when(swap, F.col("split_a")).otherwise(F.col("split_b")).alias("split_b"), "cover_q", "cover_a",
    )


def report(samples: DataFrame) -> DataFrame:
    """split, title, records, overlapping, mean_cover: how many records of each split and source have a partner in another split. Copies are not expanded: a class
    that meets another counts for all its members."""
    found, members = class_overlaps(samples)
    best = found.select(F.explode(F.array(F.struct(F.col("cls_a").alias("cls"), F.lit(True).alias("train")), F.struct(F.col("cls_b").alias("cls"), F.lit(False).alias("train")))).alias("c"), "cover_a")
    best = best.groupBy("c.cls", "c.train").agg(F.max("cover_a").alias("cover"))
    hit = members.join(best, ["cls", "train"]).select("sample_id", "cover").groupBy("sample_id").agg(F.max("cover").alias("cover"))
    rows = records(samples).select("sample_id", "split", F.explode(F.array_distinct(F.filter(F.coalesce("titles", F.array()), lambda t: t.isNotNull()))).alias("title"))
    return rows.join(hit, "sample_id", "left").groupBy("split", "title").agg(
        F.count(F.lit(1)).alias("records"), F.count("cover").alias("overlapping"), F.avg("cover").alias("mean_cover")
    )
