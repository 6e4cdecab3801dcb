"""Exact BM25: requests and documents meet in blocks, and only the best hits of a block leave it.

search() makes two passes over the documents. The first counts document frequencies and lengths (aggregated before the shuffle). In the second each
Arrow batch of documents becomes a small inverted index, and each request is scored against it term by term; a request's running k-th
best score prunes later batches: terms that cannot lift a document to it are only looked up for documents that the other terms bring near it (max-score),
which changes no result. Documents are never shuffled and no (request, document) row is made for a token.

The requests are sent to the executors if they have at most SENT terms (counted first); beyond, each pack of requests goes to one task, and the documents come by
it as compact postings (packs.py). There a request's best hits are final, so no task passes on k hits of every request.

Defined cases: null and empty fields have no tokens; a request without tokens has no hits; documents without key take no part; a key that stands in
several rows counts as several documents; ties go by key; empty tables give no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.text import tokens
from voltlake.operators import packs as P

K1, B = 1.2, 0.75
SENT, PACK, GATHERED, DOCS = 2_000_000, 2_000_000, 4_000_000, 2000  # terms sent at once, terms of a pack, postings of an index beside a pack, documents of a blob


@dataclass(frozen=True)
class Channel:
    """Fields with their boosts (the best counts), the least share of the request's tokens in one field, and the boost of the request's keywords."""

    boosts: dict[str, float]
    share: float = 0.0
    keywords: float = 0.0


@dataclass
class Terms:
    """Requests as flat arrays: terms of request i are from[i] to from[i + 1]."""

    ids: list
    groups: list
    asked: object
    start: object
    term: object
    field: object
    idf: object
    plain: object
    key: object
    vocabulary: list = field(default_factory=list)


def statistics(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, tok, df, total: document frequency of each token; the empty token has the documents with tokens and the sum of their lengths."""
    return _counted(docs.select(*[tokens(F.col(f)).alias(f) for f in fields]), fields)


def _counted(tokenised: DataFrame, fields: list[str]) -> DataFrame:
    def entry(f: str, tok: Column, n: Column) -> Column:
        return F.struct(F.lit(f).alias("field"), tok.alias("tok"), n.cast("bigint").alias("n"))

    def entries(f: str) -> Column:
        return F.concat(F.array(entry(f, F.lit(""), F.size(f))), F.transform(F.array_distinct(f), lambda t: entry(f, t, F.lit(1))))

    rows = F.concat(*[entries(f) for f in fields])
    flat = tokenised.select(F.explode(rows).alias("r")).select("r.*")
    return flat.groupBy("field", "tok").agg(F.count_if(F.col("n") > 0).alias("df"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))


def asked_tokens(requests: DataFrame) -> DataFrame:
    """request_id, tok, plain, key: distinct tokens of the text (plain = 1) and of the keywords (key = 1)."""
    def side(c: str, plain: float, key: float) -> Column:
        return F.transform(F.array_distinct(tokens(F.col(c))), lambda t: F.struct(t.alias("tok"), F.lit(plain).alias("plain"), F.lit(key).alias("key")))

    parts = [side("text", 1.0, 0.0)] + ([side("keywords", 0.0, 1.0)] if "keywords" in requests.columns else [])
    flat = requests.select("request_id", F.explode(F.concat(*parts)).alias("r")).select("request_id", "r.*")
    return flat.groupBy("request_id", "tok").agg(F.max("plain").alias("plain"), F.max("key").alias("key"))


def weighted_terms(asked: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """request_id, field, tok, plain, key, idf of the asked tokens that some document has."""
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(stats.filter("tok <> ''").select("field", "tok", idf.alias("idf")), "tok")


def _terms(table: pa.Table, fields: list[str]) -> Terms:
    """A table (request_id, grp, asked, tok, field, idf, plain, key) ordered by request as Terms."""
    import numpy as np

    ids = table.column("request_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    table, ids = table.take(pa.array(order)), ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
    toks = table.column("tok").combine_chunks().dictionary_encode()
    toks = toks.combine_chunks() if isinstance(toks, pa.ChunkedArray) else toks
    names = {f: i for i, f in enumerate(fields)}
    return Terms(
        ids=ids[first].tolist(), groups=table.column("grp").take(pa.array(first)).to_pylist(), asked=table.column("asked").to_numpy()[first], start=np.r_[first, len(ids)],
        term=toks.indices.to_numpy(zero_copy_only=False), field=np.array([names[f] for f in table.column("field").to_pylist()], np.int32), idf=table.column("idf").to_numpy(),
        plain=table.column("plain").to_numpy(), key=table.column("key").to_numpy(), vocabulary=toks.dictionary.to_pylist(),
    )


class _Best:
    """The k best (score, key) of each request and channel so far; carried: a value of each document that a channel has hit."""

    def __init__(self, k: int):
        self.k, self.rows, self.carried = k, {}, {}

    def least(self, slot) -> float:
        have = self.rows.get(slot)
        return float(have[0][-1]) if have and len(have[0]) >= self.k else 0.0

    def add(self, slot, scores, keys) -> None:
        import numpy as np

        if (have := self.rows.get(slot)) is not None:
            rows = sorted([*zip((-have[0]).tolist(), have[1]), *zip((-scores).tolist(), keys)])[: self.k]
            scores, keys = -np.array([x[0] for x in rows]), [x[1] for x in rows]
        self.rows[slot] = (scores, keys)

    def batches(self, carry: tuple[str, str] | None, slots: int = 1000) -> Iterator[pa.RecordBatch]:
        """request_id, channel, key, score, rank and what is carried."""
        import numpy as np

        rows = list(self.rows.items())
        for i in range(0, len(rows), slots):
            part = rows[i : i + slots]
            n = [len(x[1]) for _, x in part]
            keys = [y for _, x in part for y in x[1]]
            channels = np.repeat(np.array([c for (_, c), _ in part], object), n).tolist()
            columns = {
                "request_id": pa.array(np.repeat(np.array([r for (r, _), _ in part], np.int64), n)), "channel": pa.array(channels, pa.string()), "key": pa.array(keys, pa.string()),
                "score": pa.array(np.concatenate([x[0] for _, x in part])), "rank": pa.array(np.concatenate([np.arange(1, x + 1, dtype=np.int32) for x in n])),
            }
            if carry:
                columns["carried"] = pa.array([self.carried.get(x) if c == carry[1] else None for x, c in zip(keys, channels)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)


@dataclass
class Index:
    """Documents by group and key (ranges: where each group stands), and (documents, weights, starts, greatest weight, number of documents) of each field."""

    keys: object
    ranges: dict
    carried: object
    lists: list


def _placed(keys: list, groups: list, carried: list | None):
    """(keys, ranges, carried) in order, and the place of each document in it."""
    import numpy as np

    keys, groups = np.array(keys, object), np.array([repr(g) for g in groups], object)
    order = np.lexsort((keys.astype(str), groups.astype(str)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keys, groups = keys[order], groups[order]
    heads = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ranges = {groups[a]: (int(a), int(b)) for a, b in zip(heads, np.r_[heads[1:], len(groups)])}
    return keys, ranges, None if carried is None else np.array(carried, object)[order], place


def _lists(starts, doc, tf, size, average: float):
    """The postings of a field, ordered by token (starts: where each stands) and document; size: tokens of each document."""
    import numpy as np

    w = (K1 * (1 - B + B * size / max(average, 1e-9)))[doc]
    w += tf
    for i in range(0, len(w), 65_536):  # in parts, as a factor for all would take as much memory again
        w[i : i + 65_536] = np.multiply(tf[i : i + 65_536], K1 + 1, dtype=np.float64) / w[i : i + 65_536]
    top = np.zeros(len(starts) - 1)
    if len(w):
        some = starts[1:] > starts[:-1]
        top[some] = np.maximum.reduceat(w, starts[:-1][some])
    return doc, w, starts.tolist(), top.tolist(), len(size)


def _indexed(batch: pa.RecordBatch, t: Terms, fields: list[str], average: dict[str, float], carry: bool) -> Index:
    """The index of a batch (key, grp, tokens of each field[, carried])."""
    import numpy as np
    import pyarrow.compute as pc

    keys, ranges, carried, place = _placed(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2 + len(fields)).to_pylist() if carry else None)
    vocabulary, lists = pa.array(t.vocabulary, pa.string()), []
    for i, f in enumerate(fields):
        column = batch.column(2 + i)
        flat, lengths = column.flatten(), np.diff(column.offsets.to_numpy())
        code = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(place, lengths)
        known = code >= 0
        pair, tf = np.unique(code[known] * len(keys) + doc[known], return_counts=True)
        size = np.zeros(len(keys))
        size[place] = lengths
        starts = np.searchsorted(pair, np.arange(len(t.vocabulary) + 1) * len(keys))
        lists.append(_lists(starts, pair % max(1, len(keys)), tf, size, average.get(f, 1.0)))
    return Index(keys, ranges, carried, lists)


def _compact(batch: pa.RecordBatch, fields: list[str], carry: bool) -> pa.Table:
    """A batch (key, grp, tokens of each field[, carried]) as one row of lists: for each field the distinct tokens, how many documents have each, which and how often, and the lengths."""
    import numpy as np

    columns = {"keys": batch.column(0), "groups": batch.column(1)} | ({"carried": batch.column(2 + len(fields))} if carry else {})
    for i in range(len(fields)):
        column = batch.column(2 + i)
        lengths = np.diff(column.offsets.to_numpy())
        coded = column.flatten().dictionary_encode()
        doc = np.repeat(np.arange(batch.num_rows), lengths)
        pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * batch.num_rows + doc, return_counts=True)
        columns |= {
            f"tok{i}": coded.dictionary, f"n{i}": pa.array(np.bincount(pair // batch.num_rows, minlength=len(coded.dictionary)).astype(np.int32)),
            f"doc{i}": pa.array((pair % batch.num_rows).astype(np.uint16)), f"tf{i}": pa.array(tf.astype(np.uint8 if not len(tf) or tf.max() < 256 else np.uint32)), f"size{i}": pa.array(lengths.astype(np.int32)),
        }
    return pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for name, x in columns.items()})


def _gathered(blobs: list[pa.Table], t: Terms, fields: list[str], average: dict[str, float], carry: bool) -> Index:
    """The index of _compact() batches."""
    import numpy as np
    import pyarrow.compute as pc

    column = lambda x, name: x.column(name).chunk(0).flatten()
    every = lambda name: [y for x in blobs for y in column(x, name).to_pylist()]
    keys, ranges, carried, place = _placed(every("keys"), every("groups"), every("carried") if carry else None)
    first = np.r_[0, np.cumsum([len(column(x, "keys")) for x in blobs])]
    vocabulary, lists = pa.array(t.vocabulary, pa.string()), []
    for i, f in enumerate(fields):
        size = np.zeros(len(keys))
        known = [pc.index_in(column(x, f"tok{i}"), value_set=vocabulary) for x in blobs]
        n = [np.where(c.is_valid().to_numpy(zero_copy_only=False), column(x, f"n{i}").to_numpy(), 0) for c, x in zip(known, blobs)]
        # the largest arrays of a task are filled and ordered in place
        pair, end = np.empty(sum(int(x.sum()) for x in n), np.int64), 0
        tf = np.empty(len(pair), np.result_type(np.uint8, *[column(x, f"tf{i}").to_numpy().dtype for x in blobs]))
        for x, at, c, some in zip(blobs, first, known, n):
            lengths = column(x, f"size{i}").to_numpy()
            size[place[at : at + len(lengths)]] = lengths
            taken = np.repeat(some > 0, column(x, f"n{i}").to_numpy())
            here = slice(end, end := end + int(some.sum()))
            pair[here] = place[at + column(x, f"doc{i}").to_numpy()[taken].astype(np.int32)]
            pair[here] += np.repeat(pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64) * len(keys), some)
            tf[here] = column(x, f"tf{i}").to_numpy()[taken]
        order = np.argsort(pair)
        tf = tf[order]
        del order
        pair.sort()
        starts = np.searchsorted(pair, np.arange(len(t.vocabulary) + 1) * len(keys))
        pair %= max(1, len(keys))
        lists.append(_lists(starts, pair, tf, size, average.get(f, 1.0)))
    return Index(keys, ranges, carried, lists)


def _score(x: Index, t: Terms, fields: list[str], channels: dict[str, Channel], best: _Best, carry: tuple[str, str] | None = None) -> None:
    """Scores an index against the requests and keeps the best."""
    import numpy as np

    for r in range(len(t.ids)):
        a, b = x.ranges.get(repr(t.groups[r]), (0, 0))
        if a == b:
            continue
        here, terms = slice(t.start[r], t.start[r + 1]), [[] for _ in fields]
        for number, *term in zip(*(column[here].tolist() for column in (t.field, t.term, t.idf, t.plain, t.key))):
            terms[number].append(term)
        for name, c in channels.items():
            slot, ones, near = (t.ids[r], name), [], None
            least = best.least(slot)
            for f, boost in c.boosts.items():
                one = _field_scores(x.lists[fields.index(f)], terms[fields.index(f)], c, a, b, (least - 1e-5) / boost - 1e-5 if least > 0 else 0.0, t.asked[r])
                if one is not None:
                    ones.append((one, boost))
                    near = one * boost if near is None else np.maximum(near, one * boost)
            if near is None:
                continue
            # only what comes near enough to the k best is rounded; slack is more than roundings shift
            slack = 1e-5 * (1 + max(boost for _, boost in ones))
            hit = np.flatnonzero((near > 0) & (near >= least - slack))
            if len(hit) > best.k:
                hit = hit[near[hit] >= np.partition(near[hit], len(hit) - best.k)[len(hit) - best.k] - slack]
            total = np.zeros(len(near))
            for one, boost in ones:
                total[hit] = np.maximum(total[hit], np.round(np.round(one[hit], 6) * boost, 6))
            hit = hit[(total[hit] > 0) & (total[hit] >= least)]
            if len(hit):
                hit = hit[np.lexsort((hit, -total[hit]))[: best.k]]
                keys = x.keys[a + hit].tolist()
                best.add(slot, total[hit], keys)
                if carry and name == carry[1]:
                    best.carried.update(zip(keys, x.carried[a + hit].tolist()))


def _field_scores(lists, terms: list, c: Channel, a: int, b: int, least: float, asked: int):
    """Scores of the documents a to b in one field by its terms (term, idf, plain, key), zero where they are not above least or match too little; None without a match."""
    import numpy as np

    doc, w, starts, top, n = lists
    whole, found = b - a == n, []
    for term, idf, plain, key in terms:
        q = idf * (plain + c.keywords * key)
        s, e = starts[term], starts[term + 1]
        if e > s and not whole:
            s, e = s + np.searchsorted(doc[s:e], a), s + np.searchsorted(doc[s:e], b)
        if e > s and q > 0:
            found.append((q * top[term], q, s, e, plain))
    if not found:
        return None
    found.sort(key=lambda x: x[0])
    skip, bound = 0, 0.0
    if least > 0 and not c.share:
        while skip < len(found) and bound + found[skip][0] < least:
            bound += found[skip][0]
            skip += 1
        if skip == len(found):
            return None
    def added(terms: list):
        return np.bincount(np.concatenate([doc[s:e] for _, _, s, e, _ in terms]) - a, weights=np.concatenate([q * w[s:e] for _, q, s, e, _ in terms]), minlength=b - a)

    now = found[skip:]
    out = added(now)
    if skip:
        near = np.flatnonzero((out > 0) & (out + bound >= least))
        if 8 * len(near) * skip >= sum(e - s for _, _, s, e, _ in found[:skip]):  # looking up costs more than adding
            return out + added(found[:skip])
        # the other terms from the greatest down, each looked up for the documents that it and the lesser ones can still lift
        kept = out[near]
        for i in range(skip - 1, -1, -1):
            _, q, s, e, _ = found[i]
            x = np.searchsorted(doc[s:e], near + a)
            x[x == e - s] = 0
            same = doc[s:e][x] == near + a
            kept[same] += q * w[s:e][x[same]]
            still = kept + sum(x[0] for x in found[:i]) >= least
            near, kept = near[still], kept[still]
            if not len(near):
                return None
        out = np.zeros(b - a)
        out[near] = kept
        return out
    if c.share:
        plain = [doc[s:e] for _, _, s, e, p in now if p > 0]
        matched = np.bincount(np.concatenate(plain) - a, minlength=b - a) if plain else np.zeros(b - a)
        out[matched < max(np.floor(asked * c.share), 1)] = 0
    return out


def search(
    requests: DataFrame, docs: DataFrame, key: str, channels: dict[str, Channel], k: int, group: str | None = None, stats: DataFrame | None = None, sent: int = SENT, carry: tuple[str, str] | None = None
) -> DataFrame:
    """request_id, channel, key, score (rounded to 6), rank: the k best documents of each request in each channel.

    requests: request_id, text, and keywords (a text) if a channel boosts them. With group, a column of both sides, a request meets only documents of
    its group; document frequencies are those of all documents. stats: statistics() of these documents and fields (or more), if they are there already.
    carry: a text column of the documents and the channel whose hits bring it along (null for the others)."""
    fields = list(dict.fromkeys(f for c in channels.values() for f in c.boosts))
    more = [F.col(carry[0]).alias("carried")] if carry else []
    tokenised = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), (F.col(group).cast("string") if group else F.lit("")).alias("grp"), *[tokens(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)], *more)
    stats = (_counted(tokenised.toDF("key", "grp", *fields, *["carried"] * len(more)), fields) if stats is None else stats).filter(F.col("field").isin(fields))
    lengths = stats.filter("tok = ''").collect()  # one row a field
    n = max([r["rows"] for r in lengths], default=0)
    average = {r["field"]: r["total"] / r["df"] for r in lengths if r["df"]}
    asked = asked_tokens(requests)
    wanted = requests.select("request_id", (F.col(group).cast("string") if group else F.lit("")).alias("grp"), F.size(F.array_distinct(tokens(F.col("text")))).alias("asked")).filter("grp is not null")
    total = len(fields) * (wanted.agg(F.sum("asked")).first()[0] or 0)
    flat = weighted_terms(asked, stats, n).join(wanted, "request_id")
    schema = "request_id bigint, channel string, key string, score double, rank int" + ", carried string" * len(more)
    if total <= sent:
        terms = docs.sparkSession.sparkContext.broadcast(_terms(flat.toArrow(), fields))  # at most `sent` terms

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(k)
            for b in batches:
                if b.num_rows and terms.value.ids:
                    _score(_indexed(b, terms.value, fields, average, bool(carry)), terms.value, fields, channels, best, carry)
            yield from best.batches(carry)

        rank = F.row_number().over(Window.partitionBy("request_id", "channel").orderBy(F.desc("score"), "key"))
        found = tokenised.mapInArrow(scan, schema).withColumn("rank", rank).filter(F.col("rank") <= k)
    else:

        def beside(blobs: Iterator[tuple[bool, pa.Table]]) -> Iterator[pa.RecordBatch]:
            asked_, terms_, here, postings, best = [], None, [], 0, _Best(k)

            def done() -> None:
                if here:
                    _score(_gathered(here, terms_, fields, average, bool(carry)), terms_, fields, channels, best, carry)
                here.clear()
                P.released()

            for is_asked, x in blobs:
                if is_asked:
                    asked_.append(x)
                elif asked_:
                    if terms_ is None:
                        terms_ = _terms(P.whole(asked_), fields)
                        del asked_[1:]  # the rows aren't needed any more
                        P.released()
                    here.append(x)
                    postings += sum(len(x.column(f"doc{i}").chunk(0).values) for i in range(len(fields)))
                    if postings > GATHERED:
                        done()
                        postings = 0
            done()
            yield from best.batches(carry)

        packs = P.number(docs.sparkSession, total, PACK)
        rows = flat.select("request_id", "grp", "asked", "tok", "field", "idf", "plain", "key")
        found = P.meet(P.packed(rows, "request_id", packs), P.blobs(tokenised, lambda b: _compact(b, fields, bool(carry)), DOCS), packs, beside, schema)
    return found.withColumnRenamed("key", key).withColumnRenamed("carried", carry[0] if carry else "carried")


def pair_scores(pairs: DataFrame, requests: DataFrame, docs: DataFrame, key: str, boosts: dict[str, float]) -> DataFrame:
    """request_id, key, score of the given pairs (request_id, key) only: the best boosted field. Frequencies are those of all documents."""
    fields = list(boosts)
    rows = docs.filter(F.col(key).isNotNull()).select(key, *[tokens(F.col(f)).alias(f) for f in fields])
    stats = _counted(rows, fields)
    lengths = stats.filter("tok = ''").collect()  # one row a field
    n = max([r["rows"] for r in lengths], default=0)
    average = F.coalesce(*[F.when(F.col("field") == r["field"], F.lit(r["total"] / r["df"])) for r in lengths if r["df"]], F.lit(1.0))
    named = rows.join(pairs.select(key).distinct(), key, "left_semi")
    sides = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("toks")) for f in fields])
    posts = named.select(key, F.explode(sides).alias("s")).select(key, "s.field", F.size("s.toks").alias("dl"), F.explode("s.toks").alias("tok")).groupBy(key, "field", "tok").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    terms = weighted_terms(asked_tokens(requests.select("request_id", "text")), stats, n).select("request_id", "field", "tok", "idf")
    met = pairs.select("request_id", key).distinct().join(posts, key).join(terms, ["request_id", "field", "tok"])
    w = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    s = met.groupBy("request_id", key, "field").agg(F.round(F.sum(w), 6).alias("s"))
    boost = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(b))) for f, b in boosts.items()])
    return s.groupBy("request_id", key).agg(F.round(F.max(F.col("s") * boost), 6).alias("score"))


def top(hits: DataFrame, key: str, k: int, group: tuple[str, ...] = ("request_id",), ties: tuple[Column | str, ...] = ()) -> DataFrame:
    """The k best of each group with their rank; Spark limits each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), *ties, key))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)
