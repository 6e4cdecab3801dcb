"""Problem 6: token ids by a public byte-level BPE vocabulary.

The method named is a fold of ranked merges, in Spark's higher-order functions, over the byte arrays of distinct words, with
the rank map as a literal. That was built and gave the right ids (README has its figures), but higher-order functions are
interpreted and the literals are copied for each use, so it took several times the CPU seconds and more driver memory than there
are. What stands here keeps the method's parts and changes where they run: each text is cut into words by the tokenizer's pattern,
each distinct word of a task is folded once by ranked merges over its bytes, with the rank map read from the vocabulary file,
and texts are put together from their words' ids, in Arrow batches. All new words of a batch are folded at once, over arrays (Merges): in each round every word
joins its pair of least rank, wherever it stands in the word, until no pair has a rank. fold() states the same merges plainly, for one word, and serves to
test it. Nothing is shuffled; the memory of a task is bounded by CACHE words and CHUNK characters at work.

decode() concatenates the pieces' bytes and reads them as UTF-8.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text; very long texts are read whole;
every row gives a row, so repeated rows and a null doc_id stay as they are; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("VOLTLAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, CHUNK, KEPT = 200_000, 200_000, 64  # words kept, characters of words folded at once, characters of a word that is kept


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The rank map: bytes of a token to its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def fold(word: bytes, r: dict[bytes, int]) -> list[int]:
    """Ranked merges of one word, plainly: the pair of least rank joins until none has a rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((r.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1))
        if rank == 1 << 31:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [r[p] for p in parts]


class Merges:
    """Ranked merges of many words at once. A table with open addressing holds, for each pair of tokens that makes a token, its rank."""

    NONE = (1 << 31) - 1

    def __init__(self, r: dict[bytes, int]):
        import numpy as np

        self.byte = np.array([r[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a << 32 | b, n) for t, n in r.items() for i in range(1, len(t)) if (a := r.get(t[:i])) is not None and (b := r.get(t[i:])) is not None]
        keys, ranks_ = np.array([k for k, _ in pairs], np.int64), np.array([n for _, n in pairs], np.int32)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # of the keys that want a free slot one gets it, the others go on to the next slot
            free = self.keys[slot] == -1
            taken, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[taken], self.ranks[taken] = keys[put], ranks_[put]
            stay = ~np.isin(left, put)
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key):
        import numpy as np

        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a, b):
        """Ranks of pairs of tokens, NONE where they make none."""
        import numpy as np

        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        have = self.keys[slot]
        out = np.where(have == key, self.ranks[slot], self.NONE).astype(np.int32)
        todo = np.flatnonzero((have != key) & (have != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot[todo]]
            hit = have == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (have != -1)]
        return out

    def fold(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of the words (none of them empty)."""
        import numpy as np

        if not words:
            return []
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        rank = np.full(len(tok), self.NONE, np.int32)  # of each token with the one after it
        at = np.flatnonzero(word[1:] == word[:-1])
        rank[at] = self.rank(tok[at], tok[at + 1])
        done_tok, done_word = [], []
        while len(tok):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            best = np.repeat(least, np.diff(np.r_[starts, len(tok)]))
            if (ready := (least == self.NONE).mean()) > 0.2 or ready == 1:  # words without a pair to join leave
                stay = best != self.NONE
                done_tok.append(tok[~stay])
                done_word.append(word[~stay])
                tok, word, rank, best = tok[stay], word[stay], rank[stay], best[stay]
                if not len(tok):
                    break
            at = np.flatnonzero((rank == best) & (best != self.NONE))
            if (at[1:] == at[:-1] + 1).any():  # where pairs overlap, every other one from the left joins
                head = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            tok[at] = best[at]
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            tok, word, rank = tok[keep], word[keep], rank[keep]
            fresh = np.zeros(len(tok), bool)
            fresh[at] = True
            fresh[at[at > 0] - 1] = True
            rank[fresh] = self.NONE
            new = np.flatnonzero(fresh[:-1])
            new = new[word[new] == word[new + 1]]
            rank[new] = self.rank(tok[new], tok[new + 1])
        tok, word = np.concatenate(done_tok), np.concatenate(done_word)
        tok = tok[np.argsort(word, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [tok[s:e] for s, e in zip([0, *ends], ends)]


class WordFolder:
    """Ids of texts; each distinct word is folded once while it is kept."""

    def __init__(self, path: str = VOCABULARY):
        import regex

        self._words, self._merges = regex.compile(PATTERN), Merges(ranks(path))
        self._known: dict[str, list[int]] = {}

    def ids(self, text: str | None) -> list[int]:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text. Texts are taken up to about CHUNK characters of new words at a time."""
        known, out = self._known, []
        parts: list[list[list[int]]] = []  # of each text the lists of its words' ids; those of new words are filled later
        new: dict[str, list[int]] = {}
        size = 0
        for t in texts:
            part = []
            for w in self._words.findall(t) if t else ():
                x = known.get(w)
                if x is None:
                    x = known[w] = new[w] = []
                    size += len(w)
                part.append(x)
            parts.append(part)
            if size > CHUNK:
                out += self._flush(parts, new)
                parts, new, size = [], {}, 0
        return out + self._flush(parts, new)

    def _flush(self, parts: list[list[list[int]]], new: dict[str, list[int]]) -> list[list[int]]:
        for x, ids in zip(new.values(), self._merges.fold([w.encode("utf-8", "surrogatepass") for w in new])):
            x += ids
        if len(self._known) > CACHE:
            self._known.clear()
        else:
            for w in [w for w in new if len(w) > KEPT]:
                del self._known[w]
        return [list(chain.from_iterable(part)) for part in parts]


def encoded(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = WordFolder(path)
        for b in batches:
            ids = folder.batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens of each row; the ids don't leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = WordFolder(path)
        for b in batches:
            n = [len(x) for x in folder.batch(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, tokens bigint")


def decode(ids: list[int], by_id: dict[int, bytes]) -> str:
    return b"".join(by_id[i] for i in ids).decode("utf-8", "replace")
