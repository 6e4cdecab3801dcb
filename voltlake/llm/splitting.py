"""Problem 5: oversized texts cut at natural boundaries, by content-defined chunking.

A rolling (Buzhash) value over the last WINDOW characters marks landmarks; a landmark snaps to the nearest natural boundary.
A piece ends at the first snapped landmark between min_size and max_size characters, else at the last natural boundary
before max_size, else (no boundary in reach) hard at max_size. As landmarks depend only on nearby characters, an edit
alters only the pieces next to it. A piece after a natural cut starts with the last sentence of the piece before if that
and the new text still fit into max_size. A sentence reaches back over boundaries until it holds a letter or digit, so the end sign and the line break
after it belong to it.

Natural boundaries lie after a line break, after any of the end signs, and after a full stop followed by white space.

Defined cases: null texts give no piece, an empty text none, a text within max_size one piece; repeated rows count once;
blank stretches belong to the piece they stand in; joined without their overlap the pieces give the text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SIZE, MIN_SIZE, WINDOW, MASK = 1500, 400, 24, 0xFF
BOUNDARY = r"\r\n|[\n\r。！？；!?;]|\.(?=\s)"
SCHEMA = "chunk_id string, piece_no int, start int, overlap int, text string, hard boolean, chapter_title string, section_title string"


def boundaries(text: str) -> list[int]:
    """Positions right after each natural boundary, ascending."""
    import re

    return [m.end() for m in re.finditer(BOUNDARY, text)]


def landmarks(text: str, window: int = WINDOW, mask: int = MASK):
    """Positions whose rolling hash of the window before them has zero low bits."""
    import numpy as np

    a = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(a) < window:
        return np.zeros(0, np.int64)
    mixed = a * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(len(a) - window + 1, np.uint64)
    for k in range(window):
        x = mixed[k : k + len(h)]
        r = np.uint64((window - 1 - k) % 63 + 1)
        h ^= (x << r) | (x >> (np.uint64(64) - r))
    h ^= h >> np.uint64(32)
    return np.flatnonzero((h & np.uint64(mask)) == 0) + window


def cut_points(text: str, max_size: int = MAX_SIZE, min_size: int = MIN_SIZE) -> list[tuple[int, bool]]:
    """(end, hard) of each piece."""
    import numpy as np

    n, b = len(text), np.array(boundaries(text), np.int64)
    out, start = [], 0
    snapped = np.zeros(0, np.int64)
    if n > max_size and len(b):
        marks = landmarks(text)
        i = np.searchsorted(b, marks)
        left, right = b[np.maximum(i - 1, 0)], b[np.minimum(i, len(b) - 1)]
        snapped = np.unique(np.where(np.abs(marks - left) <= np.abs(right - marks), left, right))
    while n - start > max_size:
        k = np.searchsorted(snapped, start + min_size)
        if k < len(snapped) and snapped[k] <= start + max_size:
            out.append((int(snapped[k]), False))
        else:
            k = int(np.searchsorted(b, start + max_size, side="right")) - 1
            if k >= 0 and b[k] > start:
                out.append((int(b[k]), False))
            else:
                out.append((start + max_size, True))
        start = out[-1][0]
    if n > start:
        out.append((n, False))
    return out


def pieces(text: str, max_size: int = MAX_SIZE, min_size: int = MIN_SIZE) -> list[tuple[int, int, str, bool]]:
    """(start, overlap, piece, ended hard); start is where the piece's new text begins, overlap the length repeated before it."""
    b, out, start, last_start = [0, *boundaries(text)], [], 0, 0
    from bisect import bisect_left

    for end, hard in cut_points(text, max_size, min_size):
        lap = 0
        if out and not out[-1][3]:
            i = bisect_left(b, start) - 1
            while i > 0 and b[i] > last_start and not any(map(str.isalnum, text[b[i] : start])):  # only marks and blanks so far: no sentence yet
                i -= 1
            s = b[i]
            if s >= last_start and start - s + end - start <= max_size:
                lap = start - s
        out.append((start, lap, text[start - lap : end], hard))
        last_start, start = start, end
    return out


def split_texts(chunks: DataFrame, max_size: int = MAX_SIZE, min_size: int = MIN_SIZE, once: bool = True) -> DataFrame:
    """The pieces of each text of over max_size characters, with its headings. Only those rows reach Python. Repeated rows are one only with once, which shuffles
    the long texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (i, k, s, lap, p, hard, c, sec)
                for i, t, c, sec in zip(pdf.chunk_id, pdf.text, pdf.chapter_title, pdf.section_title)
                for k, (s, lap, p, hard) in enumerate(pieces(t, max_size, min_size), 1)
            ]
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "start", "overlap", "text", "hard", "chapter_title", "section_title"])

    long = chunks.select("chunk_id", "text", "chapter_title", "section_title").filter(F.length("text") > max_size)
    return (long.distinct() if once else long).mapInPandas(run, SCHEMA)


def cut_kinds(pieces_df: DataFrame) -> DataFrame:
    """chunk_id, cut: hard if any piece had to be cut without a boundary, else natural."""
    return pieces_df.groupBy("chunk_id").agg(F.max("hard").alias("h")).select("chunk_id", F.when(F.col("h"), "hard").otherwise("natural").alias("cut"))
