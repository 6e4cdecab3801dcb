"""Two large sides that meet whole: packs of what is asked, each in one task, by which the blobs of the corpus come one after the other.

All of a row's partners pass through its task, so only its best leave it: k rows of each question, not k of each task. The corpus is shuffled once for each pack,
as compressed Arrow streams; a task holds its pack and a few blobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def number(spark: SparkSession, size: int, most: int) -> int:
    """Packs of at most about `most`, one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-size // most))


def released() -> None:
    """Gives what this Python process has freed back to the system. Spark keeps the workers of earlier stages, and all that they hold counts in the executor's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def closed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def opened(blob: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks()


def whole(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).combine_chunks()


def blobs(corpus: DataFrame, table_of: Callable[[pa.RecordBatch], pa.Table], rows: int) -> DataFrame:
    """blob: table_of() each so many rows, where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = pa.Table.from_batches([b.slice(i, rows)]).take(pa.array(range(min(rows, b.num_rows - i)))).combine_chunks()  # offsets from 0
                yield pa.RecordBatch.from_pydict({"blob": pa.array([closed(table_of(part.to_batches()[0]))], pa.binary())})
        b = part = None
        released()

    return corpus.mapInArrow(run, "blob binary")


def packed(rows: DataFrame, key: str, packs: int) -> DataFrame:
    """pack, blob: rows of a key are in one pack, in any number of its blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b])
            pack = table.column("pack").to_numpy()
            for p in set(pack.tolist()):
                part = table.drop_columns(["pack"]).filter(pa.array(pack == p))
                yield pa.RecordBatch.from_pydict({"pack": pa.array([p], pa.int32()), "blob": pa.array([closed(part)], pa.binary())})
        b = table = part = None
        released()

    return rows.withColumn("pack", F.pmod(F.xxhash64(key), F.lit(packs)).cast("int")).mapInArrow(run, "pack int, blob binary")


def meet(asked: DataFrame, corpus: DataFrame, packs: int, beside: Callable[[Iterator[tuple[bool, pa.Table]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What beside() makes of each pack: it gets (whether asked, table) of all that is asked, then of the whole corpus."""
    a = asked.select("pack", F.lit(0).alias("side"), "blob")
    c = corpus.select(F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"), F.lit(1).alias("side"), "blob")
    rows = a.unionByName(c).repartitionById(packs, F.col("pack")).sortWithinPartitions("pack", "side").select("side", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from beside((s == 0, opened(x)) for b in batches for s, x in zip(b.column(0).to_pylist(), b.column(1)))
        released()

    return rows.mapInArrow(run, schema)
