"""Sinks: validated create, keyed upsert with an atomic swap, NDJSON export and import, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class SchemaMismatch(ValueError):
    pass


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def check_schema(df: DataFrame, existing: DataFrame, vectors: tuple[str, ...] = ()) -> None:
    """Same names and types, and one width for each vector column over both."""
    a, b = dict(df.dtypes), dict(existing.dtypes)
    if a != b:
        raise SchemaMismatch(f"{sorted(set(a.items()) ^ set(b.items()))}")
    for v in vectors:
        widths = df.select(F.size(v).alias("n")).unionByName(existing.select(F.size(v).alias("n"))).filter("n >= 0").distinct().limit(2).collect()
        if len(widths) > 1:
            raise SchemaMismatch(f"{v} has several widths")


def restore(spark: SparkSession, path: str) -> None:
    """Puts back what a swap that broke off has left: the old table if there is none in its place."""
    fs, p = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    if not fs.exists(p) and fs.exists(old) and not fs.rename(old, p):
        raise OSError(f"{path}.old can't be put back")


def _into_place(spark: SparkSession, new: str, path: str) -> None:
    """Renames new to path, the old one aside first; the old one is deleted only once the new one stands."""
    fs, p = _fs(spark, path)
    path_of, old = spark._jvm.org.apache.hadoop.fs.Path, f"{path}.old"
    if fs.exists(p):
        drop(spark, old)
        if not fs.rename(p, path_of(old)):
            raise OSError(f"{path} can't be moved aside")
    if not fs.rename(path_of(new), p):
        restore(spark, path)
        raise OSError(f"{new} can't be renamed")
    drop(spark, old)


def swap(df: DataFrame, path: str) -> None:
    """Writes beside the table, then renames. A swap that breaks off leaves the old table in place or beside it, from where the next call puts it back."""
    spark, new = df.sparkSession, f"{path}.new"
    restore(spark, path)
    drop(spark, new)
    df.write.parquet(new)
    _into_place(spark, new, path)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the greatest order value for each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


PARTS = 64


def _mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def _part(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(PARTS)).cast("int")


def upsert(df: DataFrame, path: str, key: str, vectors: tuple[str, ...] = (), recreate: bool = False) -> dict:
    """Rows of df replace those of the same key; keys must be there and differ. Returns {created, rows, vector_dims (the width of each vector column)}.

    The table is one folder for each of PARTS parts of the keys, each swapped whole, so an upsert rewrites only the parts that its rows fall into. All is checked before
    anything is written."""
    spark = df.sparkSession
    bad = df.groupBy(key).count().filter(f"count > 1 or {key} is null").limit(5).collect()
    if bad:
        raise ValueError(f"{key} missing or repeated: {[r[0] for r in bad]}")
    for v in vectors:
        widths = [r.n for r in df.select(F.size(v).alias("n")).filter("n >= 0").distinct().limit(2).collect()]
        if len(widths) > 1:
            raise SchemaMismatch(f"{v} has several widths")
    if recreate:
        drop(spark, path)
    created = not exists(spark, path)
    old = None if created else keyed(spark, path)
    if old is not None:
        check_schema(df, old, vectors)
    x = df.withColumn("part", _part(key))
    touched = [r[0] for r in x.select("part").distinct().collect()]  # at most PARTS
    have = [f"{path}/part={r}" for r in touched if exists(spark, f"{path}/part={r}")]
    if have:
        kept = spark.read.schema(df.schema).parquet(*have).join(df.select(key), key, "left_anti").select(*df.columns)
        x = x.unionByName(kept.withColumn("part", _part(key)))
    stage = f"{path}.stage"
    drop(spark, stage)
    x.repartition("part").write.partitionBy("part").parquet(stage)
    _mkdirs(spark, path)
    for r in touched:
        _into_place(spark, f"{stage}/part={r}", f"{path}/part={r}")
    drop(spark, stage)
    now = keyed(spark, path)
    dims = {v: now.select(F.max(F.size(v))).first()[0] for v in vectors}
    return {"created": created, "rows": now.count(), "vector_dims": dims}


def keyed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table written by upsert(); what a broken swap left is put back first."""
    fs, p = _fs(spark, path)
    for r in range(PARTS):
        restore(spark, f"{path}/part={r}")
    folders = [f"{path}/part={r}" for r in range(PARTS) if exists(spark, f"{path}/part={r}")]
    return spark.read.parquet(*folders)


def create_if_missing(spark: SparkSession, path: str, schema: str) -> bool:
    """An empty table of the schema, unless there is one; whether it was created."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def append(df: DataFrame, path: str) -> None:
    """Inserts rows into a table of the same schema (a chat, a plot, a summary, a session, a user)."""
    if exists(df.sparkSession, path):
        check_schema(df, df.sparkSession.read.parquet(path))
    df.write.mode("append").parquet(path)


def opened_chats(rows: DataFrame) -> DataFrame:
    """Chats as they are inserted when their task starts: GENERATING, without answer and error."""
    none = F.lit(None).cast("string")
    return rows.withColumns({"status": F.lit("GENERATING"), "answer": none, "error_message": none})


def update(spark: SparkSession, path: str, key: str, changes: DataFrame) -> int:
    """Sets the columns of changes in the rows of a keyed table (upsert()) that have their key, such as a session's or a user's new name; other rows and keys are left. Returns the rows changed."""
    old = keyed(spark, path)
    fields = [c for c in changes.columns if c != key]
    new = old.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields]), key)
    rows = new.select(*[F.col(f"_new_{c}").alias(c) if c in fields else F.col(c) for c in old.columns])
    n = rows.count()
    if n:
        from voltlake.session import cut

        upsert(cut(rows), path, key)  # cut, as the parts that are read are swapped
    return n


def delete(spark: SparkSession, path: str, key: str, keys: DataFrame) -> int:
    """Deletes the rows of a keyed table whose key stands in keys. Returns the rows deleted."""
    x = keys.select(key).distinct().withColumn("part", _part(key))
    n = 0
    for r in x.select("part").distinct().collect():  # at most PARTS
        folder = f"{path}/part={r[0]}"
        if exists(spark, folder):
            have = spark.read.parquet(folder)
            left = have.join(x.select(key), key, "left_anti").select(*have.columns)
            n += have.count() - left.count()
            swap(left, folder)
    return n


def check_nested(df: DataFrame, column: str, fields: dict[str, str]) -> None:
    """SchemaMismatch unless the column is an array of structs with these fields and types."""
    kind = df.schema[column].dataType
    inner = getattr(kind, "elementType", None)
    have = {f.name: f.dataType.simpleString() for f in getattr(inner, "fields", [])}
    wrong = {k: have.get(k) for k, v in fields.items() if have.get(k) != v}
    if kind.typeName() != "array" or wrong:
        raise SchemaMismatch(f"{column}: {wrong or kind.simpleString()}")


def evaluation_lines(df: DataFrame, path: str) -> None:
    """Evaluation records as JSON lines; the folder appears only once all are written."""
    spark, new = df.sparkSession, f"{path}.new"
    drop(spark, new)
    try:
        df.write.json(new)
    except Exception:
        drop(spark, new)
        raise
    drop(spark, path)
    fs, p = _fs(spark, path)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(new), p):
        raise OSError(f"{new} can't be renamed")


def memory_rows(df: DataFrame) -> DataFrame:
    """Memory rows as they are stored: doc_key is abstract:id for summaries, else the id; a row without answer has no answer_vector."""
    key = F.when(F.col("memory_type") == "abstract", F.concat(F.lit("abstract:"), F.col("id"))).otherwise(F.col("id"))
    out = df.withColumn("doc_key", key)
    if "answer_vector" in df.columns:
        out = out.withColumn("answer_vector", F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", F.col("answer_vector")))
    return out


def export_ndjson(df: DataFrame, path: str, key: str) -> None:
    """One JSON object a line: _id and _source."""
    df.select(F.col(key).cast("string").alias("_id"), F.struct(*df.columns).alias("_source")).write.mode("overwrite").json(path)


def import_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"_id string, _source struct<{schema}>").json(path).select("_source.*")


def verify(spark: SparkSession, paths: dict[str, str]) -> dict[str, int | str]:
    """Rows of each table, MISSING where there is none."""
    def rows(p: str) -> int:
        return (keyed(spark, p) if any(exists(spark, f"{p}/part={r}") for r in range(PARTS)) else spark.read.parquet(p)).count()

    return {n: rows(p) if exists(spark, p) else "MISSING" for n, p in paths.items()}


def upsert_batches(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """A stream of rows into a keyed table, batch by batch, latest row first."""

    def one(batch: DataFrame, _: int) -> None:
        upsert(latest(batch, key, order), path, key)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
