"""Sinks: the commit protocol stands for atomic appends and repaired tails."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def overwrite_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_release(records: DataFrame, path: str) -> None:
    """Four outputs: everything, tier A, fix pairs of A and B, detection rows of A to C. The plan runs once; the parts are read back from the whole."""
    records.write.mode("overwrite").parquet(f"{path}/full")
    whole = records.sparkSession.read.schema(records.schema).parquet(f"{path}/full")
    subsets = {"gold": F.col("tier") == "A", "fix_pairs": F.col("tier").isin("A", "B") & F.col("has_fix"), "detection": F.col("tier").isin("A", "B", "C")}
    for name, kept in subsets.items():
        whole.filter(kept).write.mode("overwrite").parquet(f"{path}/{name}")


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder per split; an unknown split counts as train."""
    known = F.when(F.col("split").isin("train", "val", "test"), F.col("split")).otherwise("train")
    rows.withColumn("split", known).write.mode("overwrite").partitionBy("split").json(path)


def write_manifest(counts: DataFrame, path: str) -> None:
    """A (dimension, key, n) table as one small JSON file: a few dozen rows."""
    counts.coalesce(1).write.mode("overwrite").json(path)


def write_counted(rows: DataFrame, path: str, **counters: Column) -> DataFrame:
    """Writes Parquet files and returns one row of counters (aggregates) over what was written, taken while writing.

    The counters are observed in the tasks that write, where every part counts once however often it is tried.
    """
    seen = Observation()
    rows.observe(seen, *[c.alias(name) for name, c in counters.items()]).write.mode("overwrite").parquet(path)
    kinds = rows.limit(0).agg(*[c.alias(name) for name, c in counters.items()]).schema
    return rows.sparkSession.createDataFrame([tuple(seen.get[name] for name in counters)], kinds)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text at a path, whole or not at all: it is written beside and then renamed."""
    jvm = spark._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    files.delete(target, False)
    if not files.rename(beside, target):
        raise OSError(f"can't rename to {path}")


#: Buckets that a knowledge store is dealt into by the hash of its ids.
KNOWLEDGE_BUCKETS = 64


def upsert_knowledge(docs: DataFrame, path: str, id_col: str = "id", buckets: int = KNOWLEDGE_BUCKETS) -> DataFrame:
    """Adds documents to a store, each id once: new rows replace those of their ids.

    The store is dealt into buckets by id; only buckets that the new rows fall into are read, merged and overwritten, so the store holds one version of
    each id and a small update costs a few buckets. Rows that repeat an id within ``docs`` must have been made distinct.
    """
    spark = docs.sparkSession
    placed = docs.withColumn("_bucket", F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(buckets)).cast("int"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        touched = [r._bucket for r in placed.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        stored = spark.read.schema(placed.schema).parquet(path).filter(F.col("_bucket").isin(touched))
        kept = stored.join(placed.select(F.col(id_col).alias("_id")), F.col(id_col).eqNullSafe(F.col("_id")), "left_anti")
        merged = kept.unionByName(placed)
    else:
        merged = placed
    # Written beside, since the buckets that are overwritten are read for it.
    beside = f"{path}-{uuid.uuid4().hex}"
    merged.write.partitionBy("_bucket").parquet(beside)
    fresh = spark.read.schema(placed.schema).parquet(beside)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    old = spark._jvm.org.apache.hadoop.fs.Path(beside)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return read_knowledge(spark, path, docs)


def read_knowledge(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The store's documents, with the columns of ``like``."""
    return spark.read.schema(like.schema).parquet(path)


def write_bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int = 64, columns: list[str] | None = None) -> DataFrame:
    """Stores rows as the table ``name``, bucketed and sorted by ``keys``: joins on them shuffle only the other side."""
    kept = rows.select(*columns) if columns else rows
    kept.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return rows.sparkSession.table(name)
