"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: space and the controls from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
#: What lies between words of letters and digits: all of ASCII but 0-9 and a-z (the text is lower-cased first).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables that ``cut`` has written.
WRITTEN: list[str] = []
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def whole_text(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Texts of pure ASCII take the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column) -> Column:
    """Array of the words between white space."""
    return F.array_remove(F.split(text, WHITE), "")


def alnum_words(text: Column) -> Column:
    """Array of the lower-cased words of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(text), NOT_WORD), "")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (name + "_" * i for i in range(len(taken) + 1)) if x.lower() not in taken) for name in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local one only where that is unset and all runs in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = own.get() if own.isDefined() else "/tmp/terrane-checkpoints"
    return at.rstrip("/")


def cut(df: DataFrame, name: str = "step", gather: bool = False) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it back. It survives the loss of any executor.

    ``gather`` deals the rows anew by size first, so that a small result makes few files and a large one stays split.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/terrane-{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    (df.hint("rebalance") if gather else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def holding() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``hold(df)`` keeps what several steps read in the executors' storage, spilling to disk; lost parts are computed anew from its lineage.

    All is freed at the end, so what leaves the block must have been cut.
    """
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    try:
        yield hold
    finally:
        for df in held:
            df.unpersist()


#: Bytes up to which a side of a join is broadcast; larger sides are shuffled.
BROADCAST_BYTES = 24 << 20


def small(df: DataFrame, size: Column | int, bytes_: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts ``df`` if it is proven to take at most ``bytes_``; else the join shuffles.

    ``size`` is what a row takes: a number if all take the same, else an expression that is summed. ``df`` is read for the proof, so cut it before.
    """
    if isinstance(size, int):
        most = bytes_ // size
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    total = df.agg(F.coalesce(F.sum(size.cast("long") + 16), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= bytes_ else df


def sweep(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Deletes the tables that ``cut`` has written in this session after the first ``since``, but for ``keep``; call it once their results are stored elsewhere."""
    paths, WRITTEN[since:] = WRITTEN[since:], [keep] if keep in WRITTEN[since:] else []
    for name in paths:
        if name != keep:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
