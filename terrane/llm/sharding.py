"""Sharding by sampled splitters: ``bytes`` law.

Every record has a key (hash of the text, hash of the row), so equal texts are neighbours and yet no key is heavy. A bounded
sample, drawn with a probability that follows a record's size, gives quantile boundaries; records are dealt to the
ranges between them, ranges with too many rows are subdivided by the row hash, and each range learns from the totals of the
ranges before it where it starts. A record's shard follows from the bytes that precede it in this order, so shard sizes differ
by less than the largest record; the slot is its rank in the shard.

Texts are read once and dropped at once: only (id, size, hashes) are shuffled. Defined cases: a null text has
size 1; repeated rows are records of their own, told apart by their order alone; an empty table gives an empty result; extra
columns are ignored, ``write_shards`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_text

SHARDS = 8
#: Expected size of the sample, and ranges made from it: both bounded for any input.
SAMPLE, RANGES = 16_384, 256
#: A range of more than this many times the mean rows is subdivided.
OVERFULL = 2
#: Rows beyond which more than ``RANGES`` ranges are subdivided anyway, so that no task sorts more.
ROWS_A_TASK = 2_000_000


def keys(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, th, rh): one narrow pass over the texts."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return docs.select(F.col(id_col), size.alias("size"), F.crc32(whole_text().cast("binary")).alias("text_crc32"), F.xxhash64(whole_text()).alias("th"), F.xxhash64(F.col(id_col), whole_text()).alias("rh"))


def _unit(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit("sample"), h), F.lit(1 << 40)) / float(1 << 40)


def splitters(rows: DataFrame, total: int, count: int, sample: int = SAMPLE, ranges: int = RANGES) -> list[int]:
    """Quantile boundaries over text hashes; at most ``ranges - 1`` numbers, from about ``sample`` sampled keys.

    Half of a record's weight is its share of the bytes and half its share of the rows, so many small records
    count as a few large ones do.
    """
    chance = sample * (F.col("size") / (2.0 * total) + 1 / (2.0 * count))
    drawn = sorted(r.th for r in rows.filter(_unit(F.col("rh")) < chance).select("th").collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, rh) of every record."""
    rows = cut(keys(docs, id_col), "keys")
    sums = rows.agg(F.sum("size").alias("total"), F.count("*").alias("n")).first()
    total, count = sums.total or 0, sums.n
    cuts = splitters(rows, total, count) if count else []
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    ranged = rows.withColumn("range", F.size(F.filter(bounds, lambda b: b <= F.col("th"))))
    # Overfull ranges: a table of at most RANGES rows, brought in by a broadcast.
    usual = max(1, min(OVERFULL * count // max(1, len(cuts) + 1), ROWS_A_TASK))
    held = ranged.groupBy("range").agg(F.count("*").alias("m"))
    parts = held.select("range", F.greatest(F.ceil(F.col("m") / usual), F.lit(1)).alias("parts"))
    dealt = ranged.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.col("rh"), F.col("parts")).cast("int"))
    dealt = cut(dealt.select(id_col, "size", "text_crc32", "th", "rh", "range", "part"), "dealt")
    # Totals of every piece and of those before it. Pieces number at most RANGES * (1 + OVERFULL) plus one per ROWS_A_TASK rows.
    pieces = dealt.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count("*").alias("m"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(pieces.select("range", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0")), "offsets")
    order = Window.partitionBy("range", "part").orderBy("th", "rh", "size")
    placed = dealt.withColumns({"within": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), "nth": F.row_number().over(order)})
    placed = placed.join(F.broadcast(offsets), ["range", "part"])
    ahead = F.col("b0") + F.coalesce("within", F.lit(0))
    middle = (2 * ahead + F.col("size")).cast("decimal(38,0)")
    number = F.least(F.floor(middle * shards / F.lit(2 * max(total, 1))).cast("int"), F.lit(shards - 1))
    placed = cut(placed.select(id_col, "size", "text_crc32", "rh", number.alias("shard"), (F.col("m0") + F.col("nth") - 1).alias("rank")), "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "rh"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id") -> None:
    """Writes whole records, one folder per shard; several tasks write a shard, each a run of slots, sorted by slot.

    Records move once; rows that repeat an id and text take the slots of one another in any order.
    """
    found = shard(docs, shards, id_col).select(F.col("rh").alias("_rh"), "shard", "slot")
    nth = Window.partitionBy("_rh").orderBy("slot")
    found = found.withColumn("_nth", F.row_number().over(nth))
    texts = docs.withColumn("_rh", F.xxhash64(F.col(id_col), whole_text()))
    texts = texts.withColumn("_nth", F.row_number().over(Window.partitionBy("_rh").orderBy(F.lit(0))))
    texts.join(found, ["_rh", "_nth"]).drop("_rh", "_nth").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
