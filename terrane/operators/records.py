"""Record-level operators: reality of the before side, tiers, scores, normalisation, deduplication, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import smells
from ..functions.text import PLACEHOLDER, STRONG_KEYWORDS, contains_any, content_hash, labels, split_sizes, strip
from ..sources.scratch import shared_folder
from .pairing import small

TIERS = ("A", "B", "C", "D")
#: First hex digits of a hash that make up a bucket of ranks: 4096 buckets a stratum.
BUCKET_DIGITS = 3
SMELLS = "array<struct<type:string,cwe:string,checkov_id:string,severity:string,category:string,description:string,line_number:int>>"


def _array(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def fixed_rules(before: str = "rules_before", after: str = "rules_after") -> Column:
    """How many distinct non-empty rule ids the change removed."""
    ids = lambda c: F.filter(_array(c), lambda x: x.isNotNull() & (x != ""))
    return F.size(F.array_except(ids(before), ids(after)))


def before_is_real() -> Column:
    """Whether the before side is genuine, by quality flag; without a flag by its content."""
    quality, code = F.col("code_before_quality"), F.coalesce("code_before", F.lit(""))
    long_enough = F.length(code) > 20
    return (
        F.when(quality.isin("api", "exact", "partial"), True)
        .when(quality == "new_file", long_enough)
        .when(quality.isin("unavailable", "heuristic"), False)
        .otherwise(~code.contains(PLACEHOLDER) & long_enough)
    )


def real_before() -> Column:
    """The stricter rule of the score: not blank and no placeholder."""
    code = F.coalesce("code_before", F.lit(""))
    return (strip(code) != "") & ~code.contains(PLACEHOLDER)


def tier(n_smells: str = "n_smells") -> Column:
    fix, real, smells = F.coalesce("has_fix", F.lit(False)), before_is_real(), F.col(n_smells) > 0
    validated = F.size(_array("rules_before")) > 0
    strong = contains_any(F.lower(F.coalesce("commit_message", F.lit(""))), STRONG_KEYWORDS)
    new_file = (F.coalesce("code_before_quality", F.lit("")) == "new_file") & (F.coalesce("code_after", F.lit("")) != "")
    return (
        F.when(fix & real & (fixed_rules() > 0), "A")
        .when(fix & real & (validated | smells | strong), "B")
        .when((real & validated) | (new_file & smells) | (real & smells), "C")
        .otherwise("D")
    )


def score() -> Column:
    """Compares like a tuple: tier, fixed rules, validated, fix, real before, smells, input rank."""
    rank = F.when(F.col("tier") == "A", 4).when(F.col("tier") == "B", 3).when(F.col("tier") == "C", 2).otherwise(1)
    return F.struct(rank.alias("tier_score"), fixed_rules().alias("fixed"), (F.size(_array("rules_before")) > 0).cast("int").alias("validated"), F.coalesce("has_fix", F.lit(False)).cast("int").alias("fix"), real_before().cast("int").alias("real"), F.col("n_smells").cast("int").alias("smells"), F.col("input_rank").cast("int").alias("input_rank"))


def dedup_best(records: DataFrame, key: str = "content_hash") -> DataFrame:
    """One row per key: a fix first, then most smells, then load order."""
    best = Window.partitionBy(key).orderBy(F.desc("has_fix"), F.desc("n_smells"), F.asc("ord"))
    return records.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def primary_key() -> Column:
    """(repo, commit, path) if all are non-empty, else the content hash; tagged."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("repo", "commit_sha", "file_path")]
    whole = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return F.when(whole, F.concat_ws("\x01", F.lit("repo_commit_path"), *parts)).otherwise(F.concat_ws("\x01", F.lit("content"), F.col("content_hash")))


def release_best(records: DataFrame, key: Column) -> DataFrame:
    """One row per key: the highest score, on a tie the earlier row."""
    best = Window.partitionBy("_key").orderBy(F.desc("_score"), F.asc("ord"))
    rows = records.withColumns({"_key": key, "_score": score()})
    return rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_key", "_score")


def assign_splits(records: DataFrame, strata: list[str], seed: int = 42, id_col: str = "id", folder: str | None = None) -> DataFrame:
    """Stratified splits, exact in count and deterministic by seed: rows rank by the SHA-256 of seed and id.

    ``records`` is computed once, into ``folder`` (a new shared one by default); all else reads narrow columns of it. The splits of a stratum end at two
    ranks, and counts by the first digits of the hash tell in which bucket each of them lies; only rows of those buckets are ranked. Every
    row then compares its hash with its stratum's two bounds, so texts are never shuffled, and no stratum meets in one task. Rows of one id share a split.
    """
    spark = records.sparkSession
    folder = folder or shared_folder(spark, "split")
    drawn = records.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col)), 256))
    drawn.write.parquet(folder)
    rows = spark.read.schema(drawn.schema).parquet(folder)
    bucket = F.substring("_h", 1, BUCKET_DIGITS)
    counts = rows.groupBy(*strata, bucket.alias("_b")).agg(F.count("*").alias("_m"))
    stratum = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_m").over(stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = counts.withColumns({"_before": before, "_size": F.sum("_m").over(stratum)})
    n_train, n_val = split_sizes(F.col("_size"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("_end"), n_train.alias("_rank")), F.struct(F.lit(1).alias("_end"), (n_train + n_val).alias("_rank"))))
    wanted = sized.withColumn("e", ends).withColumn("_at", F.col("e._rank") - F.col("_before")).filter((F.col("_at") > 0) & (F.col("_at") <= F.col("_m")))
    wanted = wanted.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(strata)], F.col("_b").alias("_wb"), "e._end", "_at")
    # Ranks within the buckets where a split ends: a few thousandths of the rows, ids and hashes only.
    narrow = rows.select(*strata, F.col(id_col).alias("_id"), "_h", bucket.alias("_b"))
    inside = narrow.join(wanted.select(*[f"_w{i}" for i in range(len(strata))], "_wb").distinct(), _same(strata, "_w") & (F.col("_b") == F.col("_wb")), "left_semi")
    ranked = inside.withColumn("_n", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", "_id")))
    met = ranked.join(wanted, _same(strata, "_w") & (F.col("_b") == F.col("_wb")) & (F.col("_n") == F.col("_at")))
    end = lambda k: F.max(F.when(F.col("_end") == k, F.struct("_h", "_id"))).alias(f"_end{k}")
    bounds = met.groupBy(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)]).agg(end(0), end(1))
    bounds.write.parquet(f"{folder}-bounds")
    bounds = small(spark.read.schema(bounds.schema).parquet(f"{folder}-bounds"))
    key = F.struct("_h", F.col(id_col).alias("_id"))
    split = F.when(F.coalesce(key <= F.col("_end0"), F.lit(False)), "train").when(F.coalesce(key <= F.col("_end1"), F.lit(False)), "val").otherwise("test")
    joined = rows.join(bounds, _same(strata), "left")
    return joined.withColumn("split", split).drop("_h", "_end0", "_end1", *[f"_s{i}" for i in range(len(strata))])


def _same(strata: list[str], prefix: str = "_s") -> Column:
    return _all([F.lit(True), *[F.col(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(strata)]])


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once a row, whatever filters and columns use them: a generator of one row holds filters back."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def typed_smells(types: Column) -> Column:
    """array<smell> of bare types."""
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    return F.transform(types, lambda t: F.struct(t.alias("type"), none("cwe"), none("checkov_id"), none("severity"), none("category"), none("description"), none("line_number", "int")))


SAME_SMELL = ["type", "cwe", "checkov_id", "line_number"]


def normalise(records: DataFrame) -> DataFrame:
    """The release contract: new files become detection records and are classified anew, qualities get defaults, smells are kept once
    each, hashes, tiers and labels are made anew. Smells come as ``smells``, as bare ``smell_types``, or as their number ``n_smells`` only."""
    code, after, diff = (F.coalesce(c, F.lit("")) for c in ("code_before", "code_after", "diff"))
    quality = F.col("code_before_quality")
    new_file = (F.coalesce(quality, F.lit("")) == "new_file") | diff.contains("@@ -0,0")
    unavailable = code.contains(PLACEHOLDER) | (code == "")
    columns = records.columns
    known = F.col("smells") if "smells" in columns else typed_smells(F.col("smell_types")) if "smell_types" in columns else F.array().cast(SMELLS)
    unnamed = F.lit(0) if {"smells", "smell_types"} & set(columns) else F.coalesce("n_smells", F.lit(0))
    rows = records.withColumns(
        {
            "_new": new_file,
            "smells": known,
            "code_before_quality": F.when(new_file, "new_file").when(unavailable, F.coalesce(quality, F.lit("unavailable"))).otherwise(F.coalesce(quality, F.lit("api"))),
            "code_before": F.when(new_file, after).otherwise(F.col("code_before")),
            "code_after": F.when(~new_file, F.col("code_after")),
            "has_fix": F.when(new_file, False).otherwise(F.col("has_fix")),
            "source_version": F.coalesce(F.nullif("source_version", F.lit("")), F.lit("v2_normalized")) if "source_version" in records.columns else F.lit("v2_normalized"),
        }
    )
    found = F.when(F.col("_new"), smells(F.col("code_before")))
    merged = F.concat(F.coalesce("smells", F.array().cast(SMELLS)), F.coalesce(found, F.array().cast(SMELLS)))
    rows = rows.withColumn("smells", merged).withColumn("smells", dedupe_array(F.col("smells"), SAME_SMELL)).drop("_new")
    field = lambda name: F.transform("smells", lambda s: s[name])
    rows = rows.withColumns({"smell_types": field("type"), "n_smells": F.size("smells") + unnamed, "labels": labels(field("type"), field("severity"), field("cwe"), F.col("iac_tool"))})
    return rows.withColumn("content_hash", content_hash(F.coalesce(F.nullif(F.coalesce("code_before", F.lit("")), F.lit("")), F.col("code_after")))).withColumn("tier", tier())


def dedupe_array(items: Column, same: list[str]) -> Column:
    """First occurrence of each item by the fields, in array order; nulls are equal."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda y: _all([y[k].eqNullSafe(x[k]) for k in same])))


def positions(records: DataFrame, order: list[Column], folder: str) -> DataFrame:
    """Adds ``position``, gapless from 0 in the order. Sorted runs are written once under ``folder`` with their run and place, then each run learns from
    the sizes of those before it where it starts; no task sorts more than its run."""
    runs = records.orderBy(*order).select("*", F.spark_partition_id().alias("_run"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    runs.write.parquet(folder)
    runs = records.sparkSession.read.schema(runs.schema).parquet(folder)
    sizes = runs.groupBy("_run").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_run", F.coalesce(before, F.lit(0)).alias("_start")))  # a row for each run
    return runs.join(starts, "_run").withColumn("position", F.col("_start") + F.col("_place")).drop("_run", "_place", "_start")
