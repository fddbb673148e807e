"""Detection, retrieval and remediation metrics, agreement and inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def prf(rows: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 to (tp, fp, fn)."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = rows.withColumns({"precision": p, "recall": r})
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def told(truth: DataFrame) -> DataFrame:
    """The truths that a scanner can find: those without HEURISTIC for a check."""
    return truth.filter(F.coalesce("check", F.lit("")) != "HEURISTIC")


def match(detections: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """(det_id, gt_id): each detection with its first truth of the same file and check, within the tolerance or without a line.

    Both sides are reduced to one row per (file, check, line) before they meet, and meet on buckets of lines, so a hot file
    costs its distinct lines times the tolerance and never all pairs. HEURISTIC detections and truths never match; a missing check equals a missing one.
    """
    keys, width = ["file", "check"], tolerance + 1
    check = F.coalesce("check", F.lit(""))
    detections, truth = detections.withColumn("check", check), told(truth).withColumn("check", check)
    lines = truth.groupBy(*keys, "line").agg(F.min("gt_id").alias("gt"))
    whole = lines.groupBy(*keys).agg(F.min("gt").alias("any_gt"), F.min(F.when(F.col("line").isNull(), F.col("gt"))).alias("open_gt"))
    asked = detections.filter("upper(check) <> 'HEURISTIC'").select(*keys, "line").distinct()
    bucket = F.floor(F.col("line") / width)
    near = asked.filter("line is not null").select(*keys, F.col("line").alias("dl"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    near = near.join(lines.filter("line is not null").select(*keys, F.col("line").alias("gl"), "gt", bucket.alias("bucket")), [*keys, "bucket"])
    near = near.filter(F.abs(F.col("dl") - F.col("gl")) <= tolerance).groupBy(*keys, F.col("dl").alias("line")).agg(F.min("gt").alias("near_gt"))
    found = asked.join(whole, keys).join(near, [*keys, "line"], "left")
    gt = F.when(F.col("line").isNull(), F.col("any_gt")).otherwise(F.least("near_gt", "open_gt"))
    found = found.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "line"]], gt.alias("gt_id")).filter("gt_id is not null")
    same = (F.col("file") == F.col("_file")) & (F.col("check") == F.col("_check")) & F.col("line").eqNullSafe(F.col("_line"))
    return detections.join(found, same).select("det_id", "gt_id")


def detection_counts(detections: DataFrame, truth: DataFrame, tolerance: int, by: str | None = None) -> DataFrame:
    """TP (distinct matched truths), FP (detections that match nothing), FN; overall or by a column of both sides."""
    matched, truth = match(detections, truth, tolerance), told(truth)
    key = F.lit("all") if by is None else F.col(by)
    hit = truth.join(matched.select("gt_id").distinct().withColumn("_hit", F.lit(1)), "gt_id", "left")
    t = hit.groupBy(key.alias("group")).agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("tp"), F.sum(1 - F.coalesce("_hit", F.lit(0))).alias("fn"), F.lit(0).cast("long").alias("fp"))
    f = detections.join(matched.select("det_id"), "det_id", "left_anti").groupBy(key.alias("group")).agg(F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), F.count("*").alias("fp"))
    return prf(t.unionByName(f).groupBy("group").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def macro_f1(by_type: DataFrame, min_support: int = 0) -> DataFrame:
    """Unweighted mean of F1 over the groups with enough truths."""
    return by_type.filter(F.col("tp") + F.col("fn") >= min_support).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_types"))


def keyword_scores(queries: DataFrame, taxonomy: DataFrame, most: int = 10_000) -> DataFrame:
    """(query_id, doc_idx, score, relevant): 10 for an equal CWE, 5 for the type in the name, 1 per query word in the description.

    The taxonomy is a dimension of some dozens of rows, so every query meets it in place; one of more than ``most`` rows is refused.
    """
    if taxonomy.limit(most + 1).count() > most:
        raise ValueError(f"a taxonomy of more than {most} rows is no dimension")
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "type", "cwe")), " "), lambda w: w != "")
    t = taxonomy.select("doc_idx", F.col("cwe").alias("t_cwe"), F.lower("name").alias("t_name"), F.lower("description").alias("t_text"))
    docs = F.broadcast(t.agg(F.collect_list(F.struct(*t.columns)).alias("docs")).withColumn("_k", F.lit(1)))
    pairs = queries.withColumn("_k", F.lit(1)).join(docs, "_k").select("query_id", "type", "cwe", words.alias("words"), F.inline("docs"))
    points = F.when(F.col("t_cwe") == F.col("cwe"), 10).otherwise(0) + F.when(F.col("t_name").contains(F.replace("type", F.lit("_"), F.lit(" "))), 5).otherwise(0) + F.size(F.filter("words", lambda w: F.col("t_text").contains(w)))
    relevant = (F.col("t_cwe") == F.col("cwe")) | F.replace("t_name", F.lit(" "), F.lit("_")).contains(F.lower("type"))
    return pairs.select("query_id", "doc_idx", points.alias("score"), relevant.alias("relevant"))


def retrieval_metrics(scores: DataFrame, k: int = 5) -> DataFrame:
    """Hit rates at 3 and k and the mean reciprocal rank of the first relevant document within k."""
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_idx"))
    top = scores.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k)
    firsts = top.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return firsts.agg(
        F.avg(F.when(F.col("first") <= 3, 1.0).otherwise(0.0)).alias("hit_rate_k3"),
        F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate_k5"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.count("*").alias("total_queries"),
    )


def patch_verdicts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rules removed and new between sides "before" and "after"; valid if some went and none came.

    Rules are reduced to one row per (key, rule) before anything is put together.
    """
    sides = findings.groupBy(*keys, "rule_id").agg(F.max((F.col("side") == "before").cast("int")).alias("b"), F.max((F.col("side") == "after").cast("int")).alias("a"))
    counts = sides.groupBy(*keys).agg(F.sum(F.col("b")).alias("targeted"), F.sum(F.col("b") * (1 - F.col("a"))).alias("removed"), F.sum(F.col("a") * (1 - F.col("b"))).alias("new"))
    return counts.withColumn("valid", (F.col("removed") > 0) & (F.col("new") == 0))


def ensemble(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """A patch is valid if all its scanners say so; no scanner, no validity."""
    return verdicts.groupBy(*keys).agg(F.bool_and("valid").alias("valid"), F.sum("removed").alias("removed"), F.sum("targeted").alias("targeted"), F.max((F.col("new") > 0).cast("int")).alias("violates"))


def remediation(files: DataFrame) -> DataFrame:
    """PVR, SER (micro and macro) and NNIR over files (valid, removed, targeted, violates, patched)."""
    patched = F.sum(F.col("patched").cast("int"))
    return files.agg(
        F.count("*").alias("n_files"),
        ratio(F.sum(F.col("valid").cast("int")), F.count("*")).alias("pvr"),
        ratio(F.sum("removed"), F.sum("targeted")).alias("ser_micro"),
        F.avg(F.when(F.col("targeted") > 0, F.col("removed") / F.col("targeted"))).alias("ser_macro"),
        F.when(patched > 0, 1 - F.sum("violates").cast("double") / patched).otherwise(0.0).alias("nnir"),
    )


def self_consistency(samples: DataFrame, n: int = 5, least: float = 0.4) -> DataFrame:
    """(prompt_id, form, raw, confidence): share of each normalised form among n samples; the first raw answer stands for it."""
    votes = samples.filter("form <> ''").groupBy("prompt_id", "form").agg((F.count("*") / n).alias("confidence"), F.min(F.struct("idx", "raw"))["raw"].alias("raw"))
    return votes.filter(F.col("confidence") >= least)


def success_at(attempts: DataFrame, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Share of files whose first valid attempt is at most k."""
    firsts = attempts.groupBy("file_id").agg(F.min(F.when(F.col("valid"), F.col("attempt"))).alias("first"))
    return firsts.agg(*[F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"sr_at_{k}") for k in ks])


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """Fleiss' kappa over (item, category, n) with the same number of ratings for each item."""
    items = ratings.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s"))
    agreement = items.agg(F.avg((F.col("s") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("p"), F.sum("m").alias("total"))
    chance = ratings.groupBy("category").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    both = agreement.withColumn("_k", F.lit(1)).join(F.broadcast(chance.withColumn("_k", F.lit(1))), "_k")
    pe = F.col("cc") / (F.col("total") * F.col("total"))
    return both.select(F.when(pe < 1, (F.col("p") - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def signed_rank(pairs: DataFrame) -> DataFrame:
    """Wilcoxon signed-rank statistic over (x, y): W+, W-, n, z (ties share ranks, zero differences go).

    Equal absolute differences are summed first. Ranks are made in two steps: values fall into logarithmic buckets (at most some
    thousands, whose counts give every bucket its first rank), then rank within their bucket only.
    """
    d = pairs.select((F.col("x") - F.col("y")).alias("d")).filter("d <> 0")
    values = d.groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("m"), F.sum((F.col("d") > 0).cast("int")).alias("up")).withColumn("bucket", F.floor(F.log2("a") * 64).cast("int"))
    upto = F.sum("m").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    firsts = values.groupBy("bucket").agg(F.sum("m").alias("m")).select("bucket", F.coalesce(upto, F.lit(0)).alias("first"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("bucket").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = values.withColumn("before", before).join(firsts, "bucket").withColumn("rank", F.col("first") + F.col("before") + (F.col("m") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum((F.col("m") - F.col("up")) * F.col("rank")).alias("w_minus"), F.sum("m").alias("n"))
    n = F.col("n")
    return sums.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def holm(p_values: dict[str, float]) -> dict[str, float]:
    """Holm-Bonferroni adjusted p-values of a handful of comparisons."""
    out, most = {}, 0.0
    for i, (name, p) in enumerate(sorted(p_values.items(), key=lambda x: x[1])):
        most = max(most, min(1.0, (len(p_values) - i) * p))
        out[name] = most
    return out


def run_statistics(runs: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and both standard deviations of a measure over repeated runs."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd_sample"), F.stddev_pop(value).alias("sd_population"))
