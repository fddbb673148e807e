"""The registered queries: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import rules, text, tools
from .operators import evaluation, filters, pairing, summaries
from .operators import records as rec
from .plans import corpus, searches
from .plans.testviews import records, table
from .sources.scratch import shared_folder
from .streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query
def record_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", text.record_id("GH", F.col("source"), F.col("doc_id").cast("string"), F.col("lang")).alias("id"))


@query
def dedup_best(spark, d):
    return rec.dedup_best(records(spark, d)).select("id", "content_hash", "has_fix", "n_smells")


@query
def split_assign(spark, d):
    return corpus.merge([records(spark, d)]).select("id", "iac_tool", "split")


@query
def split_counts(spark, d):
    return split_assign(spark, d).groupBy("iac_tool", "split").agg(F.count("*").alias("n"))


@query
def merge_stats(spark, d):
    """The merged records go to a file store; what went there is counted on the way."""
    return corpus.merge_counted([records(spark, d)], shared_folder(spark, "merged"))


@query
def tier_assign(spark, d):
    return records(spark, d).select("id", rec.tier().alias("tier"), rec.fixed_rules().alias("fixed"), rec.before_is_real().alias("before_real"))


@query
def tier_stats(spark, d):
    rows = records(spark, d).select(rec.tier().alias("tier"))
    return rows.agg(*[F.count_if(F.col("tier") == t).alias(t.lower()) for t in rec.TIERS])


@query
def normalise_records(spark, d):
    return rec.normalise(records(spark, d)).select("id", "code_before_quality", "has_fix", "content_hash", "tier", F.col("code_after").isNull().alias("no_after"))


@query
def release_best(spark, d):
    return rec.release_best(rec.normalise(records(spark, d)), rec.primary_key()).select("id", "tier", "content_hash")


@query
def release_outputs(spark, d):
    rows = corpus.release(records(spark, d))
    return rows.agg(F.count("*").alias("n_full"), F.count_if(F.col("tier") == "A").alias("gold"), F.count_if(F.col("tier").isin("A", "B") & F.col("has_fix")).alias("fix_pairs"), F.count_if(F.col("tier").isin("A", "B", "C")).alias("detection"))


@query
def manifest_counts(spark, d):
    return corpus.manifest(records(spark, d).withColumn("tier", rec.tier()), ["tier", "source", "iac_tool", "code_before_quality"])


@query
def labels_array(spark, d):
    none = F.array().cast("array<string>")
    return records(spark, d).select("id", F.array_join(text.labels(F.col("smell_types"), none, F.col("rules_before"), F.col("iac_tool")), "|").alias("labels"))


@query
def smell_topk(spark, d):
    return summaries.top_counts(records(spark, d).select("ord", F.posexplode("smell_types").alias("at", "smell")), ["smell"], 25, F.struct("ord", "at"))


@query
def classify_smells(spark, d):
    lowered = table(spark, d, "documents").select("doc_id", "text", F.lower("text").alias("lowered"))
    found = lowered.select("doc_id", F.explode(rules.annotations(F.col("text"), F.col("lowered"))).alias("s"))
    return found.select("doc_id", "s.type", "s.cwe", "s.severity", "s.checkov_id", "s.description")


@query
def heuristic_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(text.lines_of(F.col("text"))).alias("pos", "line"))
    hits = F.array(*[F.when(F.col("line").rlike("(?i)" + p), F.struct(F.lit(t).alias("type"), F.lit(c).alias("cwe"))) for p, t, c in rules.HEURISTICS])
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select("doc_id", "line", "h.type", "h.cwe")


@query
def text_metrics(spark, d):
    return table(spark, d, "documents").select("doc_id", text.text_metrics(F.col("text")).alias("m")).select("doc_id", "m.*")


@query
def detect_tool(spark, d):
    return table(spark, d, "pages").select("page_id", tools.detect_tool(F.lit("page"), F.col("html")).alias("tool"))


@query
def analyzer_tool(spark, d):
    return table(spark, d, "documents").select("doc_id", tools.analyzer_tool(F.lit("page"), F.col("text")).alias("tool"))


@query
def signal_filters(spark, d):
    text_ = F.col("text")
    return table(spark, d, "documents").select("doc_id", filters.has_signal(F.lit(0), text_).alias("signal"), filters.message_signal(text_).alias("message"), filters.fits(text_).alias("small"))


@query
def training_filter(spark, d):
    rows = corpus.training_samples(records(spark, d).withColumns({"split": F.lit("train"), "cwes": F.array().cast("array<string>")}))
    return rows.select("id", "iac_tool", F.array_join("smell_types", "|").alias("types"))


@query
def training_stats(spark, d):
    return corpus.training_stats(records(spark, d))


@query
def resume_anti_join(spark, d):
    return pairing.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query
def pair_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").withColumn("value", F.col("doc_id"))
    return pairing.pair_first(rows, "source", F.col("quality") == 0, F.col("quality") == 1, "doc_id", "value").select("doc_id", "source", "after_value", "has_fix")


@query
def path_verdicts(spark, d):
    return table(spark, d, "pages").select("page_id", F.when(F.col("url").isNotNull(), F.coalesce(pairing.path_verdict(F.col("url")), F.lit("none"))).alias("verdict"))


@query
def taxonomy_lookup(spark, d):
    dim = spark.createDataFrame([(n, c, s, k) for n, c, s, k, _ in rules.TAXONOMY], "type string, cwe string, severity string, category string")
    kinds = F.array(*[F.lit(x) for x in ("hardcoded_password", "weak_hash", "no_mfa", "unknown_type")])
    rows = table(spark, d, "events").select("event_id", kinds[(F.col("event_id") % 4).cast("int")].alias("type"))
    joined = pairing.lookup(rows, dim, "type").select(F.coalesce("severity", F.lit("NONE")).alias("severity"), F.coalesce("cwe", F.lit("NONE")).alias("cwe"))
    return joined.groupBy("severity", "cwe").agg(F.count("*").alias("n"))


def _sides(spark, d):
    e = table(spark, d, "events").withColumns({"line": F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000), "file": F.col("user_id"), "check": F.lit("C"), "group": F.col("user_id") % 10})
    det = e.filter("event_type = 'error'").withColumn("det_id", F.col("event_id"))
    gt = e.filter("event_type = 'purchase'").withColumn("gt_id", F.col("event_id"))
    return det, gt


@query
def detection_match(spark, d):
    return evaluation.match(*_sides(spark, d), 60)


@query
def detection_metrics(spark, d):
    return evaluation.detection_counts(*_sides(spark, d), 60)


@query
def detection_by_group(spark, d):
    return evaluation.detection_counts(*_sides(spark, d), 60, "group")


@query
def macro_f1(spark, d):
    return evaluation.macro_f1(detection_by_group(spark, d))


def _taxonomy_scores(spark, d):
    """Every smell found in a text asks the taxonomy."""
    rows = spark.createDataFrame([(i, n, c) for i, (n, c, *_) in enumerate(rules.TAXONOMY)], "idx long, type string, cwe string")
    docs = rows.select(F.col("idx").alias("doc_idx"), "cwe", F.replace("type", F.lit("_"), F.lit(" ")).alias("name"), F.concat_ws(" ", "type", "cwe").alias("description"))
    asked = classify_smells(spark, d).select("doc_id", "type").join(F.broadcast(rows), "type")
    return evaluation.keyword_scores(asked.select((F.col("doc_id") * 1000 + F.col("idx")).alias("query_id"), "type", "cwe"), docs)


@query
def retrieval_scores(spark, d):
    return _taxonomy_scores(spark, d).filter("score > 0").drop("relevant")


@query
def retrieval_metrics(spark, d):
    return evaluation.retrieval_metrics(_taxonomy_scores(spark, d))


@query
def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    near = pairing.nearest(e.filter("vec_id % 20 = 0"), e, 5)
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query
def knn_indexed(spark, d):
    """The neighbours of ``knn_topk`` through an index that proves what it leaves out."""
    e = table(spark, d, "embeddings")
    near = pairing.nearest_by_radii(e.filter("vec_id % 20 = 0"), e, 5, shared_folder(spark, "neighbours"))
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def _findings(spark, d):
    return table(spark, d, "events").select("user_id", F.col("event_type").alias("rule_id"), F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "before").otherwise("after").alias("side"))


@query
def patch_verdict(spark, d):
    return evaluation.patch_verdicts(_findings(spark, d), ["user_id"])


@query
def remediation_metrics(spark, d):
    files = evaluation.ensemble(evaluation.patch_verdicts(_findings(spark, d), ["user_id"]), ["user_id"])
    return evaluation.remediation(files.withColumn("patched", F.lit(True)))


@query
def self_consistency(spark, d):
    raw = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("idx"), raw.alias("raw"), text.normalise_diff(raw).alias("form"))
    return evaluation.self_consistency(rows, 5, 0.2)


@query
def diff_lines(spark, d):
    signed = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, "-").when(i % 3 == 1, "+").otherwise(" "), x)), "\n")
    rows = table(spark, d, "documents").select("doc_id", signed.alias("diff"))
    return rows.select("doc_id", text.diff_stats(F.col("diff")).alias("s"), F.md5(text.diff_side(F.col("diff"), "-")).alias("before_md5")).select("doc_id", "s.added", "s.removed", "before_md5")


@query
def query_product(spark, d):
    verbs = spark.createDataFrame([(v,) for v in searches.VERBS], "v string")
    return searches.product(verbs, table(spark, d, "nation").select("n_name"), table(spark, d, "region").select("r_name"))


@query
def date_windows(spark, d):
    """Windows back from the last event to the first."""
    first, last = table(spark, d, "events").agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    windows = searches.date_windows(spark, str(first or "2024-01-01"), str(last or "2024-01-01"))
    return windows if first else windows.limit(0)


@query
def union_inputs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    both = docs.filter("doc_id % 2 = 0").unionByName(docs.filter("doc_id % 2 = 1"))
    counts = both.groupBy("source").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"), "source")))


@query
def event_candidates(spark, d):
    rows = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    return summaries.first_and_count(rows, ["user_id", "event_type"], "event_id")


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_rate(spark, d):
    return monitor.rates(_events(spark, d)).select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def stream_stall(spark, d):
    return monitor.sessions(_events(spark, d)).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query
def stream_dedup(spark, d):
    return monitor.dedup(_events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type")


@query
def circuit_breaker(spark, d):
    return monitor.breaker(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "failures", "opens")


@query
def metric_lines(spark, d):
    return monitor.metric_lines(_events(spark, d)).select(F.unix_micros("start").alias("start_us"), "n", "rate_per_min", "total_today")


@query
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query
def fleiss_kappa(spark, d):
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    return evaluation.fleiss_kappa(r).select(F.round("kappa", 9).alias("kappa"))


@query
def signed_rank(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 1500).alias("y"))
    return evaluation.signed_rank(pairs).drop("z")


@query
def account_halves(spark, d):
    found = searches.halves(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", shared_folder(spark, "halves"))
    return found.select("s_suppkey", "half", "odd")


@query
def context_precision(spark, d):
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_idx")))
    found = summaries.context_precision(_taxonomy_scores(spark, d).withColumn("rank", rank), 5)
    return found.select("query_id", F.round("context_precision", 9).alias("context_precision"))


def _attempts(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("file_id"), (F.col("event_id") % 3 + 1).alias("attempt"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0)).alias("valid"))


@query
def success_at(spark, d):
    return evaluation.success_at(_attempts(spark, d))


@query
def retry_benefit(spark, d):
    return summaries.retry_benefit(evaluation.success_at(_attempts(spark, d))).select(*[F.round(c, 9).alias(c) for c in ("fa_sr", "delta_r_at_2", "delta_r_at_3")])


@query
def cost_metrics(spark, d):
    calls = table(spark, d, "conversations").select(F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"), (F.col("role") == "assistant").alias("valid"))
    found = summaries.costs(calls, 0.15, 0.6)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query
def dataset_statistics(spark, d):
    smells = table(spark, d, "events").select(F.col("event_type").alias("iac_tool"), (F.col("user_id") % 3).cast("string").alias("category"), F.concat(F.lit("CWE-"), (F.col("event_id") % 18).cast("string")).alias("cwe"))
    return summaries.dataset_statistics(smells)


@query
def top_tools(spark, d):
    return summaries.top_counts(table(spark, d, "documents"), ["lang", "source"], 6)


@query
def validation_stats(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    done, failed = F.col("quality").isNotNull(), F.coalesce("quality", F.lit(1)) == 0
    return summaries.validation_stats(rows, done, failed, F.coalesce("toxic", F.lit(0)))


@query
def ordered_unique(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    return filters.ordered_unique(rows, "o_orderpriority", "o_orderkey")


@query
def commit_queries(spark, d):
    """The vocabulary, and after it the types of parts as words of one's own, in the order of their first part."""
    words = filters.ordered_unique(table(spark, d, "part").select("p_type", "p_partkey"), "p_type", "p_partkey")
    return searches.commit_queries(spark, words.select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("word")))


@query
def work_units(spark, d):
    verbs = table(spark, d, "region").select(F.col("r_name").alias("query"))
    windows = searches.date_windows(spark, "2023-11-01", "2024-01-30")
    done = windows.filter("stop >= date'2024-01-16'").withColumn("query", F.lit("ASIA"))
    return searches.work_units(verbs, windows, done)


@query
def progress_merge(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("unit"), (F.col("event_id") % 50).alias("last_page"), (F.col("event_type") == "view").alias("done"))
    return searches.merge_progress(e.filter("last_page < 25"), e.filter("last_page >= 25"))


@query
def version_pairs(spark, d):
    e = table(spark, d, "events")
    files = e.select(F.col("user_id").alias("repo"), F.col("event_type").alias("path"), F.col("event_id").alias("commit_sha"), (F.col("event_id") - 1).alias("parent_sha"))
    versions = e.select(F.col("user_id").alias("repo"), F.col("event_type").alias("path"), F.col("event_id").alias("ref"), F.col("props").alias("content"))
    return filters.version_pairs(files, versions).select("commit_sha", "code_before", "code_after")


@query
def pairwise_agreement(spark, d):
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    return summaries.pairwise_agreement(r).select(F.round("rpa", 9).alias("rpa"))


@query
def group_keys(spark, d):
    return table(spark, d, "pages").groupBy(filters.group_key(F.col("url"), 4).alias("key")).agg(F.count("*").alias("n"))


@query
def prompts(spark, d):
    none = lambda name: F.lit(None).cast("string").alias(name)
    smells = F.transform("smell_types", lambda t: F.struct(t.alias("type"), none("line"), none("description"), none("cwe")))
    text_ = corpus.render_prompt(F.col("iac_tool"), smells, F.lit(""), F.col("code_before"))
    ask = corpus.retrieval_query(F.col("iac_tool"), F.col("smell_types"), F.col("input_rank"))
    return records(spark, d).select("id", F.md5(text_).alias("prompt_md5"), F.md5(ask).alias("query_md5"))


@query
def primary_keys(spark, d):
    return records(spark, d).select("id", F.md5(rec.primary_key()).alias("key_md5"))
