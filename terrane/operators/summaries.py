"""Reports: one pass each, with fixed rows where the report has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairing import lookup


def top_counts(rows: DataFrame, by: list[str], k: int, seen: Column | None = None) -> DataFrame:
    """The k most frequent keys; ties by key, or by the least ``seen``, the place of a row: the key that was seen first."""
    if seen is None:
        return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(k)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(seen).alias("_seen")).orderBy(F.desc("n"), "_seen").limit(k).drop("_seen")


def first_and_count(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key once, with its first row's order and the number of its rows."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first_id"), F.count("*").alias("n"))


def salvage_stats(salvaged: DataFrame) -> DataFrame:
    """Recovered and lost before sides, and smells added."""
    q = F.col("code_before_quality")
    return salvaged.agg(F.count("*").alias("total"), F.count_if(q == "exact").alias("exact"), F.count_if(q == "partial").alias("partial"), F.count_if(q == "unavailable").alias("unrecoverable"), F.sum(F.greatest(F.col("smells_added"), F.lit(0))).alias("smells_added"))


def validation_stats(rows: DataFrame, done: Column, failed: Column, findings: Column) -> DataFrame:
    return rows.agg(F.count_if(done & ~failed).alias("processed"), F.count_if(~done).alias("skipped"), F.count_if(failed).alias("errored"), F.count_if(done & (findings > 0)).alias("with_findings"))


def scan_totals(scans: DataFrame) -> DataFrame:
    """Passed and failed checks by kind of scan."""
    return scans.groupBy("check_type").agg(F.sum("summary.passed").alias("passed"), F.sum("summary.failed").alias("failed"))


def dataset_statistics(smells: DataFrame, dimensions: tuple[str, ...] = ("iac_tool", "category", "cwe")) -> DataFrame:
    """(dimension, key, n) of labelled smells, in one pass of grouping sets."""
    rows = smells.groupingSets([[d] for d in dimensions], *dimensions).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    which = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dimensions])
    return rows.select(which.alias("dimension"), F.coalesce(*dimensions).alias("key"), "n")


def context_precision(ranked: DataFrame, k: int = 5) -> DataFrame:
    """Per query: mean precision at the ranks of the relevant documents within the first k."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    top = ranked.filter(F.col("rank") <= k).withColumn("p", F.sum(F.col("relevant").cast("int")).over(upto) / F.col("rank"))
    hits = F.sum(F.col("relevant").cast("int"))
    return top.groupBy("query_id").agg(F.when(hits > 0, F.sum(F.when(F.col("relevant"), F.col("p"))) / hits).otherwise(0.0).alias("context_precision"))


def costs(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Mean tokens and cost of a script, and cost of a valid patch; prices per token."""
    total = F.sum(F.col("tokens_in") * price_in + F.col("tokens_out") * price_out)
    valid = F.count_if("valid")
    return calls.agg(F.avg("tokens_in").alias("avg_in"), F.avg("tokens_out").alias("avg_out"), (total / F.count("*")).alias("cost_per_script"), F.when(valid > 0, total / valid).alias("cost_per_valid"))


def retry_benefit(success: DataFrame) -> DataFrame:
    """Gains over the first attempt, from cumulative success rates sr_at_1, sr_at_2, sr_at_3."""
    return success.select(F.col("sr_at_1").alias("fa_sr"), *[(F.col(f"sr_at_{k}") - F.col("sr_at_1")).alias(f"delta_r_at_{k}") for k in (2, 3)])


def pairwise_agreement(ratings: DataFrame) -> DataFrame:
    """Mean share of agreeing pairs of ratings per item, from (item, category, n)."""
    items = ratings.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("s"))
    return items.filter("m > 1").agg(F.avg(F.col("s") / (F.col("m") * (F.col("m") - 1))).alias("rpa"))


def backoff(attempts: DataFrame, base: float = 2.0, most: float = 300.0) -> DataFrame:
    """Whole seconds before each attempt, at least one: base times two to its number, capped; jitter comes from a hash of the row, in [0.75, 1.25)."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "call_id", "attempt")), 1, 6), 16, 10).cast("double") / float(1 << 24)
    delay = F.floor(F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.col("attempt"))) * (0.75 + drawn * 0.5))
    return attempts.withColumn("delay", F.greatest(F.lit(1), delay))


#: Names of weaknesses for explanations; a taxonomy's names come first.
CWE_NAMES = {
    "CWE-259": "Use of Hard-coded Password",
    "CWE-798": "Use of Hard-coded Credentials",
    "CWE-732": "Incorrect Permission Assignment for Critical Resource",
    "CWE-250": "Execution with Unnecessary Privileges",
    "CWE-295": "Improper Certificate Validation",
    "CWE-326": "Inadequate Encryption Strength",
    "CWE-312": "Cleartext Storage of Sensitive Information",
    "CWE-319": "Cleartext Transmission of Sensitive Information",
}


def cwe_names(taxonomy: DataFrame, order: str = "id") -> DataFrame:
    """(cwe, cwe_name): the name of the taxonomy's last entry for a weakness, else the fixed one."""
    fixed = taxonomy.sparkSession.createDataFrame(list(CWE_NAMES.items()), "cwe string, fixed string")
    told = taxonomy.filter((F.coalesce("cwe", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")).groupBy("cwe").agg(F.max_by("name", order).alias("told"))
    return fixed.join(told, "cwe", "full").select("cwe", F.coalesce("told", "fixed").alias("cwe_name"))


def with_cwe_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``cwe_name``, empty where a weakness has no name."""
    return lookup(rows, names, "cwe").withColumn("cwe_name", F.coalesce("cwe_name", F.lit("")))


#: The headings and sentences of an explanation.
TITLE, SUMMARY = "## Security Patch Explanation\n\n", "### Diff Summary\n- Lines added: "
ISSUE = "Security misconfiguration detected."
REMEDY = "The patch removes the insecure configuration and replaces it with a secure alternative."


def explanation(smells: Column, added: Column, removed: Column, names: Column | None = None) -> Column:
    """Markdown text over array<struct<type, line, cwe, description>> and the counts of a diff; ``names`` maps weaknesses to names."""
    fixed = F.create_map(*[F.lit(x) for pair in CWE_NAMES.items() for x in pair]) if names is None else names
    cwe = lambda s: F.coalesce(s["cwe"], F.lit(""))

    def one(s: Column) -> Column:
        reference = F.concat(F.lit("- **CWE Reference:** ["), cwe(s), F.lit("] "), F.coalesce(F.try_element_at(fixed, cwe(s)), F.lit("")), F.lit("\n"))
        return F.concat(
            F.lit("### "), F.initcap(F.replace(F.coalesce(s["type"], F.lit("unknown")), F.lit("_"), F.lit(" "))), F.lit("\n- **Location:** Line "), F.coalesce(s["line"].cast("string"), F.lit("?")), F.lit("\n"),
            F.when(cwe(s) != "", reference).otherwise(""),
            F.lit("- **Issue:** "), F.coalesce(s["description"], F.lit(ISSUE)), F.lit(f"\n- **Remediation:** {REMEDY}\n\n"),
        )

    net = added - removed
    return F.concat(F.lit(TITLE), F.array_join(F.transform(smells, one), ""), F.lit(SUMMARY), added.cast("string"), F.lit("\n- Lines removed: "), removed.cast("string"), F.lit("\n- Net change: "), F.format_string("%+d", net), F.lit(" lines"))


def scanner_counts(records: DataFrame, sides: tuple[str, ...] = ("validated_smells_before", "validated_smells_after")) -> DataFrame:
    """(scanner, n): findings by scanner over both sides."""
    both = F.concat(*[F.coalesce(F.transform(c, lambda f: f["scanner"]), F.array().cast("array<string>")) for c in sides])
    return records.select(F.explode(both).alias("scanner")).filter("scanner <> ''").groupBy("scanner").agg(F.count("*").alias("n"))


def validated_counts(records: DataFrame, fixed: Column) -> DataFrame:
    """Records with findings on either side, and records whose change removed a rule."""
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    return records.agg(F.count_if(some("validated_smells_before") | some("validated_smells_after")).alias("validated_records"), F.count_if(fixed > 0).alias("scanner_confirmed_fixes"))


def load_counts(loaded: DataFrame, kept: DataFrame, inputs: list[str]) -> DataFrame:
    """(input, n_loaded, missing, total_loaded, duplicates_removed) of each named input; ``loaded`` has ``input_file``. Inputs are a handful of paths."""
    named_by = F.coalesce(*[F.when(F.col("input_file").contains(f"/{p}/") | F.col("input_file").endswith(f"/{p}"), p) for p in inputs])
    counts = loaded.groupBy(named_by.alias("input")).agg(F.count("*").alias("n_loaded"))
    named = loaded.sparkSession.createDataFrame([(p,) for p in inputs], "input string")
    totals = counts.agg(F.coalesce(F.sum("n_loaded"), F.lit(0)).alias("total_loaded")).crossJoin(kept.agg(F.count("*").alias("kept")))
    rows = named.join(counts, "input", "left").crossJoin(F.broadcast(totals))
    return rows.select("input", F.coalesce("n_loaded", F.lit(0)).alias("n_loaded"), F.col("n_loaded").isNull().alias("missing"), "total_loaded", (F.col("total_loaded") - F.col("kept")).alias("duplicates_removed"))


def report_lines(metrics: DataFrame) -> DataFrame:
    """(at, line) of a table of (at, metric, layer, value) as text, values with four decimals: a few dozen rows."""
    return metrics.select("at", F.concat(F.rpad("metric", 20, " "), F.lit(" "), F.rpad("layer", 15, " "), F.lit(" "), F.lpad(F.format_string("%.4f", "value"), 10, " ")).alias("line"))
