"""End-to-end plans: merge, salvage, release, training."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.patches import reverse_patch
from ..functions.text import PLACEHOLDER, content_hash, diff_side, strip
from ..sources.sinks import write_counted
from ..operators.records import assign_splits, dedup_best, normalise, once, primary_key, release_best, tier


def merge(inputs: list[DataFrame], seed: int = 42) -> DataFrame:
    """Union, hash, deduplicate, split: two shuffles, one by hash and one by tool."""
    rows = inputs[0]
    for other in inputs[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    hashed = rows.withColumn("content_hash", F.coalesce(F.nullif("content_hash", F.lit("")), content_hash(F.col("code_before"))))
    return assign_splits(dedup_best(hashed), ["iac_tool"], seed)


def merge_counted(inputs: list[DataFrame], path: str, seed: int = 42) -> DataFrame:
    """Merges into ``path``; (total, with_fix, without_fix, duplicates_removed, train, val, test), counted while the merged rows are written."""
    loaded = sum(rows.count() for rows in inputs)  # of whole inputs: read from file footers, no column is scanned
    fix = F.coalesce("has_fix", F.lit(False))
    splits = {s: F.count_if(F.col("split") == s) for s in ("train", "val", "test")}
    counted = write_counted(merge(inputs, seed), path, total=F.count(F.lit(1)), with_fix=F.count_if(fix), without_fix=F.count_if(~fix), **splits)
    return counted.withColumn("duplicates_removed", F.lit(loaded) - F.col("total"))


def smell_types(text: Column) -> Column:
    return F.transform(rules.annotations(text, F.lower(text)), lambda s: s["type"])


def salvage(records: DataFrame) -> DataFrame:
    """Recovers missing before sides from diffs, re-classifies, appends only types that a record lacks, and tiers anew."""
    code, after, diff = (F.coalesce(c, F.lit("")) for c in ("code_before", "code_after", "diff"))
    missing = code.contains(PLACEHOLDER) & (diff != "") & (after != "")
    new_file = missing & diff.contains("@@ -0,0")
    undone = reverse_patch(F.when(missing & ~new_file, after), F.when(missing & ~new_file, diff))
    rows = records.withColumns({"_missing": missing, "_new": new_file, "_undone": undone})
    got = F.col("_missing") & ~F.col("_new") & (strip(F.col("_undone.text")) != "")
    quality = F.when(F.col("_new"), "new_file").when(got, F.col("_undone.quality")).when(F.col("_missing"), "unavailable").otherwise(F.coalesce("code_before_quality", F.lit("api")))
    rows = rows.withColumns({"code_before_quality": quality, "code_before": F.when(F.col("_new"), "").when(got, F.col("_undone.text")).otherwise(F.col("code_before")), "has_fix": F.when(F.col("_new"), False).otherwise(F.col("has_fix"))}).drop("_missing", "_new", "_undone")
    is_new = (F.col("code_before_quality") == "new_file") & (after != "")
    rows = once(rows, _first=smell_types(F.when(is_new, after).when(diff != "", diff_side(diff, "-")).otherwise("")))
    rows = once(rows, _fresh=F.when(is_new | (F.size("_first") > 0), F.col("_first")).otherwise(smell_types(F.coalesce("code_before", F.lit("")))))
    known = F.coalesce("smell_types", F.array().cast("array<string>"))
    rows = rows.withColumn("_known", known).withColumn("smell_types", F.concat("_known", F.array_except(F.array_distinct("_fresh"), F.col("_known"))))
    return rows.withColumns({"smells_added": F.size("smell_types") - F.size("_known"), "n_smells": F.size("smell_types"), "source_version": F.lit("v1_salvaged")}).drop("_known", "_first", "_fresh").withColumn("tier", tier())


def release(inputs: DataFrame, strata: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Normalise, keep the best row per key, split. ``inputs`` has input_rank and ord."""
    best = release_best(normalise(inputs), primary_key())
    return assign_splits(best, strata or ["iac_tool"], seed)


def manifest(records: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, key, n) of all dimensions in one pass of grouping sets; empty keys are "<missing>"."""
    named = records.select(*[F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit("<missing>")).alias(d) for d in dimensions])
    grouped = named.groupingSets([[d] for d in dimensions], *dimensions).agg(F.count("*").alias("n"))
    which = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dimensions])
    return grouped.select(which.alias("dimension"), F.coalesce(*dimensions).alias("key"), "n")


def usable(max_chars: int = 8000, gold_only: bool = False) -> Column:
    """A training pair: a fix, both sides with content, not too long, not a no-op."""
    before, after = F.coalesce("code_before", F.lit("")), F.coalesce("code_after", F.lit(""))
    kept = F.col("has_fix") & (strip(before) != "") & (strip(after) != "") & (F.length(before) + F.length(after) <= max_chars) & (strip(before) != strip(after))
    return kept & (F.size(F.coalesce("rules_before", F.array().cast("array<string>"))) > 0) if gold_only else kept


def training_samples(records: DataFrame, **options) -> DataFrame:
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
    return records.filter(usable(**options)).select("id", "iac_tool", clean("smell_types").alias("smell_types"), clean("cwes").alias("cwes"), "code_before", "code_after", "split")


def training_stats(records: DataFrame, **options) -> DataFrame:
    """(iac_tool, kept, kept_pct): usable records by tool, in per cent of all records; one pass."""
    by_tool = records.groupBy("iac_tool").agg(F.count_if(usable(**options)).alias("kept"), F.count("*").alias("_n"))
    total = F.broadcast(by_tool.agg(F.greatest(F.sum("_n"), F.lit(1)).alias("_all")))  # one row
    return by_tool.filter("kept > 0").crossJoin(total).select("iac_tool", "kept", (F.lit(100.0) * F.col("kept") / F.col("_all")).alias("kept_pct"))


#: Texts of instructions, prompts and retrieval queries.
INSTRUCTION = """You are a security expert specializing in Infrastructure as Code (IaC).
Fix the following {iac_tool} script. Detected smells: {smells}.
Return ONLY the corrected script, no explanation."""
FIX_PROMPT = """
## IaC Tool
{iac_tool}

## Detected Security Smells
{smells}

## Relevant Security Knowledge
{rag_context}

## Original Script
```
{script_content}
```

Generate a unified diff patch that fixes ALL listed smells. Output the diff only.
"""
ASK, TAIL = ("IaC tool: ", ". Security issues: "), ". How to fix?"
RETRIES = (" Focus on minimal, targeted changes only.", " Provide the most conservative and safe remediation possible.")


def _fill(template: str, **values: Column) -> Column:
    """The template with its named places filled; nothing inside a value is a place."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def chat_messages(tool: Column, types: Column, before: Column, after: Column) -> Column:
    """array<struct<role, content>>: the instruction with the insecure text, and the answer."""
    names = F.coalesce(F.nullif(F.array_join(types, ", "), F.lit("")), F.lit("security issues"))
    ask = F.concat(_fill(INSTRUCTION, iac_tool=F.coalesce(tool, F.lit("IaC")), smells=names), F.lit("\n\n```\n"), before, F.lit("\n```"))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", ask), turn("assistant", after))


def render_prompt(tool: Column, smells: Column, context: Column, code: Column) -> Column:
    """The prompt of a fix over array<struct<type, line, description, cwe>>."""
    one = lambda s: F.concat(F.lit("- Line "), F.coalesce(s["line"].cast("string"), F.lit("?")), F.lit(": "), F.coalesce(s["description"], s["type"], F.lit("")), F.lit(" ["), F.coalesce(s["cwe"], F.lit("")), F.lit("]"))
    return _fill(FIX_PROMPT, iac_tool=tool, smells=F.array_join(F.transform(smells, one), "\n"), rag_context=context, script_content=code)


def retrieval_query(tool: Column, descriptions: Column, retry: Column) -> Column:
    base = F.concat(F.lit(ASK[0]), tool, F.lit(ASK[1]), F.array_join(descriptions, "; "), F.lit(TAIL))
    return F.when(retry == 1, F.concat(base, F.lit(RETRIES[0]))).when(retry >= 2, F.concat(base, F.lit(RETRIES[1]))).otherwise(base)
