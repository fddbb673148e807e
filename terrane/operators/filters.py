"""Row predicates of acquisition, each a plain Column so that Catalyst can push it down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MESSAGE_KEYWORDS, SIGNAL_KEYWORDS, base_name, contains_any
from ..functions.tools import is_config_path
from .pairing import first_by

#: Fixed values.
MAX_FILE = 200_000
GONE = ("removed", "deleted")
BAD_WORDS = ("bad", "fail", "insecure", "wrong", "deny", "vuln")
CODE_WORDS = ("terraform", "ansible", "kubernetes", "helm", "dockerfile", "cloudformation", "pulumi", "chef", "puppet", "vagrant")
GOOD_WORDS = ("good", "pass", "secure", "allow", "compliant")


def alive(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("")).isin(*GONE)


def fits(content: Column, most: int = MAX_FILE) -> Column:
    return F.length(content) <= most


def has_sides(before: Column, patch: Column, tool: Column) -> Column:
    """Something to compare, of a known kind."""
    return ((F.coalesce(before, F.lit("")) != "") | (F.coalesce(patch, F.lit("")) != "")) & (tool != "unknown")


def has_signal(n_smells: Column, message: Column) -> Column:
    return (n_smells > 0) | contains_any(F.lower(F.coalesce(message, F.lit(""))), SIGNAL_KEYWORDS)


def message_signal(message: Column) -> Column:
    return contains_any(F.lower(F.coalesce(message, F.lit(""))), MESSAGE_KEYWORDS)


def example_side(path: Column, n_smells: Column) -> Column:
    """positive or negative by a folder or a name that starts so, else by smells."""
    low = F.lower(path)
    told = lambda word: low.contains(f"/{word}") | base_name(low).startswith(word)
    return F.when(told("positive"), "positive").when(told("negative"), "negative").when(n_smells > 0, "positive").otherwise("negative")


def good_or_bad(examples: DataFrame) -> DataFrame:
    """Examples (path, content, n_smells) with smells or a bad path; the before side is kept for those, the after side for good paths."""
    low = F.lower("path")
    bad, good = contains_any(low, BAD_WORDS), contains_any(low, GOOD_WORDS)
    rows = examples.withColumns({"code_before": F.when((F.col("n_smells") > 0) | bad, F.col("content")).otherwise(""), "code_after": F.when(good, F.col("content"))})
    return rows.filter(((F.col("n_smells") > 0) | bad) & (F.col("code_before") != ""))


def tree_files(tree: DataFrame, max_files: int | None = None, within: str = "") -> DataFrame:
    """Blobs of a repository tree with a known suffix, of bounded size, once per path."""
    rows = tree.filter((F.col("type") == "blob") & is_config_path(F.col("path")) & (F.coalesce("size", F.lit(0)) <= MAX_FILE) & F.col("path").contains(within)).dropDuplicates(["path"])
    return rows.limit(max_files) if max_files else rows


def describes_code(description: Column) -> Column:
    """Whether a description speaks of configuration code: a column, never a filter."""
    return contains_any(F.lower(description), CODE_WORDS)


def ordered_unique(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return first_by(rows, [key], [F.col(order)]).orderBy(order)


def version_pairs(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Each changed file with its text at the commit and at the parent commit."""
    at = lambda name: versions.select("repo", "path", F.col("ref").alias(name), F.col("content").alias(f"{name}_content"))
    after = files.join(at("commit_sha"), ["repo", "path", "commit_sha"], "left")
    return after.join(at("parent_sha"), ["repo", "path", "parent_sha"], "left").withColumnsRenamed({"commit_sha_content": "code_after", "parent_sha_content": "code_before"})


def group_key(path: Column, parts: int = 5) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, parts), "/")
