"""Readers: record files with dirty lines, nested documents, scanner output, event dumps, CVE feeds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import describes_code
from ..operators.pairing import first_by
from . import schemas

CORRUPT = "_corrupt_record"
#: Repositories that an event dump is searched for.
REPO_HINT = r"(?i)(terraform|tf-|\bk8s\b|kube|kubernetes|helm|kustomize|docker|dockerfile|ansible|pulumi|cloudformation|\bcfn\b|bicep|\biac\b|infra|infrastructure|devops|platform|aws[-_]|azure[-_]|gcp[-_]|cloud)"
SECURITY_MESSAGE = (
    r"(?i)\b(fix(?:es|ed|ing)?|patch(?:es|ed|ing)?|resolv\w*|remediat\w*|harden\w*|secur\w*|mitigat\w*|disable|enable|remove)\b.{0,120}?"
    r"(cve|cwe|vulnerab|security|secret|password|credential|token|api[- ]?key|tls|ssl|encrypt|iam|rbac|privileg|public[- ]?access|exposed|leak|checkov|tfsec|kics|terrascan|snyk|trivy|prowler|s3\s*bucket|open\s*port|0\.0\.0\.0|cidr|hardcod)"
)
COMMIT_URL = r"(?i)^https?://github\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)/commit/([0-9a-f]{7,40})"


def _complete(line: Column) -> Column:
    """The line is an object with all required fields and no unknown one; the same holds for each of its smells."""
    keys, names = F.json_object_keys(line), lambda names: F.array(*[F.lit(n) for n in names])
    within = lambda keys, known, needed: (F.size(F.array_except(keys, names(known))) == 0) & (F.size(F.array_except(names(needed), keys)) == 0)
    smells = F.from_json(F.coalesce(F.get_json_object(line, "$.smells"), F.lit("[]")), "array<map<string,string>>")
    known = [f.name for f in schemas.SMELL.fields]
    return F.coalesce(within(keys, schemas.RECORD.names, schemas.REQUIRED) & F.forall(smells, lambda x: within(F.map_keys(x), known, ["type"])), F.lit(False))


def _matches(spark: SparkSession, path: str) -> list[str]:
    """What a path or pattern names, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(x.getPath().toUri().toString() for x in found or ())


def load_order(inputs: list[str]) -> Column:
    """struct<input, file, block, place>: compares like the order in which lines would be loaded one input after another.

    Spark packs splits by size, so ids by task don't follow it; the rank of the input, the file's path, where its block begins and the place in the block do.
    """
    file = F.col("_metadata.file_path")
    bare = F.regexp_replace(file, "^[a-z]+:/+", "/")
    rank = F.coalesce(*[F.when((bare == one) | bare.startswith(f"{one}/"), i) for i, one in enumerate(re.sub("^[a-z]+:/+(?=[^/])", "/", x) for x in inputs)], F.lit(len(inputs)))
    return F.struct(rank.alias("input"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


ORDER = "struct<input: int, file: string, block: bigint, place: bigint>"


def read_records(spark: SparkSession, paths: str | list[str], strict: bool = True, fail_fast: bool = False) -> DataFrame:
    """Records from JSON lines. Blank and unreadable lines go; strict also drops rows that lack a required key or have an unknown one.

    Missing paths are empty. ``ord`` compares in load order: inputs in the order given (those of a pattern by name), then files, then lines.
    """
    found = [x for p in ([paths] if isinstance(paths, str) else paths) for x in _matches(spark, p)]
    if not found:
        return spark.createDataFrame([], T.StructType([*schemas.RECORD.fields, T.StructField("input_file", T.StringType())])).withColumn("ord", F.lit(None).cast(ORDER))
    if fail_fast:
        rows = spark.read.schema(schemas.RECORD).option("mode", "FAILFAST").json(found)
        return rows.withColumns({"input_file": F.col("_metadata.file_path"), "ord": load_order(found)})
    lines = spark.read.text(found).select("value", F.col("_metadata.file_path").alias("input_file"), load_order(found).alias("ord"))
    kept = _complete(F.col("value")) if strict else F.json_object_keys("value").isNotNull()
    return lines.filter(kept).select(F.from_json("value", schemas.RECORD).alias("r"), "input_file", "ord").select("r.*", "input_file", "ord")


def read_event_dump(spark: SparkSession, path: str) -> DataFrame:
    """Push events of hourly dumps; gzipped files are read one by one, each by one task."""
    return spark.read.schema(schemas.PUSH).json(path)


def read_recorded(spark: SparkSession, path: str, item: T.DataType) -> DataFrame:
    """(unit, page, items.*) of recorded API pages {unit, page, items}: each page is one file of any store that Spark reads."""
    pages = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.struct(unit=T.StringType(), page=T.IntegerType(), items=T.ArrayType(item))).alias("p"))
    return pages.select("p.unit", "p.page", F.explode("p.items").alias("i")).select("unit", "page", "i.*")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SEED).json(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth: one row per labelled smell."""
    files = spark.read.schema(schemas.TRUTH).option("multiLine", True).json(path).select(F.explode("files").alias("f"))
    return files.select(F.col("f.id").alias("file_id"), F.col("f.file").alias("file"), F.col("f.iac_tool").alias("iac_tool"), F.explode("f.smells").alias("s")).select("file_id", "file", "iac_tool", "s.*")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, content): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy entries and the text that stands for each in a knowledge base."""
    rows = spark.read.schema(schemas.TAXONOMY).option("multiLine", True).json(path)
    text = F.concat_ws("\n", F.concat(F.lit("Smell: "), "name"), F.concat(F.lit("Category: "), "category"), F.concat(F.lit("Description: "), "description"), F.concat(F.lit("CWE: "), "cwe"), F.concat(F.lit("IaC tools: "), F.array_join("iac_tools", ",")), F.concat(F.lit("Fix example: "), "fix_example"))
    return rows.withColumns({"text": text, "tools_csv": F.array_join("iac_tools", ",")})


def scanner_checks(output: Column) -> Column:
    """Failed checks of one scanner output: an object, a list of objects, or objects one after another.

    Only what can't be read as it is counts as objects one after another, so braces inside strings stay.
    """
    text = F.trim(output)
    runs = lambda raw: F.from_json(raw, T.ArrayType(schemas.SCAN), {"mode": "PERMISSIVE"})
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    whole = F.when(F.json_array_length(listed).isNotNull(), listed).otherwise(F.regexp_replace(listed, r"\}\s*\{", "},{"))
    failed = F.transform(runs(whole), lambda r: F.coalesce(r["results"]["failed_checks"], F.array().cast(T.ArrayType(schemas.CHECK))))
    return F.coalesce(F.flatten(failed), F.array().cast(T.ArrayType(schemas.CHECK)))


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _finding(scanner: str, rule: Column, severity: Column, cwe: Column, line: Column, message: Column) -> Column:
    """A finding: upper-case severity, null for empty fields, message of at most 200 characters."""
    none = F.lit("")
    return F.struct(
        F.lit(scanner).alias("scanner"),
        F.coalesce(rule, none).alias("rule_id"),
        _blank(F.upper(F.coalesce(severity, none))).alias("severity"),
        _blank(F.coalesce(cwe, none)).alias("cwe"),
        line.cast("int").alias("line"),
        F.left(F.coalesce(message, none), F.lit(200)).alias("message"),
    )


def checks_to_findings(check: Column, scanner: str) -> Column:
    """A failed check as a finding: the first line of its range, the weakness its guideline names."""
    cwe = F.regexp_extract(F.coalesce(check["guideline"], F.lit("")), r"CWE-\d+", 0)
    return _finding(scanner, check["check_id"], check["severity"], cwe, F.get(check["file_line_range"], F.lit(0)), check["check_name"])


def tfsec_findings(output: Column) -> Column:
    """array<finding> of a tfsec report; an unreadable or empty one has none."""
    rows = F.from_json(output, schemas.TFSEC)["results"]
    one = lambda r: _finding("tfsec", F.coalesce(_blank(r["rule_id"]), r["long_id"]), r["severity"], F.lit(None).cast("string"), r["location"]["start_line"], r["description"])
    return F.coalesce(F.transform(rows, one), F.array())


def kics_findings(output: Column) -> Column:
    """array<finding> of a KICS report: one for each file of each query."""
    queries = F.filter(F.from_json(output, schemas.KICS)["queries"], lambda q: F.size(q["files"]) > 0)
    each = lambda q: F.transform(q["files"], lambda f: _finding("kics", F.coalesce(_blank(q["query_id"]), q["query_name"]), q["severity"], q["cwe"], f["line"], q["query_name"]))
    return F.coalesce(F.flatten(F.transform(queries, each)), F.array())


def checkov_findings(output: Column) -> Column:
    return F.transform(scanner_checks(output), lambda c: checks_to_findings(c, "checkov"))


def push_candidates(events: DataFrame, limit: int | None = 20_000) -> DataFrame:
    """(repo, sha) of pushes to hinted repositories: the head and all other commits, once each."""
    rows = events.filter((F.col("type") == "PushEvent") & F.col("repo.name").contains("/") & F.col("repo.name").rlike(REPO_HINT) & (F.coalesce("payload.head", F.lit("")) != ""))
    shas = F.array_distinct(F.concat(F.array("payload.head"), F.coalesce(F.transform("payload.commits", lambda c: c["sha"]), F.array().cast("array<string>"))))
    found = rows.select(F.col("repo.name").alias("repo"), F.explode(shas).alias("sha")).filter("sha is not null").dropDuplicates(["repo", "sha"])
    return found.limit(limit) if limit else found


def first_cves(feed: DataFrame, order: str) -> DataFrame:
    """The first row of each id in feed order; rows without an id go."""
    return first_by(feed.filter(F.coalesce("cve.id", F.lit("")) != ""), ["cve.id"], [F.col(order)])


def cve_seeds(feed: DataFrame, order: str = "ord") -> DataFrame:
    """(cve_id, owner, repo, commit_sha, description, describes_code): commit links of each CVE, once per commit, the first in feed order."""
    text = F.coalesce(F.get(F.filter("cve.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"], F.lit(""))
    rows = first_cves(feed, order).select(order, F.col("cve.id").alias("cve_id"), text.alias("text"), F.posexplode("cve.references").alias("at", "r"))
    part = lambda i: F.regexp_extract("r.url", COMMIT_URL, i)
    rows = rows.filter(F.col("r.url").rlike(COMMIT_URL)).select(order, "at", "cve_id", part(1).alias("owner"), F.regexp_replace(part(2), r"\.git$", "").alias("repo"), part(3).alias("commit_sha"), F.left("text", F.lit(500)).alias("description"), describes_code(F.col("text")).alias("describes_code"))
    lowered = rows.withColumns({f"_{c}": F.lower(c) for c in ("owner", "repo", "commit_sha")})
    return first_by(lowered, ["_owner", "_repo", "_commit_sha"], [F.col(order), F.col("at")]).drop(order, "at", "_owner", "_repo", "_commit_sha")
