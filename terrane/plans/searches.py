"""Query vocabularies for acquisition and the date windows they are cut into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import positions

#: The vocabulary of commit searches.
VERBS = ("fix", "patch", "resolve", "remediate", "harden", "secure", "correct")
TOOLS = ("terraform", "kubernetes", "helm", "dockerfile", "ansible", "pulumi", "cloudformation", "bicep")
ISSUES = (
    "hardcoded credentials", "hardcoded password", "hardcoded secret", "hardcoded api key", "hardcoded token", "exposed secret", "leaked credential",
    "open security group", "0.0.0.0/0", "public ingress", "unrestricted cidr", "public endpoint", "public access", "public bucket",
    "missing encryption", "disable encryption", "enable encryption", "unencrypted storage", "tls version", "insecure tls",
    "overly permissive iam", "iam wildcard", "least privilege", "overly permissive rbac", "wildcard action",
    "privileged container", "run as root", "runAsNonRoot", "security context", "privilege escalation", "root user", "read only root filesystem", "resource limits", "network policy",
    "s3 public", "s3 acl", "rds encryption", "rds public", "database encryption",
    "logging disabled", "cloudtrail", "enable logging", "audit logging",
    "USER root", "base image latest", "pin base image", "HEALTHCHECK",
    "security vulnerability", "security issue", "misconfiguration",
)
CWES = ("CWE-22", "CWE-78", "CWE-200", "CWE-250", "CWE-259", "CWE-276", "CWE-284", "CWE-295", "CWE-306", "CWE-311", "CWE-312", "CWE-319", "CWE-326", "CWE-327", "CWE-400", "CWE-521", "CWE-522", "CWE-611", "CWE-693", "CWE-732", "CWE-770", "CWE-778", "CWE-798", "CWE-862", "CWE-863", "CWE-915", "CWE-923", "CWE-1357")
SCANNERS = ("checkov", "tfsec", "kics", "terrascan", "snyk", "prowler", "trivy", "kube-linter", "kube-bench", "datree", "opa")
PREFIXES = ("CKV_AWS_", "CKV_K8S_", "CKV_DOCKER_", "AVD-AWS-", "AVD-KSV-", "AVD-DS-", "KICS-")


def commit_queries(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(ord, query): products of the vocabulary in order, distinct by first appearance. ``more`` (ord, word) adds words of one's own after it."""

    def words(name: str, values: tuple[str, ...]) -> DataFrame:
        return spark.createDataFrame(list(enumerate(values)), f"i_{name} long, {name} string").coalesce(1)

    verb, issue, tool, cwe, scanner, prefix = (words(n, v) for n, v in (("verb", VERBS), ("issue", ISSUES), ("tool", TOOLS), ("cwe", CWES), ("scanner", SCANNERS), ("prefix", PREFIXES)))
    core = verb.crossJoin(issue).crossJoin(tool).select((F.col("i_verb") * len(ISSUES) * len(TOOLS) + F.col("i_issue") * len(TOOLS) + F.col("i_tool")).alias("ord"), F.concat_ws(" ", "verb", "issue", "tool").alias("query"))
    by_cwe = cwe.crossJoin(tool).select((F.col("i_cwe") * len(TOOLS) + F.col("i_tool") + 1_000_000).alias("ord"), F.concat_ws(" fix ", "cwe", "tool").alias("query"))
    forms = F.posexplode(F.array(F.concat(F.lit("fix "), "scanner"), F.concat("scanner", F.lit(" failed fix")), F.concat("scanner", F.lit(" finding fix"))))
    by_scanner = scanner.select("i_scanner", forms.alias("p", "query")).select((F.col("i_scanner") * 3 + F.col("p") + 2_000_000).alias("ord"), "query")
    by_prefix = prefix.select((F.col("i_prefix") + 3_000_000).alias("ord"), F.concat("prefix", F.lit(" fix")).alias("query"))
    every = core.union(by_cwe).union(by_scanner).union(by_prefix)
    if more is not None:
        every = every.union(more.select((F.col("ord") + 4_000_000).alias("ord"), F.concat("word", F.lit(" fix")).alias("query")))
    return every.groupBy("query").agg(F.min("ord").alias("ord"))


def date_windows(spark: SparkSession, first: str, last: str, days: int = 14) -> DataFrame:
    """(start, stop) windows going back from the last day; the earliest start is clamped."""
    stops = spark.range(1).select(F.explode(F.expr(f"sequence(date'{last}', date'{first}', interval -{days} days)")).alias("stop"))
    return stops.select(F.greatest(F.lit(first).cast("date"), F.date_sub("stop", days - 1)).alias("start"), "stop")


def work_units(queries: DataFrame, windows: DataFrame, done: DataFrame) -> DataFrame:
    """(query, start, stop) still to do; ``done`` holds finished ones."""
    return queries.crossJoin(F.broadcast(windows)).join(done, ["query", "start", "stop"], "left_anti")


def merge_progress(old: DataFrame, new: DataFrame) -> DataFrame:
    """Progress marks (unit, last_page, done): pages only grow, done stays done."""
    return old.unionByName(new).groupBy("unit").agg(F.max("last_page").alias("last_page"), F.max("done").alias("done"))


def product(*words: DataFrame) -> DataFrame:
    """(query): the distinct combinations of vocabularies of one column each, space-joined. Vocabularies are some dozens of words."""
    rows = words[0]
    for other in words[1:]:
        rows = rows.crossJoin(F.broadcast(other))
    return rows.select(F.concat_ws(" ", *[w.columns[0] for w in words]).alias("query")).distinct()


def halves(rows: DataFrame, order: str, folder: str) -> DataFrame:
    """Shares for two accounts: ``half`` (1, the longer, or 2) and ``odd`` (1, 0, ... in turn) by the order."""
    placed = positions(rows, [F.col(order)], folder)
    total = F.broadcast(placed.agg(F.count("*").alias("_n")))  # one row
    half = F.when(2 * F.col("position") < F.col("_n"), 1).otherwise(2)
    return placed.crossJoin(total).select(*rows.columns, half.alias("half"), ((F.col("position") + 1) % 2).cast("int").alias("odd"))
