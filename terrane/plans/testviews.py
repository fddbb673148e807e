"""Record-shaped views over the driver's tables, so that every operator runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairing import small

IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per document: language stands for the tool, labels for scanner findings."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = d.join(small(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")), "doc_id", "left")
    toxic, m = F.coalesce("toxic", F.lit(0)) == 1, F.col("doc_id") % 5
    none = F.array().cast("array<string>")
    text = F.col("text")
    types = F.filter(F.array(F.when(text.contains("@"), "email"), F.when(text.contains("icensed"), "license"), F.when(text.rlike(IPV4), "ipv4")), lambda x: x.isNotNull())
    return rows.select(
        F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("ord"),
        "source",
        (F.col("doc_id") % 3).cast("int").alias("input_rank"),
        F.when(F.col("lang") == "en", "terraform").when(F.col("lang") == "fr", "kubernetes").when(F.col("lang") == "de", "ansible").otherwise("docker").alias("iac_tool"),
        text.alias("code_before"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.lit("\nfixed"))).when(F.col("doc_id") % 4 == 1, text).alias("code_after"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("@@ -0,0 +1,2 @@")).alias("diff"),
        F.sha2(text, 256).alias("content_hash"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("has_fix"),
        F.when(toxic, F.array(F.lit("R1"))).otherwise(none).alias("rules_before"),
        F.when(toxic & (F.col("doc_id") % 2 == 0), F.array(F.lit("R1"))).otherwise(none).alias("rules_after"),
        F.when(m == 0, "api").when(m == 1, "exact").when(m == 2, "partial").when(m == 3, "unavailable").alias("code_before_quality"),
        F.split(text, "\n")[0].alias("commit_message"),
        types.alias("smell_types"),
        F.size(types).alias("n_smells"),
        F.lit("").alias("repo"),
        F.lit("").alias("commit_sha"),
        F.lit("").alias("file_path"),
    )


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with names made from their ids: repository, commit and parent, as the views below have them."""
    n = F.col("doc_id")
    kind = F.when(n % 3 == 0, "terraform-").when(n % 3 == 1, "blog-").otherwise("k8s-")
    sha = lambda mark: F.substring(F.sha2(F.concat(F.lit(mark), n.cast("string")), 256), 1, 40)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rows.withColumns({"repo": F.concat(F.lit("org/"), kind, (n % 10).cast("string")), "sha": sha("c"), "parent": sha("p"), "fixed": F.concat("text", F.lit("\nfixed"))})


def _cases(*values: Column) -> Column:
    """The value for doc_id modulo their number."""
    n = F.col("doc_id") % len(values)
    out = F.when(n == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(n == i, v)
    return out


def _named(before: str, after: str) -> Column:
    return F.concat(F.lit(before), F.col("doc_id").cast("string"), F.lit(after))


def paths() -> Column:
    return _cases(_named("modules/pass/m", ".tf"), _named("modules/fail/m", ".tf"), _named("images/", "/Dockerfile"), _named("docs/readme", ".md"), _named("k8s/app", ".yml"), _named("group/roles/r", ".yaml"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document: (doc_id, ord, path, content, status)."""
    return keyed(spark, sf_dir).select("doc_id", F.col("doc_id").alias("ord"), paths().alias("path"), F.col("text").alias("content"), _cases(*[F.lit(s) for s in ("added", "removed", "modified", "modified", "deleted")]).alias("status"))


#: Patch of every other document: no hunk, so undoing it takes lines by their signs.
PATCH = '-password = "hunter2secret"\n+fixed'


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit with one file per document."""
    k = keyed(spark, sf_dir)
    message = F.split("text", "\n")[0]
    file = F.struct(paths().alias("filename"), _cases(*[F.lit(s) for s in ("added", "removed", "modified", "modified", "renamed")]).alias("status"), F.when(F.col("doc_id") % 2 == 0, PATCH).alias("patch"), F.lit("raw").alias("raw_url"))
    author = F.struct(F.col("lang").alias("name"), F.lit("2024-01-01T00:00:00Z").alias("date"))
    return k.select("doc_id", "repo", "sha", F.array(F.struct(F.col("parent").alias("sha"))).alias("parents"), F.struct(message.alias("message"), author.alias("author")).alias("commit"), F.array(file).alias("files"))


def contents(spark: SparkSession, sf_dir: str, repo: str = "repo") -> DataFrame:
    """(repo, path, ref, content): every file at its commit, every third at the parent too."""
    k = keyed(spark, sf_dir).withColumn("group", F.concat(F.lit("group/p"), (F.col("doc_id") % 7).cast("string")))
    at = lambda ref, content: k.select(F.col(repo).alias("repo"), paths().alias("path"), F.col(ref).alias("ref"), F.col(content).alias("content"), "doc_id")
    return at("sha", "fixed").union(at("parent", "text").filter("doc_id % 3 = 0")).drop("doc_id")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).groupBy("repo").agg(F.count("*").cast("int").alias("repo_stars"), F.min("lang").alias("repo_description"))


def code_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = F.when(F.col("doc_id") % 2 == 0, "main")
    about = F.struct(F.col("repo").alias("full_name"), branch.alias("default_branch"), (F.col("doc_id") % 100).cast("int").alias("stargazers_count"), F.col("lang").alias("description"))
    return keyed(spark, sf_dir).select(paths().alias("path"), about.alias("repository"))


def project_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    said = _cases(F.lit("fix tls"), F.lit("Rotate credential"), F.lit("tidy up"), F.lit("harden"))
    patch = F.when(n % 2 == 0, PATCH)
    change = F.struct(paths().alias("new_path"), F.when(n % 2 == 0, paths()).alias("old_path"), (n % 5 == 1).alias("deleted_file"), (n % 5 == 0).alias("new_file"), patch.alias("diff"))
    return keyed(spark, sf_dir).select(F.col("sha").alias("id"), (n % 7).alias("project_id"), F.array("parent").alias("parent_ids"), F.when(n % 3 > 0, said).otherwise("").alias("message"), said.alias("title"), F.col("lang").alias("author_name"), F.lit("2024-01-01").alias("committed_date"), F.array(change).alias("diffs"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(7).select("id", F.concat(F.lit("group/p"), F.col("id").cast("string")).alias("path_with_namespace"), F.col("id").cast("int").alias("star_count"), F.lit("d").alias("description"))


def cve_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed in which ids repeat; every other entry links to a commit of the view above."""
    n = F.col("doc_id")
    url = F.when(n % 2 == 0, F.concat(F.lit("https://github.com/"), "repo", F.lit(".git/commit/"), "sha")).otherwise("http://example.org/x")
    said = F.array(F.struct(F.lit("fr").alias("lang"), F.lit("x").alias("value")), F.struct(F.lit("en").alias("lang"), F.concat(F.when(n % 4 == 0, "Helm ").otherwise(""), "text").alias("value")))
    return keyed(spark, sf_dir).select(n.alias("ord"), F.struct(F.concat(F.lit("CVE-2024-"), (n % 500).cast("string")).alias("id"), said.alias("descriptions"), F.array(F.struct(url.alias("url"))).alias("references")).alias("cve"))


def pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 3, "WatchEvent").otherwise("PushEvent")
    shas = F.array(F.struct("sha"), F.struct(F.col("parent").alias("sha")))
    return keyed(spark, sf_dir).select(kind.alias("type"), F.struct(F.col("repo").alias("name")).alias("repo"), F.struct(F.col("sha").alias("head"), shas.alias("commits")).alias("payload"))


def examples(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(ord, path, content) of an example collection."""
    folder = F.concat(F.lit({"check": "tests/g", "query": "assets/queries/t/c/q", "scanner": "examples/"}[kind]), (F.col("doc_id") % 41).cast("string"))
    names = {
        "check": ("/pass_x", ".tf", "/fail_x", ".tf", "/main", ".tf", "/app", ".yml"),
        "query": ("/test/positive", ".tf", "/test/negative", ".tf", "/x", ".yaml", "/x", ".rego"),
        "scanner": ("/bad/m", ".tf", "/good/m", ".tf", "/insecure/m", ".tf", "/plain/m", ".yaml"),
    }[kind]
    path = _cases(*[F.concat(folder, _named(names[i], names[i + 1])) for i in range(0, 8, 2)])
    return keyed(spark, sf_dir).select(F.col("doc_id").alias("ord"), path.alias("path"), F.col("text").alias("content"))


def record_lines(spark: SparkSession, sf_dir: str, kinds: int = 8) -> DataFrame:
    """(doc_id, value): records as JSON lines; of eight, four are whole, then one with an unknown key, one without a key, one torn, one blank."""
    d = table(spark, sf_dir, "documents")
    smell = F.array(F.struct(F.lit("weak_hash").alias("type"), F.lit(3).alias("line_number")))
    none = F.lit(None).cast("string")
    fields = [F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("id"), "source", F.lit("docker").alias("iac_tool"), F.lit("p").alias("file_path"), F.col("text").alias("code_before"), none.alias("code_after"), none.alias("diff")]
    line = lambda *more: F.to_json(F.struct(*fields, *more), {"ignoreNullFields": "false"})
    fix = F.lit(False).alias("has_fix")
    whole = line(fix, smell.alias("smells"))
    n = F.col("doc_id") % kinds
    value = F.when(n < 4, whole).when(n == 4, line(fix, F.lit(1).alias("unknown_key"))).when(n == 5, line()).when(n == 6, F.lit("{bad")).otherwise("")
    return d.select("doc_id", value.alias("value"))
