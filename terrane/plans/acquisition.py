"""From recorded answers of hosting services, example collections and feeds to records. Fetching stays outside; texts come in as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import smells as smells_of
from ..functions.patches import reverse_patch
from ..functions.text import PLACEHOLDER, base_name, diff_side, record_id
from ..functions.tools import detect_tool, is_config_path
from ..operators import filters, pairing
from ..operators.records import once, tier
from ..sources import readers

MESSAGE_CHARS = 500


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def diff_smells(diff: Column) -> Column:
    """struct<before, after>: smells of the removed and of the added lines."""
    return F.struct(smells_of(diff_side(diff, "-")).alias("before"), smells_of(diff_side(diff, "+")).alias("after"))


def _at(rows: DataFrame, contents: DataFrame, name: str, path: str, ref: str) -> DataFrame:
    """Adds the text of (repo, path) at a ref, null if there is none or it is too long."""
    side = contents.filter(filters.fits(F.col("content"))).select(F.col("repo").alias("_repo"), F.col("path").alias("_path"), F.col("ref").alias("_ref"), F.col("content").alias(name))
    same = (F.col("repo") == F.col("_repo")) & (F.col(path) == F.col("_path")) & (F.col(ref) == F.col("_ref"))
    return rows.join(side, same, "left").drop("_repo", "_path", "_ref")


def _tool(path: str, *contents: str) -> Column:
    """Kind by the first of the contents that tells it."""
    return F.coalesce(*[F.nullif(detect_tool(F.col(path), F.col(c)), F.lit("unknown")) for c in contents], F.lit("unknown"))


def with_repositories(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Stars and description of each record's repository: a left lookup with one row per repository."""
    return pairing.lookup(rows, repos.select("repo", "repo_stars", "repo_description"), "repo")


def commit_records(commits: DataFrame, contents: DataFrame, repos: DataFrame) -> DataFrame:
    """One record per changed configuration file of each commit.

    The before side is the text at the parent; failing that, the patch is undone on the after side; failing that, a placeholder with the patch
    stands for it. Kept are files of a known kind with a smell or a telling message.
    """
    author = F.col("commit.author")
    files = commits.select("repo", "sha", F.get("parents", F.lit(0))["sha"].alias("parent_sha"), F.col("commit.message").alias("message"), author["date"].alias("commit_date"), author["name"].alias("commit_author"), F.explode("files").alias("f"))
    rows = files.select("*", F.col("f.filename").alias("path"), F.coalesce("f.status", F.lit("")).alias("status"), F.coalesce("f.patch", F.lit("")).alias("patch"))
    rows = rows.filter(is_config_path(F.col("path")) & (F.col("status") != "removed"))
    rows = _at(_at(rows, contents, "after", "path", "sha"), contents, "parent_text", "path", "parent_sha")
    fetched = F.when(F.col("status") != "added", F.nullif("parent_text", F.lit("")))
    after = F.when(F.coalesce("f.raw_url", F.lit("")) != "", F.col("after"))
    rows = rows.withColumns({"fetched": fetched, "after": after}).filter(F.col("fetched").isNotNull() | (F.col("patch") != ""))
    undo = F.col("fetched").isNull() & (F.coalesce("after", F.lit("")) != "")
    rows = rows.withColumn("undone", reverse_patch(F.when(undo, F.col("after")), F.when(undo, F.col("patch")))).withColumn("undo", undo)
    undone = F.when(F.col("undo"), F.nullif(F.col("undone.text"), F.lit("")))
    rows = rows.withColumns(
        {
            "code_before": F.coalesce("fetched", undone, F.concat(F.lit(f"# {PLACEHOLDER}\n"), "patch")),
            "code_before_quality": F.when(F.col("fetched").isNotNull(), "api").when(undone.isNotNull(), F.col("undone.quality")).otherwise("unavailable"),
        }
    )
    rows = once(rows, iac_tool=_tool("path", "code_before", "after")).filter("iac_tool <> 'unknown'")
    scanned = F.when(F.col("patch") != "", diff_side(F.col("patch"), "-")).otherwise(F.col("code_before"))
    rows = once(once(rows, _scanned=scanned), smells=smells_of(F.col("_scanned")))
    rows = rows.filter(filters.has_signal(F.size("smells"), F.col("message")))
    found = rows.select(
        record_id("GH", F.col("repo"), F.col("sha"), F.col("path")).alias("id"),
        F.lit("github_commit").alias("source"),
        "iac_tool",
        F.col("path").alias("file_path"),
        "code_before",
        F.col("after").alias("code_after"),
        F.nullif("patch", F.lit("")).alias("diff"),
        (F.coalesce("after", F.lit("")) != "").alias("has_fix"),
        "smells",
        "repo",
        F.col("sha").alias("commit_sha"),
        "parent_sha",
        F.left(F.nullif("message", F.lit("")), F.lit(MESSAGE_CHARS)).alias("commit_message"),
        "commit_date",
        "commit_author",
        "code_before_quality",
    )
    return with_repositories(found, repos)


def code_records(items: DataFrame, contents: DataFrame) -> DataFrame:
    """Detection records of code search hits: configuration files of a known kind with at least one smell."""
    rows = items.select("path", F.col("repository.full_name").alias("repo"), F.coalesce("repository.default_branch", F.lit("main")).alias("ref"), F.col("repository.stargazers_count").alias("repo_stars"), F.col("repository.description").alias("repo_description"))
    rows = _at(rows.filter((_text("repo") != "") & is_config_path(F.col("path"))), contents, "code_before", "path", "ref").filter(_text("code_before") != "")
    rows = once(once(rows, iac_tool=_tool("path", "code_before")).filter("iac_tool <> 'unknown'"), smells=smells_of(F.col("code_before"))).filter(F.size("smells") > 0)
    return rows.select(record_id("GH", F.col("repo"), F.col("ref"), F.col("path")).alias("id"), F.lit("github_code").alias("source"), "iac_tool", F.col("path").alias("file_path"), "code_before", F.lit(False).alias("has_fix"), "smells", "repo", "repo_stars", "repo_description")


def project_records(commits: DataFrame, projects: DataFrame, contents: DataFrame) -> DataFrame:
    """One record per changed configuration file of the other service's commits whose message speaks of security; contents go by project path."""
    message = F.coalesce(F.nullif("message", F.lit("")), F.col("title"), F.lit(""))
    told = commits.withColumn("text", message).filter(filters.message_signal(F.col("text")) & (_text("id") != ""))
    about = projects.select(F.col("id").alias("project_id"), F.col("path_with_namespace").alias("repo"), F.col("star_count").alias("repo_stars"), F.col("description").alias("repo_description"))
    rows = told.join(about, "project_id").select("*", F.get("parent_ids", F.lit(0)).alias("parent_sha"), F.explode("diffs").alias("d"))
    rows = rows.select("*", F.coalesce(F.nullif("d.new_path", F.lit("")), F.col("d.old_path")).alias("path"), F.col("d.new_path").alias("new_path"), F.coalesce(F.nullif("d.old_path", F.lit("")), F.col("d.new_path")).alias("old_path"), F.coalesce("d.diff", F.lit("")).alias("patch"), F.coalesce("d.new_file", F.lit(False)).alias("fresh"))
    rows = rows.filter(is_config_path(F.col("path")) & ~F.coalesce("d.deleted_file", F.lit(False)))
    rows = _at(_at(rows, contents, "after", "new_path", "id"), contents, "parent_text", "old_path", "parent_sha")
    rows = rows.withColumn("before", F.when(~F.col("fresh"), F.nullif("parent_text", F.lit("")))).filter(F.col("before").isNotNull() | (F.col("patch") != ""))
    rows = once(rows, iac_tool=detect_tool(F.col("path"), F.coalesce("before", "after", F.lit("")))).filter("iac_tool <> 'unknown'")
    scanned = F.when(F.col("patch") != "", diff_side(F.col("patch"), "-")).otherwise(F.coalesce("before", "after", F.lit("")))
    rows = once(once(rows, _scanned=scanned), smells=smells_of(F.col("_scanned"))).filter(filters.has_signal(F.size("smells"), F.col("text")))
    return rows.select(
        record_id("GL", F.col("repo"), F.col("id"), F.col("path")).alias("id"),
        F.lit("gitlab_commit").alias("source"),
        "iac_tool",
        F.col("path").alias("file_path"),
        F.coalesce("before", F.concat(F.lit(f"# {PLACEHOLDER}\n"), "patch")).alias("code_before"),
        F.nullif("after", F.lit("")).alias("code_after"),
        F.nullif("patch", F.lit("")).alias("diff"),
        (F.coalesce("after", F.lit("")) != "").alias("has_fix"),
        "smells",
        "repo",
        F.col("id").alias("commit_sha"),
        "parent_sha",
        F.left("text", F.lit(MESSAGE_CHARS)).alias("commit_message"),
        F.col("committed_date").alias("commit_date"),
        F.col("author_name").alias("commit_author"),
        F.when(F.col("fresh"), "new_file").when(F.col("before").isNotNull(), "api").otherwise("unavailable").alias("code_before_quality"),
        "repo_stars",
        "repo_description",
    ).transform(_tiered)


def _tiered(rows: DataFrame) -> DataFrame:
    """Adds the tier of records that no scanner has seen."""
    none = F.array().cast("array<string>")
    return rows.withColumns({"n_smells": F.size("smells"), "rules_before": none, "rules_after": none}).withColumn("tier", tier()).drop("n_smells", "rules_before", "rules_after")


def seed_records(seeds: DataFrame, commits: DataFrame, contents: DataFrame, repos: DataFrame) -> DataFrame:
    """Records of the commits that CVE seeds name, marked with their CVE."""
    wanted = seeds.select(F.concat_ws("/", "owner", "repo").alias("repo"), F.col("commit_sha").alias("sha"), "cve_id")
    found = commit_records(commits.join(wanted.select("repo", "sha").distinct(), ["repo", "sha"], "left_semi"), contents, repos)
    notes = wanted.select("repo", F.col("sha").alias("commit_sha"), F.concat(F.lit("cve_id="), "cve_id").alias("notes"))
    return found.join(notes, ["repo", "commit_sha"]).withColumn("source", F.lit("cve_osv"))


def dump_records(events: DataFrame, commits: DataFrame, contents: DataFrame, repos: DataFrame, limit: int | None = 20_000) -> DataFrame:
    """Records of the commits that an event dump announces in repositories whose name hints at configuration code."""
    wanted = readers.push_candidates(events, limit)
    return commit_records(commits.join(wanted, ["repo", "sha"], "left_semi"), contents, repos)


def _paired(rows: DataFrame, side: Column, group: Column, source: str, repo: str, note: str) -> DataFrame:
    """Every insecure example with the first secure one of its group; kinds come from the insecure side, then from the secure one."""
    rows = once(once(rows.filter(_text("content") != ""), _group=group, _smells=smells_of(F.col("content"))), _side=side)
    good = rows.filter("_side = 'good'").groupBy("_group").agg(F.min(F.struct("ord", "path", "content")).alias("_good"))
    pairs = rows.filter("_side = 'bad'").join(good, "_group", "left").withColumns({"good_path": F.col("_good.path"), "good": F.col("_good.content")})
    tool = F.coalesce(_known(detect_tool(F.col("path"), F.col("content"))), F.when(F.col("good").isNotNull(), _known(detect_tool(F.col("good_path"), F.col("good")))))
    pairs = once(pairs, iac_tool=tool).filter("iac_tool is not null")
    return pairs.select(record_id("KR", F.lit(repo), F.col("path")).alias("id"), F.lit(source).alias("source"), "iac_tool", F.col("path").alias("file_path"), F.col("content").alias("code_before"), F.col("good").alias("code_after"), F.col("good").isNotNull().alias("has_fix"), F.col("_smells").alias("smells"), F.lit(repo).alias("repo"), F.concat(F.lit(note), "_group").alias("notes"))


def _known(tool: Column) -> Column:
    return F.nullif(tool, F.lit("unknown"))


def parent_folder(path: Column) -> Column:
    """The folder of a path, "." for none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def check_examples(files: DataFrame, repo: str) -> DataFrame:
    """Examples (ord, path, content) told apart by path words, else by smells; groups are folders."""
    verdict = pairing.path_verdict(F.col("path"))
    side = F.when(verdict == "pass", "good").when(verdict == "fail", "bad").when(F.size("_smells") > 0, "bad").otherwise("good")
    return _paired(files, side, parent_folder(F.col("path")), "checkov", repo, "Checkov example group: ")


def query_examples(files: DataFrame, repo: str) -> DataFrame:
    """Examples told apart as positive and negative; groups are the first five parts of the path."""
    side = F.when(filters.example_side(F.col("path"), F.size("_smells")) == "positive", "bad").otherwise("good")
    parts = F.split("path", "/")
    group = F.when(F.size(parts) >= 5, filters.group_key(F.col("path"))).otherwise(parent_folder(F.col("path")))
    ext = F.lower(F.regexp_extract(base_name(F.col("path")), r"^.+(\.[^.]+)$", 1))
    return _paired(files.filter(ext.isin(".tf", ".yaml", ".yml", ".dockerfile", "")), side, group, "kics", repo, "KICS query: ")


def scanner_examples(files: DataFrame, repo: str) -> DataFrame:
    """Examples with a smell or a telling path; no pairs."""
    rows = once(files.filter(_text("content") != ""), iac_tool=detect_tool(F.col("path"), F.col("content"))).filter("iac_tool <> 'unknown'")
    rows = once(rows, smells=smells_of(F.col("content"))).withColumn("n_smells", F.size("smells"))
    return filters.good_or_bad(rows).select(record_id("KR", F.lit(repo), F.col("path")).alias("id"), F.lit("tfsec").alias("source"), "iac_tool", F.col("path").alias("file_path"), "code_before", "code_after", F.lit(False).alias("has_fix"), "smells", F.lit(repo).alias("repo"), F.concat(F.lit("tfsec/defsec example: "), "path").alias("notes"))


def vulnerable_records(tree: DataFrame, contents: DataFrame, about: DataFrame) -> DataFrame:
    """Detection records of repositories that are vulnerable on purpose: every configuration file of a known kind, with or without a smell.

    ``tree`` lists files (repo, ref, type, path, size), ``contents`` holds (repo, path, ref, content), ``about`` (repo, repo_description). A path counts once a repository.
    """
    files = tree.filter((F.col("type") == "blob") & is_config_path(F.col("path")) & (F.coalesce("size", F.lit(0)) <= filters.MAX_FILE))
    rows = _at(files.select("repo", "path", "ref").dropDuplicates(["repo", "path"]), contents, "code_before", "path", "ref").filter(_text("code_before") != "")
    rows = once(once(rows, iac_tool=detect_tool(F.col("path"), F.col("code_before"))).filter("iac_tool <> 'unknown'"), smells=smells_of(F.col("code_before")))
    rows = pairing.lookup(rows, about.select("repo", "repo_description"), "repo")
    note = F.concat(F.lit("Intentionally vulnerable: "), F.coalesce("repo_description", F.lit("")))
    return rows.select(record_id("KR", F.col("repo"), F.col("path")).alias("id"), F.lit("known_repo").alias("source"), "iac_tool", F.col("path").alias("file_path"), "code_before", F.lit(None).cast("string").alias("code_after"), F.lit(False).alias("has_fix"), "smells", "repo", "repo_description", note.alias("notes"))
