"""Registered queries over files: whole tables are written as a source would hold them, read back and put through the library."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import patches, rules, table_functions, text, tools
from .functions.rules import smells as smells_of
from .operators import evaluation, filters, pairing, summaries
from .operators import records as rec
from .plans import acquisition, corpus
from .plans import testviews as views
from .plans.testviews import records, table
from .queries import Query
from .sources import connector, readers, schemas, sinks
from .sources.scratch import shared_folder
from .streaming import monitor, stateful

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _written(rows: DataFrame, name: str, path: str | None = None) -> str:
    """Folder of lines, one for each row of a string column; no file is larger than Spark makes it."""
    path = path or shared_folder(rows.sparkSession, name)
    rows.select("value").write.text(path)
    return path


def _json(rows: DataFrame, name: str, **options) -> str:
    path = shared_folder(rows.sparkSession, name)
    rows.write.options(**options).json(path)
    return path


def _types(smells: Column) -> Column:
    return F.array_join(F.transform(smells, lambda s: s["type"]), "|")


# --- sources ---


@query
def read_strict(spark, d):
    path = _written(views.record_lines(spark, d), "lines")
    return readers.read_records(spark, [path, f"{path}-missing"]).select("id", F.md5("code_before").alias("code_md5"), _types(F.col("smells")).alias("types"))


@query
def read_lenient(spark, d):
    return readers.read_records(spark, _written(views.record_lines(spark, d), "lines"), strict=False).select("id", "iac_tool")


@query
def read_fail_fast(spark, d):
    """A line for every document; some lack keys, some have an unknown one."""
    path = _written(views.record_lines(spark, d, 6), "lines")
    return readers.read_records(spark, path, fail_fast=True).select("id", "has_fix")


@query
def read_glob(spark, d):
    lines, path = views.record_lines(spark, d, 1), shared_folder(spark, "inputs")
    for i in range(2):
        _written(lines.filter(f"doc_id % 2 = {i}"), "lines", f"{path}/part{i}.jsonl")
    return readers.read_records(spark, [f"{path}/part*.jsonl"]).select("id", F.regexp_extract("input_file", r"part\d", 0).alias("part"))


@query
def load_counts(spark, d):
    lines, path = views.record_lines(spark, d, 1), shared_folder(spark, "inputs")
    for i, rows in enumerate((lines, lines.filter("doc_id % 2 = 0"))):
        _written(rows, "lines", f"{path}/part{i}.jsonl")
    loaded = readers.read_records(spark, [f"{path}/part{i}.jsonl" for i in range(3)])
    return summaries.load_counts(loaded, loaded.select("id").distinct(), [f"part{i}.jsonl" for i in range(3)])


@query
def read_truth(spark, d):
    smell = F.struct(F.col("n_nationkey").cast("string").alias("smell_id"), F.col("n_name").alias("type"), (F.col("n_nationkey") % 9).cast("int").alias("line"), F.lit("CWE-1").alias("cwe"), F.lit("C").alias("checkov_id"), F.lit("").alias("description"), F.lit("").alias("category"))
    smells = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(smell).alias("smells"))
    files = table(spark, d, "region").join(smells, "r_regionkey").select(F.struct(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("file"), F.lit("terraform").alias("iac_tool"), "smells").alias("f"))
    path = _json(files.agg(F.collect_list("f").alias("files")), "truth")
    return readers.read_truth(spark, path).select("file_id", "file", "iac_tool", "smell_id", "type", "line")


@query
def read_taxonomy(spark, d):
    entry = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("Security").alias("category"), F.lit("about").alias("description"), F.concat(F.lit("CWE-"), F.col("n_regionkey").cast("string")).alias("cwe"), F.array(F.lit("docker"), "n_name").alias("iac_tools"), F.lit("fix").alias("fix_example"))
    path = _written(table(spark, d, "nation").agg(F.to_json(F.collect_list(entry)).alias("value")), "taxonomy")
    return readers.read_taxonomy(spark, path).select("id", "tools_csv", F.contains("text", F.col("name")).alias("named"))


@query
def read_scripts(spark, d):
    path = shared_folder(spark, "scripts")
    table(spark, d, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    found = readers.read_scripts(spark, f"{path}/*")
    return found.select(F.regexp_extract("file_path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.md5("content").alias("content_md5"))


@query
def read_recorded(spark, d):
    """Pages of answers, as a recorder leaves them: one file a page of a hundred items."""
    items = views.commits(spark, d).withColumn("page", F.floor(F.col("doc_id") / 100).cast("int"))
    item = F.struct("repo", "sha", "parents", "commit", "files")
    page = F.to_json(F.struct(F.lit("q").alias("unit"), "page", F.collect_list(item).alias("items")))
    path = shared_folder(spark, "pages")
    items.groupBy("page").agg(page.alias("value")).write.partitionBy("page").text(path)
    return readers.read_recorded(spark, f"{path}/*", schemas.COMMIT).select("page", "repo", "sha", F.col("files")[0]["filename"].alias("path"))


@query
def read_event_dump(spark, d):
    path = _json(views.pushes(spark, d), "dump", compression="gzip")
    return readers.push_candidates(readers.read_event_dump(spark, path), None).select("repo", "sha")


@query
def cve_seeds(spark, d):
    return readers.cve_seeds(spark.read.schema(schemas.struct(ord=schemas.T.LongType(), cve=schemas.CVE["cve"].dataType)).json(_json(views.cve_feed(spark, d), "feed"))).select("cve_id", "owner", "repo", "commit_sha", "describes_code", F.md5("description").alias("description_md5"))


@query
def scanner_findings(spark, d):
    n = F.col("doc_id")
    none = F.lit(None).cast("string")
    check = F.struct(F.concat(F.lit("CKV_"), (n % 30).cast("string")).alias("check_id"), F.concat(F.lit('a}{"b'), F.repeat(F.lit("x"), F.lit(300))).alias("check_name"), F.when(n % 3 > 0, "high").alias("severity"), F.array((n % 50).cast("int"), F.lit(99)).alias("file_line_range"), F.when(n % 2 == 0, F.concat(F.lit("see CWE-"), (n % 9).cast("string"))).alias("guideline"))
    run = F.to_json(F.struct(F.struct(F.array(check).alias("failed_checks")).alias("results")))
    checkov = F.when(n % 4 == 0, run).when(n % 4 == 1, F.concat(F.lit("["), run, F.lit("]"))).when(n % 4 == 2, F.concat(run, F.lit("\n"), F.replace(run, F.lit('}{\\"b'), F.lit("")))).otherwise("torn {")
    hit = F.struct(F.when(n % 2 == 0, "T1").otherwise("").alias("rule_id"), F.lit("long").alias("long_id"), F.lit("low").alias("severity"), F.lit("said").alias("description"), F.struct((n % 40).cast("int").alias("start_line")).alias("location"))
    tfsec = F.when(n % 5 > 0, F.to_json(F.struct(F.array(hit).alias("results")))).otherwise("")
    at = F.transform(F.sequence(F.lit(1), (n % 3 + 1).cast("int")), lambda i: F.struct(i.alias("line")))
    asked = F.struct(none.alias("query_id"), F.lit("name").alias("query_name"), F.lit("INFO").alias("severity"), F.lit("250").alias("cwe"), at.alias("files"))
    kics = F.to_json(F.struct(F.array(asked, F.struct(none.alias("query_id"), F.lit("e").alias("query_name"), none.alias("severity"), none.alias("cwe"), F.array().cast("array<struct<line:int>>").alias("files"))).alias("queries")))
    rows = table(spark, d, "documents").select("doc_id", F.concat(readers.checkov_findings(checkov), readers.tfsec_findings(tfsec), readers.kics_findings(kics)).alias("all"))
    rows = rows.select("doc_id", F.inline("all"))
    return rows.select("doc_id", "scanner", "rule_id", "severity", "cwe", "line", F.length("message").alias("message_chars"))


# --- acquisition ---


def _digest(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("id", "iac_tool", "has_fix", F.size("smells").alias("n_smells"), F.md5("code_before").alias("before_md5"), *more)


@query
def commit_records(spark, d):
    found = acquisition.commit_records(views.commits(spark, d), views.contents(spark, d), views.repositories(spark, d))
    return _digest(found, "code_before_quality", "repo_stars", "repo_description", F.length("commit_message").alias("message_chars"))


@query
def code_records(spark, d):
    at_branch = views.keyed(spark, d).select("repo", views.paths().alias("path"), F.lit("main").alias("ref"), F.col("text").alias("content"))
    return _digest(acquisition.code_records(views.code_items(spark, d), at_branch), "repo_stars")


@query
def project_records(spark, d):
    found = acquisition.project_records(views.project_commits(spark, d), views.projects(spark, d), views.contents(spark, d, "group"))
    return _digest(found, "code_before_quality", "commit_message", "tier")


@query
def seed_records(spark, d):
    seeds = readers.read_seeds(spark, _json(readers.cve_seeds(views.cve_feed(spark, d)), "seeds"))
    found = acquisition.seed_records(seeds, views.commits(spark, d), views.contents(spark, d), views.repositories(spark, d))
    return found.select("id", "source", "notes")


@query
def dump_records(spark, d):
    found = acquisition.dump_records(views.pushes(spark, d), views.commits(spark, d), views.contents(spark, d), views.repositories(spark, d), None)
    return found.select("id", "iac_tool", "code_before_quality")


def _example(rows: DataFrame) -> DataFrame:
    return rows.select("id", "source", "iac_tool", "has_fix", F.size("smells").alias("n_smells"), F.md5("code_after").alias("after_md5"), "notes")


@query
def check_examples(spark, d):
    return _example(acquisition.check_examples(views.examples(spark, d, "check"), "org/checks"))


@query
def query_examples(spark, d):
    return _example(acquisition.query_examples(views.examples(spark, d, "query"), "org/queries"))


@query
def scanner_examples(spark, d):
    return _example(acquisition.scanner_examples(views.examples(spark, d, "scanner"), "org/scanner"))


@query
def vulnerable_records(spark, d):
    """All files of two of the three kinds of repositories, twice in the listing."""
    files = views.keyed(spark, d).select("repo", views.paths().alias("path"), F.lit("main").alias("ref"), F.lit("blob").alias("type"), F.length("text").alias("size"), F.col("text").alias("content"))
    about = views.repositories(spark, d).select("repo", F.concat(F.lit("about "), "repo").alias("repo_description"))
    found = acquisition.vulnerable_records(files.drop("content").union(files.drop("content")), files.select("repo", "path", "ref", "content"), about)
    return found.select("id", "iac_tool", F.size("smells").alias("n_smells"), F.md5("code_before").alias("before_md5"), "notes")


# --- sinks ---


@query
def append_json(spark, d):
    rows, path = table(spark, d, "documents").select("doc_id", "source", "text"), shared_folder(spark, "appended")
    for i in range(2):
        sinks.append_json(rows.filter(f"doc_id % 2 = {i}"), path)
    return spark.read.schema(rows.schema).json(path).select("doc_id", "source", F.md5("text").alias("text_md5"))


@query
def overwrite_json(spark, d):
    rows, path = table(spark, d, "documents").select("doc_id", "lang"), shared_folder(spark, "overwritten")
    sinks.overwrite_json(rows, path)
    sinks.overwrite_json(rows.filter("lang <> 'en'"), path)
    return spark.read.schema(rows.schema).json(path)


@query
def release_files(spark, d):
    path = shared_folder(spark, "release")
    sinks.write_release(corpus.release(records(spark, d)).select("id", "tier", "has_fix"), path)
    parts = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("output"), "id") for name in ("full", "gold", "fix_pairs", "detection")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("output").agg(F.count("*").alias("n"))


@query
def split_files(spark, d):
    rows, path = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "val").when(F.col("doc_id") % 3 == 1, "odd").alias("split")), shared_folder(spark, "splits")
    sinks.write_splits(rows, path)
    return spark.read.schema("doc_id long, split string").json(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query
def manifest_file(spark, d):
    path = shared_folder(spark, "manifest")
    sinks.write_manifest(corpus.manifest(records(spark, d).withColumn("tier", rec.tier()), ["tier", "source", "iac_tool", "code_before_quality"]), path)
    return spark.read.schema("dimension string, key string, n long").json(path)


@query
def text_file(spark, d):
    path = f"{shared_folder(spark, 'text')}/report.txt"
    for said in ("first", f"{table(spark, d, 'documents').count()} documents"):
        sinks.write_text(spark, path, said)
    return spark.read.text(path)


@query
def knowledge_upsert(spark, d):
    docs, path = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), shared_folder(spark, "knowledge")
    sinks.upsert_knowledge(docs.filter("id % 2 = 0"), path)
    stored = sinks.upsert_knowledge(docs.filter("id % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text")), path)
    return stored.select("id", F.md5("text").alias("text_md5"))


@query
def validated_files(spark, d):
    """A validation run: its rows are written and counted in one go."""
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    done, failed = F.col("quality").isNotNull(), F.coalesce("quality", F.lit(1)) == 0
    counters = {"processed": F.count_if(done & ~failed), "skipped": F.count_if(~done), "errored": F.count_if(failed), "with_findings": F.count_if(done & (F.col("toxic") > 0))}
    return sinks.write_counted(rows, shared_folder(spark, "validated"), **counters)


@query
def load_order(spark, d):
    """Two inputs of unequal size, the small one first: the first load of each text wins."""
    lines, path = views.record_lines(spark, d, 1), shared_folder(spark, "inputs")
    for name, rows in (("b.jsonl", lines.filter("doc_id % 37 = 0")), ("a.jsonl", lines.filter("doc_id % 37 <> 0"))):
        rows.orderBy("doc_id").select("value").write.text(f"{path}/{name}")
    loaded = readers.read_records(spark, [f"{path}/b.jsonl", f"{path}/a.jsonl"])
    rows = loaded.select("id", text.content_hash(F.col("code_before")).alias("content_hash"), "has_fix", F.size("smells").alias("n_smells"), "ord")
    return rec.dedup_best(rows).select("id", "content_hash")


def _pages(spark, d) -> str:
    """Commits as recorded pages of about a hundred items by language, as a crawl leaves them."""
    items, path = views.commits(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("unit")), "doc_id"), shared_folder(spark, "pages")
    sizes = items.groupBy("unit").agg(F.ceil(F.count("*") / 100).alias("n_pages"))
    paged = items.join(F.broadcast(sizes), "unit").withColumn("page", F.pmod(F.col("doc_id"), F.col("n_pages")).cast("int"))
    item = F.struct("repo", "sha", "parents", "commit", "files")
    value = F.to_json(F.struct("unit", "page", F.collect_list(item).alias("items")))
    paged.groupBy("unit", "page").agg(value.alias("value")).write.partitionBy("unit", "page").text(path)
    return path


@query
def read_planned(spark, d):
    """Recorded pages without those of done units and of pages taken before: what isn't wanted is never opened."""
    connector.register(spark)
    path = _pages(spark, d)
    pages = lambda: spark.read.format("recorded").option("path", path).option("pagesATask", 1).load()
    wanted = pages().filter((F.col("unit") != "en") & (F.col("page") >= 1))
    n_read, n_all = wanted.rdd.getNumPartitions(), pages().rdd.getNumPartitions()
    return wanted.select("unit", "page", F.get_json_object("item", "$.sha").alias("sha"), F.lit(n_read).alias("pages_read"), F.lit(n_all).alias("pages"))


@query
def planned_records(spark, d):
    """Records of the units that progress marks leave: a unit is done if its first document has an even number. Pages of done units are never opened."""
    connector.register(spark)
    marks = table(spark, d, "documents").groupBy(F.col("lang").alias("unit")).agg(F.max("doc_id").alias("last_page"), (F.min("doc_id") % 2 == 0).alias("done"))
    done = [r.unit for r in marks.filter("done").select("unit").collect()]  # units: one for each search
    pages = spark.read.format("recorded").option("path", _pages(spark, d)).load()
    left = pages.filter(~F.col("unit").isin(done)) if done else pages
    commits = left.select(F.from_json("item", schemas.COMMIT).alias("i")).select("i.*")
    found = acquisition.commit_records(commits, views.contents(spark, d), views.repositories(spark, d))
    return found.select("id", "iac_tool", "code_before_quality")


@query
def stream_recorded(spark, d):
    """A stream over recorded pages that stops and goes on from its marks: each page is taken once."""
    connector.register(spark)
    path = _pages(spark, d)
    for _ in range(2):
        stream = spark.readStream.format("recorded").option("path", path).load().select("unit", "page", F.get_json_object("item", "$.sha").alias("sha"))
        stateful.run_available(stream, f"{path}-taken", f"{path}-marks")
    return spark.read.schema("unit string, page int, sha string").parquet(f"{path}-taken")


@query
def resume_bucketed(spark, d):
    """Documents that no label names, against a store bucketed by id."""
    name = f"terrane_labels_{uuid.uuid4().hex}"
    done = sinks.write_bucketed(table(spark, d, "labels"), name, ["doc_id"])
    return pairing.not_stored(table(spark, d, "documents").select("doc_id"), done, ["doc_id"])


@query
def version_pairs_bucketed(spark, d):
    """Before and after of each change, from versions stored once, bucketed by file and commit."""
    e = table(spark, d, "events")
    versions = e.select(F.col("user_id").alias("repo"), F.col("event_type").alias("path"), F.col("event_id").alias("ref"), F.col("props").alias("content"))
    stored = sinks.write_bucketed(versions, f"terrane_versions_{uuid.uuid4().hex}", ["repo", "path", "ref"])
    files = e.select(F.col("user_id").alias("repo"), F.col("event_type").alias("path"), F.col("event_id").alias("commit_sha"), (F.col("event_id") - 1).alias("parent_sha"))
    return filters.version_pairs(files, stored).select("commit_sha", "code_before", "code_after")


@query
def stream_ingest(spark, d):
    """An append-only ingest that is started twice; the second start finds nothing new."""
    path = shared_folder(spark, "ingested")
    for _ in range(2):
        monitor.ingest(monitor.read_events(spark, d, files=8), f"{path}/rows", f"{path}/checkpoint")
    return spark.read.schema("event_id long, event_type string").json(f"{path}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query
def evaluation_report(spark, d):
    e = table(spark, d, "events").withColumns({"line": (F.col("event_id") % 100).cast("int"), "file": F.col("user_id") % 20, "check": F.when(F.col("event_id") % 5 == 0, "HEURISTIC").when(F.col("event_id") % 5 > 1, (F.col("event_id") % 5).cast("string"))})
    det, gt = e.filter("event_type = 'error'").withColumn("det_id", F.col("event_id")), e.filter("event_type = 'purchase'").withColumn("gt_id", F.col("event_id"))
    found = evaluation.detection_counts(det, gt, 5)
    names = [("Precision", "precision"), ("Recall", "recall"), ("F1-Score", "f1")]
    rows = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(name).alias("metric"), F.lit("Detection").alias("layer"), F.col(c).alias("value")) for i, (name, c) in enumerate(names)])
    return summaries.report_lines(found.select(F.inline(rows)))


@query
def heuristic_truth(spark, d):
    e = table(spark, d, "events").withColumns({"line": (F.col("event_id") % 100).cast("int"), "file": F.col("user_id") % 20, "check": F.when(F.col("event_id") % 5 == 0, "HEURISTIC").when(F.col("event_id") % 5 > 1, (F.col("event_id") % 5).cast("string"))})
    det, gt = e.filter("event_type = 'error'").withColumn("det_id", F.col("event_id")), e.filter("event_type = 'purchase'").withColumn("gt_id", F.col("event_id"))
    return evaluation.detection_counts(det, gt, 5).select("tp", "fp", "fn")


# --- projections ---


@query
def path_filters(spark, d):
    f, path, content = views.files(spark, d), F.col("path"), F.col("content")
    return f.select("doc_id", tools.is_config_path(path).alias("config"), filters.alive(F.col("status")).alias("alive"), filters.has_sides(F.lit(""), F.when(F.col("doc_id") % 2 == 0, "p"), tools.detect_tool(path, content)).alias("sides"), tools.is_config_file(path, content).alias("known"), tools.detect_tool(path, content).alias("detected"), tools.analyzer_tool(path, content).alias("analyzed"), tools.guess_tool(path, content).alias("guessed"), tools.platform(path, content).alias("platform"))


@query
def tree_files(spark, d):
    tree = views.files(spark, d).select(F.when(F.col("doc_id") % 9 > 0, "blob").otherwise("tree").alias("type"), "path", F.when(F.col("doc_id") % 7 > 0, F.length("content") * 100).alias("size"))
    return filters.tree_files(tree.union(tree), within="m").select("path")


@query
def example_sides(spark, d):
    e = views.examples(spark, d, "query")
    return e.select("ord", filters.example_side(F.col("path"), F.size(smells_of(F.col("content")))).alias("side"))


@query
def security_messages(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(readers.SECURITY_MESSAGE).alias("security"), filters.describes_code(F.col("text")).alias("describes_code"))


@query
def normalised_smells(spark, d):
    return rec.normalise(records(spark, d)).select("id", "n_smells", F.array_join("labels", "|").alias("labels"))


@query
def dedupe_smells(spark, d):
    """Every line stands for a smell: its first letters are the type, its parity the line number."""
    none = F.lit(None).cast("string")
    line = lambda x, i: F.struct(F.left(x, F.lit(2)).alias("type"), none.alias("cwe"), none.alias("checkov_id"), (i % 2).alias("line_number"), F.lit("r").alias("resource"), F.left(x, F.lit(1)).alias("checker_id"), (i % 3).alias("line"))
    smells = F.transform(F.split("text", "\n"), line)
    return table(spark, d, "documents").select("doc_id", F.size(rec.dedupe_array(smells, rec.SAME_SMELL)).alias("n"), F.size(rec.dedupe_array(smells, ["checker_id", "type", "line", "resource"])).alias("n_analyzer"))


@query
def base64_contents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.decode_base64(F.base64(F.encode("text", "UTF-8")))).alias("text_md5"))


@query
def parsed_responses(spark, d):
    diff = F.concat(F.lit("--- a/x\n+++ b/x\n+"), F.regexp_replace(F.translate("text", "`", ""), "\n", "\n+"), F.lit("\n+end"))
    n = F.col("doc_id") % 4
    raw = F.when(n == 0, diff).when(n == 1, F.concat(F.lit("Here:\n```diff\n"), diff, F.lit("\n```\nDone"))).when(n == 2, F.concat(F.lit("```\nnote\n"), diff, F.lit("\n```"))).otherwise("  no diff ")
    return table(spark, d, "documents").select("doc_id", F.md5(text.parse_response(raw)).alias("patch_md5"))


@query
def explanations(spark, d):
    smells = F.transform("smell_types", lambda t: F.struct(t.alias("type"), F.when(F.col("ord") % 2 == 0, F.lit(3)).alias("line"), F.when(t == "email", "CWE-312").when(t == "license", "CWE-1").alias("cwe"), F.when(t == "ipv4", "an address").alias("description")))
    return records(spark, d).select("id", F.md5(summaries.explanation(smells, (F.col("ord") % 5).cast("int"), (F.col("ord") % 3).cast("int"))).alias("text_md5"))


@query
def cwe_lookup(spark, d):
    n = table(spark, d, "nation")
    taxonomy = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("CWE-"), (F.col("n_regionkey") + 249).cast("string")).alias("cwe"))
    asked = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "CWE-319").when(F.col("doc_id") % 3 == 0, F.concat(F.lit("CWE-"), (F.col("doc_id") % 8 + 247).cast("string"))).alias("cwe"))
    return summaries.with_cwe_names(asked, summaries.cwe_names(taxonomy)).select("doc_id", "cwe", "cwe_name")


@query
def chat_pairs(spark, d):
    messages = corpus.chat_messages(F.col("iac_tool"), F.col("smell_types"), F.col("code_before"), F.col("code_after"))
    return records(spark, d).filter(corpus.usable()).select("id", F.posexplode(messages).alias("at", "m")).select("id", "at", "m.role", F.md5("m.content").alias("content_md5"))


@query
def diff_smells(spark, d):
    """Every text as a diff whose lines are removed, added and kept in turn."""
    signed = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, "-").when(i % 3 == 1, "+").otherwise(" "), x)), "\n")
    rows = table(spark, d, "documents").select("doc_id", signed.alias("diff")).withColumn("s", acquisition.diff_smells(F.col("diff")))
    told = lambda side: F.array_join(F.array_sort(F.transform(F.col(side), lambda x: x["type"])), "|")
    return rows.select("doc_id", told("s.before").alias("before"), told("s.after").alias("after"))


def _salvaged(spark, d) -> DataFrame:
    n = F.col("ord")
    rows = records(spark, d).withColumns({"diff": F.when(n % 7 == 0, "@@ -0,0 +1,2 @@").when(n % 2 == 0, views.PATCH), "code_before": F.when(n % 3 == 0, f"# {text.PLACEHOLDER}").otherwise(F.col("code_before")), "code_after": F.concat("code_before", F.lit("\nfixed")), "code_before_quality": F.lit(None).cast("string")})
    return corpus.salvage(rows)


@query
def salvaged(spark, d):
    return _salvaged(spark, d).select("id", "code_before_quality", "has_fix", "smells_added", F.md5("code_before").alias("before_md5"))


@query
def salvage_stats(spark, d):
    return summaries.salvage_stats(_salvaged(spark, d))


@query
def patch_round_trip(spark, d):
    """A unified diff between two versions, applied and undone again."""
    before, lines = F.concat("text", F.lit("\n")), F.split("text", "\n")
    after = F.concat(F.array_join(F.transform(lines, lambda x, i: F.when(i % 5 == 1, F.concat(x, F.lit(" changed"))).otherwise(x)), "\n"), F.lit("\nfixed\n"))
    rows = table(spark, d, "documents").select("doc_id", before.alias("before"), after.alias("after")).withColumn("patch", patches.unified_diff("before", "after"))
    rows = rows.select("doc_id", patches.apply_patch("before", "patch").alias("applied"), patches.reverse_patch("after", "patch").alias("undone"))
    return rows.select("doc_id", F.md5("applied").alias("applied_md5"), F.md5("undone.text").alias("undone_md5"))


@query
def smells_table_function(spark, d):
    """The rules as a table function of SQL."""
    table_functions.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("terrane_documents")
    return spark.sql("SELECT doc_id, s.type FROM terrane_documents, LATERAL smells(text) s")


@query
def smells_sql_function(spark, d):
    """The rules as an expression function of SQL, evaluated in the scan."""
    table_functions.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("terrane_documents")
    return spark.sql("SELECT doc_id, s.type, md5(s.match) AS match_md5 FROM (SELECT doc_id, smell_list(text) AS found FROM terrane_documents) LATERAL VIEW inline(found) s AS type, match")


# --- counts, orders, limits ---


def _validated(spark, d) -> DataFrame:
    finding = lambda on, name: F.when(on, F.array(F.struct(F.lit(name).alias("scanner"))))
    n = F.col("ord")
    return records(spark, d).withColumns({"validated_smells_before": finding(F.size("rules_before") > 0, "checkov"), "validated_smells_after": finding(n % 3 == 0, "tfsec")})


@query
def scanner_counts(spark, d):
    return summaries.scanner_counts(_validated(spark, d))


@query
def validated_counts(spark, d):
    return summaries.validated_counts(_validated(spark, d), rec.fixed_rules())


@query
def scan_totals(spark, d):
    """Each text is a scan: the smells it has are the checks it fails, all others it passes."""
    failed = F.size(smells_of(F.col("text"))).cast("long")
    kinds = len({name for name, _ in rules.RULES})
    scans = rec.once(table(spark, d, "documents").select(F.col("lang").alias("check_type"), "text"), failed=failed)
    return summaries.scan_totals(scans.select("check_type", F.struct((F.lit(kinds) - F.col("failed")).alias("passed"), "failed").alias("summary")))


@query
def run_statistics(spark, d):
    found = evaluation.run_statistics(table(spark, d, "events"), "event_type", "value")
    return found.select("event_type", "runs", *[F.round(c, 6).alias(c) for c in ("mean", "sd_sample", "sd_population")])


@query
def repository_lookup(spark, d):
    repos = views.repositories(spark, d).filter("repo_stars > 2").withColumn("repo_description", F.lit("d"))
    return acquisition.with_repositories(views.keyed(spark, d).select("doc_id", "repo"), repos).select("doc_id", "repo", "repo_stars", "repo_description")


@query
def ordered_records(spark, d):
    rows = records(spark, d).select("id", "source")
    empty = F.lit("")
    return rec.positions(rows, [F.coalesce("source", empty), F.coalesce("id", empty)], shared_folder(spark, "ordered")).select("id", "position")


@query
def head_sample(spark, d):
    """A limit is the feature here: the first records in order."""
    return table(spark, d, "documents").orderBy("doc_id").limit(100).select("doc_id", "source")


@query
def exact_sets(spark, d):
    rows = views.keyed(spark, d).select(F.lower("repo").alias("repo"), "lang", "doc_id")
    return pairing.first_by(rows, ["repo", "lang"], [F.col("doc_id")])


@query
def token_bucket(spark, d):
    calls = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return monitor.throttle(calls, "user_id", "event_id", "at", 0.0001).select("event_id", F.round("start", 2).alias("start"))


@query
def breaker_pauses(spark, d):
    calls = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.breaker(calls, "user_id", "event_id", F.col("event_type") == "error", 3, "ts").select("event_id", "opens", F.unix_micros("paused_until").alias("paused_until_us"))


@query
def backoff_delays(spark, d):
    calls = table(spark, d, "events").select("event_id", F.col("user_id").alias("call_id"), (F.col("event_id") % 10).alias("attempt"))
    return summaries.backoff(calls).select("event_id", F.col("delay").cast("long").alias("delay"))
