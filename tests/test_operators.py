"""Record, evaluation, pairing, source and streaming operators on small frames."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from terrane.operators import evaluation, pairing
from terrane.operators import records as rec
from terrane.plans import corpus
from terrane.sources import readers, sinks
from terrane.streaming import monitor

RECORD = "id string, ord long, content_hash string, has_fix boolean, n_smells int, iac_tool string"


def test_dedup_prefers_fix_then_smells_then_order(spark):
    rows = [("a", 1, "h", False, 9, "t"), ("b", 2, "h", True, 1, "t"), ("c", 3, "h", True, 2, "t"), ("d", 4, "h", True, 2, "t"), ("e", 5, "g", False, 0, "t")]
    once = rec.dedup_best(spark.createDataFrame(rows, RECORD))
    assert sorted(r.id for r in once.collect()) == ["c", "e"]
    assert sorted(r.id for r in rec.dedup_best(once).collect()) == ["c", "e"]


def test_splits_are_exact_stratified_and_seeded(spark):
    rows = [(f"r{i}", i, str(i), False, 0, "big" if i else "one") for i in range(101)]
    frame = spark.createDataFrame(rows, RECORD)
    split = lambda seed: {r.id: r.split for r in rec.assign_splits(frame, ["iac_tool"], seed).collect()}
    a = split(1)
    counts = [list(a.values()).count(s) for s in ("train", "val", "test")]
    assert counts == [80, 10, 11] and a["r0"] == "test" and split(1) == a and split(2) != a


TIER = "has_fix boolean, code_before_quality string, code_before string, code_after string, commit_message string, n_smells int, rules_before array<string>, rules_after array<string>"


def test_tiers(spark):
    code = "x" * 30
    rows = [
        ((True, "api", "[before content unavailable]", "y", "", 0, ["R"], []), "A"),
        ((True, "exact", code, "y", "", 0, ["R"], ["R"]), "B"),
        ((True, None, code, "y", "", 1, None, None), "B"),
        ((True, None, code, "y", "Fix CVE-1", 0, None, None), "B"),
        ((True, None, code, "y", "tidy", 0, None, None), "D"),
        ((False, None, code, None, "", 0, ["R"], None), "C"),
        ((False, "new_file", "", "new", "", 1, None, None), "C"),
        ((False, "partial", "", None, "", 2, None, None), "C"),
        ((True, "unavailable", code, "y", "cve-", 3, ["R"], []), "D"),
        ((True, None, "[before content unavailable]" + code, "y", "", 3, ["R"], []), "D"),
        ((None, None, None, None, None, 0, None, None), "D"),
    ]
    frame = spark.createDataFrame([r for r, _ in rows], TIER)
    assert [r.t for r in frame.select(rec.tier().alias("t")).collect()] == [t for _, t in rows]


def test_normalise_and_release(spark):
    base = ", repo string, commit_sha string, file_path string, diff string, ord long, input_rank int, id string, iac_tool string, content_hash string"
    row = lambda i, fix, q, before, after, diff, rules, rank: (fix, q, before, after, "", 1, rules, [], "r", "s", "p", diff, i, rank, f"i{i}", "docker", None)
    code = "y" * 40
    frame = spark.createDataFrame([row(1, True, None, "", code, "@@ -0,0 +1 @@", None, 0), row(2, True, None, code, "z", "", ["R"], 0), row(3, True, None, code, "z", "", None, 1)], TIER + base)
    normal = {r.id: r for r in rec.normalise(frame).collect()}
    assert normal["i1"].code_before == code and normal["i1"].code_after is None and not normal["i1"].has_fix and normal["i1"].tier == "C"
    assert normal["i2"].code_before_quality == "api" and normal["i2"].tier == "A"
    best = corpus.release(frame).collect()
    assert [r.id for r in best] == ["i2"] and best[0].split == "test"


def test_salvage(spark):
    cols = "id string, has_fix boolean, code_before_quality string, code_before string, code_after string, diff string, commit_message string, smell_types array<string>, rules_before array<string>, rules_after array<string>, n_smells int"
    gone = "[before content unavailable]"
    diff = '@@ -1,2 +1,2 @@\n-password = "hunter22"\n+password = var.x\n keep'
    rows = [("a", True, None, gone, "password = var.x\nkeep", diff, "", ["old"], None, None, 1), ("b", True, None, gone, "privileged: true", "@@ -0,0 +1 @@\n+privileged: true", "", [], None, None, 0), ("c", True, None, "real code", "x", None, "", None, None, None, 0)]
    by = {r.id: r for r in corpus.salvage(spark.createDataFrame(rows, cols)).collect()}
    assert by["a"].code_before == 'password = "hunter22"\nkeep' and by["a"].code_before_quality == "exact" and by["a"].smell_types == ["old", "hardcoded_password"] and by["a"].smells_added == 1
    assert by["b"].code_before_quality == "new_file" and not by["b"].has_fix and by["b"].smell_types == ["privileged_container"] and by["c"].code_before_quality == "api"


def test_salvage_lowers_a_text_once(spark):
    """The removed lines and the before side are each lowered once, not for each guard of a rule."""
    cols = "id string, has_fix boolean, code_before_quality string, code_before string, code_after string, diff string, commit_message string, smell_types array<string>, rules_before array<string>, rules_after array<string>, n_smells int"
    plan = corpus.salvage(spark.createDataFrame([], cols)).select("id", "code_before", "smells_added")._jdf.queryExecution().optimizedPlan().toString()
    assert "diff#" in plan and plan.count("lower(") == 2


def test_detection_edges(spark):
    det = [(1, "f", "C1", 5), (2, "f", "C1", 6), (3, "f", "C1", 30), (4, "f", "HEURISTIC", 5), (5, "f", "C2", None)]
    gt = [(10, "f", "C1", 10), (11, "f", "C2", 3), (12, "g", "C1", 5)]
    d = spark.createDataFrame(det, "det_id long, file string, check string, line int")
    g = spark.createDataFrame(gt, "gt_id long, file string, check string, line int")
    r = evaluation.detection_counts(d, g, 5).first()
    assert (r.tp, r.fp, r.fn) == (2, 2, 1) and abs(r.f1 - 2 * 0.5 * (2 / 3) / (0.5 + 2 / 3)) < 1e-12
    empty = evaluation.detection_counts(d.limit(0), g, 5).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


def test_verdicts_and_remediation(spark):
    rows = [("a", "s1", "before", "R1"), ("a", "s1", "after", "R2"), ("b", "s1", "before", "R1"), ("b", "s2", "before", "R3"), ("b", "s2", "before", "R3")]
    v = evaluation.patch_verdicts(spark.createDataFrame(rows, "file string, scanner string, side string, rule_id string"), ["file", "scanner"])
    files = {r.file: r for r in evaluation.ensemble(v, ["file"]).collect()}
    assert not files["a"].valid and files["b"].valid
    m = evaluation.remediation(evaluation.ensemble(v, ["file"]).withColumn("patched", F.lit(True))).first()
    assert m.pvr == 0.5 and m.ser_micro == 1.0 and m.nnir == 0.5
    tries = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False)], "file_id string, attempt int, valid boolean")
    s = evaluation.success_at(tries).first()
    assert (s.sr_at_1, s.sr_at_2, s.sr_at_3) == (0.0, 0.5, 0.5)


def test_consistency_kappa_and_ranks(spark):
    rows = [("p", i, f"raw{i}", f) for i, f in enumerate(["x", "x", "y", "", "x"])]
    got = evaluation.self_consistency(spark.createDataFrame(rows, "prompt_id string, idx int, raw string, form string")).collect()
    assert [(r.form, r.raw, r.confidence) for r in got] == [("x", "raw0", 0.6)]
    full = spark.createDataFrame([(1, "a", 3), (2, "b", 3)], "item int, category string, n long")
    assert evaluation.fleiss_kappa(full).first().kappa == 1.0
    w = evaluation.signed_rank(spark.createDataFrame([(3.0, 1.0), (1.0, 2.0), (5.0, 5.0), (9.0, 1.0)], "x double, y double")).first()
    assert (w.w_plus, w.w_minus, w.n) == (5.0, 1.0, 3)
    assert evaluation.holm({"a": 0.01, "b": 0.04, "c": 0.03}) == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_pairing(spark):
    assert [r.v for r in spark.createDataFrame([("x/pass/a.tf",), ("x/fail_1.tf",), ("x/insecure.tf",), ("x/y.tf",)], "p string").select(pairing.path_verdict(F.col("p")).alias("v")).collect()] == ["pass", "fail", "pass", None]
    assert spark.createDataFrame([("x/insecure.tf",)], "p string").select(pairing.path_verdict(F.col("p"), strict=True).alias("v")).first().v == "fail"
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id long, embedding array<float>")
    near = pairing.nearest(v.filter("vec_id in (3, 10)"), v, 3).collect()
    assert sorted((r.query_id, r.vec_id) for r in near) == [(3, 2), (3, 3), (3, 4), (10, 9), (10, 10), (10, 11)]


def test_neighbours_without_a_distance_come_last(spark):
    """Nulls, other lengths and components that are no numbers, next to copies, over several parts of both sides."""
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i // 3), 0.5, -1.0]) for i in range(40)] + [(40, None), (41, [1.0, None, 2.0]), (42, [nan, 0.0, 0.0]), (43, [1.0, 0.5]), (44, [inf, 0.0, 0.0]), (45, [1e200, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def distance(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        total = 0.0
        for x, y in zip(a, b):
            total += (y - x) * (y - x)
        return total**0.5 if total == total else nan

    asked = [r for r in rows if r[0] % 4 == 0 or r[0] > 40]
    wanted = []
    for q, e in asked:
        near = sorted((d is None, d != d, 0.0 if d is None or d != d else d, x, d) for x, y in rows for d in [distance(y, e)])
        wanted += [(q, x, str(d), n) for n, (_, _, _, x, d) in enumerate(near[:7], 1)]
    found = pairing.nearest(v.filter("vec_id % 4 = 0 or vec_id > 40"), v, 7, block=10).collect()
    assert sorted((r.query_id, r.vec_id, str(r.distance), r["rank"]) for r in found) == sorted(wanted)


def test_readers_tolerate_dirty_lines(spark, tmp_path):
    good = {"id": "a", "source": "s", "iac_tool": "docker", "file_path": "p", "code_before": "é", "code_after": None, "diff": None, "has_fix": True, "smells": [{"type": "x"}]}
    more = [good | {"id": "c", "unknown_key": 1}, good | {"id": "d", "smells": [{"type": "x", "odd": 1}]}, good | {"id": "e", "smells": [{"cwe": "x"}]}]
    (tmp_path / "r.jsonl").write_text(json.dumps(good) + "\n\n{bad\n" + "\n".join(map(json.dumps, [{"id": "b"}, *more])) + "\n[1]\n")
    rows = readers.read_records(spark, [str(tmp_path / "r.jsonl"), str(tmp_path / "missing.jsonl")])
    assert [r.id for r in rows.collect()] == ["a"] and sorted(r.id for r in readers.read_records(spark, str(tmp_path / "r.jsonl"), strict=False).collect()) == ["a", "b", "c", "d", "e"]
    assert readers.read_records(spark, str(tmp_path / "none.jsonl")).count() == 0
    sinks.write_splits(rows.withColumn("split", F.lit("odd")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().split == "train"


def test_scanner_push_and_cve_parsing(spark):
    run = {"results": {"failed_checks": [{"check_id": "CKV_1", "check_name": "n", "severity": "high", "file_line_range": [3, 4], "guideline": "see CWE-250"}]}}
    for raw in (json.dumps(run), json.dumps([run]), json.dumps(run) + "\n" + json.dumps(run)):
        found = spark.createDataFrame([(raw,)], "o string").select(F.explode(readers.scanner_checks(F.col("o"))).alias("c")).select(readers.checks_to_findings(F.col("c"), "checkov").alias("f")).collect()
        assert found[0].f.rule_id == "CKV_1" and found[0].f.severity == "HIGH" and found[0].f.cwe == "CWE-250" and found[0].f.line == 3
    push = [("PushEvent", ("o/terraform-x",), ("h", [("h",), ("g",)])), ("PushEvent", ("o/blog",), ("h", None)), ("Watch", ("o/k8s",), ("h", None))]
    events = spark.createDataFrame(push, "type string, repo struct<name: string>, payload struct<head: string, commits: array<struct<sha: string>>>")
    assert sorted(r.sha for r in readers.push_candidates(events).collect()) == ["g", "h"]
    feed = spark.createDataFrame([(7, ("CVE-1", [("en", "later")], [("https://github.com/o/r/commit/abcdef2",)])), (1, ("CVE-1", [("fr", "x"), ("en", "hello")], [("https://github.com/O/R.git/commit/abcdef1",), ("http://x",)]))], "ord long, cve struct<id: string, descriptions: array<struct<lang: string, value: string>>, references: array<struct<url: string>>>")
    assert readers.cve_seeds(feed).count() == 1
    seed = readers.cve_seeds(feed).first()
    assert (seed.owner, seed.repo, seed.commit_sha, seed.description) == ("O", "R", "abcdef1", "hello")


def test_streams_equal_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i * (40 if i % 5 == 0 else 3)), i % 2, "error" if i % 3 else "view", 1.0, "{}") for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events"))
    batch = spark.read.parquet(str(tmp_path / "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = lambda: monitor.read_events(spark, str(tmp_path / "events"), "*.parquet")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(monitor.run_to_table(monitor.rates(stream()), "rates")) == key(monitor.rates(batch))
    closed = monitor.run_to_table(monitor.sessions(stream()), "stalls", "append")
    assert set(key(closed)) <= set(key(monitor.sessions(batch)))
    assert monitor.run_to_table(monitor.dedup(stream(), ["user_id", "event_type"], "30 days"), "unique", "append").count() == 4


def test_every_query_has_an_oracle():
    import __spark_entry__ as entry

    missing = {q for q in entry.queries() if q not in entry.oracle_sql()}
    assert {q for q in missing if not q.startswith("op") and q != "pipeline"} == set()


def test_filters_and_trees(spark):
    from terrane.operators import filters

    tree = spark.createDataFrame([("blob", "a/main.tf", 10), ("blob", "a/main.tf", 10), ("blob", "a/big.tf", 10**6), ("tree", "a/x.tf", 1), ("blob", "a/readme.md", 1), ("blob", "b/Dockerfile", 1)], "type string, path string, size int")
    assert sorted(r.path for r in filters.tree_files(tree).collect()) == ["a/main.tf", "b/Dockerfile"] and filters.tree_files(tree, 1).count() == 1
    rows = spark.createDataFrame([("good/a.tf", "x", 0), ("bad/a.tf", "x", 0), ("good/b.tf", "x", 2), ("bad/c.tf", "", 0)], "path string, content string, n_smells int")
    got = {r.path: (r.code_before, r.code_after) for r in filters.good_or_bad(rows).collect()}
    assert got == {"bad/a.tf": ("x", None), "good/b.tf": ("x", "x")}
    sides = spark.createDataFrame([("q/positive1.tf", 0), ("q/negative/x.tf", 3), ("q/x.tf", 1), ("q/y.tf", 0)], "p string, n int").select(filters.example_side(F.col("p"), F.col("n")).alias("s"))
    assert [r.s for r in sides.collect()] == ["positive", "negative", "positive", "negative"]
    flags = spark.createDataFrame([("removed", "", "x", "docker", 0, "tidy"), (None, "a", None, "unknown", 0, "Fix CVE")], "st string, b string, p string, t string, n int, m string")
    out = flags.select(filters.alive(F.col("st")).alias("a"), filters.has_sides(F.col("b"), F.col("p"), F.col("t")).alias("h"), filters.has_signal(F.col("n"), F.col("m")).alias("s"), filters.message_signal(F.col("m")).alias("g"), filters.fits(F.col("m"), 4).alias("f"), filters.describes_code(F.col("t")).alias("d")).collect()
    assert [tuple(r) for r in out] == [(False, True, False, False, True, False), (True, False, True, True, False, False)]


def test_summaries(spark, tmp_path):
    from terrane.operators import summaries
    from terrane.plans import searches

    s = spark.createDataFrame([("exact", 2), ("partial", -1), ("unavailable", 0)], "code_before_quality string, smells_added int")
    r = summaries.salvage_stats(s).first()
    assert (r.total, r.exact, r.partial, r.unrecoverable, r.smells_added) == (3, 1, 1, 1, 2)
    scans = spark.createDataFrame([("tf", (3, 1)), ("tf", (1, 1))], "check_type string, summary struct<passed: int, failed: int>")
    assert tuple(summaries.scan_totals(scans).first()) == ("tf", 4, 2)
    calls = spark.createDataFrame([(1, a) for a in range(10)], "call_id long, attempt int")
    delays = [r.delay for r in summaries.backoff(calls).orderBy("attempt").collect()]
    assert all(int(0.75 * min(300, 2 * 2**a)) <= d < 1.25 * min(300, 2 * 2**a) and d >= 1 for a, d in enumerate(delays))
    smells = F.array(F.struct(F.lit("root_user").alias("type"), F.lit(3).alias("line"), F.lit("CWE-250").alias("cwe"), F.lit(None).cast("string").alias("description")))
    text = spark.range(1).select(summaries.explanation(smells, F.lit(2), F.lit(3)).alias("x")).first().x
    assert "### Root User" in text and "[CWE-250]" in text and text.endswith("Net change: -1 lines")
    halves = searches.halves(searches.commit_queries(spark).limit(7), "ord", str(tmp_path / "halves")).orderBy("ord").collect()
    assert [(r.half, r.odd) for r in halves] == [(1, 1), (1, 0), (1, 1), (1, 0), (2, 1), (2, 0), (2, 1)]
    items = spark.range(1).select(rec.dedupe_array(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(c).cast("string").alias("cwe"), F.lit(i).alias("n")) for i, (t, c) in enumerate([("a", None), ("a", None), ("a", "x"), ("b", None)])]), ["type", "cwe"]).alias("i")).first().i
    assert [x.n for x in items] == [0, 2, 3]


def test_table_functions_are_native(spark):
    from terrane.functions import table_functions

    table_functions.register(spark)
    spark.createDataFrame([(1, "privileged: true"), (2, None), (3, "privileged: true")], "i int, t string").createOrReplaceTempView("scripts")
    rows = spark.sql("SELECT i, s.type FROM scripts, LATERAL smells(t) s")
    assert sorted((r.i, r.type) for r in rows.collect()) == [(1, "privileged_container"), (3, "privileged_container")]
    listed = spark.sql("SELECT i, s.type FROM (SELECT i, smell_list(t) AS found FROM scripts) LATERAL VIEW inline(found) s AS type, match")
    assert sorted((r.i, r.type) for r in listed.collect()) == [(1, "privileged_container"), (3, "privileged_container")]
    for plan in (rows, listed):
        assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [r.smell.type for r in table_functions.smells_of(spark.table("scripts"), "t").collect()] == ["privileged_container"] * 2
