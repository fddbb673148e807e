"""Records from recorded answers, restarts, limits and stores."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from terrane.functions import patches
from terrane.operators import evaluation, pairing
from terrane.operators import records as rec
from terrane.plans import acquisition, corpus
from terrane.sources import readers, schemas, sinks
from terrane.streaming import monitor


def test_commit_records_undo_patches(spark):
    after = "resource x\nfixed\nend"
    patch = "@@ -1,3 +1,3 @@\n resource x\n-acl = \"public-read\"\n+fixed\n end"
    files = [("main.tf", "modified", patch, "raw"), ("gone.tf", "removed", patch, "raw"), ("notes.md", "modified", patch, "raw"), ("new.tf", "added", "", "raw")]
    commits = spark.createDataFrame([("o/r", "s1", [("p1",)], ("tidy", ("me", "now")), files)], schemas.COMMIT)
    contents = spark.createDataFrame([("o/r", "main.tf", "s1", after)], "repo string, path string, ref string, content string")
    repos = spark.createDataFrame([("o/r", 3, "d")], "repo string, repo_stars int, repo_description string")
    found = acquisition.commit_records(commits, contents, repos).collect()
    assert [(r.file_path, r.code_before_quality, r.code_before, r.repo_stars) for r in found] == [("main.tf", "exact", 'resource x\nacl = "public-read"\nend', 3)]
    assert [s.type for s in found[0].smells] == ["overly_permissive_acl"]


def test_lines_without_a_hunk_are_undone_by_their_signs():
    assert patches.reverse_apply("a\nadded\nb", "-old\n+added\n--- x\n+++ y") == ("a\nb\nold", "heuristic")


def test_new_files_are_classified_anew(spark):
    row = ("new_file", None, "privileged: true\nprivileged: true", None, True, ["a", "a"], "kubernetes")
    frame = spark.createDataFrame([row], "code_before_quality string, code_before string, code_after string, diff string, has_fix boolean, smell_types array<string>, iac_tool string")
    none = F.array().cast("array<string>")
    found = rec.normalise(frame.withColumns({"rules_before": none, "rules_after": none, "commit_message": F.lit("")})).first()
    assert [s.type for s in found.smells] == ["a", "privileged_container"] and found.n_smells == 2 and found.tier == "C" and not found.has_fix
    assert found.labels == ["CWE-250", "HIGH", "a", "kubernetes", "privileged_container"]


def test_truths_without_a_check_stay_out(spark):
    det = spark.createDataFrame([(1, "f", "heuristic", 3), (2, "f", None, 3), (3, "f", "C", 30)], "det_id long, file string, check string, line int")
    gt = spark.createDataFrame([(1, "f", "HEURISTIC", 3), (2, "f", None, 4), (3, "f", "C", 3)], "gt_id long, file string, check string, line int")
    assert [(r.tp, r.fp, r.fn) for r in evaluation.detection_counts(det, gt, 5).collect()] == [(1, 2, 1)]


def test_parsers_of_empty_and_torn_reports(spark):
    rows = spark.createDataFrame([("",), ("{",), ("{}",), (None,)], "o string")
    for parse in (readers.checkov_findings, readers.tfsec_findings, readers.kics_findings):
        assert [len(r.f or []) for r in rows.select(parse(F.col("o")).alias("f")).collect()] == [0] * 4


def test_names_in_templates_are_not_filled_twice(spark):
    one = spark.range(1).select(corpus.chat_messages(F.lit("{smells}"), F.array(F.lit("a"), F.lit("b")), F.lit("x"), F.lit("y")).alias("m")).first().m
    assert "following {smells} script. Detected smells: a, b." in one[0].content and one[1].content == "y"


def test_recorded_pages_and_texts(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"unit": "q", "page": 2, "items": [{"repo": "a/b", "sha": "1"}, {"repo": "a/b", "sha": "2"}]}))
    rows = readers.read_recorded(spark, str(tmp_path), schemas.COMMIT).collect()
    assert [(r.page, r.sha) for r in rows] == [(2, "1"), (2, "2")]
    sinks.write_text(spark, str(tmp_path / "t.txt"), "é")
    sinks.write_text(spark, str(tmp_path / "t.txt"), "é again")
    assert (tmp_path / "t.txt").read_text() == "é again" and not list(tmp_path.glob("t.txt.*"))


def test_positions_are_gapless(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") * 37 % 101).alias("k")).repartition(5)
    found = rec.positions(rows, [F.col("k")], str(tmp_path / "runs")).collect()
    assert [r.k for r in sorted(found, key=lambda r: r.position)] == sorted(r.k for r in found) and sorted(r.position for r in found) == list(range(100))


def test_cells_find_most_neighbours(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 3) for _ in range(8)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 1) for x in centres[i % 30]]) for i in range(900)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = v.filter("vec_id % 20 = 0")
    pairs = lambda found: {(r.query_id, r.vec_id) for r in found.collect()}
    exact = pairs(pairing.nearest(asked, v, 5))
    assert pairs(pairing.nearest_by_cells(asked, v, 5, 16, 16)) == exact
    recall = len(pairs(pairing.nearest_by_cells(asked, v, 5, 32, 8)) & exact) / len(exact)
    assert recall >= 0.9, recall


def test_throttle_and_pauses(spark):
    calls = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 5.0), (4, 5.1)], "id long, at double").withColumn("who", F.lit("a"))
    starts = [r.start for r in monitor.throttle(calls, "who", "id", "at", 1.0).orderBy("id").collect()]
    assert starts == pytest.approx([0.0, 1.0, 5.0, 6.0])
    fails = spark.createDataFrame([(i, i != 4) for i in range(1, 12)], "id long, failed boolean").withColumns({"who": F.lit("a"), "ts": F.timestamp_seconds("id")})
    found = monitor.breaker(fails, "who", "id", F.col("failed"), 3, "ts").orderBy("id").collect()
    assert [r.id for r in found if r.opens] == [3, 7, 10]
    assert [r.paused_until is None for r in found][:3] == [True, True, False]


def test_supervision_starts_again():
    slept, ends = [], [monitor.Stalled(), StreamingQueryException("x"), None]

    class Query:
        def awaitTermination(self):
            if end := ends.pop(0):
                raise end

    assert monitor.supervise(Query, sleep=slept.append) == 3 and slept == [monitor.AFTER_STALL, monitor.AFTER_FAILURE]
    assert monitor.supervise(Query, most_hours=0) == 0
