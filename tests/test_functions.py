"""Scalar building blocks, rules and patches."""

import re

import pytest
from pyspark.sql import functions as F

from terrane.functions import patches, rules, text, tools


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


POSITIVE = {
    "hardcoded_password": 'password = "hunter22"',
    "overly_permissive_cidr": 'cidr_blocks = ["0.0.0.0/0"]',
    "privileged_container": "privileged: true",
    "root_user": "FROM x:1\nUSER root\n",
    "missing_encryption": "storage_encrypted = false",
    "unpinned_base_image": "FROM ubuntu:latest",
    "overly_permissive_iam": '"Action": "*"',
    "weak_hash": "md5(x)",
    "uri_credentials": "postgres://a:b@host",
    "apt_no_install_recommends": "RUN apt-get install curl",
    "become_root": "become: yes\n  become_user: root",
    "insecure_tls": "sslProtocols = TLSv1.0",
    "hardcoded_credential": "ghp_" + "a" * 36,
    "missing_resource_limits": "resources: {}",
    "ssh_port_open_world": 'from_port = 22\n cidr_blocks = ["0.0.0.0/0"]',
}


@pytest.mark.parametrize("name", POSITIVE)
def test_rule_fires(spark, name):
    found = one(spark, rules.annotations(F.col("t"), F.lower("t")), t=POSITIVE[name])
    hit = [s for s in found if s.type == name]
    assert len(hit) == 1 and hit[0].cwe and hit[0].severity and hit[0].description.startswith("Pattern match: ")


def test_clean_text_and_single_annotation(spark):
    assert one(spark, rules.annotations(F.col("t"), F.lower("t")), t="nothing to see here\nat all") == []
    types = [s.type for s in one(spark, rules.annotations(F.col("t"), F.lower("t")), t='password = "hunter22"\npasswd = "hunter33"\nencrypted = false\n"Encrypted": false')]
    assert sorted(types) == ["hardcoded_password", "missing_encryption"]
    assert one(spark, rules.annotations(F.col("t"), F.lower("t")), t="RUN apt-get install --no-install-recommends curl") == []
    assert one(spark, rules.annotations(F.col("t"), F.lower("t")), t="FROM scratch\n") == []


def test_guards_are_necessary_literals():
    assert len(rules.RULES) == 41 and sum(len(p) for _, p in rules.RULES) == 142 and len({n for n, _ in rules.RULES}) == 36 and len(rules.TAXONOMY) == 41
    for _, patterns in rules.RULES:
        for p in patterns:
            literal = rules.required_literal(p)
            assert literal is None or literal == literal.lower()
    assert rules.required_literal(r"https?://x") == "http" and rules.required_literal(r"(abc|def)\s+[xyz]+") is None
    for sample in POSITIVE.values():
        for _, patterns in rules.RULES:
            for p in patterns:
                literal = rules.required_literal(p)
                if literal and re.search(p, sample, re.I | re.M):
                    assert literal in sample.lower()
                if re.search(p, sample, re.I | re.M):
                    assert not rules.guards(p) or any(g in sample.lower() for g in rules.guards(p))
                    assert all(c in sample for c in rules.required_signs(p))
    assert rules.guards(r"\b(md5|sha1)\s*\(") == ["md5", "sha1"] and rules.guards(r"(ab|cde)x?") == rules.guards(r"(abc|def)?") == []
    assert rules.required_signs(r"a_b\s*[=:]\s*\{-?\}") == ["_", "{", "}"]


def test_rules_take_the_lower_case_once(spark):
    """Spark shares nothing inside of array functions: each guard would lower the text anew."""
    from terrane.functions import table_functions

    rows = spark.createDataFrame([("x",)], "t string")
    plan = rows.select(rules.smells(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(t#") <= 1
    assert table_functions.smells_sql("t").count("lower(t)") == 1


@pytest.mark.parametrize(
    ("path", "content", "tool"),
    [
        ("a/Dockerfile", "", "docker"), ("x.dockerfile", "", "docker"), ("main.tf", "kind: Pod", "terraform"), ("v.tfvars", "", "terraform"),
        ("t.yaml", "AWSTemplateFormatVersion: 1", "cloudformation"), ("d.yaml", "apiVersion: apps/v1", "kubernetes"), ("p.yml", "- name: x", "ansible"),
        ("f.txt", 'resource "aws_s3_bucket" "b" {}', "terraform"), ("f.txt", "\n FROM alpine", "docker"), ("k8s/a.yaml", "", "kubernetes"), ("roles/a.yml", "x", "ansible"), ("readme.md", "hello", "unknown"),
    ],
)
def test_detect_tool(spark, path, content, tool):
    assert one(spark, tools.detect_tool(F.col("p"), F.col("c")), p=path, c=content) == tool


def test_other_tool_rules(spark):
    assert one(spark, tools.analyzer_tool(F.col("p"), F.col("c")), p="a.yaml", c="apiVersion: v1\n- name: x") == "kubernetes"
    assert one(spark, tools.guess_tool(F.col("p"), F.col("c")), p="a.yaml", c="x") == "kubernetes"
    assert one(spark, tools.platform(F.col("p"), F.col("c")), p="a.json", c="x") == "CloudFormation"
    assert one(spark, tools.is_config_path(F.col("p")), p="x/Vagrantfile") and not one(spark, tools.is_config_path(F.col("p")), p="x/.tf")


def test_metrics_lines_and_hashes(spark):
    m = one(spark, text.text_metrics(F.col("t")), t="a b\r\n\n# c\n  // d\x0be\n")
    assert (m.line_count, m.token_count, m.blank_lines, m.comment_lines) == (5, 7, 1, 2)
    assert len(one(spark, text.content_hash(F.col("t")), t="é")) == 64
    assert one(spark, text.record_id("GH", F.col("a"), F.col("b")), a="r", b="s").startswith("GH-")
    assert one(spark, text.decode_base64(F.col("t")), t="aGVs\nbG8=") == "hello"
    labels = text.labels(F.array(F.lit("b"), F.lit(None).cast("string")), F.array(F.lit("HIGH")), F.array(F.lit("")), F.col("t"))
    assert one(spark, labels, t="docker") == ["HIGH", "b", "docker"]


DIFF = "--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c"


def test_diffs(spark):
    assert one(spark, text.diff_side(F.col("d"), "-"), d=DIFF) == "b" and one(spark, text.diff_side(F.col("d"), "+"), d=DIFF) == "B"
    s = one(spark, text.diff_stats(F.col("d")), d=DIFF)
    assert (s.added, s.removed, s.net) == (1, 1, 0)
    assert one(spark, text.parse_response(F.col("d")), d="Sure:\n```diff\n" + DIFF + "\n```\nbye") == DIFF
    assert one(spark, text.parse_response(F.col("d")), d="plain") == "plain"
    assert one(spark, text.normalise_diff(F.col("d")), d="  a   b\n\n# c\n// d\ne") == "a b\ne"


def test_patches(spark):
    assert patches.reverse_apply("a\nB\nc", DIFF) == ("a\nb\nc", "exact")
    assert patches.reverse_apply("a\nB\nc\nd", DIFF) == ("a\nb\nc\nd", "partial")
    assert patches.reverse_apply("x\ny", "-z\n+y") == ("x\nz", "heuristic")
    assert patches.apply("a\nb\nc\n", DIFF) == "a\nB\nc\n"
    assert patches.apply("0\n1\na\nb\nc", DIFF.replace("-1,3", "-9,7")) == "0\n1\na\nB\nc" and patches.apply("q", DIFF) is None
    made = patches.unified("a\nb\n", "a\nc\n")
    assert patches.apply("a\nb\n", made) == "a\nc\n" and patches.unified("x", made) == made
    row = spark.createDataFrame([("a\nB\nc", DIFF)], "a string, d string").select(patches.reverse_patch("a", "d").alias("r"), patches.apply_patch(F.lit("a\nb\nc"), "d").alias("f")).first()
    assert row.r.text == "a\nb\nc" and row.r.quality == "exact" and row.f == "a\nB\nc"


def test_answers_are_evaluated_once(spark):
    from terrane.functions import text

    rows = spark.createDataFrame([("```diff\n--- a\n+++ b\n+x\n```\nend",), ("no diff",)], "t string")
    made = rows.select(text.parse_response(F.upper("t")).alias("p"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("upper(t#") <= 1
    assert [r.p for r in rows.select(text.parse_response(F.col("t")).alias("p")).collect()] == ["--- a\n+++ b\n+x", "no diff"]


def test_patches_take_texts_by_slices():
    """Of a batch only a slice's texts are Python strings at once."""
    import gc

    import pyarrow as pa

    from terrane.functions import patches

    class Text(str):
        pass

    most = 0

    def made(before, after):
        nonlocal most
        out = Text(before + after)
        most = max(most, sum(isinstance(x, Text) for x in gc.get_objects()) if len(before) % 50 == 0 else 0)
        return out

    rows = [None if i % 7 == 0 else "x" * i for i in range(1000)]
    found = patches._by_slices(pa.string(), made, pa.array(rows), pa.array(["y"] * 1000))
    assert found.to_pylist() == [(r or "") + "y" for r in rows] and most <= 2 * patches.SLICE
