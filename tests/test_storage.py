"""Planned sources, load order, bucketed stores, counted writes, splits and the exact neighbour index."""

import json
import random

from pyspark.sql import functions as F

from terrane.operators import pairing
from terrane.operators import records as rec
from terrane.sources import connector, readers, sinks
from terrane.streaming import stateful


def page(folder, unit, number, *shas):
    at = folder / f"unit={unit}" / f"page={number}"
    at.mkdir(parents=True)
    (at / "part-0.txt").write_text(json.dumps({"unit": unit, "page": number, "items": [{"sha": s} for s in shas]}))


def taken(rows):
    return sorted((r.unit, r.page, json.loads(r.item)["sha"]) for r in rows.collect())


def test_filters_drop_pages_before_they_are_opened(spark, tmp_path):
    connector.register(spark)
    for unit, number in (("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c d", 1)):
        page(tmp_path, unit.replace(" ", "%20"), number, f"{unit}{number}x", f"{unit}{number}y")
    # A page that can't be read doesn't hurt who doesn't want it.
    (tmp_path / "unit=b" / "page=2" / "part-0.txt").write_text("{torn")
    load = lambda: spark.read.format("recorded").option("path", str(tmp_path)).option("pagesATask", 1).load()
    assert load().rdd.getNumPartitions() == 5
    for kept, expected in (
        ((F.col("unit") == "a") & (F.col("page") > 1), [("a", 2)]),
        (~F.col("unit").isin("a", "b"), [("c d", 1)]),
        ((F.col("page") <= 1) & F.col("item").contains("1x"), [("a", 1), ("b", 1), ("c d", 1)]),
        ((F.col("unit") != "b") & (F.col("page") >= 2), [("a", 2)]),
    ):
        rows = load().filter(kept)
        assert {(u, n) for u, n, _ in taken(rows)} == set(expected) and rows.rdd.getNumPartitions() == len(expected)
    assert load().filter("unit = 'none'").count() == 0
    assert spark.read.format("recorded").option("path", f"{tmp_path}/missing").load().count() == 0


def test_a_stream_goes_on_after_its_marks(spark, tmp_path):
    connector.register(spark)
    pages, out = tmp_path / "pages", str(tmp_path / "out")
    run = lambda: stateful.run_available(spark.readStream.format("recorded").option("path", str(pages)).load(), out, str(tmp_path / "marks"))
    page(pages, "a", 1, "1"), page(pages, "b", 4, "2")
    run(), run()
    page(pages, "a", 2, "3"), page(pages, "c", 1, "4")
    run()
    assert taken(spark.read.schema("unit string, page int, item string").parquet(out)) == [("a", 1, "1"), ("a", 2, "3"), ("b", 4, "2"), ("c", 1, "4")]


def line(name, text):
    return json.dumps({"id": name, "source": "s", "iac_tool": "docker", "file_path": "p", "code_before": text, "code_after": None, "diff": None, "has_fix": False, "smells": []}) + "\n"


def test_lines_load_in_the_order_of_inputs_files_and_lines(spark, tmp_path):
    (tmp_path / "z.jsonl").write_text(line("z0", "same"))
    (tmp_path / "b.jsonl").write_text("".join(line(f"b{i:03}", "same" if i % 2 else f"other {i}") for i in range(200)))
    (tmp_path / "a.jsonl").write_text(line("a0", "other 0") + line("a1", "same"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for fast in (False, True):
            rows = readers.read_records(spark, [str(tmp_path / f"{x}.jsonl") for x in "zba"], fail_fast=fast)
            assert [r.id for r in rows.orderBy("ord").collect()] == ["z0", *[f"b{i:03}" for i in range(200)], "a0", "a1"]
        globbed = readers.read_records(spark, f"{tmp_path}/*.jsonl")
        assert [r.id for r in globbed.orderBy("ord").collect()][:3] == ["a0", "a1", "b000"]
        once = rec.dedup_best(rows.select("id", F.col("code_before").alias("content_hash"), "has_fix", F.size("smells").alias("n_smells"), "ord"))
        assert {r.content_hash: r.id for r in once.collect() if r.content_hash in ("same", "other 0")} == {"same": "z0", "other 0": "b000"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_joins_on_a_bucketed_store_shuffle_the_other_side_only(spark):
    old = spark.range(1000).select(F.col("id").alias("key"), F.lit("stored text").alias("text"))
    stored = sinks.write_bucketed(old, "stored_keys", ["key"], 4)
    try:
        new = spark.range(990, 1010).select(F.col("id").alias("key"))
        rows = pairing.not_stored(new, stored, ["key"])
        plan = rows._jdf.queryExecution().executedPlan().toString()
        right = plan[plan.rindex("Sort ["):]
        assert "stored_keys" in right and "Exchange" not in right
        assert sorted(r.key for r in rows.collect()) == list(range(1000, 1010))
    finally:
        spark.sql("DROP TABLE stored_keys")


def test_splits_read_their_input_once_and_shuffle_no_text(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"r{i}", rng.choice(["x", "y", None]), "text") for i in range(700)] + [("only", "lone", "text")]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    frame = spark.createDataFrame(rows, "id string, tool string, code string")
    frame = frame.mapInPandas(count, frame.schema)
    found = rec.assign_splits(frame, ["tool"], 7, folder=str(tmp_path / "rows"))
    got = found.collect()
    assert seen.value == len(rows) and len(got) == len(rows)
    for tool in {t for _, t, _ in rows}:
        n = sum(t == tool for _, t, _ in rows)
        sizes = [sum(r.split == s and r.tool == tool for r in got) for s in ("train", "val", "test")]
        assert sizes == [int(n * 0.8), int(n * 0.1), n - int(n * 0.8) - int(n * 0.1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_counters_are_taken_while_writing(spark, tmp_path):
    rows = spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    found = sinks.write_counted(rows, str(tmp_path / "w"), n=F.count(F.lit(1)), odd=F.count_if("odd"), most=F.max("id"))
    assert tuple(found.first()) == (100, 50, 99) and spark.read.parquet(str(tmp_path / "w")).count() == 100
    empty = sinks.write_counted(rows.limit(0), str(tmp_path / "e"), n=F.count(F.lit(1)), most=F.max("id")).first()
    assert tuple(empty) == (0, None)


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    old = spark.range(200).select("id", F.lit("old").alias("text"))
    sinks.upsert_knowledge(old, path, buckets=16)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    first = files()
    new = spark.createDataFrame([(3, "new"), (900, "new")], "id long, text string")
    stored = sinks.upsert_knowledge(new, path, buckets=16)
    assert {r.id: r.text for r in stored.collect()} == {**{i: "old" for i in range(200)}, 3: "new", 900: "new"}
    assert len(set(first.items()) & set(files().items())) >= 14 and sinks.upsert_knowledge(new.limit(0), path, buckets=16).count() == 201


def test_the_index_by_radii_is_exact(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(4 * (i % 5), 1) for _ in range(4)]) for i in range(400)] + [(400 + i, [0.5] * 4) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = v.filter("vec_id % 20 = 0")
    pairs = lambda df: sorted((r.query_id, r.vec_id, r["rank"]) for r in df.collect())
    for k in (3, 80):
        assert pairs(pairing.nearest_by_radii(asked, v, k, str(tmp_path / f"i{k}"), cells=8, block=50)) == pairs(pairing.nearest(asked, v, k))
    few = v.filter("vec_id < 4")
    assert pairs(pairing.nearest_by_radii(few, few, 9, str(tmp_path / "few"), cells=8)) == pairs(pairing.nearest(few, few, 9))


def test_fail_fast_reads_lines_that_lack_keys(spark):
    """The query's lines are of every kind that reading may take, one for each document."""
    from terrane import io_oracles, io_queries

    found = io_queries.read_fail_fast(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert {r.has_fix for r in found} == {False, None} and "% 6" in io_oracles.ORACLES["read_fail_fast"]
