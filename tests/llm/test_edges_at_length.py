"""Long fields, long pages, mixed lengths of words, and the pipeline over odd and empty tables."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from terrane.llm import html, licenses, neardup, pii, sentencepiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return sorted((str(r.doc_id) for r in corpus_pipeline.run(spark, str(path)).collect()))


def test_pipeline_over_repeated_rows_null_ids_and_empty_tables(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    one, two, three, bench = say(120), say(130), say(140), say(30)
    rows = [(1, one), (1, one), (2, two), (None, three), (None, None), (3, f"{say(60)} {bench} {say(60)}")]
    assert set(tables(spark, tmp_path / "a", rows, [(7, bench)])) == {"1", "2", "None"}
    assert set(tables(spark, tmp_path / "b", rows, [])) == {"1", "2", "3", "None"}
    assert tables(spark, tmp_path / "c", [], [(7, bench)]) == [] and tables(spark, tmp_path / "d", [], []) == []


def test_a_long_text_with_a_large_field(spark):
    rng = random.Random(9)
    phone = "+49 170 1234567"
    words = [rng.choice(("call", "4917012345678901"[: rng.randint(9, 15)], phone, "491701234567", f"{rng.randint(10**9, 10**10)}")) for _ in range(20_000)]
    docs = spark.createDataFrame([(1, "; ".join(words))], "doc_id long, text string")
    found = pii.digest(pii.personal_data(docs)).first()
    assert found.n_phone == sum(w == phone for w in words)
    bare = sum(w == "491701234567" for w in words)
    assert found.spans.count("phone:") >= found.n_phone + 0.95 * bare


def test_a_very_long_page(spark):
    body = "".join(f"<p>paragraph {i} &amp; more</p>" for i in range(60_000))
    rows = [(i, "http://h.example/x", f"<html><body><nav>menu</nav><article>{body}<p>{i}</p></article></body></html>") for i in range(2)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.count("\n") == 60_000 and r.text.startswith("paragraph 0 & more\n") and r.n_chars == len(r.text) for r in found)


def test_long_and_usual_words_in_repeated_rows(spark):
    rng = random.Random(10)
    long = "".join(rng.choices("abcdefgh", k=sentencepiece.MATRIX_LENGTH * 3))
    text = f"the usual words and {long} the usual words"
    frame = spark.createDataFrame([(1, text), (1, text), (2, "the usual words")], "doc_id long, text string")
    rows = sentencepiece.encode(frame).collect()
    assert len(rows) == 3 and all(r.round_trip for r in rows) and len({str(r.ids) for r in rows if r.doc_id == 1}) == 1


def test_license_scan_of_an_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_of_digits_as_strings(spark):
    docs = spark.createDataFrame([("7", "one two three four five six"), ("8", "one two three four five six"), ("9", "other words of another text here")], "doc_id string, text string")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.select(F.col("doc_id")).collect()) == ["7", "9"]
