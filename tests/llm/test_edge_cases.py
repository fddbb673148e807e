"""Empty tables, repeated rows, very long texts and clashing columns, for the operators whose other tests leave them out."""

import random
import re

from pyspark.sql import functions as F

from terrane.llm import decontam, html, licenses, pii, quality, secrets, sentencepiece

DOCS = "doc_id long, text string, row string, _row string, id string"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "r", "r", "i") for i, t in texts], DOCS)


def test_decontamination_of_empty_tables_and_clashing_columns(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    docs = rows_of(spark, [(1, phrase), (2, "else"), (None, None)])
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    found = decontam.decontaminate(docs, items.limit(0)).collect()
    assert len(found) == 3 and not any(r.contaminated or r.n_hit for r in found)
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]
    assert decontam.drop_contaminated(docs.limit(0), items).count() == 0 and decontam.drop_contaminated(docs, items.limit(0)).count() == 3


def test_positions_of_many_matches(spark):
    rng = random.Random(3)
    text = "é𝒳 " + " ".join("".join(rng.choices("abcXYZ019", k=rng.randint(3, 30))) for _ in range(1500))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "abc")], "doc_id long, text string")
    for r in docs.select("doc_id", secrets.spans(F.col("text"), "[a-z0-9]{2,}").alias("s"), "text").collect():
        assert [(x.s, x.e, x.v) for x in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer("[a-z0-9]{2,}", r.text)]


def test_tokens_apart_from_base_spans(spark):
    rng = random.Random(4)
    draw = lambda n, step: [(s, s + rng.randint(1, 9)) for s in range(0, n * step, step)]
    tokens, base = draw(900, 10), sorted((s + rng.randint(0, 9), e + 3) for s, e in draw(400, 17))
    frame = spark.createDataFrame([(tokens, base)], "t array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    found = frame.select(secrets._apart(F.col("t"), F.col("b")).alias("x")).first().x
    assert [(x.s, x.e) for x in found] == [t for t in tokens if not any(b[0] < t[1] and t[0] < b[1] for b in base)]


def test_personal_data_of_empty_tables_and_repeated_rows(spark):
    docs = rows_of(spark, [(1, "a.b@c.example.com 10.0.0.1"), (1, "a.b@c.example.com 10.0.0.1"), (2, None), (3, "x " * 200_000 + "a@b.cd")])
    found = pii.digest(pii.personal_data(docs)).collect()
    assert sorted((r.doc_id, r.n_email, r.n_ip) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 1, 0)]
    assert pii.personal_data(docs.limit(0)).count() == 0 and pii.mask(docs.limit(0)).columns == docs.columns


def test_pages_of_empty_tables_repeated_rows_and_clashing_columns(spark):
    page = "<html><body><nav>menu</nav><article><p>said &amp; done</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/1", page, "x", "y"), (1, "http://a.example/1", page, "x", "y"), (2, None, None, "x", "y")], "page_id long, url string, html string, low string, host string")
    found = html.extract(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in found) == [(1, "said & done", 11)] * 2 + [(2, "", 0)]
    assert html.extract(pages.limit(0)).count() == 0


def test_encoding_of_empty_tables(spark):
    assert sentencepiece.encode(rows_of(spark, []).limit(0)).count() == 0
    assert [r.n_ids for r in sentencepiece.encode(rows_of(spark, [(1, None), (1, "")])).collect()] == [0, 0]


def test_licenses_in_very_long_texts(spark):
    docs = rows_of(spark, [(1, "word " * 300_000 + "\nSPDX-License-Identifier: MIT\n"), (2, None)])
    assert licenses.scan(docs).count() == 2 and licenses.scan(docs.limit(0)).count() == 0


def test_quality_of_repeated_rows(spark):
    docs = rows_of(spark, [(1, "good words here " * 30)] * 3)
    found = quality.apply_policy(quality.ledger(docs)).collect()
    assert len(found) == 3 and len({str(r) for r in found}) == 1
