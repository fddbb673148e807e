"""Decontamination of documents that occur in several equal rows."""

import pytest

from terrane.llm import decontam


@pytest.mark.parametrize("anchors", [1, 3, 100])
def test_repeated_rows_stay_contaminated(spark, anchors):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"intro {phrase} end")] * 2 + [(2, phrase)] + [(3, phrase.replace("beta", "other"))] * 3 + [(None, phrase)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, phrase)], "item_id long, text string")
    found = decontam.decontaminate(docs, items, anchors=anchors).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found) == sorted(
        [("1", 12, 10, 1, True)] * 2 + [("2", 10, 10, 1, True)] + [("3", 10, 0, 0, False)] * 3 + [("None", 10, 10, 1, True)] * 3
    )
    assert [r.doc_id for r in decontam.drop_contaminated(docs, items).collect()] == [3] * 3
