"""Proximity over all words of a window."""

from terrane.llm import decontam


def test_rare_words_alone_are_no_near_match(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    others = "alpha x beta x gamma x eta x theta x iota x kappa"
    rows = [(1, phrase), (2, phrase.replace("gamma", "gamma extra")), (4, "q1 q2 q3 delta epsilon zeta q7 q8 q9 q10"), (5, others), (6, others), (7, others)]
    windows = decontam.benchmark_windows(spark.createDataFrame([(9, phrase)], "item_id long, text string"))
    near = decontam.near_matches(decontam.build_index(spark.createDataFrame(rows, "doc_id long, text string"), windows), windows)
    assert {(r.doc_id, r.item_id) for r in near.collect()} == {(1, 9), (2, 9)}
