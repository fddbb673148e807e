"""Near duplicates among rows that share ids, repeat or have none."""

import random
from collections import Counter

from terrane.llm import neardup


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, _k1 string")


def text(seed, words=40, changed=0):
    rng, other = random.Random(seed), random.Random(-1 - seed)
    out = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for i in range(changed):
        out[i] = f"x{other.randrange(10**6)}"
    return " ".join(out)


def test_unrelated_texts_of_one_id_all_stay(spark):
    rows = [(1, text(1), "a"), (1, text(2), "b"), (2, text(3), "c")]
    found = neardup.near_duplicates(docs_of(spark, rows)).collect()
    assert len({r.class_id for r in found}) == 3 and all(r.representative for r in found)
    assert sorted(r["_k1"] for r in neardup.drop_near_duplicates(docs_of(spark, rows)).collect()) == ["a", "b", "c"]


def test_classes_go_by_text_where_ids_are_shared(spark):
    rows = [(1, text(1), "a"), (1, text(2), "b"), (7, text(1, changed=1), "c"), (8, text(2, changed=1), "d"), (1, text(1).upper(), "e"), (9, text(9), "f"), (9, text(9), "f"), (0, text(2), "g")]
    found = neardup.near_duplicates(docs_of(spark, rows)).collect()
    of = {(r.doc_id, r.class_id) for r in found}
    assert len({c for _, c in of}) == 3 and len(found) == len(rows)
    first = next(c for d, c in of if d == 7)
    assert Counter(r.class_id for r in found)[first] == 3
    assert next(c for d, c in of if d == 8) == 0
    kept = neardup.drop_near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 9] and next(r.text for r in kept if r.doc_id == 1) == text(1).upper()


def test_rows_without_an_id_never_go(spark):
    rows = [(None, text(1), "a"), (5, text(1, changed=1), "b"), (6, text(1), "c"), (None, None, "d"), (None, text(1), "e")]
    found = neardup.near_duplicates(docs_of(spark, rows)).collect()
    assert Counter(r.class_id for r in found)[5] == 4
    kept = neardup.drop_near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["5", "None", "None", "None"]


def test_chains_of_links_are_one_class(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (100, 60)], "a long, b long")
    found = {(r.node, r.root) for r in neardup.components(links).collect()}
    assert found == {(i, 0) for i in range(21)} | {(n, 50) for n in (50, 60, 70, 100)}
    more = spark.createDataFrame([(20, 60), (300, 301), (301, 302)], "a long, b long")
    moved = {(r.node, r.root) for r in neardup._joined_up(neardup.components(links), more).collect()}
    assert moved == {(i, 0) for i in [*range(21), 50, 60, 70, 100]} | {(n, 300) for n in (300, 301, 302)}
