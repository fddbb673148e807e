"""Language identification: held-out accuracy, the contract's cases, and features against a plain version."""

import random
import zlib
from collections import Counter

import numpy as np

from terrane.llm import langid

DOCS = "doc_id long, text string, lang string, source string, score string, rejected string, _text string"
WORDS = {
    "en": "the of and to in was that with from which there their would about house water light",
    "de": "der die und das nicht eine auch sich werden haben über schön straße wasser licht haus",
    "fr": "le la les des une dans pour que avec être où garçon lumière maison eau très déjà",
}


def docs_of(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(8, 60))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "x", "y", "z") for r in rows], DOCS)


def test_held_out_accuracy_and_split(spark):
    rows = docs_of(1, 400)
    found = langid.identify(frame(spark, rows)).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(found) == 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    out = [r for r in found if r.held_out]
    assert len(out) > 60 and sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) >= 0.98
    assert all(0 <= r.score <= 1 for r in found) and sum(r.rejected for r in found) < 40


def test_predictions_use_only_the_text(spark):
    rows = docs_of(2, 200)
    model = langid.fit(frame(spark, rows))
    one = {r.doc_id: r.lang_pred for r in langid.predict(frame(spark, rows), model).collect()}
    other = {r.doc_id - 5000: r.lang_pred for r in langid.predict(frame(spark, [(i + 5000, t, "xx") for i, t, _ in rows]), model).collect()}
    assert one == other
    # What is held out is not learned from.
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    assert "zz" not in set(langid.fit(frame(spark, wrong)).langs)


def test_und_rejection_and_odd_rows(spark):
    rows = docs_of(3, 200)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 -- 34 !!", "en"), (1003, "漢字仮名交文漢字", None), (1004, rows[0][1], None), (None, rows[1][1], None), (1005, rows[2][1], rows[2][2]), (1005, rows[2][1], rows[2][2])]
    found = langid.identify(frame(spark, rows + odd)).collect()
    by = {r.doc_id: r for r in found if r.doc_id is None or r.doc_id >= 1000}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, False) for i in (1000, 1001, 1002))
    assert by[1003].rejected and by[1003].lang_pred in WORDS and by[1003].score < 0.2
    assert by[1004].lang_pred == rows[0][2] and by[None].lang_pred == rows[1][2] and sum(r.doc_id == 1005 for r in found) == 2


def test_nothing_to_learn_from_and_empty_tables(spark):
    assert {r.lang_pred for r in langid.identify(frame(spark, [(1, "some words", None), (2, "others", None)])).collect()} == {"und"}
    assert langid.identify(frame(spark, []).limit(0)).collect() == []


def test_counts_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = "Être, où?  Déjà-vu 123 the END  " * 7 + "fin"

    def plain(t):
        seen, low = Counter(), "".join(c if c.isalpha() else " " for c in t.lower())
        low = " " + " ".join(low.split()) + " "
        for n in (1, 2, 3):
            seen.update(g for g in (low[i : i + n] for i in range(len(low) - n + 1)) if g.strip())
        return sum(seen.values())

    whole = langid.counts(text)
    assert whole.sum() == plain(text)
    for piece in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (langid.counts(text) == whole).all()
    assert langid.counts("1 2 3") is None and langid.counts("") is None


def test_samples_are_bounded(spark):
    rows = docs_of(4, 600)
    drawn, names = langid.training_rows(frame(spark, rows), sample=40)
    assert names == sorted(WORDS) and 60 < drawn.count() < 190
    assert np.allclose([np.linalg.norm(c) for c in langid.fit(frame(spark, rows), sample=40).centroids], 1, atol=1e-3)
