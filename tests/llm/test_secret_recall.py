"""Recall of bare random tokens by encoding and length, among twice as many tokens of text."""

import collections
import random

from pyspark.sql import functions as F

from terrane.llm import secrets

LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"lower": LOWER, "base36": LOWER + DIGITS, "base32": LOWER.upper() + "234567", "alnum": LOWER + LOWER.upper() + DIGITS, "base64": LOWER + LOWER.upper() + DIGITS + "+/"}
WORDS = "user account session handler request response number window default config service manager transport layer version internal buffer stream encode decode first second table column index".split()


def test_short_random_tokens_are_found(spark):
    random.seed(4)
    cases = [(name, n, "".join(random.choices(abc, k=n))) for name, abc in ALPHABETS.items() for n in (20, 24, 32, 40) for _ in range(100)]
    texts = []
    while len(texts) < 2 * len(cases):
        some = random.choices(WORDS, k=random.randint(4, 6))
        text = random.choice(["_".join(some), "-".join(some), "/".join(some), "".join(w.title() for w in some), "".join(some)]) + random.choice(["", "", "2", "256"])
        texts += [text] if 20 <= len(text) <= 60 else []
    docs = spark.createDataFrame([(i, f"value {t} end") for i, t in enumerate([t for *_, t in cases] + texts)], "doc_id long, text string")
    found = {r.doc_id for r in secrets.digest(secrets.secrets(docs)).collect() if r.spans}
    recall = collections.Counter()
    for i, (name, n, _) in enumerate(cases):
        recall[name, n] += i in found
    print(dict(recall), len([i for i in found if i >= len(cases)]))
    assert all(count >= (85 if name == "lower" else 95) for (name, n), count in recall.items())
    assert len([i for i in found if i >= len(cases)]) <= 0.01 * len(found)


def test_the_model_counts_the_words_of_all_documents(spark):
    """Each distinct word once, however many documents there are."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Qz zq-"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" x qz")).alias("text"))
    found = secrets.corpus_pairs(docs)
    words = {"qz", "zq"} | {w for i in range(3000) if len(w := str(i).translate(str.maketrans("0123456789", "abcdefghij"))) > 1}
    wanted = collections.Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    assert found == dict(wanted)
