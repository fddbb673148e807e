"""Codes of vectors against plain Lloyd in whole numbers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from terrane.llm import codes

ROWS = "vec_id long, embedding array<float>, label int, code string, error long, q string"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd with Python integers: (result by row, digest)."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = [[math.floor(4096 * x) for x in np.array(r[1], dtype=np.float32).astype(float)] for r in kept]
    width = len(q[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in q]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(cut, code) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    code = assign()
    error = [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, code)]
    label = Counter()
    for r, e in zip(kept, error):
        label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{c:02x}" for c in cs), e, label[r[2]], sha) for r, cs, e in zip(kept, code, error))


def result(spark, rows):
    frame = spark.createDataFrame([(*r, "c", 1, "q") for r in rows], ROWS)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(frame).collect())


def vectors(seed, n, width=16, grid=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(grid)) if grid else (lambda: rng.gauss(0, 0.2))
    return [(i, [draw() for _ in range(width)], rng.choice([None, 0, 1, 2])) for i in range(n)]


def test_codes_equal_plain_lloyd(spark):
    rows = vectors(1, 300)
    assert result(spark, rows) == brute(rows)


def test_ties_repeated_rows_and_what_is_dropped(spark):
    rows = vectors(2, 200, grid=[-0.25, 0.0, 0.25, 0.0001, -0.0001])
    rows += [rows[20]] * 40 + [(900, None, 1), (901, [0.1] * 15 + [None], 1), (902, [0.1] * 15 + [float("nan")], 1), (903, [0.1] * 15 + [float("-inf")], 1), (None, [0.5] * 16, None), (None, [0.25] * 16, 2)]
    assert result(spark, rows) == brute(rows)


def test_few_rows_and_empty_tables(spark):
    rows = vectors(3, 5)
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == [] and result(spark, [(1, None, 1), (2, [], 1)]) == []


def test_other_lengths_are_dropped_and_large_components_held(spark):
    rows = vectors(4, 30)
    assert result(spark, rows + [(90, [0.1] * 8, 1), (91, [0.1] * 24, 1)]) == brute(rows)
    assert result(spark, [(0, [0.1] * 7, 1), (1, [0.2] * 7, 1)]) == []
    huge = result(spark, rows + [(95, [3e38] * 16, 1), (96, [-3e38] * 16, 1)])
    assert len(huge) == 32 and all(0 <= r[2] < 1 << 62 for r in huge)


def test_bounds_spare_scans_without_changing_codes():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(4000, 8)) * 800).astype(np.int64) + rng.choice([0, 9000, -9000], size=(4000, 1))
    book = x[:16].copy()
    group = codes.grouping(book[None])[0]
    code, upper, lower = codes.assign_all(x, book, group, codes.GROUPS)
    for step in range(6):
        moved = np.array([x[code == e].sum(0) // max(1, (code == e).sum()) if (code == e).any() else book[e] for e in range(16)])
        drift, book = np.sqrt(((moved - book).astype(float) ** 2).sum(1)), moved
        code, upper, lower, scanned = codes.assign_again(x, book, drift, group, code, upper, lower)
        assert (code == codes._distances(x, book).argmin(1)).all()
        assert scanned < 0.75 * x.shape[0] * 16
    assert scanned < 0.5 * x.shape[0] * 16
