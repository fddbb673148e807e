"""Messages of the personal-data field against exact marginals, by enumeration of small fields."""

import itertools
import math

import pytest

from terrane.llm import pii


def exact(text):
    """(nodes, marginals): the field of a text, built anew and enumerated over all labels of nodes and hubs."""
    base = pii.base_spans(text)
    nodes = pii._nodes(text, base)
    none, groups = len(pii.KINDS), {}
    unary = []
    for i, (s, e, form, kind) in enumerate(nodes):
        keys = {f"form {form}", *pii._similar(form)}
        if kind == 0 and pii._name(text[s:e]):
            keys.add(f"form {pii._name(text[s:e])}")
        for key in keys:
            groups.setdefault(key, []).append(i)
        core, score = text[s:e], [0.0] * none + [pii.PRIOR_NONE]
        digits = sum(c.isdigit() for c in core)
        if kind >= 0:
            score[kind] += pii.SEEDED
        else:
            shapes = ("@" in core, core.count(".") == 3 and digits >= 4, 14 <= digits <= 19, 10 <= digits <= 15 and core[0] in "+0(")
            score = [x + pii.SHAPE * bool(y) for x, y in zip(score, [*shapes, False])]
        unary.append(score)
    hubs = [(key, at) for key, at in groups.items() if len(at) > 1]
    edges = [(i, i + 1, pii.CHAIN) for i in range(len(nodes) - 1)]
    edges += [(i, len(nodes) + h, pii.SKIP if key.startswith("form ") else pii.SIMILAR) for h, (key, at) in enumerate(hubs) for i in at]
    total = [[0.0] * (none + 1) for _ in nodes]
    for labels in itertools.product(range(none + 1), repeat=len(nodes) + len(hubs)):
        weight = math.exp(sum(unary[i][labels[i]] for i in range(len(nodes))) + sum(w for a, b, w in edges if labels[a] == labels[b]))
        for i in range(len(nodes)):
            total[i][labels[i]] += weight
    return nodes, [[x / sum(row) for x in row] for row in total]


@pytest.mark.parametrize(
    "text",
    [
        "Call +49 170 1234567 today or 491701234567 later",
        "write to jane.doe@example.org, jane.doe answers",
        "host 10.20.30.40 and again 10.20.30.40 here",
        "order 12025550109 for +1 202 555 0100 please",
        "mail a.b@c.example.com and 4111 1111 1111 1111",
    ],
)
def test_labels_equal_those_of_exact_marginals(text):
    nodes, marginals = exact(text)
    assert 1 < len(nodes) <= 5
    expected = []
    for (s, e, _, kind), p in zip(nodes, marginals):
        best = max(range(len(p)), key=p.__getitem__)
        assert abs(p[best] - pii.BELIEF) > 0.05  # the cases are clear ones
        if kind >= 0:
            expected.append((s, kind, e))
        elif best < len(pii.KINDS) and p[best] >= pii.BELIEF:
            expected.append((s, best, e))
    assert pii.spread(text, pii.base_spans(text)) == sorted(expected)


def test_recall_and_precision_of_planted_repeats():
    """Bare repeats of what a pattern has found once, among numbers of the same lengths that were never found."""
    import random

    rng = random.Random(3)
    found = planted = wrong = 0
    for _ in range(300):
        digits = "".join(rng.choices("123456789", k=10))
        phone, bare, other = f"+{digits[:2]} {digits[2:5]} {digits[5:]}", digits, "".join(rng.choices("123456789", k=10))
        text = f"Reach us at {phone} any day. Some words lie between them. The number {bare} is the same, the order {other} is not."
        spans = pii.spread(text, pii.base_spans(text))
        planted += 1
        found += any(text[s:e] == bare for s, _, e in spans)
        wrong += any(text[s:e] == other for s, _, e in spans)
    assert found / planted >= 0.95 and wrong / planted <= 0.05
