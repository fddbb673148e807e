"""Importance of style nodes inside and outside declared articles, and entropies against a plain version."""

import math
from collections import Counter, defaultdict

import pytest
import xxhash

from terrane.llm import html


def extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", page) for i, page in enumerate(pages)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


@pytest.mark.parametrize("n", [2, 3, 8, 50])
def test_recurring_article_text_stays_on_hosts_of_any_size(spark, n):
    page = lambda i: (
        f"<html><body><div class='links'><a href='/'>Home</a> <a href='/x'>All stories</a></div><article><h1>Title {i}</h1><h2>Summary</h2><p>Own text {i}</p>"
        "<blockquote>Never give up.</blockquote><div class='terms'><p>This text may be shared under the licence of the site.</p></div><ul><li>first of all</li></ul>"
        "<p>See <a class='x' href='/m'>the manual</a>.</p></article></body></html>"
    )
    kept = "Summary\nOwn text {}\nNever give up.\nThis text may be shared under the licence of the site.\nfirst of all\nSee the manual."
    assert extracted(spark, [page(i) for i in range(n)]) == [f"Title {i}\n" + kept.format(i) for i in range(n)]


@pytest.mark.parametrize("n", [2, 12])
def test_recurring_links_go_inside_and_outside_articles(spark, n):
    page = lambda i: f"<html><body><article><p>Story {i} of its own</p><div class='more'><p><a href='/a'>Read the same story</a></p></div></article><div class='box'><p>We keep your data safe</p></div></body></html>"
    assert extracted(spark, [page(i) for i in range(n)]) == [f"Story {i} of its own" for i in range(n)]


def test_recurring_text_in_the_flow_of_pages_without_an_article_stays(spark):
    page = lambda i: f"<html><body><div class='box'><p>The same everywhere</p></div><div class='story'><h2>Summary</h2><p>Story {i} of its own</p><div class='hint'><p>Read the same words again</p></div></div></body></html>"
    assert extracted(spark, [page(i) for i in range(12)]) == [f"Summary\nStory {i} of its own\nRead the same words again" for i in range(12)]
    flat = lambda i: f"<html><body><p>Story {i} of its own</p><div class='hint'><p>Read the same words again</p></div></body></html>"
    assert extracted(spark, [flat(i) for i in range(12)]) == [f"Story {i} of its own\nRead the same words again" for i in range(12)]


def test_what_few_of_many_pages_share_is_left(spark):
    page = lambda i: f"<html><body><p>Story {i} of its own</p>{'<div class=x><a>Same link</a></div>' if i < 3 else ''}</body></html>"
    assert extracted(spark, [page(i) for i in range(20)]) == [f"Story {i} of its own" + ("\nSame link" if i < 3 else "") for i in range(20)]


def test_text_outside_a_teaser_card_stays(spark):
    page = lambda i: f"<html><body><div class='story'><p>Story {i} of its own</p></div><article class='card'>Next: {i + 1}</article></body></html>"
    assert extracted(spark, [page(i) for i in range(12)]) == [f"Story {i} of its own\nNext: {i + 1}" for i in range(12)]
    card = lambda i: f"<html><body><div class='story'><p>Story {i} of its own</p></div><article class='card'>Read our best story</article></body></html>"
    assert extracted(spark, [card(i) for i in range(12)]) == [f"Story {i} of its own\nRead our best story" for i in range(12)]


def test_copies_of_a_page_keep_their_text(spark):
    page = lambda i: f"<html><body><script>track({i})</script><article><p>One story</p></article></body></html>"
    assert extracted(spark, [page(i) for i in range(12)]) == ["One story"] * 12


def test_entropies_equal_a_plain_version(spark):
    """Pages as nested lists, so that the expected entropies come from the structure itself, not from a parser."""
    kinds = lambda i: [("div", f"d{i % 3}", [("p", f"text {i % 5}", []), ("ul", "", [("li", f"item {i % 2}", [])] * (i % 4))]), ("section", "same words", [])]
    draw = lambda node: f"<{node[0]}>{node[1]}{''.join(map(draw, node[2]))}</{node[0]}>"
    said = lambda node: ([node[1]] if node[1] else []) + [t for child in node[2] for t in said(child)]
    content, shape = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))

    def walk(node, path, page):
        path = f"{path}/{node[0]}"
        if not said(node) and not node[2]:
            return  # an empty element is no node
        content[path][page] += said(node)
        shape[path][page] += [child[0] for child in node[2]]
        for child in node[2]:
            walk(child, path, page)

    trees = {i: ("body", f"page {i}", kinds(i)) for i in range(30)}
    for i, tree in trees.items():
        walk(tree, "", i)

    def entropy(values):
        n = len(values)
        return -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n) if n > 1 else 1.0

    expected = {}
    for path in content:
        words, forms = [tuple(v) for v in content[path].values()], [tuple(dict.fromkeys(shape[path][p])) for p in content[path]]
        expected[path] = (len(words), 0.9 * entropy(words) + 0.1 * entropy(forms))
    rows = [(i, "http://h.example/x", draw(tree)) for i, tree in trees.items()]
    found = {r.node: (r.pages, r.importance) for r in html.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for path, (pages, importance) in expected.items():
        key = xxhash.xxh64_intdigest(path)
        got = found[key - (1 << 64) if key >= 1 << 63 else key]
        assert got[0] == pages and abs(got[1] - importance) < 1e-9, path
