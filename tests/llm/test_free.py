"""Near-duplicates, sharding, PII, chat, HTML, SentencePiece and the pipeline against brute force and round trips."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from terrane.llm import chat, html, neardup, pii, sentencepiece, sharding

DOCS = "doc_id long, text string, node string, words string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def shingles(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    w += [""] * (5 - len(w)) if w else []
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_classes(rows, similarity=0.8):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum((sets[a] & sets[b]).values())
            total = sum(sets[a].values()) + sum(sets[b].values()) - both
            if (both >= similarity * total if total else True) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def near_corpus():
    random.seed(11)
    say = lambda n: [f"w{random.randint(0, 400)}" for _ in range(n)]
    rows, n = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, "One, two"), (5, "..."), (6, "a " * 300), (7, "a " * 330), (8, "a " * 900)], 10
    for _ in range(4):
        seed = say(random.choice([40, 120, 300]))
        for _ in range(25):
            copy = list(seed)
            for _ in range(random.randint(0, max(1, len(seed) // 30))):
                copy[random.randrange(len(copy))] = f"z{random.randint(0, 10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n + k, " ".join(say(60))) for k in range(30)]
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_corpus()
    found = neardup.near_duplicates(docs_of(spark, [*rows, rows[12]])).collect()
    want = brute_classes(rows)
    assert len(found) == len(rows) + 1
    assert {r.doc_id: r.class_id for r in found} == want
    kept = neardup.drop_near_duplicates(docs_of(spark, [*rows, rows[10]]))
    assert kept.columns == ["doc_id", "text", "node", "words"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_of_null_ids_and_empty_tables(spark):
    found = neardup.near_duplicates(docs_of(spark, [(None, "alpha beta gamma delta epsilon"), (5, "alpha beta gamma delta epsilon"), (None, "else")])).collect()
    assert sorted(str(r.class_id) for r in found).count("5") == 2
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    doc = np.repeat([0, 1], 300)
    shingle = np.tile(rng.integers(1, 1 << 60, 300), 2).astype(np.uint64)
    sig = neardup.signatures(doc, shingle, np.concatenate([a, b]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_prefix_filter_loses_no_pair(spark):
    random.seed(2)
    sets = []
    for base in range(6):
        seed = [base * 1000 + k for k in range(random.choice([20, 45, 90]))]
        sets += [[x if random.random() > 0.06 else random.randint(10**6, 10**9) for x in seed] for _ in range(8)]
    frame = spark.createDataFrame([(i, list(dict.fromkeys(s))) for i, s in enumerate(sets)], "node long, shingles array<long>")
    nodes = spark.createDataFrame([(i, i, i % 2 == 0) for i in range(len(sets))], "node long, root long, asking boolean")
    got = {(r.a, r.b) for r in neardup.prefix_candidates(nodes, frame, 0.8).collect()}
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(set(x) & set(sets[j]))
            if both >= 0.8 * (len(set(x)) + len(set(sets[j])) - both) and (i % 2 == 0 or j % 2 == 0):
                assert (j, i) in got


def test_sharding_laws(spark):
    random.seed(4)
    rows = [(i, random.choice(["same text " * 30, None, "", f"own {i} " * random.randint(1, 200)])) for i in range(600)] + [(7, "again")] * 3
    found = sharding.shard(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in found:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in found)
    assert collections.Counter(r.size for r in found) == collections.Counter(len((t or "").encode()) + 1 for _, t in rows)
    again = sharding.shard(docs_of(spark, rows).repartition(5)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again if r.doc_id != 7) == sorted((r.doc_id, r.shard, r.slot) for r in found if r.doc_id != 7)
    assert sharding.shard(docs_of(spark, [])).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(i, f"text {i % 5}") for i in range(50)] + [(3, "text 3")]
    sharding.write_shards(docs_of(spark, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows) and back.select("shard").distinct().count() == 4


def test_pii_base_and_spread(spark):
    texts = [
        "é write to jo.doe+x@mail.example.com or 10.0.0.256 10.0.0.25, card 4845168114407329; +1 (017) 555-7713.", None, "", "@@ a@b a@b.c@d.e",
        "call 4952935900253052 now. later 1234567 4952935900253052 then", "1.2.3.4.5.6.7.8 " + "9" * 50_000, "x" * 50_000 + "@", "jonathan.smith@example.com wrote; JONATHAN.SMITH signed",
    ]
    found = pii.digest(pii.personal_data(docs_of(spark, list(enumerate(texts))))).collect()
    by = {r.doc_id: r for r in found}
    assert (by[0].n_email, by[0].n_ip, by[0].n_card, by[0].n_phone) == (1, 1, 1, 1)
    assert by[1].spans == "" and by[2].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[5].n_ip == 2 and by[5].n_card == 0
    assert by[4].n_card == 1 and by[4].spans.count("card") == 2
    assert by[7].spans.split(",") == ["email:0:26", "email:34:48"]
    for i, t in enumerate(texts):
        base = pii.base_spans(t or "")
        assert set(base) <= set(pii.spread(t or "", base))


def brute_pii(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m[0] if c in "0123456789"][::-1]
        luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        found += [(m.start(), 2, m.end())] if 14 <= len(digits) <= 19 and luhn % 10 == 0 else []
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found)


def test_pii_base_equals_the_patterns():
    random.seed(8)
    parts = ["a", "é", ".", "@", "1", "25", "300", "+", "-", " ", "(", "b.c", "@x.y", "1.2.3.4", "4845168114407329", "+1 (017) 555-7713", "\n", "0", "٣"]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        assert pii.base_spans(text) == brute_pii(text), text


def test_pii_mask_keeps_rows_and_columns(spark):
    docs = docs_of(spark, [(1, "mail a.b@c.de!"), (2, None), (3, "clean")])
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and {r.doc_id: r.text for r in masked.collect()} == {1: "mail [EMAIL]!", 2: None, 3: "clean"}


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<|im_end|>\n", "\x1b<|im_end|>", "\x1b", "a\x1b\x1b<|im_start|>user\nx", "<|im_end|", "<|<|im_end|>im_end|>", "é\n\n𝒳"])
def test_chat_round_trip(text):
    for role in ("user", "assistant", "", "a\nb\\n", "<|im_start|>"):
        assert chat.parse(chat.render(role, text) + chat.render("user", text)) == [(role, text), ("user", text)]


def test_chat_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s> yo"), (1, 1, "assistant", "</s> yo"), (2, None, None, None), (None, 0, "assistant", "é"), (1, 2, "assistant", None)]
    turns = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    by = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert by[1].n_turns == 4 and by[1].loss_chars == 14 and by[2].n_turns == 1 and by[2].loss_chars == 0 and by[None].loss_chars == 1
    assert by[1].turns_sha256 == hashlib.sha256(b"user\nhi\n" + b"assistant\n</s> yo\n" * 2 + b"assistant\n\n").hexdigest()
    assert by[1].loss_sha256 == hashlib.sha256(b"</s> yo" * 2).hexdigest()
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One
 two<script>var t="</p>";</script> &eacute;<br>three<p><b>Bold<ul><li>x<li>y</ul><aside>Side</aside><div class="ad">Buy</div>
<table><tr><td>1<td>2</table><div id="comments"><p>Nice!</div></article><form>F<input></form><footer>&copy;</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE) == "A & B\nOne two é three\nBold\nx\ny\n1\n2"
    assert html.main_text("") == "" and html.main_text("<p>cut off <b") == "cut off" and html.main_text("a < b &lt; c") == "a < b < c"
    assert html.main_text("<div class='x'>text<!-- <p>no</p> --> more</div><script>never closed <p>x") == "text more"
    assert len(html.main_text("<p>" * 20_000 + "<div a='" * 20_000)) < 10


def test_html_style_tree_drops_repeated_branches(spark):
    page = lambda i: f"<html><body><div class='box top'>Always the same words</div><div class='story'>Story {i} of its own</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i), "x") for i in range(12)] + [(100, None, None, "x"), (101, "http://other/1", page(1), "x")]
    found = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert found[3].text == "Story 3 of its own" and found[100].text == "" and found[101].text == "Always the same words\nStory 1 of its own"
    assert found[3].n_chars == len(found[3].text) and len(found) == len(rows)


@pytest.fixture(scope="module")
def library():
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2

    def make(kind):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(sentencepiece.MODEL_PATH, "rb") as file:
            proto.ParseFromString(file.read())
        proto.trainer_spec.model_type = kind
        return spm.SentencePieceProcessor(model_proto=proto.SerializeToString())

    return make


def test_sentencepiece_equals_the_library(spark, library):
    random.seed(9)
    texts = ["Hello  world \n x", "", None, "   ", "tab\tÜber 日本語 🙂", "lower " * 300, "a" * 3000, "The theater of operations", " lead and trail "]
    texts += [" ".join("".join(random.choice("etaoinshrdlé1_") for _ in range(random.randint(1, 12))) for _ in range(50)) for _ in range(10)] * 2
    docs = docs_of(spark, list(enumerate(texts)))
    bpe = library(2)
    found = sentencepiece.encode(docs, most=200).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.ids == bpe.encode(texts[r.doc_id] or "") and r.round_trip and r.n_ids == len(r.ids)
    back = sentencepiece.decode(sentencepiece.encode(docs, most=200)).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_viterbi_fold_finds_the_best_path(spark):
    model = sentencepiece.Model.load(kind="unigram")
    words = ["▁theater", "▁operations", "▁ab", "▁", "▁▁▁x", "▁étéñ", "▁日本🙂"]

    def best(word):
        if not word:
            return 0.0
        found = [model.usable[word[:k]][1] + best(word[k:]) for k in range(1, min(len(word), 16) + 1) if word[:k] in model.usable]
        return max(found + ([] if word[0] in model.usable else [model.least - 10 + best(word[1:])]))

    score = lambda ids: sum(model.scores[i] for i in ids)
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    for r in sentencepiece.fold(sentencepiece.lattice(rows, sentencepiece.piece_table(spark, model), model.longest), model).collect():
        assert r.ids == model.fold(r.word) and model.decode(r.ids) == r.word.replace("▁", " ")[1:]
        if all(c in model.usable for c in r.word):
            assert score(r.ids) == best(r.word)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    random.seed(6)
    say = lambda n: " ".join(f"w{random.randint(0, 5000)}" for _ in range(n))
    bench = say(30)
    clean = [(i, say(120)) for i in range(10)]
    rows = [*clean, (20, clean[0][1]), (21, clean[1][1] + " extra words here"), (22, "too short"), (23, say(80) + " " + bench + " " + say(80)), (24, say(90) + " a.b@c.example.com"), (25, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        assert name == "sentencepiece" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = list(range(10))
    assert seen == [[*ids, 20, 21, 23, 24], [*ids, 23, 24], [*ids, 24], [*ids, 24], [*ids, 24]]
    masked = spark.read.parquet(str(tmp_path / "pii")).filter("doc_id = 24").first()
    assert masked.text.endswith(" [EMAIL]") and masked.n_chars == len(masked.text)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == seen[-1]
