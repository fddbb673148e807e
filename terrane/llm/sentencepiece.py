"""SentencePiece encoding and decoding over a relational lattice.

A text falls into units that no piece crosses: space marks with the run of letters, the digit or the run of other
characters after them; ``Model`` checks every piece for that. The most frequent units of the corpus, at most ``DICTIONARY`` of
at most ``LONGEST`` characters, are encoded relationally: their substrings up to the longest piece are exploded, joined to the
piece table, grouped back into a lattice per unit and folded with Spark's higher-order ``aggregate``. For a unigram model the fold
is Viterbi; a BPE model's own result is not the best path (its scores are merge ranks), so there the fold merges along the lattice
by rank. Units outside the bounded dictionary go through the same fold where their document lies, all those of a batch at
once as one matrix; no document is shuffled.

Defined cases: a null or empty text has no ids; characters without a piece become byte pieces (or the unknown id); U+2581 in a text
reads as a space, as in the library; repeated rows get equal rows; extra columns are ignored; an empty table gives an empty result;
very long units are folded with a heap (BPE) or in one pass (unigram).
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import holding, let, whole_text

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORDS = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
#: Units by the classes of their characters: letters, one digit, one line feed, other characters; for Python and for Java.
_UNITS = f"{SPACE}*(?:{{letter}}+|{{digit}}|\\n|{{other}}+)|{SPACE}+"
UNITS = _UNITS.format(letter=r"[^\W\d_²³¹]", digit=r"\d", other=rf"(?:[^\w{SPACE}\n]|[_²³¹])")
JAVA_UNITS = _UNITS.format(letter=r"[\p{L}\p{N}&&[^\p{Nd}²³¹]]", digit=r"\p{Nd}", other=rf"(?:[^\p{{L}}\p{{N}}{SPACE}\n]|[²³¹])")
#: Units of the broadcast dictionary, their greatest length, words that a worker remembers besides.
DICTIONARY, LONGEST, REMEMBERED = 1 << 17, 32, 1 << 17
#: Units of one matrix, and the length beyond which a heap folds.
MATRIX_ROWS, MATRIX_LENGTH = 8192, 64
#: Tasks that share the dictionary's lattice, whose size is bounded.
FOLDERS = 64
UNKNOWN_PENALTY, NO_RANK, LAST = 10.0, -math.inf, np.iinfo(np.int32).max
#: Documents whose words are put together at once.
BATCH_DOCS = 500


@dataclass
class Model:
    """A piece table: bounded by the vocabulary file."""

    pieces: list[str]
    scores: list[float]
    kind: str
    usable: dict[str, tuple[int, float]]
    bytes_at: dict[int, int]
    unknown: int
    longest: int
    least: float
    text: list[bytes] = field(default_factory=list)
    ranks: dict[str, float] = field(default_factory=dict)
    units: str = WORDS
    none: int = 0
    pairs: np.ndarray | None = None
    merged: np.ndarray | None = None
    order: np.ndarray | None = None
    chars: np.ndarray | None = None

    @classmethod
    def load(cls, path: str = MODEL_PATH, kind: str | None = None) -> Model:
        """Reads a model file on the driver; ``kind`` overrides the file's own ("bpe" or "unigram")."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if not proto.normalizer_spec.escape_whitespaces or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        usable = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in usable):
            raise ValueError("a piece spans words")
        bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        text = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        kind = kind or {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        model = cls([p.piece for p in proto.pieces], [p.score for p in proto.pieces], kind, usable, bytes_at, unknown, max(map(len, usable)), min(s for _, s in usable.values()), text, {p: s for p, (_, s) in usable.items()})
        if all(re.fullmatch(UNITS, p) for p in usable if len(p) > 1):
            model.units = UNITS
        if kind == "bpe" and all(c in usable for p in usable for c in p):
            model._pair_up()
        return model

    def _pair_up(self) -> None:
        """The pairs of pieces whose union is a piece: sorted keys, the unions' ids, their places in the order of merging. And the id of each character."""
        self.none = len(self.pieces)
        ids = {p: i for p, (i, _) in self.usable.items()}
        found = sorted((ids[p[:k]] * (self.none + 1) + ids[p[k:]], i, -score) for p, (i, score) in self.usable.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pairs = np.array([x[0] for x in found] + [np.iinfo(np.int64).max], np.int64)
        self.merged = np.array([x[1] for x in found] + [self.none], np.int32)
        self.order = np.append(np.unique([x[2] for x in found], return_inverse=True)[1], LAST).astype(np.int32)
        single = {ord(p): i for p, i in ids.items() if len(p) == 1}
        self.chars = np.full(max(single) + 2, self.none, np.int32)
        self.chars[list(single)] = list(single.values())

    def _without_piece(self, char: str) -> list[int]:
        return [self.bytes_at[b] for b in char.encode()] if self.bytes_at else [self.unknown]

    def fold(self, word: str) -> list[int]:
        """Ids of one word."""
        return self._merge(word) if self.kind == "bpe" else self._viterbi(word)

    def fold_all(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of many words: those of bounded length as matrices of similar lengths, the others one by one."""
        words = sorted(words, key=len)
        short = bisect.bisect_right(words, MATRIX_LENGTH, key=len) if self.chars is not None else 0
        out: dict[str, bytes] = {}
        for at in range(0, short, MATRIX_ROWS):
            out |= self._merge_matrix(words[at : min(at + MATRIX_ROWS, short)])
        for w in words[short:]:
            out[w] = array("i", self.fold(w)).tobytes()
        return out

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order of merging (none: ``LAST``) and id of the union of each pair of ids."""
        key = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.order[at], LAST), self.merged[at]

    def _merge_matrix(self, words: list[str]) -> dict[str, bytes]:
        """A row for each word, a column for each part; in every round each word merges its best pair, leftmost first.

        Parts stay in the column of their first character; ``after`` and ``before`` lead from part to part, and the last column ends each row.
        """
        none, sizes = self.none, np.array([len(w) for w in words])
        n, width = len(words), int(sizes[-1]) + 1
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = self.chars[np.minimum(codes, len(self.chars) - 1)]
        whole = np.full((n, width), none, np.int32)
        whole[np.arange(width) < sizes[:, None]] = first
        parts, rows = whole, np.arange(n)
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        order, union = np.full((n, width), LAST, np.int32), np.zeros((n, width), np.int32)
        order[:, :-1], union[:, :-1] = self._ranked(parts[:, :-1], parts[:, 1:])
        while True:
            best = order.argmin(axis=1)
            row = np.flatnonzero(order[np.arange(len(best)), best] < LAST)
            if 2 * len(row) < len(rows):  # words that are done leave
                whole[rows] = parts
                rows, parts, after, before, order, union, best = (x[row] for x in (rows, parts, after, before, order, union, best))
                row = np.arange(len(rows))
            if not len(row):
                break
            at = best[row]
            gone = after[row, at]
            new = parts[row, at] = union[row, at]
            right = after[row, at] = after[row, gone]
            parts[row, gone], order[row, gone] = none, LAST
            right = np.minimum(right, width - 1)
            before[row, right] = at
            order[row, at], union[row, at] = self._ranked(new, parts[row, right])
            left = before[row, at]
            inner = left >= 0
            row, left = row[inner], left[inner]
            order[row, left], union[row, left] = self._ranked(parts[row, left], new[inner])
        kept = whole < none
        ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        packed = whole[kept].tobytes()
        out = {w: packed[e0:e1] for w, e0, e1 in zip(words, [0, *ends], ends, strict=False)}
        if (first == none).any():
            for r in np.flatnonzero(np.add.reduceat(first == none, np.cumsum(sizes) - sizes)):
                out[words[r]] = array("i", self.fold(words[r])).tobytes()
        return out

    def _merge(self, word: str) -> list[int]:
        """Merges the neighbours whose union ranks best, leftmost first, until none is a piece."""
        return self._merge_short(word) if len(word) <= MATRIX_LENGTH else self._merge_long(word)

    def _merge_short(self, word: str) -> list[int]:
        rank, usable, parts = self.ranks.get, self.usable, list(word)
        ranks = [rank(a + b, NO_RANK) for a, b in pairwise(parts)]
        while ranks and (best := max(ranks)) != NO_RANK:
            i = ranks.index(best)
            merged = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + merged, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(merged + parts[i + 1], NO_RANK)
        try:
            return [usable[part][0] for part in parts]
        except KeyError:
            return [x for part in parts for x in ((usable[part][0],) if part in usable else self._without_piece(part))]

    def _merge_long(self, word: str) -> list[int]:
        usable, n = self.usable, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = after[:]
        heap = [(-usable[word[i : i + 2]][1], i, i + 1, i + 2) for i in range(n - 1) if word[i : i + 2] in usable]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, s, m, e = heapq.heappop(heap)
            if gone[s] or m >= n or gone[m] or ends[s] != m or ends[m] != e:
                continue
            ends[s], after[s], gone[m] = e, after[m], True
            if e < n:
                before[e] = s
                if found := usable.get(word[s : ends[e]]):
                    heapq.heappush(heap, (-found[1], s, e, ends[e]))
            if (p := before[s]) >= 0 and (found := usable.get(word[p:e])):
                heapq.heappush(heap, (-found[1], p, s, e))
        ids, s = [], 0
        while s < n:
            found = usable.get(word[s : ends[s]])
            ids += [found[0]] if found else self._without_piece(word[s : ends[s]])
            s = ends[s]
        return ids

    def _viterbi(self, word: str) -> list[int]:
        usable, n = self.usable, len(word)
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(-math.inf, 0, -1)] * n
        for s in range(n):
            score = best[s][0]
            single = False
            for e in range(s + 1, min(n, s + self.longest) + 1):
                if found := usable.get(word[s:e]):
                    single = single or e == s + 1
                    if score + found[1] > best[e][0]:
                        best[e] = (score + found[1], s, found[0])
            if not single and score + self.least - UNKNOWN_PENALTY > best[s + 1][0]:
                best[s + 1] = (score + self.least - UNKNOWN_PENALTY, s, -1)
        out, e = [], n
        while e > 0:
            _, s, i = best[e]
            out.append([i] if i >= 0 else self._without_piece(word[s:e]))
            e = s
        return [i for part in reversed(out) for i in part]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def mark(text: str) -> str:
    """The text with space marks and the dummy prefix."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def bare_words(text: str) -> list[str]:
    """The words of a text, each without its first mark. Single spaces between words take the fast path."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
        return [w[1:] for w in re.findall(WORDS, mark(text))]
    return text.split(" ")


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, score): as many rows as the vocabulary file has pieces."""
    return spark.createDataFrame([(p, i, float(s)) for p, (i, s) in model.usable.items()], "piece string, id int, score double")


def frequent_units(docs: DataFrame, hold: Callable[[DataFrame], DataFrame], units: str = JAVA_UNITS, most: int = DICTIONARY, longest: int = LONGEST) -> DataFrame:
    """(word): the most frequent units of the corpus, at most ``most`` of them.

    Words are counted first, then the units within the distinct words; counts are summed before each shuffle. A histogram over logarithmic
    bins of the counts (at most 2,000 rows) gives the threshold.
    """
    words = docs.select(F.explode(F.split(whole_text(), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    each = words.select(F.explode(F.regexp_extract_all(F.concat(F.lit(SPACE), "word"), F.lit(units), F.lit(0))).alias("word"), "n")
    counted = hold(each.filter(F.length("word") <= longest).groupBy("word").agg(F.sum("n").alias("n")))
    bin_ = F.floor(F.log2("n") * 32).cast("int")
    bins = sorted(((r.b, r.m) for r in counted.groupBy(bin_.alias("b")).agg(F.count("*").alias("m")).collect()), reverse=True)
    total, least = 0, math.inf
    for b, m in bins:
        total += m
        if total > most:
            break
        least = b
    return counted.filter(bin_ >= (least if least < math.inf else 1 << 30)).select("word")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges): array<struct<s, e, id, score>> of all pieces in each distinct word."""
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    cuts = starts.select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + longest))).alias("e"))
    spans = cuts.select("word", "s", "e", F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s")).alias("piece"))
    # The piece table is bounded by its vocabulary file.
    edges = spans.join(F.broadcast(pieces), "piece", "left").filter("id is not null or e = s + 1")
    return edges.groupBy("word").agg(F.collect_list(F.struct("s", "e", "id", "score")).alias("edges"))


def _bytes_of(char: Column, model: Model) -> Column:
    if not model.bytes_at:
        return F.array(F.lit(model.unknown))
    first = model.bytes_at[0]
    code = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda i: F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int") + first)


def fold(rows: DataFrame, model: Model) -> DataFrame:
    """(word, ids) from (word, edges)."""
    word, edges = F.col("word"), F.col("edges")
    n = F.length(word)

    def ids(bounds: Column, by_span: Column) -> Column:
        def one(i: Column) -> Column:
            s, e = bounds[i], bounds[i + 1]
            return let(by_span[s * 64 + e], lambda hit: F.when(hit["id"].isNotNull(), F.array(hit["id"])).otherwise(_bytes_of(F.substring(word, s + 1, e - s), model)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), one))

    spans = F.map_from_entries(F.transform(edges, lambda x: F.struct((x["s"] * 64 + x["e"]).alias("k"), F.struct(x["id"].alias("id"), x["score"].alias("score")).alias("v"))))

    def merge(by_span: Column) -> Column:
        def step(bounds: Column, _: Column) -> Column:
            inner = F.filter(F.sequence(F.lit(1), F.greatest(F.size(bounds) - 2, F.lit(1))), lambda i: i <= F.size(bounds) - 2)
            ranked = F.transform(inner, lambda i: F.struct(F.try_element_at(by_span, F.get(bounds, i - 1) * 64 + F.get(bounds, i + 1))["score"].alias("r"), (-i).alias("i")))
            best = F.array_max(F.filter(ranked, lambda x: x["r"].isNotNull()))
            return let(best, lambda b: F.when(b.isNull(), bounds).otherwise(F.concat(F.slice(bounds, F.lit(1), -b["i"]), F.slice(bounds, -b["i"] + 2, F.size(bounds)))))

        return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step, lambda bounds: ids(bounds, by_span))

    def viterbi(by_span: Column) -> Column:
        start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s")))

        def step(best: Column, e: Column) -> Column:
            into = F.filter(edges, lambda x: x["e"] == e)
            scored = F.transform(into, lambda x: F.struct((best[x["s"]]["score"] + F.coalesce(x["score"], F.lit(model.least - UNKNOWN_PENALTY))).alias("score"), (-x["s"]).alias("s")))
            return F.concat(best, let(F.array_max(scored), lambda b: F.array(F.struct(b["score"].alias("score"), (-b["s"]).alias("s")))))

        def path(best: Column) -> Column:
            back = lambda at, _: F.when(at[0] > 0, F.concat(F.array(best[at[0]]["s"]), at)).otherwise(at)
            return F.aggregate(F.sequence(F.lit(1), n), F.array(n), back, lambda bounds: ids(bounds, by_span))

        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda best: let(best, path))

    return rows.select("word", let(spans, merge if model.kind == "bpe" else viterbi).alias("ids"))


def dictionary(docs: DataFrame, model: Model, most: int = DICTIONARY) -> dict[str, bytes]:
    """Packed ids of the frequent units: at most ``most`` of at most ``LONGEST`` characters reach the driver."""
    with holding() as hold:
        units = frequent_units(docs, hold, JAVA_UNITS if model.units == UNITS else WORDS, most).coalesce(FOLDERS)
        rows = fold(lattice(units, piece_table(docs.sparkSession, model), model.longest), model)
        return {r.word: array("i", r.ids).tobytes() for r in rows.collect()}


class _Encoder:
    """Encodes texts with the dictionary's units; other units are folded a batch at a time."""

    def __init__(self, model: Model, known: dict[str, bytes]):
        self.model, self.units, self.split = model, known, re.compile(model.units).findall
        # Words that are one unit each stand without their first mark, as ``bare_words`` gives them.
        self.words = {u[1:]: ids for u, ids in known.items() if u[:1] == SPACE and len(u) > 1}
        self.more: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        words, units = [bare_words(t) for t in texts], self.units
        if len(self.more) >= REMEMBERED:
            self.more = {}
        missing = {w: self.split(SPACE + w) for w in set().union(*words) if w not in self.words and w not in self.more}
        fresh = self.model.fold_all(list({u for found in missing.values() for u in found if u not in units}))
        for w, found in missing.items():
            self.more[w] = b"".join([units.get(u) or fresh[u] for u in found])
        known, more = self.words, self.more
        return [b"".join([known.get(w) or more[w] for w in each]) for each in words]


def encode(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", most: int = DICTIONARY) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of every document row."""
    model = model or Model.load()
    shared = docs.sparkSession.sparkContext.broadcast((model, dictionary(docs, model, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                out = encoder.encode(texts)
                same = [encoder.model.decode(memoryview(x).cast("i").tolist()) == t for x, t in zip(out, texts, strict=True)]
                sizes = np.array([len(x) // 4 for x in out])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), ids, pa.array(same)], ["id", "n_ids", "ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_ids long, ids array<int>, round_trip boolean")
    return rows.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: Model | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model or Model.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
