"""Benchmark decontamination over a distributed positional inverted index.

The index holds one posting (term, document, position) for every training token that some benchmark item
uses; common and rare terms alike, whole texts. A phrase window is looked up by its rarest terms first:
their lists, moved back by each term's offset in the window, are intersected; what survives is compared with
the words of the text, all of them in order. All of it is DataFrame code: no Python on the executors.

Defined cases: a null text has no words; an item without words has no window and occurs nowhere; an item
of fewer than ``width`` words is one window; repeated document rows each keep their own (equal) result row;
a null ``doc_id`` is an id like any other; an item with a null id counts for hits but not as an item;
extra columns are ignored; an empty table gives an empty result, an empty benchmark no hit. Terms and windows are known by
64-bit hashes; a hit agrees in the hashes of its rarest terms, their places, and the hash of the whole phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, cut, let, small, unused, whole_text

WIDTH = 10
#: Lists that are intersected before the words themselves are compared.
ANCHORS = 3
#: Lists that fit the bits of a long.
MOST_ANCHORS = 63


def _row_hash(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col), whole_text())


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, item_id, words): each run of ``width`` words of each item, or the whole of a shorter one."""
    words = items.select("item_id", alnum_words(whole_text()).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - width + 1, F.lit(1)))
    runs = words.select("item_id", "ws", F.explode(starts).alias("at"))
    runs = runs.select("item_id", F.slice("ws", F.col("at"), F.lit(width)).alias("words"))
    return runs.select(_phrase(F.col("words")).alias("window"), "item_id", "words").distinct()


def _phrase(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def build_index(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", ends: bool = True) -> DataFrame:
    """Postings (term, doc_id, row, pos). With ``ends`` the empty term closes each document: its position is the word count."""
    terms = windows.select(F.explode("words").alias("word"))
    if ends:
        terms = terms.union(terms.sparkSession.sql("SELECT '' AS word"))
    terms = cut(terms.distinct(), "terms", gather=True)
    words = alnum_words(whole_text())
    closed = F.concat(words, F.array(F.lit(""))) if ends else words
    tokens = docs.select(F.col(id_col).alias("doc_id"), _row_hash(id_col).alias("row"), F.posexplode(closed).alias("pos", "word"))
    found = tokens.join(small(terms, F.octet_length("word")), "word", "left_semi")
    return cut(found.select(F.xxhash64("word").alias("term"), "doc_id", "row", "pos"), "postings")


def _anchored(index: DataFrame, windows: DataFrame, anchors: int) -> DataFrame:
    """The rarest terms (window, need, len, list, off, term) of the distinct windows whose every term occurs."""
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    anchors = min(anchors, MOST_ANCHORS)
    distinct = windows.select("window", "words").dropDuplicates(["window"])
    spread = distinct.select("window", F.size("words").alias("len"), F.posexplode("words").alias("off", "word"))
    spread = spread.select("window", "len", "off", F.xxhash64("word").alias("term")).join(frequency, "term")
    by_window = Window.partitionBy("window")
    ranked = spread.withColumns({"seen": F.count("*").over(by_window), "rank": F.row_number().over(by_window.orderBy("n", "off"))})
    rare = ranked.filter((F.col("seen") == F.col("len")) & (F.col("rank") <= anchors))
    return cut(rare.select("window", F.least(F.col("len"), F.lit(anchors)).alias("need"), "len", F.expr("shiftleft(1L, rank - 1)").alias("list"), "off", "term"), "anchors", gather=True)


def _starts(index: DataFrame, rare: DataFrame) -> DataFrame:
    """Postings of the rare terms, moved back to where their window would start."""
    rows = index.join(small(rare, 40), "term")
    return rows.select("doc_id", "row", "window", "need", "len", "list", "off", (F.col("pos") - F.col("off")).alias("start"))


def phrase_hits(docs: DataFrame, index: DataFrame, windows: DataFrame, anchors: int = ANCHORS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, row, hits): every exact occurrence of a window as array<struct<start, len, window>>, one row per document."""
    starts = _starts(index, _anchored(index, windows, anchors)).filter(F.col("start") >= 0)
    # One bit for each list intersects them however often a repeated document row brings a posting; most of it is done before the shuffle.
    both = starts.groupBy("doc_id", "row", "window", "start", "need", "len").agg(F.bit_count(F.bit_or("list")).alias("n")).filter("n = need")
    wanted = both.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "len", "window")).alias("wanted"))
    wanted = cut(wanted, "wanted", gather=True)
    texts = docs.select(F.col(id_col).alias("doc_id"), "text").withColumn("row", _row_hash("doc_id"))
    pairs = texts.join(small(wanted, 16 * F.size("wanted")), (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    same = lambda ws: F.filter("wanted", lambda h: _phrase(F.slice(ws, h["start"] + 1, h["len"])) == h["window"])
    exact = pairs.select("doc_id", "row", let(alnum_words(whole_text()), same).alias("hits")).filter(F.size("hits") > 0)
    # A repeated row has its text, and so its hits, once more.
    return cut(exact.groupBy("doc_id", "row").agg(F.max("hits").alias("hits")), "hits", gather=True)


def _near(index: DataFrame, terms: DataFrame, slack: int) -> DataFrame:
    """(doc_id, row, window) where all the terms of a window start within one bin.

    Starts are dealt to overlapping bins of twice the slack, so no two starts that close are missed.
    """
    bins = F.floor(F.col("start") / slack)
    binned = _starts(index, terms).select("doc_id", "row", "window", "need", "off", F.explode(F.array(bins, bins + 1)).alias("bin"))
    close = binned.groupBy("doc_id", "row", "window", "need", "bin").agg(F.count_distinct("off").alias("n")).filter("n = need")
    return close.select("doc_id", "row", "window").distinct()


def near_matches(index: DataFrame, windows: DataFrame, slack: int = 4, anchors: int = ANCHORS) -> DataFrame:
    """Proximity: (doc_id, item_id) where a window's words all occur, each at most ``slack`` words from its place.

    The rarest terms find windows and documents; then all words (``MOST_ANCHORS`` at most) are looked up there.
    """
    found = cut(_near(index, _anchored(index, windows, anchors), slack).select("row", "window"), "near")
    every = _anchored(index, windows.join(found, "window", "left_semi"), MOST_ANCHORS)
    close = _near(index.join(found, "row", "left_semi"), every, slack)
    return close.join(windows.select("window", "item_id"), "window").select("doc_id", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, anchors: int = ANCHORS, id_col: str = "doc_id") -> DataFrame:
    """One row per document row: n_words, n_hit, n_items, items_sha256, contaminated, and ``row`` (a hash of id and text)."""
    windows = cut(benchmark_windows(items, width), "windows", gather=True)
    index = build_index(docs, windows, id_col)
    hits = phrase_hits(docs, index, windows, anchors, id_col)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))
    counted = hits.select("doc_id", "row", F.size(covered).cast("long").alias("n_hit"), F.explode(F.array_distinct(F.transform("hits", lambda h: h["window"]))).alias("window"))
    named = windows.select("window", F.col("item_id").cast("string").alias("item"))
    found = counted.join(small(named, 8 + F.coalesce(F.octet_length("item"), F.lit(0))), "window")
    per_doc = found.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    ends = index.filter(F.col("term") == F.xxhash64(F.lit(""))).select("doc_id", "row", F.col("pos").cast("long").alias("n_words"))
    rows = ends.join(per_doc, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "row",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without any benchmark window; columns stay as they are."""
    windows = cut(benchmark_windows(items), "windows", gather=True)
    hits = phrase_hits(docs, build_index(docs, windows, id_col, ends=False), windows, id_col=id_col)
    id_, row_ = unused(docs, "_id", "_row")
    bad = cut(hits.select(F.col("doc_id").alias(id_), F.col("row").alias(row_)), "contaminated", gather=True)
    same = (_row_hash(id_col) == F.col(row_)) & F.col(id_col).eqNullSafe(F.col(id_))
    return docs.join(small(bad, 24), same, "left_anti")
