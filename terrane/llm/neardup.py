"""Near-duplicate classes by BagMinHash signatures over multisets of five-word shingles.

Each distinct shingle with its count is a discretised weight. Its weight axis is cut into dyadic levels
[0,1), [1,2), [2,4), ...; every level runs a Poisson process keyed by shingle and level, whose points fall
on random signature slots, and a point counts if its place on the axis lies below the weight. A slot keeps the
earliest point, so two signatures agree in a slot with a probability equal to the weighted Jaccard
similarity. Processes are drawn in ascending order and stop once they are later than the document's latest slot.

Signatures are banded. In a bucket every member is compared with one hub only, the member whose buckets are fullest. Members
that are then still in another class than the bucket's largest one ask for partners in other classes through an exact prefix
filter over the multisets. Thus a group of n copies costs about n comparisons, and no link between classes that a bucket
holds is left out. Every candidate is verified on the exact multisets.
Equal texts are one node from the start, so copies are never paired.

Defined cases: words are lower-cased runs of letters and digits; a text of fewer than five words is one shingle;
texts without words (null, empty) are one class; rows that share an id are classed each by its own text; a row with a null id takes
a hash of its text for an id, and is never dropped; ids are whole numbers, or strings of their digits; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alnum_words, cut, holding, small, unused, whole_text

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 is missed with a probability of (1 - 0.8^4)^24, about 3e-6.
BANDS, BAND_ROWS = 24, 4
SLOTS = BANDS * BAND_ROWS
#: Words that one step of numpy handles at once, and documents that one Arrow batch holds.
CHUNK_WORDS, BATCH_DOCS = 400_000, 256

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_counts(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text index, shingle hash, count), by text. Texts lie at words[start:end]."""
    sizes = ends - starts
    doc = np.repeat(np.arange(len(sizes)), sizes)
    h = np.zeros(len(words), np.uint64)
    w = words.view(np.uint64)
    for k in range(SHINGLE):
        h[: len(w) - k] = _mix((h[: len(w) - k] + w[k:]) * GOLDEN + np.uint64(k))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    whole = left >= SHINGLE
    h, doc = h[whole], doc[whole]
    order = np.argsort(_mix(h + doc.astype(np.uint64) * GOLDEN), kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order], count[order]


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash: (n_docs, slots) earliest arrival times; texts without shingles keep infinity."""
    levels = np.ceil(np.log2(count)).astype(np.int64) + 1  # 1, 2, 3-4, 5-8, ... need 1, 2, 3, 4, ... levels
    which = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 2 ** np.maximum(level - 1, 0))
    rate = np.where(level == 0, 1, low)
    seed = _mix(shingle[which] + level.astype(np.uint64) * GOLDEN)
    owner, weight, time = doc[which], count[which], np.zeros(len(which))
    sig = np.full((n_docs, slots), np.inf)
    flat = sig.reshape(-1)
    state = seed.copy()
    while len(owner):
        state = state + GOLDEN
        a = _mix(state)
        b = _mix(a ^ seed)
        time = time - np.log((((a >> np.uint64(11)).astype(np.float64)) + 0.5) * 2.0**-53) / rate
        slot = ((b >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
        place = low + np.floor(rate * ((b & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)).astype(np.int64)
        hit = place < weight
        np.minimum.at(flat, owner[hit] * slots + slot[hit], time[hit])
        present = np.flatnonzero(np.bincount(owner, minlength=n_docs))
        latest = np.zeros(n_docs)
        latest[present] = sig[present].max(axis=1)
        on = time < latest[owner]
        if not on.all():
            owner, weight, time, state, seed, low, rate = (x[on] for x in (owner, weight, time, state, seed, low, rate))
    return sig


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands) bucket hashes; each carries its band's number."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, -1)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        h = _mix((h + bits[:, :, k]) * GOLDEN + np.uint64(k + 1))
    return h.view(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with bounded words: (first row, rows, words, starts, ends)."""
    col = batch.column(batch.schema.get_field_index("words"))
    off = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = col.values.to_numpy(zero_copy_only=False)
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_WORDS, side="right")) - 1)
        yield at, to - at, np.ascontiguousarray(values[off[at] : off[to]]), off[at:to] - off[at], off[at + 1 : to + 1] - off[at]
        at = to


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n, words, starts, ends in _chunks(batch):
            doc, shingle, count = shingle_counts(words, starts, ends)
            bands = band_hashes(signatures(doc, shingle, count, n))
            total = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            some = total > 0
            rows = batch.slice(at, n)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(total), _lists(bands[some].reshape(-1), np.where(some, BANDS, 0))], ["id", "k1", "k2", "n", "bands"])


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A multiset as a set: the k-th copy of a shingle gets a hash of its own."""
    for batch in batches:
        for at, n, words, starts, ends in _chunks(batch):
            doc, shingle, count = shingle_counts(words, starts, ends)
            copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            each = _mix(np.repeat(shingle, count) + copy.astype(np.uint64) * GOLDEN)
            sizes = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.slice(at, n).column(0), _lists(each, sizes)], ["node", "shingles"])


@contextmanager
def _batches(spark: SparkSession, docs: int = BATCH_DOCS):
    """Bounds the rows of an Arrow batch while a table is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(docs))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def _hashed(words: Column) -> Column:
    """Word hashes; shorter texts are filled up to one shingle."""
    filled = F.when((F.size(words) > 0) & (F.size(words) < SHINGLE), F.concat(words, F.array_repeat(F.lit(""), F.lit(SHINGLE) - F.size(words)))).otherwise(words)
    return F.transform(filled, lambda w: F.xxhash64(w))


def _key(words: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.array_join(words, " "))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node on a link (a, b): root is the least node of the connected component.

    Alternating large and small stars; each step is two group-bys with map-side minima and two joins that
    may split hot keys. Links never leave the executors; every step is cut into the shared folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        # Done once every node has one parent at most, and parents have none.
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
        if open_.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        both = edges.union(edges.select("v", "u"))
        # Minima are tables of their own, so that the joins have plain sides, which Spark can split at a hub, or need no shuffle.
        least = small(cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least"), 16)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = small(cut(large.groupBy("u").agg(F.min("v").alias("m")), "down"), 16)
        parents = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(large.join(down, "u").select(F.explode(parents).alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "links")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose multisets overlap enough."""
    left = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    rows = pairs.join(left, "b").join(right, "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    # Pairs are distinct already; a distinct here would lean on the join's partitioning and so keep Spark from splitting a hub.
    return rows.filter(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _stars(shared: DataFrame, hubs: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b): each member of a bucket and the bucket's hub, if their sizes allow the similarity."""
    rows = shared.join(hubs, "bucket").filter((F.col("node") != F.col("hub.node")) & (F.least("n", "hub.n") >= similarity * F.greatest("n", "hub.n")))
    return rows.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def prefix_candidates(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of which one is ``asking``, that can reach the similarity: an exact filter, no sketch.

    ``nodes`` has (node, root, asking). Elements are ordered from the rarest up. Two multisets that overlap in at least
    ``need`` elements share one within the first size - need + 1 of both. ``need`` follows from both sizes, so asking nodes
    look into size classes 2 % wide, each with a prefix as short as its sizes allow. An element that no other node has
    can't be shared, so a text with many changes of its own asks for nothing, however large its group is.
    """
    share, step = similarity / (1 + similarity), math.log(1.02)
    each = sets.join(nodes, "node").select("node", "root", "asking", F.size("shingles").alias("size"), F.explode("shingles").alias("e"))
    known = each.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1")
    of_node = Window.partitionBy("node")
    common = each.join(known, "e")
    place = F.col("size") - F.count("*").over(of_node) + F.row_number().over(of_node.orderBy("df", "e"))
    ordered = common.withColumn("pos", place).filter(F.col("pos") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-6) + 1)
    ordered = cut(ordered.select("e", "node", "root", "asking", "size", "pos"), "prefixes")
    class_of = lambda size: F.floor(F.log(size) / step).cast("int")
    # The largest partner size for which this element lies in the prefix, then the classes from the smallest partner up to it.
    most = F.least((F.col("size") - F.col("pos") + 1) / share - F.col("size"), F.col("size") / similarity) + 1e-6
    asked = ordered.filter("asking").withColumns({"low": class_of(similarity * F.col("size")) - 1, "high": class_of(F.greatest(most, F.lit(1.0)))}).filter("low <= high")
    asked = asked.select("e", F.explode(F.sequence("low", "high")).alias("class"), F.col("node").alias("x"), F.col("root").alias("rx"), F.col("size").alias("sx"), F.col("pos").alias("px"))
    told = ordered.select("e", class_of(F.col("size")).alias("class"), F.col("node").alias("y"), F.col("root").alias("ry"), F.col("size").alias("sy"), F.col("pos").alias("py"), "asking")
    need = F.ceil(share * (F.col("sx") + F.col("sy")) - 1e-6)
    fits = (F.col("rx") != F.col("ry")) & (~F.col("asking") | (F.col("x") < F.col("y"))) & (F.col("px") <= F.col("sx") - need + 1) & (F.col("py") <= F.col("sy") - need + 1)
    return asked.join(told, ["e", "class"]).filter(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _keys(words: Column) -> list[Column]:
    return [_key(words, 1).alias("k1"), _key(words, 2).alias("k2")]


def _classes(docs: DataFrame, similarity: float, id_col: str) -> DataFrame:
    """(id, k1, k2, class_id, first) of every row, a table of its own; ``first`` marks the row that stands for its class."""
    spark = docs.sparkSession
    words = docs.select(F.col(id_col).cast("long").alias("id"), alnum_words(whole_text()).alias("w"))
    hashed = words.select("id", *_keys(F.col("w")), _hashed(F.col("w")).alias("words"))
    with holding() as hold:
        with _batches(spark):
            signed = hold(hashed.mapInArrow(_sign, "id long, k1 long, k2 long, n long, bands array<long>"))
            # An id with several texts can't stand for one of them, nor can none; there a hash of the text does.
            texts = F.struct("k1", "k2")
            per_id = signed.groupBy("id").agg((F.min(texts) != F.max(texts)).alias("differ"), F.count("*").alias("n")).filter("n > 1 or id is null")
            odd = cut(per_id.select(F.col("id").alias("odd_id"), (F.col("differ") | F.col("id").isNull()).alias("differ")), "odd")
        repeats, by_hash = not odd.isEmpty(), not odd.filter("differ").isEmpty()
        several = small(odd.filter("differ and odd_id is not null").select("odd_id"), 16) if by_hash else None
        nodes = signed.groupBy("k1", "k2", "n", "bands").agg(F.min("id").alias("least"))
        if by_hash:
            nodes = nodes.join(several, F.col("least") == F.col("odd_id"), "left").withColumn("least", F.when(F.col("odd_id").isNull(), F.col("least")))
        nodes = hold(nodes.select("k1", "k2", "n", "bands", F.coalesce("least", "k1").alias("node")))
        entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
        sizes = cut(entries.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "sizes")
        shared = cut(entries.join(sizes, "bucket"), "shared")
        # The member whose buckets are fullest lies in the middle of its group; it is the first to be compared.
        scores = shared.groupBy("node").agg(F.sum("members").alias("score"))
        best = cut(shared.join(scores, "node").groupBy("bucket").agg(F.max(F.struct("score", "node", "n")).alias("hub")), "hubs")
        stars = cut(_stars(shared, best, similarity), "stars")

        wanted = small(cut(shared.select(F.col("node").alias("wanted_node")).distinct(), "wanted"), 16)
        with _batches(spark):
            sets = hold(_sets(docs, wanted, several, repeats, id_col))
            sets.count()
        links = cut(_verified(stars, sets, similarity), "links")
        roots = components(links)

        # Buckets whose members are in several classes now: all members outside the largest class ask for partners in other classes.
        placed = shared.filter("members > 2").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        per_class = placed.groupBy("bucket", "root").agg(F.count("*").alias("m"))
        largest = per_class.groupBy("bucket").agg(F.max(F.struct("m", "root"))["root"].alias("largest"), F.count("*").alias("classes")).filter("classes > 1")
        split = cut(placed.join(cut(largest, "largest"), "bucket").groupBy("node", "root").agg(F.max(F.col("root") != F.col("largest")).alias("asking")), "asking")
        if not split.isEmpty():
            across = cut(prefix_candidates(split, sets, similarity).join(stars, ["a", "b"], "left_anti"), "across")
            more = cut(_verified(across, sets, similarity), "links")
            if not more.isEmpty():
                roots = _joined_up(roots, more)
        classes = nodes.join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("class_id"))
        rows = signed.select("id", "k1", "k2")
        if not by_hash:
            return cut(rows.join(classes, ["k1", "k2"]).select("id", "k1", "k2", "class_id", (F.col("id") == F.col("class_id")).alias("first")), "classes")
        # Some roots are hashes, so the least row of each class is looked up; its id names the class unless other texts have it too.
        rows = cut(rows.join(classes, ["k1", "k2"]), "rows")
        firsts = rows.filter("id is not null").groupBy("class_id").agg(F.min(F.struct("id", "k1", "k2")).alias("least"))
        firsts = firsts.join(several, F.col("least.id") == F.col("odd_id"), "left").select(F.col("class_id").alias("root"), "least", F.when(F.col("odd_id").isNull(), F.col("least.id")).alias("named"))
        rows = rows.join(firsts, F.col("class_id") == F.col("root"), "left")
        return cut(rows.select("id", "k1", "k2", F.coalesce("named", "class_id").alias("class_id"), F.coalesce(F.struct("id", "k1", "k2") == F.col("least"), F.lit(False)).alias("first")), "classes")


def _joined_up(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The roots of ``components`` after more links (a, b), which are followed between roots only."""
    at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    between = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    above = components(between).select(F.col("node").alias("root"), F.col("root").alias("above"))
    moved = roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return moved.union(above.select("root", "above").join(roots.select(F.col("node").alias("root")), "root", "left_anti"))


def _sets(docs: DataFrame, wanted: DataFrame, several: DataFrame | None, repeats: bool, id_col: str) -> DataFrame:
    """(node, shingles): the multiset of each wanted node, read from the row with its least id.

    Rows without an id and those whose id has several texts (``several``) are known by the hash of their text.
    """
    words = alnum_words(whole_text())
    rows = docs.select(F.col(id_col).cast("long").alias("node"), "text")
    if several is not None:
        rows = rows.join(several, F.col("node") == F.col("odd_id"), "left")
        by_hash = F.col("node").isNull() | F.col("odd_id").isNotNull()
        rows = rows.select(F.when(by_hash, _key(words, 1)).otherwise(F.col("node")).alias("node"), "text")
    found = rows.join(wanted, F.col("node") == F.col("wanted_node"), "left_semi")
    sets = found.select("node", _hashed(words).alias("words")).mapInArrow(_multisets, "node long, shingles array<long>")
    return sets.groupBy("node").agg(F.max("shingles").alias("shingles")) if repeats else sets


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, representative) of every document row; class_id is the least doc_id of its class, a hash if other classes share that id."""
    return _classes(docs, similarity, id_col).select(F.col("id").alias(id_col), "class_id", F.col("first").alias("representative"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id") -> DataFrame:
    """The documents without all but the first of each class by id, then by text; columns stay as they are. Rows without an id stay."""
    found = _classes(docs, similarity, id_col).filter("id is not null")
    gone_, again_, start_, k1_, k2_, place_ = unused(docs, "_gone", "_again", "_start", "_k1", "_k2", "_place")
    id_, key = F.col(id_col).cast("long"), _keys(alnum_words(whole_text()))
    per_id = cut(found.groupBy("id").agg(F.max("first").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "dropped")
    kept = docs.join(small(per_id.filter("not kept").select(F.col("id").alias(gone_)), 16), id_ == F.col(gone_), "left_anti")
    again = per_id.filter("kept").select(F.col("id").alias(again_))
    if again.isEmpty():
        return kept
    # Ids of several rows: of each class that starts here one row stays, the least by its text.
    again = small(again, 16)
    starts = found.filter("first").select(F.col("id").alias(start_), F.col("k1").alias(k1_), F.col("k2").alias(k2_)).distinct()
    rows = kept.join(again, id_ == F.col(again_), "left_semi")
    rows = rows.join(starts, (id_ == F.col(start_)) & (key[0] == F.col(k1_)) & (key[1] == F.col(k2_)), "left_semi")
    place = F.row_number().over(Window.partitionBy(id_col, *key).orderBy(F.col("text").asc_nulls_last()))
    rows = rows.withColumn(place_, place).filter(F.col(place_) == 1).drop(place_)
    return kept.join(again, id_ == F.col(again_), "left_anti").unionByName(rows)
