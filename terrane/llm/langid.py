"""Language identification by the nearest centroid of normalised TF-IDF vectors of letter n-grams.

A text's letters, lower-cased, with one space for whatever lies between them, give 1-, 2- and 3-grams, hashed to ``DIMS`` features. Features are
weighted by (1 + log tf) * idf and normalised. The training rows of each language are clustered into ``CENTROIDS`` centroids (spherical k-means); a text gets the
language of the centroid of greatest cosine. Each centroid knows the cosine that all but ``REJECT`` of its training rows reach: a text farther away from
its nearest centroid is ``rejected``; ``lang_pred`` names the nearest language nonetheless, as callers may want either.

Training reads a sample bounded by ``SAMPLE`` rows a language (in expectation, drawn by hash) and ``LANGUAGES`` languages (the most frequent); all else sees every row and whole texts.
Sample rows are vectors in a table; every round of clustering is a Spark job that sums vectors by centroid in the tasks, and only centroids
(``LANGUAGES * CENTROIDS`` of ``DIMS`` numbers at most) go through the driver.

Defined cases: a null text or one without a letter is ``und`` with score 0, not rejected; texts whose n-grams were never seen get score 0, the first
language by name and are rejected; ties go to the first language by name; without training rows all texts are ``und``; repeated rows are predicted each; a null id
reads as an empty one in the split; an empty table gives an empty result; other columns, clashing names included, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text

#: Features that n-grams are hashed to, centroids a language, rounds of clustering.
DIMS, CENTROIDS, CLUSTER_ROUNDS = 8192, 4, 5
#: Training rows a language (expected) and languages that are learned, at most.
SAMPLE, LANGUAGES = 2_000, 200
#: Share of a centroid's training rows that its bound of distance leaves out.
REJECT = 0.01
#: Code points that are taken at a time, and rows whose vectors are scored together.
PIECE, ROWS = 1 << 20, 128
#: The fold that is held out, of so many.
HELD_OUT, FOLDS = 2, 4


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row may not be learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, taken in pieces that overlap by the two code points a 3-gram reaches back; None without a letter."""
    total, tail, seen = np.zeros(DIMS, dtype=np.int64), np.zeros(1, dtype=np.uint32), False
    for start in range(0, len(text), PIECE):
        code = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[code]
        seen = seen or bool(letter.any())
        code = np.concatenate([tail, np.where(letter, code, 0), np.zeros(1 if start + PIECE >= len(text) else 0, np.uint32)])
        # One space for a run of what isn't a letter.
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
        code = code[keep]
        new = min(len(tail), len(code))
        one = code[new:]
        two = code[max(new - 1, 0) :]
        grams = [one[one != 0] * np.uint32(2654435761)]
        if len(two) > 1:
            grams.append((two[:-1] * np.uint32(2246822519)) ^ (two[1:] * np.uint32(3266489917)) ^ np.uint32(0x9E3779B9))
        if len(code) > 2:
            three = code[max(new - 2, 0) :]
            grams.append((three[:-2] * np.uint32(668265263)) ^ (three[1:-1] * np.uint32(374761393)) ^ (three[2:] * np.uint32(2869860233)))
        for g in grams:
            g = g ^ (g >> np.uint32(15))
            total += np.bincount((g * np.uint32(2246822507)) >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)
        tail = code[-2:]
    return total if seen else None


def _tf(row: np.ndarray) -> np.ndarray:
    """1 + log of the counts that aren't 0."""
    return np.where(row > 0, 1 + np.log(np.maximum(row, 1)), 0.0)


def training_rows(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """(lang, text, u) of the sampled training rows, and the languages to be learned. Counts cover all rows; the sample's share follows from them."""
    rows = docs.filter(~held_out(id_col) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), id_col)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return rows.limit(0).select("lang", "text", F.lit(0.0).alias("u")), []
    shares = F.create_map(*[F.lit(x) for lang_, n in sorted(sizes.items()) for x in (lang_, min(1.0, sample / n))])
    unit = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col).cast("string"), "text"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.withColumn("u", unit).filter(F.col("u") < F.coalesce(shares[F.col("lang")], F.lit(0.0)))
    return drawn.select("lang", "text", "u"), sorted(sizes)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, u, at, tf): sparse vectors of the training rows before idf."""
    for batch in batches:
        lang, u, at, tf = [], [], [], []
        for name, value, text in zip(batch["lang"].to_pylist(), batch["u"].to_pylist(), batch["text"]):
            row = counts(text.as_py())
            if row is not None:
                places = np.flatnonzero(row)
                lang.append(name), u.append(value), at.append(places.tolist()), tf.append(_tf(row[places]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(u, pa.float64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32()))], names=["lang", "u", "at", "tf"])


def _dense(batch: pa.RecordBatch, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows of a batch of sparse vectors."""
    x = np.zeros((batch.num_rows, DIMS), dtype=np.float32)
    for i in range(batch.num_rows):
        x[i, batch["at"][i].values.to_numpy()] = batch["tf"][i].values.to_numpy()
    x *= idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Centroids with their languages, the idf of the features, and the least cosine that each centroid accepts."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, least: np.ndarray):
        self.langs, self.idf, self.centroids, self.least = langs, idf.astype(np.float32), centroids.astype(np.float32), least

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, its cosine) of normalised rows; equal cosines go to the first."""
        cosines = x @ self.centroids.T
        best = cosines.argmax(1)
        return best, np.clip(cosines[np.arange(len(x)), best], 0.0, 1.0)


def _near(langs: list[str], centroids: np.ndarray, idf: np.ndarray, sums: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each training row meets the centroids of its own language. ``sums``: vectors added up by centroid, one row a centroid and task; else (centroid, cosine) rows."""
    own = {name: np.flatnonzero(np.array(langs) == name) for name in set(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x, near, cosine = _dense(batch, idf), [], []
                for row, name in zip(x, batch["lang"].to_pylist()):
                    found = centroids[own[name]] @ row
                    near.append(int(own[name][found.argmax()])), cosine.append(float(found.max()))
                if sums:
                    for k, row in zip(near, x):
                        total.setdefault(k, np.zeros(DIMS))
                        total[k] += row
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(cosine, pa.float64())], names=["centroid", "cosine"])
        for k, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))], names=["centroid", "total"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """The model of the training rows; None if there are none."""
    drawn, names = training_rows(docs, text, lang, id_col, sample)
    if not names:
        return None
    rows = cut(drawn.repartition(max(8, len(names))).mapInArrow(_vectors, "lang string, u double, at array<int>, tf array<float>"), "languages")
    df = {r.at: r.n for r in rows.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect()}  # at most DIMS rows
    n = rows.count()
    idf = np.array([np.log((1 + n) / (1 + df.get(i, 0))) + 1 for i in range(DIMS)], dtype=np.float32)
    # The rows of the least hashes are the first centroids; a sample that fell empty leaves its language out.
    langs, start = [], []
    for name in names:
        seeds = rows.filter(F.col("lang") == name).orderBy("u", "at").limit(centroids).select("at", "tf").collect()
        for s in seeds:
            x = np.zeros(DIMS, dtype=np.float32)
            x[s["at"]] = s["tf"]
            x *= idf
            langs.append(name), start.append(x / max(np.linalg.norm(x), 1e-12))
    if not langs:
        return None
    centre = np.array(start, dtype=np.float32)
    kept = rows.filter(F.col("lang").isin(sorted(set(langs))))
    for _ in range(CLUSTER_ROUNDS):
        sums = kept.mapInArrow(_near(langs, centre, idf, True), "centroid int, total array<double>")
        places = sums.select("centroid", F.posexplode("total").alias("i", "x")).filter("x <> 0").groupBy("centroid", "i").agg(F.sum("x").alias("x"))
        moved: dict[int, np.ndarray] = {}
        for k, at, x in ((r.centroid, r["at"], r["x"]) for r in places.groupBy("centroid").agg(F.collect_list("i").alias("at"), F.collect_list("x").alias("x")).collect()):
            moved[k] = np.zeros(DIMS)
            moved[k][at] = x
        centre = np.array([(moved[k] / max(np.linalg.norm(moved[k]), 1e-12)).astype(np.float32) if k in moved else c for k, c in enumerate(centre)])
    reach = kept.mapInArrow(_near(langs, centre, idf, False), "centroid int, cosine double").groupBy("centroid").agg(F.percentile_approx("cosine", F.lit(REJECT)).alias("least")).collect()
    least = np.zeros(len(langs))
    for r in reach:
        least[r.centroid] = r.least
    return Model(langs, idf, centre, least)


def _predict(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n = batch.num_rows
                names, score, rejected = np.array(["und"] * n, dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
                x, rows = [], []
                for i, text in enumerate(batch["_text"]):
                    row = counts(text.as_py() or "")
                    if row is not None and model is not None:
                        v = _tf(row).astype(np.float32) * model.idf
                        x.append(v / max(np.linalg.norm(v), 1e-12)), rows.append(i)
                if rows:
                    best, cosine = model.score(np.array(x))
                    names[rows] = [model.langs[b] for b in best]
                    score[rows], rejected[rows] = cosine, (cosine < model.least[best]) | (cosine <= 0)
                yield pa.RecordBatch.from_arrays([batch["_id"], batch["_held"], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["_id", "_held", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held"), whole_text(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_predict(model), f"_id {kind}, _held boolean, lang_pred string, score double, rejected boolean")
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "lang_pred", "score", "rejected")


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Learns from the rows that aren't held out and predicts all."""
    return predict(docs, fit(docs, text, lang, id_col), text, id_col)
