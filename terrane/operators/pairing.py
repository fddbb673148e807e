"""Joins with the semantics of record building: pairing, resuming, lookups, neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of paths.
PASS_WORDS = ("pass", "passed", "positive", "good", "compliant", "secure", "correct", "allowed")
FAIL_WORDS = ("fail", "failed", "negative", "bad", "example_", "wrong", "insecure", "violated", "denied", "vulnerable")
#: A side of at most this many rows is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts ``df`` if it is proven to have at most ``rows`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pair_first(rows: DataFrame, group: str, failing: Column, passing: Column, order: str, value: str) -> DataFrame:
    """Each failing row with its group's first passing value; without one the pair stays open (has_fix false)."""
    firsts = rows.filter(passing).groupBy(F.col(group).alias("_g")).agg(F.min(F.struct(order, value)).alias("_p"))
    pairs = rows.filter(failing).join(firsts, F.col(group) == F.col("_g"), "left")
    return pairs.withColumns({"after_value": F.col("_p")[value], "has_fix": F.col("_p").isNotNull()}).drop("_g", "_p")


def path_verdict(path: Column, strict: bool = False) -> Column:
    """pass, fail or neither by the path's parts and stem; passing words are tested first, so "insecure" passes unless strict."""
    lowered = F.lower(path)
    parts, stem = F.split(lowered, "/"), F.regexp_replace(F.element_at(F.split(lowered, "/"), -1), r"(?<=.)\.[^.]+$", "")

    def told(words: tuple[str, ...]) -> Column:
        inside = F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))
        for w in words:
            inside = inside | (stem.rlike(rf"(?<![a-z]){w}") if strict else stem.contains(w))
        return inside

    return F.when(told(PASS_WORDS), "pass").when(told(FAIL_WORDS), "fail")


def not_done(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: rows whose keys aren't among the done ones."""
    return new.join(done.select(*keys).distinct(), keys, "left_anti")


def not_stored(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """``not_done`` against a table bucketed by the keys: only the new rows are shuffled, to the table's buckets."""
    return new.join(stored.select(*keys).hint("merge"), keys, "left_anti")


def lookup(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left lookup in a dimension with one row per key."""
    return rows.join(small(dimension), key, "left")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def _matrix(vectors: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of ``width`` doubles, filled up with zeros, and their lengths; -1 for one that is null or holds a null."""
    rows = pa.concat_arrays(vectors.chunks).cast(pa.list_(pa.float64())) if vectors.num_chunks else pa.array([], pa.list_(pa.float64()))
    flat, ends = rows.flatten(), np.cumsum(lengths := pc.fill_null(pc.list_value_length(rows), 0).to_numpy())
    out, at = np.zeros((len(rows), width)), np.repeat(np.arange(len(rows)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    told = np.where(rows.is_null().to_numpy(zero_copy_only=False), -1, lengths)
    told[at[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, told


def _nearest_met(queries: pa.Table, vectors: pa.Table, k: int, tile: int = 256, first: int = 1024) -> pa.Table:
    """(query_id, vec_id, distance): the ``k`` nearest of some vectors for each of some queries, none beyond the query's ``bound`` if there is that column.

    Products of matrices tell which pairs may be among them, with a margin above their rounding errors; the distances of these are summed as ``distance`` sums them.
    """
    names = pa.schema([("query_id", queries["query_id"].type), ("vec_id", vectors["vec_id"].type), ("distance", pa.float64())])
    if not (queries.num_rows and vectors.num_rows):
        return names.empty_table()
    width = max(pc.max(pc.list_value_length(x["embedding"])).as_py() or 0 for x in (queries, vectors))
    (q, q_len), (v, v_len) = _matrix(queries["embedding"], width), _matrix(vectors["embedding"], width)
    place = pc.rank(vectors["vec_id"], null_placement="at_start", tiebreaker="dense").to_numpy()

    def squares(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lengths, and which rows products say nothing about: nulls, other lengths, components that are not finite or huge."""
        with np.errstate(all="ignore"):
            found = (x * x).sum(axis=1)
        return found, (length != width) | ~(found < 1e300)

    (q_sq, q_odd), (v_sq, v_odd) = squares(q, q_len), squares(v, v_len)
    plain_q, plain_v = np.where(q_odd[:, None], 0.0, q), np.where(v_odd[:, None], 0.0, v)
    q_sq, v_sq = np.where(q_odd, 0.0, q_sq), np.where(v_odd, np.inf, v_sq)
    margin = 8 * (width + 8) * np.finfo(float).eps * (q_sq + v_sq[~v_odd].max(initial=0.0))
    bound = queries["bound"].to_numpy() if "bound" in queries.column_names else np.full(len(q), np.inf)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), tile):
        b = slice(a, a + tile)
        near = q_sq[b, None] + v_sq - 2.0 * (plain_q[b] @ plain_v.T)
        some = near[:, :first]
        limit = np.partition(some, k - 1, axis=1)[:, k - 1] if some.shape[1] >= k else np.full(len(some), np.inf)
        limit = np.minimum(limit, np.square(bound[b])) + 2 * margin[b]
        met = near <= limit[:, None]
        met[:, v_odd] = True
        met[q_odd[b]] = True
        i, j = np.nonzero(met)
        i += a
        total = np.zeros(len(i))
        with np.errstate(all="ignore"):
            for c in range(width):
                gap = v[j, c] - q[i, c]
                total += gap * gap
            d = np.sqrt(total)
        null = (q_len[i] < 0) | (q_len[i] != v_len[j])
        order = np.lexsort((place[j], np.where(null, 0.0, d), null, i))
        i, j, d, null = i[order], j[order], d[order], null[order]
        keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (null | ~(d > bound[i]))
        parts.append((i[keep], j[keep], d[keep], null[keep]))
    i, j, d, null = (np.concatenate(x) for x in zip(*parts, strict=True))
    found = [pc.take(queries["query_id"], pa.array(i)), pc.take(vectors["vec_id"], pa.array(j)), pa.array(d, mask=null)]
    return pa.Table.from_arrays(found, schema=names)


def _met(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, distance): for each value of the keys the nearest of its vectors (vec_id, embedding) for its queries (query_id, embedding, perhaps bound)."""
    kind = lambda rows, name: rows.schema[name].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, vec_id {kind(vectors, 'vec_id')}, distance double"
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(lambda a, b: _nearest_met(a, b, k), schema)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query's pairs; those without a distance come last."""
    rank = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
    return near.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def _parts(count: int, block: int) -> Column:
    """Numbers of the parts that so many rows are dealt into."""
    return F.sequence(F.lit(0), F.lit(max(1, -(-count // block)) - 1))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 16_384) -> DataFrame:
    """(query_id, vec_id, distance, rank): Euclidean neighbours of a stated set of queries among all vectors.

    Both sides are dealt into parts of about ``block`` rows, and each part of the one meets each of the other in a task that holds
    these two alone and passes on ``k`` rows a query.
    """
    v_parts, q_parts = _parts(vectors.count(), block), _parts(queries.count(), block)
    own = lambda parts: F.pmod(F.xxhash64("vec_id"), F.size(parts)).cast("int")
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding", own(q_parts).alias("q"), F.explode(v_parts).alias("v"))
    rows = vectors.select("vec_id", "embedding", own(v_parts).alias("v"), F.explode(q_parts).alias("q"))
    return _ranked(_met(asked, rows, ["q", "v"], k), k)


def nearest_by_cells(queries: DataFrame, vectors: DataFrame, k: int, cells: int = 64, probes: int = 8) -> DataFrame:
    """(query_id, vec_id, distance, rank) through an index: every vector lies in the cell of its nearest centre, and a query looks into its ``probes`` nearest cells.

    Centres are ``cells`` sampled vectors (those with the least hashes of their ids), a bound that holds for any input; every row is indexed.
    Neighbours outside the probed cells are missed: with all cells probed the result is exact.
    """
    centres = vectors.orderBy(F.md5(F.col("vec_id").cast("string"))).limit(cells).agg(F.collect_list("embedding").alias("centres"))
    places = F.transform("centres", lambda c, i: F.struct(distance(F.col("embedding"), c).alias("d"), i.alias("cell")))
    measured = lambda rows: rows.crossJoin(F.broadcast(centres)).withColumn("places", places)
    indexed = measured(vectors).select("vec_id", "embedding", F.array_min("places")["cell"].alias("cell"))
    asked = measured(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"), F.explode(F.slice(F.array_sort("places"), 1, probes)).alias("p"))
    found = asked.select("query_id", "qe", F.col("p.cell").alias("cell")).join(indexed, "cell")
    found = found.select("query_id", "vec_id", distance(F.col("embedding"), F.col("qe")).alias("distance"))
    rank = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def nearest_by_radii(queries: DataFrame, vectors: DataFrame, k: int, folder: str, cells: int = 64, block: int = 16_384) -> DataFrame:
    """(query_id, vec_id, distance, rank) as ``nearest`` has them, through an index that proves what it leaves out.

    Every vector lies in the cell of its nearest centre and knows its distance from it; a cell is dealt into blocks of about ``block`` rows, so a
    crowded one is many tasks' work. In round one a query looks into as many of its nearest cells as hold ``k`` rows, which bounds the distance of its k-th neighbour.
    In round two it meets the cells that may hold something nearer: by the triangle inequality no row of a cell is nearer than the query's distance from
    the centre less the cell's radius. Queries are dealt into parts of about ``block`` too; a task holds a part and a block and passes on what the bound leaves.
    Rows and cells are kept in ``folder``; centres are ``cells`` sampled vectors, as in ``nearest_by_cells``.
    """
    spark = vectors.sparkSession
    centres = vectors.orderBy(F.md5(F.col("vec_id").cast("string"))).limit(cells).agg(F.collect_list("embedding").alias("centres"))  # ``cells`` vectors
    places = F.transform("centres", lambda c, i: F.struct(distance(F.col("embedding"), c).alias("d"), i.alias("cell")))
    measured = lambda rows: rows.select("vec_id", "embedding").crossJoin(F.broadcast(centres)).withColumn("places", places).drop("centres")
    indexed = measured(vectors).select("vec_id", "embedding", F.array_min("places").alias("p")).select("vec_id", "embedding", "p.cell", F.col("p.d").alias("from_centre"))
    indexed.write.partitionBy("cell").parquet(f"{folder}/rows")
    indexed = spark.read.schema(indexed.schema).parquet(f"{folder}/rows")
    sizes = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("from_centre").alias("radius"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    sizes.withColumn("blocks", blocks).write.parquet(f"{folder}/cells")
    sizes = F.broadcast(spark.read.schema("cell int, n long, radius double, blocks int").parquet(f"{folder}/cells"))  # at most ``cells`` rows
    rows = indexed.join(sizes.select("cell", "blocks"), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    parts = _parts(queries.count(), block)
    rows = rows.select("vec_id", "embedding", "cell", "block", F.explode(parts).alias("part"))
    asked = measured(queries).select(F.col("vec_id").alias("query_id"), "embedding", F.inline("places")).join(sizes, "cell")
    upto = Window.partitionBy("query_id").orderBy("d", "cell").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "part": F.pmod(F.xxhash64("query_id"), F.size(parts)).cast("int")})
    asked.write.parquet(f"{folder}/asked")
    asked = spark.read.schema(asked.schema).parquet(f"{folder}/asked")
    spread = lambda a, *more: a.select("query_id", "embedding", *more, "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    keys = ["cell", "block", "part"]
    first = _ranked(_met(spread(asked.filter(F.col("before") < k)), rows, keys, k), k)
    bound = first.groupBy("query_id").agg(F.max("distance").alias("bound"), F.count("distance").alias("m")).select("query_id", F.when((F.col("m") == k) & ~F.isnan("bound"), F.col("bound")).otherwise(float("inf")).alias("bound"))
    # Rounding of distances must not lose a neighbour at the bound itself.
    slack = F.col("bound") * (1 + 1e-9) + 1e-9
    least = F.col("d") - F.col("radius")
    left = least.isNull() | F.isnan(least) | (least <= slack)  # what is no number proves nothing
    again = asked.join(bound, "query_id").filter(left).withColumn("bound", slack)
    return _ranked(_met(spread(again, "bound"), rows, keys, k), k)
