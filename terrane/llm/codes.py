"""Compression of vectors to codes: a codebook per part of the vector, fitted and applied by Yinyang Lloyd over integers.

Components become integers, vectors are cut into equal parts, and every part position has a codebook of its own. Rounds of Lloyd assign each part to
its nearest entry and move entries to the means (rounded down) of their parts. Entries of a codebook are clustered into groups once. A part
keeps an upper bound of the distance to its entry and one lower bound per group of the distance to the group's other entries.
After entries have moved, the upper bound grows by the drift of its entry, a group's bound shrinks by the largest drift in the group; only groups whose
bound no longer exceeds the upper bound are scanned, and their distances are compared as integers, ties going to the lower index. Bounds are rounded away
from each other and compared with a margin, so they only ever spare work: the result is that of plain Lloyd, bit by bit.

A round reads and writes the vectors with their bounds once, as a table in the shared folder. Sums of entries change only by the parts that changed
their entry; every task adds those up over all its rows, so what is shuffled and brought to the driver is a codebook, whatever the number of vectors.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped; so are those whose length is not that of the vector with the
least id, or no positive multiple of the number of parts. Null ids come after all others, rows of one id in the order of their vectors; repeated rows are
coded each. Fewer rows than entries make shorter codebooks. Integers beyond ``_largest`` are held there (from about 32,768 for 64 components),
so that no distance overflows. Null labels are one label. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Groups that the entries of a codebook are clustered into, and the rounds that cluster them.
GROUPS, GROUPING_ROUNDS = 4, 5
#: Rows of a batch.
BATCH = 8192
#: A bound has to clear another by this much (relative, absolute) to spare a scan.
MARGIN = (1e-6, 1e-3)
STATE = "_id {id}, _label {label}, q array<bigint>, code binary, before binary, upper array<float>, lower array<float>"


def _largest(width: int) -> int:
    """Integers up to this keep the sum of ``width`` squared differences below 2^62."""
    return 1 << ((60 - max(1, width - 1).bit_length()) // 2)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """(_id, _label, q): the kept vectors as integers."""
    v = F.col(vector)
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label).alias("_label"), v.cast("array<double>").alias("_v")).filter(finite_of("_v"))
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_v").select(F.size("_v").alias("n")).first()
    width = first.n if first else 0
    if not width or width % parts:
        return rows.limit(0).select("_id", "_label", F.array().cast("array<bigint>").alias("q"))
    most = float(_largest(width))
    held = lambda x: F.floor(F.least(F.greatest(x * F.lit(float(SCALE)), F.lit(-most)), F.lit(most)))
    return rows.filter(F.size("_v") == width).select("_id", "_label", F.transform("_v", held).cast("array<bigint>").alias("q"))


def finite_of(name: str) -> Column:
    """Whether an array of doubles is there and holds neither nulls nor what is not finite."""
    return F.coalesce(F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, width / parts): the parts of the rows with the least ids; at most ``entries`` rows reach the driver."""
    first = [r.q for r in rows.orderBy(F.col("_id").asc_nulls_last(), "q").limit(entries).select("q").collect()]
    return np.array(first, dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()


def grouping(books: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """(parts, entries): the group of each entry; entries near each other share one, as they drift alike."""
    out = np.zeros(books.shape[:2], dtype=np.int64)
    for p, book in enumerate(books.astype(np.float64)):
        centres = book[np.linspace(0, len(book) - 1, min(groups, len(book))).astype(int)].copy()
        for _ in range(GROUPING_ROUNDS):
            out[p] = ((book[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            for g in range(len(centres)):
                if (out[p] == g).any():
                    centres[g] = book[out[p] == g].mean(0)
    return out


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, as integers."""
    return np.stack([((x - e) ** 2).sum(1) for e in book], axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def assign_all(x: np.ndarray, book: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower) of parts that have no bounds yet: all entries are scanned."""
    d = _distances(x, book)
    code = d.argmin(1)
    upper, root = np.sqrt(d[np.arange(len(x)), code]), np.sqrt(d)
    root[np.arange(len(x)), code] = np.inf
    lower = np.full((len(x), groups), np.inf)
    for g in range(groups):
        if (group == g).any():
            lower[:, g] = root[:, group == g].min(1)
    return code, _up(upper), _down(lower)


def assign_again(x: np.ndarray, book: np.ndarray, drift: np.ndarray, group: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper, lower, entries scanned) after the entries moved by ``drift``; groups whose bound holds aren't looked at."""
    groups = lower.shape[1]
    code, upper, lower = code.copy(), upper.astype(np.float64) + drift[code], lower.astype(np.float64).copy()
    for g in range(groups):
        if (group == g).any():
            lower[:, g] -= drift[group == g].max()
    clears = lambda up, low: low > up * (1 + MARGIN[0]) + MARGIN[1]
    open_ = np.flatnonzero(~clears(upper, lower.min(1)))
    scanned = len(open_)
    if not scanned:
        return code, _up(upper), _down(lower), 0
    # The own entry's true distance often closes what its bound left open.
    own = ((x[open_] - book[code[open_]]) ** 2).sum(1)
    upper[open_] = np.sqrt(own)
    failing = ~clears(upper[open_, None], lower[open_])
    best, best_d = code[open_].copy(), own.copy()
    for g in range(groups):
        members, hit = np.flatnonzero(group == g), np.flatnonzero(failing[:, g])
        if not len(members) or not len(hit):
            continue
        d = _distances(x[open_[hit]], book[members])
        scanned += d.size
        at = d.argmin(1)
        near, near_d = members[at], d[np.arange(len(hit)), at]
        wins = (near_d < best_d[hit]) | ((near_d == best_d[hit]) & (near < best[hit]))
        best[hit[wins]], best_d[hit[wins]] = near[wins], near_d[wins]
        # Bounds of scanned groups are made anew, without the entry that a part had before.
        root = np.sqrt(d)
        root[members[None] == code[open_[hit]][:, None]] = np.inf
        lower[open_[hit], g] = root.min(1)
    moved = np.flatnonzero(best != code[open_])
    rows = open_[moved]
    # The entry left behind belongs to the others of its group now, the one taken no longer does: its distance in the bound is only lower than need be.
    left = group[code[rows]]
    lower[rows, left] = np.minimum(lower[rows, left], np.sqrt(own[moved]))
    code[open_], upper[open_] = best, np.sqrt(best_d)
    return code, _up(upper), _down(lower), scanned


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), kind))


def _codes(matrix: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(matrix.astype(np.uint8))
    offsets = np.arange(0, data.size + 1, data.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _read_codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, parts).astype(np.int64)


def _round(books: np.ndarray, drift: np.ndarray | None, group: np.ndarray, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assigns the parts of every row: from scratch without ``drift``, else through the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                n = batch.num_rows
                q = _matrix(batch["q"], n).reshape(n, parts, -1)
                old = np.zeros((n, parts), np.int64) if drift is None else _read_codes(batch["code"], parts)
                code, upper, lower = old.copy(), np.zeros((n, parts), np.float32), np.zeros((n, parts, groups), np.float32)
                if drift is not None:
                    upper, lower = _matrix(batch["upper"], n).copy(), _matrix(batch["lower"], n).reshape(n, parts, groups).copy()
                for p in range(parts):
                    if drift is None:
                        code[:, p], upper[:, p], lower[:, p] = assign_all(q[:, p], books[p], group[p], groups)
                    else:
                        code[:, p], upper[:, p], lower[:, p], _ = assign_again(q[:, p], books[p], drift[p], group[p], old[:, p], upper[:, p], lower[:, p])
                before = np.full_like(old, 255) if drift is None else old
                columns = [batch["_id"], batch["_label"], batch["q"], _codes(code), _codes(before), _lists(upper, pa.float32()), _lists(lower.reshape(n, -1), pa.float32())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_label", "q", "code", "before", "upper", "lower"])

    return run


def _changes(parts: int, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task's rows add to the sums and counts of entries, and take away: (part, entry, place, change); place -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            q = _matrix(batch["q"], n).reshape(n, parts, -1)
            code, before = _read_codes(batch["code"], parts), _read_codes(batch["before"], parts)
            total = np.zeros((parts, entries, q.shape[2] + 1), np.int64) if total is None else total
            for p in range(parts):
                moved = np.flatnonzero(code[:, p] != before[:, p])
                rows = np.concatenate([q[moved, p], np.ones((len(moved), 1), np.int64)], axis=1)
                np.add.at(total[p], code[moved, p], rows)
                had = before[moved, p] < entries
                np.subtract.at(total[p], before[moved, p][had], rows[had])
        if total is not None:
            p, e, c = np.nonzero(total)
            values = [Decimal(int(v)) for v in total[p, e, c]]
            place = np.where(c == total.shape[2] - 1, -1, c)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(place, pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["part", "entry", "place", "change"])

    return run


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, np.ndarray]:
    """The rows with their final codes (and bounds), and the final codebooks. ``rows`` come from ``integers``, as a table that was cut."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = STATE.format(id=kinds["_id"], label=kinds["_label"])
    books = first_codebooks(rows, parts, entries)
    entries = books.shape[1]
    group, drift = grouping(books, groups), None
    sums = [[[0] * books.shape[2] + [0] for _ in range(entries)] for _ in range(parts)]
    state = rows
    for _ in range(rounds):
        state = cut(state.mapInArrow(_round(books, drift, group, groups), schema), "codes")
        moved = state.filter(F.col("code") != F.col("before")).select("q", "code", "before")
        changes = moved.mapInArrow(_changes(parts, entries), "part int, entry int, place int, change decimal(38,0)")
        for r in changes.groupBy("part", "entry", "place").agg(F.sum("change").alias("change")).collect():
            sums[r.part][r.entry][r.place] += int(r.change)
        moved_to = books.copy()
        for p in range(parts):
            for e in range(entries):
                *total, count = sums[p][e]
                if count:
                    moved_to[p, e] = [s // count for s in total]
        # Distances of up to 2^62 squared fit a double to within the margin.
        drift = np.sqrt(((moved_to - books).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12)
        books = moved_to
    return cut(state.mapInArrow(_round(books, drift, group, groups), schema), "codes"), books


def _errors(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_id, _label, code, error): codes as hex digits and the final squared distances added up over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            q, code = _matrix(batch["q"], n).reshape(n, parts, -1), _read_codes(batch["code"], parts)
            error = sum(((q[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
            digits = pa.array([c.hex() for c in batch["code"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_label"], digits, pa.array(error, pa.int64())], names=["_id", "_label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept vector."""
    rows = cut(integers(vectors, id_col, vector, label, parts), "vectors")
    if rows.isEmpty():
        empty = rows.select(F.col("_id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.withColumn("codebooks_sha256", F.lit(digest(np.zeros(0, np.int64))))
    state, books = fit(rows, parts, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = cut(state.mapInArrow(_errors(books), f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error bigint"), "coded")
    # Labels are added up before the shuffle; their table is broadcast only if it is proven small.
    totals = cut(coded.groupBy(F.col("_label").alias("_l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long").alias("label_error")), "labels", gather=True)
    joined = coded.join(small(totals, F.coalesce(F.octet_length(F.col("_l").cast("string")), F.lit(0)) + 64), F.col("_label").eqNullSafe(F.col("_l")))
    return joined.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
