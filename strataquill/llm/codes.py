"""Compression of vectors to codes: eight parts, each replaced by the number of the nearest of 16 learned entries.

Components become whole numbers (``floor(4096 * x)``), so that all sums, means and distances are exact and no result depends
on the order of rows or partitions. Entries are learned in rounds: a round assigns each part to its nearest entry and takes
the floor of the mean. A task sends one sum for each entry and position, whatever the number of its rows, and Spark adds
them up; only codebooks (entries x components) come to the driver.

The nearest entry is found from coarse to fine. A part and an entry are described by the means of one, two, four, ...
segments and by the norm of what is left (the residual). The squared difference of the means, weighted by the segments'
lengths, plus the squared difference of the residual norms is never above the squared distance. Entries whose bound, less
a margin for rounding, is above an exact distance already known are dropped, the others go to the next level; what is left
after the finest gets its exact integer distance. Ties go to the lower index.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Null ids come last when the
first entries are chosen, equal ids in order of their vectors; with fewer than ``entries`` vectors there are as many
entries as vectors. A vector of another length than the first has null code and error; parts of a length that ``parts``
doesn't divide differ by one component at most. Repeated rows count as often as they stand there. Components of 2^24 and
more are computed in whole numbers of any size, without bounds; an error that a long can't hold is null, as is a label's
sum of such. Null labels are one label. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.session import cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
SMALL = 1 << 24  # below it, squared distances of up to 2^13 components fit in 64 bits
MOST_LABELS = 1 << 16  # rows of two short columns that are broadcast


def usable(vector: Column) -> Column:
    """Whether a vector of doubles has finite components only; false for null."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``, exact: as 64-bit numbers, or as Python's where one is too large."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * float(SCALE))
    if not out.size or np.abs(out).max() < SMALL:
        return out.astype(np.int64)
    big = [int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE) for x in vectors.ravel().tolist()]
    return np.array([*big, None], object)[:-1].reshape(vectors.shape)


def borders(length: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [length * k // max(parts, 1) for k in range(parts + 1)]


def _described(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of ``segments`` segments, their lengths, and the norm of what the means leave."""
    at = borders(v.shape[1], segments)
    lengths = np.diff(at)
    means = np.add.reduceat(v, at[:-1], axis=1) / lengths
    return means, lengths, np.sqrt(((v - np.repeat(means, lengths, axis=1)) ** 2).sum(axis=1))


def nearest(v: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest of ``entries`` for each row of ``v`` (whole numbers), exactly."""
    if not v.shape[1]:
        return np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    if v.dtype == object or entries.dtype == object:
        away = ((v.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(axis=2)
        index = np.array([min(range(len(row)), key=lambda j: row[j]) for row in away.tolist()], np.int64)
        return index, away[np.arange(len(v)), index]
    exact = lambda i, j: ((v[i] - entries[j]) ** 2).sum(axis=1)
    rows = np.arange(len(v))
    alive, known, segments = np.ones((len(v), len(entries)), bool), None, 1
    while segments < v.shape[1]:
        (m, lengths, rest), (m_e, _, rest_e) = _described(v, segments), _described(entries, segments)
        i, j = np.nonzero(alive)
        bound = (lengths * (m[i] - m_e[j]) ** 2).sum(axis=1) + (rest[i] - rest_e[j]) ** 2
        if known is None:
            known = exact(rows, bound.reshape(alive.shape).argmin(axis=1))
        alive[i, j] = bound * (1 - 1e-9) - 1 <= known[i]
        segments *= 2
    i, j = np.nonzero(alive)
    away = np.full(alive.shape, np.iinfo(np.int64).max)
    away[i, j] = exact(i, j)
    index = away.argmin(axis=1)
    return index, away[rows, index]


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return whole(np.asarray(column.flatten()).reshape(len(column), length))


def _limbs(total: int) -> list[int]:
    """A number of any size as digits to base 2^32, the last of which has the sign."""
    out = []
    while not -(1 << 31) <= total < 1 << 31:
        out.append(total & 0xFFFFFFFF)
        total >>= 32
    return [*out, total]


def _sums(vectors: DataFrame, books: list[np.ndarray], length: int) -> dict[tuple[int, int, int], int]:
    """By part, entry and position the sum of the parts nearest to that entry; at position -1 their number."""
    at = borders(length, len(books))
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("embedding"), length)
            for p, book in enumerate(shared.value):
                own = v[:, at[p] : at[p + 1]]
                index, _ = nearest(own, book)
                for k in np.unique(index).tolist():
                    some = own[index == k]
                    row = np.array([*some.sum(axis=0).tolist(), len(some)], object)
                    total[p, k] = total[p, k] + row if (p, k) in total else row
        rows = [(p, k, x - (x == len(row) - 1) * len(row), n, digit) for (p, k), row in total.items() for x, s in enumerate(row.tolist()) for n, digit in enumerate(_limbs(s))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], ["part", "entry", "position", "limb", "digit"])

    sent = vectors.select("embedding").mapInArrow(run, "part long, entry long, position long, limb long, digit long")
    out: dict[tuple[int, int, int], int] = {}
    # entries x (components + parts) x a few digits: bounded by the codebooks' size
    for r in sent.groupBy("part", "entry", "position", "limb").agg(F.sum("digit").alias("digit")).collect():
        key = (r["part"], r["entry"], r["position"])
        out[key] = out.get(key, 0) + (r["digit"] << 32 * r["limb"])
    return out


def _book(rows: list[list[int]], width: int) -> np.ndarray:
    big = any(abs(x) >= SMALL for row in rows for x in row)
    return np.array([x for row in rows for x in row], object if big else np.int64).reshape(len(rows), width)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part, from ``vectors`` (vec_id, embedding of usable doubles); none for an empty table."""
    first = [r["embedding"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()]
    if not first:
        return []
    length = len(first[0])
    same = np.array([e for e in first if len(e) == length], np.float64).reshape(-1, length)
    start, at = whole(same), borders(length, parts)
    books = [_book(start[:, at[p] : at[p + 1]].tolist(), at[p + 1] - at[p]) for p in range(parts)]
    like_first = vectors.where(F.size("embedding") == length)
    for _ in range(rounds):
        sums = _sums(like_first, books, length)
        books = [
            _book([[sums[p, k, x] // n for x in range(book.shape[1])] if (n := sums.get((p, k, -1), 0)) else row for k, row in enumerate(book.tolist())], book.shape[1])
            for p, book in enumerate(books)
        ]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error for ``vectors`` (vec_id, label, embedding of usable doubles)."""
    length = sum(b.shape[1] for b in books)
    at = borders(length, len(books))
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = np.asarray(b.column("embedding").value_lengths()) == length
            codes, errors = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            if fits.any():
                v = _matrix(b.column("embedding").filter(pa.array(fits)), length)
                each = [nearest(v[:, at[p] : at[p + 1]], book) for p, book in enumerate(shared.value)]
                codes[fits] = ["".join(f"{k:02x}" for k in row) for row in np.stack([i for i, _ in each], axis=1).tolist()]
                totals = (sum(column) for column in zip(*(d.tolist() for _, d in each), strict=True))
                errors[fits] = [x if x < 1 << 63 else None for x in totals]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the sum of ``error`` over equal labels. Sums are broadcast while there are few labels; beyond that those of the
    labels with most rows, which can only be few, and the others are joined."""
    sums = cut(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    n_labels, n_rows = sums.agg(F.count(F.lit(1)), F.sum("n")).first()

    def joined(rows: DataFrame, few: DataFrame) -> DataFrame:
        few = few.select(F.col("label").alias("of"), "label_error")
        return rows.join(few, rows["label"].eqNullSafe(few["of"]), "left").drop("of")

    if n_labels <= MOST_LABELS:
        return joined(coded, F.broadcast(sums))
    hot = F.col("n") * MOST_LABELS > n_rows
    marked = joined(coded, F.broadcast(sums.where(hot)).withColumn("label_error", F.struct("label_error")))
    rest = joined(marked.where("label_error is null").drop("label_error"), sums.where(~hot))
    return marked.where("label_error is not null").withColumn("label_error", F.col("label_error.label_error")).unionByName(rest)


def listed(books: list[np.ndarray]) -> str:
    """All components of all entries by part, entry and position."""
    return ",".join(str(x) for book in books for row in book.tolist() for x in row)


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for each usable row of ``table``, and the codebooks."""
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[label_col].alias("label"), table[vector_col].cast("array<double>").alias("embedding"))
    vectors = rows.where(usable(F.col("embedding")))
    books = fit(vectors, parts, entries, rounds)
    coded = cut(encode(vectors, books))
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(hashlib.sha256(listed(books).encode()).hexdigest())), books
