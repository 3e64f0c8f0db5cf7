"""Short codes of vectors: each part of a vector becomes the number of its nearest codebook entry.

Codebooks are learned over all vectors in whole numbers, so results don't depend on the order of sums: every round
tasks assign their vectors and hand on counts and sums per entry, a table whose size doesn't depend on the
vectors. The nearest entry is found by partial distances: components are taken in the order of falling variance in
the codebook, and an entry is dropped for a vector as soon as its distance so far exceeds the best whole one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_batches, written

Book = np.ndarray  # (entries, width) of int64, or of Python ints where those could overflow

#: Below this size of numbers all sums of squares (of 65,536 components, or 256 entries' variances) fit in 64 bits.
PLAIN = 1 << 22

#: Sums travel as digits of this many bits.
DIGIT = 40

#: Greatest value of a long; errors beyond it are given as this.
MOST = (1 << 63) - 1

#: Labels that hold at least one in so many rows meet their sums by broadcast.
FREQUENT = 4096


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) of finite doubles, exactly; ``scale`` is a power of two."""
    if not values.size or np.abs(values).max() * scale < PLAIN:
        return np.floor(values * scale).astype(np.int64)
    out = np.array([int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in values.ravel().tolist()], object)
    return out.reshape(values.shape)


def fitting(book: list[list[int]]) -> Book:
    """A codebook as 64-bit numbers where they are small enough, else as Python ints."""
    wide = any(abs(v) >= PLAIN for entry in book for v in entry)
    out = np.empty((len(book), len(book[0]) if book else 0), object if wide else np.int64)
    for e, entry in enumerate(book):
        out[e] = entry
    return out


def nearest(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, its squared distance, and how many components were compared; ties go to the lower index."""
    if x.dtype != book.dtype:
        x, book = x.astype(object), book.astype(object)
    n, width = x.shape
    index, best = np.zeros(n, np.int64), np.zeros(n, x.dtype)
    if not width or not n:
        return index, best, 0
    k = len(book)
    variance = k * (book * book).sum(0) - book.sum(0) ** 2
    order = sorted(range(width), key=lambda j: (-variance[j], j))
    columns = [np.ascontiguousarray(x[:, j]) for j in order]
    for j, column in zip(order, columns, strict=True):
        best += (column - book[0, j]) ** 2
    compared = n * width
    for e in range(1, k):
        live, total = None, None  # all rows, until some are dropped
        limit = best
        for j, column in zip(order, columns, strict=True):
            step = ((column if live is None else column[live]) - book[e, j]) ** 2
            total = step if total is None else total + step
            compared += len(step)
            keep = total <= limit
            if not keep.all():
                live = np.flatnonzero(keep) if live is None else live[keep]
                total, limit = total[keep], limit[keep]
                if not len(live):
                    break
        better = total < limit
        rows = np.flatnonzero(better) if live is None else live[better]
        best[rows] = total[better]
        index[rows] = e
    return index, best, compared


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where consecutive parts begin and end; equal where ``dim`` divides by ``parts``."""
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def of_length(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dim`` components as a matrix, and which rows they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = np.asarray(column.value_lengths()) == dim
    rows = np.flatnonzero(fits)
    taken = column.take(pa.array(rows, pa.int64()))
    return np.asarray(taken.flatten(), np.float64).reshape(len(rows), dim), rows


class Codes:
    """Vectors as (key, label, vector of doubles), their dimension, and codebooks that ``learn`` moves."""

    def __init__(self, vectors: DataFrame, dim: int, parts: int, entries: int, scale: int):
        self.vectors, self.dim, self.parts, self.scale = vectors, dim, parts, scale
        first = vectors.where(F.size("vector") == dim).orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select("vector").collect() if dim else []
        start = whole_numbers(np.array([r["vector"] for r in first], np.float64).reshape(len(first), dim), scale).tolist()
        self.books = [fitting([v[a:b] for v in start]) for a, b in cuts(dim, parts)]

    def learn(self) -> int:
        """One round over all vectors; how many components were compared."""
        books, dim, parts, scale = self.books, self.dim, self.parts, self.scale
        k, widest = len(books[0]), max(b - a for a, b in cuts(dim, parts)) + 1

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, k, widest), object)  # the last of an entry's row is its count
            compared = 0
            for batch in batches:
                values, _ = of_length(batch.column(0), dim)
                x = whole_numbers(values, scale)
                for p, (a, b) in enumerate(cuts(dim, parts)):
                    index, _, n = nearest(x[:, a:b], books[p])
                    compared += n
                    own = np.zeros((k, b - a), x.dtype)
                    np.add.at(own, index, x[:, a:b])
                    sums[p, :, : b - a] += own.astype(object)
                    sums[p, :, -1] += np.bincount(index, minlength=k).astype(object)
            slots, digits, values = [-1], [0], [compared]
            for slot, v in enumerate(int(v) for v in sums.ravel()):
                digit = 0
                while v:
                    high = v >> DIGIT
                    last = high in (0, -1) or abs(v) < 1 << DIGIT
                    slots.append(slot)
                    digits.append(digit)
                    values.append(v if last else v & (1 << DIGIT) - 1)
                    v, digit = (0 if last else high), digit + 1
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(digits, pa.int32()), pa.array(values, pa.int64())], ["slot", "digit", "n"])

        summed = self.vectors.select("vector").mapInArrow(add_up, "slot long, digit int, n long").groupBy("slot", "digit").agg(F.sum("n").alias("n"))
        total, compared = np.zeros(parts * k * widest, object), 0
        for r in summed.collect():  # a number per component of the codebooks, and a few more digits
            if r["slot"] < 0:
                compared = r["n"]
            else:
                total[r["slot"]] += r["n"] << DIGIT * r["digit"]
        total = total.reshape(parts, k, widest)
        self.books = [fitting([[int(total[p, e, j]) // int(total[p, e, -1]) if total[p, e, -1] else int(v) for j, v in enumerate(book[e])] for e in range(k)]) for p, book in enumerate(books)]
        return compared

    def coded(self) -> DataFrame:
        """(key, label, code, error) of all vectors."""
        books, dim, parts, scale = self.books, self.dim, self.parts, self.scale

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, rows = of_length(batch.column(2), dim)
                x = whole_numbers(values, scale)
                codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
                found = [nearest(x[:, a:b], books[p])[:2] for p, (a, b) in enumerate(cuts(dim, parts))]
                digits = np.stack([index for index, _ in found], 1).astype(np.uint8).tobytes().hex()
                distances = np.stack([d.astype(object) for _, d in found], 1).sum(1)
                for i, row in enumerate(rows.tolist()):
                    codes[row] = digits[2 * parts * i : 2 * parts * (i + 1)]
                    errors[row] = min(MOST, int(distances[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["key", "label", "code", "error"])

        kinds = self.vectors.schema
        return self.vectors.mapInArrow(encode, f"key {kinds['key'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long")

    def sha256(self) -> str:
        """The digest of all entries' components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for book in self.books for entry in book for v in entry).encode()).hexdigest()


def fit(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """Codebooks after ``rounds`` rounds over all vectors; see ``codes``."""
    if not 0 < entries <= 256 or scale & scale - 1:
        raise ValueError("entries must be 1 to 256, and scale a power of two")
    column = F.col(f"`{vector}`").cast("array<double>")
    finite = ~F.exists(F.col("vector"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    slim = embeddings.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), column.alias("vector"))
    vectors = text_batches(slim).where(F.col("vector").isNotNull() & finite)
    lengths = vectors.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    made = Codes(vectors, lengths["n"] if lengths else 0, parts, entries, scale)
    for _ in range(rounds if len(made.books[0]) else 0):
        made.learn()
    return made


def codes(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **how: int) -> DataFrame:
    """One row per vector of finite components: key, code, error, label_error, codebooks_sha256.

    Components become floor(4096 * x), and vectors are cut into 8 consecutive parts (equal ones; else they differ by
    one). A part's codebook starts with that part of the 16 vectors of the smallest keys (null keys last, ties by the
    vectors; all if there are fewer) and is moved by 6 rounds over all vectors: assign to the nearest entry, ties to
    the lower, then set each used entry to the floors of its parts' means. ``code`` has two hex digits a part.
    ``label_error`` sums errors over equal labels, nulls together. Numbers of any size are exact; an error beyond a
    long is given as the greatest long. Null vectors, and those with a null or non-finite component, are dropped;
    vectors of another length than most (the longer of equals) keep their rows with null code and error. Equal keys
    and equal vectors stay rows of their own; other columns are ignored; an empty table gives no rows.
    """
    made = fit(embeddings, key, vector, label, **how)
    # labels as text of bounded length, never null
    marked = F.when(F.col("label").isNull(), "").otherwise(F.sha2(F.col("label").cast("string"), 256))
    coded = written(made.coded().select("key", marked.alias("mark"), "code", "error"), "coded")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(total > MOST, MOST).otherwise(total.cast("long"))  # null where no row of a label has an error
    sums = written(coded.groupBy("mark").agg(total.alias("label_error"), F.count("*").alias("n")), "labels", 64)
    least = -(-(coded.count()) // FREQUENT)
    frequent = sums.where(F.col("n") >= least).select("mark", "label_error")  # at most FREQUENT rows of 72 bytes
    others = sums.where(F.col("n") < least).select("mark", "label_error")
    met = coded.join(F.broadcast(frequent), "mark").unionByName(coded.join(others, "mark"))
    return met.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(made.sha256()).alias("codebooks_sha256"))
