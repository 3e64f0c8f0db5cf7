"""Packing of whole documents into as few sequences as possible: best fit, then local search by exchanges.

Documents are encoded in the scan; from then on only a row of numbers per piece travels. These rows are dealt
into groups of about ``GROUP`` pieces, whatever their keys, and each group is packed by itself, which costs at
most about one sequence in each. A group is packed by best fit in falling order; then sequences that
aren't full are taken one after another, the fullest first, and filled from those behind: a piece moves, or
one or two pieces are exchanged for one or two of a sequence that is not fuller. Every exchange makes the
fuller sequence fuller, so the sum of squared fills grows and the last sequences empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns_of, pieces, text_batches, written
from .wordpieces import wordpieces

#: Pieces that are packed together, on average.
GROUP = 1 << 16


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of positions: the longest pieces first, each into the fullest bin that has room, else into a new one."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by room
    any_with = np.zeros(size + 1, bool)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = n + int(any_with[n:].argmax())
        if any_with[room]:
            b = with_room[room].pop()
            any_with[room] = bool(with_room[room])
        else:
            b, room = len(bins), size
            bins.append([])
        bins[b].append(i)
        if room > n:
            with_room[room - n].append(b)
            any_with[room - n] = True
    return bins


def pair_sums(lengths: list[int], size: int) -> dict[int, tuple[int, int]]:
    """Sum of two pieces of a bin -> their lengths; at most some 4,000 sums, as lengths of one bin sum up to ``size``."""
    counts: dict[int, int] = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    each = sorted(counts)
    return {a + b: (a, b) for k, a in enumerate(each) for b in each[k:] if (a < b or counts[a] > 1) and a + b <= size}


class Shelf:
    """Which bins have a piece of a length, or two of a summed length; ``upto[x]`` is the greatest such number up to x."""

    def __init__(self, size: int):
        self.bins: list[dict[int, None]] = [{} for _ in range(size + 1)]
        self.have = np.zeros(size + 1, np.int64)

    def add(self, n: int, b: int) -> None:
        self.bins[n][b] = None
        self.have[n] = n

    def drop(self, n: int, b: int) -> None:
        self.bins[n].pop(b, None)
        if not self.bins[n]:
            self.have[n] = 0

    def upto(self) -> np.ndarray:
        return np.maximum.accumulate(self.have)


class Search:
    """Local search over bins that aren't full; ``bins`` are lists of positions in ``lengths``."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], size: int):
        self.lengths, self.size, self.bins = lengths.tolist(), size, bins
        self.fill = [sum(self.lengths[i] for i in b) for b in bins]
        self.exchanges = 0

    def of(self, b: int) -> list[int]:
        return [self.lengths[i] for i in self.bins[b]]

    def shelve(self, b: int) -> None:
        each = self.of(b)
        for n in set(each):
            self.one.add(n, b)
        for n in pair_sums(each, self.size):
            self.two.add(n, b)

    def unshelve(self, b: int) -> None:
        each = self.of(b)
        for n in set(each):
            self.one.drop(n, b)
        for n in pair_sums(each, self.size):
            self.two.drop(n, b)

    def take(self, b: int, wanted: tuple[int, ...]) -> list[int]:
        """Removes pieces of these lengths from a bin."""
        out = []
        for n in wanted:
            i = next(i for i in self.bins[b] if self.lengths[i] == n)
            self.bins[b].remove(i)
            out.append(i)
        return out

    def best(self, b: int) -> tuple[int, tuple[int, ...], bool]:
        """The exchange that fills bin ``b`` most: what it gains, the pieces that it gives, and whether it gets two pieces."""
        gap, each = self.size - self.fill[b], self.of(b)
        singles = np.array([0, *sorted(set(each))], np.int64)
        sums = pair_sums(each, self.size)
        pairs = np.fromiter(sums, np.int64, len(sums))
        one = self.one.upto()
        gains = [one[np.minimum(singles + gap, self.size)] - singles]  # a move, or one for one
        gains.append(one[np.minimum(pairs + gap, self.size)] - pairs)  # two for one
        gains.append(self.two.upto()[np.minimum(singles + gap, self.size)] - singles)  # one for two, or two move
        gain, kind = max((int(g.max()), -k) if len(g) else (0, -k) for k, g in enumerate(gains))
        if gain <= 0:
            return 0, (), False
        at = int(gains[-kind].argmax())
        gives = sums[int(pairs[at])] if kind == -1 else (int(singles[at]),) if singles[at] else ()
        return gain, gives, kind == -2

    def run(self) -> list[list[int]]:
        """All bins that hold something, when no exchange with a bin that isn't fuller can fill any of them more."""
        before = -1
        while before < self.exchanges:
            before = self.exchanges
            self.sweep()
        return [b for b in self.bins if b]

    def sweep(self) -> None:
        self.one, self.two = Shelf(self.size), Shelf(self.size)
        order = sorted((b for b, f in enumerate(self.fill) if f < self.size), key=lambda b: (-self.fill[b], b))
        for b in order:
            self.shelve(b)
        for b in order:  # what lies behind a bin only loses, so it is never fuller than that bin
            if not self.bins[b]:
                continue
            self.unshelve(b)
            while self.fill[b] < self.size:
                gain, gives, two = self.best(b)
                if not gain:
                    break
                got = gain + sum(gives)
                other = next(reversed((self.two if two else self.one).bins[got]))  # shelved last: among the emptiest
                self.unshelve(other)
                wanted = pair_sums(self.of(other), self.size)[got] if two else (got,)
                given, taken = self.take(b, gives), self.take(other, wanted)
                self.bins[b] += taken
                self.bins[other] += given
                self.fill[b] += gain
                self.fill[other] -= gain
                self.shelve(other)
                self.exchanges += 1


def pack_lengths(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of positions for pieces of 1 to ``size``; no bin holds more than ``size``."""
    return Search(lengths, best_fit(lengths, size), size).run()


def document_pieces(documents: DataFrame, path: str, key: str, text: str, size: int, end_id: int) -> DataFrame:
    """(number, key, piece, start, length, ids_crc32): each document's ids and the end id, cut only beyond ``size``."""
    documents = text_batches(documents)
    key_type = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = wordpieces(path).ids
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        end = np.array([end_id], "<u4")
        for batch in pieces(batches, 128):
            out: list[list[int]] = [[] for _ in range(6)]
            for row, x in enumerate(columns_of(batch, "text")[0]):
                ids = np.concatenate([encode(x), end]) if x else end
                for piece, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    for column, value in zip(out, (row, number, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
                    number += 1
            keys = batch.column(batch.schema.get_field_index("key")).take(pa.array(out[0], pa.int64()))
            longs = [pa.array(out[k], pa.int64()) for k in (1, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([longs[0], keys, pa.array(out[2], pa.int32()), *longs[1:]], ["number", "key", "piece", "start", "length", "ids_crc32"])

    slim = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, f"number long, key {key_type}, piece int, start long, length long, ids_crc32 long")


def pack_whole(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end_id``; only one of more than ``size`` ids is cut, into pieces of ``size`` and a
    rest. Pieces lie gapless in sequences of at most ``size`` ids, which aren't padded. Null and empty texts are the
    end id alone; texts of any length are encoded whole; rows with equal or null keys are documents of their own;
    other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    cut = written(document_pieces(documents, path, key, text, size, end_id), "pieces")
    whole = cut.where(F.col("length") == size).withColumns({"sequence_id": F.col("number"), "offset": F.lit(0).cast("long")})
    loose = cut.where(F.col("length") < size)
    groups = max(1, -(-loose.count() // group))
    kind = cut.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by("number")
        numbers, lengths = rows.column("number").to_numpy(), rows.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b in pack_lengths(lengths, size):
            at = np.array(b)
            sequence[at] = numbers[at].min()
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
        out = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches()

    # each group has a partition of its own; hashed numbers spread rows of one key or file over all groups
    dealt = loose.repartitionById(groups, F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"))
    packed = dealt.mapInArrow(run, kind + ", sequence_id long, offset long")
    return whole.unionByName(packed).select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
