"""Packing of documents into training windows by the sum-of-squares rule.

Each task packs the rows of its own partition, so nothing is shuffled and a lost task packs the same rows
again. A document's ids are cut into whole windows; the remainder goes to the fill level that keeps the sum
of squared counts of partially filled windows least. Those counts are one array over the levels. Windows
that are still open at the end, or beyond ``most_open``, are emptied into each other by cutting; what is left
of a partition is cut into windows of powers of two, which need no padding, and memory stays bounded.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import pretokenizer
from .shared import columns_of, pieces, text_batches
from .words import forgetting

Piece = tuple  # (document's key, start, ids, document's ids in all)

#: More than any change of the sum of squares.
NEVER = 1 << 40


class Packer:
    """Online packing into windows of ``size``; ``done`` has the pieces of the full ones; ``settled`` counts those that were filled by cutting."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.n_open = 0
        # how the sum of squared counts changes if a window reaches a level, and if one leaves it;
        # a new window leaves level 0 and full ones aren't counted
        self.reach = np.ones(size + 1, np.int64)
        self.leave = np.full(size + 1, NEVER, np.int64)
        self.reach[size] = self.leave[0] = 0
        self.done: list[list[Piece]] = []
        self.settled = 0

    def moved(self, level: int, by: int) -> None:
        """Notes that ``by`` more windows are at a level between the ends."""
        count = len(self.open[level])
        self.n_open += by
        self.reach[level] = 2 * count + 1
        self.leave[level] = 1 - 2 * count if count else NEVER

    def level_for(self, n: int) -> int:
        """The level whose window ``n`` more ids suit best, 0 for a new one; of equals the fullest."""
        change = self.reach[n:] + self.leave[: self.size + 1 - n]
        return self.size - n - int(change[::-1].argmin())

    def add(self, piece: Piece) -> None:
        n = len(piece[2])
        if n == self.size:
            self.done.append([piece])
            return
        level = self.level_for(n)
        window = []
        if level:
            window = self.open[level].pop()
            self.moved(level, -1)
        window.append(piece)
        if level + n == self.size:
            self.done.append(window)
            return
        self.open[level + n].append(window)
        self.moved(level + n, 1)
        if self.n_open > self.most_open:
            self.settle(self.most_open // 2)

    def settle(self, keep: int) -> None:
        """Empties open windows, the emptiest first, into the fullest until at most ``keep`` are open."""
        left = deque((h, w) for h in range(1, self.size) for w in self.open[h])
        while len(left) > keep:
            fill, window = left.pop()
            while fill < self.size and left:
                low_fill, low = left[0]
                key, start, ids, total = low.pop()
                room = self.size - fill
                window.append((key, start, ids[:room], total))
                fill += min(room, len(ids))
                if len(ids) > room:
                    low.append((key, start + room, ids[room:], total))
                if low:
                    left[0] = (low_fill - min(room, len(ids)), low)
                else:
                    left.popleft()
            if fill < self.size:
                left.append((fill, window))
                break
            self.done.append(window)
            self.settled += 1
        self.open = [[] for _ in range(self.size + 1)]
        self.n_open = 0
        self.reach[1 : self.size] = 1
        self.leave[1 : self.size] = NEVER
        for fill, window in left:
            self.open[fill].append(window)
            self.moved(fill, 1)

    def rest(self) -> list[list[Piece]]:
        """The last windows: what one that isn't full holds, cut into windows of powers of two."""
        self.settle(1)
        out = []
        for window in [w for at in self.open for w in at]:
            left = deque(window)
            fill = sum(len(p[2]) for p in window)
            while fill:
                room = 1 << fill.bit_length() - 1
                fill -= room
                out.append([])
                while room:
                    key, start, ids, total = left.popleft()
                    out[-1].append((key, start, ids[:room], total))
                    if len(ids) > room:
                        left.appendleft((key, start + room, ids[room:], total))
                    room -= len(out[-1][-1][2])
        return out


def pack(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0, most_open: int = 4096) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids and then ``end_id`` are laid into windows of ``size`` ids, a power of two, each id in
    exactly one piece. Windows are full, but for at most log2(``size``) of a partition, whose fills are powers of
    two: none needs padding. Null and empty texts are the end id alone. A text of any length is encoded as a
    whole. Rows with equal or null keys are documents of their own; other columns, whatever their names, are
    ignored; an empty table gives no rows.
    """
    documents = text_batches(documents)
    key_type = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pretokenizer(path).ids
        packer = Packer(size, most_open)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        end = np.array([end_id], np.uint32)

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in range(7)]
            for window in windows:
                at = 0
                for k, start, ids, total in window:
                    for column, value in zip(out, (k, start, len(ids), zlib.crc32(ids), total, number, at), strict=True):
                        column.append(value)
                    at += len(ids)
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(out[0], key_arrow), *(pa.array(c, pa.int64()) for c in out[1:])], ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        key_arrow = None
        for batch in pieces(batches, 128):
            key_arrow = batch.schema.field("key").type
            for k, x in zip(*columns_of(batch, "key", "text"), strict=True):
                ids = np.concatenate([encode(x), end]).astype("<u4", copy=False) if x else end
                for start in range(0, len(ids) // size * size, size):
                    packer.add((k, start, ids[start : start + size], len(ids)))
                if len(ids) % size:
                    packer.add((k, len(ids) // size * size, ids[len(ids) // size * size :].copy(), len(ids)))
            yield rows(packer.done)
            packer.done = []
        if key_arrow is not None:
            last = packer.rest()
            yield rows(packer.done + last)

    slim = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    packed = slim.mapInArrow(forgetting(run), f"key {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("key", key)
