"""Repeated passages by sparse suffix arrays.

Of the suffixes of all texts, word by word, those are retained that start at a minimiser: the 16-word run of
least hash within some 50-word window. Equal windows have equal minimisers, so two texts that share 50 words
share a retained suffix's start. Suffixes whose first 16 words occur once are dropped. The others are sorted
by the words that follow; neighbours are compared, which gives how far each run of suffixes agrees to the
right; then matches are extended to the left. A window belongs to its own minimiser alone, so it is decided
once, and every window that occurs twice is found. By default those count that two documents have: what repeats
inside one text only is left to it.

Starts with more occurrences than ``HOT`` aren't gathered in one task: their windows are hashed to 128 bits,
counted with partial aggregation, and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns_of, fresh, parts_of, pieces, text_batches, written
from .words import WORD, forgetting, hashes_of, run_hashes

GRAM = 16
#: Suffixes with the same start that one task sorts: some 20 MB.
HOT = 1 << 15
#: Suffixes times words to the left that are compared at once.
AT_ONCE = 1 << 16
#: Windows whose minimisers are sought at a time.
CHUNK = 1 << 15

RUN = pa.schema([("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("first_key", pa.int64()), ("first_low", pa.int32())])


def minimisers(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash of its run, first and last window that it is the minimiser of), by place."""
    runs = run_hashes(words, GRAM)
    span = length - GRAM + 1
    windows = len(words) - length + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    parts = []
    for at in range(0, windows, CHUNK):
        part = runs[at : min(windows, at + CHUNK) + span - 1]
        parts.append(np.lib.stride_tricks.sliding_window_view(part, span).argmin(axis=1) + np.arange(at, at + len(part) - span + 1))
    owner = np.concatenate(parts)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[first], runs[owner[first]], first, np.concatenate([first[1:], [windows]]) - 1


def text_hashes(text: str | None) -> np.ndarray:
    return hashes_of(WORD.findall(text)) if text else np.zeros(0, np.uint64)


def repeated_in(rows: list[tuple[int, int, int, int, bytes]], length: int, across: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
    """Of suffixes (key, place, low, high, words from low on) with the same start: runs of repeated windows.

    Each is (key, low, high, first_key, first_low), where the first occurrence is the least (key, place). With
    ``across`` a window counts only if two keys have it. Suffixes with the same words around them are one context,
    which is compared once.
    """
    contexts: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
    for key, place, low, high, words in rows:
        contexts.setdefault((place - low, place - high, words), []).append((key, place))
    for places in contexts.values():
        places.sort()
    made = sorted(contexts.items(), key=lambda c: c[1][0])
    if len(made) == 1:
        (most, least, _), places = made[0]
        found = [(0, least, most, 0)] if len(places) > 1 and (not across or places[0][0] != places[-1][0]) else []
    else:
        found = repeated_contexts([c for c, _ in made], [p for _, p in made], length, across)
    for k, least, most, f in found:
        first_key, first_place = made[f][1][0]
        for key, place in made[k][1]:
            yield key, place - most, place - least, first_key, first_place - most


def repeated_contexts(contexts: list[tuple[int, int, bytes]], places: list[list[tuple[int, int]]], length: int, across: bool) -> list[tuple[int, int, int, int]]:
    """(context, least, most, first): the windows that start ``least`` to ``most`` words before the suffix occur again.

    Contexts are (most, least words to the left, words) in order of their first occurrence, of which ``first``
    is the earliest for these windows.
    """
    n = len(contexts)
    arrays = [np.frombuffer(w, np.uint64) for _, _, w in contexts]
    # sort the suffixes and compare neighbours
    order = sorted(range(n), key=lambda k: contexts[k][2][8 * contexts[k][0] :])
    agree = np.zeros(n, np.int64)  # words that agree with the suffix before
    for at, (x, y) in enumerate(zip(order, order[1:], strict=False), 1):
        a, b = arrays[x][contexts[x][0] :], arrays[y][contexts[y][0] :]
        m = min(len(a), len(b))
        apart = a[:m] != b[:m]
        k = int(apart.argmax())
        agree[at] = k if apart[k] else m
    most, least = (np.array([c[i] for c in contexts]) for i in (0, 1))
    least_key, most_key = (np.array([p[i][0] for p in places], np.int64) for i in (0, -1))
    many = np.array([len(p) > 1 for p in places])
    # runs of suffixes that agree far enough to the right, for each number of words to the left, extended to the left
    # by a hash of so many words; as many numbers at once as there is room for
    wide = int(most.max()) + 1
    of = np.full((n, wide), -1, np.int32)
    lefts = np.arange(wide, dtype=np.uint64)
    before = np.zeros((n, min(wide, max(1, AT_ONCE // n))), np.uint64)  # words to the left, by their distance
    left = np.zeros(n, np.uint64)
    for low in range(0, wide, before.shape[1]):
        by = lefts[low : low + before.shape[1]]
        before[:] = 0
        for k in np.flatnonzero(most >= max(1, low)).tolist():
            nearest, furthest = max(1, low), min(int(most[k]), low + before.shape[1] - 1)
            before[k, nearest - low : furthest - low + 1] = arrays[k][most[k] - furthest : most[k] - nearest + 1][::-1]
        sums = left[:, None] + np.cumsum(before[:, : len(by)] * (2 * by + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), axis=1)
        left = sums[:, -1].copy()
        run = np.empty(sums.shape, np.uint64)
        run[order] = np.cumsum(agree[:, None] < length - by.astype(np.int64), axis=0)
        inside = (least[:, None] <= by.astype(np.int64)) & (by.astype(np.int64) <= most[:, None])
        if not inside.any():
            continue
        rows = np.broadcast_to(np.arange(n)[:, None], inside.shape)[inside]
        key = ((sums ^ run * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB) + by)[inside]
        # np.unique names the earliest place of each key, which is the earliest context
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        if across:
            lowest, highest = least_key[rows[first]], most_key[rows[first]]
            np.minimum.at(lowest, group, least_key[rows])
            np.maximum.at(highest, group, most_key[rows])
            again = lowest < highest
        else:
            again = (np.bincount(group) > 1) | (np.bincount(group, many[rows]) > 0)
        of[:, low : low + len(by)][inside] = np.where(again[group], rows[first[group]], -1)
    out = []
    for k in range(n):
        cuts = [0, *(np.flatnonzero(of[k, 1:] != of[k, :-1]) + 1).tolist(), of.shape[1]]
        out += [(k, a, b - 1, int(of[k, a])) for a, b in zip(cuts, cuts[1:], strict=False) if of[k, a] >= 0]
    return out


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RUN)], schema=RUN)


def repeated_windows(documents: DataFrame, key: str, text: str, length: int, across: bool) -> DataFrame:
    """(key, low, high, first_key, first_low): runs of windows that occur more than once, with ``across`` in two keys."""
    documents = text_batches(documents)
    n_parts, parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts_of(documents)
    slim = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            rows, hashes, counts = [], [], []
            for k, x in enumerate(columns_of(batch, "text")[0]):
                h, c = np.unique(minimisers(text_hashes(x), length)[1], return_counts=True)
                rows.append(np.full(len(h), k, np.int32))
                hashes.append(h)
                counts.append(c)
            keys = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int32))], ["key", "start", "c"])

    per_text = written(slim.mapInArrow(forgetting(starts), "key long, start long, c int"), "starts")
    often = per_text.groupBy("start").agg(F.sum("c").alias("c")).where("c > 1").select("start", (F.col("c") > HOT).alias("hot"))
    hits = per_text.select("key", "start").join(often, "start").groupBy("key").agg(F.collect_list(F.struct("start", "hot")).alias("starts"))  # at most one per word of the text

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            out: list[list] = [[] for _ in range(7)]
            for k, x, wanted in zip(*columns_of(batch, "key", "text", "starts"), strict=True):
                words = text_hashes(x)
                hot = {s["start"]: s["hot"] for s in wanted}
                place, run, low, high = minimisers(words, length)
                # of all windows, two independent hashes
                whole = np.stack([run_hashes(words, length), run_hashes(words, length, 0x5DEECE66D)], axis=1).view(np.int64) if any(hot.values()) else None
                for p, r, lo, hi in zip(place.tolist(), run.view(np.int64).tolist(), low.tolist(), high.tolist(), strict=True):
                    is_hot = hot.get(r)
                    if is_hot is not None:
                        shown = (None, whole[lo : hi + 1].tolist()) if is_hot else (words[lo : hi + length].tobytes(), None)
                        for column, value in zip(out, (r, k, p, lo, hi, *shown), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64()))), strict=True))], ["start", "key", "place", "low", "high", "words", "windows"])

    found = written(slim.join(hits, "key").mapInArrow(forgetting(suffixes), "start long, key long, place int, low int, high int, words binary, windows array<array<long>>"), "suffixes", parts)

    def sort_and_compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in pieces(batches, 1024):
                yield from zip(*columns_of(batch, "start", "key", "place", "low", "high", "words"), strict=True)

        out: list[tuple] = []
        for _, group in groupby(rows(), key=lambda r: r[0]):
            mine = {(r[1], r[2]): r[1:] for r in group}  # rows of one key are one document
            for found in repeated_in(list(mine.values()), length, across) if len(mine) > 1 else ():
                out.append(found)
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    usual = found.where("words IS NOT NULL").drop("windows").repartition(n_parts, "start").sortWithinPartitions("start").mapInArrow(sort_and_compare, "key long, low int, high int, first_key long, first_low int")
    windows = found.where("windows IS NOT NULL").select("key", F.posexplode("windows").alias("i", "w"), "low").select("key", (F.col("low") + F.col("i")).alias("low"), F.col("w")[0].alias("w"), F.col("w")[1].alias("v")).distinct()
    first = windows.groupBy("w", "v").agg(F.count("*").alias("c"), F.min("key").alias("least"), F.max("key").alias("most"), F.min(F.struct("key", "low")).alias("f")).where("least < most" if across else "c > 1").select("w", "v", "f")
    hot = windows.join(first, ["w", "v"]).select("key", "low", F.col("low").alias("high"), F.col("f.key").alias("first_key"), F.col("f.low").alias("first_low"))
    return usual.unionByName(hot)


def passages(runs: list[tuple[int, int, int, int, int]], length: int) -> list[tuple[int, int, bool, int, int]]:
    """(start, end, first, first_key, first_start) in words, from one document's runs of repeated windows.

    Words under the first occurrence of a window are first; the other repeated words are not.
    """
    mine = sorted((lo, hi + length) for k, lo, hi, fk, fl in runs if (k, lo) == (fk, fl))
    others = sorted((lo, hi + length, fk, fl) for k, lo, hi, fk, fl in runs if (k, lo) != (fk, fl))
    key = runs[0][0]
    out = []
    for a, b in mine:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    kept = [(a, b, True, key, a) for a, b in out]
    cover: list[list] = []
    for a, b, fk, fl in others:
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b, fk, fl])
    rest = []
    at = 0
    for a, b, fk, fl in cover:
        here = a
        while at < len(out) and out[at][1] <= here:
            at += 1
        k = at
        while here < b:
            if k < len(out) and out[k][0] < b:
                x, y = out[k]
                if here < x:
                    rest.append((here, x, False, fk, fl + here - a))
                here = max(here, y)
                k += 1
            else:
                rest.append((here, b, False, fk, fl + here - a))
                break
    return sorted(kept + rest)


def repeated_passages(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, across: bool = True) -> DataFrame:
    """One row per passage: key, start_word, end_word, n_words, first, first_doc_id, first_start_word.

    A passage is a maximal stretch of words [start_word, end_word) under windows of ``length`` words that
    occur in more than one document, or, without ``across``, more than once, be it in one text. ``first`` marks the stretch whose windows occur here
    first, by key and place; the others name the first occurrence of their first window. Words are runs
    without ASCII white space, compared exactly. Null, empty and shorter texts and rows without a key have
    no passages; longer ones are searched whole. Rows with the same key count as one document, so that a repeated row repeats nothing; other
    columns are ignored; an empty table gives no rows. Keys are integers.
    """
    runs = repeated_windows(documents, key, text, length, across)
    per_text = runs.groupBy("key").agg(F.collect_set(F.struct("key", "low", "high", "first_key", "first_low")).alias("runs"))  # at most one per word

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            out: list[list] = [[] for _ in range(6)]
            for k, r in zip(*columns_of(batch, "key", "runs"), strict=True):
                for a, b, first, fk, fl in passages([tuple(x.values()) for x in r], length):
                    for column, value in zip(out, (k, a, b, first, fk, fl), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32()), strict=True)], ["key", "start_word", "end_word", "first", "first_doc_id", "first_start_word"])

    made = per_text.mapInArrow(merge, "key long, start_word int, end_word int, first boolean, first_doc_id long, first_start_word int")
    return made.select(F.col("key").alias(key), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first", "first_doc_id", "first_start_word").coalesce(parts_of(documents))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of each span and the white space before the next word."""
    found = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : found[a]])
        at = found[b]
    out.append(text[at:])
    return "".join(out)


def cut_passages(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, across: bool = True) -> DataFrame:
    """``documents`` with every repeated passage cut from all but its first occurrence; all rows and columns stay.

    What repeats, and ``across``, as in ``repeated_passages``; of a passage that several documents have, further
    occurrences in the first of them go as well.

    Null texts and rows without a key stay as they are; rows with the same key are cut in the same places; columns
    of any name stay; an empty table stays empty.
    """
    at_key, at_spans = fresh(documents, "key_of_spans"), fresh(documents, "spans")
    spans = repeated_passages(documents, key, text, length, across).where("NOT first").groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    joined = documents.join(spans.select(F.col("key").alias(at_key), F.col("spans").alias(at_spans)), F.col(key) == F.col(at_key), "left").drop(at_key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            at = batch.schema.get_field_index(text)
            texts, found = columns_of(batch, text, at_spans)
            made = pa.array([without_words(x, [(s["start_word"], s["end_word"]) for s in f]) if f and x else x for x, f in zip(texts, found, strict=True)], batch.schema.field(at).type)
            arrays = [made if i == at else c for i, c in enumerate(batch.columns)][:-1]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:-1])

    return joined.mapInArrow(cut, documents.schema)
