"""Toxicity by cumulative-link ordinal regression over sparse words.

P(grade > j) = logistic(w . x - t_j): one weight per word, shared by all grades, and ordered thresholds t_j.
x has log2(1 + count) for each word or word beginning of a vocabulary chosen by association with the label. The labels are
only toxic or not; their grades are made from them: 0 is not toxic, toxic texts get grade 1 to 3 by terciles
of how often they have words that are associated with it. The score is the expected grade.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .shared import columns_of, pieces, text_batches, written
from .words import forgetting, hashes_of, shingles

LETTERS = re.compile(r"[^\W\d_]+")
GRADES = 4
#: Rows of the sample that share COPY of their SKETCH least shingle hashes count as one.
SKETCH, COPY = 16, 4
#: Words whose features a task remembers.
MOST_WORDS = 50_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall(text.lower()) if text else []


def features_of(word: str) -> tuple[str, ...]:
    """The word, and its first 4 and 5 letters if it has more, marked by a colon."""
    return (word, *(f"{word[:n]}:" for n in (4, 5) if len(word) > n))


class Known(dict):
    """word -> its features that have a weight, each word sought once; emptied when it has grown too large."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        out = tuple(f for f in features_of(word) if f in self.weights)
        if len(self) > MOST_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """w . x of each whole text."""
        weights, out = self.weights, np.zeros(len(texts))
        known = self.__dict__.setdefault("known", Known(weights))
        for k, t in enumerate(texts):
            counts = Counter(f for w in words_of(t) for f in known[w])
            out[k] = sum(weights[f] * np.log2(1 + n) for f, n in counts.items())
        return out

    def above(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > j) for j = 0 to GRADES - 2."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - sums[:, None], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 1500, rate: float = 0.05, ridge: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam; ``n``: how often each row occurs."""
    p = x.shape[1]
    share = np.array([(n * (y > j)).sum() + 0.5 for j in range(GRADES - 1)]) / (n.sum() + 1)
    t = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(t), 0.05))
    params = np.concatenate([np.zeros(p), t[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    at = np.arange(GRADES - 1)
    for step in range(1, steps + 1):
        w, t = params[:p], params[p] + np.concatenate([[0], np.cumsum(np.exp(params[p + 1 :]))])
        above = 1 / (1 + np.exp(np.clip(t[None] - (x @ w)[:, None], -500, 500)))
        full = np.concatenate([np.ones((len(y), 1)), above, np.zeros((len(y), 1))], axis=1)
        chance = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-12)
        slope = above * (1 - above)
        # d log P(y) / d (w.x - t_j): +slope where j is the grade's lower end, - where its upper
        d = np.where(at[None] == y[:, None] - 1, slope, 0) - np.where(at[None] == y[:, None], slope, 0)
        d = d * (n / chance)[:, None]
        dt = -d.sum(0)
        g = np.concatenate([x.T @ d.sum(1) - ridge * w, [dt.sum()], np.exp(params[p + 1 :]) * np.cumsum(dt[::-1])[::-1][1:]]) / n.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return params[:p], params[p] + np.concatenate([[0], np.cumsum(np.exp(params[p + 1 :]))])


def copies_of(rows: Iterator[tuple[int, list[int]]]) -> list[int]:
    """Keys of rows that share ``COPY`` of their ``SKETCH`` least shingle hashes with an earlier row; the sample bounds them."""
    seen: dict[int, list[int]] = {}
    out = []
    for key, sketch in rows:
        shared = Counter(k for v in sketch for k in seen.get(v, ()))
        if any(n >= min(COPY, len(sketch)) for n in shared.values()):
            out.append(key)
        else:
            for v in sketch:
                seen.setdefault(v, []).append(key)
    return out


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most_rows: int = 20_000, most_words: int = 512, least_texts: int = 8, least_z: float = 6.0) -> Model:
    """A model fitted on at most ``most_rows`` labelled rows outside the held-out part.

    Of near copies one row counts, see ``copies_of``. A word
    enters the vocabulary if at least ``least_texts`` rows have it and its share of toxic rows lies
    ``least_z`` standard errors from the average. Without labels, or with one class only, no word has a
    weight and no text is rejected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            out: list[list] = [[] for _ in range(3)]
            for t in columns_of(batch, "text")[0]:
                found = words_of(t)
                counts: Counter = Counter()
                for w, n in Counter(found).items():
                    for f in features_of(w):
                        counts[f] += n
                for column, value in zip(out, (list(counts), list(counts.values()), shingles(hashes_of(found), 5)[:SKETCH].view(np.int64).tolist()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int64()))], ["key", "label", "words", "counts", "sketch"])

    rows = sample(text_batches(documents), labels, label, key, text, most_rows).select("key", "label", "text")
    made = written(rows.mapInArrow(forgetting(run), "key long, label int, words array<string>, counts array<int>, sketch array<long>"), "toxic-sample")
    copies = copies_of((r["key"], r["sketch"]) for r in made.select("key", "sketch").orderBy("key").toLocalIterator())
    if copies:
        gone = made.sparkSession.createDataFrame([(k,) for k in copies], "key long")
        made = made.join(F.broadcast(gone), "key", "left_anti")
    total = made.agg(F.count("*").alias("n"), F.sum("label").alias("t")).first()
    n, toxic = total["n"], total["t"] or 0
    none = Model({}, np.array([5.0, 6.0, 7.0]))
    if not n or not 0 < toxic < n:
        return none
    base = toxic / n
    z = (F.col("t") - F.col("c") * base) / F.sqrt(F.col("c") * base * (1 - base))
    chosen = made.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c"), F.sum("label").alias("t")).where(f"c >= {least_texts}").withColumn("z", z).where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(most_words).collect()
    if not chosen:
        return none
    at = {r["word"]: k for k, r in enumerate(chosen)}
    toward = np.array([r["z"] > 0 for r in chosen])
    slim = made.select("key", "label", F.filter(F.arrays_zip("words", "counts"), lambda x: x["words"].isin(list(at))).alias("x")).orderBy("key").collect()
    x = np.zeros((len(slim), len(at)), np.float32)
    for k, r in enumerate(slim):
        for w in r["x"]:
            x[k, at[w["words"]]] = w["counts"]
    y = np.array([r["label"] > 0 for r in slim]).astype(int)
    much = np.log2(1 + x[:, toward]).sum(1)
    hit = (y == 1) & (much > 0)
    if hit.any():
        low, high = np.quantile(much[hit], [1 / 3, 2 / 3])
        y[hit] = 1 + (much[hit] > low) + (much[hit] > high)
    both, many = np.unique(np.column_stack([np.log2(1 + x), y]), axis=0, return_counts=True)
    w, t = fit(both[:, :-1], both[:, -1].astype(int), many.astype(float))
    return Model({word: float(w[k]) for word, k in at.items()}, t)


def toxicity(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", reject_at: float = 0.5) -> DataFrame:
    """One row per row: key, severity (expected grade, 0 to 3), p_toxic (chance of a grade above 0), grade, rejected.

    ``grade`` is the likeliest one; a text is rejected if ``p_toxic`` >= ``reject_at``. Null, empty and
    wordless texts get the score of a text without known words. Only the text enters a score, all of it however
    long; null keys and repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    documents = text_batches(documents)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            above = model.above(model.sums(columns_of(batch, "text")[0]))
            one = np.ones((len(above), 1))
            grade = -np.diff(np.concatenate([one, above, 0 * one], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(grade.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= reject_at)], ["key", "severity", "p_toxic", "grade", "rejected"])

    scored = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(forgetting(run), f"key {kind}, severity double, p_toxic double, grade int, rejected boolean")
    return scored.withColumnRenamed("key", key)


def without_toxic(documents: DataFrame, model: Model, text: str = "text", reject_at: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that aren't rejected, with all their columns, filtered inside the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            keep = model.above(model.sums(columns_of(batch, text)[0]))[:, 0] < reject_at
            yield batch.filter(pa.array(keep))

    return text_batches(documents).mapInArrow(forgetting(run), documents.schema)
