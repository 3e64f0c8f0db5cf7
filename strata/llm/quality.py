"""Quality scores by a generalised additive model with pairwise interactions.

A text becomes a few numbers, each number a bin. Boosting goes round the features in turn: each step fits a
tree of at most four leaves to one feature's bins and adds it to that feature's table. Then the pairs whose
coarse grids explain most of what is left get tables of their own, boosted in the same way. A score is the
logistic function of a sum of table entries, looked up for a whole batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .shared import columns_of, pieces, text_batches
from .words import WORD, forgetting, hashes_of, run_hashes

FEATURES = (
    "log_chars", "letters", "upper", "digits", "symbols", "bars", "exclamations", "stops", "spaces", "beyond_ascii", "word_length",
    "adjacent_repeats", "distinct_words", "top_word", "distinct_trigrams", "repeated_lines", "log_line_words",
)


def byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


UPPER = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = byte_class("abcdefghijklmnopqrstuvwxyz")
DIGIT = byte_class("0123456789")
SYMBOL = byte_class("#$%&*@^~<>{}[]=+\\_/`")
BAR, SHOUT, STOP, SPACE = byte_class("|"), byte_class("!"), byte_class(".,;:?"), byte_class(" \t\n\r\f\v")


def features(text: str | None) -> list[float]:
    """The numbers of one text, over all of it; null as the empty text."""
    text = text or ""
    data = text.encode()
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    upper, beyond = int(count @ UPPER), int(count[128:].sum())
    letters = upper + int(count @ LOWER) + beyond
    found = WORD.findall(text)
    words = hashes_of(found)
    m = max(1, len(words))
    _, often = np.unique(words, return_counts=True)
    runs = run_hashes(words, 3)
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = sum(map(len, lines)) - sum(map(len, set(lines)))
    return [
        np.log1p(len(text)), letters / n, upper / max(1, letters), int(count @ DIGIT) / n, int(count @ SYMBOL) / n, int(count @ BAR) / m, int(count @ SHOUT) / m, int(count @ STOP) / m,
        int(count @ SPACE) / n, beyond / n, len(text) / m, int((words[1:] == words[:-1]).sum()) / m, len(often) / m, int(often.max(initial=0)) / m,
        len(np.unique(runs)) / max(1, len(runs)) if len(runs) else 1.0, repeated / max(1, len(text)), np.log1p(m / max(1, len(lines))),
    ]


@dataclass
class Model:
    """``edges`` of each feature's bins, a table per feature, and (i, j, table) per pair on coarse bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        fine = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        out = np.full(len(x), self.bias)
        for b, t in zip(fine, self.tables, strict=True):
            out += t[b]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][fine[i]], self.coarse[j][fine[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The gain and place of the best cut of ordered bins with these sums of gradients and weights."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of two levels over ordered bins: its value for each bin."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, depth: int) -> None:
        gain, k = best_cut(g[a:b], h[a:b], ridge) if depth else (0.0, 0)
        if gain > 1e-9:
            grow(a, a + k, depth - 1)
            grow(a + k, b, depth - 1)
        else:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)

    grow(0, len(g), 2)
    return out


def grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree over a grid: one cut along either side, then one along the other in each half."""
    best: tuple[float, np.ndarray] = (0.0, np.full(g.shape, g.sum() / (h.sum() + ridge)))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, a.shape[0]):
            out, gain = np.zeros(a.shape), 0.0
            for part in (slice(0, k), slice(k, None)):
                gp, hp = a[part].sum(0), b[part].sum(0)
                more, c = best_cut(gp, hp, ridge)
                gain += gp.sum() ** 2 / (hp.sum() + ridge) + more
                c = c if more > 0 else len(gp)
                out[part, :c] = gp[:c].sum() / (hp[:c].sum() + ridge)
                if c < len(gp):
                    out[part, c:] = gp[c:].sum() / (hp[c:].sum() + ridge)
            if gain > best[0]:
                best = gain, out.T if turned else out
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 8, rounds: int = 120, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, ridge: float = 4.0) -> Model:
    """Cyclic boosting; with no rows or one class only, a constant near that class (0.5 without rows)."""
    p = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(p)]
    coarse = [np.minimum(np.arange(len(e) + 1) * coarse_bins // (len(e) + 1), coarse_bins - 1) for e in edges]
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(edges, coarse, float(np.log(mean / (1 - mean))), [np.zeros(len(e) + 1) for e in edges], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    fine = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    f = np.full(len(y), model.bias)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        s = 1 / (1 + np.exp(-f))
        return y - s, np.maximum(s * (1 - s), 1e-4)

    for _ in range(rounds):
        for k in range(p):
            r, w = residuals()
            m = len(model.tables[k])
            step = rate * shallow_tree(np.bincount(fine[k], r, m), np.bincount(fine[k], w, m), ridge)
            model.tables[k] += step
            f += step[fine[k]]
    r, w = residuals()
    wide = [c[b] for c, b in zip(coarse, fine, strict=True)]
    shape = (coarse_bins, coarse_bins)

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[i] * coarse_bins + wide[j], v, coarse_bins**2).reshape(shape)

    gains = []
    for i in range(p):
        for j in range(i + 1, p):
            g, h = grid(i, j, r), grid(i, j, w)
            gains.append((float((g**2 / (h + ridge)).sum()), i, j))
    model.pairs = [(i, j, np.zeros(shape)) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            r, w = residuals()
            step = rate * grid_tree(grid(i, j, r), grid(i, j, w), ridge)
            t += step
            f += step[wide[i], wide[j]]
    return model


def feature_rows(texts: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``x``, the features of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            x = [features(t) for t in columns_of(batch, "text")[0]]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    kinds = dict(texts.dtypes)
    return texts.mapInArrow(forgetting(run), ", ".join(f"{c} {kinds[c]}" for c in keep) + ", x array<double>")


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most_rows: int = 20_000) -> Model:
    """A model fitted on at most ``most_rows`` labelled rows, none of them held out; only features reach the driver."""
    rows = feature_rows(sample(text_batches(documents), labels, label, key, text, most_rows), "key", "label").orderBy("key").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], float))


def quality_scores(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row: key, held_out, score (higher: better text), predicted (1 if score >= ``threshold``).

    Null and empty texts are scored as empty. Nothing but the text enters a score, all of it however long, so equal
    texts have equal scores; null keys and repeated rows stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            x = np.array([features(t) for t in columns_of(batch, "text")[0]], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["key", "score"])

    documents = text_batches(documents)
    kind = documents.schema[key].dataType.simpleString()
    scored = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(forgetting(run), f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
