"""A quantised bigram model: vocabulary, transitions, novelty and tags."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, scoring, text, udfs

# Words that are no tags, for texts and for domain terms.
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "into", "when", "where", "how", "what", "why", "should", "could", "would", "about", "using")
DOMAIN_STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "from", "into", "while", "when", "then", "your", "you", "our", "their", "them", "they", "there", "about", "have", "has", "had", "will", "would", "should", "could", "just",
    "also", "more", "most", "some", "other", "using", "used", "need", "needs", "where", "what", "how", "why", "who", "which", "than", "over", "under", "across", "before", "after", "between", "inside", "outside", "through",
)

#: As text.tokenize_ngram has them.
TOKEN = re.compile(r"[a-z0-9_]+|[^ \t\n\x0b\f\r]")
TAG = re.compile(r"[a-z][a-z0-9_-]{2,}")

#: Distinct pairs of tokens that a task counts before it hands them on.
FLUSH = 1 << 20


def vocabulary(docs: DataFrame, size: int = 4096, column: str = "text") -> DataFrame:
    """(tokenId, token, n, unigramQ): the most frequent tokens; id 0 stands for all others.

    Counted at once: a model's vocabulary is used many times, and ``size`` bounds its rows.
    """
    counted = docs.select(F.explode(text.tokenize_ngram(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(size - 1)  # bounded, so one task may number it
    order = Window.orderBy(F.desc("n"), "token")
    most = F.max("n").over(Window.partitionBy())
    known = top.select(F.row_number().over(order).alias("tokenId"), "token", "n", scoring.quantize_weight(F.col("n") / most).alias("unigramQ"))
    unknown = docs.sparkSession.createDataFrame([(0, "<unk>", 0, 0)], "tokenId int, token string, n long, unigramQ int")
    return docs.sparkSession.createDataFrame([*unknown.collect(), *known.collect()], unknown.schema)


def ids_of(vocab: DataFrame) -> dict[str, int]:
    """token to id of a vocabulary, which its size bounds."""
    return {r["token"]: r["tokenId"] for r in vocab.select("token", "tokenId").where("tokenId > 0").collect()}


def codes(value: str | None, ids: dict[str, int]) -> np.ndarray:
    """The ids of a text's tokens."""
    found = TOKEN.findall(value.lower()) if value else []
    return np.fromiter((ids.get(t, 0) for t in found), np.int64, len(found))


def bigrams(docs: DataFrame, vocab: DataFrame, column: str = "text") -> DataFrame:
    """(fromId, toId, n): how often neighbours occur; a task adds them up before it hands them on."""
    ids = ids_of(vocab)
    size = len(ids) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys // size), pa.array(keys % size), pa.array(times)], ["fromId", "toId", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                made = [codes(x, ids) for x in batch.column(0).slice(at, 512).to_pylist()]
                new, n = np.unique(np.concatenate([c[:-1] * size + c[1:] for c in made]), return_counts=True)
                keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
                times = np.bincount(inverse, np.concatenate([times, n]), len(keys)).astype(np.int64)
                if len(keys) > FLUSH:
                    yield out()
                    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield out()

    return docs.select(F.col(column).alias("text")).mapInArrow(run, "fromId long, toId long, n long").groupBy("fromId", "toId").agg(F.sum("n").alias("n"))


def transitions(docs: DataFrame, vocab: DataFrame, most: int = 24, column: str = "text") -> DataFrame:
    """(fromId, toId, rank, q): the ``most`` frequent followers of each token, their shares quantised: at most the
    vocabulary's size times ``most`` rows, counted at once."""
    top = bigrams(docs, vocab, column).withColumn("rank", F.row_number().over(Window.partitionBy("fromId").orderBy(F.desc("n"), "toId"))).where(F.col("rank") <= most)
    made = top.select(F.col("fromId").cast("int").alias("fromId"), F.col("toId").cast("int").alias("toId"), "rank", scoring.quantize_weight(F.col("n") / F.sum("n").over(Window.partitionBy("fromId"))).alias("q"))
    table = made.toArrow()
    return docs.sparkSession.createDataFrame(table if table.num_rows else [], made.schema)


@dataclass
class Model:
    """A model in memory; its vocabulary and the followers of a token bound it."""

    ids: dict[str, int]
    names: list[str]
    followers: dict[int, list[tuple[int, int]]]
    unigrams: list[tuple[int, int]] = field(default_factory=list)
    pairs: np.ndarray = None  # sorted codes of known pairs, and their weights
    weights: np.ndarray = None

    def __post_init__(self):
        size = len(self.names)
        known = sorted((a * size + b, q) for a, after in self.followers.items() for b, q in after)
        self.pairs = np.array([k for k, _ in known], np.int64)
        self.weights = np.array([q for _, q in known], np.float64)

    def novelty(self, value: str | None) -> float:
        """Mean of 1 - q/127 over neighbours, unseen ones counting fully; 0.5 below two tokens."""
        c = codes(value, self.ids)
        if len(c) < 2:
            return 0.5
        if not len(self.pairs):
            return 1.0
        keys = c[:-1] * len(self.names) + c[1:]
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return float((1 - np.where(self.pairs[at] == keys, self.weights[at], 0) / 127).mean())


def hydrated(vocab: DataFrame, model: DataFrame, most_unigrams: int = 64) -> Model:
    """The model in memory: weights that aren't positive and ids out of range drop, followers by rank; the most frequent tokens."""
    rows = vocab.orderBy("tokenId").collect()
    names = [r["token"] for r in rows]
    followers: dict[int, list[tuple[int, int]]] = {}
    for r in model.where("q > 0 AND toId >= 0 AND fromId >= 0").orderBy("fromId", "rank").collect():
        if r["toId"] < len(names) and r["fromId"] < len(names):
            followers.setdefault(r["fromId"], []).append((r["toId"], r["q"]))
    often = sorted(((r["tokenId"], r["unigramQ"]) for r in rows if r["unigramQ"] > 0), key=lambda x: (-x[1], x[0]))[:most_unigrams]
    return Model({t: i for i, t in enumerate(names) if i}, names, followers, often)


def novelty(docs: DataFrame, model: Model, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, novelty) of each row, found inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.novelty(x) for x in batch.column(1).to_pylist()], pa.float64())], ["key", "novelty"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInArrow(run, f"key {kind}, novelty double").withColumnRenamed("key", key)


def frequent_tags(docs: DataFrame, most: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, token, n, place): the most frequent words of each text that aren't stop words; of equals the shorter."""
    words = F.filter(F.regexp_extract_all(F.lower(column), F.lit("[a-zA-Z][a-zA-Z0-9_-]{2,}"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))
    counted = docs.select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.length("token"), "token"))).where(F.col("place") <= most)


def domain_terms(tokens: list[str], most: int = 12, prefix: int = 5) -> tuple[list[str], list[str]]:
    """The first distinct terms of four letters and more, and beginnings of the longer ones."""
    terms = list(dict.fromkeys(t for t in tokens if len(t) >= 4 and TAG.fullmatch(t) and t not in DOMAIN_STOP_WORDS))[:most]
    return terms, list(dict.fromkeys(t[:prefix] for t in terms if len(t) > prefix + 1))


# The scores of own tags and domain terms by place, of followers, and boosts for terms and their beginnings.
OWN, DOMAIN, FOLLOWER, TERM_BOOST, PREFIX_BOOST, FOLLOWERS = (1.4, 0.08), (2.6, 0.1), 0.8, 1.35, 1.15, 10


def tag_scores(value: str, model: Model | None, most: int) -> dict[str, float]:
    scores: dict[str, float] = {}

    def add(token: str, score: float) -> None:
        if len(token) <= 24 and TAG.fullmatch(token) and token not in DOMAIN_STOP_WORDS:
            scores[token] = scores.get(token, 0.0) + max(0.0001, score)

    tokens = TOKEN.findall(value.strip().lower())
    counts = Counter(t for t in tokens if len(t) <= 24 and TAG.fullmatch(t))
    for i, (t, _) in enumerate(sorted(counts.items(), key=lambda x: -x[1])[: min(24, most * 4)]):  # of equals the first in the text
        add(t, OWN[0] - OWN[1] * i)
    terms, prefixes = domain_terms(tokens)
    for i, t in enumerate(terms):
        add(t, DOMAIN[0] - DOMAIN[1] * i)
    for t in dict.fromkeys(tokens) if model else ():
        after = model.followers.get(model.ids.get(t, -1), [])[:FOLLOWERS]
        top = max([1, *(q for _, q in after)])
        for to, q in after:
            name = model.names[to].lower()
            boost = TERM_BOOST if name in terms else PREFIX_BOOST if name.startswith(tuple(prefixes)) else 1.0
            add(name, FOLLOWER + q / top * boost)
    return scores


def ranked_tags(scores: dict[str, float], most: int) -> list[tuple[str, float]]:
    """The best tags; scores that agree in four places are ties, which the shorter and then the lesser token wins."""
    return sorted(((t, round(s, 4)) for t, s in scores.items()), key=lambda x: (-x[1], len(x[0]), x[0]))[:most]


def suggest_tags(docs: DataFrame, model: Model | None, most: int = 6, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, token, score, place): the best tags of each whole text, from its frequent words, its first domain terms
    and what the model expects to follow its words."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(k, t, s, i) for k, x in zip(p["key"], p["text"], strict=True) for i, (t, s) in enumerate(ranked_tags(tag_scores(x, model, most), most) if x else (), 1)], columns=["key", "token", "score", "place"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInPandas(run, f"key {kind}, token string, score double, place int").withColumnRenamed("key", key)


def weighted(snippets: DataFrame, weight: int) -> DataFrame:
    """Every snippet ``weight`` times, which is at least 1 and at most 4."""
    n = min(4, max(1, int(weight)))
    return snippets if n == 1 else snippets.withColumn("__copy", F.explode(F.array(*map(F.lit, range(n))))).drop("__copy")


# How often the texts of projects, memories and datasets count.
WEIGHTS = (2, 2, 1)


def train(project: DataFrame, memory: DataFrame, dataset: DataFrame, size: int = 4096, most: int = 24, column: str = "snippet") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, transitions, summary) over snippets of three kinds, weighted; those below two tokens don't count."""
    parts = [weighted(df.select(F.col(column).alias("text")), w) for df, w in zip((project, memory, dataset), WEIGHTS, strict=True)]
    corpus = parts[0].unionByName(parts[1]).unionByName(parts[2])
    tokens = F.size(text.tokenize_ngram(F.col("text")))
    corpus = corpus.where(tokens >= 2)
    vocab = vocabulary(corpus, size)
    model = transitions(corpus, vocab, most)
    counts = corpus.agg(F.count("*").alias("snippets"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokenCount"))
    sources = [df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("chars")) for df in (project, memory, dataset)]
    source = sources[0].unionByName(sources[1]).unionByName(sources[2]).agg(F.sum("n").alias("sourceCount"), F.sum("chars").alias("corpusChars"))
    rows = model.groupBy("fromId").agg(F.count("*").alias("b")).agg(F.count("*").alias("transitionRows"), F.coalesce(F.avg("b"), F.lit(0.0)).alias("averageBranchingFactor"))
    summary = counts.crossJoin(source).crossJoin(vocab.agg(F.count("*").alias("vocabSize"))).crossJoin(rows)  # one row each
    return vocab, model, summary


VERSION = "quantised-bigrams-v1"


def save(vocab: DataFrame, model: DataFrame, path: str) -> None:
    """The model as Parquet, with its version."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    model.write.mode("overwrite").parquet(f"{path}/transitions")
    vocab.sparkSession.createDataFrame([(json.dumps({"version": VERSION}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/version")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, transitions) of a saved model; another version is refused."""
    found = json.loads(spark.read.text(f"{path}/version").first()[0]).get("version")
    if found != VERSION:
        raise ValueError(f"{path}: a model of version {found!r}; this is {VERSION!r}")
    return spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/transitions")


def ephemeral(value: str, size: int = 512, most: int = 16) -> Model:
    """A small model of one text alone, made on the driver."""
    tokens = TOKEN.findall(value.lower())
    counts = Counter(tokens)
    names = ["<unk>", *(t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: size - 1])]
    ids = {t: i for i, t in enumerate(names) if i}
    follow: dict[int, Counter] = {}
    for a, b in zip(tokens, tokens[1:], strict=False):
        follow.setdefault(ids.get(a, 0), Counter())[ids.get(b, 0)] += 1
    quantised = lambda n, total: min(127, max(1, int(n / total * 127 + 0.5)))
    followers = {}
    for a, after in follow.items():
        top = sorted(after.items(), key=lambda x: (-x[1], x[0]))[:most]
        total = sum(n for _, n in top)
        followers[a] = [(b, quantised(n, total)) for b, n in top]
    most_often = max(counts.values(), default=1)
    return Model(ids, names, followers, [(ids[t], quantised(counts[t], most_often)) for t in names[1:65]])


# Fixed values of sampling: how many followers compete, temperature, remembered tokens, how repeats decay, tokens before an end.
CANDIDATES, TEMPERATURE, REMEMBERED, REPEAT_DECAY, LEAST_TOKENS = 12, 0.95, 28, 0.9, 16
# Factors of a token's chance, and marks that open, close and end.
AGAIN, STREAK_END, STREAK, MARK, EARLY_END, WORD, NO_WORD, TERM, PREFIX = 0.14, 0.55, 0.18, 0.92, 0.45, 1.15, 0.9, 1.9, 1.28
OPENING, CLOSING, ENDING = "([{", ")]}", ".!?"


def generator(seed: int) -> Iterator[float]:
    """Numbers from 0 to 1 of a 32-bit generator that adds a constant and mixes."""
    state, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        state = state + 0x6D2B79F5 & mask
        x = (state ^ state >> 15) * (1 | state) & mask
        x ^= x + ((x ^ x >> 7) * (61 | x) & mask) & mask
        yield (x ^ x >> 14) / 2**32


def has_word(token: str) -> bool:
    return any(c.isascii() and (c.isalnum() and not c.isupper() or c == "_") for c in token)


def repeats(history: list[int], n: int) -> bool:
    """Whether the last ``n`` of a history stood there before."""
    tail = history[-n:]
    return len(history) > n and any(history[i : i + n] == tail for i in range(len(history) - n))


class Writer:
    """A text that goes on, token by token, from the end of a seed."""

    def __init__(self, model: Model, seed_text: str):
        self.model = model
        tokens = TOKEN.findall(seed_text.lower())
        self.terms, self.prefixes = domain_terms(tokens)
        self.otherwise = model.unigrams[0][0] if model.unigrams else 0
        self.now = model.ids.get(tokens[-1] if tokens else "", self.otherwise)
        self.seed = hashing.fnv1a(seed_text)
        self.chance = generator(self.seed or 1)
        self.ids: list[int] = []
        self.tokens: list[str] = []
        self.open = self.marks = 0  # brackets that are open; marks in a row

    def relevance(self, token: str) -> float:
        return TERM if token in self.terms else PREFIX if token.startswith(tuple(self.prefixes)) else 1.0

    def factor(self, i: int, token: str) -> float:
        """What a candidate's weight is multiplied by; 0 where it may not come now."""
        mark, end = not has_word(token), token in ENDING
        closes = any(c in token for c in CLOSING)
        if not token or token == "<unk>" or (mark and not self.ids) or (closes and self.open <= 0) or repeats([*self.ids, i], 3):
            return 0.0
        out = 1 / (1 + self.ids[-REMEMBERED:].count(i) * REPEAT_DECAY) * (WORD if not mark else NO_WORD) * self.relevance(token)
        out *= AGAIN if i == self.now else 1.0
        if mark:
            out *= (STREAK_END if end else STREAK) if self.marks >= 2 else MARK
        return out * (EARLY_END if end and len(self.ids) < 8 else 1.0)

    def chosen(self, followers: list[tuple[int, int]], step: int) -> int:
        names = self.model.names
        words = [f for f in followers if has_word(names[f[0]])]
        pool = (words if words and step % 6 else followers)[:CANDIDATES]
        scored = [(i, s) for i, q in pool if (s := max(0.0001, q / 127) ** (1 / TEMPERATURE) * self.factor(i, names[i])) > 1e-6]
        if not scored:
            return next((i for i, _ in pool if i != self.now), pool[0][0]) if pool else 0
        at = next(self.chance) * sum(s for _, s in scored)
        run = 0.0
        for i, s in scored:
            run += s
            if run >= at:
                return i
        return scored[-1][0]

    def step(self, k: int) -> bool:
        """Takes the next token; False: the text ends here."""
        followers = self.model.followers.get(self.now) or self.model.unigrams
        if not followers:
            return False
        i = self.chosen(followers, k) or followers[(self.seed + 31 * k) % min(3, len(followers))][0]
        token = self.model.names[i]
        if not i:
            self.now = self.otherwise
            return True
        self.ids.append(i)
        self.tokens.append(token)
        self.now = i
        self.open += 1 if token in OPENING else -1 if self.open > 0 and any(c in token for c in CLOSING) else 0
        self.marks = 0 if has_word(token) else self.marks + 1
        n, told = len(self.tokens), not self.terms or any(t in self.terms for t in self.tokens)
        if n >= LEAST_TOKENS and (self.marks >= 6 or token in ENDING and (told or len(set(self.ids[-14:])) < 4)):
            return False
        return not (n >= 8 and repeats(self.ids, 4))


def continuation(model: Model, seed_text: str, most: int) -> str:
    """At most ``most`` more tokens of a text, drawn by a generator that its hash seeds: the same text always goes on
    alike. Marks at the ends that neither open nor end anything are cut."""
    w = Writer(model, seed_text)
    for k in range(most):
        if not w.step(k):
            break
    kept = list(w.tokens)
    while kept and not has_word(kept[0]) and kept[0] not in OPENING:
        kept.pop(0)
    while kept and not has_word(kept[-1]) and kept[-1] not in ENDING and not any(c in kept[-1] for c in CLOSING):
        kept.pop()
    return udfs.detokenize(kept or w.tokens)
