"""URL rules held in Bloom filter cascades.

A rule is a host and a path prefix; it fits its host and all subdomains where the url's path starts with the
rule's. A url's candidate keys are its host suffixes times the prefixes of its path that have the length of
some rule's path. Level 1 of a cascade is a Bloom filter of the listed keys; level 2 one of those keys of the
corpus that level 1 lets through wrongly; level 3 one of the listed keys that level 2 lets through, and so on
until none is left. As every candidate key of the corpus took part, the first level that lacks a key tells
exactly whether it is listed: a level of odd number, not; of even number, it is. Urls meet the cascade, which
is broadcast, in their own scan; no join takes place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checked_broadcast, columns_of


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without it, or null: empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(rest_of(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    whole = F.substring_index(F.substring_index(rest_of(url), "?", 1), "#", 1)
    at = F.instr(whole, "/")
    return F.when(at > 0, whole.substr(at, F.length(whole))).otherwise("")


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


#: A key is its 128-bit hash, as two 64-bit halves.
KEY = np.dtype([("a", np.uint64), ("b", np.uint64)])


class Bloom:
    """A Bloom filter over hashed keys; ``has`` answers for an array of them."""

    def __init__(self, bits: int, hashes: int, seed: int):
        self.bits, self.hashes, self.seed = max(64, bits), hashes, seed
        self.words = np.zeros((self.bits + 63) // 64, np.uint64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places of each key, one row per hash."""
        x = keys["a"] ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 & 2**64 - 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (x ^ keys["b"]) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        return (x[None] + np.arange(self.hashes, dtype=np.uint64)[:, None] * y[None] >> np.uint64(11)) % np.uint64(self.bits)

    def add(self, keys: np.ndarray) -> None:
        at = self.places(keys)
        np.bitwise_or.at(self.words, (at >> np.uint64(6)).ravel(), np.uint64(1) << (at & np.uint64(63)).ravel())

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        at = self.places(keys)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=0)

    @classmethod
    def of(cls, keys: np.ndarray, rate: float, seed: int) -> Bloom:
        bits = math.ceil(-max(1, len(keys)) * math.log(rate) / math.log(2) ** 2)
        made = cls(bits, max(1, round(bits / max(1, len(keys)) * math.log(2))), seed)
        made.add(keys)
        return made


class Cascade:
    """Alternate levels; ``listed`` is exact for the keys that took part in building it."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def listed(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), len(self.levels) % 2 == 1)
        left = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            has = level.has(keys[left])
            out[left[~has]] = k % 2 == 1
            left = left[has]
        return out

    @property
    def n_bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def hashed(keys: list[str]) -> np.ndarray:
    """Two of 10^12 distinct keys have one hash with a chance of about 1 in 10^14."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), KEY)


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every key that a rule fitting this url could have, the longest first."""
    if not host:
        return []
    ends = [host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")]
    fronts = [path[:n] for n in lengths if n <= len(path)]
    return [e + p for e, p in sorted(((e, p) for e in ends if e for p in fronts), key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def build_cascades(parts: DataFrame, listed: dict[str, np.ndarray], lengths: list[int], rate: float | None, most_bytes: int) -> dict[str, Cascade]:
    """A cascade of each name's ``listed`` keys against all candidate keys of ``parts`` (host, path).

    Only a Bloom filter's false positives come to the driver, about ``rate`` of the distinct keys at level 1; their
    number is checked first. Without a rate it follows from an estimate of the distinct urls.
    """
    spark = parts.sparkSession
    most = most_bytes // KEY.itemsize // max(1, len(listed))
    if rate is None:
        n = parts.agg(F.approx_count_distinct(F.struct("host", "path")).alias("n")).first()["n"]
        rate = min(1e-3, most / (100.0 * max(1, n)))  # a url has some ten candidates; ten times as few as fit
    first = {v: Bloom.of(k, rate, 1) for v, k in listed.items()}
    sent = checked_broadcast((first, listed, lengths), sum(b.words.nbytes for b in first.values()) + sum(k.nbytes for k in listed.values()), spark, "the first levels", most_bytes)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms, true, sizes = sent.value
        for batch in batches:
            keys = np.unique(hashed([k for h, p in zip(*columns_of(batch, "host", "path"), strict=True) for k in candidates(h, p, sizes)]))
            for v, bloom in blooms.items():
                through = keys[bloom.has(keys)]
                wrong = through[~np.isin(through, true[v])]
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(wrong), pa.string()), pa.array(wrong["a"].view(np.int64)), pa.array(wrong["b"].view(np.int64))], ["name", "a", "b"])

    wrong = parts.mapInArrow(passing, "name string, a long, b long").distinct()
    got = wrong.limit(most * len(listed) + 1).toArrow()
    if got.num_rows > most * len(listed):
        raise ValueError(f"over {most * len(listed)} false positives at level 1; lower the rate")
    names = np.array(got.column("name").to_pylist(), object)
    pairs = np.empty(got.num_rows, KEY)
    for half in ("a", "b"):
        pairs[half] = got.column(half).to_numpy().view(np.uint64)
    out = {}
    for v in listed:
        levels, include, exclude = [first[v]], np.sort(pairs[names == v]), listed[v]
        while len(include):
            levels.append(Bloom.of(include, 0.5, len(levels) + 1))
            exclude = exclude[levels[-1].has(exclude)]
            include, exclude = exclude, include
        out[v] = Cascade(levels)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", default: str = "allow", rate: float | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict.

    ``rules``: (verdict, host + path prefix), e.g. ("block", "net/es/"); the longest fitting rule wins, of
    equally long ones the one with the longer host. Urls that no rule fits get ``default``: they aren't
    listed. Null urls and those without ``://`` have an empty host and path, and no rule. Null and repeated keys
    and rows stay; urls may be of any length; other columns are ignored; an empty table gives an empty result;
    without rules all get ``default``. ``rate`` sizes level 1 and doesn't change results; cascades above
    ``most_bytes`` are refused.
    """
    spark = pages.sparkSession
    names = sorted({v for v, _ in rules})
    lengths = sorted({len(r) - r.index("/") for _, r in rules}, reverse=True)
    slim = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    slim = slim.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    parts = slim.select("host", "path")
    # one cascade per verdict: which keys are listed at all, and to which end
    cascades = build_cascades(parts, {v: np.unique(hashed([r for w, r in rules if w == v])) for v in names}, lengths, rate, most_bytes) if names else {}
    sent = checked_broadcast((cascades, lengths), sum(c.n_bytes for c in cascades.values()), spark, "the cascades", most_bytes)
    key_type = pages.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sizes = sent.value
        for batch in batches:
            per_row = [candidates(h, p, sizes) for h, p in zip(*columns_of(batch, "host", "path"), strict=True)]
            keys = [k for x in per_row for k in x]
            at = np.repeat(np.arange(len(per_row)), [len(x) for x in per_row])
            rule: list[str | None] = [None] * len(per_row)
            verdict = [default] * len(per_row)
            h = hashed(keys)
            found = [(k, v) for v, c in made.items() for k in np.flatnonzero(c.listed(h))]
            for k, v in sorted(found, reverse=True):  # the first of a row, which is the longest, is set last
                rule[at[k]], verdict[at[k]] = keys[k], v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["key", "host", "path", "rule", "verdict"])

    return slim.mapInArrow(judge, f"key {key_type}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)
