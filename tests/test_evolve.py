"""Exact overlap search and evolution, against plain Python."""

import random
import re

import pytest

from strata.operators import evolve, overlap
from strata.operators.lineage import KEPT, remove_kept


def words_of(x):
    return {w for w in re.split("[^a-z0-9_]+", (x or "").lower()) if len(w) > 1}


def brute(asking, listed, k):
    out = []
    for i, grp, t, own in asking:
        found = sorted((-s, j) for j, g, u in listed if g == grp and grp is not None and u is not None and t is not None and j != own and (s := len(words_of(t) & words_of(u))))
        out += [(i, p, j, -s) for p, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def made_texts(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    return [" ".join(rng.choices(vocab, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("k,rounds", [(3, overlap.ROUNDS), (1, (1, 2)), (5, ()), (40, (2,))])
def test_top_overlaps_are_exact(spark, k, rounds):
    texts = made_texts(220, k)
    texts[:60] = ["w1 w2 common"] * 60  # copies: one class, ties by id
    listed = [(f"m{i:03}", "p" if i % 4 else "q", t) for i, t in enumerate(texts)] + [("null", None, "w1"), ("none", "p", None), ("blank", "p", " . ")]
    asking = [(i, g, f"{t.upper()} extra", i) for i, g, t in listed if i not in ("null", "none")] + [("other", "p", "common w7 w9", None), ("null", None, "w1", None), ("none", "p", None, None), ("far", "elsewhere", "w1", None)]
    before = len(KEPT)
    got = overlap.top_overlaps(spark.createDataFrame(asking, "id string, grp string, t string, own string").repartition(3), spark.createDataFrame(listed, "id string, grp string, t string").repartition(3), k, rounds)
    assert sorted(map(tuple, got.collect())) == brute(asking, listed, k)
    remove_kept(spark, before)


def test_frequent_words_are_not_joined(spark, monkeypatch):
    """Two texts that only share what all have never meet, as others share more."""
    listed = [(f"m{i:03}", "p", f"all have these rare{i // 5} pair{i // 5} seldom{i // 5}") for i in range(100)]
    met = []
    original = overlap.kept

    def noted(df, name):
        out = original(df, name)
        met.append((name, out.count()))
        return out

    monkeypatch.setattr(overlap, "kept", noted)
    got = overlap.top_overlaps(spark.createDataFrame([(i, g, t, i) for i, g, t in listed], "id string, grp string, t string, own string"), spark.createDataFrame(listed, "id string, grp string, t string"), 3, (3,))
    assert {r["id"]: r["shared"] for r in got.collect()} == {i: 6 for i, _, _ in listed}
    assert [n for name, n in met if name == "overlap-best"][-1] <= 4 * 100


def candidate(key, place, title, summary, content="body", tags=("a",), kind="semantic", own=None, project="p"):
    return (key, place, project, kind, title, summary, content, list(tags), "ref", own)


CANDIDATE = "key string, place int, projectId string, kind string, title string, summary string, content string, tags array<string>, sourceRef string, own string"
MEMORY = "id string, projectId string, kind string, sourceType string, title string, summary string, content string, tags array<string>, importance double, confidence double, createdAt long, lastAccessedAt long, sourceRef string"
LONG = "Upgrade the progression pipeline with staged telemetry; rank candidates, guard archives. " * 5


def store(spark):
    rows = [(f"n{i}", "p", "semantic", "system", f"Caching pipeline note {i}", f"telemetry {i}", "c", ["cache", f"t{i}"], 0.7, 0.7, 1, 1, "s") for i in range(7)]
    return spark.createDataFrame(rows, MEMORY)


def test_evolution_reviews_chooses_and_stores(spark):
    rows = [
        candidate("merge", 0, "Low", "weak"), candidate("merge", 1, "Primary pipeline note", LONG), candidate("merge", 2, "Primary pipeline note", LONG),
        candidate("compress", 0, "A plain thing", "x" * 30, content="line\nline\n" + "y" * 1500), candidate("reject", 0, "", ""), candidate("known", 0, "Say", "Caching pipeline note 1 telemetry 1", tags=("keep",)),
    ]
    made = evolve.evolve(spark.createDataFrame(rows, CANDIDATE), store(spark), 5_000, merge=evolve.union_of_tags)
    got = {r["key"]: r for r in made.results.collect()}
    assert set(got) == {"merge", "compress", "reject", "known"}
    m = got["merge"]
    assert (m["stored"], m["action"], m["proposed"], m["selected"], m["merged"], m["neighbors"], m["promoted"], m["reason"]) == (True, "merge", 3, 1, True, 5, True, "fallback-heuristic")
    assert [s["stage"] for s in m["stages"]] == ["propose", "review", "consolidate", "archivist", "persist"] and m["stages"][2]["detail"] == "merged-with-5-neighbor(s)"
    c = got["compress"]
    assert (c["action"], c["neighbors"], [s["stage"] for s in c["stages"]]) == ("compress", 0, ["propose", "review", "compress", "consolidate", "archivist", "persist"]) or c["action"] == "store"
    r = got["reject"]
    assert (r["stored"], r["action"], r["reason"], r["id"], [s["ok"] for s in r["stages"]]) == (False, "reject", "empty-candidate", None, [True, False])
    reviews = {(x["key"], x["place"]): x for x in made.reviews.collect()}
    assert len(reviews) == 6 and reviews["known", 0]["novelty"] == pytest.approx(1 - 1 / 3)
    after = {x["id"]: x for x in made.memories.collect()}
    assert len(after) == 7 + sum(x["stored"] for x in got.values())
    new = after[m["id"]]
    assert new["tags"] == ["a", "cache", "t0", "t1", "t2", "t3", "t4", "promoted"] and new["importance"] >= 0.9 and new["createdAt"] == 5_000 and new["sourceType"] == "system"
    assert all(after[f"n{i}"]["title"] == f"Caching pipeline note {i}" for i in range(7))


def test_evolution_again_replaces_what_it_stored(spark):
    rows = [candidate("a", 0, "Primary pipeline note", LONG, own=None), candidate("b", 0, "Primary pipeline note", LONG)]
    first = evolve.evolve(spark.createDataFrame(rows, CANDIDATE), store(spark), 5_000)
    assert first.memories.count() == 8  # equal texts are one memory
    again = evolve.evolve(spark.createDataFrame(rows, CANDIDATE), first.memories, 6_000)
    assert again.memories.count() == 8 and again.memories.where("createdAt = 6000").count() == 1


def test_evolution_of_nothing(spark):
    none = spark.createDataFrame([], CANDIDATE)
    made = evolve.evolve(none, store(spark), 1)
    assert made.results.count() == 0 and made.memories.count() == 7
    one = evolve.evolve(spark.createDataFrame([candidate("a", 0, "T", LONG, project=None)], CANDIDATE), spark.createDataFrame([], MEMORY), 1)
    assert one.results.first()["neighbors"] == 0 and one.memories.first()["projectId"] == "default"


@pytest.mark.parametrize("k,rows", [(3, 16), (40, 1 << 15), (1, 1)])
def test_texts_of_frequent_words_are_counted_in_blocks(spark, monkeypatch, k, rows):
    monkeypatch.setattr(overlap, "MEET", 0)
    monkeypatch.setattr(overlap, "BLOCK_ROWS", rows)
    monkeypatch.setattr(overlap, "ASK_ROWS", 2 * rows)
    met = []
    monkeypatch.setattr(overlap, "first_rows", lambda df, by, order, n, original=overlap.first_rows: met.append(df) or original(df, by, order, n))
    texts = made_texts(60, k)
    texts[:20] = ["w1 w2 common"] * 20
    texts[20] = " ".join(f"w{i}" for i in range(300))  # more shared words than a byte holds
    listed = [(f"m{i:03}", "p" if i % 4 else "q", t) for i, t in enumerate(texts)]
    asking = [(i, g, f"{t.upper()} extra", i) for i, g, t in listed] + [("far", "elsewhere", "w1", None)]
    before = len(KEPT)
    got = overlap.top_overlaps(spark.createDataFrame(asking, "id string, grp string, t string, own string"), spark.createDataFrame(listed, "id string, grp string, t string"), k)
    assert sorted(map(tuple, got.collect())) == brute(asking, listed, k)
    assert met[1].union(met[2]).union(met[3]).isEmpty() and not met[4].isEmpty()  # none meets in a join
    remove_kept(spark, before)


def test_contents_travel_with_the_chosen_alone(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(evolve, "kept", lambda df, name, original=evolve.kept: kept.setdefault(name, original(df, name)))
    rows = [candidate("a", 0, "Primary pipeline note", LONG, content="one"), candidate("a", 0, "Primary pipeline note", LONG, content="one"), candidate("r", 0, "", "")]
    made = evolve.evolve(spark.createDataFrame(rows, CANDIDATE), store(spark), 5_000)
    assert {r["key"]: r["proposed"] for r in made.results.collect()} == {"a": 2, "r": 1}  # equal candidates don't meet each other
    assert sorted(r["content"] for r in made.reviews.collect()) == ["body", "one", "one"]
    assert made.memories.where("createdAt = 5000").first()["content"] == "one"
    assert "content" not in kept["reviews"].columns + kept["best"].columns
