"""The token index against the search without one, and the vector index against a comparison with all."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import retrieval, tokenindex, vectorindex

MEMORY = "id string, projectId string, kind string, title string, summary string, content string, tags array<string>, importance double, confidence double, lastAccessedAt long"


def memory(i, title, project="p", tags=("t",)):
    return (f"m{i:02}", project, "semantic", title, f"summary {i}", f"content {i}", list(tags), 0.1 + i / 100, 0.5, 1000 + i)


def found(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def changes():
    """Rows, changes of them, and the rows afterwards with what is archived."""
    rows = [memory(i, f"alpha note {i} {'beta' if i % 3 else 'gamma gamma'}", "p" if i % 4 else "q") for i in range(40)] + [memory(50, None), memory(51, "")]
    delta = [memory(3, "delta word", tags=("alpha", "new")), memory(4, "beta only", "q"), memory(60, "epsilon beta")]
    removed, archived, restored = ["m05", "m99"], ["m06", "m60", "m07"], ["m07"]
    after = {r[0]: r for r in rows} | {r[0]: r for r in delta}
    del after["m05"]
    return rows, delta, removed, archived, restored, list(after.values()), ["m06", "m60"]


def indexed(spark, path, changes):
    rows, delta, removed, archived, restored, *_ = changes
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    index = tokenindex.TokenIndex(spark, path, 8).build(spark.createDataFrame(rows, MEMORY))
    index.archive(ids(archived[:1]), 1)
    index.upsert(spark.createDataFrame(delta, MEMORY), 2)
    index.remove(ids(removed), 3)
    index.archive(ids(archived[1:]), 4)
    index.restore(ids(restored), 5)
    return index


def test_index_finds_what_a_scan_finds(spark, tmp_path, changes):
    index = indexed(spark, str(tmp_path / "i"), changes)
    *_, after, archived = changes
    now = spark.createDataFrame(after, MEMORY)
    gone = spark.createDataFrame([(x,) for x in archived], "id string")
    for each in (index, index.packed(str(tmp_path / "packed"))):
        for q in ("beta", "Gamma, delta!", "epsilon", "nowhere", "note new", "!!", "   ", "summary"):
            for project in (None, "p", "q"):
                want = found(retrieval.token_search(now, q, 9_000, 7, project, ("new",), gone))
                assert found(each.search(now, q, 9_000, 7, project, ("new",))) == want, (q, project)
        assert found(each.search(now, "epsilon", 9_000, 7, archived=True)) == found(retrieval.token_search(now, "epsilon", 9_000, 7))
    counts = {r["id"]: (r["hits"], r["tf"]) for r in index.matching("gamma note alpha", "p").collect()}
    assert counts["m09"] == (3, 4) and counts["m03"] == (1, 1) and "m06" not in counts
    assert {r["id"] for r in index.matching("epsilon", archived=True).collect()} == {"m60"}


def test_a_query_opens_its_buckets_alone(spark, tmp_path, changes):
    index = indexed(spark, str(tmp_path / "i"), changes)
    one = index.postings(["beta"])
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket") or "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].splitlines()[0]
    assert "PushedFilters" in plan and "token" in plan.split("PushedFilters", 1)[1].splitlines()[0]
    assert one.select("bucket").distinct().count() == 1
    files = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert all(f"bucket={one.first()['bucket']}/" in f for f in files)


def test_a_change_that_was_cut_off_has_no_effect(spark, tmp_path, changes):
    index = indexed(spark, str(tmp_path / "i"), changes)
    before = sorted(map(tuple, index.matching("beta").collect()))
    lost = tokenindex.postings_of(spark.createDataFrame([memory(8, "beta beta beta")], MEMORY), 6)
    lost.withColumn("bucket", index.bucket(F.col("token"))).write.partitionBy("bucket").mode("append").parquet(f"{index.path}/postings")
    assert sorted(map(tuple, index.matching("beta").collect())) == before
    index.upsert(spark.createDataFrame([memory(8, "zeta")], MEMORY), 7)
    assert {r["id"] for r in index.matching("zeta").collect()} == {"m08"} and "m08" not in {r["id"] for r in index.matching("beta").collect()}


def vectors(n, dim, seed, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 3
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.4


def nearest_brute(rows, asked, k, dim):
    out = []
    good = [(i, np.asarray(v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    x = vectorindex.unit(np.stack([v for _, v in good]))
    for i, v in asked:
        if v is None or len(v) != dim or not all(y is not None and np.isfinite(y) for y in v):
            continue
        s = np.round(vectorindex.unit(np.asarray(v)[None])[0] @ x.T, 9)
        best = sorted((-a, j) for a, (j, _) in zip(s, good, strict=True) if j != i)[:k]
        out += [(i, p, j, -a) for p, (a, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("k,block,clusters", [(5, 16, 12), (1, 64, 1), (30, 8, 40)])
def test_vector_index_is_exact(spark, monkeypatch, k, block, clusters):
    monkeypatch.setattr(vectorindex, "BLOCK", block)
    monkeypatch.setattr(vectorindex, "QUERIES", 7)
    made = vectors(400, 8, k, clusters)
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]  # equal vectors: ties by id
    rows += [(1100 + i, rows[0][1]) for i in range(60)] + [(2000, [0.0] * 8), (2001, None), (2002, [1.0]), (2003, [None] * 8), (2004, [float("nan")] * 8), (2005, [1e-5] * 8)]
    asked = [r for r in rows if r[0] % 20 == 0] + [(-1, made[5].tolist()), (-2, [0.0] * 8), (-3, [1.0] * 9), (-4, None)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    index = vectorindex.build_index(table, lists=10)
    best, met = index.nearest(spark.createDataFrame(asked, "id long, embedding array<double>").repartition(2), k)
    got, want = sorted(map(tuple, best.select("query", "place", "id", "similarity").collect())), nearest_brute(rows, asked, k, 8)
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([float(r[3]) for r in want])
    counts = {r["query"]: (r["met"], r["blocks"]) for r in met.collect()}
    assert index.blocks.agg(F.sum("n")).first()[0] == 400 + 40 + 60 + 2 and index.blocks.agg(F.max("n")).first()[0] <= block
    if clusters == 12:
        skipped = [1 - m / b for q, (m, b) in counts.items() if q >= 0 and q != 2000]
        assert np.mean(skipped) > 0.5


def test_vector_index_of_little(spark):
    kind = "id string, embedding array<float>"
    none = vectorindex.build_index(spark.createDataFrame([], kind))
    assert none.nearest(spark.createDataFrame([("q", [1.0])], kind), 3)[0].collect() == []
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], kind)
    best, _ = vectorindex.build_index(two, lists=5).nearest(two, 3)
    assert sorted((r["query"], r["id"], r["similarity"]) for r in best.collect()) == [("a", "b", 0.0), ("b", "a", 0.0)]
