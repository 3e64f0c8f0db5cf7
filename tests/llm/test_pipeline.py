"""The pipeline: each stage does what its operator says, on all its predecessor kept, and clean documents survive."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import decontam, neardup, suffixdedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    words = lambda n: [word() for _ in range(n)]
    docs = [(i, " ".join(words(120))) for i in range(300)]
    for i in range(0, 300, 5):
        w = docs[i][1].split()
        w.insert(7, rng.choice(["vilest", "grotty"]))
        w.insert(40, rng.choice(["vilest", "grotty"]))
        docs[i] = (i, " ".join(w))
    near = [(400 + i, docs[i][1] + " end") for i in (1, 2, 3)]
    passage = " ".join(words(70))
    share = [(500 + i, " ".join(words(100)) + " " + passage + " " + " ".join(words(100))) for i in range(3)]
    item = " ".join(words(30))
    dirty = [(600, " ".join(words(50)) + " " + item + " " + " ".join(words(50)))]
    rows = docs + near + share + dirty + [(700, None), (701, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, tmp_path):
    d = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    every = ids(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, d).cache()
        assert after.columns == docs.columns
        if name == "toxicity":
            assert every - ids(after) == set(range(0, 300, 5))
            model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
            assert ids(after) == {r["doc_id"] for r in toxicity.toxicity(docs, model).where("NOT rejected").collect()}
        elif name == "near_duplicates":
            assert ids(docs) - ids(after) == {401, 402, 403} == {r["doc_id"] for r in neardup.near_duplicates(docs).where("NOT kept").collect()}
        elif name == "repeated_passages":
            assert ids(after) == ids(docs)
            was, now = ({r["doc_id"]: len((r["text"] or "").split()) for r in x.collect()} for x in (docs, after))
            assert {i: was[i] - now[i] for i in was if was[i] != now[i]} == {501: 70, 502: 70}
            assert suffixdedup.repeated_passages(after).isEmpty()
        else:
            assert ids(docs) - ids(after) == {600} == {r["doc_id"] for r in decontam.contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet")).where("contaminated").collect()}
        docs = after
    packed = corpus_pipeline.run(spark, d)
    assert ids(packed) == ids(docs)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).where("n <> t").isEmpty()


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows, rows without an id, null and empty texts, and columns of any name."""
    made = [(1, "some words of a text that is here twice", 1), (1, "some words of a text that is here twice", 2), (1, "another text of the same id", 3), (None, "no id", 4), (None, None, 5), (2, None, 6), (2, None, 7), (3, "", 8)]
    names = "doc_id long, text string, key long, row string, spans int, kept int, h int, rejected string, key_of_spans int"
    rows = spark.createDataFrame([(i, t, k, "x", 1, 0, 2, "r", 3) for i, t, k in made], names)
    for name, docs, labels, bench in (("full", rows, [(1, 0), (3, 1)], [(1, "words of nothing here")]), ("bare", rows, [], []), ("empty", rows.limit(0), [], [])):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            now = run(spark, now, d).cache()
            assert now.columns == docs.columns
            if name != "empty":
                assert now.where("doc_id IS NULL").count() == 2
                assert now.count() == (5 if stage in ("near_duplicates", "repeated_passages", "decontamination") else 8), stage
        packed = corpus_pipeline.run(spark, d)
        assert packed.select("doc_id").distinct().count() == (4 if name != "empty" else 0)


def test_run_leaves_only_its_result(spark, tmp_path):
    from strata.llm import shared

    d = folder(spark, tmp_path)
    before = len(shared.MADE)
    packed = corpus_pipeline.run(spark, d)
    assert len(shared.MADE) == before + 1 and packed.count() > 0
    shared.remove_written(spark, before)
    assert len(shared.MADE) == before
