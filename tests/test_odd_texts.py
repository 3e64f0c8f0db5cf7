"""Results that odd texts must have in Spark as in SQL, and rooms that ranges of atoms leave."""

from strata.operators import context
from strata.plans import catalog
from strata.sources import corpus


def test_greedy_packing_when_less_room_leaves_more(spark):
    # of a room of 10 a range of sixes leaves 4, of a room of 5 all of it: the second five fits only there, the third nowhere
    tokens = [5, *[6] * 17, 5, *[6] * 20, 5]
    df = spark.createDataFrame([("a", float(-i), i, "x" * 4 * t) for i, t in enumerate(tokens)], "g string, s double, k int, body string")
    assert [r["k"] for r in context.pack_greedy(df, "g", "s", "k", "body", 10).where("accepted").orderBy("k").collect()] == [0, 18]


def test_a_word_after_a_space_or_other_letter_tells_the_intent(spark, tmp_path):
    said = ["Das ist. Test und so.", "ein täst", "ät test", None]
    spark.createDataFrame([(i, 4, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["category"], r["confidence"]) for r in catalog.QUERIES["proactive_suggestion"](spark, str(tmp_path)).collect()}
    assert got == {0: ("testing", 0.5), 1: ("general", 0.45), 2: ("testing", 0.5), 3: ("general", 0.45)}


ODD = ("und so weiter und so İMPORT fort", "und so weiter let́ und so fort", "und so weiter {\x0b\" und so fort", "  function und so weiter und so fort  \x85")


def test_technical_rows_of_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "k int, text string")
    got = {r["k"]: r["snippet"] for r in corpus.dataset_corpus(rows, "text", name="web").collect()}
    head = "# dataset:web\n"
    assert got == {0: head + ODD[0], 1: head + ODD[1], 3: head + "function und so weiter und so fort \x85"}


def test_nested_rows_of_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "k int, text string").selectExpr("k", "named_struct('t', text) AS page")
    plain = corpus.nested_corpus(rows, "page", name="web").select("k", "snippet")
    raw = corpus.nested_corpus(rows.selectExpr("k", "to_json(named_struct('page', page)) AS row"), "row", name="web", as_json=True).select("k", "snippet")
    assert sorted(plain.collect()) == sorted(raw.collect())
    assert {r["k"] for r in plain.collect()} == {0, 1, 3}


def test_plan_of_raw_titles(spark):
    rows = [("a", 0.9, " spaced "), ("b", 0.8, "  "), ("c", 0.7, None), ("d", 0.6, "plain")]
    df = spark.createDataFrame(rows, "id string, score double, title string")
    told = lambda raw: [r["title"] for r in context.execution_plan(df, "q", 3, raw).orderBy("step").collect()][2:-2]
    assert told(True) == ["Inspect memory anchor:  spaced ", "Inspect memory anchor:   ", None]
    assert told(False) == ["Inspect memory anchor: spaced", "Inspect memory anchor: plain"]
