"""Places and neighbours in groups of any size, logs as lines, and nested rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strata.operators import ordered
from strata.sources import chat, corpus


@pytest.mark.parametrize("groups", [["a"], ["a", "b", None], list("abcdefghijklmnop"), [str(i) for i in range(300)]])
def test_places_and_neighbours(spark, groups):
    rng = random.Random(len(groups))
    rows = [(rng.choice(groups) if len(groups) != 3 or rng.random() < 0.2 else "a", i, f"v{i}" if i % 5 else None) for i in range(200)]
    df = ordered.placed(spark.createDataFrame(rows, "g string, i int, v string").repartition(3), ["g"], ["i"], ["i", "v"])
    got = {r["i"]: (r["place"], r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in df.collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    want = {r[0]: (k, rs[k - 1] if k else None, rs[k + 1] if k + 1 < len(rs) else None) for rs in map(sorted, by.values()) for k, r in enumerate(rs)}
    assert got == want
    assert df.select(F.spark_partition_id()).distinct().count() > 1  # also where there is one group


def test_places_of_nothing(spark):
    assert ordered.placed(spark.createDataFrame([], "g string, i int"), ["g"], ["i"], ["i"]).collect() == []


def item(rng):
    said = lambda: rng.choice(["one", "two", "three", " ", "four words are here"])
    files = rng.choice([{}, {"files": ["a.ts", "b.ts"]}, {"references": [{"uri": "c.ts"}, "a.ts"]}])
    at = rng.choice([{}, {"timestamp": rng.randint(1, 9)}, {"time": "2024-01-01"}])
    return files | at | rng.choice([{"role": "user", "content": said()}, {"role": "user", "content": said()}, {"role": "assistant", "content": said()}, {"type": "assistant.message", "data": {"content": said()}}, {"role": "tool", "content": "x"}, {"prompt": said(), "response": said()}, {"nothing": 1}, {"v": {"requests": []}}])


def event(rng):
    value = rng.choice(["text", {"text": "a text"}, [{"value": "late"}, {"kind": "thinking", "value": "hm"}], None, 5, [], {"parts": ["p", {"text": "q"}]}])
    whole = {"v": {"requests": [rng.choice([{"message": "m"}, {"message": {"text": "n"}, "response": "r"}, {}, 7, {"role": "user", "content": "asked"}, {"role": "assistant", "content": "told", "files": ["x"]}, {"timestamp": 3}]) for _ in range(rng.randint(0, 4))]}}
    path = [rng.choice(["requests", "requests", "other"]), rng.choice([0, 1, 2, "3", "x", -1]), rng.choice(["response", "message", "timestamp", "title"])]
    return rng.choice([whole, {"k": path, "v": value}, {"k": path, "v": value}, {"k": ["requests"], "v": 1}, item(rng)])


def test_logs_as_lines_are_read_as_whole_logs(spark):
    rng = random.Random(11)
    logs = {}
    for k in range(60):
        make = item if k % 2 else event
        lines = [rng.choice(["no json", "[]", "7", ""]) if rng.random() < 0.1 else json.dumps(make(rng)) for _ in range(rng.choice([0, 1, 3, 12, 40]))]
        logs[f"log{k}.jsonl"] = lines
    logs["long.jsonl"] = [json.dumps(item(rng)) for _ in range(1500)]
    whole = chat.chat_turns(spark.createDataFrame([(p, "\n".join(x)) for p, x in logs.items()], "path string, value string"))
    rows = [(p, k // 7 * 100, k, x) for p, lines in logs.items() for k, x in enumerate(lines)]
    rng.shuffle(rows)
    got = chat.log_turns(spark.createDataFrame(rows, "path string, block long, row long, value string").repartition(5))
    key = lambda r: (r["path"], r["turn"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, whole.select(got.columns).collect()), key=str)
    assert len({key(r) for r in got.collect()}) == whole.count() > 500


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"role": "user", "content": "q"}\n\n{"role": "assistant", "content": "a"}\n')
    got = chat.log_turns(chat.log_lines(spark, [str(tmp_path / "a.jsonl")])).collect()
    assert [(r["turn"], r["prompt"], r["response"]) for r in got] == [(0, "q", "a")]
    assert chat.log_turns(chat.log_lines(spark, [])).collect() == []


def test_nested_rows(spark):
    told = lambda x: f"a text of the api that is long enough, {x}"
    row = {"b": told(1), "a": {"x": [told(2), {"y": told(3), "z": {"deep": told(4)}}], "n": 7, "short": "short"}, "c": None, "d": [], "e": {"k": [[told(5)], [[told(6)]]]}}
    assert list(corpus.json_texts(row)) == [told(1), told(2), told(3), "short", told(5)]
    rows = [(1, json.dumps(row)), (2, "{"), (3, None), (4, json.dumps({"a": "a text that is long enough but of no interest"})), (5, json.dumps([told(9)]))]
    got = {r["i"]: r["snippet"] for r in corpus.nested_corpus(spark.createDataFrame(rows, "i int, s string"), "s", name="d", as_json=True).collect()}
    assert got == {1: "# dataset:d\n" + "\n".join(told(k) for k in (1, 2, 3, 5)), 5: f"# dataset:d\n{told(9)}"}
    kind = "i int, b string, a struct<x: array<struct<y: string, z: struct<deep: string>>>, n: int>, m map<string, array<string>>"
    typed = [(1, told(1), ([(told(3), (told(4),)), None], 7), {"k": [told(5), None]}), (2, None, None, None)]
    got = {r["i"]: r["snippet"] for r in corpus.nested_corpus(spark.createDataFrame(typed, kind), "b", "a", "m", name="d").collect()}
    assert got == {1: "# dataset:d\n" + "\n".join(told(k) for k in (1, 3, 5))}


@pytest.mark.parametrize("groups", [["a"], ["a", None, "b"]])
def test_runs_of_equal_values(spark, groups):
    rng = random.Random(4)
    rows = [(rng.choice(groups), i, None if i % 40 > 36 else "x" if rng.random() < 0.8 else "y") for i in range(400)]
    got = {r["i"]: (r["place"], r["seen"]) for r in ordered.runs(spark.createDataFrame(rows, "g string, i int, v string").repartition(3), ["g"], ["i"], "v").collect()}
    want, last, n, places = {}, {}, {}, {}
    for g, i, v in rows:
        n[g] = n.get(g, 0) + 1 if g in last and last[g] == v else 1
        last[g], places[g] = v, places.get(g, -1) + 1
        want[i] = (places[g], n[g])
    assert got == want
