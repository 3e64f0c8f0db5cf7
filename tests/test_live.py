"""Streams with timers, rings and listings, against the same work on finished tables."""

import os
import random

import pytest

from strata.streaming import files, live

START = 1_700_000_000_000


def as_files(spark, tmp_path, name, rows, kind, parts):
    """Rows as a stream of files, one batch each; ``parts`` says how many rows each file has."""
    folder = tmp_path / name
    folder.mkdir()
    at = 0
    for k, n in enumerate(parts):
        spark.createDataFrame(rows[at : at + n], kind).coalesce(1).write.mode("overwrite").json(str(tmp_path / f"{name}-{k}"))
        for f in (tmp_path / f"{name}-{k}").glob("*.json"):
            os.utime(f, (k + 1, k + 1))
            f.rename(folder / f"{k:03}.json")
            os.utime(folder / f"{k:03}.json", (k + 1, k + 1))
        at += n
    assert at >= len(rows)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(folder))


def collected(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        return sorted(map(tuple, stream.sparkSession.table(name).collect()), key=str)
    finally:
        q.stop()


EMITTED, ACK = "suggestionHash string, atMs long", "suggestionHash string, atMs long, status string"


@pytest.mark.parametrize("parts", [[0], [20, 1, 30, 0]])
def test_suggestions_expire_or_are_settled(spark, tmp_path, parts):
    rng = random.Random(3)
    emitted = [(f"h{rng.randrange(25)}", START + rng.randrange(0, 40) * 10_000) for _ in range(90)]
    emitted = sorted(set(emitted))
    acks = [(f"h{rng.randrange(25)}", START + rng.randrange(0, 45) * 10_000, rng.choice(["ack", "applied", "suppressed", "other"])) for _ in range(110)]
    acks = sorted(set(acks))
    rng.shuffle(emitted)
    rng.shuffle(acks)
    want = sorted(map(tuple, live.lives_batch(spark.createDataFrame(emitted, EMITTED), spark.createDataFrame(acks, ACK)).collect()), key=str)
    ends = [START + 100_000_000, START + 200_000_000]  # move the watermark on; their own suggestions stay open
    of = lambda rows, ps: [*ps[:-1], len(rows) - sum(ps[:-1]), 1, 1]
    a = as_files(spark, tmp_path, "emitted", [*emitted, *((f"end{k}", t) for k, t in enumerate(ends))], EMITTED, of(emitted, parts))
    b = as_files(spark, tmp_path, "acks", [*acks, *((f"end{k}", t, "other") for k, t in enumerate(ends))], ACK, of(acks, parts))
    got = collected(live.lives(a, b, late="3 hours"), tmp_path, f"lives{len(parts)}")
    assert [r for r in got if r[0][:3] != "end"] == want and {r[2] for r in want} == {live.ACKED, live.APPLIED, live.SUPPRESSED, live.EXPIRED}


DELTA, CLIENT = "projectId string, id string, payload string, atMs long", "projectId string, client string, kind string, atMs long"


def bus_brute(deltas, clients, held, replayed):
    out, rings, listening = [], {}, {}
    rows = [(d[3], 0, d[1], d[0], "delta", None, d[2]) for d in deltas] + [(c[3], 1, f"{c[2]}:{c[1]}", c[0], c[2], c[1], None) for c in clients]
    for at, _, _, p, kind, client, payload in sorted(rows, key=lambda r: r[:3]):
        ring, who = rings.setdefault(p, []), listening.setdefault(p, set())
        if kind == "join":
            out.append((client, p, -1, "bootstrap", None, at))
            kept = [(n, *x) for n, x in enumerate(ring)][-held:][-replayed:]
            out += [(client, p, n, "replay", body, then) for n, body, then in kept]
            who.add(client)
        elif kind == "leave":
            who.discard(client)
        else:
            out += [(c, p, len(ring), "live", payload, at) for c in who]
            ring.append((payload, at))
    return sorted(out, key=str)


@pytest.mark.parametrize("held,replayed", [(20, 8), (5, 9)])
def test_clients_get_a_bootstrap_the_last_deltas_and_new_ones(spark, tmp_path, held, replayed):
    deltas = [("p" if i % 3 else "q", f"{i:03}", f"payload {i}", START + i * 1000) for i in range(90)]
    clients = [("p", "one", "join", START + 30_500), ("q", "one", "join", START + 30_500), ("p", "two", "join", START + 60_000), ("p", "one", "leave", START + 70_100), ("p", "one", "join", START + 80_000), ("q", "three", "leave", START + 5), ("z", "one", "join", START)]
    want = bus_brute(deltas, clients, held, replayed)
    a, b = spark.createDataFrame(deltas, DELTA), spark.createDataFrame(clients, CLIENT)
    assert sorted(map(tuple, live.bus_batch(a, b, held, replayed).collect()), key=str) == want
    for name, cuts in (("one", []), ("many", [10, 31, 65])):
        bounds = [0, *cuts, 10**9]
        of = lambda rows: [[r for r in rows if START + lo * 1000 <= r[3] < START + hi * 1000] for lo, hi in zip(bounds, bounds[1:], strict=False)]  # noqa: B023, E731
        d, c = of(deltas), of(clients)
        x = as_files(spark, tmp_path, f"d-{name}", [r for p in d for r in p], DELTA, list(map(len, d)))
        y = as_files(spark, tmp_path, f"c-{name}", [r for p in c for r in p], CLIENT, list(map(len, c)))
        assert collected(live.bus(x, y, held, replayed), tmp_path, f"bus_{name}_{held}") == want


def test_files_that_appear_change_and_go(spark, tmp_path):
    root = tmp_path / "root"
    (root / "node_modules").mkdir(parents=True)
    for name in ("a.ts", "b.py", "c.md", "node_modules/d.ts"):
        (root / name).write_text("one")
    out = str(tmp_path / "events")

    def run(existing=True):
        made = files.watch_files(spark, str(root), "p", existing=existing)
        q = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"cp-{existing}")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r["type"], r["path"].rsplit("/", 1)[1]) for r in spark.read.parquet(out).collect())

    assert run() == [("add", "a.ts"), ("add", "b.py")]
    (root / "a.ts").write_text("longer")
    (root / "b.py").unlink()
    (root / "e.go").write_text("new")
    second = run()  # the query is started again and finds what happened meanwhile
    assert second == sorted([("add", "a.ts"), ("add", "b.py"), ("change", "a.ts"), ("unlink", "b.py"), ("add", "e.go")])
    assert run() == second
    (root / "b.py").write_text("back again")
    assert run() == sorted([*second, ("add", "b.py")])
    state = {r["path"].rsplit("/", 1)[1]: r["bytes"] for r in files.latest_files(spark.read.parquet(out)).collect()}
    assert state == {"a.ts": 6, "e.go": 3, "b.py": 10}
    reader = files.FolderReader({"path": str(root), "existing": "false"})
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == [] and files.differences({"x": [1, 1]}, {"y": [2, 5_000_000]}, 9) == [("unlink", "x", 1, 9), ("add", "y", 2, 5)]


def test_lives_of_equal_moments_make_no_more_rows_than_are_told(spark):
    import random

    rng = random.Random(3)
    hashes = ["a", "b", None]
    emitted = [(rng.choice(hashes), rng.randint(-300, 900)) for _ in range(150)] + [("a", None)]
    acks = [(rng.choice(hashes), rng.randint(-300, 900), rng.choice(["ack", "ack", "ack", "applied", "suppressed", "other"])) for _ in range(150)]
    names = {"ack": live.ACKED, "applied": live.APPLIED, "suppressed": live.SUPPRESSED}
    for ttl in (100, 0):
        want = []
        for h, t in emitted:
            ended = False
            for _, at, s in sorted((a for a in acks if h and t is not None and a[0] == h and a[2] in names and t <= a[1] <= t + ttl), key=lambda a: (a[1], a[2])):
                want.append((h, t, names[s], at))
                if s != "ack":
                    ended = True
                    break
            if not ended:
                want.append((h, t, live.EXPIRED, t + ttl if t is not None else None))
        made = live.lives_batch(spark.createDataFrame(emitted, EMITTED), spark.createDataFrame(acks, ACK), ttl)
        assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
        joins = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
        assert joins and all("place" in x for x in joins)  # by hash and bucket alone, all would meet all
