"""Operators that SQL can't express, against a second, plain implementation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from strata.llm import decontam, fingerprint, neardup, packing, quality, sharding, suffixdedup, tokencount, toxicity, urlfilter
from strata.llm.pretokens import PreTokenizer
from strata.llm.queries import URL_RULES, tokenizer_path


def words(rng, n, pool=300):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def test_quality_scores_are_sums_of_table_entries(spark):
    rng = random.Random(4)
    made = [(i, words(rng, rng.randint(1, 90)) if i % 3 else " ".join(["BUY!!"] * rng.randint(5, 60))) for i in range(200)] + [(900, None), (901, ""), (902, words(rng, 30_000))]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.pairs and any(t.any() for t in model.tables) and any(t.any() for _, _, t in model.pairs)

    def score(x):
        values, bins, total = quality.features(x), [], model.bias
        for value, edges, table in zip(values, model.edges, model.tables, strict=True):
            b = sum(1 for e in edges if e <= value)
            bins.append(b)
            total += table[b]
        for i, j, table in model.pairs:
            total += table[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]]
        return 1 / (1 + math.exp(-total))

    got = {r["doc_id"]: r for r in quality.quality_scores(docs, model).collect()}
    for i, x in made:
        assert got[i]["score"] == pytest.approx(score(x), abs=1e-12)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[900]["score"] == got[901]["score"]


def test_a_tree_takes_the_best_cuts():
    rng = np.random.default_rng(2)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        best = max(range(1, 9), key=lambda k: g[:k].sum() ** 2 / (h[:k].sum() + 2) + g[k:].sum() ** 2 / (h[k:].sum() + 2))
        gain, at = quality.best_cut(g, h, 2.0)
        assert at == best and gain == pytest.approx(g[:at].sum() ** 2 / (h[:at].sum() + 2) + g[at:].sum() ** 2 / (h[at:].sum() + 2) - g.sum() ** 2 / (h.sum() + 2))
        tree = quality.shallow_tree(g, h, 2.0)
        for v in set(tree):
            part = tree == v
            assert v == pytest.approx(g[part].sum() / (h[part].sum() + 2))


def test_toxicity_scores_are_expected_grades(spark):
    rng = random.Random(5)
    made = [(i, words(rng, 60) + (" grotty vilest" * (1 + i % 4) if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, "")]
    made += [(902, "grotty " * 50_000), (903, words(rng, 20_000))]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()

    def above(x):
        total = 0.0
        counts = Counter()
        for w in toxicity.words_of(x):
            counts.update({w, *(w[:n] + ":" for n in (4, 5) if len(w) > n)})
        for f, n in counts.items():
            total += model.weights.get(f, 0.0) * math.log2(1 + n)
        return [1 / (1 + math.exp(t - total)) for t in model.thresholds]

    for r in toxicity.toxicity(docs, model).collect():
        p = above(dict(made)[r["doc_id"]])
        chances = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
        assert r["severity"] == pytest.approx(sum(k * c for k, c in enumerate(chances))) and r["p_toxic"] == pytest.approx(p[0])
        assert chances[r["grade"]] == pytest.approx(max(chances)) and r["rejected"] == (p[0] >= 0.5)


def test_ordinal_fit_is_at_its_greatest_likelihood():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 4)) < 0.4) * rng.integers(1, 4, (300, 4)).astype(float)
    y = np.clip((x @ [1.0, 0.5, -1.0, 0.0] + rng.normal(size=300)).astype(int), 0, 3)
    n = rng.integers(1, 4, 300).astype(float)
    w, t = toxicity.fit(x, y, n, steps=6000, rate=0.02)

    def loss(w, t):
        p = 1 / (1 + np.exp(t[None] - (x @ w)[:, None]))
        full = np.concatenate([np.ones((300, 1)), p, np.zeros((300, 1))], 1)
        return float((n * np.log(full[np.arange(300), y] - full[np.arange(300), y + 1])).sum() - 0.125 * (w * w).sum())

    best = loss(w, t)
    for k in range(4):  # by differences: flat at the optimum, and lower on either side
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, t) < best
    for k in range(3):
        for step in (-0.02, 0.02):
            moved = t.copy()
            moved[k] += step
            assert loss(w, moved) < best


def shards_brute(rows, curve, shards=8, slack=0.01):
    """(key, crc32, size) to shards and slots, from each row's place on the curve."""
    full = []
    for (i, x), c in zip(rows, curve, strict=True):
        data = (x or "").encode()
        full.append([c, int(np.uint64(xxhash.xxh64_intdigest(data, 42)).astype(np.int64)), zlib.crc32(data), len(data) + 1, i])
    full.sort(key=lambda r: (*r[:4], r[4] is not None, r[4] or 0))
    total = sum(r[3] for r in full)
    whole = max(max(r[3] for r in full), int(slack * total / shards))
    out, at, slots = Counter(), 0, Counter()
    first = {}
    size = Counter()
    for r in full:
        first.setdefault(tuple(r[:4]), at)
        size[tuple(r[:4])] += r[3]
        at += r[3]
    at = 0
    for r in full:
        group = tuple(r[:4])
        middle = 2 * first[group] + size[group] if r[3] < size[group] <= whole else 2 * at + r[3]
        shard = min(shards - 1, middle * shards // (2 * total))
        out[r[4], r[2], r[3], shard, slots[shard]] += 1
        slots[shard] += 1
        at += r[3]
    return out


@pytest.mark.parametrize("copies", [3, 40])
def test_shards_are_cut_from_the_sorted_rows(spark, copies):
    rng = random.Random(7)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(150)]
    texts += [t for t in texts[:6] for _ in range(copies)] + [None, None, "", words(rng, 4000)]
    rows = [(k if k % 17 else None, t) for k, t in enumerate(texts)]
    meta = [(["a", "commonprefix_01", "commonprefix_02", "commonprefix_10", None][k % 5], k % 3, k % 7) for k in range(len(rows))]
    docs = spark.createDataFrame([(*r, *m) for r, m in zip(rows, meta, strict=True)], "doc_id long, text string, source string, lang int, size int").repartition(3)
    got = sharding.hilbert_shards(docs, 8).collect()
    place = {}
    for r in got:
        place.setdefault((r["doc_id"], r["text_crc32"]), r["curve"])
    curve = [place[i, zlib.crc32((x or "").encode())] for i, x in rows]
    assert Counter((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in got) == shards_brute(rows, curve)
    shards_of = {}
    for r in got:
        shards_of.setdefault(r["text_crc32"], set()).add(r["shard"])
    if copies == 3:
        assert max(map(len, shards_of.values())) == 1  # small groups stay whole
    # a column that is called like the size of a text changes nothing
    other = sharding.hilbert_shards(docs.drop("size"), 8).collect()
    assert Counter(map(tuple, other)) == Counter(map(tuple, got))


def test_bins_compare_whole_strings(spark):
    rng = random.Random(1)
    made = [f"https://one.prefix/{rng.choice('abcdefghij')}{rng.randrange(3)}" for _ in range(800)] + ["https://one.prefix/zzz"] * 500 + [None] * 20
    rng.shuffle(made)
    slim = spark.createDataFrame([(x,) for x in made], "d string").repartition(5)
    cuts = sharding.string_cuts(slim, ["d"], 16, 4)["d"]
    known = sorted(x for x in made if x)
    want = []
    for b in range(15):
        upto = [v for v in sorted(set(known)) if min(15, (2 * known.index(v) + known.count(v)) * 16 // (2 * len(known))) <= b]
        want.append(upto[-1] if upto else None)
    assert cuts == want and len(set(cuts)) > 8


def digest_brute(text):
    """The digest once more, from dicts of triplets."""
    data = (text or "").encode()
    order, state = list(range(256)), 7
    for i in range(255, 0, -1):
        state = (state * 1103515245 + 12345) % 2**31
        j = (state >> 8) % (i + 1)
        order[i], order[j] = order[j], order[i]
    mix = order.__getitem__
    often = dict.fromkeys(range(256), 0)
    for at in range(len(data) - 2):
        often[mix(mix(mix(data[at]) ^ data[at + 1]) ^ data[at + 2])] += 1
        if at + 4 < len(data):
            often[mix(mix(mix(data[at]) ^ data[at + 1]) ^ data[at + 4] ^ 0x5A)] += 1
    ranked = sorted(often.values())
    limits = [ranked[63], ranked[127], ranked[191]]
    codes = [sum(often[b] > q for q in limits) for b in range(256)]
    packed = [64 * a + 16 * b + 4 * c + d for a, b, c, d in zip(*[iter(codes)] * 4, strict=True)]
    return bytes([hashlib.sha256(data).digest()[0], min(255, round(12 * math.log(len(data) + 1))), *packed]).hex()


def likeness_brute(a, b):
    if a == b:
        return 1.0
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    code = lambda v, k: v[2 + k // 4] >> 6 - 2 * (k % 4) & 3
    apart = [abs(code(x, k) - code(y, k)) for k in range(256)]
    length = min(60, 2 * max(0, abs(x[1] - y[1]) - 1))
    return 1 - min(1596, 1 + sum(6 if d == 3 else d for d in apart) + length) / 1596


def test_digests_and_likeness(spark):
    rng = random.Random(9)
    texts = [None, "", "ab", "abc", "abcd", "ÀÉ 中文 😀", words(rng, 200), words(rng, 30_000), "a" * 100_000]
    texts += [texts[6].replace("w1", "zz"), texts[6] + " end"]
    for x in texts:
        assert fingerprint.digest(x) == digest_brute(x)
    for a in texts:
        for b in texts:
            assert fingerprint.compare(fingerprint.digest(a), fingerprint.digest(b)) == pytest.approx(likeness_brute(digest_brute(a), digest_brute(b)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprint.edit_likeness(docs).collect()}
    for i, x in enumerate(texts):
        x, y = x or "", texts[i - 1] or ""
        e = x[: len(x) - len(x) // 3] + y[: len(x) // 3]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(x), hashlib.sha256(e.encode()).hexdigest(), digest_brute(x), digest_brute(e))
        assert r["near_edited"] == pytest.approx(likeness_brute(digest_brute(x), digest_brute(e))) and r["near_next"] == pytest.approx(likeness_brute(digest_brute(x), digest_brute(y)))


def test_whole_sets_lose_no_link(spark):
    rng = random.Random(12)
    base = [words(rng, 40, 10**6).split() for _ in range(30)]
    made = []
    for w in base:
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
            made.append((len(made), " ".join(v)))
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    one, all_values = (sorted(map(tuple, neardup.near_duplicates(docs, k=k).collect())) for k in (64, None))
    assert one == all_values and sum(not r[3] for r in one) > 20


@pytest.mark.parametrize("limit", ["rows", "bytes"])
def test_a_template_of_many_rows_is_cut_again(spark, monkeypatch, limit):
    """Rows that share most of a sketch with all others, but are similar to few."""
    if limit == "rows":
        monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    else:
        monkeypatch.setattr(neardup, "BLOCK_BYTES", 8 * 100 * 8)
    rng = random.Random(13)
    template = words(rng, 60, 10**6)
    made = [(i, f"{template} {words(rng, 40, 10**6)}") for i in range(120)]  # alike by 0.43
    made += [(200 + i, f"{made[i][1]} more") for i in range(0, 120, 10)]
    made += [(400 + i, f"{template} {words(rng, 3, 10**6)}") for i in range(40)]  # alike by 0.8
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)

    def shingles(x):
        w = x.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(x) for i, x in made}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if least[j] < least[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    least[i], changed = least[j], True
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == least and len(set(least.values())) == 121


def test_blocks_of_the_second_pass_have_bounded_bytes(spark):
    """600 rows of 1.6 MB: rows alone would make two blocks of them."""
    rows = spark.createDataFrame([(1, i % 3 == 0, 1_600_000) for i in range(600)] + [(2, i == 0, 100) for i in range(600)] + [(3, False, 9)], "g long, outer boolean, bytes long")
    got = {r["g"]: (r["nb"], r["no"]) for r in neardup.block_counts(rows).collect()}
    assert got == {1: (-(-600 * 1_600_000 // neardup.BLOCK_BYTES), -(-200 * 1_600_000 // neardup.BLOCK_BYTES)), 2: (2, 1)}


def test_the_estimate_is_the_share_of_the_unions_sketch():
    rng = np.random.default_rng(5)
    for _ in range(300):
        k = int(rng.integers(1, 40))
        a, b = (np.unique(rng.integers(0, 90, rng.integers(1, 80)).astype(np.uint64)) for _ in range(2))
        least = np.union1d(a, b)[:k]
        want = 100 * np.isin(least, np.intersect1d(a, b)).sum() / len(least)
        assert neardup.estimate(a[:k], b[:k], k) == pytest.approx(want)


def test_pairs_far_below_the_threshold_are_dropped_by_their_estimate(monkeypatch):
    """Two sets whose smallest values are alike, as a plain count of common values would have it, but no others."""
    checked = []
    monkeypatch.setattr(neardup.np, "searchsorted", lambda *x, f=np.searchsorted: checked.append(1) or f(*x))
    common = np.arange(1000, 1032, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, np.arange(s, s + 900 * 7, 7, dtype=np.uint64) + 5000 * s])) for s in (1, 2)]
    sets = [np.unique(np.concatenate([np.arange(10 * s, 10 * s + 32, dtype=np.uint64), x])) for s, x in zip((1, 5), sets, strict=True)]
    before = len(checked)
    assert neardup.verified(sets, [0, 1], np.array([True, True]), 64, 75) == []
    assert len(checked) - before <= 1  # the one that cuts values into portions


@pytest.fixture(scope="module")
def long_text():
    return words(random.Random(20), 300_000, 10**7)


def test_very_long_texts(spark, long_text):
    """Some megabytes in one row: nothing is cut, and what stands at the end is found."""
    rng = random.Random(21)
    end = words(rng, 60, 10**7)
    rows = [(1, f"{long_text} {end}"), (2, words(rng, 200)), (3, f"{words(rng, 30)} {end}"), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    whole = rows[0][1]
    made = PreTokenizer(tokenizer_path())
    n = len(made.tokenizer.encode(whole, add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs, tokenizer_path()).collect()}[1] == n
    packed = packing.pack(docs, tokenizer_path()).where("doc_id = 1").collect()
    assert sum(r["length"] for r in packed) == n + 1 == packed[0]["doc_tokens"]
    bench = spark.createDataFrame([(5, end)], "item_id long, text string")
    assert {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in decontam.contamination(docs, bench).where("n_hit > 0").collect()} == {1: (60, False), 3: (60, True)}
    found = suffixdedup.repeated_passages(docs).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["first"]) for r in found) == [(1, 300_000, 300_060, True), (3, 30, 90, False)]
    near = {r["doc_id"]: r["n_shingles"] for r in neardup.near_duplicates(docs).collect()}
    assert near[1] == len(neardup.shingle_set(whole)) > 300_000 and near[4] == 0
    assert {r["doc_id"]: r["n_chars"] for r in fingerprint.edit_likeness(docs).collect()}[1] == len(whole)
    assert {r["doc_id"]: r["size"] for r in sharding.hilbert_shards(docs.selectExpr("*", "'s' AS source", "'en' AS lang")).collect()}[1] == len(whole) + 1
    assert len(quality.quality_scores(docs, quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).collect()) == len(rows)
    urls = spark.createDataFrame([(None, "http://x.com/" + "a/" * 1_000_000), (1, "http://" + "a." * 2000 + "net/es/")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(urls, URL_RULES).collect()} == {None: ("com/", "allow"), 1: ("net/es/", "block")}


@pytest.mark.parametrize("across", [True, False])
def test_groups_are_compared_alike_in_any_portions(monkeypatch, across):
    """Suffixes of one start against a dict of their windows, however many extensions are compared at once."""
    rng = random.Random(30)
    length = 50
    start = [rng.getrandbits(64) for _ in range(16)]
    sides = [[rng.getrandbits(64) for _ in range(60)] for _ in range(4)]
    rows, windows = [], {}
    for key in range(25):
        for place in (rng.randint(40, 60), rng.randint(140, 160)):  # a window belongs to one of them
            low, high = place - rng.randint(0, 34), place
            low = max(low, 0)
            high = rng.randint(low, place)
            before = [rng.choice(sides)[-1 - k] if rng.random() < 0.01 else sides[key % 3][-1 - k] for k in range(place - low)][::-1]
            after = [rng.choice(sides)[k] if rng.random() < 0.005 else sides[key % 2][k] for k in range(high + length - place - 16)]
            words = (before + start + after)[: high + length - low]
            rows.append((key, place, low, high, np.array(words, np.uint64).tobytes()))
            for w in range(low, high + 1):
                windows.setdefault((place - w, *words[w - low : w - low + length]), set()).add((key, w))
    want = {}
    for places in windows.values():
        if len({k for k, _ in places} if across else places) > 1:
            for p in places:
                want[p] = min(places)
    for at_once in (1, 40, 1 << 16):
        monkeypatch.setattr(suffixdedup, "AT_ONCE", at_once)
        got = {}
        for key, low, high, first_key, first_low in suffixdedup.repeated_in(rows, length, across):
            got |= {(key, w): (first_key, first_low + w - low) for w in range(low, high + 1)}
        assert got == want and len(want) > 100


def test_lists_meet_their_rows_by_merging_whatever_their_size(spark):
    from pyspark.sql import functions as F

    from strata.llm.neardup import listed_groups

    rows = spark.range(40).select(F.lit(0).cast("long").alias("g"), F.col("id").alias("key"), F.lit(3).alias("n"), F.array(F.col("id") % 4, F.col("id") % 5 + 10, F.lit(99).cast("long")).alias("values"))
    made = listed_groups(rows, F.ceil(F.col("n") * 0.5).cast("int"))
    found = {frozenset(r["keys"]) for r in made.groupBy("g").agg(F.collect_set("key").alias("keys")).collect()}
    assert len(found) > 1 and made.count() <= 40 * 2  # a row meets one list for each of its two places
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def rows_of_joins(spark, since: int) -> tuple[int, int]:
    """What joins on (g, v) made in the queries after number ``since``, and the last one's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsList()
    ids = [seen.apply(i).executionId() for i in range(seen.size())]
    made = 0
    for e in (e for e in ids if e > since):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.search(r"Join \[g#\d+L?, v#", node.desc()):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return made, max(ids)


def test_values_of_a_template_travel_to_the_rows(spark, monkeypatch):
    """120 rows of 40 common and 20 own values: whatever is sent, the groups are those of a join of all values, and what is sent isn't joined."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    template = rng.integers(-(2**62), 2**62, 40)
    sets = [np.unique(np.concatenate([template[rng.random(40) < 0.9], rng.integers(0, 60, 8), rng.integers(-(2**62), 2**62, 12)])) for _ in range(120)]
    made = [(1 + i % 2, i, i % 3 == 0, s.tobytes(), s.nbytes) for i, s in enumerate(sets)]
    rows = spark.createDataFrame(made, "g long, key long, outer boolean, set binary, bytes long")
    many, whole = rows.select("g", "key", "outer"), rows.select("key", "set", "bytes")
    values = spark.createDataFrame([(g, k, len(s), s.tolist()) for (g, k, *_), s in zip(made, sets, strict=True)], "g long, key long, n int, values array<long>")
    want = neardup.listed_groups(values, F.ceil(F.col("n") * 75 / 100).cast("int"))
    with_outer = want.join(many.where("outer").select("key"), "key").select("g").distinct()
    want = {tuple(r) for r in want.join(with_outer, "g", "left_semi").collect()}
    joined = {}
    for sent in (131_072, 70, 7, 0):
        monkeypatch.setattr(neardup, "SENT_VALUES", sent, raising=False)
        _, since = rows_of_joins(spark, 1 << 60)
        got = neardup.narrowed(many, whole, 75)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 120, sent
        joined[sent], _ = rows_of_joins(spark, since)
    all_values = sum(len(s) for s in sets)
    assert joined[131_072] < joined[7] < joined[0] and joined[131_072] < all_values / 2, joined
