"""Each operator against brute force on a small fixture with nulls, empty, long and repeated texts, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strata.llm import decontam, fingerprint, neardup, packing, quality, sharding, suffixdedup, tokencount, toxicity, urlfilter
from strata.llm.pretokens import PreTokenizer
from strata.llm.queries import URL_RULES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, words int, size double, part int, curve int"
EMPTY = "doc_id long, text string, lang string, source string"


def texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = words(200), words(70)
    out = [None, "", "   \n\t", "one", "two words", "ÀB é — 中文 😀 x<|endoftext|>y", base, base, base.upper(), base + " tail", base.replace("w1 ", "zz ", 3)]
    out += [f"{words(30)} {passage} {words(rng.randint(1, 60))}" for _ in range(6)]
    out += [words(rng.randint(1, 120)) for _ in range(20)] + [words(6000), "z " * 400, "'''ll  \n\n  1234,5 don't"]
    near = base.split()
    for k in range(8):
        w = list(near)
        for _ in range(2 + k):
            w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 7 % 53, t) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(i, t, ["en", None, "fr"][i % 3], f"src{i % 4}" if i % 9 else None, None, 1, "x", 2, 0.5, 3, 4) for i, t in rows]
    made += [made[7], (None, "a row without an id", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], EMPTY)


def all_rows(rows):
    return [*rows, rows[7], (None, "a row without an id")]


def by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_token_counts(spark, docs, rows, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 512) for i, x in all_rows(rows)]
    for head in (0, 5, 131_072):
        assert by_id(tokencount.token_counts(docs, tokenizer_path(), head=head)) == sorted(want, key=str)
    assert tokencount.token_counts(no_docs, tokenizer_path()).count() == 0


def test_pretokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    t, p = Tokenizer.from_file(tokenizer_path()), PreTokenizer(tokenizer_path())
    rng = random.Random(1)
    pool = [*"ab  '\n\t,.9é²　ж中😀", "<|endoftext|>", "'ll", "'s", "՘", "\U000105c0", "   ", "\x1c", "\x85", "\xa0"]
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert [i for x in p.encode(p.cut(s)) for i in x] == t.encode(s, add_special_tokens=False).ids


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    whole = re.split(r"[?#]", rest)[0]
    host, _, path = whole.partition("/")
    path = "/" + path if "/" in whole else ""
    host = re.split(r"[/?#]", rest)[0].encode().lower().decode()
    fits = [(len(r), r, v) for v, r in URL_RULES for rh, rp in [(r[: r.index("/")], r[r.index("/") :])] if (host == rh or host.endswith("." + rh)) and path.startswith(rp)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://a.example.com/en/1", "http://x.net/es/", "http://net/fr/a", "http://xnet/es/", "http://.net/es/", "http://x.net/de/", "a://b://c.com/", "http://com", "http://é.com/ü", "http://x.com?/en/", "http://x.net#/es/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate([*urls, urls[6]])], "page_id long, url string, host string, path string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge_urls(pages, URL_RULES).collect()}
    assert got == {i: judged(u) for i, u in enumerate([*urls, urls[6]])}
    assert urlfilter.judge_urls(pages, []).where("verdict <> 'allow' OR rule IS NOT NULL").isEmpty()
    assert urlfilter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_cascade_is_exact_with_a_poor_first_level(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.com/p/{i}") for i in range(3000)], "page_id long, url string")
    rules = [("block", f"h{i}.com/p/") for i in range(0, 3000, 7)] + [("allow", f"h{i}.com/p/") for i in range(0, 3000, 11) if i % 7]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules, default="none", rate=0.4).collect()}
    known = {r: v for v, r in rules}
    assert got == {i: (r if r in known else None, known.get(r, "none")) for i in range(3000) for r in [f"h{i}.com/p/"]}


def test_quality(spark, docs, no_docs):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "of", "green", "hills,", "and", "stone."]) + rng.choice(["", "s", "ed"]) for _ in range(80))
    made = [(i, good() if i % 4 else rng.choice([" ".join(["SALE!!"] * 40), good().replace(" ", "$$$ "), "x | y | " * 30])) for i in range(600)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in made] + [(None, 1), (5, None), (9999, 1)], "doc_id long, quality int")
    model = quality.train(d, labels)
    got = quality.quality_scores(d, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.97
    odd = quality.quality_scores(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd) and quality.quality_scores(no_docs, model).count() == 0
    assert quality.train(no_docs, labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_quality_labels_of_the_held_out_part_have_no_effect(spark):
    d = spark.createDataFrame([(i, "word " * (i % 9) + "!" * (i % 5)) for i in range(200)], "doc_id long, text string")
    a = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    b = a.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert by_id(quality.quality_scores(d, quality.train(d, a))) == by_id(quality.quality_scores(d, quality.train(d, b)))


def test_toxicity(spark, docs, no_docs):
    rng = random.Random(4)
    plain = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    made = []
    for i in range(800):
        w = plain(60)
        if i % 5 == 0:
            for _ in range(rng.randint(1, 8)):
                w.insert(rng.randrange(len(w)), rng.choice(["badword", "uglyterm", "nasty", "grimly", "vileness"]))
        made.append((i, " ".join(w)))
    d = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in made], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    assert np.all(np.diff(model.thresholds) > 0)
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, model).collect()}
    assert np.mean([got[i]["rejected"] == (i % 5 == 0) for i, _ in made]) > 0.99
    few, many = model.above(model.sums(["so badword here", "badword nasty uglyterm grimly badword vileness nasty badword"])).sum(1)
    assert few < many
    kept = {r["doc_id"] for r in toxicity.without_toxic(d, model).collect()}
    assert kept == {i for i, r in got.items() if not r["rejected"]}
    odd = toxicity.toxicity(docs, model).collect()
    assert len(odd) == docs.count() and not any(r["rejected"] for r in odd) and toxicity.toxicity(no_docs, model).count() == 0
    none = toxicity.train(d, labels.limit(0))
    assert not any(r["rejected"] for r in toxicity.toxicity(d, none).collect())


def test_hilbert_places_are_a_connected_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        places = sharding.hilbert_places(dims, bits)
        assert sorted(places) == list(range(1 << dims * bits))
        cells = sorted(range(len(places)), key=places.__getitem__)
        at = [[c >> bits * d & (1 << bits) - 1 for d in range(dims)] for c in cells]
        assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for a, b in zip(at, at[1:], strict=False))


def test_shards(spark, docs, rows, no_docs):
    got = sharding.hilbert_shards(docs, 8).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted((i, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for i, x in all_rows(rows) if i is not None)
    slots = defaultdict(list)
    size = Counter()
    for r in got:
        slots[r["shard"]].append((r["slot"], r["curve"]))
        size[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in slots.values())
    most = max(r["size"] for r in got)
    assert all(abs(size[k] - sum(size.values()) / 8) <= most for k in range(8))
    order = [(k, s, c) for k, v in slots.items() for s, c in v]
    assert [c for _, _, c in sorted(order)] == sorted(c for _, _, c in order)
    assert sharding.hilbert_shards(no_docs, 8).count() == 0


def hit_brute(x, items, window=13, ratio=20):
    w = decontam.words_of(x)
    hit, met = set(), set()
    for i, t in items:
        p = decontam.words_of(t)
        n = min(window, len(p))
        for s in range(len(p) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == p[s : s + n]:
                    hit.update(range(at, at + n))
                    met.add(str(i))
    return len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and ratio * len(hit) >= len(w)


@pytest.mark.parametrize(("block_bytes", "scan_bytes"), [(4 << 20, 256 << 20), (400, 256 << 20), (400, 60_000)])
def test_decontamination(spark, docs, rows, no_docs, block_bytes, scan_bytes):
    limits = {"block_bytes": block_bytes, "scan_bytes": scan_bytes}
    all_texts = [t for _, t in rows]
    items = [(10, " ".join(all_texts[6].split()[20:60]).upper()), (9, " ".join(all_texts[12].split()[35:48])), (2, "two, WORDS"), (3, "é"), (4, ""), (5, None), (6, "nothing of this occurs"), (9, " ".join(all_texts[12].split()[35:48])), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, **limits)
    want = {i: hit_brute(x, [p for p in items if p[0] is not None]) for i, x in all_rows(rows)}
    assert got.count() == docs.count()
    assert {r[0]: tuple(r)[1:6] for r in got.collect()} == want
    kept = {r["doc_id"] for r in decontam.clean(docs, bench, **limits).collect()}
    assert kept == {i for i, w in want.items() if not w[4]} and decontam.clean(docs, bench, **limits).columns == docs.columns
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").isEmpty() and decontam.contamination(no_docs, bench).count() == 0


@pytest.mark.parametrize("scan_bytes", [256 << 20, 60_000])
def test_decontamination_adds_up_the_hits_of_all_blocks(spark, scan_bytes):
    rng = random.Random(8)
    item_words = [[f"i{k}w{j}" for j in range(30)] for k in range(24)]
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    # each passage is 13 words of 500: under 1 in 20 alone, over it with those of the other items
    spread = sum((item_words[k][5:18] + filler(487 // 4) for k in (0, 7, 15, 23)), [])
    alone = item_words[3][5:18] + filler(487)
    made = [(1, " ".join(spread)), (1, "the same key, but clean"), (2, " ".join(alone)), (None, " ".join(spread)), (3, " ".join(filler(50)))]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    items = [(k, " ".join(w)) for k, w in enumerate(item_words)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    scans = decontam.benchmark_scans(bench, "item_id", "text", 13, 400, scan_bytes)
    assert sum(map(len, scans)) >= 3 and (len(scans) > 2) == (scan_bytes < 1 << 20)
    got = [tuple(r)[:6] for r in decontam.contamination(docs, bench, block_bytes=400, scan_bytes=scan_bytes).collect()]
    assert sorted(got, key=str) == sorted(((i, *hit_brute(x, items)) for i, x in made), key=str)
    kept = decontam.clean(docs, bench, block_bytes=400, scan_bytes=scan_bytes).collect()
    assert sorted(map(tuple, kept)) == sorted([made[1], made[2], made[4]])


def near_brute(rows, percent=75):
    def shingles(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").encode().lower().decode())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(x) for i, x in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, docs, rows, no_docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    twin = spark.createDataFrame([(None, rows[6][1]), (None, rows[6][1])], "doc_id long, text string")  # a keyed row has this text
    docs = docs.unionByName(twin, allowMissingColumns=True)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count() and all(r["component_id"] is None and r["kept"] for r in got if r[0] is None)
    assert {r[0]: tuple(r)[1:] for r in got if r[0] is not None} == near_brute(rows)
    assert next(r for r in got if r[0] is None)["kept"]
    assert neardup.near_duplicates(no_docs).count() == 0


def test_near_duplicate_chains_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    w = [f"v{rng.randint(0, 999)}" for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(w)
        for _ in range(3 if i % 7 else 30):
            w[rng.randrange(150)] = f"n{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 5)
    got = {r[0]: tuple(r)[1:] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_brute(rows)


def test_fingerprints(spark, docs, rows, no_docs):
    of_text = lambda x: np.uint64(xxhash.xxh64_intdigest((x or "").encode(), 42)).astype(np.int64)
    ordered = sorted(((i, x) for i, x in all_rows(rows)), key=lambda r: (r[0] is None, -(r[0] or 0), of_text(r[1]), r[1] or ""))
    want = []
    for k, (i, x) in enumerate(ordered):
        x, y = x or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(x) // 3
        e = x[: len(x) - n] + y[:n]
        a, b, c = map(fingerprint.digest, (x, e, y))
        want.append((i, len(x), hashlib.sha256(e.encode()).hexdigest(), a, b, fingerprint.compare(a, b), fingerprint.compare(a, c)))
    for n, size in ((1, 1 << 27), (2, 1 << 27), (7, 1 << 27), (3, 500), (2, 4000)):
        assert by_id(fingerprint.edit_likeness(docs, partitions=n, run_bytes=size)) == sorted(want, key=str)
    assert fingerprint.edit_likeness(no_docs).count() == 0
    one = docs.where("doc_id = 0").limit(1)
    assert fingerprint.edit_likeness(one).count() == 1
    plain = fingerprint.fingerprints(docs).collect()
    assert len(plain) == docs.count() and all(len(r["fingerprint"]) == 132 for r in plain)


def test_a_key_of_many_rows_is_parted(spark):
    made = [(i if i % 3 else 40, f"text {i} of this key " * 3) for i in range(120)] + [(None, f"no key {i} " * 4) for i in range(60)] + [(7, "the same")] * 5
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    whole = by_id(fingerprint.edit_likeness(docs, partitions=1))
    assert len(whole) == len(made)
    for n, size in ((2, 200), (5, 900), (3, 3000)):
        assert by_id(fingerprint.edit_likeness(docs, partitions=n, run_bytes=size)) == whole


def test_bucket_counts_do_not_depend_on_chunks(monkeypatch):
    data = bytes(random.Random(1).randrange(256) for _ in range(1000))
    whole = fingerprint.bucket_counts(data)
    for c in (1, 2, 3, 7, 64, 999, 1000):
        monkeypatch.setattr(fingerprint, "CHUNK", c)
        assert (fingerprint.bucket_counts(data) == whole).all()
    assert whole.sum() == 998 + 996


def passages_brute(rows, across, n=50):
    windows = defaultdict(set)
    for i, x in rows:
        w = tuple(suffixdedup.WORD.findall(x or ""))
        for s in range(len(w) - n + 1) if i is not None else ():
            windows[w[s : s + n]].add((i, s))
    first, other = defaultdict(set), defaultdict(set)
    for places in windows.values():
        if len({i for i, _ in places} if across else places) > 1:
            for i, s in places:
                (first if (i, s) == min(places) else other)[i].update(range(s, s + n))
    return {i: (first[i], other[i] - first[i]) for i in {*first, *other}}


@pytest.mark.parametrize(("hot", "across"), [(2048, True), (2048, False), (2, True), (2, False)])
def test_repeated_passages(spark, docs, rows, no_docs, monkeypatch, hot, across):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    got = {}
    for r in suffixdedup.repeated_passages(docs, across=across).collect():
        got.setdefault(r["doc_id"], (set(), set()))[0 if r["first"] else 1].update(range(r["start_word"], r["end_word"]))
    want = passages_brute(rows, across)
    assert got == want and len(want) > 10 and len(passages_brute(rows, False)) > len(passages_brute(rows, True))
    cut = {r["doc_id"]: r["text"] for r in suffixdedup.cut_passages(docs, across=across).collect()}
    for i, x in rows:
        words = suffixdedup.WORD.findall(x or "")
        assert suffixdedup.WORD.findall(cut[i] or "") == [w for k, w in enumerate(words) if k not in want.get(i, ((), ()))[1]]
    assert cut[None] == "a row without an id" and suffixdedup.cut_passages(no_docs).count() == 0 and suffixdedup.cut_passages(docs).columns == docs.columns


def test_packing(spark, docs, rows, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), size=64).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        windows[r["sequence_id"]].append(r)
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in all_rows(rows))
    assert {k for k in want} == set(pieces)
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        copies = want[i, len(ids)]
        mine = sorted(pieces[i, len(ids)], key=lambda r: r["start"])
        covered = Counter(p for r in mine for p in range(r["start"], r["start"] + r["length"]))
        assert covered == Counter({p: copies for p in range(len(ids))})
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in w] == list(np.cumsum([0, *(r["length"] for r in w)])[:-1]) and sum(r["length"] for r in w) <= 64
    fills = [sum(r["length"] for r in w) for w in windows.values()]
    assert all(n & n - 1 == 0 for n in fills)  # 64 or another power of two: nothing is padded
    assert sum(n < 64 for n in fills) <= 3 * 6 and packing.pack(no_docs, tokenizer_path()).count() == 0


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    t, made = Tokenizer.from_file(tokenizer_path()), PreTokenizer(tokenizer_path())
    assert made.fast is not None
    hard = [" " * 300_000, " " * 300_000 + "x", "a" * 50_000, "\U0001fae8\ue000 unassigned \u0378", "x\x85y\x1c\x1f \u2028\u3000z", "<|endoftext|><|endoftext|> <|endoftext|", "'s 'S ' ll'll", "\r\n \t\n x", "e\u0301\u200d\ufeff"]
    for x in [*hard, *(x or "" for x in texts())]:
        want = t.encode(x, add_special_tokens=False).ids
        assert made.ids(x).tolist() == want
        assert [i for ids in made.encode(made.cut(x)) for i in ids] == want


def test_packer_takes_the_level_of_least_squares():
    p = packing.Packer(10, 1000)
    for k, n in enumerate((6, 6, 3, 4)):
        p.add((k, 0, np.zeros(n, "<u4"), n))
    assert len(p.done) == 1 and [len(x[2]) for x in p.done[0]] == [6, 4]
    q = packing.Packer(10, 4)
    for k in range(100):
        q.add((k, 0, np.zeros(7, "<u4"), 7))
        assert q.n_open <= 5
    rest = q.rest()  # this may fill windows
    assert sum(sum(len(x[2]) for x in w) for w in [*q.done, *rest]) == 700
