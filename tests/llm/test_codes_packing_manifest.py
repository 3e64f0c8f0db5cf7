"""Vector codes, packing by exchanges and the Merkle manifest, against plain implementations."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import merkle, swappacking, vectorcodes
from strata.llm.queries import op13, tokenizer_path
from strata.llm.wordpieces import WordPieces

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def codes_brute(rows, dim, parts=8, entries=16, rounds=6, scale=4096):
    """(key, label, vector) to (key, code, error, label_error, sha256), in Python's own numbers."""
    kept = [(k, y, [math.floor(float(x) * scale) if abs(x) < 2**40 else int(x) * scale for x in v]) for k, y, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if len(r[2]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    cuts = [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]
    books = [[r[2][a:b] for r in first] for a, b in cuts]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            got = defaultdict(list)
            for _, _, v in kept:
                if len(v) == dim:
                    got[nearest(v[a:b], books[p])[1]].append(v[a:b])
            books[p] = [[sum(c) // len(got[e]) for c in zip(*got[e], strict=True)] if got[e] else old for e, old in enumerate(books[p])]
    sha = H(",".join(str(x) for book in books for entry in book for x in entry))
    out, sums = [], defaultdict(lambda: None)
    for k, y, v in kept:
        code = error = None
        if len(v) == dim:
            found = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
            code, error = "".join(f"{e:02x}" for _, e in found), min(2**63 - 1, sum(d for d, _ in found))
            sums[y] = (sums[y] or 0) + error
        out.append((k, y, code, error))
    return [(k, code, error, sums[y] if sums[y] is None else min(sums[y], 2**63 - 1), sha) for k, y, code, error in out]


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(30)]
    return [(i, i % 5 if i % 7 else None, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(n)]


ODD_VECTORS = [(900, 1, None), (901, 1, [float("nan")] + [0.0] * 15), (902, None, [None] + [0.0] * 15), (903, 2, [float("-inf")] * 16), (904, 9, [0.1] * 3), (905, 9, [])]


@pytest.mark.parametrize("case", ["usual", "few", "huge", "uneven"])
def test_vector_codes(spark, monkeypatch, case):
    dim = {"uneven": 13}.get(case, 16)
    rows = vectors(9 if case == "few" else 300, dim)
    if case == "few":
        monkeypatch.setattr(vectorcodes, "FREQUENT", 2)
    if case == "usual":  # equal keys, equal vectors, a null key, odd vectors, labels met by a shuffle
        rows += [rows[3], (None, 3, rows[5][2]), (77, 4, rows[6][2]), *ODD_VECTORS]
        monkeypatch.setattr(vectorcodes, "FREQUENT", 3)
    if case == "huge":
        rows += [(1000, 1, [3e38, -3e38] * 8), (1001, 1, [1e300] * 16), (-1, 0, [2.0**30 + 0.3] * 16)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, label int, embedding array<double>, code string, error double").repartition(3)
    got = sorted(map(tuple, vectorcodes.codes(df).collect()), key=str)
    assert got == sorted(codes_brute(rows, dim), key=str)


def test_vector_codes_of_nothing(spark):
    kind = "vec_id long, label string, embedding array<float>"
    for rows in ([], [(1, None, None)], [(1, "a", [float("nan")])]):
        assert vectorcodes.codes(spark.createDataFrame(rows, kind)).collect() == []
    one = vectorcodes.codes(spark.createDataFrame([(1, "a", [])], kind)).collect()
    assert [r["vec_id"] for r in one] == [1]


def test_partial_distances_skip_and_are_exact():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))
    book = np.concatenate([centres[:14], centres[:2]])  # two entries twice: ties go to the lower
    index, best, compared = vectorcodes.nearest(x, book)
    full = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (best == full.min(1)).all() and index.max() < 14
    assert compared < 0.55 * x.size * len(book)
    wide, far, _ = vectorcodes.nearest(x.astype(object), book)
    assert (wide == index).all() and (far == best).all()


def test_recall_and_error_fall_with_rounds(spark):
    df = spark.createDataFrame(vectors(400, 16), "vec_id long, label int, embedding array<double>")
    total = [vectorcodes.codes(df, rounds=r).agg(F.sum("error")).first()[0] for r in (0, 1, 6)]
    assert total[2] < total[1] < total[0]


@pytest.fixture(scope="module")
def words():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_are_the_tokenizers(words):
    made, rng = WordPieces(words), random.Random(4)
    pool = [*map(chr, range(256)), "<|endoftext|>", "<|startoftext|>", "'ll", "'S", "the ", " of", "İ", "Σ", "é", "ﬁ", "中", " "]
    cases = ["".join(rng.choice(pool if k % 3 else pool[:256]) for _ in range(rng.randint(0, 50))) for k in range(4000)]
    cases += ["x" * 70_000, "ab " * 500_000, " " * 1_200_000 + "q", "\xa0".join(["é" * 3] * 300_000), "<|endoftext|" * 3]
    for x in cases:
        assert np.array_equal(made.ids(x), made.tokenizer.encode(x, add_special_tokens=False).ids), x[:60]


def odd_documents(n):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    made = [(i, text(int(math.exp(rng.gauss(4, 1.4))))) for i in range(n)] + [(9000, None), (9001, ""), (None, "no id"), (None, "no id"), (9002, text(9000)), (9003, "Ünïcode 中文 <|endoftext|>")]
    return made + [made[3]] * 5


@pytest.mark.parametrize("group", [1 << 16, 40])
def test_whole_packing_keeps_every_id(spark, words, group):
    rows = odd_documents(250)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, piece int, offset long").repartition(3)
    got = swappacking.pack_whole(df, words, size=512, group=group).collect()
    made = WordPieces(words)
    want = Counter()
    for k, x in rows:
        ids = np.array([*made.tokenizer.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 512)):
            part = ids[start : start + 512]
            want[k, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(n * c for (_, _, _, n, _), c in want.items())
    assert len(by) <= -(-total // 512) + (1 if group > 100 else 8)


def test_packing_nothing(spark, words):
    assert swappacking.pack_whole(spark.createDataFrame([], "doc_id long, text string"), words).collect() == []


def lengths_of(kind, n, rng):
    if kind == "log":
        return np.minimum(4095, np.exp(rng.normal(6, 1.2, n)).astype(int) + 1)
    return {"flat": rng.integers(1, 4096, n), "half": rng.integers(1500, 2100, n), "few": rng.choice([1000, 1300, 1700], n), "same": np.full(n, 1000), "tiny": rng.integers(1, 30, n)}[kind]


@pytest.mark.parametrize("kind", ["log", "flat", "half", "few", "same", "tiny"])
def test_no_exchange_is_left(kind):
    lengths = lengths_of(kind, 300, np.random.default_rng(7))
    start = swappacking.best_fit(lengths, 4096)
    search = swappacking.Search(lengths, [list(b) for b in start], 4096)
    bins = search.run()
    assert sorted(i for b in bins for i in b) == list(range(300))
    fills = [int(lengths[b].sum()) for b in bins]
    assert max(fills) <= 4096 and len(bins) <= len(start) and sum(f * f for f in fills) >= sum(int(lengths[b].sum()) ** 2 for b in start)
    assert (sum(f * f for f in fills) > sum(int(lengths[b].sum()) ** 2 for b in start)) == (search.exchanges > 0)

    def sums(b, most):
        return {sum(c) for k in range(most + 1) for c in itertools.combinations(sorted(int(lengths[i]) for i in b), k)}

    if kind == "tiny":
        return
    for k, (b, f) in enumerate(zip(bins, fills, strict=True)):
        for j, (other, g) in enumerate(zip(bins, fills, strict=True)):
            if j != k and g <= f < 4096:
                for give, get in ((1, 1), (2, 1), (1, 2)):
                    assert not any(0 < y - x <= 4096 - f for x in sums(b, give) for y in sums(other, get) if not (x and len(b) < give and y == 0))


def test_exchanges_empty_bins():
    """There are lengths for which best fit in falling order needs a bin more than exchanges leave."""
    cases = 0
    rng = np.random.default_rng(3)
    for _ in range(400):
        lengths = rng.integers(5, 60, 14)
        start = swappacking.best_fit(lengths, 100)
        if len(swappacking.Search(lengths, [list(b) for b in start], 100).run()) < len(start):
            cases += 1
    assert cases >= 1


def test_best_fit_takes_the_fullest():
    rng = np.random.default_rng(8)
    for _ in range(50):
        lengths = rng.integers(1, 101, 60)
        bins = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [b for b in bins if sum(b) + n <= 100]
            (max(fits, key=sum) if fits else bins.append([]) or bins[-1]).append(n)
        got = swappacking.best_fit(lengths, 100)
        assert sorted(sum(b) for b in bins) == sorted(int(lengths[b].sum()) for b in got)


def manifest_brute(rows, fan=8):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(at):
        steps, where = [[] for _ in at], list(range(len(at)))
        while len(at) > 1:
            runs = [at[i : i + fan] for i in range(0, len(at), fan)]
            for i, w in enumerate(where):
                steps[i].append((w % fan, runs[w // fan]))
                where[i] = w // fan
            at = [H(*r) for r in runs]
        return at[0], steps

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r, H(*map(field, r))))
    groups = []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(by[lang], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        groups.append((leaves, *tree([leaf for _, leaf in leaves])))
    root, above = tree([g[1] for g in groups])
    out = []
    for (leaves, top, steps), upper in zip(groups, above, strict=True):
        for (r, leaf), own in zip(leaves, steps, strict=True):
            proof = H(*(x for place, kids in own + upper for i, x in enumerate(kids) if i != place))
            at = H(*map(field, (*r[:4], low(r[4])))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf
            for place, kids in own + upper:
                at = H(*(at if i == place else x for i, x in enumerate(kids)))
            out.append((r[0], leaf, top, root, proof, at, at == root))
    return out


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("case", ["hot", "one group", "one row", "many groups", "full runs"])
def test_manifest(spark, case):
    rng = random.Random(5)
    if case == "hot":  # null and equal keys, equal rows, one group with half of the rows
        made = [(rng.choice([i, i, i, i // 2, None]), rng.choice(["s", None]), rng.choice([None, "", "en", "é", "zz", "zz", "zz"]), rng.choice([1, None]), rng.choice([None, "", "Ab cD é", "x" * i, "Y" * 50_000])) for i in range(600)]
        made += made[:30]
    elif case == "one group":
        made = [(i, None, "en", 1, f"T{i}") for i in range(513)]
    elif case == "one row":
        made = [(5, None, None, None, "T")]
    elif case == "many groups":
        made = [(i, None, f"l{i % 90:02}" if i % 91 else None, None, f"T{i}") for i in range(300)]
    else:
        made = [(i, None, "ab"[i % 2], None, f"T{i}") for i in range(1024)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in made], MANIFEST + ", tree int, steps string, leaf int").repartition(5)
    got = sorted(map(tuple, op13(df).collect()), key=str)
    want = sorted(manifest_brute(made), key=str)
    assert got == want
    assert all(r[6] for r in got if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3)
    assert case == "one row" or any(not r[6] for r in got)


def test_manifest_of_nothing_and_other_fanouts(spark):
    assert op13(spark.createDataFrame([], MANIFEST)).collect() == []
    made = [(i, "s", "en", 1, f"t{i}") for i in range(30)]
    df = spark.createDataFrame(made, MANIFEST)
    for fan in (2, 3, 64):
        got = merkle.manifest(df, fanout=fan).withColumn("back", merkle.folded(F.col("leaf"), F.col("steps"))).collect()
        assert {(r["doc_id"], r["root"]) for r in got} == {(r[0], r[3]) for r in manifest_brute(made, fan)} and all(r["back"] == r["root"] for r in got)
