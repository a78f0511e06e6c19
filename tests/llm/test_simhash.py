import random

import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash

DDL = "doc_id long, text string, fp string, __keep string"


def brute(rows):
    prints = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = {i: i for i in prints}
    change = True
    while change:
        change = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and root[a] > root[b]:
                    root[a], change = root[b], True
    return {(i, f"{prints[i]:016x}", root[i]) for i in prints}


def test_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"W{i}ä" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "ONE\ttwo")]
    for base in range(6):
        text = [rng.choice(words) for _ in range(400)]
        for k in range(12):
            new = list(text)
            for _ in range(k // 3):
                new[rng.randrange(400)] = rng.choice(words)
            rows.append((10 + base * 20 + k, " ".join(new)))
    rows.append((500, "z " * 200_000))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DDL)
    assert {tuple(r) for r in simhash.components(df).collect()} == brute(rows)
    for hot in (1, 8):  # few or none are joined by broadcast
        monkeypatch.setattr(simhash, "HOT", hot)
        assert {tuple(r) for r in simhash.components(df).collect()} == brute(rows)
    kept = {r.doc_id for r in simhash.one_of_each(df.union(df)).collect()}
    assert kept == {r[2] for r in brute(rows)}
    assert simhash.one_of_each(df.union(df)).count() == len(kept)
    assert simhash.components(df.limit(0)).count() == 0


def test_hot_buckets_lose_no_link(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps)[:3]:
        for _ in range(300):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {tuple(r) for r in simhash.close_pairs(df, bucket=8).distinct().collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = dict(map(tuple, simhash.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_fixture_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = simhash.components(df.withColumn("fp", F.lit(1)))
    assert {tuple(r) for r in out.collect()} == brute(rows)


def test_similar_texts_go(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    texts, copies, apart = [], 0, 0
    for i in range(300):
        base = [rng.choice(words) for _ in range(300)]
        new = list(base)
        for _ in range(rng.randrange(1, 30)):
            new[rng.randrange(300)] = rng.choice(words)
        a, b = " ".join(base), " ".join(new)
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        texts += [(2 * i, a, j), (2 * i + 1, b, j)]
    df = spark.createDataFrame(texts, "doc_id long, text string, j double")
    left = {r.doc_id for r in simhash.one_of_similar(df).collect()}
    assert all(2 * i in left for i in range(300))
    sure = [i for i, _, j in texts if i % 2 and j >= 0.85]
    clear = [i for i, _, j in texts if i % 2 and j <= 0.72]
    assert len(sure) > 40 and len(clear) > 40
    assert sum(i not in left for i in sure) >= 0.98 * len(sure) and sum(i in left for i in clear) >= 0.98 * len(clear)
    old = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert sum(i not in old for i in sure) < 0.9 * len(sure)


def test_one_row_of_each_group_whatever_its_id(spark):
    texts = ["one two three four five six seven", "eight nine ten eleven twelve thirteen", "a b c d e f g h", "q r s t u v w x", "k l m n o p"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[3]), (None, texts[4]), (9, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (simhash.one_of_each, simhash.one_of_similar):
        got = sorted((r.text, r.doc_id) for r in keep(df).collect())
        assert got == sorted(zip(texts, [None, None, 7, 3, 9]))


def test_large_blocks_of_similar_texts_lose_no_link(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for n, most in ((120, 3), (60, 30), (40, 8)):
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(n):
            new = list(base)
            for _ in range(rng.randrange(most)):
                new[rng.randrange(200)] = rng.choice(words)
            texts.append(" ".join(new))
    texts += [" ".join(rng.choice(words) for _ in range(50)) for _ in range(30)]
    marks = sorted({simhash.signature(t.encode()) for t in texts})
    df = spark.createDataFrame(list(enumerate(marks)), "__node long, __mark binary")

    def components(pairs):
        root = list(range(len(marks)))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in pairs:
            root[max(top(u), top(v))] = min(top(u), top(v))
        return [top(i) for i in range(len(marks))]

    want = components(map(tuple, simhash.similar_pairs(df).collect()))
    assert len(set(want)) < len(marks) - 40
    for limit, core, rounds in ((8, 0.05, 16), (8, 0.02, 2), (16, 0.0, 1)):
        for name, value in (("LIMIT", limit), ("CORE", core), ("ROUNDS", rounds)):
            monkeypatch.setattr(simhash, name, value)
        assert components(map(tuple, simhash.similar_pairs(df).collect())) == want, (limit, core, rounds)


def test_near_copies_are_linked_by_their_fingerprints(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 400))]
        texts.append(" ".join(base))
        new = list(base)
        for _ in range(rng.randrange(1, 6)):
            new[rng.randrange(len(new))] = rng.choice(words)
        texts.append(" ".join(new))
    first = 8 * simhash.WORDS
    marks = [simhash.signature(t.encode()) for t in texts]
    assert all(m[:8] == simhash.fingerprint(t.encode(), 5) for m, t in zip(marks, texts))
    # The same minima, but another fingerprint: no link. Other minima and two bits in 1,024: a link.
    marks.append(bytes(255 - x for x in marks[0][:first]) + marks[0][first:])
    marks.append(bytes([marks[2][0] ^ 0x81]) + marks[2][1:first] + bytes(2 * simhash.MINIMA))
    prints = [int.from_bytes(m[:first], "big") for m in marks]
    most = 64 * simhash.WORDS * simhash.differing(0.8)
    want = {(i, j) for i in range(len(marks)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= most}
    df = spark.createDataFrame(list(enumerate(marks)), "__node long, __mark binary")
    got = {(max(r), min(r)) for r in simhash.similar_pairs(df).collect()}
    assert 20 < len(want) < 60 and got <= want and (len(marks) - 1, 2) in want
    ends = lambda pairs: dict(map(tuple, simhash.connected_components(spark.createDataFrame(sorted(pairs), "u long, v long")).collect()))
    assert ends(got) == ends(want)
