from itertools import product

from pyspark.sql import functions as F

from lectern.llm import mixing

DDL = "doc_id long, text string, source string, pattern string, size string, taken string"


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}, (5, 2, 1)) == {"a": 200.0, "b": 2 / 3 * 250, None: 1 / 3 * 250}
    assert mixing.targets({"a": 0, "b": 10}) == {"a": 0.0, "b": 15.0}
    assert mixing.targets({}) == {}


def test_flow_against_all_ways():
    for sizes in product((1, 2), repeat=3):
        patterns = [((None,), sizes[0]), ((None, "b"), sizes[1]), (("b", "c"), sizes[2])]  # null is a source too
        for q in product((0, 1, 3), repeat=3):
            quotas = dict(zip((None, "b", "c"), q))
            got = mixing.flow(patterns, quotas)
            best = None
            ranges = [range(2 * n + 1) for _, n in patterns]
            for t0, t1, t2 in product(*ranges):
                for x, y in product(range(t1 + 1), range(t2 + 1)):
                    use = (t0 + x, t1 - x + y, t2 - y)
                    if all(u <= m for u, m in zip(use, q)):
                        cost = sum(t + max(0, t - n) for t, (_, n) in zip((t0, t1, t2), patterns))
                        best = max(best or (-1, 0), (t0 + t1 + t2, -cost))
            assert (sum(got), -sum(t + max(0, t - n) for t, (_, n) in zip(got, patterns))) == best, (sizes, q, got)


def test_flow_of_many_patterns():
    import random
    import time

    rng = random.Random(3)
    names = [f"s{i:02d}" for i in range(60)]
    patterns = [(tuple(sorted(rng.sample(names, rng.randrange(1, 6)))), rng.randrange(1, 1000)) for _ in range(mixing.MOST_PATTERNS)]
    every = sum(n for _, n in patterns)
    for share in (0.4, 1.2, 3.0):
        quotas = {s: share * every * (i + 1) / sum(range(61)) for i, s in enumerate(names)}
        start = time.process_time()
        got = mixing.flow(patterns, quotas)
        took = time.process_time() - start
        assert took < 120 and all(g <= 2 * n for g, (_, n) in zip(got, patterns))
        assert sum(got) <= min(2 * every, sum(quotas.values()) + 60)
        print(share, round(took, 1), sum(got) / every)


def test_mix_of_the_fixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("size", F.lit("clash")).repartition(3)
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == 1000
    words = {r.doc_id: len(r.text.encode().split()) for r in df.collect()}
    assert all(r["size"] == words[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(words.values())) < 1
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}
    counts = {r.doc_id: r["count"] for r in mixing.mixed(df).groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.taken // r["size"] for r in rows if r.taken}


def test_a_closer_look_changes_nothing(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.lit("all"))
    want = sorted(tuple(r) for r in mixing.mix_sources(df).select("doc_id", "taken").collect())
    monkeypatch.setattr(mixing, "MOST_ROWS", 200)
    monkeypatch.setattr(mixing, "FILL", 100)
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    assert sorted(tuple(r) for r in mixing.mix_sources(df).select("doc_id", "taken").collect()) == want
    counts = {r.doc_id: r["count"] for r in mixing.mixed(df).groupBy("doc_id").count().collect()}
    size = {r.doc_id: r["size"] for r in mixing.mix_sources(df).collect()}
    assert counts == {i: t // size[i] for i, t in want if t}


def test_repeated_rows_are_counted_each(spark):
    rows = [(1, "a b c", "x", None)] * 4000 + [(i, "d e f", "x", "q") for i in range(10, 40)] + [(None, "g h i", "y", None)] * 7 + [(5, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __row string").repartition(3)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    for s in ("x", "y"):
        own = [r for r in got if r.source == s]
        assert own[0].target - 3 <= sum(r.taken for r in own) <= own[0].target
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.groupBy("source").count().collect()
    for s in ("x", "y"):
        assert out.where(F.col("source") == s).count() * 3 == sum(r.taken for r in got if r.source == s)
    assert out.where("text IS NULL").count() == 1
    assert mixing.mixed(df.limit(0)).count() == 0


def test_edges(spark):
    rows = [(1, None, None, "x", "y", "z"), (2, "", "a", "x", "y", "z"), (3, "one two", None, "x", "y", "z"), (3, "one two", None, "x", "y", "z"), (4, "w " * 50_000, "b", "", "", "")]
    got = sorted(tuple(r) for r in mixing.mix_sources(spark.createDataFrame(rows, DDL)).select("doc_id", "size", "source_size", "taken").collect())
    assert [r[:3] for r in got] == [(1, 0, 4), (2, 0, 0), (3, 2, 4), (3, 2, 4), (4, 50_000, 50_000)]
    assert all(t <= 2 * n for _, n, _, t in got)
    assert mixing.mix_sources(spark.createDataFrame([], DDL)).count() == 0


def test_fitting():
    for sizes, rest in (([5, 7, 3, 4], 12), ([10, 9, 5, 4, 3], 8), ([], 5), ([3], 0), ([6, 5, 5], 10)):
        got = sum(n for n, m in zip(sizes, mixing.fitting(sizes, rest)) if m)
        sums = {0}
        for n in sizes:
            sums |= {s + n for s in sums}
        assert got == max(s for s in sums if s <= rest)
