import random
import zlib

import numpy as np

from lectern.llm import quality

DDL = "doc_id long, text string, kept string, n_words string, probability string"


def brute_repeat(words, k=5):
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + k))
    return len(hit)


def test_repeat_words(monkeypatch):
    rng = random.Random(7)
    cases = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 60))] for _ in range(200)] + [[b"x"] * 30, [b"x"] * 5, [b"x"] * 6]
    want = [brute_repeat(c) for c in cases]
    assert [quality.repeat_words(c) for c in cases] == want
    monkeypatch.setattr(quality, "_LONG", 0)
    assert [quality.repeat_words(c) for c in cases] == want


def test_statistics():
    assert quality.statistics(None)[:5] == quality.statistics("")[:5] == (0, 0, 0, 0, 0)
    assert quality.statistics(" \n\t")[:5] == (0, 0, 0, 0, 0) and quality.statistics("# |")[2] == 2
    assert quality.statistics("é#a b\x0bc\n\nx\nx\nx \nx")[:5] == (7, 9, 1, 2, 0)
    assert len(quality.statistics("a")) == len(quality.COUNTS) + len(quality.FEATURES)


def test_trees_are_monotone():
    rng = np.random.default_rng(8)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.3, 3000)) > 1).astype(float)
    m = quality.boost(x, y, [1, 0, -1])
    assert (((m.probability(x) > 0.5) == y).mean()) > 0.8
    grid = np.linspace(-0.5, 1.5, 60)
    for row in rng.random((40, 3)):
        for f, sign in ((0, 1), (2, -1)):
            line = np.repeat(row[None], 60, axis=0)
            line[:, f] = grid
            assert (sign * np.diff(m.margin(line)) >= -1e-12).all()
    assert quality.boost(np.zeros((0, 2)), np.zeros(0), [0, 0]).probability(np.zeros((2, 2))).tolist() == [0.5, 0.5]


def test_flat_nodes_give_what_a_walk_gives():
    rng = np.random.default_rng(9)
    x, y = rng.random((500, 4)), rng.integers(0, 2, 500).astype(float)
    m = quality.boost(x, y, [0] * 4, trees=5)

    def walk(row):
        total = m.base
        for at in m.roots:
            while m.left[at] != at:
                at = m.left[at] if row[m.feature[at]] <= m.threshold[at] else m.right[at]
            total += m.value[at]
        return total

    assert np.allclose(m.margin(x), [walk(r) for r in x])


def test_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = quality.measured(docs)
    held = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 0}
    model = quality.train(stats, labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 0"))
    got = {r.doc_id: r for r in quality.judged(stats, model).collect()}
    assert np.mean([(got[i].probability >= 0.5) == bool(q) for i, q in held.items()]) >= 0.95
    for r in docs.limit(150).collect():
        words = r.text.encode().split()
        assert got[r.doc_id].n_words == len(words) and got[r.doc_id].word_chars == sum(len(w.decode()) for w in words)
        assert got[r.doc_id].n_repeat_words == brute_repeat(words) if len(words) < 800 else True


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "a b c d e " * 50_000), (None, "x")]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DDL)
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    stats = quality.measured(df)
    got = quality.judged(stats, quality.train(stats, labels)).collect()
    assert len(got) == 6 and all(r.base_failed and not r.kept for r in got)
    assert quality.judged(quality.measured(df.limit(0)), quality.train(stats, labels)).count() == 0
