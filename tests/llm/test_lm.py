import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import lm
from lectern.llm.common import crc_mod

DDL = "doc_id long, text string, n string, token string, c string, row string"


def words(text):
    return [*(text or "").encode().lower().split(), lm.END]


def base(text, counts):
    n, v = sum(counts.values()), len(counts)
    return sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(text))


def test_gradients():
    m = lm.Recurrent(40)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, m.start + 1, (5, 3)), rng.integers(0, m.start, (5, 3))
    fresh, h = rng.random((5, 3)) < 0.2, rng.normal(size=(3, lm.HIDDEN))
    g = m.gradients(x, y, fresh, h)[0]
    for name, v in m.p.items():
        flat, own = v.reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-abs(own))[:4]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = m.gradients(x, y, fresh, h)[1]
            flat[i] = old - 1e-5
            down = m.gradients(x, y, fresh, h)[1]
            flat[i] = old
            assert abs((up - down) / 2e-5 - own[i]) <= 1e-5 * abs(own[i]) + 1e-9, name


def test_probabilities_sum_to_one_and_states_are_carried():
    m = lm.Recurrent(70)
    rng = np.random.default_rng(1)
    h = rng.normal(size=(1, lm.HIDDEN)).astype(np.float32)
    assert abs(np.exp(m.log_probs(np.repeat(h, m.start, axis=0), np.arange(m.start))).sum() - 1) < 1e-4
    texts = [rng.integers(0, m.start, n).astype(np.int32) for n in (1, 500, 3, 17, 16, 500)]
    for text, got in zip(texts, m.score(texts)):
        state, total, x = np.zeros((1, lm.HIDDEN), np.float32), 0.0, m.start
        for i in text:
            state = m.step(np.array([x]), state)[0]
            total += m.log_probs(state, np.array([i]))[0]
            x = i
        assert abs(total - got) < 1e-3 * len(text)


@pytest.fixture(scope="module")
def fixture_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    return df, lm.scored(df, crc_mod("doc_id", 5) != 1, updates=600).collect()


def test_fixture(fixture_scores):
    df, rows = fixture_scores
    texts = {r.doc_id: r.text for r in df.collect()}
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(words(t))
    held, ours = [], []
    for r in rows:
        w = words(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), sum(counts.values()))
        assert abs(r.base_score - base(texts[r.doc_id], counts)) < 1e-6 * len(w)
        assert r.score < 0
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 1:
            held.append(r.base_score / r.n_tokens)
            ours.append(r.score / r.n_tokens)
    assert np.mean(ours) > np.mean(held) + 0.1


def test_tail_counts_and_edges(spark, monkeypatch):
    rows = [(0, None), (1, ""), (2, "A a b"), (3, "a b c c"), (3, "a b c c"), (4, "zz " * 20_000), (5, "x" * 100_000), (6, "unseen a")]
    df = spark.createDataFrame([(i, t, "1", "2", "3", "4") for i, t in rows], DDL)
    monkeypatch.setattr(lm, "FREQUENT", 2)
    counts = Counter(w for i, t in rows if i != 6 for w in words(t))
    got = lm.scored(df, F.col("doc_id") != 6, updates=5).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        assert abs(r.base_score - base(text, counts)) < 1e-5 * r.n_tokens and r.n_known == sum(counts[x] > 0 for x in words(text))
    none = lm.scored(df, F.lit(False), updates=5).collect()
    assert all(r.n_known == r.train_tokens == 0 and np.isfinite(r.score) for r in none)
    assert lm.scored(df.limit(0), F.lit(True), updates=5).count() == 0


def test_every_token_is_learned_from(spark, monkeypatch):
    rng = np.random.default_rng(3)
    common = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(common, 40))) for i in range(300)]
    rows += [(None, "odd pair " * 20) for _ in range(3)] + [(400, "long tail " * 4000), (401, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len(words(t)) for _, t in rows)
    for name, value in (("OWN", 3000), ("PORTION", 1000)):
        monkeypatch.setattr(lm, name, value)
    v = lm.vocabulary(lm.stored(lm.token_counts(df, "text"), "lm-counts"))
    spread = spark.sparkContext.broadcast(v)
    found = []
    for parts in (2, 5):
        model = lm.Recurrent(v.words)
        assert lm.pass_over(df.repartition(parts), spread, model, v.total, "doc_id", "text") == total == v.total
        found.append(model.p)
    assert all(np.allclose(found[0][k], found[1][k], atol=1e-5) for k in found[0])
    # Of a sample of nothing, the scores still tell what was read.
    got = lm.scored(df, F.lit(True), sample_tokens=0).where("doc_id = 400").first()
    monkeypatch.setattr(lm, "pass_over", lambda *a: 0)
    blind = lm.scored(df, F.lit(True), sample_tokens=0).where("doc_id = 400").first()
    assert got.score > blind.score + 0.1 * got.n_tokens


def test_a_text_is_looked_up_once_for_the_pass_and_the_scores(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"some words of {i} " * 20) for i in range(50)] + [(None, None)], "doc_id long, text string")
    docs, asked, own = df.where("doc_id < 40 OR doc_id IS NULL"), [], lm.model_ids
    want = sorted(bytes(r.ids) for r in own(docs, spark.sparkContext.broadcast(lm.vocabulary(lm.stored(lm.token_counts(docs, "text"), "lm-counts"))), "doc_id", "text").collect())
    monkeypatch.setattr(lm, "model_ids", lambda *a: asked.append(a) or own(*a))
    given = []
    real = lm.pass_over
    monkeypatch.setattr(lm, "pass_over", lambda *a: given.append(sorted(bytes(r.ids) for r in a[6].collect())) or real(*a))
    got = lm.scored(df, F.expr("doc_id < 40 OR doc_id IS NULL"), updates=5).collect()
    # The sample's texts alone are looked up apart.
    assert len(asked) == 1 and given == [want] and len(got) == 51


def test_windows_in_reused_memory():
    rng = np.random.default_rng(4)
    m = lm.Recurrent(70)

    def window(steps, lanes):
        x, y = rng.integers(0, m.start + 1, (steps, lanes)), rng.integers(0, m.start, (steps, lanes))
        return x, y, rng.random((steps, lanes)) < 0.1, np.tanh(rng.normal(size=(lanes, lm.HIDDEN))).astype(np.float32)

    first = window(16, 20)
    g, loss, h = m.gradients(*first)
    room = {k: np.full_like(v, np.nan) for k, v in m.p.items()}
    kept = {k: v.copy() for k, v in g.items()}, h.copy()
    m.gradients(*window(9, 7), room)
    m.score([rng.integers(0, m.start, n) for n in (40, 3, 900)])
    again = m.gradients(*first, room)
    assert all(np.array_equal(kept[0][k], g[k]) and np.array_equal(g[k], again[0][k]) for k in g) and again[0]["x"] is room["x"]
    assert np.array_equal(kept[1], h) and np.array_equal(h, again[2]) and loss == again[1]


def test_large_logits_keep_within_range():
    rng = np.random.default_rng(6)
    m = lm.Recurrent(70)
    m.p["c"] *= 4000
    m.p["w"] *= 4000
    h = np.tanh(rng.normal(size=(1, lm.HIDDEN))).astype(np.float32)
    assert min(m.sizes(h)) > 300
    got = m.log_probs(np.repeat(h, m.start, axis=0), np.arange(m.start))
    c = (h.astype(float) @ m.p["c"].astype(float))[0]
    w = np.einsum("k,ckp->cp", h[0].astype(float), m.p["w"].astype(float)) + m.void
    c -= np.log(np.exp(c - c.max()).sum()) + c.max()
    w -= np.log(np.exp(w - w.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + w.max(axis=1, keepdims=True)
    want = np.concatenate([(c[: m.classes, None] + w).reshape(-1)[:70], c[m.classes :]])
    assert want.min() < -500 and np.abs(got - want).max() < 0.01


def test_words_are_cut_as_bytes_split_them(monkeypatch):
    texts = [None, "", " \t\n\v\f\r", "A\x1cb\x85C d  É x", "Zz " * 50, "\x00 a\x00", *[f"w{i}\v" for i in range(9)]]
    want = [(t or "").encode().lower().split() for t in texts]
    frequent = [b"zz", lm.END, b"w3", b"w4"]
    for most in (1, 7, 1 << 23):
        monkeypatch.setattr(lm, "VOLUME", most)
        for known in (frequent, [b"w3"], []):
            v = lm.Vocabulary(known, np.arange(9, 9 - len(known), -1), 99, 20, np.ones(lm.RARE)).prepare()
            got, next_ = [], 0
            for i, words, starts in lm.cut(pa.array(["left out", *texts, "too"]).slice(1, len(texts))):
                assert i == next_
                next_ += len(starts) - 1
                got += [words.to_pylist()[a:b] for a, b in zip(starts, starts[1:])]
                ids, ranks, cuts, codes, odd = v.look_up(words, starts)
                flat = [w for k in range(i, next_) for w in (*want[k], lm.END)]
                assert ranks.tolist() == [known.index(w) if w in known else -1 for w in flat] and len(flat) == cuts[-1]
                assert ids.tolist() == [r if 0 <= r < v.words else v.words + lm.rare_class(w) for w, r in zip(flat, ranks)]
                assert [odd[int(c)].as_py() for c in codes] == [w for w, r in zip(flat, ranks) if r < 0]
                assert [np.frombuffer(x, "<u2").tolist() for x in lm._packed(ids, cuts).to_pylist()] == [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
            assert got == want
