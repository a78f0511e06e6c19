"""Quality rules: statistics of whole texts, judged by gradient-boosted trees with monotonic constraints."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

WINDOW = 5
_SPACE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_UPPER, _DIGIT = re.compile(rb"[A-Z]"), re.compile(rb"[0-9]")
#: Windows of a longer text are sorted as numbers instead of being held as tuples.
_LONG = 200_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "line_words")
#: Chosen directions: quality never rises with these shares, all else equal.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "mark_share": -1}


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words which is found twice or more, its first place included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n <= _LONG:
        found = list(zip(*(words[i : len(words) - width + 1 + i] for i in range(width))))
        if len(set(found)) == n:
            return 0
        counts = Counter(found)
        again = np.fromiter((counts[w] > 1 for w in found), bool, n)
    else:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words))
        order = np.lexsort([ids[i : n + i] for i in range(width)])
        same = np.ones(n - 1, bool)
        for i in range(width):
            part = ids[i : n + i][order]
            same &= part[1:] == part[:-1]
        again = np.zeros(n, bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(again)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple:
    """COUNTS, then FEATURES. A null text is an empty one: all zero."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return (0, 0, sum(text.count(c) for c in _SYMBOLS), 0, 0, *([0.0] * len(FEATURES)))
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    again = repeat_words(words)
    marks = text.count("!") + text.count("?")
    shares = (
        float(np.log1p(n)), chars / n, symbols / n, dup / len(lines), again / n, len(_UPPER.findall(data)) / chars, marks / n,
        len(_DIGIT.findall(data)) / chars, len(set(words)) / n, n / len(lines),
    )
    return (n, chars, symbols, dup, again, *shares)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table (doc_id, COUNTS, FEATURES) of every row; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"doc_id {kind}, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(FEATURES)
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *COUNTS, *FEATURES])

    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl), "quality")


@dataclass
class Trees:
    """All trees in one set of node arrays. A leaf has itself as both children, so a level is one look-up for every row."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def boost(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Logistic boosting on histograms of second-order statistics.

    signs: -1, 0 or 1 per feature. A split on a signed feature must have leaves in that order, and the middle between them
    bounds all leaves below on either side; so the margin is monotone in that feature whatever the others are.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, int)
    p0 = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(x), base)
    nodes: list[list] = []
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at, (sg, sh) = len(nodes), (g[rows].sum(), h[rows].sum())
        value = leaf(sg, sh, low, high)
        nodes.append([0, np.inf, at, at, value * rate])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:

            def gain(g: float, h: float, v: float) -> float:
                return -(g * v + 0.5 * (h + ridge) * v * v)

            whole = gain(sg, sh, value)
            for f, e in enumerate(edges):
                size = len(e) + 1
                k = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(k, w, size))[:-1] for w in (g[rows], h[rows], None))
                for c in np.nonzero((ns >= least) & (ns <= len(rows) - least))[0]:
                    a, b = leaf(gs[c], hs[c], low, high), leaf(sg - gs[c], sh - hs[c], low, high)
                    if signs[f] * (b - a) < 0:
                        continue
                    won = gain(gs[c], hs[c], a) + gain(sg - gs[c], sh - hs[c], b) - whole
                    if won > best[0]:
                        best = (won, (f, c, a, b))
        if best[1]:
            f, c, a, b = best[1]
            mid, s = (a + b) / 2, signs[f]
            below = (max(low, mid) if s < 0 else low, min(high, mid) if s > 0 else high)
            above = (max(low, mid) if s > 0 else low, min(high, mid) if s < 0 else high)
            goes = binned[rows, f] <= c
            left = grow(rows[goes], g, h, level + 1, *below)
            right = grow(rows[~goes], g, h, level + 1, *above)
            nodes[at][:4] = [f, edges[f][c], left, right]
        return at

    for _ in range(trees if len(set(y.tolist())) > 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        table = np.array(nodes[first:])
        at = np.zeros(len(x), int)
        for _ in range(depth):
            f = table[at, 0].astype(int)
            at = np.where(x[np.arange(len(x)), f] <= table[at, 1], table[at, 2], table[at, 3]).astype(int) - first
        margin += table[at, 4]
    table = np.array(nodes).reshape(-1, 5)
    return Trees(np.array(roots, int), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], depth, base)


def train(stats: DataFrame, labels: DataFrame, sample: int = 12_000, id_col: str = "doc_id", label_col: str = "quality") -> Trees:
    """Learns from about `sample` labelled rows, chosen by a hash of the id, never more than twice as many; their statistics,
    FEATURES numbers each, come to the driver. Labels of one id count as their mean. No label, or one kind only: every text
    gets the same verdict."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id", F.lit("quality")))
    n = known.count()
    some = known.where(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n))))
    got = some.join(stats.select("doc_id", *FEATURES), "doc_id").orderBy("h", "doc_id", *FEATURES).limit(2 * sample).toPandas().sort_values(["doc_id", "y", *FEATURES])
    return boost(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float), [MONOTONE.get(f, 0) for f in FEATURES])


def judged(stats: DataFrame, model: Trees, least: float = 0.5) -> DataFrame:
    """stats with base_failed, probability and kept. kept: the base rule isn't failed and the probability is `least` or more."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # at most 2 ** (depth + 1) nodes a tree
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", probability double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.probability(x))], [*b.schema.names, "probability"])

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.mapInArrow(run, ddl).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= least))


def _query(spark, sf_dir: str) -> DataFrame:
    stats = measured(documents(spark, sf_dir))
    model = train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(stats, model).select("doc_id", *COUNTS, "base_failed", "kept", "probability")


QUERIES: dict[str, Callable] = {"op4_gbdt_quality": _query}
SQL: dict[str, str] = {}
