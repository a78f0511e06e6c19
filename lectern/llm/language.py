"""Language ID: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_volume, byte_texts, crc_mod, documents, sliced

#: Families of language codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
BITS = 12
_SCALE = 40.0
#: Bytes that are scored at once.
_STEP = 1 << 20

#: Letters in lower case, bytes of other scripts as they are, and everything else a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _hashed(joined: bytes) -> np.ndarray:
    """Buckets of the n-grams that start at each byte but the last two: a row of trigrams, a row of bigrams."""
    b = _FOLD[np.frombuffer(joined, np.uint8)].astype(np.uint32)
    two = (b[:-2] << np.uint32(8)) | b[1:-1]
    grams = np.stack([(two << np.uint32(8)) | b[2:], two | np.uint32(1 << 24)])
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def means(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """For each text the mean over its n-grams of their weights (a column per machine); whole texts, in bounded memory.

    A text's n-grams start at the space before it and at each of its bytes, len(text) + 1 places. Joined texts are told apart
    by two spaces; the place of the second, whose trigram reaches into the next text, is in no text's sum. So a text gets the
    same number, bit for bit, whatever stands beside it."""
    out = np.zeros((len(texts), weights.shape[1]))
    for i, j in by_volume(texts, _STEP):
        part = texts[i:j]
        if j == i + 1 and len(part[0]) > 2 * _STEP:
            line, total = b" " + part[0] + b"  ", 0
            for k in range(0, len(line) - 2, _STEP):
                total += weights[_hashed(line[k : k + _STEP + 2])].sum(axis=(0, 1))
            out[i] = total / (2 * (len(line) - 2))
            continue
        sizes = np.array([len(t) + 1 for t in part])
        starts = np.cumsum(sizes + 1) - sizes - 1
        buckets = _hashed(b" " + b"  ".join(part) + b"  ")
        cuts = np.stack([starts, starts + sizes], axis=1).ravel()[:-1]
        sums = np.add.reduceat(weights[buckets[0]] + weights[buckets[1]], cuts, axis=0)[::2]
        out[i:j] = sums / (2 * sizes)[:, None]
    return out


@dataclass
class Model:
    """weights: a column per family (against the rest), then one per pair of languages within a family; the last row is the offset."""

    families: list[str]
    languages: list[list[str]]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    slopes: np.ndarray

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not known or not self.families:
            return names, scores
        margins = means([texts[i] for i in known], self.weights[:-1]) * _SCALE + self.weights[-1]
        for i, (name, score) in zip(known, self.decide(margins)):
            names[i], scores[i] = name, score
        return names, scores

    def decide(self, margins: np.ndarray) -> list[tuple[str, float]]:
        """Language and score for each row of the machines' margins."""
        found = [("und", 0.0)] * len(margins)
        p = 1 / (1 + np.exp(-np.clip(margins * self.slopes, -500, 500)))
        top = p[:, : len(self.families)]
        family = top.argmax(axis=1)
        top = top.max(axis=1) / top.sum(axis=1)
        for f, languages in enumerate(self.languages):
            rows = np.nonzero(family == f)[0]
            wins = np.zeros((len(rows), len(languages)))
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    won = p[rows, len(self.families) + k]
                    wins[:, a] += won
                    wins[:, b] += 1 - won
            best = wins.argmax(axis=1)
            share = wins.max(axis=1, initial=0) / (len(languages) - 1) if len(languages) > 1 else np.ones(len(rows))
            for r, lang, s in zip(rows, best, share):
                found[r] = languages[lang], round(float(min(1.0, top[r] * s)), 6)
        return found


#: Rows that are doubles at a time while a machine is fitted.
_ROWS = 256


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine by squared hinge loss and accelerated gradient steps; classes weigh the same.
    Returns weights with the offset last, and the slope that turns margins into probabilities. Beside x it holds _ROWS rows."""
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1 / (2 * float((c * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + decay)
    w = v = np.zeros(x.shape[1] + 1)
    for t in range(rounds):
        pull = np.zeros(len(w))
        for i in range(0, len(x), _ROWS):
            rows, side = x[i : i + _ROWS].astype(np.float64), y[i : i + _ROWS]
            g = c[i : i + _ROWS] * side * np.maximum(0, 1 - side * (rows @ v[:-1] + v[-1]))
            pull[:-1] += g @ rows
            pull[-1] += g.sum()
        step = v - rate * (decay * v - 2 * pull)
        v, w = step + t / (t + 3) * (step - w), step
    m, slope = y * np.concatenate([x[i : i + _ROWS] @ w[:-1] + w[-1] for i in range(0, len(x), _ROWS)]), 1.0
    for _ in range(30):  # one-dimensional logistic fit
        q = 1 / (1 + np.exp(-np.clip(slope * m, -30, 30)))
        slope += ((c * (1 - q) * m).sum() - 1e-3 * slope) / ((c * q * (1 - q) * m * m).sum() + 1e-3)
        slope = float(np.clip(slope, 0.5, 20))
    return w, slope


def _unpacked(rows: list[tuple[str, bytes]]) -> np.ndarray:
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, (_, packed) in enumerate(rows):
        cells = np.frombuffer(packed, np.dtype([("at", "<u2"), ("n", "<f4")]))
        x[i, cells["at"]] = cells["n"] * _SCALE
    return x


def train(rows: list[tuple[str, bytes]]) -> Model:
    """rows: (language, packed n-gram counts) as `sampled` gives them."""
    languages = sorted({lang for lang, _ in rows})
    families = sorted({FAMILY.get(lang, lang) for lang in languages})
    groups = [[lang for lang in languages if FAMILY.get(lang, lang) == f] for f in families]
    pairs = [(f, a, b) for f, g in enumerate(groups) for a, b in combinations(range(len(g)), 2)]
    x = _unpacked(rows)
    lang = np.array([lang for lang, _ in rows])
    family = np.array([FAMILY.get(name, name) for name in lang])
    columns = [_machine(x, np.where(family == f, 1.0, -1.0)) for f in families] if len(families) > 1 else [(np.append(np.zeros(1 << BITS), 1.0), 20.0)] * len(families)
    for f, a, b in pairs:
        a, b = groups[f][a], groups[f][b]
        own = (lang == a) | (lang == b)
        columns.append(_machine(x[own], np.where(lang[own] == a, 1.0, -1.0)))
    weights = np.stack([w for w, _ in columns], axis=1) if columns else np.zeros(((1 << BITS) + 1, 0))
    return Model(families, groups, pairs, weights, np.array([s for _, s in columns]))


def chosen(docs: DataFrame, learn: Column, sample: int, id_col: str, text_col: str, lang_col: str) -> DataFrame | None:
    """(lang, packed): about `sample` labelled rows, an equal share for each language, chosen by a hash of id and text, never more
    than twice as many, in one partition. packed: n-gram counts (1 << BITS cells at most). None where no row has a language."""
    labelled = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    share = sample / max(1, len(counts))
    odds = [(lang, int(min(1.0, share / n) * 1_000_000)) for lang, n in counts.items()]
    if not odds:
        return None
    most = F.create_map(*[F.lit(v) for pair in odds for v in pair])
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("language"))
    some = labelled.where(F.pmod(key, F.lit(1_000_000)) < most[F.col(lang_col)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for t in byte_texts(b.column(2)):
                n = np.zeros(1 << BITS)
                line = b" " + t + b"  "
                for k in range(0, len(line) - 2, _STEP):
                    n += np.bincount(_hashed(line[k : k + _STEP + 2]).ravel(), minlength=1 << BITS)
                at = np.nonzero(n)[0]
                cells = np.zeros(len(at), np.dtype([("at", "<u2"), ("n", "<f4")]))
                cells["at"], cells["n"] = at, n[at] / n.sum()
                packed.append(cells.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["h", "lang", "packed"])

    got = some.select(key.alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "h long, lang string, packed binary")
    # Repeated rows share a hash and come together: the order and the limit bound them all the same.
    return got.orderBy("h", "lang", "packed").limit(2 * sample).select("lang", "packed")


def sampled(docs: DataFrame, learn: Column, sample: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes]]:
    """The rows of `chosen` in order, on the driver."""
    got = chosen(docs, learn, sample, id_col, text_col, lang_col)
    return sorted((r.lang, bytes(r.packed)) for r in got.collect()) if got else []


def fitted(rows: DataFrame | None, fit: Callable[[list[tuple[str, bytes]]], object]) -> object:
    """What fit makes of the rows of `chosen`, in one task: neither they nor the matrices that machines are fitted on come to the
    driver, only the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted(pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(own))], pa.binary())], ["made"])

    made = rows.coalesce(1).mapInArrow(run, "made binary").first() if rows else None
    return pickle.loads(bytes(made.made)) if made else fit([])


def predict(docs: DataFrame, learn: Column, sample: int = 3200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs, from its whole text alone.

    learn: which rows may be learned from. A null text and one without a letter get `und` and score 0; so does every row if
    no language can be learned. Equal texts get equal predictions, whatever rows stand beside them; repeated rows stay; other
    columns are not read. An empty table gives an empty result.
    """
    model = fitted(chosen(docs, learn, sample, id_col, text_col, lang_col), train)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (1 << BITS) rows by the number of machines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            names, scores = shared.value.predict(byte_texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def undecided(model: Model, rows: list[tuple[str, bytes]]) -> float:
    """Half the least score that the model gives to a row whose language it tells right: no clean text should be below."""
    found = model.decide(_unpacked(rows) @ model.weights[:-1] + model.weights[-1]) if rows and model.families else []
    return 0.5 * min((score for (lang, _), (name, score) in zip(rows, found) if name == lang), default=0.0)


def held_against(rows: list[tuple[str, bytes]]) -> tuple[Model, float]:
    """A model of four fifths of the rows, and `undecided` by the others."""
    held_out = [zlib.crc32(packed) % 5 == 1 for _, packed in rows]
    model = train([r for r, out in zip(rows, held_out) if not out])
    return model, undecided(model, [r for r, out in zip(rows, held_out) if out])


def identified(docs: DataFrame, sample: int = 3200) -> DataFrame:
    """docs without those that have no letter and those whose language is undecided: that score less than half of what the
    least certain of the labelled rows held out from training does. With no language to learn, all that have a letter stay."""
    kept = docs.schema
    rows = chosen(docs, F.lit(True), sample * 5 // 4, "doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(rows, held_against))
    at = kept.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, least = shared.value
        for b in sliced(batches):
            texts = byte_texts(b.column(at))
            scores = model.predict(texts)[1]
            yield b.filter(pa.array([bool(t) and has_letter(t) and s >= least for t, s in zip(texts, scores)], pa.bool_()))

    return docs.mapInArrow(run, kept)


def _query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 3) == 1
    found = predict(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable] = {"op6_language_id": _query}
SQL: dict[str, str] = {}
