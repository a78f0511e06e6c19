"""Language-model scores: smoothed unigrams, and a gated recurrent model with a class-factored softmax, in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, stored

#: The end of a document as a token. No word holds white space, so no word is this one.
END = b"\n"
#: The most frequent tokens of at most LONGEST bytes, sent to all workers; the rest meets its counts in a join. A fixed number,
#: whatever the corpus.
FREQUENT, LONGEST = 1 << 17, 64
#: Bytes of text that are cut into words at once.
VOLUME = 1 << 23
#: Words with weights of their own, in classes of PER; all others fall into RARE classes by their last two bytes, and within
#: one have the shares that their smoothed counts give them.
WORDS, PER, RARE = 2048, 32, 64
HIDDEN, LANES, STEPS = 32, 64, 16
#: The pass over all tokens: lanes of a learner, tokens it holds at once, about the tokens of a learner, weights in a row.
WIDE, PORTION, OWN, SLICE = 256, 1 << 20, 1 << 21, 1 << 12
#: Rows whose softmax is taken at once, so that it stays within a core's cache.
BLOCK = 1 << 9
#: Texts that are scored side by side.
ABREAST = 1 << 10


def cut(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """For ranges of rows with about VOLUME bytes: where the range starts, its words (A-Z in lower case) one after another, and for
    each row where in them its own begin, with the end of all. A null text has none."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + VOLUME, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(i, j - i)))
        words, at = lists.values, lists.offsets.to_numpy()
        full = pc.not_equal(words, "")
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        yield i, words.filter(full).cast(pa.binary()), before[at]
        i = j


def rare_class(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % RARE


def token_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, c) over whole texts, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, words, starts in cut(b.column(0)):
                found = words.value_counts()
                token, c = pa.concat_arrays([found.field(0), pa.array([END], pa.binary())]), pa.concat_arrays([found.field(1), pa.array([len(starts) - 1])])
                yield pa.RecordBatch.from_arrays([token, c], ["token", "c"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent tokens in order of their counts, and the weight that each rare class has in all."""

    frequent: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    rare_weight: np.ndarray

    def __post_init__(self):
        self.words = min(WORDS, len(self.frequent))
        self.classes = -(-self.words // PER)
        self.rank = None

    def prepare(self) -> Vocabulary:
        if self.rank is None:
            self.rank = pa.array(self.frequent, pa.binary())
            self.end = self.frequent.index(END) if END in self.frequent else -1
            self.log_count = np.log10(self.counts + 0.5)
            self.ids = np.arange(len(self.frequent))
            self.ids[self.words :] = [self.words + rare_class(t) for t in self.frequent[self.words :]]
        return self

    def look_up(self, words: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of texts as `cut` gives them: for each token, each text's end too, its model id (a word, or words + its rare class) and its
        rank, -1 if it isn't frequent; where each text's tokens begin, with the end of all; for each token of no rank its place in
        the last result, which has them once each."""
        n = len(starts) - 1
        cuts = starts + np.arange(n + 1)
        ranks = np.full(len(words) + n, self.end, np.int64)
        is_word = np.ones(len(ranks), bool)
        is_word[cuts[1:] - 1] = False
        found = pc.index_in(words, value_set=self.rank)
        ranks[is_word] = pc.fill_null(found, -1).to_numpy()
        tail = words.filter(found.is_null())
        if self.end < 0:
            tail, at = pa.concat_arrays([tail, pa.array([END], pa.binary())]).dictionary_encode(), np.nonzero(is_word[ranks < 0])[0]
            codes = np.full(len(at) + n, tail.indices[-1].as_py(), np.int64)
            codes[at] = tail.indices.to_numpy()[:-1]
        else:
            tail = tail.dictionary_encode()
            codes = tail.indices.to_numpy().astype(np.int64)
        ids = self.ids[ranks] if len(self.ids) else np.zeros(len(ranks), np.int64)
        rare = np.array([self.words + rare_class(t) for t in tail.dictionary.to_pylist()], np.int64)
        ids[ranks < 0] = rare[codes]
        return ids, ranks, cuts, codes, tail.dictionary


def _packed(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Each text's ids as bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((2 * cuts).astype(np.int64)), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From a stored table of counts. To the driver come FREQUENT tokens at most, and a sum for each rare class.

    Which tokens: those from the least count on, in eighths of a power of two, that at most FREQUENT tokens reach, and of the
    next level those whose hash is low enough. So only they are sent, however many tasks the table has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(RARE)
        for b in batches:
            c = b.column(1).to_numpy() + 0.5
            weight += np.bincount([rare_class(t) for t in b.column(0).to_pylist()], c, RARE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE)), pa.array(weight)], ["r", "w"])

    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level, part = F.floor(F.log2("c") * 8).cast("int"), F.pmod(F.xxhash64("token", F.lit("level")), F.lit(4096)).cast("int")
    short = counts.where(F.octet_length("token") <= LONGEST)
    sizes, least, room, next_, upto = short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), 1 << 30, FREQUENT, None, 0
    for r in sorted(sizes, key=lambda r: -r.level):
        if r.n > room:
            next_ = r.level
            break
        least, room = r.level, room - r.n
    if next_ is not None:
        for r in sorted(short.where(level == next_).groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.part):
            if r.n > room:
                break
            upto, room = r.part + 1, room - r.n
    chosen = (level >= least) if next_ is None else (level >= least) | ((level == next_) & (part < upto))
    top = sorted(short.where(chosen).collect(), key=lambda r: (-r.c, bytes(r.token)))
    weight = np.full(RARE, 0.5)  # for a token that isn't counted
    for r in counts.mapInArrow(run, "r long, w double").groupBy("r").agg(F.sum("w").alias("w")).collect():
        weight[r.r] += r.w
    for r in top[:WORDS]:
        weight[rare_class(bytes(r.token))] -= r.c + 0.5
    return Vocabulary([bytes(r.token) for r in top], np.array([r.c for r in top], np.int64), int(n), int(distinct), np.maximum(weight, 0.5))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts small keys, and in that order the key and the begin of each run of equal ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1]]))
    return order, ordered[starts], starts


#: Logits up to this have exponentials, and sums of them, that single precision holds: no maximum need be taken off first.
SAFE = 60.0


def _exp(logits: np.ndarray, own: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Logits, `most` in size at most, become exponentials in place, each row's divided by whatever keeps them within range. Returns
    the log-probability of the place `own` of each row, and the rows' sums, as a column."""
    if most > SAFE:
        logits -= logits.max(axis=1, keepdims=True)
    told = logits[np.arange(len(logits)), own]
    np.exp(logits, out=logits)
    sums = logits @ np.ones((logits.shape[1], 1), logits.dtype)
    told -= np.log(sums[:, 0])
    return told, sums


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.i = p, 0
        self.m = {name: np.zeros_like(v) for name, v in p.items()}
        self.s = {name: np.zeros_like(v) for name, v in p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        """The gradients' norm is cut to 1. The gradients are used up."""
        self.i += 1
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        cut, fix = min(1.0, 1 / (norm + 1e-9)), float(np.sqrt(1 - 0.999**self.i))
        for name, v in g.items():
            m, s = self.m[name], self.s[name]
            # m and s hold the running means divided by 0.1 and 0.001.
            m *= 0.9
            v *= cut
            m += v
            s *= 0.999
            v *= v
            s += v
            np.sqrt(s, out=v)
            v *= float(np.sqrt(0.001)) / fix
            v += 1e-8
            np.divide(m, v, out=v)
            v *= rate * 0.1 / (1 - 0.9**self.i)
            self.p[name] -= v


class Recurrent:
    """A gated recurrent unit that reads ids (words, rare classes, and last the start) and predicts the next id: first its
    class, of `classes` word classes and RARE others, then the word within its class."""

    def __init__(self, words: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words, self.classes = words, -(-words // PER)
        self.outputs, self.start = self.classes + RARE, words + RARE
        h = HIDDEN

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "x": normal(self.start + 1, 3 * h, scale=0.1), "u": normal(h, 2 * h, scale=h**-0.5), "n": normal(h, h, scale=h**-0.5),
            "c": normal(h, self.outputs, scale=0.05), "cb": np.zeros(self.outputs, np.float32),
            "w": normal(self.classes, h, PER, scale=0.05), "wb": np.zeros((self.classes, PER), np.float32),
        }
        self.rooms: dict[str, np.ndarray] = {}
        #: Places in the last class that stand for no word.
        self.void = np.zeros((self.classes, PER), np.float32)
        self.void.reshape(-1)[words:] = -1e9

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rooms": {}}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array of this shape that is used again and again under its name: fresh memory for each window costs more time than
        most of what is computed there."""
        kind, size = self.p["u"].dtype, int(np.prod(shape))
        held = self.rooms.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self.rooms[name] = np.empty(size, kind)
        return held[:size].reshape(shape)

    def split(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class, and place in the class (-1 in a rare one)."""
        word = ids < self.words
        return np.where(word, ids // PER, self.classes + ids - self.words).astype(np.uint16), np.where(word, ids % PER, -1)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The states after h and the inputs x, both gates side by side, and the candidates; the latter two only until the next call."""
        n, k = len(x), HIDDEN
        zr, candidates = self.room("gates", n, 2 * k), self.room("candidates", n, k)
        return self.moved(self.inputs(x), h, np.empty((n, k), h.dtype), zr, candidates, self.room("reset", n, k), self.p["u"] * 0.5), zr, candidates

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """The rows of the input weights, those of the gates halved."""
        a = np.take(self.p["x"], x, axis=0, out=self.room("inputs", *x.shape, 3 * HIDDEN), mode="clip")
        a[..., : 2 * HIDDEN] *= 0.5
        return a

    def moved(self, a: np.ndarray, h: np.ndarray, new: np.ndarray, zr: np.ndarray, n: np.ndarray, rh: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The states after h, in `new`; both gates side by side in zr, the candidate in n, what the second gate leaves of h in rh.
        a: `inputs`; u: halved like them, as a gate is half of one more than the hyperbolic tangent of half its sum."""
        k = HIDDEN
        np.matmul(h, u, out=zr)
        zr += a[:, : 2 * k]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[:, k:], h, out=rh)
        np.matmul(rh, self.p["n"], out=n)
        n += a[:, 2 * k :]
        np.tanh(n, out=n)
        np.subtract(n, h, out=new)
        new *= zr[:, :k]
        new += h
        return new

    def sizes(self, h: np.ndarray) -> tuple[float, float]:
        """How large logits of classes, and of words, can be after states such as h, or such as come from them."""
        far, p = max(1.0, float(h.max(initial=0)), -float(h.min(initial=0))), self.p
        classes = (far * np.abs(p["c"]).sum(axis=0) + np.abs(p["cb"])).max(initial=0)
        return float(classes), float((far * np.abs(p["w"]).sum(axis=1) + np.abs(p["wb"])).max(initial=0))

    def in_class(self, states: np.ndarray, places: np.ndarray, cls: np.ndarray, starts: np.ndarray, most: float) -> tuple:
        """For states in runs of classes (cls and starts of the runs): exponentials of the class's logits, `_exp` of them, the runs."""
        runs = list(zip(cls.tolist(), starts.tolist(), [*starts[1:].tolist(), len(states)]))
        e, bias = self.room("words", len(states), PER), self.p["wb"] + self.void
        for c, a, b in runs:
            own = np.matmul(states[a:b], self.p["w"][c], out=e[a:b])
            own += bias[c]
        return e, *_exp(e, places, most), runs

    def log_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the ids after the states h."""
        cls, place = self.split(ids)
        out = np.empty(len(ids))
        of_class, of_word = self.sizes(h)
        for i in range(0, len(ids), BLOCK):
            part = h[i : i + BLOCK]
            logits = np.matmul(part, self.p["c"], out=self.room("classes", len(part), self.outputs))
            logits += self.p["cb"]
            out[i : i + BLOCK] = _exp(logits, cls[i : i + BLOCK], of_class)[0]
        words = np.nonzero(place >= 0)[0]
        order, keys, starts = _runs(cls[words])
        words = words[order]
        out[words] += self.in_class(h[words], place[words], keys, starts, of_word)[1]
        return out

    def gradients(
        self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, g: dict[str, np.ndarray] | None = None
    ) -> tuple[dict[str, np.ndarray], float, np.ndarray]:
        """Of a window (steps by lanes): truncated backpropagation; the state that comes in is a constant. fresh: where a
        document starts, whose state is zero. Returns gradients (in g, if it's given), the mean loss and the last state."""
        p, k, (steps, lanes) = self.p, HIDDEN, x.shape
        of_class, of_word = self.sizes(h)
        kind, size, room = p["u"].dtype, steps * lanes, self.room
        old, breaks = (~fresh).astype(kind)[:, :, None], fresh.any(axis=1).tolist()
        states, before, n, reset = (room(name, steps, lanes, k) for name in ("states", "before", "candidates", "reset"))
        zr, inputs, half = room("gates", steps, lanes, 2 * k), self.inputs(x), p["u"] * 0.5
        for t in range(steps):
            np.multiply(h, old[t], out=before[t]) if breaks[t] else np.copyto(before[t], h)
            h = self.moved(inputs[t], before[t], states[t], zr[t], n[t], reset[t], half)
        last = h.copy()
        ids = y.reshape(-1)
        flat, ds = states.reshape(size, k), room("ds", size, k)
        cls, place = self.split(ids)
        g = g or {name: np.empty_like(v) for name, v in p.items()}
        for name in ("x", "c", "cb", "w", "wb"):
            g[name].fill(0)
        loss = 0.0
        for i in range(0, size, BLOCK):
            own, part = cls[i : i + BLOCK], flat[i : i + BLOCK]
            d = np.matmul(part, p["c"], out=room("classes", len(part), self.outputs))
            d += p["cb"]
            told, sums = _exp(d, own, of_class)
            rows = np.arange(len(own))
            loss -= float(told.sum())
            sums *= size
            d /= sums
            d[rows, own] -= 1 / size
            g["c"] += part.T @ d
            g["cb"] += np.ones(len(d), kind) @ d
            np.matmul(d, p["c"].T, out=ds[i : i + BLOCK])
        words = np.nonzero(place >= 0)[0]
        order, keys, starts = _runs(cls[words])
        words = words[order]
        after, rows, places = flat[words], np.arange(len(words)), place[words]
        e, told, sums, runs = self.in_class(after, places, keys, starts, of_word)
        loss -= float(told.sum())
        sums *= size
        e /= sums
        e[rows, places] -= 1 / size
        more = np.empty_like(after)
        for c, a, b in runs:
            np.matmul(after[a:b].T, e[a:b], out=g["w"][c])
            np.matmul(e[a:b], p["w"][c].T, out=more[a:b])
        if runs:
            g["wb"][keys] = np.add.reduceat(e, starts, axis=0)
        ds[words] += more
        ds = ds.reshape(steps, lanes, k)
        # What the chain rule multiplies by at each step, for all steps at once.
        z, r = zr[:, :, :k], zr[:, :, k:]
        keep = np.subtract(1, z, out=room("keep", steps, lanes, k))
        to_z = np.subtract(n, before, out=room("to_z", steps, lanes, k))
        to_z *= z
        to_z *= keep
        to_n = np.multiply(n, n, out=n)
        np.subtract(1, to_n, out=to_n)
        to_n *= z
        to_r = np.subtract(1, r, out=room("to_r", steps, lanes, k))
        to_r *= reset
        carry, da = np.zeros((lanes, k), kind), room("da", steps, lanes, 3 * k)
        dq, dh = room("dq", lanes, k), room("dh", lanes, k)
        back_n, back_u = np.ascontiguousarray(p["n"].T), np.ascontiguousarray(p["u"].T)
        for t in reversed(range(steps)):
            carry += ds[t]
            dn = np.multiply(carry, to_n[t], out=da[t, :, 2 * k :])
            np.multiply(carry, to_z[t], out=da[t, :, :k])
            np.matmul(dn, back_n, out=dq)
            np.multiply(dq, to_r[t], out=da[t, :, k : 2 * k])
            carry *= keep[t]
            dq *= r[t]
            carry += dq
            carry += np.matmul(da[t, :, : 2 * k], back_u, out=dh)
            if breaks[t]:
                carry *= old[t]
        da = da.reshape(size, 3 * k)
        np.matmul(reset.reshape(size, k).T, da[:, 2 * k :], out=g["n"])
        np.matmul(before.reshape(size, k).T, da[:, : 2 * k], out=g["u"])
        order, keys, starts = _runs(x.reshape(-1).astype(np.uint16))
        g["x"][keys] = np.add.reduceat(np.take(da, order, axis=0, out=room("ordered", size, 3 * k), mode="clip"), starts, axis=0)
        return g, loss / size, last

    def fit(self, texts: list[np.ndarray], updates: int = 1500, rate: float = 0.01) -> list[float]:
        """Adam over windows of STEPS by LANES; each lane reads documents one after another, its state carried on."""
        if not texts:
            return []
        ids = np.concatenate(texts).astype(np.int32)
        first = np.zeros(len(ids), bool)
        first[np.cumsum([0, *(len(t) for t in texts[:-1])])] = True
        before = np.where(first, self.start, np.roll(ids, 1)).astype(np.int32)
        at = np.linspace(0, len(ids), LANES, endpoint=False).astype(int)
        h = np.zeros((LANES, HIDDEN), np.float32)
        adam, room = Adam(self.p), None
        losses = []
        for i in range(1, updates + 1):
            where = (at + np.arange(STEPS)[:, None]) % len(ids)
            at = (at + STEPS) % len(ids)
            room, loss, h = self.gradients(before[where], ids[where], first[where], h, room)
            losses.append(loss)
            adam.step(room, rate * min(1.0, i / 50) * (1 - 0.9 * i / updates))
        return losses

    def read(self, texts: Iterator[np.ndarray], rate: float = 0.003) -> int:
        """One pass of Adam over every token of texts, PORTION of them in memory at once, a longer text in several portions.
        Returns the number of tokens."""
        adam, total, held, waiting = Adam(self.p), 0, [], 0
        room = {name: np.empty_like(v) for name, v in self.p.items()}

        def learn() -> None:
            ids, before, first = (np.concatenate(c) for c in zip(*held))
            lanes = max(1, min(WIDE, len(ids) // (64 * STEPS)))
            at, h = np.linspace(0, len(ids), lanes, endpoint=False).astype(int), np.zeros((lanes, HIDDEN), np.float32)
            for t in range(0, -(-len(ids) // lanes), STEPS):
                where = (at + t + np.arange(STEPS)[:, None]) % len(ids)
                h = self.gradients(before[where], ids[where], first[where], h, room)[2]
                adam.step(room, rate * min(1.0, (adam.i + 1) / 50))

        for text in texts:
            for i in range(0, len(text), PORTION):
                ids = text[i : i + PORTION].astype(np.int32)
                first = np.zeros(len(ids), bool)
                first[0] = i == 0
                held.append((ids, np.concatenate([[text[i - 1] if i else self.start], ids[:-1]]).astype(np.int32), first))
                total, waiting = total + len(ids), waiting + len(ids)
                if waiting >= PORTION:
                    learn()
                    held.clear()
                    waiting = 0
        if held:
            learn()
        return total

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each whole text. Texts run side by side, longest first, window after window, and those
        that have ended drop out; a state is carried from a text's first token to its last."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        out = np.zeros(len(texts))
        for i in range(0, len(order), ABREAST):
            some = order[i : i + ABREAST]
            out[some] = self.abreast([texts[j] for j in some])
        return out

    def abreast(self, texts: list[np.ndarray]) -> np.ndarray:
        """`score` of texts in order of their lengths, longest first."""
        sizes = np.array([len(t) for t in texts])
        flat, starts = np.concatenate(texts), np.cumsum(sizes) - sizes
        total, h = np.zeros(len(texts)), np.zeros((len(texts), HIDDEN), self.p["u"].dtype)
        longest = int(sizes[0])
        live = np.searchsorted(-sizes, -np.arange(longest), "left").tolist()  # texts longer than t
        k, u = HIDDEN, self.p["u"] * 0.5
        for t0 in range(0, longest, STEPS):
            counts = live[t0 : t0 + STEPS]
            n = counts[0]
            # A window's places in flat, those past a text's end too, which no state is made of.
            at = np.minimum(starts[:n] + np.arange(t0, t0 + len(counts))[:, None], len(flat) - 1)
            x = flat[at - 1]
            if not t0:
                x[0] = self.start
            a, held = self.inputs(x), self.room("states", sum(counts), k)
            zr, candidates, rh = self.room("gates", n, 2 * k), self.room("candidates", n, k), self.room("reset", n, k)
            end = 0
            for t, n in enumerate(counts):
                h = self.moved(a[t, :n], h[:n], held[end : end + n], zr[:n], candidates[:n], rh[:n], u)
                end += n
            h = h.copy()
            got, end = self.log_probs(held, flat[np.concatenate([row[:n] for row, n in zip(at, counts)])]), 0
            for n in counts:
                total[:n] += got[end : end + n]
                end += n
        return total


def model_ids(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(h, ids): a hash of the row, and the model ids of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value.prepare()
        for b in batches:
            for i, words, starts in cut(b.column(1)):
                ids, _, cuts, *_ = v.look_up(words, starts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(cuts) - 1), _packed(ids, cuts)], ["h", "ids"])

    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text")).mapInArrow(run, "h long, ids binary")


def training_ids(docs: DataFrame, shared, share: float, most: int, id_col: str, text_col: str) -> list[np.ndarray]:
    """Model ids of texts chosen by a hash of the row, `most` of them at most: about `share` of all texts come to the driver, a
    partition at a time, until it has enough. What a long text has beyond that is cut off here."""
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("lm")), F.lit(1_000_000)) < int(share * 1_000_000))
    cut = model_ids(some, shared, id_col, text_col).select("h", F.substring("ids", 1, 2 * most).alias("ids"))
    out: list[np.ndarray] = []
    for r in cut.orderBy("h", "ids").toLocalIterator():
        out.append(np.frombuffer(bytes(r.ids), "<u2")[:most])
        most -= len(out[-1])
        if most <= 0:
            break
    return sorted(out, key=lambda x: x.tobytes())


def pass_over(docs: DataFrame, shared, model: Recurrent, total: int, id_col: str, text_col: str, ids: DataFrame | None = None) -> int:
    """Every token of docs (ids: what `model_ids` gives of them, if that is there already) goes through truncated backpropagation once; returns how many did.

    Learners, one for about OWN of the `total` tokens, start from the model and read their rows, which a hash gives them
    whatever the split of the input. The model becomes the mean of theirs, each weighing as its tokens: summed slice by
    slice, so that one model's worth of rows comes to the driver.
    """
    if not total:
        return 0
    start = docs.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Recurrent(start.value.words)
        own.p = {name: v.copy() for name, v in start.value.p.items()}
        n = own.read(np.frombuffer(x, "<u2") for b in batches for x in b.column(0).to_pylist())
        if n:
            flat = np.concatenate([v.reshape(-1) for v in own.p.values()])
            parts = [flat[i : i + SLICE].astype("<f4").tobytes() for i in range(0, len(flat), SLICE)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([part] * len(parts), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["slice", "learner", "n", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for i, n, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = sums.setdefault(i, [0, 0.0])
                own[0], own[1] = own[0] + n, own[1] + np.frombuffer(w, "<f4").astype(np.float64) * n
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([w.tobytes() for _, w in sums.values()], pa.binary())], ["slice", "n", "w"])

    ids = model_ids(docs, shared, id_col, text_col) if ids is None else ids
    rows = ids.repartition(-(-total // OWN), "h").sortWithinPartitions("h", "ids").select("ids")
    learned = stored(rows.mapInArrow(learn, "slice int, learner int, n long, w binary"), "lm-learned")
    summed = learned.repartition("slice").sortWithinPartitions("slice", "learner").select("slice", "n", "w").mapInArrow(add, "slice int, n long, w binary")
    got = sorted(summed.collect(), key=lambda r: r.slice)
    flat, at = np.concatenate([np.frombuffer(r.w, "<f8") / r.n for r in got]).astype(np.float32), 0
    for name, v in model.p.items():
        model.p[name] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return got[0].n


def scored(docs: DataFrame, learn: Column, sample_tokens: int = 400_000, id_col: str = "doc_id", text_col: str = "text", updates: int = 1500) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    learn: which rows are learned from. Their tokens are all counted; the recurrent model is first fitted on `sample_tokens`
    of them in expectation, twice as many at most, and then reads all of them once. A null text is an empty one, whose end
    alone is scored. Repeated rows stay; other columns are not read. Nothing to learn from: counts of zero and an untrained model. A word outside the model's own has its rare class's
    probability times its share (c + 0.5) of the class, one place of 0.5 standing for all that is unseen.
    """
    spark = docs.sparkSession
    counts = stored(token_counts(docs.where(learn), text_col), "lm-counts")
    v = vocabulary(counts)
    spread = spark.sparkContext.broadcast(v)
    model = Recurrent(v.words)
    model.fit(training_ids(docs.where(learn), spread, min(1.0, sample_tokens / max(1, v.total)), 2 * sample_tokens, id_col, text_col), updates)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "h", "learned", "doc_id", "n_tokens", "known", "base", "own", "ids", "token", "n"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), None, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = spread.value.prepare()
        row, log_rare, floor = TaskContext.get().partitionId() << 36, np.log10(v.rare_weight), np.log10(v.total + 0.5 * (v.distinct + 1))
        log_count = np.append(v.log_count, 0.0)  # the last: that of no rank
        for b in batches:
            own_kinds = dict(zip(names, kinds)) | {"doc_id": b.schema.field(2).type}
            for i, words, starts in cut(b.column(3)):
                ids, ranks, cuts, codes, odd = v.look_up(words, starts)
                n, at = len(cuts) - 1, cuts[:-1]
                sizes, told, rare = np.diff(cuts), log_count[ranks], ids >= v.words
                own = np.where(rare, told - log_rare[np.where(rare, ids - v.words, 0)], 0.0)
                base, known = np.add.reduceat(told, at) - sizes * floor, np.add.reduceat((ranks >= 0).astype(np.int64), at)
                yield _batch(
                    own_kinds, row=np.arange(row, row + n), h=b.column(0).slice(i, n), learned=b.column(1).slice(i, n), doc_id=b.column(2).slice(i, n),
                    n_tokens=sizes, known=known, base=base, own=np.add.reduceat(own, at), ids=_packed(ids, cuts),
                )
                if len(codes):
                    pairs, times = np.unique(np.repeat(np.arange(n), sizes)[ranks < 0] * len(odd) + codes, return_counts=True)
                    yield _batch(own_kinds, row=row + pairs // len(odd), token=odd.take(pa.array(pairs % len(odd))), n=times)
                row += n

    ddl = f"row long, h long, learned boolean, doc_id {kind}, n_tokens long, known long, base double, own double, ids binary, token binary, n long"
    read = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.coalesce(learn, F.lit(False)).alias("learned"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )
    # Every text is cut into tokens and looked up once, for the pass and for the scores.
    made = stored(read.mapInArrow(run, ddl), "lm-ids")
    pass_over(docs.where(learn), spread, model, v.total, id_col, text_col, made.where("learned").select("h", "ids"))
    both = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = both.value.score([np.frombuffer(x, "<u2").astype(np.int32) for x in b.column(4).to_pylist()])
            score = found / np.log(10) + b.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], b.column(6), pa.array(score)], ["row", "doc_id", "n_tokens", "known", "base", "score"])

    texts = made.where("token IS NULL").select("row", "doc_id", "n_tokens", "known", "ids", "own", "base")
    scores = stored(texts.mapInArrow(score, f"row long, doc_id {kind}, n_tokens long, known long, base double, score double"), "lm-scores")
    tail = made.where("token IS NOT NULL").select("row", "token", "n").join(counts, "token", "left")
    tail = tail.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("also"))
    out = scores.join(tail, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def _batch(kinds: dict[str, pa.DataType], **columns: object) -> pa.RecordBatch:
    n = len(columns["row"])
    arrays = [pa.nulls(n, k) if (c := columns.get(x)) is None else c if isinstance(c, pa.Array) else pa.array(c, k) for x, k in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


def _query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 5) == 1
    found = scored(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable] = {"op8_gru_score": _query}
SQL: dict[str, str] = {}
