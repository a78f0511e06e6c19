"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, connected_components, documents, sliced, stored

SEED = 42
_STEP = 1 << 16


def _digests(data: bytes, width: int) -> Iterator[bytes]:
    """Joined 8-byte digests of the text's shingles, 65,536 at most in each part."""
    words = data.lower().split()
    if not words:
        return
    hashed = xxhash.xxh64_digest
    if len(words) < width:
        yield hashed(b" ".join(words), SEED)
        return
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    n = len(words) - width + 1
    for i in range(0, n, _STEP):
        j = min(i + _STEP, n)
        yield b"".join([hashed(line[a:b], SEED) for a, b in zip(starts[i:j], ends[i + width - 1 : j + width - 1])])


def fingerprint(data: bytes | None, width: int = 3) -> bytes:
    """8 bytes, big-endian: a bit is 1 if over half of the shingles' hashes have it. No word: zero."""
    total, n = np.zeros(64, np.int64), 0
    for part in _digests(data or b"", width):
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        n += len(bits)
        # Eight one-bit bytes are added at a time; 255 rows can't overflow a byte.
        sums = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long. Reads the two columns only; a null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = b"".join([fingerprint(t, width) for t in byte_texts(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` out of `blocks` equal blocks of these bit positions."""
    size = len(bits) // blocks
    parts = [sum(1 << b for b in bits[i * size : (i + 1) * size]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def close_pairs(classes: DataFrame, distance: int = 2, bucket: int = 64) -> DataFrame:
    """(u, v) of distinct fingerprints (column fp) that differ in `distance` bits or fewer, 0 to 2; repeats possible.

    Four blocks of 16 bits: two fingerprints within two bits agree on at least two blocks, so they share one of six 32-bit
    keys. A key with more than `bucket` fingerprints is split by the same principle: of the 32 bits that it leaves, eight
    blocks of 4 bits, six agree, which leaves 8 bits: no bucket holds over 256 distinct fingerprints. Nothing is capped.
    """
    if not 0 <= distance <= 2:
        raise ValueError("blocks are laid out for distances of 0 to 2")
    first = _masks(list(range(64)), 4, 2)

    def keyed(df: DataFrame, masks: list[int], *more: str) -> DataFrame:
        each = F.array(*(F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
        return df.select("fp", *more, F.explode(each).alias("k")).select("fp", *more, "k.b", "k.key")

    def joined(df: DataFrame, on: list[str]) -> DataFrame:
        a, b = df.alias("a"), df.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
        near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
        cond = near
        for s in same:
            cond = cond & s
        return a.join(b, cond).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    one = keyed(classes.select("fp"), first)
    hot = one.groupBy("b", "key").count().where(F.col("count") > bucket).select("b", "key", F.lit(True).alias("hot"))
    marked = stored(one.join(hot, ["b", "key"], "left").select("fp", "b", "key", F.coalesce("hot", F.lit(False)).alias("hot")), "simhash-blocks")
    plain = joined(marked.where("not hot"), ["b", "key"])
    split = None
    for i, m in enumerate(first):
        rest = [x for x in range(64) if not m >> x & 1]
        fine = keyed(marked.where(f"hot and b = {i}").select("fp"), [m | s for s in _masks(rest, 8, 6)]).withColumn("b", F.col("b") + 28 * i)
        split = fine if split is None else split.union(fine)
    return plain.union(joined(split, ["b", "key"]))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the least id reachable over links of near fingerprints.

    Equal fingerprints are one class first (pre-aggregated, so thousands of copies cost one row); only distinct ones are
    compared. Null and empty texts share fingerprint zero. Repeated rows stay repeated; other columns are not read. An empty
    table gives an empty result; rows with a null id keep it and don't lower a component's id.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = connected_components(close_pairs(classes, distance))
    linked = roots.join(classes.withColumnRenamed("fp", "node"), "node")
    low = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = roots.join(low, "root").select(F.col("node").alias("fp"), "component_id")
    named = stored(classes.join(found, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "simhash-named")
    out = _meeting(prints, named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Keys that hold a row in so many or more are joined by broadcast: there can be no more of them than that.
HOT = 1024


def _meeting(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows joined to named, a stored table with a row for each key and n, its number of rows. Keys with a HOT-th of all rows or
    more, HOT at most, go to every task, so that no group of copies is one task's; the others are shuffled."""
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = rows.sparkSession.createDataFrame(named.where(F.col("n") * HOT >= total).collect(), named.schema)
    first = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(named.where(F.col("n") * HOT < total), key)
    return first.unionByName(rest)


def _marked(docs: DataFrame, mark: Callable[[bytes | None], bytes], name: str) -> tuple[DataFrame, DataFrame]:
    """docs as a stored table with a number for each row (__row); and (__row, doc_id, __h, __mark), a hash and the mark of each
    text. No text comes back from Python."""
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            marks = pa.array([mark(t) for t in byte_texts(b.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], marks], ["__row", "doc_id", "__h", "__mark"])

    read = rows.select("__row", "doc_id", F.xxhash64("text").alias("__h"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows, stored(read.mapInArrow(run, f"__row long, doc_id {kind}, __h long, __mark binary"), f"{name}-marks")


def _first_of_each(rows: DataFrame, marks: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each component (marks: __row, __node; edges: links of nodes) exactly one of rows: that with the least id, nulls last, then
    with the least hash of its text. A shared id takes no row away."""
    roots = connected_components(edges).withColumnRenamed("node", "__node")
    # Copies are one row before anything meets their component.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h", "__row")).alias("first")
    named = marks.groupBy("__node").agg(first).join(roots, "__node", "left")
    keep = named.groupBy(F.coalesce("root", "__node").alias("c")).agg(F.min("first").alias("first")).select("first.__row")
    return rows.join(keep, "__row", "left_semi").drop("__row")


def one_of_each(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """docs without near-duplicates: of each component of near fingerprints one row."""
    rows, marks = _marked(docs, lambda t: fingerprint(t, width), "simhash-rows")
    marks = marks.withColumn("__node", F.conv(F.hex("__mark"), 16, -10).cast("long"))
    return _first_of_each(rows, marks, close_pairs(stored(marks.select(F.col("__node").alias("fp")).distinct(), "simhash-classes"), distance))


#: Words of 64 bits in a wide fingerprint; minima beside it, and how many of them make up a key of a block. Two texts of similarity
#: 0.8 share one of the MINIMA // EACH keys in 998 cases of 1,000.
WORDS, MINIMA, EACH = 16, 120, 6
_FACTORS, _SHIFTS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, MINIMA, 1), dtype=np.uint32)
_FACTORS |= np.uint32(1)
_SPREAD = np.random.default_rng(SEED + 1).integers(0, 1 << 63, WORDS - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _spread(h: np.ndarray) -> np.ndarray:
    """WORDS words of hash bits for each hash, the first of them itself."""
    more = h[:, None] * _SPREAD
    return np.hstack([h[:, None], more ^ (more >> np.uint64(32))])


def signature(data: bytes | None, width: int = 5) -> bytes:
    """The wide fingerprint of the set of shingles, 64 * WORDS bits, the first 64 those of `fingerprint` where no shingle recurs; then
    16 bits of the least of the shingles' hashes under each of MINIMA permutations. No word: zeros, then ones."""
    h = np.unique(np.frombuffer(b"".join(_digests(data or b"", width)), ">u8").astype(np.uint64))
    total, least = np.zeros(64 * WORDS, np.int64), np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 255):
        part = h[i : i + 255]
        bits = np.unpackbits(_spread(part).astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1)
        total += bits.view(np.uint64).sum(axis=0).view(np.uint8)  # 255 rows can't overflow a byte
        np.minimum(least, ((part >> np.uint64(32)).astype(np.uint32) * _FACTORS + _SHIFTS).min(axis=1), out=least)
    return np.packbits(2 * total > len(h)).tobytes() + least.astype("<u2").tobytes()


def differing(similarity: float) -> float:
    """The share of fingerprint bits in which two equally large sets of this Jaccard similarity differ: their angle over pi."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _apart(signs: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The share of differing bits, row by row; fingerprints as rows of 64-bit words."""
    return np.bitwise_count(signs ^ other).sum(axis=1) / (64 * WORDS)


#: Fingerprints that are compared with each other in one task at most. How near to a pivot (as a share of differing bits) one of a
#: larger group must be to be done with once it is linked. Rounds of pivots before blocks are compared two by two.
LIMIT, CORE, ROUNDS = 1024, 0.07, 16


def _linked(blocks: DataFrame, apart: float) -> DataFrame:
    """(u, v) for blocks (key, __node, __mark) of LIMIT rows each, about: all that is reachable over links of near fingerprints
    in a block gets linked, by as few links as that takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(nodes: list[int], marks: list[bytes]) -> None:
            left, signs = np.arange(len(nodes)), np.frombuffer(b"".join(marks), np.uint64).reshape(-1, WORDS)
            while len(left):
                front, left = [left[0]], left[1:]
                while front and len(left):
                    at = front.pop()
                    near = _apart(signs[left], signs[at]) <= apart
                    found.extend((nodes[at], nodes[j]) for j in left[near])
                    front.extend(left[near])
                    left = left[~near]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

        key, nodes, marks = None, [], []
        found: list[tuple[int, int]] = []
        for b in batches:
            for k, node, mark in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    links(nodes, marks)
                    key, nodes, marks = k, [], []
                nodes.append(node)
                marks.append(mark)
            yield batch()
            found.clear()
        links(nodes, marks)
        yield batch()

    return blocks.select("key", "__node", "__mark").repartition("key").sortWithinPartitions("key", "__node").mapInArrow(run, "u long, v long")


def _from_pivots(rows: DataFrame) -> DataFrame:
    """rows (key, __node, __mark, pivot, __pivot) with d, the share of bits in which a fingerprint differs from its key's pivot.
    Row by row: a key may lie in many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, WORDS) for i in (2, 4))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(_apart(a, z))], ["key", "__node", "__mark", "pivot", "d"])

    return rows.select("key", "__node", "__mark", "pivot", "__pivot").mapInArrow(run, "key long, __node long, __mark binary, pivot long, d double")


def _crossed(one: DataFrame, other: DataFrame) -> DataFrame:
    """Blocks in which each row of one meets each of other of its key, about LIMIT rows of either in a block."""
    sizes = [df.groupBy("key").agg(F.ceil(F.count("*") / LIMIT).cast("int").alias(n)) for df, n in ((one, "m"), (other, "n"))]
    both = sizes[0].join(sizes[1], "key")
    part = F.pmod(F.xxhash64("__node", F.lit("part")), F.col("own")).cast("int")
    out = []
    for i, (df, own, far) in enumerate(((one, "m", "n"), (other, "n", "m"))):
        rows = df.join(both, "key").select("key", "__node", "__mark", F.col(own).alias("own"), F.explode(F.sequence(F.lit(0), F.col(far) - 1)).alias("far"))
        place = (part, F.col("far")) if i == 0 else (F.col("far"), part)
        out.append(rows.select(F.xxhash64("key", *place).alias("key"), "__node", "__mark"))
    return out[0].union(out[1])


def similar_pairs(classes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(u, v): links of distinct signatures (__node, __mark) that share a block and whose wide fingerprints are within the Hamming
    distance of `similarity`; what is reachable over such links stays so.

    Blocks are the six of `close_pairs` over the first 64 bits, which no two fingerprints within two bits there escape, and, as no
    blocks of bits are narrow enough at a distance of 155 in 1,024, those of EACH minima.

    Blocks of up to LIMIT fingerprints are compared in one task. Of a larger one each is compared with a pivot, row by row.
    What differs from the pivot in CORE at most can only be near to such as differ from it in the distance + CORE at most. So
    such ones, the bulk of any large group of near copies, are linked and leave the block, and only those that are nearly
    near to the pivot meet them again, in blocks of bounded size. The rest has another pivot; after ROUNDS, blocks of
    bounded size meet each other. No group is gathered in one task, no link is given up.
    """
    size, first, apart = 2 * EACH, 8 * WORDS, differing(similarity) + 1e-9
    bits = F.conv(F.hex(F.substring("__mark", 1, 8)), 16, -10).cast("long")
    pigeonholes = [F.xxhash64(F.lit(-1 - i), bits.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(_masks(list(range(64)), 4, 2))]
    keys = F.array(*pigeonholes, *(F.xxhash64(F.lit(i), F.substring("__mark", 1 + first + size * i, size)) for i in range(MINIMA // EACH)))
    keyed = classes.select("__node", F.explode(keys).alias("key"))
    classes = classes.select("__node", F.substring("__mark", 1, first).alias("__mark"))
    # Keys of one signature only carry no link.
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    rows = keyed.join(shared, "key").join(classes, "__node").select("key", "__node", "__mark", "n")
    found = [_linked(rows.where(F.col("n") <= LIMIT), apart)]
    if shared.where(F.col("n") > LIMIT).isEmpty():
        return found[0]
    open_ = stored(rows.where(F.col("n") > LIMIT).drop("n"), "simhash-large")
    for _ in range(ROUNDS):
        counts = open_.groupBy("key").agg(F.count("*").alias("n"), F.min("__node").alias("pivot"))
        large = counts.where(F.col("n") > LIMIT).join(classes.select(F.col("__node").alias("pivot"), F.col("__mark").alias("__pivot")), "pivot").select("key", "pivot", "__pivot")
        large = stored(large, "simhash-pivots")
        found.append(_linked(open_.join(large.select("key"), "key", "left_anti"), apart))
        if large.isEmpty():
            return reduce(DataFrame.union, found)
        near = stored(_from_pivots(open_.join(large, "key")), "simhash-compared")
        found.append(near.where((F.col("d") <= apart) & (F.col("__node") != F.col("pivot"))).select(F.col("pivot").alias("u"), F.col("__node").alias("v")))
        core, edge = near.where(F.col("d") <= CORE), near.where((F.col("d") > apart) & (F.col("d") <= apart + CORE))
        if not edge.isEmpty():
            found.append(_linked(_crossed(core.join(edge.select("key").distinct(), "key", "left_semi"), edge), apart))
        open_ = near.where(F.col("d") > CORE).select("key", "__node", "__mark")
    found.append(_linked(_crossed(open_, open_), apart))
    return reduce(DataFrame.union, found)


def one_of_similar(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """docs without near copies: of each component of texts whose wide fingerprints of shingles of `width` words are near, one row."""
    rows, marks = _marked(docs, lambda t: signature(t, width), "simhash-rows")
    marks = marks.withColumn("__node", F.xxhash64("__mark"))
    classes = stored(marks.groupBy("__node").agg(F.min("__mark").alias("__mark")), "simhash-classes")
    return _first_of_each(rows, marks, similar_pairs(classes, similarity))


def _query(spark, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))


QUERIES: dict[str, Callable] = {"op7_simhash_components": _query}
SQL: dict[str, str] = {}
