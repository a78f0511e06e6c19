"""Token files: canonical length-limited Huffman codes of global counts, in independent blocks with bit-offset checkpoints."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, sliced, stored
from .tokens import ids_of

#: The longest code in bits; a decoding table has 1 << LIMIT cells.
LIMIT = 16
#: Ids between checkpoints, and about the ids of a block.
EVERY, BLOCK = 64, 1 << 18
#: Ids of a part at most, about, where there are `total` of them: more ids, more parts.
PART = 1 << 26
MAGIC, TABLE = b"HUFB", b"HUFT"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for an id without a count."""
    ids = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.uint8)
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids need codes of more than {limit} bits")
    if len(ids) == 1:
        lengths[ids] = 1
    if len(ids) < 2:
        return lengths
    ids = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[ids].astype(np.float64)
    # Each level: the coins of this size and the packages of two of the level before, in order of weight. Of a level it is
    # enough to know which places are coins; how many coins of each level are bought follows from the top down.
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weight))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    buy = 2 * (len(ids) - 1)
    for coins in reversed(levels):
        n = int(coins[:buy].sum())
        lengths[ids[:n]] += 1
        buy = 2 * (buy - n)
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by id."""
    out, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.nonzero(lengths == n)[0]
        code <<= n - last
        out[own] = code + np.arange(len(own), dtype=np.uint32)
        code, last = code + len(own), n
    return out


def decoding_table(lengths: np.ndarray) -> np.ndarray:
    """For each LIMIT leading bits: the id times 32 plus its code's length."""
    table, code = np.zeros(1 << LIMIT, np.uint32), codes(lengths)
    for n in range(1, LIMIT + 1):
        own = np.nonzero(lengths == n)[0]
        width = 1 << (LIMIT - n)
        first = (code[own].astype(np.int64) << (LIMIT - n))[:, None] + np.arange(width)
        table[first] = (own.astype(np.uint32) * 32 + n)[:, None]
    return table


def encode_block(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> bytes:
    """MAGIC, number of ids, number of bits; a 32-bit bit offset for each EVERY ids; then the bits, the first one highest."""
    n = lengths[ids].astype(np.int64)
    if len(n) and not n.min():
        raise ValueError("an id without a code")
    ends = np.cumsum(n)
    at, bits = ends - n, int(ends[-1]) if len(ends) else 0
    words = bits // 32 + 2
    word, shift = at >> 5, 64 - (at & 31) - n
    put = code[ids].astype(np.uint64) << shift.astype(np.uint64)
    # A code lies in two words at most, and no two codes share a bit: sums of up to 32 bits are exact in a double.
    high = np.bincount(word, (put >> np.uint64(32)).astype(np.float64), words)
    low = np.bincount(word + 1, (put & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return MAGIC + struct.pack("<IQ", len(ids), bits) + at[::EVERY].astype("<u4").tobytes() + (high + low).astype(np.uint64).astype(">u4").tobytes()


def decode_block(block: bytes, table: np.ndarray) -> np.ndarray:
    """The ids of a block. All stretches between checkpoints are decoded side by side, a table look-up for each id."""
    if block[:4] != MAGIC:
        raise ValueError("not a block")
    n, bits = struct.unpack_from("<IQ", block, 4)
    lanes = -(-n // EVERY)
    at = np.frombuffer(block, "<u4", lanes, 16).astype(np.int64)
    data = np.frombuffer(block, np.uint8, offset=16 + 4 * lanes)
    if len(data) != 4 * (bits // 32 + 2):
        raise ValueError("a block is cut short")
    out = np.empty((EVERY, lanes), np.uint32)
    for i in range(EVERY):
        live = lanes - (i >= (n - 1) % EVERY + 1) if n else 0  # the last stretch may be shorter
        a = at[:live]
        byte = a >> 3
        window = (data[byte].astype(np.uint32) << 16) | (data[byte + 1].astype(np.uint32) << 8) | data[byte + 2]
        cell = table[(window >> (8 - (a & 7)).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1)]
        out[i, :live] = cell >> 5
        a += cell & 31
    return out.T.reshape(-1)[:n]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids): the ids of every whole text and end_id, little-endian in `ids`, 16 bits each where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        width = ids.width
        end = end_id.to_bytes(width, "little")
        for b in sliced(batches):
            found = [x + end for x in ids.many(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // width for x in found], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def _unpacked(column: pa.Array, counts: pa.Array) -> Iterator[np.ndarray]:
    for data, n in zip(column.to_pylist(), counts.to_pylist()):
        yield np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs. A vocabulary's worth of rows comes to the driver: no more than a code can be made for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for ids in _unpacked(b.column(1), b.column(0)):
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
        at = np.nonzero(total)[0]
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["id", "n"])

    rows = tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = rows.limit((1 << LIMIT) + 1).toArrow()
    if got.num_rows > 1 << LIMIT:
        raise ValueError("too many different ids for codes of this length")
    out = np.zeros(max(got.column("id").to_pylist(), default=-1) + 1, np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


BLOCK_DDL = "part int, block int, doc_ids array<long>, lengths array<long>, start long, n_ids long, data binary"


def table_bytes(lengths: np.ndarray) -> bytes:
    """TABLE, LIMIT, number of ids, then a byte for each id: its code's length. The codes are canonical."""
    return TABLE + struct.pack("<II", LIMIT, len(lengths)) + lengths.astype(np.uint8).tobytes()


def table_lengths(data: bytes) -> np.ndarray:
    limit, n = struct.unpack_from("<II", data, 4)
    if data[:4] != TABLE or limit != LIMIT or len(data) != 12 + n:
        raise ValueError("not a table of code lengths")
    return np.frombuffer(data, np.uint8, n, 12)


def write_blocks(tokens: DataFrame, lengths: np.ndarray, total: int = 0) -> DataFrame:
    """A stored table of blocks, and of one row more, part -1, whose data are the code lengths; documents in ascending doc_id order (nulls first; rows of one id in order of their ids).

    Each part is a range of doc_ids; rows that repeat an id may lie in several, in the order of their numbers of ids. A block holds whole documents, about BLOCK ids of them, and can be decoded alone;
    `start` counts the ids before it in its part. Columns: part, block, doc_ids, lengths, start, n_ids, data.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, code = shared.value, codes(shared.value)
        part, block, before, docs, held, waiting = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def made() -> pa.RecordBatch:
            ids = np.concatenate(held)
            columns = [[part], [block], [docs], [[len(x) for x in held]], [before], [len(ids)], [encode_block(ids, length, code)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "block", "doc_ids", "lengths", "start", "n_ids", "data"])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), _unpacked(b.column(2), b.column(1))):
                docs.append(doc)
                held.append(ids)
                waiting += len(ids)
                if waiting >= BLOCK:
                    yield made()
                    block, before, docs, held, waiting = block + 1, before + waiting, [], [], 0
        if held:
            yield made()

    n = max(1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    place = tokens.withColumn("place", F.spark_partition_id())
    ordered = place.repartitionByRange(n, "doc_id", "n", "place").sortWithinPartitions("doc_id", "n", "place", "ids").drop("place")
    table = tokens.sparkSession.createDataFrame([(-1, 0, [], [], 0, 0, table_bytes(lengths))], BLOCK_DDL)
    return stored(ordered.mapInArrow(run, BLOCK_DDL).union(table), "token-blocks", compression="none")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in a table of blocks, from that table alone; start: ids of all documents before it; ids little-endian 32-bit."""
    spark = blocks.sparkSession
    lengths = table_lengths(bytes(blocks.where("part = -1").first().data))
    blocks = blocks.where("part >= 0")
    # One row per part: as many as there are partitions, whatever the data's size.
    sums = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    starts, total = {}, 0
    for part, n in sums:
        starts[part], total = total, total + n
    shared = spark.sparkContext.broadcast((starts, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, length = shared.value
        table = decoding_table(length)
        for b in batches:
            for r in b.to_pylist():
                ids = decode_block(r["data"], table).astype("<u4")
                ends = np.cumsum(r["lengths"])
                begin = ends - np.array(r["lengths"])
                found = [ids[i:j].tobytes() for i, j in zip(begin, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(begin + (first[r["part"]] + r["start"])), pa.array(found, pa.binary())], ["doc_id", "start", "ids"])

    return blocks.select("part", "start", "doc_ids", "lengths", "data").mapInArrow(run, "doc_id long, start long, ids binary")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encodes every row of docs, writes the blocks, and gives what they hold: (doc_id, start, ids).

    A null or empty text is end_id alone; repeated rows stay; other columns are not read; an empty table has no block.
    """
    tokens = stored(tokenized(docs, tokenizer, end_id), "token-ids", compression="zstd")
    counts = id_counts(tokens)
    return read_blocks(write_blocks(tokens, code_lengths(counts), int(counts.sum())))


def _query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = write_and_read(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable] = {"op10_huffman_ids": _query}
SQL: dict[str, str] = {}
