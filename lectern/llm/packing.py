"""Packing documents into sequences: full windows are cut off, the rest is packed by multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, sliced
from .tokens import ids_of

_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k near-equal groups of the sizes' indexes (Karmarkar-Karp): a heap of partial partitions; the two with the largest
    spread are merged, large parts with small ones, and only the difference to the least part is kept. Parts of zero aren't
    listed while there are fewer items than k.

    A part is one number, its size above its node's; a node is an item or a pair of nodes. So parts sort as numbers, and no
    list of members is copied before the end.
    """
    bits = (2 * len(sizes)).bit_length()
    low = (1 << bits) - 1
    heap = [(-n, i, [n << bits | i]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    pairs: list[tuple[int, int]] = []
    made = node = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # Ascending lists: the largest of one meet the other's zeros, which aren't listed, and stay as they are.
        both = len(a) + len(b) - k
        if both > 0:
            parts = a[both:] + b[both:]
            for x, y in zip(a[:both], reversed(b[:both])):
                pairs.append((x & low, y & low))
                parts.append(x - (x & low) + y - (y & low) | node)
                node += 1
        else:
            parts = a + b
        parts.sort()
        if len(parts) == k and (least := parts[0] >> bits << bits):
            parts = [x - least for x in parts]
        heapq.heappush(heap, (-(parts[-1] >> bits), made, parts))
        made += 1
    groups = []
    for part in reversed(heap[0][2] if heap else []):
        group, stack = [], [part & low]
        while stack:
            if (x := stack.pop()) < len(sizes):
                group.append(x)
            else:
                stack.extend(pairs[x - len(sizes)])
        groups.append(group)
    return groups


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most `capacity`: as few as the sum allows, and one more each time that a group comes out too large."""
    if any(n > capacity for n in sizes):
        raise ValueError("a piece exceeds the capacity")
    k = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, max(1, k))
        if all(sum(sizes[i] for i in g) <= capacity for g in found):
            return found
        k += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group: int = 160, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document is its text's ids and end_id. Its full windows are sequences of their own; what is left of documents that are
    read together, `group` windows' worth at a time, is divided by differencing. So a task needs no other task's rows: there
    is no shuffle, memory is bounded, and a task that runs again gives the same pieces. sequence_id holds the partition in
    its upper bits. A null or empty text is end_id alone; repeated rows are packed repeatedly; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        base, made = TaskContext.get().partitionId() << 36, 0
        pool: list[tuple] = []
        pooled = volume = 0
        out: list[tuple] = []

        def divided() -> Iterator[tuple]:
            nonlocal made
            for members in windows([p[2] for p in pool], capacity):
                at = 0
                for i in sorted(members):
                    doc, start, n, total, data = pool[i]
                    yield doc, start, n, total, base + made, at, data
                    at += n
                made += 1

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
            out.clear()
            return batch

        for b in sliced(batches):
            for doc, data in zip(b.column(0).to_pylist(), ids.many(b.column(1).to_pylist())):
                all_ids = np.append(np.frombuffer(data, ids.kind).astype("<u4"), np.uint32(end_id)).astype("<u4")
                n = len(all_ids)
                for start in range(0, n - capacity + 1, capacity):
                    out.append((doc, start, capacity, n, base + made, 0, all_ids[start : start + capacity].tobytes()))
                    made, volume = made + 1, volume + capacity
                if rest := n % capacity:
                    pool.append((doc, n - rest, rest, n, all_ids[n - rest :].tobytes()))
                    pooled += rest
                if pooled >= group * capacity:
                    out.extend(divided())
                    pool, volume, pooled = [], volume + pooled, 0
                if volume >= 1 << 20:
                    yield flushed()
                    volume = 0
        out.extend(divided())
        if out:
            yield flushed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DDL)


def _query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable] = {"op5_kk_packing": _query}
SQL: dict[str, str] = {}
