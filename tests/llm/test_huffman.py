import heapq
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import huffman

DDL = "doc_id long, text string, start string, ids string, n string"


def best_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_code_lengths():
    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = rng.integers(0, 50, rng.integers(2, 300))
        n = huffman.code_lengths(counts)
        assert (n * counts).sum() == best_cost(counts) or n.max() == huffman.LIMIT
        assert sum(2.0 ** -int(x) for x in n if x) <= 1
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    n = huffman.code_lengths(np.array(fib))
    assert n.max() == huffman.LIMIT and sum(2.0 ** -int(x) for x in n) == 1
    assert list(huffman.code_lengths(np.array([0, 7, 0]))) == [0, 1, 0] and not huffman.code_lengths(np.zeros(0, int)).size
    # A small limit against every way to choose lengths.
    counts = np.array([1, 2, 4, 8, 16])
    from itertools import product

    ways = min(sum(a * b for a, b in zip(w, counts)) for w in product(range(1, 4), repeat=5) if sum(2.0**-x for x in w) <= 1)
    assert (huffman.code_lengths(counts, 3) * counts).sum() == ways


def test_blocks():
    rng = np.random.default_rng(6)
    for n in (0, 1, 63, 64, 65, 1000, 70_001):
        ids = np.minimum(rng.geometric(0.01, n), 5000).astype(np.uint16)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=5001))
        block = huffman.encode_block(ids, lengths, huffman.codes(lengths))
        assert np.array_equal(huffman.decode_block(block, huffman.decoding_table(lengths)), ids)
    with pytest.raises(ValueError):
        huffman.decode_block(block[:-9], huffman.decoding_table(lengths))
    with pytest.raises(ValueError):
        huffman.encode_block(np.array([5002]), np.append(lengths, [0, 0]), huffman.codes(np.append(lengths, [0, 0])))


def test_round_trip(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, "a " * 300_000), (1003, "x"), (1003, "x"), (1004, "a <|endoftext|> b<|startoftext|>"), (1005, "longer text of one id"), (1005, "b")]
    df = spark.createDataFrame([(i, x, "p", "q", "r") for i, x in rows], DDL).repartition(3)
    got = sorted(huffman.write_and_read(df, path).collect(), key=lambda r: (r.doc_id, r.start))
    at = 0
    size = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    for (i, text), r in zip(sorted(rows, key=lambda r: (r[0], size(r[1]))), got, strict=True):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start) == (i, at) and list(array("I", bytes(r.ids))) == want
        at += len(want)
    assert huffman.write_and_read(df.limit(0), path).count() == 0


def test_blocks_are_read_from_their_files_alone(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "one two")], "doc_id long, text string")
    tokens = huffman.tokenized(df, path, 2)
    blocks = huffman.write_blocks(tokens, huffman.code_lengths(huffman.id_counts(tokens)))
    files = spark.read.schema(huffman.BLOCK_DDL).parquet(blocks.inputFiles()[0].rsplit("/", 1)[0])
    want = {r.doc_id: list(np.frombuffer(r.ids, "<u2")) for r in tokens.collect()}
    assert {r.doc_id: list(np.frombuffer(r.ids, "<u4")) for r in huffman.read_blocks(files).collect()} == want
