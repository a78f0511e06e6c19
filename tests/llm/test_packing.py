import random
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing, tokens

DDL = "doc_id long, text string, start string, ids string, length string"
TEXTS = [None, "", " ", "\n", "a", "Hello  world\n\nfoo \n bar\tbaz\r\n end ", "it's <|endoftext|> don't stop \x1cx", "x y z", "é é İI ǅ 12 345!!! ...", " lead", "trail\n", "a\nb c\n'd", "\x85a b", "word " * 30_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_library_ids(name, monkeypatch):
    ids = tokens.Ids(public_tokenizers.path(name))
    t = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(3)
    bits = ["a", "B", ".", ",", "Foo.", "àÉ", "J", "\u030c", "Σ", "é", "'s", " ", "  ", "\n", "\t", "\r", "\x0b", "1", "!", "́", "\x1c", "\xa0", "<|endoftext|>", "ß", "漢"]
    texts = [x or "" for x in TEXTS] + ["\0a b\0 c", "İ İx", "e\u0301 \u0301a a\u0301", "a <|endoftext|> b", "x<|endoftext|>", "<|ENDOFTEXT|> <|startoftext|>a b"] + ["".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(4000)]
    monkeypatch.setattr(tokens, "_KEEP", 500)
    for text, data in zip(texts, ids.many(texts), strict=True):
        assert np.frombuffer(data, ids.kind).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_merged_without_the_library_and_not_kept(name):
    ids = tokens.Ids(public_tokenizers.path(name))
    t = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(8)
    letters = "etaoinshrdlu" * 4 + "bcfgjkmpqvwxyzABCXYZ" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    marks = ["", "", "", ".", ",", "?!", "$$$", ".***", "×", "÷", "'", "'s", "1", "*/", "漢"]
    word = lambda: "".join(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 8, 13, 23, 24, 25, 60]))) + rng.choice(marks)
    texts = [rng.choice([" ", "\n"]).join(word() for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    for text, data in zip(texts, ids.many(texts), strict=True):
        assert np.frombuffer(data, ids.kind).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    plain = [" ".join("".join(rng.choices(letters, k=9)) for _ in range(50)) for _ in range(100)]
    before = len(ids.young)
    assert [np.frombuffer(x, ids.kind).tolist() for x in ids.many(plain)] == [t.encode(x, add_special_tokens=False).ids for x in plain]
    assert len(ids.young) == before


def test_windows():
    rng = random.Random(4)
    assert packing.windows([], 10) == [] and sorted(packing.windows([10, 10], 10)) == [[0], [1]]
    for _ in range(50):
        sizes = [rng.randrange(1, 2049) for _ in range(rng.randrange(1, 400))]
        found = packing.windows(sizes, 2048)
        assert sorted(i for g in found for i in g) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in g) <= 2048 for g in found)
    # Differencing gives 16 and 14: over a capacity of 15 the count rises.
    assert len(packing.windows([4, 5, 6, 7, 8], 16)) == 2 and len(packing.windows([4, 5, 6, 7, 8], 15)) == 3
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.differencing([8, 7, 6, 5, 4], 3)) == [8, 11, 11]


def test_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    fixture = [(r.doc_id + 100, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [*enumerate(TEXTS), *fixture]
    df = spark.createDataFrame([(i, x, "p", "q", "r") for i, x in rows], DDL).repartition(2)
    got = packing.pack(df, path).collect()
    seen, filled = {}, {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in rows:
        own = sorted(seen[i], key=lambda r: r.start)
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert list(array("I", b"".join(bytes(r.ids) for r in own))) == want
        assert all(r.doc_tokens == len(want) and r.length * 4 == len(r.ids) for r in own)
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(r.length for r in got) >= 0.9 * 2048 * len(filled)
    assert packing.pack(df.limit(0), path).count() == 0
