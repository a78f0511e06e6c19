"""Token ids of whole texts by the tokenizers library, with the ids of recurring chunks kept."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any kind other than the six ASCII characters that Python, Unicode and the tokenizers all agree on.
_ODD = tuple(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
_CHUNKS = re.compile(r"\s*\S+|\s+")
#: Chunks kept in each of two generations; memory stays bounded however many different ones a task meets.
_KEEP = 500_000
#: Texts that are looked up together: so many characters, about. How many new chunks the library encodes at a time.
_VOLUME, _JOINED = 1 << 21, 2000


class _Merges:
    """Byte pair merging of many chunks side by side, as the library does it for each: of its pairs the one of the least rank is
    merged, the leftmost of equal ones, until no pair has a rank.

    Chunks of Latin-1 letters and then ASCII marks, after a zero byte or a line break perhaps: both kinds of vocabulary cut such a
    one between letters and marks and after the line break, but for contractions, so the apostrophe is none of the marks."""

    #: Rounds are as many as the longest chunk has bytes; longer ones are left to the library.
    LONGEST = 24
    NONE, NEVER, PLACE, CUT = 0xFFFF, 1 << 30, 32, 0xFF
    LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B)]
    MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]

    def __init__(self, model: dict, lower: bool):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        spelled = _spelled_bytes()
        self.inner = np.array([vocab.get(spelled[b], self.NONE) for b in range(256)], np.uint32)
        self.last = np.array([vocab.get(spelled[b] + end, self.NONE) for b in range(256)], np.uint32)
        self.inner[self.CUT] = self.last[self.CUT] = self.NONE
        self.letter, self.mark = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[self.LETTERS[26:] if lower else self.LETTERS] = self.mark[self.MARKS] = True
        # Second bytes of letters from À on, or from ß on: what lower case would change isn't of this kind.
        self.least = 0x9F if lower else 0x80
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[x + y] for x, y in pairs], np.uint32)
        ranks = {vocab[x] << 16 | vocab[y]: i for i, (x, y) in enumerate(pairs)}
        bits = (8 * len(pairs)).bit_length()
        self.shift, size = np.uint32(32 - bits), 1 << bits
        self.keys, self.ranks = np.full(size, 0xFFFFFFFF, np.uint32), np.full(size, self.NEVER, np.int64)
        for key, rank in ranks.items():
            at = (key * 2654435761 & 0xFFFFFFFF) >> (32 - bits)
            while self.keys[at] != 0xFFFFFFFF:
                at = (at + 1) % size
            self.keys[at], self.ranks[at] = key, rank

    @classmethod
    def of(cls, path: str, lower: bool) -> _Merges | None:
        """None for models of any other kind."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or not model["merges"] or max(model["vocab"].values()) >= cls.NONE:
            return None
        found = cls(model, lower)
        used = [0x0A, 0x20, *cls.LETTERS, *cls.MARKS, *range(0x80, 0xC0), 0xC3]
        return found if (found.inner[used] != cls.NONE).all() and (found.last[used] != cls.NONE).all() else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.uint32(16) | right
        at = (key * np.uint32(2654435761)) >> self.shift
        there = self.keys[at]
        found = np.where(there == key, self.ranks[at], self.NEVER)
        more = np.nonzero((there != key) & (there != 0xFFFFFFFF))[0]
        while len(more):
            at[more] = (at[more] + 1) % len(self.keys)
            there = self.keys[at[more]]
            same = there == key[more]
            found[more[same]] = self.ranks[at[more[same]]]
            more = more[~same & (there != 0xFFFFFFFF)]
        return found

    def many(self, chunks: pa.LargeStringArray, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which chunks are of this kind, how many ids each has (others 0), and all ids. With `spaces`, one that starts with neither
        a zero byte nor a line break has a space before it."""
        cuts = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
        starts, lengths = cuts[:-1] - cuts[0], np.diff(cuts)
        lead = data[starts]
        lead = np.where((lead == 0) | (lead == 10), lead, self.CUT) if spaces else np.full(len(starts), self.CUT, np.uint8)
        letter = self.letter[data]
        pair = (data[:-1] == 0xC3) & (data[1:] >= self.least) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[:-1] |= pair
        letter[1:] |= pair
        letter[starts[lead != self.CUT]] = True
        # Letters before the first mark, counted with what leads.
        word = np.minimum(np.minimum.reduceat(np.where(letter, len(data), np.arange(len(data))), starts) - starts, lengths)
        marks = np.append(0, np.cumsum(self.mark[data]))
        fits = (word > (lead != self.CUT)) & (marks[starts + lengths] - marks[starts + word] == lengths - word) & (lengths <= self.LONGEST)
        sizes = np.zeros(len(starts), np.int64)
        if not fits.any():
            return fits, sizes, np.zeros(0, np.uint16)
        data, lead, word, lengths = data[np.repeat(fits, lengths)], lead[fits], word[fits], lengths[fits]
        starts = np.cumsum(lengths) - lengths
        # A cut stands before each chunk, between its letters and marks, and after a line break; a zero byte is one itself.
        more = np.zeros(len(data) + 1, np.int64)
        more[starts] = np.where(lead == self.CUT, 1 + spaces, (lead == 10).astype(np.int64))
        more[(starts + word)[word < lengths]] += 1
        more[starts[lead == 10] + 1] += 1
        to = np.cumsum(more[:-1]) + np.arange(len(data))
        line = np.full(len(to) + int(more[:-1].sum()) + 1, self.CUT, np.uint8)
        line[to] = data
        begins = to[starts]
        line[begins[lead == 0]] = self.CUT
        if spaces:
            begins = begins - (lead == self.CUT)
            line[begins[lead == self.CUT]] = 32
        symbols, live = self._merged(line)
        sizes[fits] = np.add.reduceat(live, begins, dtype=np.int64)
        return fits, sizes, symbols[live].astype(np.uint16)

    def _merged(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of bytes between cuts after all merges, and which places still have one. A cut has no rank with anything."""
        live = line != self.CUT
        symbols = np.where(live & ~np.append(live[1:], False), self.last[line], self.inner[line])
        starts = np.nonzero(live & ~np.append(False, live[:-1]))[0]
        place = np.arange(len(line))
        after, before = place + 1, place - 1
        never = self.NEVER << self.PLACE
        order = np.full(len(line), never)
        order[:-1] = self._rank(symbols[:-1], symbols[1:]) << self.PLACE | place[:-1]
        while True:
            best = np.minimum.reduceat(order, starts)
            best = best[best < never]
            if not len(best):
                return symbols, live
            at = best & ((1 << self.PLACE) - 1)
            gone = after[at]
            right, left = after[gone], before[at]
            new = self.made[best >> self.PLACE]
            symbols[at], live[gone], order[gone], after[at], before[right] = new, False, never, right, at
            order[at] = self._rank(new, symbols[right]) << self.PLACE | at
            order[left] = self._rank(symbols[left], new) << self.PLACE | left


class Ids:
    """many(texts): each text's ids as little-endian bytes, 16 or 32 bits each (`width` bytes), equal to the library's ids of
    the whole text, add_special_tokens=False. A special token's string in a text is that token, as the library has it, or
    ordinary text with special_as_text.

    Both kinds of vocabulary here cut a text before white space that follows something else, whatever stands on either side
    (byte-level ones keep the white space with what follows, word-end ones drop it), so a text's ids are those of its chunks.
    The new chunks of some texts are encoded in one call, as a text of their own, and told apart by their offsets. Where odd
    white space might be cut otherwise, or a special token's string stands in the text, the whole text is encoded at once.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.encode_special_tokens = special_as_text
        added = [] if special_as_text else list(t.get_added_tokens_decoder().values())
        self.marks, self.whole = [x.content for x in added], any(x.normalized for x in added)
        self.width = 2 if t.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        self.spaces = t.normalizer is None
        self.lower = not self.spaces and t.normalizer.normalize_str("AÀ") == "aà"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.merges = _Merges.of(path, self.lower) if self.width == 2 and sys.byteorder == "little" else None
        if self.merges is not None:
            words = ["a", "Word", "UPPER", "straße", "qzxj", "internationals", *map(chr, _Merges.LETTERS), *(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
            marks = ["", ".", ".###", '")', "_-", *map(chr, _Merges.MARKS)]
            keys = [x + w + m for x in ("", "\0", "\n") if self.spaces or not x for i, w in enumerate(words) for m in marks[: None if i < 3 else 3]]
            keys = [k.lower() for k in keys] if self.lower else keys
            fits, sizes, flat = self.merges.many(pa.array(keys, pa.large_string()), self.spaces)
            if not fits.all() or b"".join([self.encode(self._spelled(k)) for k in keys]) != flat.tobytes():
                self.merges = None

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _line(self, text: str) -> str | None:
        """The text with one space between its chunks; None where its white space isn't that plain."""
        if any(x in text for x in _UNEVEN) or text[0] in " \n" or text[-1] in " \n":
            return None
        if self.spaces:
            # Spaces are left out and put back before what needs one: a key that starts with white space has its own.
            return text.replace("\n", " \n")
        return self._folded(text).replace("\n", " ")

    def _folded(self, text: str) -> str:
        # Lower case is these vocabularies' own. Within Latin-1 no composition can come between, so it is taken first.
        return text.lower() if self.lower and (text.isascii() or len(text.encode("latin-1", "ignore")) == len(text)) else text

    def _chunks(self, text: str) -> list[str]:
        if not self.spaces:
            return self._folded(text).split()
        first, *rest = _CHUNKS.findall(text)
        return [first if first[0].isspace() else "\0" + first, *rest]

    def _spelled(self, key: str) -> str:
        """The text of a key. Byte-level keys: after a zero byte as it is (a text's first chunk), else with a space unless
        white space leads."""
        if not self.spaces:
            return key
        return key[1:] if key[0] == "\0" else key if key[0].isspace() else " " + key

    def _encode_all(self, keys: list[str]) -> dict[str, bytes]:
        out = {}
        texts = [self._spelled(k) for k in keys]
        joined = [i for i, x in enumerate(texts) if not self.spaces or (x[0].isspace() and not x[-1].isspace())]
        alone = set(range(len(keys))).difference(joined)
        for i in range(0, len(joined), _JOINED):
            part = joined[i : i + _JOINED]
            glue = "" if self.spaces else " "
            sizes = np.array([len(texts[j]) + len(glue) for j in part])
            found = self.tokenizer.encode(glue.join(texts[j] for j in part), add_special_tokens=False)
            ids = np.array(found.ids, self.kind)
            begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
            cuts = np.searchsorted(begins, np.cumsum(sizes)).tolist()
            data, a, w = ids.tobytes(), 0, self.width
            for j, z in zip(part, cuts):
                if z == a:
                    alone.add(j)  # no token of its own starts here: it is asked alone
                out[keys[j]] = data[a * w : z * w]
                a = z
        for j in alone:
            out[keys[j]] = self.encode(texts[j])
        return out

    def many(self, texts: list[str | None]) -> Iterator[bytes]:
        part, volume = [], 0
        for t in texts:
            part.append(t or "")
            volume += len(part[-1])
            if volume >= _VOLUME:
                yield from self._together(part)
                part, volume = [], 0
        yield from self._together(part)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        """Plain texts are cut, their chunks numbered and their ids put in place as arrays; only different chunks are Python's."""
        kinds = [self._kind(t) for t in texts]
        lines = [(i, x) for i, t in enumerate(texts) if kinds[i] and (x := self._line(t)) is not None]
        out: dict[int, bytes] = {}
        if lines:
            # A text's first chunk has a zero byte before it where it matters.
            line = "\0" + " \0".join([x for _, x in lines]) if self.spaces else " ".join([x for _, x in lines])
            chunks = pc.split_pattern(pa.array([line], pa.large_string()), " ").flatten().dictionary_encode()
            number, (flat, sizes, starts) = chunks.indices.to_numpy(), self._numbered(chunks.dictionary)
            n = sizes[number]
            ends = np.cumsum(n)
            places = np.repeat(starts[number] - (ends - n), n)
            places += np.arange(len(places))
            data = flat[places].tobytes()
            cuts = (ends[np.cumsum([x.count(" ") + 1 for _, x in lines]) - 1] * self.width).tolist()
            out = {i: data[a:z] for (i, _), a, z in zip(lines, [0, *cuts], cuts)}
        for i, t in enumerate(texts):
            if i in out:
                yield out[i]
            elif kinds[i]:
                yield b"".join(self._found(self._chunks(t)))
            else:
                yield self.encode(t) if t else b""

    def _numbered(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each chunk how many and where they start."""
        fits, sizes, flat = self.merges.many(chunks, self.spaces) if self.merges is not None else (np.zeros(len(chunks), bool), np.zeros(len(chunks), np.int64), np.zeros(0, self.kind))
        starts, rest = np.cumsum(sizes) - sizes, np.nonzero(~fits)[0]
        if len(rest):
            found = self._found(chunks.take(pa.array(rest)).to_pylist())
            sizes[rest] = n = np.fromiter(map(len, found), np.int64, len(found)) // self.width
            starts[rest] = len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, np.frombuffer(b"".join(found), self.kind)])
        return flat, sizes, starts

    def _kind(self, text: str) -> bool:
        """Whether the text's ids are those of its chunks. A chunk that itself starts with the zero byte would be taken for a first one."""
        return bool(text) and not (self.whole or any(m in text for m in self.marks) or any(c in text for c in _ODD) or (self.spaces and "\0" in text))

    def _found(self, keys: list[str]) -> list[bytes]:
        """The ids of these chunks; what is new or comes from the older generation is in the younger one then."""
        found = list(map(self.young.get, keys))
        if None in found:
            new = {k for k, x in zip(keys, found) if x is None}
            if len(self.young) + len(new) > _KEEP:
                self.old, self.young = self.young, {}
            got = {k: x for k in new if (x := self.old.get(k)) is not None}
            got.update(self._encode_all(list(new.difference(got))))
            self.young.update(got)
            found = [got[k] if x is None else x for k, x in zip(keys, found)]
        return found


def _spelled_bytes() -> dict[int, str]:
    """The character that stands for each byte: printable bytes are themselves, others are counted from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One for each path and Python worker."""
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]
