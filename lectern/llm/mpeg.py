"""MPEG audio columns: streams are scanned for frames, tags and variable-bitrate tables; checksums, durations and seek offsets."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_volume, byte_texts, documents, stored

#: Fixed values of ISO/IEC 11172-3 and 13818-3: kilobits a second by header index, for MPEG-1 and for MPEG-2 and 2.5.
RATES_1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
RATES_2 = {
    1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: The longest free-format frame that is looked for, in bytes.
FREE = 6000
#: Samples a second by version bits and header index.
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 2.5 times 10
    layer: int
    checked: bool
    kbps: int
    hertz: int
    mono: bool
    length: int
    samples: int
    side: int  # bytes of side information, layer III only


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """None unless the four bytes can start a frame. A free-format frame (bitrate 0) has no length of its own: 0."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate == 15 or hz == 3 or four[3] & 3 == 2:
        return None
    first = version == 3
    kbps, hertz, mono, pad = (RATES_1 if first else RATES_2)[layer][rate], HERTZ[version][hz], four[3] >> 6 == 3, four[2] >> 1 & 1
    if layer == 1:
        samples, length = 384, (12_000 * kbps // hertz + pad) * 4
    else:
        samples = 1152 if layer == 2 or first else 576
        length = samples // 8 * 1000 * kbps // hertz + pad
    if not rate:
        length = 0
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return Header({3: 10, 2: 20, 0: 25}[version], layer, not four[1] & 1, kbps, hertz, mono, length, samples, side if layer == 3 else 0)


@lru_cache(1024)
def crc16(data: bytes) -> int:
    """The standard's 16-bit check: polynomial 0x8005, from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


@dataclass
class Scan:
    frames: list[tuple[int, Header]] = field(default_factory=list)  # audio frames: offset and header
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None  # of the variable-bitrate frame: kind, frames, bytes, seek points
    good: int = 0
    bad: int = 0
    unchecked: int = 0
    skipped: int = 0  # bytes that belong to no frame and no tag
    truncated: int = 0  # bytes of a last frame that is cut short

    @property
    def samples(self) -> int:
        return sum(h.samples for _, h in self.frames)

    @property
    def hertz(self) -> int:
        return self.frames[0][1].hertz if self.frames else 0

    @property
    def durations(self) -> list[tuple[int, int]]:
        """Samples by rate, in order of the rates: the exact duration is the sum of samples / rate."""
        out: dict[int, int] = {}
        for _, h in self.frames:
            out[h.hertz] = out.get(h.hertz, 0) + h.samples
        return sorted(out.items())


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Bytes of the ID3v2 tag at `at`, 0 if there is none; text frames of versions 2.2 to 2.4 go to tags, bytes that were put in
    against false syncs are taken out first. Compressed and encrypted frames are passed over."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return 0
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end, i = min(at + 10 + size, len(data)), 0
    part = data[at + 10 : end]
    if flags & 0x80 and major < 4:
        part = part.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and major > 2 and len(part) >= 4:
        i = _syncsafe(part[:4]) if major == 4 else 4 + int.from_bytes(part[:4], "big")
    head, name_size = (6, 3) if major == 2 else (10, 4)
    while major in (2, 3, 4) and i + head <= len(part) and part[i]:
        name, raw = part[i : i + name_size].decode("latin-1"), part[i + name_size : i + 2 * name_size]
        n = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        how = part[i + 9] if major > 2 else 0
        body = part[i + head : i + head + n]
        if major == 4 and how & 1:
            body = body[4:]
        if major == 4 and (how & 2 or flags & 0x80):
            body = body.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and body and not how & (0x0C if major == 4 else 0xC0):
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = value
        i += head + n
    return end - at + (10 if flags & 0x10 else 0)


def _ape(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Bytes of the APE tag at `at`, 0 if there is none; its text items go to tags. A footer alone has no items after it."""
    if data[at : at + 8] != b"APETAGEX" or len(data) < at + 32:
        return 0
    size, count, flags = struct.unpack_from("<III", data, at + 12)
    if not flags & 1 << 29:
        return 32
    end, i = min(at + 32 + size, len(data)), at + 32
    for _ in range(count):
        if i + 8 > end or data[i : i + 8] == b"APETAGEX":
            break
        n, kind = struct.unpack_from("<II", data, i)
        zero = data.find(b"\0", i + 8, min(end, i + 264))
        if zero < 0:
            break
        if kind >> 1 & 3 == 0:
            tags[data[i + 8 : zero].decode("latin-1")] = data[zero + 1 : min(zero + 1 + n, end)].decode("utf-8", "replace")
        i = zero + 1 + n
    return end - at


def _table(frame: bytes, h: Header) -> dict | None:
    """The variable-bitrate table in a frame that holds one instead of sound."""
    at = 4 + 2 * h.checked + h.side
    if h.layer != 3:
        return None
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, i, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[i : i + 4], "big")
                i += 4
        if flags & 4:
            out["points"] = list(frame[i : i + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, n, scale, width, per = *struct.unpack_from(">II", frame, 46), *struct.unpack_from(">HHHH", frame, 54)
        points = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "points": points, "per": per}
    return None


def scan(data: bytes) -> Scan:
    """All frames, tags and tables of a stream. Where no frame starts, the next place is sought at which one does and which
    another frame, a tag or the end follows; the bytes between are counted as skipped. A free-format frame reaches to the next
    frame of its kind, within FREE bytes. The places of the next tags are kept, so a pass over any bytes takes time in
    proportion to them."""
    out, at, n = Scan(), 0, len(data)
    last = n - 128 if data[-128:-125] == b"TAG" else n
    marks = {b"ID3": -1, b"APETAGEX": -1}
    free: dict[bytes, int] = {}

    def next_tag(i: int) -> int:
        for mark, place in marks.items():
            if place < i:
                found = data.find(mark, i)
                marks[mark] = found if found >= 0 else n
        return min(*marks.values(), last if last >= i else n)

    def free_length(i: int, h: Header) -> int:
        """The distance to the next header that differs in padding at most, without this frame's own padding."""
        kind = data[i + 1 : i + 2] + bytes([data[i + 2] & 0xFD])
        if kind not in free:
            j = i + 4
            while 0 <= (j := data.find(data[i : i + 2], j, min(n, i + FREE))):
                if j + 4 <= n and data[j + 2] & 0xFD == data[i + 2] & 0xFD and header(data[j : j + 4]):
                    break
                j += 1
            unit = (4 if h.layer == 1 else 1) * (data[i + 2] >> 1 & 1)
            free[kind] = j - i - unit if j > 0 else 0
        return free[kind] + (4 if h.layer == 1 else 1) * (data[i + 2] >> 1 & 1) if free[kind] else 0

    def ends(i: int) -> bool:
        return i == n or data[i : i + 3] in (b"TAG", b"ID3") or data[i : i + 8] == b"APETAGEX"

    synced = False
    while at < n:
        if size := _id3v2(data, at, out.tags):
            at, synced = at + size, False
            continue
        if data[at : at + 3] == b"TAG" and n - at == 128:
            for name, i, j in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
                if value := data[at + i : at + j].split(b"\0")[0].decode("latin-1").strip():
                    out.tags.setdefault(name, value)
            break
        if size := _ape(data, at, out.tags):
            at, synced = at + size, False
            continue
        h = header(data[at : at + 4])
        if h and not h.length:
            size = free_length(at, h)
            h = replace(h, length=size, kbps=size * 8 * h.hertz // (h.samples * 1000)) if size else None
        if h and not synced and not (ends(at + h.length) or header(data[at + h.length : at + h.length + 4]) or (free and at + h.length > n)):
            h = None
        if h is None:
            nxt = data.find(b"\xff", at + 1)
            to = min(nxt if nxt > 0 else n, next_tag(at + 1))
            out.skipped, at, synced = out.skipped + to - at, to, False
            continue
        if at + h.length > n:
            out.truncated = n - at
            break
        if not synced and out.table is None and not out.frames and (table := _table(data[at : at + h.length], h)):
            out.table = table
        else:
            out.frames.append((at, h))
        if not h.checked:
            out.unchecked += 1
        elif h.layer == 3:
            right = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.good, out.bad = out.good + right, out.bad + (not right)
        else:
            out.unchecked += 1  # layers I and II check bit allocations, which takes their decoding tables
        at, synced = at + h.length, True
    return out


#: What is stored: units of 192 bytes in the ancillary part of silent 48 kHz mono layer III frames, whose
#: side information is all zero. Bitrate index to the units that a frame of that rate carries, largest first.
UNIT = 192
CARRIED = {14: 4, 10: 2, 6: 1}


def _prefix(rate: int) -> bytes:
    head = bytes([0xFF, 0xFA, rate << 4 | 1 << 2, 0xC4])
    return head + crc16(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


_PREFIX = {rate: _prefix(rate) for rate in CARRIED}
_LENGTH = {rate: header(p[:4]).length for rate, p in _PREFIX.items()}


def _plan(units: int) -> list[int]:
    rates = []
    for rate, n in CARRIED.items():
        rates += [rate] * (units // n)
        units %= n
    return rates


def _text_frame(name: str, value: str) -> bytes:
    body = b"\x03" + value.encode()
    return name.encode() + bytes([len(body) >> 21, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + b"\0\0" + body


def encode(text: bytes) -> bytes:
    """A variable-bitrate stream that carries the text and spaces up to a positive multiple of UNIT bytes: an ID3v2 tag with
    the text's length, a table frame, then frames whose ancillary data is the payload and its CRC-32."""
    payload = text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))
    rates = _plan(len(payload) // UNIT)
    body, at, offsets = [], 0, [_LENGTH[6]]
    for rate in rates:
        n = CARRIED[rate] * UNIT
        part = payload[at : at + n]
        body.append((_PREFIX[rate] + zlib.crc32(part).to_bytes(4, "big") + part).ljust(_LENGTH[rate], b"\0"))
        at += n
        offsets.append(offsets[-1] + _LENGTH[rate])
    total = offsets[-1]
    points = bytes(min(255, offsets[len(rates) * i // 100] * 256 // total) for i in range(100))
    head = bytes([0xFF, 0xFB, 6 << 4 | 1 << 2, 0xC4]) + bytes(17) + b"Xing" + struct.pack(">III", 7, len(rates), total) + points
    tag = _text_frame("TXXX", f"bytes\0{len(text)}")
    size = len(tag)
    return b"ID3\x04\0\0" + bytes([0, 0, size >> 7, size & 127]) + tag + head.ljust(_LENGTH[6], b"\0") + b"".join(body)


def decode(data: bytes, found: Scan) -> bytes:
    """The payload in the stream's frames; an error if one doesn't match its CRC-32."""
    out = []
    for at, h in found.frames:
        n = h.length // 240 * UNIT
        start = at + 6 + h.side
        part = data[start + 4 : start + 4 + n]
        if zlib.crc32(part) != int.from_bytes(data[start : start + 4], "big"):
            raise ValueError(f"the frame at byte {at} is damaged")
        out.append(part)
    return b"".join(out)


def feature(data: bytes, found: Scan) -> str:
    """What the scan says, as JSON with sorted keys."""
    table = found.table or {}
    rates = [h.kbps for _, h in found.frames]
    seen = {
        "frames": len(found.frames), "hertz": found.hertz, "samples": found.samples, "kbps": [min(rates, default=0), max(rates, default=0)],
        "crc": [found.good, found.bad, found.unchecked], "skipped": found.skipped, "truncated": found.truncated, "table": table.get("kind"),
        "table_agrees": bool(table) and table.get("frames") == len(found.frames) and (not found.frames or table.get("bytes") == len(data) - found.skipped - _tag_bytes(data)),
        "seek_sha1": hashlib.sha1(",".join(str(at) for at, _ in found.frames).encode()).hexdigest(), "tags": found.tags,
    }
    return json.dumps(seen, sort_keys=True, separators=(",", ":"))


def _tag_bytes(data: bytes) -> int:
    return _id3v2(data, 0, {}) + (128 if data[-128:-125] == b"TAG" else 0)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table (doc_id, media): each whole text as a stream. A null text is an empty one; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_texts(b.column(1))
            for i, j in by_volume(texts, 1 << 24):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([encode(t or b"") for t in texts[i:j]], pa.binary())], ["doc_id", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, media binary"), "mpeg", compression="zstd")


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per stream: feature, frames, samples, hertz (of the first frame), durations (samples by rate: the exact duration is the
    sum of samples / hertz), crc_bad, and seek_offsets, the byte offset of each frame. Any bytes are taken: what is no stream
    has no frame. A null stream gives nulls."""
    kind = media.schema[id_col].dataType.simpleString()
    ddl = f"doc_id {kind}, feature string, frames long, samples long, hertz int, crc_bad long, seek_offsets array<long>, durations array<struct<hertz:int,samples:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                s = scan(data) if data is not None else None
                rows.append((feature(data, s), len(s.frames), s.samples, s.hertz, s.bad, [at for at, _ in s.frames], [{"hertz": z, "samples": m} for z, m in s.durations]) if s else (None,) * 7)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("hertz", pa.int32()), ("samples", pa.int64())]))]
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["doc_id", "feature", "frames", "samples", "hertz", "crc_bad", "seek_offsets", "durations"])

    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, ddl)


def read_back(media: DataFrame) -> DataFrame:
    """The digests of stored streams: of the payload as it is read back, and of the stored bytes; and their features."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "hertz", "seek_offsets"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    ddl = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, hertz int, seek_offsets array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                s = scan(data)
                p = decode(data, s)
                rows.append((int(s.tags["bytes"]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, s), s.samples, s.hertz, [at for at, _ in s.frames]))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return media.select("doc_id", "media").mapInArrow(run, ddl)


def _query(spark, sf_dir: str) -> DataFrame:
    return read_back(media_table(documents(spark, sf_dir)))


QUERIES: dict[str, Callable] = {"op3_mpeg_audio": _query}
SQL: dict[str, str] = {}
