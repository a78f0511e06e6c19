import hashlib
import json
import zlib

from lectern.llm import mpeg

DDL = "doc_id long, text string, media string, feature string, n_bytes string"
TEXTS = [None, "", "a", "é" * 96, "x" * 192, "x" * 193, "ID3 TAG \xff\xfb APETAGEX" * 50, "w " * 200_000]


def frame(rate=9, first=0xFB, mode=0xC4, hz=0):
    head = bytes([0xFF, first, rate << 4 | hz << 2, mode])
    return head + bytes(mpeg.header(head).length - 4)


def test_headers():
    h = mpeg.header(bytes([0xFF, 0xFB, 0x90, 0x64]))
    assert (h.version, h.layer, h.kbps, h.hertz, h.length, h.samples, h.checked) == (10, 3, 128, 44100, 417, 1152, False)
    h = mpeg.header(bytes([0xFF, 0xF3, 0x82, 0xC0]))
    assert (h.version, h.layer, h.kbps, h.hertz, h.length, h.samples, h.mono) == (20, 3, 64, 22050, 209, 576, True)
    h = mpeg.header(bytes([0xFF, 0xFF, 0x54, 0x00]))
    assert (h.layer, h.kbps, h.length, h.samples) == (1, 160, 160, 384)
    for bad in (b"", b"\xff\xfb\xf0\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x9c\x00", b"\xfe\xfb\x90\x00", b"\xff\xfb\x90\x02"):
        assert mpeg.header(bad) is None


def test_resync_tags_and_damage():
    tag1 = b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    stream = b"junk\xff\xfb" + frame() + frame(11) + b"\xff\xff\x00garbage" + frame() + frame() + tag1
    s = mpeg.scan(stream)
    assert [at for at, _ in s.frames] == [6, 6 + 417, 6 + 417 + 626 + 10, 6 + 2 * 417 + 626 + 10]
    assert s.skipped == 16 and s.tags == {"title": "Title"} and s.samples == 4 * 1152 and s.hertz == 44100
    assert mpeg.scan(frame() + frame()[:50]).truncated == 50
    for data in (b"", b"\xff", b"ID3", b"no frames here", b"\xff" * 500):
        assert mpeg.scan(data).frames == [] or data[0] == 0xFF
    vbri = bytearray(frame(14))
    vbri[36:62] = b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (7).to_bytes(4, "big") + bytes([0, 2, 0, 10, 0, 1, 0, 4])
    vbri[62:64] = bytes([3, 5])
    s = mpeg.scan(bytes(vbri) + frame())
    assert s.table == {"kind": "VBRI", "frames": 7, "bytes": 5000, "points": [30, 50], "per": 4} and len(s.frames) == 1
    data = bytearray(mpeg.encode(b"y" * 5000))
    offset = mpeg.scan(bytes(data)).frames[1][0]
    data[offset + 10] ^= 1
    s = mpeg.scan(bytes(data))
    assert s.bad == 1 and s.good == len(s.frames) - 1
    data[offset + 40] ^= 1
    try:
        mpeg.decode(bytes(data), s)
        raise AssertionError
    except ValueError:
        pass


def test_other_tags_and_free_format():
    v22 = b"TT2\0\0\6\0Hello" + b"TXX\0\0\5\0a\0bc"
    tag = b"ID3\2\0\0" + bytes([0, 0, 0, len(v22)]) + v22
    assert mpeg.scan(tag + frame() + frame()).tags == {"TT2": "Hello", "a": "bc"}
    body = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0\0" + b"\xff\xfbx"
    guarded = body.replace(b"\xff", b"\xff\0")
    s = mpeg.scan(b"ID3\3\0\x80" + bytes([0, 0, 0, len(guarded)]) + guarded + frame())
    assert s.tags == {"TIT2": "\xff\xfbx"} and len(s.frames) == 1
    item = (5).to_bytes(4, "little") + bytes(4) + b"Title\0" + "höh!".encode()[:5]
    head = lambda flags: b"APETAGEX" + (2000).to_bytes(4, "little") + (len(item) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + flags.to_bytes(4, "little") + bytes(8)
    s = mpeg.scan(frame() + frame() + head(5 << 29) + item + head(4 << 29))
    assert s.tags == {"Title": "höh!"} and len(s.frames) == 2 and s.skipped == 0
    free = lambda pad: bytes([0xFF, 0xFB, pad << 1, 0xC4]) + bytes(496 + pad)
    s = mpeg.scan(b"junk" + free(0) + free(1) + free(0) + free(0))
    assert [at for at, _ in s.frames] == [4, 504, 1005, 1505] and s.frames[0][1].kbps == 153 and s.skipped == 4
    joined = mpeg.scan(frame() + frame() + frame(hz=1) + frame(hz=1))
    assert joined.durations == [(44100, 2 * 1152), (48000, 2 * 1152)]


def test_any_bytes_in_linear_time():
    import time

    for data in (b"\xff" * 400_000, b"ID3" * 100_000, b"\xff\xfb\0\0" * 100_000, b"APETAGEX" * 30_000):
        start = time.process_time()
        mpeg.scan(data)
        assert time.process_time() - start < 20


def test_round_trip(spark):
    fixture = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [*TEXTS, *TEXTS, *fixture]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], DDL)
    media = mpeg.media_table(df)
    got = {r.doc_id: r for r in mpeg.read_back(media).collect()}
    streams = {r.doc_id: bytes(r.media) for r in media.collect()}
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[i]
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(streams[i]), hashlib.sha256(streams[i]).hexdigest())
        f = json.loads(r.feature)
        assert f["table_agrees"] and f["crc"][1] == f["skipped"] == 0 and f["samples"] == r.samples == 1152 * len(r.seek_offsets) and f["tags"] == {"bytes": str(len(raw))}
        assert all(mpeg.header(streams[i][at : at + 4]) for at in r.seek_offsets)
    assert got[0].feature == got[len(TEXTS)].feature
    assert mpeg.features(media).count() == len(texts) and mpeg.read_back(mpeg.media_table(df.limit(0))).count() == 0
    assert mpeg.features(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().feature is None
