import hashlib
import random
import struct
import zlib

import pytest

from masar.llm import matroska as m

SCHEMA = "doc_id long, text string, key string, content string, packet int"


def pad(raw):
    while not raw or len(raw) % 576:
        raw += b"\xff"
    return raw


def walk(data, at=0, end=None):
    """(id, start, end) of sibling elements, by shifting bits; unknown sizes aren't needed for our own files."""
    end = len(data) if end is None else end
    while at < end:
        width = next(k for k in range(1, 5) if data[at] & 0x100 >> k)
        ident, at = int.from_bytes(data[at : at + width], "big"), at + width
        width = next(k for k in range(1, 9) if data[at] & 0x100 >> k)
        size, at = int.from_bytes(data[at : at + width], "big") - (1 << 7 * width), at + width
        yield ident, at, at + size
        at += size
    assert at == end


def plain_payload(data):
    """The samples of a file of fixed lacing, read without the operator's parser."""
    out = b""
    for ident, a, b in walk(data):
        for i, c, d in walk(data, a, b) if ident == m.SEGMENT else ():
            for j, e, f in walk(data, c, d) if i == m.CLUSTER else ():
                if j == m.SIMPLE_BLOCK:
                    out += data[e + 4 + (data[e + 3] >> 1 & 3 > 0) : f]
    return out


TEXTS = [None, "", "a", "é😀" * 100, "x" * 575, "x" * 576, "x" * 577, "x" * 576 * 9, "y" * 576 * 64, "y" * (576 * 64 + 1), "z " * 300_000, "\n\0\t", "a"]


def test_round_trip(spark):
    rows = [(k if k != 3 else None, t, "k", "c", 1) for k, t in enumerate(TEXTS)] + [(2, "a", "k", "c", 1)]
    got = m.digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full, stored = pad(raw), m.mux(pad(raw))
        assert plain_payload(stored) == full
        media = m.parse(stored)
        assert media.error is None and b"".join(stored[p[5] : p[6]] for p in media.packets) == full
        want.setdefault(i, []).append((len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(stored), hashlib.sha256(stored).hexdigest()))
    for r in got:
        assert tuple(r)[1:7] in want[r["doc_id"]]
    same = {r["feature"] for r in got if r["payload_sha256"] == hashlib.sha256(pad(b"a")).hexdigest()}
    assert len(same) == 1 and sum(r["payload_sha256"] == hashlib.sha256(pad(b"a")).hexdigest() for r in got) == 3
    assert m.digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cues_and_times():
    data = m.mux(bytes(576 * 200))
    media = m.parse(data)
    assert [p for _, _, p in media.cues] == media.clusters and len(media.clusters) == 4
    assert [p[1] for p in media.packets] == [12_000_000 * k for k in range(200)]
    assert {p[4] for p in media.packets} <= {"fixed", "none"} and {p[0] for p in media.packets} == {1}


def block(frames, lacing, offset=0, track=1, key=True, ident=m.SIMPLE_BLOCK):
    """A block of frames in any lacing, written by the specification."""
    head = bytes([0x80 | track]) + struct.pack(">h", offset) + bytes([(0x80 if key else 0) | lacing << 1])
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    if lacing == 3:
        before = None
        for f in frames[:-1]:
            if before is None:
                head += m.encode_size(len(f))
            else:
                step = len(f) - before
                width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
                head += ((step + (1 << 7 * width - 1) - 1) | 1 << 7 * width).to_bytes(width, "big")
            before = len(f)
    return m.element(ident, head + b"".join(frames))


def sized(ident, body, unknown=False):
    return m.encode_id(ident) + b"\x01" + b"\xff" * 7 + body if unknown else m.element(ident, body)


def made(seed, unknown=False):
    rng = random.Random(seed)
    tracks = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1) + m.number(m.DEFAULT_DURATION, 2_000_000)) + m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 2) + m.number(m.TRACK_TYPE, 1)))
    want, clusters = [], b""
    for c in range(3):
        body = m.number(m.CLUSTER_TIMESTAMP, 100 * c)
        for _ in range(4):
            lacing, track, offset, key = rng.randrange(4), rng.choice([1, 2]), rng.randrange(-5, 50), rng.random() < 0.5
            n = 1 if not lacing else rng.choice([1, 2, 5, 40])
            size = rng.choice([1, 20, 300])
            frames = [rng.randbytes(size if lacing == 2 else rng.choice([0, 1, 254, 255, 256, 600, 20_000])) for _ in range(n)]
            if rng.random() < 0.5:
                body += block(frames, lacing, offset, track, key)
            else:
                body += m.element(m.BLOCK_GROUP, block(frames, lacing, offset, track, False, m.BLOCK) + (b"" if key else m.number(m.REFERENCE_BLOCK, 1)))
            want += [(track, (100 * c + offset) * 1_000_000 + (k * 2_000_000 if track == 1 else 0), key, c, m.LACINGS[lacing], f) for k, f in enumerate(frames)]
        clusters += sized(m.CLUSTER, body, unknown)
    return m.element(m.EBML, b"") + sized(m.SEGMENT, m.element(0xEC, b"void") + tracks + clusters, unknown), want


@pytest.mark.parametrize("unknown", [False, True])
def test_every_lacing_and_unknown_sizes(unknown):
    for seed in range(30):
        data, want = made(seed, unknown)
        media = m.parse(data)
        assert media.error is None
        assert [(*p[:5], data[p[5] : p[6]]) for p in media.packets] == want


def test_damage_keeps_what_came_before():
    data, want = made(1)
    whole = [(*p[:5], data[p[5] : p[6]]) for p in m.parse(data).packets]
    for cut in range(0, len(data), 97):
        media = m.parse(data[:cut])
        assert [(*p[:5], data[p[5] : p[6]]) for p in media.packets] == whole[: len(media.packets)]
        assert media.error or len(media.packets) in (0, len(whole))
    rng = random.Random(2)
    for _ in range(300):
        bad = bytearray(data)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        m.parse(bytes(bad))  # never raises
    assert m.parse(b"").packets == [] and m.parse(b"not media").error


def test_packet_table(spark):
    files = [(k, *made(k, k % 2 == 1)) for k in range(6)]
    rows = [(k, bytearray(d), 1) for k, d, _ in files] + [(100, None, 1), (101, bytearray(b""), 1), (102, bytearray(b"junk"), 1), (None, bytearray(files[0][1]), 1), (0, bytearray(files[0][1]), 1)]
    got = m.packets(spark.createDataFrame(rows, "id long, content binary, packet int"), "content", "id").collect()
    data = {k: (d, w) for k, d, w in files} | {None: files[0][1:]}
    for k, (d, w) in data.items():
        own = [r for r in got if r["id"] == k]
        have = sorted((r["packet"], r["track"], r["timestamp_ns"], r["keyframe"], r["cluster"], r["lacing"], d[r["byte_start"] : r["byte_end"]]) for r in own)
        assert have == sorted((n, *x) for n, x in enumerate(w) for _ in range(2 if k == 0 else 1))
        assert not any(r["cued"] for r in own)
    assert not {r["id"] for r in got} & {100, 101, 102}
    cued = m.packets(spark.createDataFrame([(1, bytearray(m.mux(bytes(576 * 70))))], "id long, content binary"), "content", "id").collect()
    assert len(cued) == 70 and all(r["cued"] for r in cued)
