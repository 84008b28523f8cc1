"""Media columns: Matroska.

``packets`` turns a binary column of Matroska files into a packet table: one row per frame with its track, timestamp,
key flag, cluster, lacing and byte range in the file.  ``mux`` writes payloads as 8-bit PCM audio in Matroska, with
clusters, fixed-size lacing and cues; ``digests`` stores texts that way, reads the stored bytes back and describes them.

Defined results: a null or empty file has no packets; of a damaged or truncated file the packets before the damage are
returned and ``error`` of ``parse`` names it; elements of unknown size end where an element of a higher level starts;
extra columns of the input are ignored, repeated rows are treated alike.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masar.llm.textkit import column_bytes

# Element ids of the Matroska specification (RFC 9559).
EBML, SEGMENT, CLUSTER, CUES, TRACKS, INFO = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1C53BB6B, 0x1654AE6B, 0x1549A966
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TIMESTAMP_SCALE, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DURATION, MUXING_APP, WRITING_APP = 0x4489, 0x4D80, 0x5741
LEVEL_1 = {CLUSTER, CUES, TRACKS, INFO, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME = 576
FRAMES_PER_BLOCK = 8
FRAMES_PER_CLUSTER = 64
RATE = 48_000

PACKET_SCHEMA = "packet long, track long, timestamp_ns long, keyframe boolean, cluster long, lacing string, byte_start long, byte_end long, cued boolean"


class Damaged(ValueError):
    """The bytes break the format here."""


def encode_size(n: int) -> bytes:
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def encode_id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def element(i: int, body: bytes) -> bytes:
    return encode_id(i) + encode_size(len(body)) + body


def number(i: int, value: int) -> bytes:
    return element(i, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def read_vint(data: bytes, at: int, end: int) -> tuple[int, int, bool]:
    """(value, next position, whether all value bits are set: an unknown size)."""
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"number cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return value, at + width, value == (1 << 7 * width) - 1


def read_head(data: bytes, at: int, end: int) -> tuple[int, int, int | None]:
    """(element id, where its body starts, the body's length or None if unknown)."""
    if at >= end or not data[at] & 0xF0:
        raise Damaged(f"no element id at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"element id cut off at {at}")
    ident = int.from_bytes(data[at : at + width], "big")
    length, body, unknown = read_vint(data, at + width, end)
    return ident, body, None if unknown else length


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements of known size between two positions."""
    while at < end:
        ident, body, length = read_head(data, at, end)
        if length is None or body + length > end:
            raise Damaged(f"element {ident:#x} at {at} reaches over its parent's end")
        yield ident, body, body + length
        at = body + length


def _uint(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


@dataclass
class Media:
    """What ``parse`` finds.  A packet: (track, timestamp in ns, keyframe, cluster, lacing, start, end)."""

    packets: list[tuple[int, int, bool, int, str, int, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    segment: int = 0
    error: str | None = None


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block and where the first starts."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise Damaged(f"lacing cut off at {at}")
    frames, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % frames:
            raise Damaged(f"{end - at} bytes don't part into {frames} equal frames")
        return [(end - at) // frames] * frames, at
    for k in range(frames - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise Damaged(f"lacing cut off at {at}")
                size, more, at = size + data[at], data[at] == 255, at + 1
                if not more:
                    break
        else:
            width = 9 - data[at].bit_length() if at < end and data[at] else 0
            value, at, _ = read_vint(data, at, end)
            size = value if not k else sizes[-1] + value - ((1 << (7 * width - 1)) - 1)
        sizes.append(size)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise Damaged(f"laced frames reach over the block's end at {end}")
    return [*sizes, rest], at


def _block(media: Media, data: bytes, start: int, end: int, cluster: int, base: int, key: bool | None) -> None:
    track, at, _ = read_vint(data, start, end)
    if at + 3 > end:
        raise Damaged(f"block cut off at {start}")
    (offset,), flags = struct.unpack(">h", data[at : at + 2]), data[at + 2]
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, end, lacing)
    step = media.tracks.get(track, {}).get("default_duration", 0)
    for k, size in enumerate(sizes):
        media.packets.append((track, (base + offset) * media.scale + k * step, bool(flags & 0x80) if key is None else key, cluster, LACINGS[lacing], at, at + size))
        at += size


def _track(data: bytes, start: int, end: int) -> tuple[int, dict]:
    out: dict = {}
    for ident, a, b in children(data, start, end):
        if ident == TRACK_NUMBER:
            out["number"] = _uint(data, a, b)
        elif ident == TRACK_TYPE:
            out["type"] = _uint(data, a, b)
        elif ident == CODEC_ID:
            out["codec"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif ident == DEFAULT_DURATION:
            out["default_duration"] = _uint(data, a, b)
        elif ident == AUDIO:
            for i, c, d in children(data, a, b):
                if i == SAMPLING_FREQUENCY and d - c in (4, 8):
                    out["rate"] = struct.unpack(">f" if d - c == 4 else ">d", data[c:d])[0]
                elif i in (CHANNELS, BIT_DEPTH):
                    out["channels" if i == CHANNELS else "bits"] = _uint(data, c, d)
    return out.get("number", 0), out


def _cues(media: Media, data: bytes, start: int, end: int) -> None:
    for ident, a, b in children(data, start, end):
        if ident != CUE_POINT:
            continue
        when, spots = 0, []
        for i, c, d in children(data, a, b):
            if i == CUE_TIME:
                when = _uint(data, c, d)
            elif i == CUE_TRACK_POSITIONS:
                spot = {j: _uint(data, e, f) for j, e, f in children(data, c, d)}
                spots.append((spot.get(CUE_TRACK, 0), spot.get(CUE_CLUSTER_POSITION, -1)))
        media.cues += [(when * media.scale, track, media.segment + position) for track, position in spots]


def _cluster(media: Media, data: bytes, head: int, at: int, end: int, known: bool) -> int:
    """Reads a cluster; returns where it ends."""
    media.clusters.append(head)
    base, index = 0, len(media.clusters) - 1
    while at < end:
        ident, body, length = read_head(data, at, end)
        if not known and (ident in LEVEL_1 or ident in (SEGMENT, EBML)):
            return at
        if length is None or body + length > end:
            raise Damaged(f"element {ident:#x} at {at} reaches over its parent's end")
        stop = body + length
        if ident == CLUSTER_TIMESTAMP:
            base = _uint(data, body, stop)
        elif ident == SIMPLE_BLOCK:
            _block(media, data, body, stop, index, base, None)
        elif ident == BLOCK_GROUP:
            parts = list(children(data, body, stop))
            key = not any(i == REFERENCE_BLOCK for i, _, _ in parts)
            for i, a, b in parts:
                if i == BLOCK:
                    _block(media, data, a, b, index, base, key)
        at = stop
    return at


def parse(data: bytes) -> Media:
    """Tracks, packets, clusters and cues of one file."""
    media, at, end = Media(), 0, len(data)
    inside, limit = False, end
    try:
        while at < end:
            ident, body, length = read_head(data, at, end)
            stop = end if length is None else body + length
            if ident == SEGMENT:
                inside, media.segment, limit = True, body, min(stop, end)
                at = body
                continue
            if inside and at >= limit and ident != EBML:
                inside = False
            if ident == CLUSTER and inside:
                at = _cluster(media, data, at, body, min(stop, end), length is not None)
                if stop > end and length is not None:
                    raise Damaged(f"cluster cut off at {end}")
                continue
            if stop > end or length is None:
                raise Damaged(f"element {ident:#x} at {at} reaches over the end")
            if inside and ident == INFO:
                for i, a, b in children(data, body, stop):
                    if i == TIMESTAMP_SCALE:
                        media.scale = _uint(data, a, b)
            elif inside and ident == TRACKS:
                for i, a, b in children(data, body, stop):
                    if i == TRACK_ENTRY:
                        n, track = _track(data, a, b)
                        media.tracks[n] = track
            elif inside and ident == CUES:
                _cues(media, data, body, stop)
            at = stop
    except Damaged as e:
        media.error = str(e)
    return media


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file whose one track holds ``payload`` as unsigned 8-bit samples; its length is a multiple of ``frame``."""
    if len(payload) % frame:
        raise ValueError("the payload isn't whole frames")
    count, ms = len(payload) // frame, frame * 1000 // RATE
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", count * ms)) + element(MUXING_APP, b"masar") + element(WRITING_APP, b"masar"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, ms * 1_000_000) + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, count, FRAMES_PER_CLUSTER):
        blocks = [number(CLUSTER_TIMESTAMP, first * ms)]
        last = min(count, first + FRAMES_PER_CLUSTER)
        for k in range(first, last, FRAMES_PER_BLOCK):
            n = min(FRAMES_PER_BLOCK, last - k)
            lace = b"\x80" if n == 1 else b"\x84" + bytes([n - 1])
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", (k - first) * ms) + lace + payload[k * frame : (k + n) * frame]))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * ms) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def pad(raw: bytes, unit: int = FRAME) -> bytes:
    return raw + b"\xff" * (-len(raw) % unit or (unit if not raw else 0))


def packets(files: DataFrame, content: str, key: str) -> DataFrame:
    """One row per frame of each file: ``key``, then the columns of PACKET_SCHEMA."""
    kind = files.schema[key].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                media = parse(data.as_py() or b"")
                if not media.packets:
                    continue
                cued = {media.clusters.index(p) for _, _, p in media.cues if p in media.clusters}
                cols = list(zip(*media.packets, strict=True))
                n = len(media.packets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.as_py()] * n, batch.schema.field(0).type), pa.array(range(n), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64()), pa.array([c in cued for c in cols[3]], pa.bool_())],
                    names=["key", "packet", "track", "timestamp_ns", "keyframe", "cluster", "lacing", "byte_start", "byte_end", "cued"],
                )

    out = files.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(read, f"key {kind.simpleString()}, {PACKET_SCHEMA}")
    return out.withColumnRenamed("key", key)


DIGEST_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(raw: bytes) -> tuple[int, int, str, int, int, str, str]:
    """Stores one text and describes what is read back."""
    stored = mux(pad(raw))
    media = parse(stored)
    if media.error:
        raise Damaged(media.error)
    payload = b"".join([stored[p[5] : p[6]] for p in media.packets])
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero(np.diff(np.signbit(samples))))
    feature = f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ns={media.packets[-1][1] + media.tracks[1]['default_duration']};sum={int(samples.sum())};power={int((samples * samples).sum())};turns={turns}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as Matroska and read back: ``key`` and the columns of DIGEST_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = column_bytes(batch.column(1))
            view = raw.data if len(raw) else b""
            rows = [digest(bytes(view[a:b])) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["key", *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {DIGEST_SCHEMA}").withColumnRenamed("key", key)
