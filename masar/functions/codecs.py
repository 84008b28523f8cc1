"""Codecs that need loops over bytes: polylines, vector tiles, WAV; as pandas functions over columns."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

POINT = StructType([StructField("lat", DoubleType()), StructField("lng", DoubleType())])


def read_polyline(text: str | None, precision: int = 5) -> list[tuple[float, float]]:
    """The points of an encoded polyline; of a cut-off one those before the cut."""
    numbers, value, shift = [], 0, 0
    for ch in text or "":
        part = ord(ch) - 63
        value |= (part & 31) << shift
        shift += 5
        if part < 32:
            numbers.append(~(value >> 1) if value & 1 else value >> 1)
            value, shift = 0, 0
    out, lat, lng = [], 0, 0
    for a, b in zip(numbers[::2], numbers[1::2], strict=False):
        lat, lng = lat + a, lng + b
        out.append((lat / 10**precision, lng / 10**precision))
    return out


def write_polyline(points: list[tuple[float, float]], precision: int = 5) -> str:
    out, before = [], (0, 0)
    for lat, lng in points or []:
        now = (round(lat * 10**precision), round(lng * 10**precision))
        for a, b in zip(before, now, strict=True):
            step = b - a
            value = ~(step << 1) if step < 0 else step << 1
            while value >= 32:
                out.append(chr((value & 31 | 32) + 63))
                value >>= 5
            out.append(chr(value + 63))
        before = now
    return "".join(out)


def decode_polyline(text: str | Column, precision: int = 5) -> Column:
    @F.pandas_udf(ArrayType(POINT))
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda t: [{"lat": a, "lng": b} for a, b in read_polyline(t, precision)])

    return decode(text)


def encode_polyline(points: str | Column, precision: int = 5) -> Column:
    @F.pandas_udf(StringType())
    def encode(x: pd.Series) -> pd.Series:
        return x.map(lambda ps: write_polyline([(p["lat"], p["lng"]) for p in ps], precision))

    return encode(points)


def wav_seconds(data: bytes | None) -> float | None:
    """Duration of a RIFF file from its format and data chunks; null if it is none."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 20 <= len(data):
            rate = struct.unpack("<I", data[at + 16 : at + 20])[0]
        elif name == b"data":
            return min(size, len(data) - at - 8) / rate if rate else None
        at += 8 + size + size % 2
    return None


def wav_duration(data: str | Column) -> Column:
    @F.pandas_udf(DoubleType())
    def duration(x: pd.Series) -> pd.Series:
        return x.map(wav_seconds)

    return duration(data)


class _Wire:
    """Fields of a protocol-buffer message."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def varint(self) -> int:
        value, shift = 0, 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    def fields(self):
        while self.at < len(self.data):
            key = self.varint()
            kind = key & 7
            if kind == 0:
                yield key >> 3, self.varint()
            else:
                size = self.varint() if kind == 2 else 8 if kind == 1 else 4
                yield key >> 3, self.data[self.at : self.at + size]
                self.at += size


def _packed(data: bytes) -> list[int]:
    wire, out = _Wire(data), []
    while wire.at < len(data):
        out.append(wire.varint())
    return out


def _zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _rings(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Lines from the command stream: 1 starts a line, 2 goes on, 7 closes it."""
    out: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        what, times = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == 7:
            if out and out[-1]:
                out[-1].append(out[-1][0])
            continue
        for _ in range(times):
            if at + 1 >= len(commands):
                return out
            x, y = x + _zigzag(commands[at]), y + _zigzag(commands[at + 1])
            at += 2
            if what == 1:
                out.append([])
            if out:
                out[-1].append((x, y))
    return out


def _text(value: bytes) -> str | None:
    for field, v in _Wire(value).fields():
        if field == 1:
            return v.decode("utf-8", "replace")
        if field in (2, 3):
            return str(struct.unpack("<f" if field == 2 else "<d", v)[0])
        if field in (4, 5):
            return str(v)
        if field == 6:
            return str(_zigzag(v))
        if field == 7:
            return str(bool(v)).lower()
    return None


def read_tile(data: bytes | None) -> list[tuple[str, dict[str, str], list[list[tuple[int, int]]]]]:
    """(layer, properties, lines) of each feature of a vector tile."""
    out = []
    for field, layer in _Wire(data or b"").fields():
        if field != 3:
            continue
        name, keys, values, features = "", [], [], []
        for f, v in _Wire(layer).fields():
            if f == 1:
                name = v.decode("utf-8", "replace")
            elif f == 2:
                features.append(v)
            elif f == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif f == 4:
                values.append(_text(v))
        for feature in features:
            tags, shape = [], []
            for f, v in _Wire(feature).fields():
                if f == 2:
                    tags = _packed(v)
                elif f == 4:
                    shape = _packed(v)
            pairs = zip(tags[::2], tags[1::2], strict=False)
            out.append((name, {keys[k]: values[j] for k, j in pairs if k < len(keys) and j < len(values)}, _rings(shape)))
    return out


TILE = ArrayType(StructType([StructField("layer", StringType()), StructField("properties", MapType(StringType(), StringType())), StructField("lines", ArrayType(ArrayType(StructType([StructField("x", IntegerType()), StructField("y", IntegerType())]))))]))


def decode_tile(data: str | Column) -> Column:
    @F.pandas_udf(TILE)
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda d: [{"layer": n, "properties": p, "lines": [[{"x": a, "y": b} for a, b in line] for line in lines]} for n, p, lines in read_tile(d)])

    return decode(data)
