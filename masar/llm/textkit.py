"""Words of whole Arrow string columns as numpy arrays: spans, 64-bit hashes, windows.

All functions work on a *chunk*: the bytes of some whole texts and the offsets that part them.  A chunk holds
about ``CHUNK`` bytes, or one longer text.  Words are maximal runs of bytes that are not separators; A-Z count as
a-z.  A word's hash is a polynomial over its bytes modulo 2**64, mixed with its length; it doesn't depend on where
the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 500_000
U = np.uint64
_BASE = 0x9E6C63D0676A9A99 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: True at the bytes that part words: 0x20 and 0x09-0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: True at every ASCII byte that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        out = np.full(size, base, U)
        out[0] = 1
        np.cumprod(out, out=out)
        if size > CHUNK + 1:
            return out
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of whole texts of about ``limit`` bytes."""
    raw, offs = column_bytes(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def spans(raw: np.ndarray, offs: np.ndarray, separator: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never reaches over an offset."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = separator[raw]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[inner - 1] = True
    word = ~gap
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    n = len(raw)
    if not len(starts):
        return np.zeros(0, U)
    prefix = np.empty(n + 1, U)
    prefix[0] = 0
    np.cumsum((LOWER[raw].astype(U) + U(1)) * _power(_BASE, n), out=prefix[1:])
    out = (prefix[ends] - prefix[starts]) * _power(_INVERSE, n)[starts]
    return mix(out + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def prefix_hashes(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_hashes`` reads a hash of any run of words."""
    out = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * _power(_BASE, len(hashes)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words from begin to end, in order; it doesn't depend on where they stand."""
    out = (prefix[end] - prefix[begin]) * _power(_INVERSE, len(prefix))[begin]
    return mix(out + (end - begin).astype(U) * U(0xD6E8FEB86659FD93))


def per_text(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bounds of each text's words among all words of the chunk: text i has words bounds[i] to bounds[i+1]."""
    return np.searchsorted(starts, offs)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, and the bounds of each text among them.

    A text of fewer words has one window of all its words; one without words has none.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    new = np.concatenate([[0], np.cumsum(made)])
    if not new[-1]:
        return np.zeros(0, U), new
    first = np.repeat(bounds[:-1] - new[:-1], made) + np.arange(new[-1])
    room = np.repeat(np.minimum(counts, width), made)
    padded = np.concatenate([hashes, np.zeros(width, U)])
    out = np.zeros(new[-1], U)
    short = room < width
    for k in range(width):
        part = mix(padded[first + k] + U((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        if k and short.any():
            part = np.where(k < room, part, U(0))
        out = out * U(0xFF51AFD7ED558CCD) + part
    return mix(out), new


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(U)
