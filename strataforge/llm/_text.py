"""Arrow text columns as numpy arrays: word spans, span hashes and bounded blocks.

Everything here works on UTF-8 bytes, so a text is never split into Python objects.
Null texts count as empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A block's arrays of 64-bit numbers take some hundred times as much for each word; a worker keeps them between blocks.
BLOCK_BYTES = 1 << 20
#: White space of the word definition [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_SYMBOL = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _MULT), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 offsets that separate them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES):
    """Slices of the batch with about `limit` bytes of text each (one text may be longer)."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0), np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where `member` holds, cut at the texts' borders."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    first[borders] = member[borders]
    last[borders - 1] = member[borders - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words [^\\x20\\x09-\\x0D]+."""
    starts, ends = spans(data, offsets, ~IS_SPACE[data])
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes anywhere."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unicode code points of all texts (bytes that are not UTF-8 become U+FFFD) and their offsets."""
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        return points, lead[offsets]
    except UnicodeDecodeError:
        raw, ends = data.tobytes(), offsets.tolist()
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def per_document(values: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each document (whole numbers below 2^53 stay exact)."""
    return np.bincount(document, values, minlength=n).astype(np.float64)


def crc_of_ids(ids: list) -> np.ndarray:
    """crc32 of each id written as text; a null id counts as the text '' (checksum 0)."""
    return np.array([0 if i is None else zlib.crc32(str(i).encode()) for i in ids], np.int64)
