"""TIFF in binary columns: walk image directories and decode them to one row per page.

Decoder: classic TIFF of either byte order; strips and tiles; no compression, PackBits, LZW and
deflate; predictors 2 (horizontal differences) and 3 (floating point); chunky and planar samples of whole bytes, or of
1, 2 or 4 bits, which come out as a byte each.

Bound: a page of more than MAX_PAGE_BYTES decoded bytes, or of more than its stored bytes can expand to (EXPANSION), is
refused before anything is allocated; a strip or tile is decoded no further than its page needs.

Defined cases: a null or empty blob has no pages; a page that can't be decoded gives a row with `error` set and null
pixels, and the walk goes on with the next directory; an unreadable directory gives such a row and ends the walk; a
directory that was visited before ends it without one. Repeated rows give repeated pages.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._spark import extended, map_rows, quoted
from ._text import blocks, utf8

WIDTH = 192
ROWS_PER_STRIP = 128
#: Fixed values of the format: bytes of each field type, and the tags that are read.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TAG_WIDTH, TAG_HEIGHT, TAG_BITS, TAG_COMPRESSION, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIP_OFFSETS, TAG_SAMPLES, TAG_ROWS_PER_STRIP, TAG_STRIP_BYTES, TAG_PLANAR, TAG_PREDICTOR = 273, 277, 278, 279, 284, 317
TAG_TILE_WIDTH, TAG_TILE_HEIGHT, TAG_TILE_OFFSETS, TAG_TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TAG_FILL_ORDER = 266
#: Decoded bytes of a page, at most.
MAX_PAGE_BYTES = (1 << 31) - 1
#: Decoded pages are handed on after so many bytes, each page whole.
BATCH_BYTES = 1 << 24
#: Decoded bytes for each stored one, at most: a PackBits run has 128 bytes in 2, LZW 4,096 in 9 bits, deflate 258 in 2 bits.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}

PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, feature string, error string"


def unpack_bits(data: bytes, need: int | None = None) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and (need is None or len(out) < need):
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def unpack_lzw(data: bytes, need: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; widths change one code early."""
    out: list[bytes] = []
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    width, bits, have, last, size = 9, 0, 0, None, 0
    for byte in data:
        bits, have = (bits << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257 or (need is not None and size >= need):
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise ValueError("LZW code beyond the table")
        out.append(entry)
        size += len(entry)
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _inflate(data: bytes, compression: int, need: int) -> bytes:
    """At least `need` bytes, if there are as many; no more than one run, code or block beyond."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, need)
    if compression == LZW:
        return unpack_lzw(data, need)
    return zlib.decompressobj().decompress(data, need)


def _undo(raw: np.ndarray, predictor: int, order: str, bits: int) -> np.ndarray:
    """raw: rows x columns x samples x bytes of a sample; returns samples in the file's byte order."""
    if predictor == 1:
        return raw
    rows, columns, samples, size = raw.shape
    if predictor == 2:
        if size not in (1, 2, 4, 8):
            raise ValueError(f"differences of samples of {bits} bits are not supported")
        kind = np.dtype(f"{order}u{size}")
        values = raw.reshape(rows, columns, samples * size).view(kind).reshape(rows, columns, samples)
        return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")).astype(kind).view(np.uint8).reshape(raw.shape)
    if predictor == 3 and bits in (16, 32, 64):
        flat = raw.reshape(rows, columns * size, samples)
        planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        best = planes.transpose(0, 2, 1)  # most significant byte first
        return np.ascontiguousarray(best if order == ">" else best[:, :, ::-1]).reshape(raw.shape)
    raise ValueError(f"predictor {predictor} with {bits} bits is not supported")


def _split(rows: np.ndarray, bits: int, fill_order: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits as bytes; each row begins with a new byte. fill_order 2: the lowest bit comes first."""
    single = np.unpackbits(rows, axis=1, bitorder="little" if fill_order == 2 else "big").reshape(len(rows), -1, bits)
    return (single << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def _directory(blob: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(f"{order}H", blob, at)
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", blob, at + 2 + 12 * k)
        if kind not in TYPE_BYTES:
            continue
        place = at + 10 + 12 * k
        if TYPE_BYTES[kind] * count > 4:
            (place,) = struct.unpack_from(f"{order}I", blob, place)
        if kind in (1, 3, 4):
            if place + TYPE_BYTES[kind] * count > len(blob):
                raise ValueError("a field lies beyond the end")
            fields[tag] = struct.unpack_from(f"{order}{count}{'BHI'[(0, 0, 0, 1, 2)[kind]]}", blob, place)
    (after,) = struct.unpack_from(f"{order}I", blob, at + 2 + 12 * n)
    return fields, after


def _page(blob: bytes, tags: dict[int, tuple], order: str) -> dict:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(TAG_WIDTH, 0), one(TAG_HEIGHT, 0), one(TAG_SAMPLES, 1)
    bits, compression, predictor, planar = one(TAG_BITS, 1), one(TAG_COMPRESSION, NONE), one(TAG_PREDICTOR, 1), one(TAG_PLANAR, 1)
    if bits not in (1, 2, 4, 8, 16, 24, 32, 64) or len(set(tags.get(TAG_BITS, (bits,)))) > 1:
        raise ValueError(f"samples of {bits} bits are not supported")
    if compression not in EXPANSION:
        raise ValueError(f"compression {compression} is not supported")
    if predictor != 1 and bits < 8:
        raise ValueError(f"predictor {predictor} with {bits} bits is not supported")
    size, tiled = max(1, bits // 8), TAG_TILE_OFFSETS in tags
    block_w = one(TAG_TILE_WIDTH, 0) if tiled else width
    block_h = one(TAG_TILE_HEIGHT, 0) if tiled else min(one(TAG_ROWS_PER_STRIP, height), height)
    at, lengths = tags[TAG_TILE_OFFSETS if tiled else TAG_STRIP_OFFSETS], tags[TAG_TILE_BYTES if tiled else TAG_STRIP_BYTES]
    if not (width and height and block_w and block_h and samples):
        raise ValueError("an empty image")
    across, down = -(-width // block_w), -(-height // block_h)
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if len(at) < across * down * planes or len(lengths) < across * down * planes:
        raise ValueError("too few strips or tiles")
    line = -(-block_w * deep * bits // 8)
    stored = sum(min(n, max(0, len(blob) - a)) for a, n in zip(at, lengths, strict=False))
    if height * width * samples * size > MAX_PAGE_BYTES or line * block_h > MAX_PAGE_BYTES:
        raise ValueError(f"a page of more than {MAX_PAGE_BYTES} bytes")
    if height * -(-width * deep * bits // 8) * planes > EXPANSION[compression] * stored:
        raise ValueError("fewer stored bytes than the page needs")
    image = np.zeros((height, width, samples, size), np.uint8)
    for k in range(across * down * planes):
        plane, where = divmod(k, across * down)
        y, x = where // across * block_h, where % across * block_w
        tall = block_h if tiled else min(block_h, height - y)
        need = tall * line
        raw = np.frombuffer(_inflate(blob[at[k] : at[k] + lengths[k]], compression, need), np.uint8)[:need]
        if len(raw) < need:
            raise ValueError("a strip or tile is too short")
        if bits < 8:
            raw = _split(raw.reshape(tall, line), bits, one(TAG_FILL_ORDER, 1))[:, : block_w * deep]
        block = _undo(np.ascontiguousarray(raw).reshape(tall, block_w, deep, size), predictor, order, bits)
        part = block[: height - y, : width - x]
        if planar == 2:
            image[y : y + part.shape[0], x : x + part.shape[1], plane] = part[:, :, 0]
        else:
            image[y : y + part.shape[0], x : x + part.shape[1]] = part
    return {
        "width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "tiled": tiled,
        "pixels": image.tobytes(), "feature": feature(image),
    }


def feature(image: np.ndarray) -> str:
    """Mean of each of 8 vertical bands and a histogram of 8 levels (in 255ths), as hexadecimal text."""
    flat = image.reshape(image.shape[0], -1)
    means = [int(part.mean()) if part.size else 0 for part in np.array_split(flat, 8, axis=1)]
    counts = np.bincount(flat.ravel() >> 5, minlength=8)
    return bytes(means).hex() + bytes((counts * 255 // max(1, flat.size)).tolist()).hex()


def read_pages(blob: bytes | None) -> Iterator[dict]:
    """The pages of one file, in the order of its directories."""
    if not blob:
        return
    number, seen, damage = 0, set(), (KeyError, ValueError, TypeError, IndexError, OverflowError, MemoryError, struct.error, zlib.error)
    failed = lambda problem: {"page": number, "error": f"{type(problem).__name__}: {problem}"[:200]}
    try:
        order = {b"II": "<", b"MM": ">"}[blob[:2]]
        magic, at = struct.unpack_from(f"{order}HI", blob, 2)
        if magic != 42:
            raise ValueError(f"not a classic TIFF: {magic}")
        while at and at not in seen:
            seen.add(at)
            tags, at = _directory(blob, at, order)
            try:
                page = {"page": number, **_page(blob, tags, order), "error": None}
            except damage as problem:
                page = failed(problem)
            yield page
            number += 1
    except damage as problem:
        yield failed(problem)


def write_page(payload: bytes, width: int = WIDTH, rows: int = ROWS_PER_STRIP) -> bytes:
    """One grey 8-bit page of `width` columns: horizontal differences, deflate, strips of `rows` rows."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    delta = image.copy()
    delta[:, 1:] -= image[:, :-1]
    strips = [zlib.compress(delta[y : y + rows].tobytes(), 1) for y in range(0, len(image), rows)]
    n = len(strips)
    sizes, body = [len(s) for s in strips], b"".join(strips)
    places = (8 + np.cumsum([0, *sizes[:-1]])).tolist()
    pad = b"\0" * (len(body) % 2)
    lists = 8 + len(body) + len(pad)
    entries = [
        (TAG_WIDTH, 4, 1, width), (TAG_HEIGHT, 4, 1, len(image)), (TAG_BITS, 3, 1, 8), (TAG_COMPRESSION, 3, 1, DEFLATE), (TAG_PHOTOMETRIC, 3, 1, 1),
        (TAG_STRIP_OFFSETS, 4, n, places[0] if n == 1 else lists), (TAG_SAMPLES, 3, 1, 1), (TAG_ROWS_PER_STRIP, 4, 1, rows),
        (TAG_STRIP_BYTES, 4, n, sizes[0] if n == 1 else lists + 4 * n), (TAG_PLANAR, 3, 1, 1), (TAG_PREDICTOR, 3, 1, 2),
    ]
    tables = b"" if n == 1 else struct.pack(f"<{2 * n}I", *places, *sizes)
    head = struct.pack("<2sHI", b"II", 42, lists + len(tables))
    fields = b"".join(struct.pack("<HHI", t, k, c) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, c, v in entries)
    return head + body + pad + tables + struct.pack("<H", len(entries)) + fields + b"\0\0\0\0"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Each text as a TIFF file: UTF-8 bytes, padded with blanks to a positive multiple of `width`.

    Returns the id, n_bytes (unpadded) and media. A null text is stored as an empty one.
    """

    def run(batches):
        for batch in (part for whole in batches for part in blocks(whole)):
            data, offsets = utf8(batch.column(1))
            ends, raw = offsets.tolist(), data.tobytes()
            media = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                media.append(write_page(raw[a:b] + b" " * (max(width, -(-(b - a) // width) * width) - (b - a)), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", id_col)


def tiff_pages(files: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of the files in `media_col`, with the columns of `files` repeated.

    A column of `files` that is named like a result column is replaced by the result.
    """
    names = [f.strip().split(" ")[0] for f in PAGE_SCHEMA.split(",")]
    kept = files.select(*[F.col(quoted(c)) for c in files.columns if c not in names])
    position, carried = kept.columns.index(media_col), kept.columns

    def run(batches):
        for batch in batches:
            rows, pages, held = [], [], 0

            def found() -> pa.RecordBatch:
                taken = batch.take(pa.array(rows, pa.int64()))
                made = [pa.array([p.get(n) for p in pages], kinds[n]) for n in names]
                return pa.RecordBatch.from_arrays([*taken.columns, *made], names=[*carried, *names])

            for k, blob in enumerate(batch.column(position)):
                for page in read_pages(blob.as_py()):
                    rows.append(k)
                    pages.append(page)
                    held += len(page.get("pixels") or b"")
                    if held >= BATCH_BYTES or len(rows) >= 256:
                        yield found()
                        rows, pages, held = [], [], 0
            if rows:
                yield found()

    of = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    kinds = {f.strip().split(" ")[0]: of[f.strip().split(" ")[1]] for f in PAGE_SCHEMA.split(",")}
    return map_rows(kept, run, extended(kept.schema, *StructType.fromDDL(PAGE_SCHEMA).fields))


def text_media_digest(docs: DataFrame) -> DataFrame:
    """What each text of `docs` (doc_id, text) looks like after it was stored as TIFF and read back."""
    pages = tiff_pages(store_texts(docs))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "page",
        "width",
        "height",
        "error",
    )
