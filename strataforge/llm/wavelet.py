"""Token ids in wavelet matrices, a file per shard: access, counting and occurrence lookup without unpacking the rest.

A shard holds the ids of successive documents. Level by level, from the highest bit of an id to the lowest, the file
has one bit of every id (a plane); behind each plane the ids with a 0 come first, those with a 1 next, their order kept. A
plane is cut into chunks of CHUNK bits; each is deflated on its own and its directory entry says how many 1s
come before it, so rank and select open one chunk.

    magic WMX1, levels (1 byte), ids, ids before it in its part, documents, size of the next section (unsigned, 8 bytes each)
    an Arrow stream of the documents (key, tokens), deflated
    for each plane: number of zeros, size of its chunks (8 bytes each); (1s before, byte offset) of each chunk and of the end; chunks

`write_shards` sorts the documents by key (and text, for repeated keys) through ranges; each task writes its range's shards one after another, as rows of a
Parquet table with the file in a binary column, so any store that Spark writes to will do. A shard is closed at SHARD ids; a
document is never split, so a task holds one shard and its longest document. Each file knows how many ids its range has
before it, so that only one sum for each range has to be known to number all ids.

Defined cases: a null or empty text consists of the end id; null keys come first; repeated rows are documents of their own;
an empty table gives no shards; columns other than key and text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from . import packing
from ._text import blocks, utf8

SHARD = 1 << 20
#: Bits of a chunk.
CHUNK = 1 << 16
MAGIC = b"WMX1"
_HEAD = struct.Struct("<4sBQQQQ")
_PLANE = struct.Struct("<QQ")


def build(ids: np.ndarray, keys: pa.Array, tokens: np.ndarray, before: int = 0) -> bytes:
    """The file of `ids`, whose documents have these keys and numbers of ids."""
    n = len(ids)
    levels = max(1, int(ids.max()).bit_length() if n else 1)
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([keys, pa.array(tokens, pa.int64())], names=["key", "tokens"])
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    documents = zlib.compress(sink.getvalue(), 1)
    out = [_HEAD.pack(MAGIC, levels, n, before, len(tokens), len(documents)), documents]
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels - 1, -1, -1):
        ones = (now >> now.dtype.type(level)) & now.dtype.type(1) != 0
        packed = np.packbits(ones, bitorder="little")
        chunks = [zlib.compress(packed[i : i + CHUNK // 8].tobytes(), 1) for i in range(0, len(packed), CHUNK // 8)]
        counts = np.add.reduceat(ones, np.arange(0, n, CHUNK), dtype=np.int64) if n else np.zeros(0, np.int64)
        directory = np.zeros((len(chunks) + 1, 2), "<u8")
        directory[1:, 0], directory[1:, 1] = np.cumsum(counts), np.cumsum([len(c) for c in chunks])
        out += [_PLANE.pack(n - int(counts.sum()), int(directory[-1, 1])), directory.tobytes(), *chunks]
        now = np.concatenate([now[~ones], now[ones]])
    return b"".join(out)


class Shard:
    """A file opened for reading. Positions count ids of this shard from 0; arrays of positions are answered together."""

    def __init__(self, data: bytes):
        data = memoryview(data)
        magic, self.levels, self.n, self.before, self.documents, size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = _HEAD.size
        self._documents = data[at : at + size]
        at += size
        self.zeros, self._directory, self._chunks = [], [], []
        for _ in range(self.levels):
            zeros, size = _PLANE.unpack_from(data, at)
            at += _PLANE.size
            entries = -(-self.n // CHUNK) + 1
            self._directory.append(np.frombuffer(data, "<u8", 2 * entries, at).reshape(entries, 2).astype(np.int64))
            at += 16 * entries
            self.zeros.append(zeros)
            self._chunks.append(data[at : at + size])
            at += size
        self._bits = lru_cache(maxsize=64)(self._open)

    def documents_table(self) -> tuple[pa.Array, np.ndarray]:
        """Keys and numbers of ids of the documents."""
        with pa.ipc.open_stream(zlib.decompress(self._documents)) as stream:
            table = stream.read_all().combine_chunks()
        empty = pa.array([], table.schema.field("key").type)
        return table.column(0).chunk(0) if table.num_rows else empty, table.column(1).to_numpy()

    def _open(self, level: int, chunk: int) -> np.ndarray:
        at = self._directory[level][:, 1]
        raw = zlib.decompress(self._chunks[level][at[chunk] : at[chunk + 1]])
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: min(CHUNK, self.n - chunk * CHUNK)]

    def rank(self, level: int, positions: np.ndarray) -> np.ndarray:
        """How many 1s the plane has before each position (up to n)."""
        chunk = positions // CHUNK
        out = self._directory[level][chunk, 0]
        for c in np.unique(chunk[chunk * CHUNK < self.n]).tolist():
            own = chunk == c
            sums = np.concatenate([[0], np.cumsum(self._bits(level, c), dtype=np.int64)])
            out[own] += sums[positions[own] - c * CHUNK]
        return out

    def select(self, level: int, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Positions of the bits with so many equal ones before them."""
        ones = self._directory[level][:, 0]
        before = ones if bit else np.minimum(np.arange(len(ones)) * CHUNK, self.n) - ones
        chunk = np.searchsorted(before, ranks, side="right") - 1
        out = np.empty(len(ranks), np.int64)
        for c in np.unique(chunk).tolist():
            own = chunk == c
            out[own] = c * CHUNK + np.flatnonzero(self._bits(level, c) == bit)[ranks[own] - before[c]]
        return out

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The ids at these positions."""
        at, value = np.asarray(positions, np.int64), np.zeros(len(positions), np.int64)
        for level in range(self.levels):
            ones = self.rank(level, at)
            chunk, bit = at // CHUNK, np.zeros(len(at), np.int64)
            for c in np.unique(chunk).tolist():
                own = chunk == c
                bit[own] = self._bits(level, c)[at[own] - c * CHUNK]
            value = value << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return value

    def range_of(self, token: int, start: int = 0, end: int | None = None) -> tuple[int, int]:
        """Where the token's occurrences in [start, end) stand behind the last plane; their number is the difference."""
        edges = np.array([start, self.n if end is None else end], np.int64)
        if token < 0 or token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            ones = self.rank(level, edges)
            edges = self.zeros[level] + ones if token >> (self.levels - 1 - level) & 1 else edges - ones
        return int(edges[0]), int(edges[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self.range_of(token, start, end)
        return b - a

    def find(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Positions of the token in [start, end), ascending."""
        at = np.arange(*self.range_of(token, start, end), dtype=np.int64)
        for level in range(self.levels - 1, -1, -1) if len(at) else ():
            bit = token >> (self.levels - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def extract(self) -> np.ndarray:
        """All ids, from whole planes."""
        value, place = np.zeros(self.n, np.uint32), np.arange(self.n, dtype=np.int32)
        for level in range(self.levels):
            at = self._directory[level][:, 1].tolist()
            raw = b"".join(zlib.decompress(self._chunks[level][a:b]) for a, b in zip(at[:-1], at[1:], strict=True))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").astype(bool)
            upper = place[ones]
            value[upper] |= np.uint32(1 << (self.levels - 1 - level))
            place = np.concatenate([place[~ones], upper])
        return value


def write_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> None:
    """Writes (part, shard, before, tokens, documents, file) of all documents in ascending order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = packing.load(tokenizer), TaskContext.get().partitionId()
        keys, ids, totals, held, before, number = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            tokens = np.concatenate(totals)
            file = build(np.concatenate(ids), pa.concat_arrays(keys), tokens, before)
            values = [part, number, before, held, len(tokens), file]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=SHARDS.names)

        for batch in batches:
            for own in blocks(batch):
                found, total = packing.text_ids(known, *utf8(own.column(1)))
                edges, at = np.concatenate([[0], np.cumsum(total)]), 0
                while at < len(total):  # as many documents as the shard needs to be full
                    to = min(len(total), int(np.searchsorted(edges, edges[at] + shard - held)))
                    keys.append(own.column(0).slice(at, to - at))
                    ids.append(found[edges[at] : edges[to]])
                    totals.append(total[at:to])
                    held, at = held + int(edges[to] - edges[at]), to
                    if held >= shard:
                        yield close()
                        keys, ids, totals, before, number, held = [], [], [], before + held, number + 1, 0
        if totals:
            yield close()

    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    ordered = chosen.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", "text")
    ordered.mapInArrow(run, SHARDS).write.option("parquet.block.size", 32 << 20).option("compression", "none").parquet(path)


SHARDS = StructType([StructField("part", IntegerType()), StructField("shard", IntegerType()), StructField("before", LongType()), StructField("tokens", LongType()), StructField("documents", LongType()), StructField("file", BinaryType())])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The stored shards with `start`, the number of ids in all files before. What is broadcast is one row for each task that wrote."""
    table = spark.read.schema(SHARDS).parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = table.groupBy("part").agg(F.sum("tokens").alias("all_")).select("part", F.coalesce(F.sum("all_").over(earlier), F.lit(0)).alias("start_"))
    return table.join(F.broadcast(parts), "part").select(*SHARDS.names, (F.col("start_") + F.col("before")).alias("start"))


def _each(shards: DataFrame, schema: StructType, of) -> DataFrame:
    """of(shard, start): the columns of some rows, in the order of the schema."""

    def run(batches):
        for batch in batches:
            for start, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays(of(Shard(file.as_buffer()), start), names=schema.names)

    return shards.select("start", "file").mapInArrow(run, schema)


def document_digests(shards: DataFrame, key_type) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the ids in the files."""
    schema = StructType([StructField("key", key_type), *[StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32")]])

    def of(shard: Shard, start: int):
        keys, tokens = shard.documents_table()
        raw = memoryview(shard.extract().astype("<u4").tobytes())
        edges = np.concatenate([[0], np.cumsum(tokens)])
        at = (4 * edges).tolist()
        return [keys, pa.array(start + edges[:-1]), pa.array(tokens), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())]

    return _each(shards, schema, of)


def documents_ids(shards: DataFrame, key_type) -> DataFrame:
    """(key, start, ids) of every document."""
    schema = StructType([StructField("key", key_type), StructField("start", LongType()), StructField("ids", ArrayType(LongType()))])

    def of(shard: Shard, start: int):
        keys, tokens = shard.documents_table()
        edges = np.concatenate([[0], np.cumsum(tokens)])
        return [keys, pa.array(start + edges[:-1]), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(shard.extract().astype(np.int64)))]

    return _each(shards, schema, of)


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n) of each of these ids, counted in the planes; no ids are unpacked."""
    schema = StructType([StructField("token", LongType()), StructField("n", LongType())])
    found = _each(shards, schema, lambda shard, _: [pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())])
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def token_places(shards: DataFrame, token: int, key_type) -> DataFrame:
    """(key, position, offset) of every occurrence of an id: among all ids, and in its document."""
    schema = StructType([StructField("key", key_type), StructField("position", LongType()), StructField("offset", LongType())])

    def of(shard: Shard, start: int):
        keys, tokens = shard.documents_table()
        places, edges = shard.find(token), np.concatenate([[0], np.cumsum(tokens)])
        document = np.searchsorted(edges, places, side="right") - 1
        return [keys.take(pa.array(document)), pa.array(start + places), pa.array(places - edges[document])]

    return _each(shards, schema, of)
