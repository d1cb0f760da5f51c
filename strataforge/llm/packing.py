"""Packing by powers of two: no padding, and no sequence crosses documents.

A document of T ids is cut from its start into floor(T / 2048) pieces of 2,048 ids and then into one piece
for each binary digit of the rest, the longest first. Every piece is a sequence of its own whose length is a
power of two, so nothing is padded; sequences of one length make up a bucket, and a training batch takes
2^k of them. Each document's ids end with the end-of-document id.

Ids come from the public word-level BPE file. Its pre-tokenizer never joins across white space, so each block's
distinct words are encoded once and the ids of the texts are gathered from them.

The strings of the file's special tokens in a text become these tokens, as the tokenizer's plain call does it.

Defined cases: a null or empty text consists of the end id alone (one piece of length 1); repeated rows
are packed each on its own.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER_ASCII, blocks, expand, span_hashes, spans, utf8

SEQUENCE = 2048
END_ID = 1
#: Words that are remembered between blocks, at most (each about 40 bytes).
KNOWN_WORDS = 1 << 19
WORDS_PER_CALL = 512
#: White space (\\s) of the pre-tokenizer outside ASCII, and bytes of these in UTF-8.
WIDE_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
PEELED = ".,;:!?%$&#*"
#: A character that never stands in words that are encoded together; words with it are encoded alone.
SEPARATOR = "|"


class WordIds:
    """Ids of words, remembered by hash in sorted arrays of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bar = self.tokenizer.encode(f" {SEPARATOR} ", add_special_tokens=False).ids
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        sizes, alone = np.zeros(len(texts), np.int64), []
        kept: list[np.ndarray] = []
        joined = [k for k, t in enumerate(texts) if SEPARATOR not in t]
        if len(self.bar) == 1:
            groups = [joined[i : i + WORDS_PER_CALL] for i in range(0, len(joined), WORDS_PER_CALL)]
            for group, ids in zip(groups, self._encode([f" {SEPARATOR} ".join([texts[k] for k in g]) for g in groups]), strict=True):
                ids = np.array(ids, np.int32)
                bars = np.flatnonzero(ids == self.bar[0])
                if len(bars) == len(group) - 1:
                    edges = np.concatenate([[-1], bars, [len(ids)]])
                    sizes[group] = np.diff(edges) - 1
                    kept.append(np.delete(ids, bars))
                else:
                    alone += group
                    joined = None
                    break
        else:
            joined = None
        if joined is None:
            found = self._encode(texts)
            return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)
        lonely = [k for k, t in enumerate(texts) if SEPARATOR in t]
        found = self._encode([texts[k] for k in lonely])
        sizes[lonely] = [len(ids) for ids in found]
        order = np.concatenate([np.array(joined, np.int64), np.array(lonely, np.int64)])
        flat = np.concatenate([*kept, np.array([i for ids in found for i in ids], np.int32), np.zeros(0, np.int32)])
        lengths = sizes[order]
        begin = np.empty(len(texts), np.int64)
        begin[order] = np.cumsum(lengths) - lengths
        return flat[expand(begin, sizes)], sizes

    def of(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids with the place and size of each word's ids in it. keys: the words' hashes, ascending."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        seen = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~seen)
        if len(self.keys) + len(new) > KNOWN_WORDS:  # forget what this block doesn't use
            used = at[seen]
            self.ids = self.ids[expand(self.begin[used], self.sizes[used])]
            self.keys, self.sizes = self.keys[used], self.sizes[used]
            self.begin = np.cumsum(self.sizes) - self.sizes
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode(errors="replace") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            flat, sizes = self.encode(texts)
            place = np.searchsorted(self.keys, keys[new])
            self.begin = np.insert(self.begin, place, len(self.ids) + np.cumsum(sizes) - sizes)
            self.keys, self.sizes = np.insert(self.keys, place, keys[new]), np.insert(self.sizes, place, sizes)
            self.ids = np.concatenate([self.ids, flat])
        at = np.searchsorted(self.keys, keys)
        return self.ids, self.begin[at], self.sizes[at]


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space as the pre-tokenizer sees it."""
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    raw = None
    for c in WIDE_SPACES:
        shape = chr(c).encode()
        if not (data == shape[-1]).any():
            continue
        raw = data.tobytes() if raw is None else raw
        at = raw.find(shape)
        while at >= 0:
            white[at : at + len(shape)] = True
            at = raw.find(shape, at + len(shape))
    return white


def _peel(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to 8 closing marks (PEELED) of a word become a word of their own where an ASCII letter stands before them.

    The pre-tokenizer separates them there as well, and far fewer distinct words remain.
    """
    if not len(starts):
        return starts, ends
    mark = np.zeros(256, bool)
    mark[list(PEELED.encode())] = True
    cut = ends.copy()
    for _ in range(8):
        cut -= mark[data[cut - 1]] & (cut - 1 > starts)
    before = data[cut - 1] | 0x20
    split = np.flatnonzero((cut < ends) & (before >= 97) & (before <= 122))
    places = np.stack([starts, np.where(np.isin(np.arange(len(starts)), split), cut, ends)], axis=1)
    more = np.stack([cut[split], ends[split]], axis=1)
    both = np.insert(places, split + 1, more, axis=0)
    return both[:, 0], both[:, 1]


def text_ids(known: WordIds, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each text's closed by the end id, and the number of ids of each."""
    n = len(offsets) - 1
    starts, ends = _peel(data, *spans(data, offsets, ~_white(data)))
    lowered = LOWER_ASCII[data]
    for at in np.unique(np.searchsorted(starts, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), side="right") - 1).tolist():
        lowered[starts[at] : ends[at]] = data[starts[at] : ends[at]]  # words with <|, for special tokens are told by case
    keys, first, number = np.unique(span_hashes(lowered, starts, ends), return_index=True, return_inverse=True)
    pool, place, size = known.of(keys, lowered, starts[first], ends[first])
    document = np.searchsorted(offsets, starts, side="right") - 1
    total = np.bincount(document, size[number], minlength=n).astype(np.int64) + 1
    out = np.empty(int(total.sum()), np.int32)
    close = np.cumsum(total) - 1
    body = np.ones(len(out), bool)
    body[close] = False
    out[close] = END_ID
    out[body] = pool[expand(place[number], size[number])]
    return out, total


def pieces(total: np.ndarray, longest: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of every piece of documents with so many ids."""
    powers = [1 << k for k in range(longest.bit_length() - 1, -1, -1)]
    counts = np.stack([total // longest] + [(total % longest) // p % 2 for p in powers[1:]], axis=1)
    document = np.repeat(np.arange(len(total)), counts.sum(axis=1))
    length = np.repeat(np.tile(powers, len(total)), counts.ravel())
    run = np.cumsum(length) - length
    return document, run - (np.cumsum(total) - total)[document], length


def pack(docs: DataFrame, path: str, longest: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; sequence_id is unique, `bucket` is the binary logarithm of the length.

    longest: a power of two. with_ids adds the piece's ids. Documents with equal ids make equal pieces.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches):
        known = load(path)
        for batch in batches:
            for part in blocks(batch):
                ids, total = text_ids(known, *utf8(part.column(1)))
                document, start, length = pieces(total, longest)
                raw = memoryview(ids.astype("<u4").tobytes())
                edges = (4 * np.concatenate([[0], np.cumsum(length)])).tolist()
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                arrays = [part.column(0).take(pa.array(document)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(total[document])]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    made = chosen.mapInArrow(run, schema).withColumnRenamed("key", id_col)
    return made.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
