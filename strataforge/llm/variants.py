"""Spelling variants: words within one edit of each other, found through an index of variable-length grams.

A dictionary of frequent grams decides how long a gram has to be: at every place of a word, closed by ^ and $, the
gram is the shortest one that is not frequent, of at most LONGEST code points. A gram depends on its own code points only,
so an edit affects just the grams that cover it; all others stand in both words, as far from the start (before the edit)
or from the end (behind it). Grams are ordered by an estimate of their number, the rarest first, and a word is
listed under the shortest beginning of this order that no single edit affects as a whole (its bound of affected grams).
The first gram that two near words have in common is among the listed ones of both, so joining the lists loses no pair;
lengths, letters and then the exact distance are compared inside the join.

The dictionary is collected: grams with more than max(LEAST, 3 / DICTIONARY of all places) occurrences are fewer than
DICTIONARY. Lists are joined by Spark's sort-merge join, which spills and splits hot lists; nothing else is collected.
Candidates grow faster than the vocabulary, for lists grow with it.

Defined cases: a null text has no words; a null id counts as the text ''; texts of any length are read whole, in blocks;
repeated rows count each; words with the same count and code points less are the same word; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._text import LOWER_ASCII, blocks, expand, span_hashes, spans, utf8

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One occurrence in so many is damaged.
DAMAGED = 97
#: Lengths of grams. A word of LEAST_LENGTH code points has grams apart from any edit while LONGEST is at most that.
SHORTEST, LONGEST = 2, 5
#: Grams with at most so many occurrences are never made longer.
LEAST = 100
DICTIONARY = 1 << 19
#: Runs with more bytes are checked one by one.
LONG_RUN = 64

_TABLE = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
_TABLE ^= _TABLE[0]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF (C3 and the byte behind it in UTF-8)."""
    lead = data == 0xC3
    member = _LETTER[data] | lead
    member[1:] |= lead[:-1]
    return member


def run_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run, going on from the checksum `before` of what stands in front of it."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, register = starts[order], before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    ascending = sizes[order][::-1]
    for j in range(min(LONG_RUN, int(sizes.max()) if len(sizes) else 0)):
        k = len(order) - int(np.searchsorted(ascending, j, side="right"))  # runs with more than j bytes
        own = register[:k]
        register[:k] = _TABLE[(own ^ data[at[:k] + j]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(sizes > LONG_RUN).tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    return out


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int | None = DAMAGED, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): runs of letters in lower case (A-Z only) of at least `least` code points, counted by block of text.

    damaged: with h the crc32 of '<id>:<run>', a run whose h it divides loses its code point h % length; None leaves all whole.
    """

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                data, offsets = utf8(part.column(1))
                starts, ends = spans(data, offsets, _letters(data))
                if not len(starts):
                    continue
                lowered = LOWER_ASCII[data]
                lead = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
                points = lead[ends] - lead[starts]
                whole, changed = np.ones(len(starts), bool), Counter()
                if damaged:
                    ids = ["" if i is None else i for i in part.column(0).to_pylist()]
                    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
                    sums = run_checksums(lowered, starts, ends, heads[np.searchsorted(offsets, starts, side="right") - 1])
                    whole = sums % damaged != 0
                    for k in np.flatnonzero(~whole & (points > least)).tolist():
                        word, place = lowered[starts[k] : ends[k]].tobytes().decode(errors="replace"), int(sums[k]) % int(points[k])
                        changed[word[:place] + word[place + 1 :]] += 1
                kept = np.flatnonzero(whole & (points >= least))
                starts, ends = starts[kept], ends[kept]
                _, first, n = np.unique(span_hashes(lowered, starts, ends), return_index=True, return_counts=True)
                sizes = (ends - starts)[first]
                raw = lowered[expand(starts[first], sizes)]
                found = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([found, pa.array(list(changed), pa.string())]), pa.concat_arrays([pa.array(n, pa.int64()), pa.array(list(changed.values()), pa.int64())])], names=["word", "n"])

    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT, **how) -> DataFrame:
    """(word, n) of all words with at least so many occurrences."""
    return occurrences(docs, **how).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, least: int = LEAST, size: int = DICTIONARY) -> dict[str, int]:
    """Frequent grams of `shortest` to `longest` - 1 code points with their numbers: fewer than `size`.

    A beginning of a frequent gram is frequent as well, so a gram grows for as long as it is found here.
    """
    closed = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    places = closed.agg(F.sum(F.length("w"))).first()[0] or 0
    most = max(least, -(-(longest - shortest) * places // size))

    def of_length(q: int):
        return F.transform(F.sequence(F.lit(1), F.length("w") - (q - 1)), lambda i: F.substr(F.col("w"), i, F.lit(q)))

    grams = F.flatten(F.array(*[of_length(q) for q in range(shortest, longest)]))
    counted = closed.where(F.length("w") >= longest - 1).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r.gram: r.n for r in counted.where(F.col("n") > most).toLocalIterator()}


def decompose(word: str, frequent: dict[str, int], shortest: int = SHORTEST, longest: int = LONGEST) -> list[tuple[int, int]]:
    """Start and end of the gram at every place of a closed word."""
    n, out = len(word), []
    for start in range(n - shortest + 1):
        end = start + shortest
        while end < n and end - start < longest and word[start:end] in frequent:
            end += 1
        out.append((start, end))
    return out


def estimate(gram: str, frequent: dict[str, int]) -> float:
    """About how often a gram occurs: its number if it is frequent, else from its two largest parts as if they were independent."""
    if gram in frequent:
        return frequent[gram]
    inner = frequent.get(gram[1:-1], 0)
    return frequent.get(gram[:-1], 1) * frequent.get(gram[1:], 1) / inner if inner else 0.0


def listed(word: str, frequent: dict[str, int], weights: dict[str, float], shortest: int = SHORTEST, longest: int = LONGEST) -> list[tuple[int, int]]:
    """The rarest grams of a closed word, up to the first that makes it impossible for one edit to affect them all."""
    def weight(gram: str) -> float:
        if gram not in weights:
            if len(weights) > 1 << 17:
                weights.clear()
            weights[gram] = estimate(gram, frequent)
        return weights[gram]

    ranked = sorted((weight(word[a:b]), word[a:b], a, b) for a, b in decompose(word, frequent, shortest, longest))
    out, last_start, first_end = [], 0, len(word)
    for _, _, a, b in ranked:
        out.append((a, b))
        last_start, first_end = max(last_start, a), min(first_end, b)
        if last_start >= first_end:
            break
    return out


def index(words: DataFrame, frequent: dict[str, int], shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(gram, from_end, word, n, length, letters): a row for each listed gram, by its distance from the start and from the end.

    gram: a hash of the distance, its side and the gram; letters: a bit for each letter (by hash), of which an edit changes two at most.
    """
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        dictionary, weights = shared.value, {}
        for batch in batches:
            for part in blocks(batch, "word", 1 << 18):
                keys, side, row, lengths, letters = [], [], [], [], []
                for k, word in enumerate(part.column(0).to_pylist()):
                    closed = f"^{word}$"
                    for a, b in listed(closed, dictionary, weights, shortest, longest):
                        gram = closed[a:b].encode()
                        keys += [zlib.crc32(gram, a) | zlib.adler32(gram, 1) << 32, zlib.crc32(gram, len(closed) - b + (1 << 20)) | zlib.adler32(gram, 2) << 32]
                        side += [False, True]
                        row += [k, k]
                    bits = 0
                    for c in word:
                        bits |= 1 << ord(c) * 7 % 61
                    lengths.append(len(word))
                    letters.append(bits)
                row, lengths, letters = np.array(row, np.int64), np.array(lengths, np.int32), np.array(letters, np.int64)
                taken = pa.array(row)
                columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(side, pa.bool_()), part.column(0).take(taken), part.column(1).take(taken), pa.array(lengths[row]), pa.array(letters[row])]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "from_end", "word", "n", "length", "letters"])

    return words.select("word", "n").mapInArrow(run, "gram long, from_end boolean, word string, n long, length int, letters long")


def near_pairs(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, least_length: int = LEAST_LENGTH, **dictionary) -> DataFrame:
    """(word, n, near, near_n): each word with each word that one inserted, deleted or replaced code point makes of it.

    words: (word, n), each word once, of at least least_length code points, which `longest` must not exceed. Candidates are compared under every list
    they share, but for words of one length only under those from the start, where they share one as well.
    """
    if longest > least_length or shortest < 2:
        raise ValueError("grams must have 2 code points at least and at most as many as the shortest word")
    rows = cut(index(words, gram_dictionary(words, shortest, longest, **dictionary), shortest, longest))
    a, b = rows.alias("a"), rows.alias("b")
    longer = F.col("b.length") - F.col("a.length")
    ordered = (longer == 1) | ((longer == 0) & ~F.col("a.from_end") & (F.col("a.word") < F.col("b.word")))
    close = F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2
    exact = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    found = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.from_end") == F.col("b.from_end")) & ordered & close & exact)
    both = F.explode(F.array(*[F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("near"), F.col(f"{y}.n").alias("near_n")) for x, y in ("ab", "ba")]))
    return found.select(both.alias("p")).select("p.*").dropDuplicates(["word", "near"])


def with_roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to their last.

    Each turn doubles the steps taken. A form has at least twice its word's count, so chains have at most 63 links and 6 turns do.
    """
    at = cut(links.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at


def group_variants(words: DataFrame, times: int = 2, **how) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word's most frequent near word, if it is `times` as frequent, and where such steps end.

    Ties go to the smaller word in code-point order. n_near is 0 for a word without near words.
    """
    words = cut(words)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = near_pairs(words, **how).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left")
    enough = F.col("best.near_n") >= times * F.col("n")
    table = cut(known.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near_n")).alias("form_n")))
    roots = with_roots(table.where("form IS NOT NULL"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
