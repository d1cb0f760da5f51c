"""Language identification by cross-parsing: how few phrases of a language's sample make up a text.

For each language a bounded sample of labelled text is folded to a small alphabet and turned into a suffix
automaton. A text is parsed greedily into the longest phrases that occur in the sample; the phrase count,
normalised as phrases * log2(sample size) / symbols (the cross-entropy estimate in bits a symbol), is lowest
for the language that wins. Texts are parsed in blocks of BLOCK symbols, all blocks at once, so a phrase ends
at the latest where its block ends; every block of every text is parsed.

Bounds: a language's sample is SAMPLE_SYMBOLS symbols, drawn from the whole texts of at most SAMPLE_ROWS rows (those
with the smallest hashed ids): every text gives a stretch of the same length, or all it has, from a hashed place. Samples are
collected and broadcast. Each makes at most twice as many states of ALPHABET transitions; a worker holds those of GROUP
languages at a time, and goes through further groups for each batch of texts where there are more languages.

Defined cases: a null text, or one without letters, is `und` with score 0; without any labelled row every
text is `und`; a language whose sample has no letters can't win; ties go to the first language by name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import map_rows
from ._text import blocks, code_points, utf8

SAMPLE_SYMBOLS = 1 << 14
SAMPLE_ROWS = 64
GROUP = 16
ALPHABET = 48
BLOCK = 1024
UNKNOWN = "und"


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane: 0 for what is no letter, a to z, and 21 more for other letters."""
    table = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()[0]
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 21
    return table


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols, each run of other characters as one 0, and the texts' offsets in them."""
    points, at = code_points(data, offsets)
    table = symbol_table()
    plain = table[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    plain[far] = [27 + c % 21 if chr(c).isalpha() else 0 for c in points[far].tolist()]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 0) | (plain[:-1] != 0)
    firsts = at[:-1][at[:-1] < at[1:]]
    keep[firsts] = True
    left = np.concatenate([[0], np.cumsum(keep)])
    return plain[keep], left[at]


def suffix_automaton(text: bytes) -> np.ndarray:
    """Transitions states x ALPHABET of the automaton of all substrings; -1 where none goes on."""
    link, size, after = [-1], [0], [[-1] * ALPHABET]
    last = 0
    for c in text:
        now = len(size)
        size.append(size[last] + 1)
        link.append(0)
        after.append([-1] * ALPHABET)
        p = last
        while p != -1 and after[p][c] == -1:
            after[p][c] = now
            p = link[p]
        if p != -1:
            q = after[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                copy = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                after.append(after[q][:])
                while p != -1 and after[p][c] == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return np.array(after, np.int32)


def parse_table(text: bytes) -> np.ndarray:
    """The automaton as a parser: where a phrase can't go on, the next begins with that symbol.

    An entry is the next state times ALPHABET, with the sign bit set where a phrase begins.
    """
    step = suffix_automaton(text)
    fresh = np.maximum(step[0], 0)
    target = np.where(step >= 0, step, fresh[None, :]) * ALPHABET
    return np.where(step >= 0, target, target | np.int32(-(1 << 31))).astype(np.int32).ravel()


def phrase_counts(codes: np.ndarray, at: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text (rows) by each language's sample (columns)."""
    size = np.diff(at)
    rows = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(size)), rows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    begin = at[owner] + nth * BLOCK
    length = np.minimum(BLOCK, at[owner + 1] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    counts = np.zeros((len(tables), len(order)), np.int32)
    states = [np.zeros(len(order), np.int32) for _ in tables]
    mask = np.int32((1 << 31) - 1)
    live = len(order)
    for j in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length[:live], -j, side="left"))
        c = codes[begin[:live] + j]
        for k, table in enumerate(tables):
            state = states[k][:live]
            np.add(state, c, out=state)
            found = table[state]
            counts[k, :live] += found < 0
            np.bitwise_and(found, mask, out=state)
    out = np.zeros((len(size), len(tables)))
    for k in range(len(tables)):
        out[:, k] = np.bincount(owner[order], counts[k] + 1, minlength=len(size))  # the block's first phrase
    return out


def _stretches(batches):
    """Of each text its number of symbols, and a stretch of at most SAMPLE_SYMBOLS of them from a hashed place."""
    for batch in batches:
        for part in blocks(batch):
            codes, at = symbols(*utf8(part.column(part.schema.get_field_index("text"))))
            rows = zip(at[:-1].tolist(), np.diff(at).tolist(), part.column(part.schema.get_field_index("draw")).to_pylist(), strict=True)
            found = [codes[a + (place := draw % max(1, n - SAMPLE_SYMBOLS + 1)) : a + min(n, place + SAMPLE_SYMBOLS)].tobytes() for a, n, draw in rows]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in ("lang", "draw")), pa.array(found, pa.binary())], names=["lang", "draw", "codes"])


def _sample(table: pa.Table) -> pa.Table:
    """The sample of one language from the stretches of its rows."""
    rows = sorted(zip(table.column("draw").to_pylist(), table.column("codes").to_pylist(), strict=True))
    size = sorted(len(c) + 1 for _, c in rows)
    share, left = SAMPLE_SYMBOLS, SAMPLE_SYMBOLS  # each row's part where the short ones leave theirs to the others
    for k, n in enumerate(size):
        share = left // (len(size) - k)
        if n > share:
            break
        left -= n
    keep = [c if len(c) + 1 <= share else c[(p := draw % (len(c) - share + 2)) : p + share - 1] for draw, c in rows]
    return pa.table([pa.array([table.column("lang")[0].as_py()], pa.string()), pa.array([b"".join(c + b"\0" for c in keep if c)], pa.binary())], names=["lang", "sample"])


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Sample of symbols of each language, from rows of `labelled` with a language. See the bounds above."""
    known = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("draw"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = Window.partitionBy("lang").orderBy("draw", "id")
    chosen = known.select("lang", "draw", "id").withColumn("place", F.row_number().over(first)).where(F.col("place") <= SAMPLE_ROWS).select("lang", "id").distinct()
    texts = known.join(F.broadcast(chosen), ["lang", "id"]).select("lang", "draw", "text").mapInArrow(_stretches, "lang string, draw long, codes binary")
    again = Window.partitionBy("lang").orderBy("draw", "codes")  # an id may have many rows
    few = texts.withColumn("place", F.row_number().over(again)).where(F.col("place") <= SAMPLE_ROWS).select("lang", "draw", "codes")
    samples = {r.lang: bytes(r.sample) for r in few.groupBy("lang").applyInArrow(_sample, "lang string, sample binary").collect()}
    return {k: v for k, v in sorted(samples.items()) if any(v)}


@lru_cache(maxsize=GROUP)
def _table(sample: bytes) -> np.ndarray:
    return parse_table(sample)


def _costs(codes: np.ndarray, at: np.ndarray, samples: list[bytes]) -> np.ndarray:
    """Bits a symbol of each text (rows) by each sample (columns)."""
    found = [np.zeros((len(at) - 1, 0))]
    for k in range(0, len(samples), GROUP):
        own = samples[k : k + GROUP]
        weight = np.array([np.log2(max(2, len(t))) for t in own])
        found.append(phrase_counts(codes, at, [_table(t) for t in own]) * weight)
    return np.concatenate(found, axis=1) / np.maximum(1, np.diff(at))[:, None]


def _predict(column: pa.Array, samples: dict[str, bytes]) -> tuple[np.ndarray, ...]:
    """Language, score, letters and bits a symbol of each text."""
    codes, at = symbols(*utf8(column))
    n, names = len(at) - 1, list(samples)
    letters = np.diff(np.concatenate([[0], np.cumsum(codes != 0)])[at])
    pred, score, bits = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
    good = letters > 0
    if names:
        cost = _costs(codes, at, list(samples.values()))
        rank = np.argsort(cost, axis=1, kind="stable")
        lines = np.arange(n)
        best = cost[lines, rank[:, 0]]
        pred[good] = np.array(names, object)[rank[good, 0]]
        bits[good] = best[good]
        score[good] = np.clip(1 - best / np.maximum(cost[lines, rank[:, 1]], 1e-12), 0, 1)[good] if len(names) > 1 else 1.0
    return pred, score, letters, bits


def _parts(batches, text: str, samples: dict[str, bytes]):
    """Blocks of the batches; whole batches where tables of several groups have to be made for each."""
    for batch in batches:
        yield from blocks(batch, text, *([16 << 20] if len(samples) > GROUP else []))


def identify(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score of each text, with its letters and the winner's bits a symbol.

    score: how much lower the winner's bits a symbol are than the second language's (1 with one language).
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches):
        for part in _parts(batches, "text", shared.value):
            pred, score, letters, bits = _predict(part.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(letters), pa.array(bits)], names=["key", "lang_pred", "score", "letters", "bits"])

    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(run, f"key {kind}, lang_pred string, score double, letters long, bits double").withColumnRenamed("key", id_col)


def keep_known(docs: DataFrame, samples: dict[str, bytes], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose text is in some language, with that language in `lang_col`; the others (`und`) go."""
    columns, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(samples)
    position, target = columns.index(text_col), columns.index(lang_col)

    def run(batches):
        for part in _parts(batches, text_col, shared.value):
            pred = _predict(part.column(position), shared.value)[0]
            arrays = [pa.array(pred, pa.string()) if k == target else c for k, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(pred != UNKNOWN, pa.bool_()))

    return map_rows(docs, run, docs.schema)


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus` (a null id: 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % modulus, F.lit(0))
