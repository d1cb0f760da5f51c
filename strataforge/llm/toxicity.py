"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matches, exception phrases, normalised by length.

Folding: lower case; look-alike letters of other scripts as Latin ones; digits and signs that stand for letters, in a word
that holds at least one letter, as those letters; every run of other characters as one blank. A word is a run of letters
and such signs. Before its first and after its last letter the signs of MARKS are punctuation, and so is what lies beyond
them; only one ! right at the beginning stands for a letter.

The lexicon is learned from labelled texts: whole words and word beginnings of MIN_STEM to MAX_STEM letters, each weighted by
its log odds between toxic and other texts. A longer entry is left out where its beginning weighs as much.
A text's weight is the sum over its matches outside exception phrases, per 100 words (with PRIOR_WORDS more); a
logistic curve turns it into a score from 0 to 1; it is fitted to labelled texts that
the lexicon behind their weights hasn't seen.

Exception phrases are EXCEPTIONS, and two-word phrases round an entry that the labelled texts show to be meant well: seen in at
least LEAST_TEXTS texts, and in other texts relatively more often than in toxic ones.

Bounds: at most SAMPLE_ROWS labelled texts (those with the smallest hashed ids); of their terms those in most toxic texts,
CANDIDATES at most, are weighed, MAX_ENTRIES at most are kept, and MAX_PHRASES exceptions.

Defined cases: a null text is empty; texts without matches, empty ones too, share the lowest score; without
labelled rows of both kinds the lexicon is empty and the score is the share of toxic rows; repeated rows count each.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import blocks, code_points, utf8

SAMPLE_ROWS = 40_000
MAX_ENTRIES = 4_000
CANDIDATES, MAX_PHRASES = 200_000, 2_000
MIN_STEM, MAX_STEM = 4, 7
LEAST_TEXTS, LEAST_WEIGHT = 3, 2.5
PRIOR_WORDS = 20
THRESHOLD = 0.3
#: The curve is fitted to one of FOLDS parts of the labelled texts, by a lexicon of the others; densities are counted in steps of 1 / STEPS.
FOLDS, STEPS = 3, 1000
#: Phrases (folded) in which an entry isn't meant badly; entries inside them don't count.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "sore loser syndrome", "dumb waiter", "dumb bell", "pond scum", "stupid simple", "kill switch", "not stupid", "no idiot")
#: Look-alikes of Latin letters in other scripts, and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
#: Signs that are punctuation at either end of a word.
MARKS = "!|+"
BLANK = 32


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 2^16: the folded letter (BLANK: no letter), and the letter that a sign stands for (0: none)."""
    letter = np.full(0x10000, BLANK, np.uint32)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            low = LOOK_ALIKES.get(low, low)
            letter[c] = ord(low[0])
    letter[0xFF21:0xFF3B] = letter[0xFF41:0xFF5B] = np.arange(97, 123)  # full-width forms
    sign = np.zeros(0x10000, np.uint32)
    for s, low in SIGNS.items():
        sign[ord(s)] = ord(low)
    return letter, sign


def _inside(real: np.ndarray, stands: np.ndarray, mark: np.ndarray, bang: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the signs that stand for letters in their word. real: letters; mark, bang: signs of MARKS, and !."""
    n = len(real)
    place = np.arange(n)
    member = real | stands
    first = member.copy()
    first[1:] &= ~member[:-1]
    borders = at[:-1][at[:-1] < n]
    first[borders] = member[borders]
    begin = np.maximum.accumulate(np.where(first | ~member, place, 0))
    last = np.ones(n, bool)
    last[:-1] = first[1:] | ~member[1:]
    end = np.minimum.accumulate(np.where(last, place, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(real, place, -1))
    after = np.minimum.accumulate(np.where(real, place, n)[::-1])[::-1]
    p = np.flatnonzero(stands)
    left, right = before[p] >= begin[p], after[p] <= end[p]
    marks = np.concatenate([[0], np.cumsum(mark)])
    ahead = marks[np.minimum(after[p], n)] - marks[p]
    behind = marks[p + 1] - marks[np.maximum(before[p], 0)]
    opens = (ahead == 0) | (bang[p] & first[p] & (ahead == 1))
    return p[np.where(left & right, True, np.where(right, opens, left & (behind == 0)))]


def fold(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The folded texts, each with one blank before and after."""
    points, at = code_points(data, offsets)
    letter, sign = _tables()
    near = np.minimum(points, 0xFFFF)
    plain = letter[near]
    plain[points > 0xFFFF] = BLANK
    real = plain != BLANK
    stands = (sign[near] > 0) & ~real
    if stands.any():
        inner = _inside(real, stands, np.isin(near, [ord(c) for c in MARKS]), near == ord("!"), at)
        plain[inner] = sign[near[inner]]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != BLANK) | (plain[:-1] != BLANK)
    firsts = at[:-1][at[:-1] < at[1:]]
    keep[firsts] = True
    left = np.concatenate([[0], np.cumsum(keep)])
    whole, edges = plain[keep].astype("<u4").tobytes().decode("utf-32-le", errors="replace"), left[at].tolist()
    return [f" {whole[a:b].strip()} " for a, b in zip(edges[:-1], edges[1:], strict=True)]


def terms(folded: str) -> set[str]:
    """Candidate entries of a text: ' word ' for whole words, ' stem' for beginnings."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(f" {word[:k]}" for k in range(MIN_STEM, min(MAX_STEM, len(word)) + 1))
    return found


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, text, toxic) of at most SAMPLE_ROWS labelled rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.select(F.col("doc_id").alias("key"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64(F.col("key").cast("string")), "key", "toxic").limit(SAMPLE_ROWS)
    return docs.select(F.col("doc_id").alias("key"), F.col("text")).join(F.broadcast(chosen), "key")


def lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries and weights from labelled texts (key, text, toxic)."""

    def run(batches):
        found: dict[str, list[int]] = {}
        texts = [0, 0]
        for batch in batches:
            for part in blocks(batch):
                for folded, toxic in zip(fold(*utf8(part.column(0))), part.column(1).to_pylist(), strict=True):
                    texts[toxic > 0] += 1
                    for term in terms(folded):
                        if term in found or toxic > 0:
                            found.setdefault(term, [0, 0])[toxic > 0] += 1
            yield from give(found, texts)
            found, texts = {}, [0, 0]

    def give(found, texts):
        rows = [*found.items(), ("", texts)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.int64())], names=["term", "clean", "toxic"])

    toxic_only = sample.where(F.col("toxic") > 0).select("text", "toxic")
    counted = toxic_only.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("toxic").alias("toxic"))
    candidates = {r.term: r.toxic for r in counted.where((F.col("toxic") >= LEAST_TEXTS)).orderBy(F.desc("toxic"), "term").limit(CANDIDATES).collect()}
    n_toxic = candidates.pop("", 0)
    if not candidates:
        return {}
    shared = sample.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def count_clean(batches):
        found: dict[str, int] = {}
        n = 0
        for batch in batches:
            for part in blocks(batch):
                for folded in fold(*utf8(part.column(0))):
                    n += 1
                    for term in terms(folded) & shared.value:
                        found[term] = found.get(term, 0) + 1
        rows = [*found.items(), ("", n)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([v for _, v in rows], pa.int64())], names=["term", "clean"])

    clean = sample.where(F.col("toxic") <= 0).select("text").mapInArrow(count_clean, "term string, clean long").groupBy("term").agg(F.sum("clean").alias("clean"))
    seen = {r.term: r.clean for r in clean.collect()}
    n_clean = seen.pop("", 0)
    weight = {t: float(np.log((k + 0.5) / (n_toxic + 1)) - np.log((seen.get(t, 0) + 0.5) / (n_clean + 1))) for t, k in candidates.items()}
    chosen: dict[str, float] = {}
    for term in sorted(weight, key=lambda t: (len(t), t)):
        if weight[term] < LEAST_WEIGHT or len(term) < MIN_STEM:
            continue
        starts = (term[:k] for k in range(MIN_STEM + 1, len(term)))
        if not any(s in chosen and chosen[s] >= weight[term] - 0.7 for s in starts):
            chosen[term] = weight[term]
    best = sorted(chosen, key=lambda t: (-chosen[t] * np.log1p(candidates[t]), t))[:MAX_ENTRIES]
    return {t: chosen[t] for t in sorted(best)}


@lru_cache(maxsize=2)
def _automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in entries:
        found.add_word(term, (len(term), weight))
    for phrase in exceptions:
        found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
    if len(found):
        found.make_automaton()
    return found


def match_weight(found, folded: str) -> tuple[float, int]:
    """Sum of the weights of the matches outside exceptions (the heaviest one of those that begin together), and their number."""
    if not len(found):
        return 0.0, 0
    best: dict[int, float] = {}
    shields: list[tuple[int, int]] = []
    for end, (size, weight) in found.iter(folded):
        begin = end - size + 1
        if weight:
            best[begin] = max(weight, best.get(begin, 0.0))
        else:
            shields.append((begin, end))
    if shields:
        best = {b: w for b, w in best.items() if not any(s <= b < e for s, e in shields)}
    return sum(best.values()), len(best)


def meant_well(sample: DataFrame, entries: dict[str, float]) -> tuple[str, ...]:
    """Two-word phrases round an entry that occur relatively more often in other texts than in toxic ones."""
    if not entries:
        return ()
    shared = sample.sparkSession.sparkContext.broadcast(tuple(sorted(entries.items())))

    def run(batches):
        found = _automaton(shared.value, ())
        for batch in batches:
            for part in blocks(batch):
                seen: dict[str, list[int]] = {"": [0, 0]}
                for text, toxic in zip(fold(*utf8(part.column(0))), part.column(1).to_pylist(), strict=True):
                    words, own = text.split(), set()
                    for k, word in enumerate(words):
                        if next(found.iter(f" {word} "), None):
                            own.update(" ".join(words[j : j + 2]) for j in (k - 1, k) if 0 <= j < len(words) - 1)
                    seen[""][toxic > 0] += 1
                    for phrase in own:
                        seen.setdefault(phrase, [0, 0])[toxic > 0] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["phrase", "clean", "toxic"])

    counted = sample.select("text", "toxic").mapInArrow(run, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counted.where("phrase = ''").select(F.col("clean").alias("n_clean"), F.col("toxic").alias("n_toxic"))
    share = lambda c: (F.col(c) + 0.5) / (F.col(f"n_{c}") + 1)
    good = counted.where(f"phrase <> '' AND clean >= {LEAST_TEXTS}").join(F.broadcast(total)).where(share("clean") > share("toxic"))
    return tuple(sorted(r.phrase for r in good.orderBy(F.desc("clean"), "phrase").limit(MAX_PHRASES).collect()))


def measure(docs: DataFrame, entries: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, id_col: str = "key", text_col: str = "text") -> DataFrame:
    """(key, words, matches, weight, density) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(entries.items())))

    def run(batches):
        found = _automaton(shared.value, exceptions)
        for batch in batches:
            for part in blocks(batch):
                texts = fold(*utf8(part.column(1)))
                size = np.array([t.count(" ") - 1 for t in texts], np.int64)
                rows = [match_weight(found, t) for t in texts]
                weight = np.array([w for w, _ in rows], float)
                density = np.log1p(100 * weight / (size + PRIOR_WORDS))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array([n for _, n in rows], pa.int64()), pa.array(weight), pa.array(density)], names=["key", "n_words", "n_matches", "weight", "density"])

    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(run, f"key {kind}, n_words long, n_matches long, weight double, density double")


def fit_curve(density: np.ndarray, toxic: np.ndarray, rows: np.ndarray | None = None) -> tuple[float, float]:
    """Slope (not negative) and intercept of the logistic curve, with a small ridge; Newton steps. rows: how many each value stands for.

    Without rows of both kinds the curve is flat, at the share of toxic rows (0 without rows).
    """
    rows = np.ones(len(toxic)) if rows is None else rows
    share = float(toxic @ rows / rows.sum()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return 0.0, 40.0 if share else -40.0
    x = np.stack([density, np.ones(len(density))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (rows * (toxic - p)) - 0.01 * beta
        step = np.linalg.solve((x * (rows * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def _unseen(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Densities of a FOLDS-th of the labelled texts by a lexicon that was learned from the others; toxic or not; and how many texts.

    What is collected is a row for each STEPS-th of a density and label.
    """
    part = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(FOLDS))
    others = sample.where(part != 0)
    entries = lexicon(others)
    own = measure(sample.where(part == 0), entries, tuple(sorted({*EXCEPTIONS, *meant_well(others, entries)})), id_col="toxic")
    counted = own.groupBy((F.round(F.col("density") * STEPS) / STEPS).alias("density"), (F.col("key") > 0).cast("double").alias("toxic")).agg(F.count("*").alias("rows")).toPandas()
    return counted.density.to_numpy(float), counted.toxic.to_numpy(float), counted.rows.to_numpy(float)


def score(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """(doc_id, score, predicted, ...) of all texts, learned from `labels` (doc_id, toxic) and their texts in `docs`."""
    sample = _sample(docs, labels)
    entries = lexicon(sample)
    exceptions = tuple(sorted({*exceptions, *meant_well(sample, entries)}))
    slope, base = fit_curve(*_unseen(sample))
    value = 1 / (1 + F.exp(-(F.lit(slope) * F.col("density") + F.lit(base))))
    return measure(docs.select(F.col("doc_id").alias("key"), "text"), entries, exceptions).select(
        F.col("key").alias("doc_id"), value.alias("score"), F.when(value >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_words", "n_matches", "weight"
    )
