"""Near-duplicate documents by ProbMinHash on weighted five-word shingles, banding and exact verification.

Signature: every shingle of a text is a Poisson process of arrivals whose rate is 1 + ln(its count); each arrival
takes one of BANDS * ROWS slots at random, and a slot keeps the shingle that arrives first. Arrivals are drawn in
rounds, and a shingle stops as soon as its next arrival comes after the text's slowest slot. Two texts agree in a slot
with the probability Jaccard similarity of these weights (for shingles that occur once each: the Jaccard
similarity of the sets).

Candidates are texts that agree in all ROWS slots of one of BANDS bands. At a similarity of 0.8 a pair is missed
with a probability below 4e-6. Every candidate link counts only after its similarity has been computed exactly.

Texts of equal words are one text from the start. Within a band's bucket the texts are compared with LEADERS chosen
members (stars, not all pairs): the one that shares buckets with most texts, which in a group of copies tends to be the
original, and one by hash. Connected texts share a class. In buckets that still hold several classes, the texts outside
the largest class are compared with all members of other classes, so no link between classes is lost. Here a pair
comes from the first band that both texts share, and counts only if it can be similar at all: two texts of x and y
shingles at similarity t have at least t / (1 + t) (x + y) in common, and how many they have is bounded by what each
has in common with the bucket's leader and with any other text (exact); and at least LEAST of their slots must agree in
the 8 bits that are kept of each, which two texts at 0.8 miss with a probability below 1e-7. This spares copies that were
changed too much the comparison with the whole group.

Words are [^\\x20\\x09-\\x0D]+ in lower-case ASCII. Defined cases: a text of one to four words has one shingle, all its
words; null texts and texts without words are never linked; a null id is an id like others; rows with
one id and different texts are different texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from ._spark import cut, extended, map_rows, quoted, unused
from ._text import LOWER_ASCII, blocks, mix, span_hashes, utf8, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
LEADERS = 2
SLOTS = BANDS * ROWS
#: Of the SLOTS, as many as agree at least in texts that are compared beyond their leaders.
LEAST = 100


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: document number, hash and count, ascending; and each text's fingerprint (0: no words)."""
    lowered = LOWER_ASCII[data]
    starts, ends, document = words(lowered, offsets)
    n = len(offsets) - 1
    word = span_hashes(lowered, starts, ends)
    size = np.bincount(document, minlength=n)
    begin = np.cumsum(size) - size
    place = np.arange(len(word)) - begin[document]
    value = word.copy()
    for k in range(1, SHINGLE):
        following = np.roll(word, -k)
        following[place + k >= size[document]] = 0
        value = mix(value + np.uint64(0x9E3779B97F4A7C15)) ^ following
    value = mix(value)
    valid = (place + SHINGLE <= size[document]) | (place == 0)
    ranked = mix(word + mix(place.astype(np.uint64) + np.uint64(1)))
    mark = np.zeros(n, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        mark[full] = mix(np.add.reduceat(ranked, begin[full]) + size[full].astype(np.uint64)) | np.uint64(1)
    document, value = document[valid], value[valid]
    order = np.lexsort((value, document))
    document, value = document[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(fresh)
    return document[first], value[first], np.diff(np.append(first, len(value))), mark


def weights(count: np.ndarray) -> np.ndarray:
    """A shingle's weight grows with the logarithm of its count, so that one line repeated a thousand times isn't the whole text."""
    return 1.0 + np.log(count)


def signatures(document: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """The shingle that arrives first in each slot, for each of n texts (0 in texts without shingles)."""
    earliest = np.full(n * slots, np.inf)
    winner = np.zeros(n * slots, np.uint64)
    time = np.zeros(len(value))
    rate = weights(count)
    turn = 0
    while len(value):
        turn += 1
        draw = mix(value + np.uint64(turn * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate
        slowest = earliest.reshape(n, slots).max(axis=1)
        live = time <= slowest[document]
        document, value, time, rate, draw = document[live], value[live], time[live], rate[live], draw[live]
        slot = document * slots + (mix(draw) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = time == earliest[slot]
        winner[slot[won]] = value[won]
    return winner.reshape(n, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, slots = signature.shape
    key = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(slots // bands):
        key = mix(key + np.uint64(0x9E3779B97F4A7C15)) ^ signature[:, k :: slots // bands]
    return mix(key)


def sketches(signature: np.ndarray) -> np.ndarray:
    """8 bits of every slot, 8 slots in a 64-bit number."""
    return np.ascontiguousarray((mix(signature) & np.uint64(255)).astype(np.uint8)).view(np.int64)


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two ascending arrays of the values that are in both."""
    if len(a) > len(b):
        j, i = common(b, a)
        return i, j
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    i = np.flatnonzero(b[at] == a)
    return i, at[i]


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, both: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Probability Jaccard similarity of two sorted shingle arrays with counts. both: common(a, b), if known."""
    i, j = both or common(a, b)
    if not len(i):
        return 0.0
    if len(x) == int(x.sum()) and len(y) == int(y.sum()):
        return len(i) / (len(a) + len(b) - len(i))
    x, y = weights(x), weights(y)
    u, v = x[i], y[j]
    only_x, only_y = x.sum() - u.sum(), y.sum() - v.sum()
    ratio = u / v
    order = np.argsort(ratio, kind="stable")
    sums_x = np.concatenate([[0], np.cumsum(u[order])])
    sums_y = np.concatenate([[0], np.cumsum(v[order])])
    split = np.searchsorted(ratio[order], ratio, side="right")
    whole = only_x + (sums_x[-1] - sums_x[split]) + ratio * (only_y + sums_y[split])
    return float((u / whole).sum())


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, fingerprint of the words (null: no words), band keys and sketch of each text."""
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                document, value, count, mark = shingles(*utf8(part.column(1)))
                n = part.num_rows
                signature = signatures(document, value, count, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mark.view(np.int64), mask=mark == 0), lists(band_keys(signature).view(np.int64)), lists(sketches(signature))], names=["key", "mark", "bands", "sketch"])

    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(run, f"key {kind}, mark long, bands array<long>, sketch array<long>")


def shingle_table(docs: DataFrame) -> DataFrame:
    """Fingerprint and shingles (hashes and counts as arrays of bytes) of each text of docs (key, text)."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                document, value, count, mark = shingles(*utf8(part.column(1)))
                cuts = np.searchsorted(document, np.arange(part.num_rows + 1)).tolist()
                rows = [d for d in range(part.num_rows) if mark[d]]
                hashes = [value[cuts[d] : cuts[d + 1]].tobytes() for d in rows]
                times = [b"" if (c := count[cuts[d] : cuts[d + 1]]).max() == 1 else c.astype(np.uint32).tobytes() for d in rows]
                yield pa.RecordBatch.from_arrays([pa.array(mark[rows].view(np.int64)), pa.array(hashes, pa.binary()), pa.array(times, pa.binary())], names=["mark", "hashes", "times"])

    return docs.mapInArrow(run, "mark long, hashes binary, times binary")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) with the number of their common shingles, and whether their exact similarity reaches the threshold."""

    def run(batches):
        for batch in batches:
            a, b, *fields = batch.columns
            left, right, left_times, right_times = (f.to_pylist() for f in fields)
            keep, shared = [], []
            for p, q, s, t in zip(left, right, left_times, right_times, strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = common(x, y)
                u = np.frombuffer(s, np.uint32) if s else np.ones(len(x), np.uint32)
                v = np.frombuffer(t, np.uint32) if t else np.ones(len(y), np.uint32)
                keep.append(similarity(x, u, y, v, both) >= threshold - 1e-12)
                shared.append(len(both[0]))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(shared, pa.int64()), pa.array(keep, pa.bool_())], names=["a", "b", "common", "similar"])

    right = sets.select(F.col("mark").alias("b"), F.col("hashes").alias("right"), F.col("times").alias("right_times"))
    left = sets.select(F.col("mark").alias("a"), F.col("hashes").alias("left"), F.col("times").alias("left_times"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right", "left_times", "right_times")
    return joined.mapInArrow(run, "a long, b long, common long, similar boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): the smallest node it is connected with.

    Each round points every node at the smallest label among its neighbours and then at that label's own label;
    labels only fall, and the rounds end when none has changed.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        roots = stepped.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = cut(stepped.join(roots, "label", "left").select("node", "was", F.least("label", F.coalesce("root", "label")).alias("label")))
        labels = jumped.select("node", "label")
        if not jumped.where(F.col("was") != F.col("label")).take(1):
            return labels


def _solve(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(key, mark) of every row; (mark, key, label) of every distinct text, with its smallest id and its class's label."""
    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    prints = cut(fingerprint_texts(docs, id_col, text_col))
    texts = prints.where(F.col("mark").isNotNull()).groupBy("mark").agg(F.min("key").alias("key"))
    banded = prints.where(F.col("mark").isNotNull()).groupBy("mark").agg(F.first("bands").alias("bands")).select("mark", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    found = banded.join(shared, "band")
    degrees = found.groupBy("mark").agg(F.sum("n").alias("degree"))
    members = cut(found.select("band", "mark").join(degrees, "mark"))
    chosen_ids = texts.join(members.select("mark").distinct(), "mark", "left_semi").select(F.col("key").alias("chosen")).distinct()
    matched = chosen.join(chosen_ids, F.col("key").eqNullSafe(F.col("chosen")), "left_semi")
    sets = cut(shingle_table(matched).dropDuplicates(["mark"]))
    measured = cut(verify(_ordered(_with_leaders(members, LEADERS), "mark", "leader"), sets, threshold))
    labels = components(measured.where("similar").select("a", "b"))
    open_ = cut(_unresolved(members, labels))
    if open_.take(1):
        links = cut(verify(_open_pairs(open_, members, prints, sets, measured, threshold), sets, threshold).where("similar").select("a", "b"))
        if links.take(1):
            labels = _joined_up(labels, links)
    named = texts.join(labels.withColumnRenamed("node", "mark"), "mark", "left")
    return prints.select("key", "mark"), named.select("mark", "key", F.coalesce("label", "mark").alias("label"))


def _joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after more links: only the labels that they join are solved anew."""
    of = labels.select(F.col("node"), F.col("label"))
    ends = links.join(of.select(F.col("node").alias("a"), F.col("label").alias("x")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("label").alias("y")), "b", "left")
    ends = cut(ends.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")))
    root = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("root"))
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("label")), F.struct(F.col("b").alias("node"), F.col("y").alias("label")))).alias("e")).select("e.*")
    every = of.unionByName(new.join(of.select("node"), "node", "left_anti").distinct())
    return cut(every.join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def _open_pairs(open_: DataFrame, members: DataFrame, prints: DataFrame, sets: DataFrame, measured: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) between different classes of the buckets in open_ that can be similar and haven't been measured."""
    marks = open_.select("mark").distinct()
    sized = cut(support(sets.join(marks, "mark", "left_semi")))
    tops = members.groupBy("band").agg(F.max(F.struct("degree", "mark")).getField("mark").alias("leader"))
    known = _with_common(open_.join(sized, "mark").join(tops, "band"), measured)
    signed = prints.join(marks, "mark", "left_semi").groupBy("mark").agg(F.first(F.struct("bands", "sketch")).alias("s")).select("mark", "s.*")
    known = cut(known.join(signed, "mark"))
    side = lambda rows, x: rows.select("band", *[F.col(c).alias(f"{x}_{c}") for c in ("mark", "label", "bands", "sketch", *SUPPORT)])
    mine, other = side(known.where(F.col("label") != F.col("top")), "x"), side(known, "y")
    first = F.get(F.filter(F.arrays_zip("x_bands", "y_bands"), lambda z: z["x_bands"] == z["y_bands"]), F.lit(0))["x_bands"]
    once = (F.col("y_label") == F.col("top")) | (F.col("x_mark") < F.col("y_mark"))
    mine = mine.join(open_.select("band", "top").distinct(), "band")
    passing = (mine.band == other.band) & (F.col("x_label") != F.col("y_label")) & once & _possible(threshold) & (_agreeing() >= LEAST) & (first == mine.band)
    pairs = mine.join(other, passing).select(F.least("x_mark", "y_mark").alias("a"), F.greatest("x_mark", "y_mark").alias("b"))
    return pairs.distinct().join(measured.select("a", "b"), ["a", "b"], "left_anti")


def _agreeing():
    """How many slots of x_sketch and y_sketch agree: bytes of the exclusive or that are 0."""
    differing = F.lit(0)
    for k in range(SLOTS // 8):
        t = F.get("x_sketch", F.lit(k)).bitwiseXOR(F.get("y_sketch", F.lit(k)))
        for step in (4, 2, 1):
            t = t.bitwiseOR(F.shiftrightunsigned(t, step))
        differing = differing + F.bit_count(t.bitwiseAND(F.lit(0x0101010101010101)))
    return SLOTS - differing


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size) of every row: class_id is the smallest id among the near-duplicates, class_size its rows."""
    prints, named = _solve(docs, id_col, text_col, threshold)
    counts = prints.where(F.col("mark").isNotNull()).groupBy("mark").count()
    sizes = named.join(counts, "mark").groupBy("label").agg(F.min("key").alias("class_id"), F.sum("count").alias("class_size"))
    by_mark = named.select("mark", "label").join(sizes, "label").select("mark", "class_id", "class_size")
    return prints.join(by_mark, "mark", "left").select(
        F.col("key").alias(id_col), F.when(F.col("mark").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.col("mark").alias("text_hash")
    )


SUPPORT = ("size", "shared", "common", "plain")


def _with_common(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """`rows` (mark, leader, size, ...) with the number of shingles that each text has in common with its bucket's leader."""
    pair = {"a": F.least("mark", "leader"), "b": F.greatest("mark", "leader")}
    found = rows.withColumns(pair).join(measured.select("a", "b", "common"), ["a", "b"], "left").drop("a", "b")
    return found.withColumn("common", F.when(F.col("mark") == F.col("leader"), F.col("size")).otherwise(F.coalesce("common", F.lit(0)))).drop("leader")


def support(sets: DataFrame) -> DataFrame:
    """(mark, size, shared, plain): how many shingles each text has, how many of them another text has too, and whether each occurs once."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                arrays = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                size = np.array([len(x) for x in arrays])
                mark = np.repeat(np.asarray(part.column(0)), size)
                plain = np.repeat([not t for t in part.column(2).to_pylist()], size)
                yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(np.concatenate(arrays)), pa.array(plain)], names=["mark", "shingle", "plain"])

    rows = sets.select("mark", "hashes", "times").mapInArrow(run, "mark long, shingle long, plain boolean")
    alone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("mark").alias("mark")).where(F.col("n") == 1).groupBy("mark").agg(F.count("*").alias("alone"))
    sizes = sets.select("mark", (F.length("hashes") / 8).cast("long").alias("size"), (F.length("times") == 0).alias("plain"))
    return sizes.join(alone, "mark", "left").select("mark", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"), "plain")


def _possible(threshold: float):
    """Whether two texts can reach the threshold at all. Exact for texts whose shingles occur once each; others always can.

    Both have some shingles in common with their bucket's leader, and some others that any other text has too; they
    have at most the smaller number of the first kind and the smaller number of the second kind in common.
    """
    need = threshold / (1 + threshold) * (F.col("x_size") + F.col("y_size")) - 1e-9
    most = F.least("x_common", "y_common") + F.least(F.col("x_shared") - F.col("x_common"), F.col("y_shared") - F.col("y_common"))
    return ~(F.col("x_plain") & F.col("y_plain")) | (most >= need)


def _with_leaders(members: DataFrame, n: int) -> DataFrame:
    """(mark, leader): each member with n leaders of its bucket: the member that meets most texts, then others by hash."""
    draw = [F.struct("degree", "mark") if k == 0 else F.struct(F.xxhash64("mark", F.lit(k)), F.col("mark")) for k in range(n)]
    leaders = members.groupBy("band").agg(*[F.max(d).getField("mark").alias(f"l{k}") for k, d in enumerate(draw)])
    return members.select("band", "mark").join(leaders, "band").select("mark", F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(n)]))).alias("leader")).distinct()


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs a < b."""
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, mark, degree, label, top) of the buckets that hold several classes; top is the largest one."""
    labelled = members.join(labels.withColumnRenamed("node", "mark"), "mark", "left").withColumn("label", F.coalesce("label", "mark"))
    per_class = labelled.groupBy("band", "label").count()
    largest = per_class.groupBy("band").agg(F.count("*").alias("classes"), F.max_by("label", F.struct("count", "label")).alias("top")).where(F.col("classes") > 1)
    return labelled.join(largest.select("band", "top"), "band")


def with_marks(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """`docs` with the fingerprint of each text's words in a last column (null: no words)."""
    names = docs.columns
    position = names.index(text_col)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, text_col):
                mark = shingles(*utf8(part.column(position)))[3]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mark.view(np.int64), mask=mark == 0)], names=[*names, out])

    return map_rows(docs, run, extended(docs.schema, StructField(out, LongType())))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stay when one document of each class does: the one with the smallest id (null ids last).

    Rows without words all stay.
    """
    mark = unused(docs.columns, "mark")
    _, named = _solve(docs, id_col, text_col, threshold)
    stay = named.groupBy("label").agg(F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("mark"))).getField("mark").alias(mark)).select(mark)
    marked = with_marks(docs, text_col, mark)
    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    one = marked.join(stay, mark, "left_semi").groupBy(mark).agg(F.min_by(whole, F.struct(F.col(quoted(id_col)).isNull(), F.col(quoted(id_col)))).alias("row"))
    return one.select("row.*").unionByName(marked.where(F.col(mark).isNull()).drop(mark))
