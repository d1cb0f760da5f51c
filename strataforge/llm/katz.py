"""Katz backoff over words: Good-Turing discounted counts, exactly normalised backoff, one log10 score a text.

P(w | v) = d(r) r / c(v) where the pair (v, w) was seen r > 0 times, else alpha(v) P(w); P(w) = d(r) r / N for a known
word, and what the discounts leave for the one class of unknown words. alpha(v) is (1 - sum of the seen P(w | v)) /
(1 - sum of the seen words' P(w)), so that each context's probabilities add up to 1; it is 1 for a context without counts.
Discounts are Katz's for counts up to K; where the counts of counts don't allow them (a discount outside 0 to 1),
r - D over r with D = n1 / (n1 + 2 n2). A context whose seen pairs are all undiscounted keeps RESERVE counts back.

How it runs: each task turns its texts into word pairs, merges equal ones, and deals them out by the context's hash
into buckets, each row of the shuffle one bucket's share of one task (numpy arrays, compressed) rather than one pair.
A bucket holds the pair table of its contexts; it asks the buckets of the words for their counts, derives its part of
the model and evaluates the occurrences it holds, falling back from pair to word to unknown. The table partitions are
thus made, stored in the shuffle and used where they lie; `model_tables` writes the same partitions as Parquet.

Heavy contexts: a first pass finds every word with at least 1 / (HEAVY * buckets) of the tokens (each task reports the
words that reach half of that among its own). Their pairs are dealt out by word over as many buckets as their share
calls for, and the sums over a context that its probabilities need are added up across those buckets, as counts of counts.

Words are 62-bit hashes: among a hundred million different words two are alike with a probability of 0.1 %. Buckets are SPREAD times as
many as shuffle partitions, but each has LEAST_BYTES to BUCKET_BYTES of text: their questions to one another are up to the
square of their number. Defined cases: a null text is empty and has the end token only; a null id falls in
fold 0; repeated rows count each; without training rows every token is unknown with probability 1.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import parts
from ._text import LOWER_ASCII, blocks, crc_of_ids, mix, span_hashes, utf8, words

K = 5
RESERVE = 0.5
GROUP_BYTES = 12 << 20
WORD_BITS = 62
#: Bytes of text for each bucket, at most and at least.
BUCKET_BYTES, LEAST_BYTES = 32 << 20, 2 << 20
#: Buckets for each shuffle partition between these bounds: several small ones a partition even out what chance deals to one.
SPREAD = 2
START, END = np.uint64(1), np.uint64(2)
ADD = 0.1
HEAVY = 2

OCCURRENCES = "bucket int, part long, kind int, payload binary"
REQUESTS = "target int, source int, payload binary, stats array<long>, context long"
ANSWERS = "bucket int, part long, kind int, payload binary, stats array<long>, context long"
SUMS = "part long, kind int, payload binary, train_tokens long"
#: kind of a row of OCCURRENCES, ANSWERS and SUMS
PAIRS, HEADER, COUNTS, CONSTANTS, SPLIT = 0, 1, 2, 3, 4


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary value, each compressed; 64-bit words byte by byte, so that equal high bytes lie together."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        raw = x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() if x.dtype == np.uint64 else x.tobytes()
        packed = pa.compress(raw, codec="zstd", asbytes=True)
        out.append(x.dtype.str.encode().ljust(4) + len(raw).to_bytes(8, "little") + len(packed).to_bytes(8, "little") + packed)
    return b"".join(out)


def undump(value: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(value):
        kind = value[at : at + 4].decode().strip()
        size, packed = int.from_bytes(value[at + 4 : at + 12], "little"), int.from_bytes(value[at + 12 : at + 20], "little")
        raw = pa.decompress(value[at + 20 : at + 20 + packed], decompressed_size=size, codec="zstd", asbytes=True)
        if kind == "<u8":
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel())
        else:
            out.append(np.frombuffer(raw, np.dtype(kind)))
        at += 20 + packed
    return out


def small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


def bucket_of(word: np.ndarray, n: int) -> np.ndarray:
    return (mix(word) % np.uint64(n)).astype(np.int64)


class Heavy:
    """Contexts whose pairs are dealt out by word, and over how many buckets each."""

    def __init__(self, shares: dict[int, float], buckets: int):
        self.buckets = buckets
        self.context = np.array(sorted(shares), np.uint64)
        self.slices = np.array([min(buckets, 1 + int(HEAVY * buckets * shares[int(c)])) for c in self.context], np.int64)

    def place(self, context: np.ndarray) -> np.ndarray:
        """Positions of heavy contexts in the list; -1 for others."""
        if not len(self.context):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        return np.where(self.context[at] == context, at, -1)

    def bucket(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        home = bucket_of(context, self.buckets)
        at = self.place(context)
        found = np.flatnonzero(at >= 0)
        turn = mix(word[found] + np.uint64(7)) % self.slices[at[found]].astype(np.uint64)
        home[found] = (home[found] + turn.astype(np.int64)) % self.buckets
        return home

    def homes(self) -> list[tuple[int, int]]:
        """(context, bucket) of every slice."""
        return [(int(c), int((h + k) % self.buckets)) for c, h, n in zip(self.context, bucket_of(self.context, self.buckets), self.slices, strict=True) for k in range(n)]


def find_heavy(docs: DataFrame, buckets: int) -> Heavy:
    """Heavy contexts of docs (key, text). A word with a share f of all tokens has at least f / 2 where tasks report it, so the list has at most 2 HEAVY buckets entries."""
    least = 0.5 / (HEAVY * buckets)

    def run(batches):
        for batch in batches:
            held, n = [], 0
            for block in blocks(batch, limit=2 << 20):
                context = token_pairs(*utf8(block.column(1)))[0]
                word, count = np.unique(context, return_counts=True)
                n += len(context)
                held.append((word, count))
            if held:
                word, number = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
                count = np.bincount(number, np.concatenate([c for _, c in held])).astype(np.int64)
                many = count >= least * n
                yield pa.RecordBatch.from_arrays([pa.array(np.append(word[many].astype(np.int64), 0)), pa.array(np.append(count[many], n))], names=["context", "n"])

    rows = docs.mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    total = rows.where("context = 0").select(F.col("n").alias("total"))
    share = (F.col("n") / F.col("total")).alias("share")
    found = rows.where("context <> 0").join(F.broadcast(total)).select("context", share).where(F.col("share") >= least).collect()
    return Heavy({r.context: r.share for r in found}, buckets)


def token_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and document number of every token; each text ends with END."""
    lowered = LOWER_ASCII[data]
    starts, ends, document = words(lowered, offsets)
    n = len(offsets) - 1
    count = np.bincount(document, minlength=n)
    word = np.full(len(starts) + n, END)
    word[np.arange(len(starts)) + document] = span_hashes(lowered, starts, ends) >> np.uint64(64 - WORD_BITS) | np.uint64(4)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(count + 1) - (count + 1)] = START
    return context, word, np.repeat(np.arange(n), count + 1)


def _occurrences(batches, heavy: Heavy, modulus: int):
    """Each group of texts: its pairs by bucket, and one header row with its ids."""
    task, buckets = TaskContext.get(), heavy.buckets
    part = (task.partitionId() if task else 0) << 24
    held: list[tuple] = []
    ids: list = []
    size = 0

    def flush():
        nonlocal part, held, ids, size
        fold = crc_of_ids(ids) % modulus
        train = fold != 0
        place = np.empty(len(ids), np.int32)  # training texts first
        place[np.argsort(~train, kind="stable")] = np.arange(len(ids))
        context, word, document = (np.concatenate([h[k] for h in held]) for k in range(3))
        tokens = np.bincount(document, minlength=len(ids))
        held.clear()
        document = place[document]
        bucket = heavy.bucket(context, word).astype(np.int32)
        order = np.lexsort((document, word, context, bucket))
        context, word, document, bucket = context[order], word[order], document[order], bucket[order]
        fresh = np.ones(len(context), bool)
        fresh[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        pair = np.flatnonzero(fresh)
        head = np.ones(len(pair), bool)
        owner = bucket[pair]
        head[1:] = (context[pair][1:] != context[pair][:-1]) | (owner[1:] != owner[:-1])
        n_train = int(train.sum())
        cuts = np.searchsorted(owner, np.arange(buckets + 1))
        begin = np.append(pair, len(context))
        rows = []
        for b in np.unique(owner).tolist():
            lo, hi = int(cuts[b]), int(cuts[b + 1])
            heads = np.flatnonzero(head[lo:hi])
            own = context[pair[lo:hi]][heads]
            rows.append((b, part, PAIRS, dump(own, small(np.diff(np.append(heads, hi - lo))), word[pair[lo:hi]], small(np.diff(begin[lo : hi + 1])), small(document[begin[lo] : begin[hi]]), np.array([n_train], np.int64))))
        names = [None if i is None else str(i) for i in ids]
        header = dump(np.frombuffer(json.dumps(names).encode(), np.uint8), small(tokens), small(place), train.astype(np.uint8))
        rows.append((part % buckets, part, HEADER, header))
        for k in range(0, len(rows), 64):
            cols = list(zip(*rows[k : k + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["bucket", "part", "kind", "payload"])
        part, held, ids, size = part + 1, [], [], 0

    for batch in batches:
        for block in blocks(batch, limit=2 << 20):
            data, offsets = utf8(block.column(1))
            context, word, document = token_pairs(data, offsets)
            held.append((context, word, (document + len(ids)).astype(np.int32)))
            ids += block.column(0).to_pylist()
            size += len(data)
            if size >= GROUP_BYTES:
                yield from flush()
    if ids:
        yield from flush()


class Bucket:
    """The pair table of one bucket, merged from its rows."""

    def __init__(self, kinds: list[int], owners: list[int], payloads: list[bytes]):
        self.parts, self.sizes, self.documents, self.occurrences = [], [], [], []
        contexts, seconds, trained = [], [], []
        for kind, owner, payload in zip(kinds, owners, payloads, strict=True):
            if kind != PAIRS:
                continue
            heads, runs, word, times, document, (n_train,) = undump(payload)
            times = times.astype(np.int64)
            before = np.concatenate([[0], np.cumsum(document < n_train)])
            edges = np.concatenate([[0], np.cumsum(times)])
            contexts.append(np.repeat(heads, runs))
            seconds.append(word)
            trained.append(np.diff(before[edges]))
            self.parts.append(owner)
            self.sizes.append(len(word))
            self.documents.append(document)
            self.occurrences.append(times)
        empty = np.zeros(0, np.uint64)
        context, word = np.concatenate([empty, *contexts]), np.concatenate([empty, *seconds])
        order = np.lexsort((word, context))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
        group = np.cumsum(fresh) - 1
        self.pair = np.empty(len(order), np.int64)  # number of each row's pair in the table
        self.pair[order] = group
        first = order[fresh]
        self.context, self.word = context[first], word[first]
        self.count = np.bincount(self.pair, np.concatenate([np.zeros(0), *trained]), minlength=len(first)).astype(np.int64)
        self.words, self.word_number = np.unique(self.word, return_inverse=True)

    def by_target(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of `words` by the bucket that counts them, and the cuts between buckets."""
        target = bucket_of(self.words, buckets)
        order = np.argsort(target, kind="stable")
        return order, np.searchsorted(target[order], np.arange(buckets + 1))


def _counts_of_counts(count: np.ndarray) -> list[int]:
    return [int((count == r).sum()) for r in range(1, K + 2)]


def _rows(table: pa.Table, *names: str) -> list[list]:
    return [table.column(n).to_pylist() for n in names]


def _seen_kinds(count: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """For each group: the sum of its counts above K, and how many counts are 1, 2, ... K."""
    out = np.zeros((groups, K + 1), np.int64)
    out[:, 0] = np.bincount(group, np.where(count > K, count, 0), minlength=groups)
    for r in range(1, K + 1):
        out[:, r] = np.bincount(group, count == r, minlength=groups)
    return out


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"target": pa.int32(), "source": pa.int32(), "bucket": pa.int32(), "part": pa.int64(), "kind": pa.int32(), "payload": pa.binary(), "stats": pa.list_(pa.int64()), "context": pa.int64(), "train_tokens": pa.int64()}
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, kinds[n]) for c, n in zip(cols, names, strict=True)], names=names)


def _request(table: pa.Table, heavy: Heavy) -> pa.Table:
    """Asks for the counts of the bucket's words; with each question, which of these words were seen after a heavy context."""
    source, buckets = table.column("bucket")[0].as_py(), heavy.buckets
    own = Bucket(*_rows(table, "kind", "part", "payload"))
    total = np.bincount(own.word_number, own.count, minlength=len(own.words)).astype(np.int64)
    order, cuts = own.by_target(buckets)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = heavy.place(own.context)
    split = np.flatnonzero((at >= 0) & (own.count > 0))
    split = split[np.lexsort((rank[own.word_number[split]], at[split]))]
    place, which = rank[own.word_number[split]], at[split]
    target = np.searchsorted(cuts, place, side="right") - 1
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        mine = target == b
        after, times = np.unique(which[mine], return_counts=True)
        chosen = order[cuts[b] : cuts[b + 1]]
        rows.append((b, source, dump(own.words[chosen], small(total[chosen]), small(after), small(times), small(place[mine] - cuts[b])), None, None))
    rows.append((source, source, None, _counts_of_counts(own.count), None))
    kinds = _seen_kinds(own.count[split], which, len(heavy.context))
    rows += [(source, source, None, [*kinds[k].tolist(), *[0] * (K + 1)], int(heavy.context[k])) for k in np.unique(which).tolist()]
    return _table(rows, ["target", "source", "payload", "stats", "context"])


def _answer(table: pa.Table, heavy: Heavy) -> pa.Table:
    """Counts of the words that each bucket asked for, in its order; and this bucket's part of the statistics."""
    target = table.column("target")[0].as_py()
    sources, payloads, stats, contexts = _rows(table, "source", "payload", "stats", "context")
    pairs = np.sum([s for s, c in zip(stats, contexts, strict=True) if s is not None and c is None] or [[0] * (K + 1)], axis=0)
    asked = [(s, *undump(p)) for s, p in zip(sources, payloads, strict=True) if p is not None]
    keys = np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in asked)])
    distinct, number = np.unique(keys, return_inverse=True)
    count = np.bincount(number, np.concatenate([np.zeros(0), *(x[2] for x in asked)]), minlength=len(distinct)).astype(np.int64)
    below = np.zeros((len(heavy.context), K + 1), np.int64)
    rows, at = [], 0
    for source, word, _, after, times, place in asked:
        given = count[number[at : at + len(word)]]
        rows.append((source, target, COUNTS, dump(small(given)), None, None))
        below += _seen_kinds(given[place], np.repeat(after.astype(np.int64), times), len(heavy.context))
        at += len(word)
    rows.append((target, target, CONSTANTS, None, [int(count.sum()), int((count > 0).sum()), *_counts_of_counts(count), *(int(x) for x in pairs)], None))
    rows += [(target, target, SPLIT, None, s, c) for s, c in zip(stats, contexts, strict=True) if c is not None]
    rows += [(target, target, SPLIT, None, [*[0] * (K + 1), *below[k].tolist()], int(heavy.context[k])) for k in np.flatnonzero(below.any(axis=1)).tolist()]
    return _table(rows, ["bucket", "part", "kind", "payload", "stats", "context"])


def discounts(n: list[int]) -> np.ndarray:
    """Discount factor of counts 0 (unused) to K, from n[0] = how many were seen once, and so on up to K + 1 times."""
    n = [float(x) for x in n]
    factor = np.ones(K + 1)
    if n[0] <= 0:
        return factor
    shared = (K + 1) * n[K] / n[0]
    if shared < 1 and all(n[:K]):
        for r in range(1, K + 1):
            factor[r] = ((r + 1) * n[r] / (r * n[r - 1]) - shared) / (1 - shared)
    if shared >= 1 or not all(n[:K]) or (factor[1:] <= 0).any() or (factor[1:] > 1).any():
        off = n[0] / (n[0] + 2 * n[1]) * (0.5 if n[1] == 0 else 1.0)
        factor[1:] = [(r - off) / r for r in range(1, K + 1)]
    return factor


class Model:
    """Probabilities of one bucket's contexts."""

    def __init__(self, own: Bucket, counts: np.ndarray, constants: list[int], split: dict[int, list[int]] | None = None):
        """split: of each heavy context the counts of counts of its pairs and of the words seen after it."""
        self.total, self.kinds = constants[0], constants[1]
        d_word, d_pair = discounts(constants[2 : K + 3]), discounts(constants[K + 3 : 2 * K + 4])
        seen_once = np.array(constants[2 : K + 2], float)
        left = float((seen_once * np.arange(1, K + 1) * (1 - d_word[1:])).sum()) / max(1, self.total) if self.total else 1.0
        self.word_count = counts
        mass = counts * np.where(counts <= K, d_word[np.minimum(counts, K)], 1.0)
        self.unknown = left if left > 0 else RESERVE / (self.total + RESERVE)
        if self.total:
            word_p = mass / self.total if left > 0 else counts / (self.total + RESERVE)
        else:
            word_p = np.zeros(len(counts))
        self.word_p = np.where(counts > 0, word_p, self.unknown)
        head = np.ones(len(own.context), bool)
        head[1:] = own.context[1:] != own.context[:-1]
        self.head = np.cumsum(head) - 1
        groups = int(self.head[-1]) + 1 if len(head) else 0
        seen = own.count > 0
        discounted = own.count * np.where(own.count <= K, d_pair[np.minimum(own.count, K)], 1.0)
        self.context_count = np.bincount(self.head, own.count, minlength=groups)
        kept = np.bincount(self.head, discounted, minlength=groups)
        lower = self.word_p[own.word_number]
        below = np.bincount(self.head, np.where(seen, lower, 0.0), minlength=groups)
        if split:
            small_r = np.arange(1, K + 1)
            first = np.flatnonzero(head)
            for k in np.flatnonzero(np.isin(own.context[first], np.array(list(split), np.uint64))).tolist():
                pair, word = np.array(split[int(own.context[first[k]])], np.int64).reshape(2, K + 1)
                self.context_count[k] = pair[0] + (pair[1:] * small_r).sum()
                kept[k] = pair[0] + (pair[1:] * small_r * d_pair[1:]).sum()
                below[k] = self._sum(word, d_word, left)
        full = (self.context_count > 0) & (self.context_count - kept <= 1e-9 * self.context_count)
        scale = np.maximum(self.context_count + RESERVE * full, 1e-300)
        self.alpha = np.where(self.context_count > 0, (1 - kept / scale) / np.maximum(1 - below, 1e-12), 1.0)
        self.pair_p = np.where(seen, discounted / scale[self.head], self.alpha[self.head] * lower)


    def _sum(self, kinds: np.ndarray, d_word: np.ndarray, left: float) -> float:
        """The sum of P over words with such counts: kinds[0] the sum of those above K, kinds[r] how many are r."""
        r = np.arange(1, K + 1)
        if left > 0:
            return float(kinds[0] + (kinds[1:] * r * d_word[1:]).sum()) / max(1, self.total)
        return float(kinds[0] + (kinds[1:] * r).sum()) / (self.total + RESERVE)


def _counts_in_order(own: Bucket, buckets: int, kinds, owners, payloads) -> np.ndarray:
    counts = np.zeros(len(own.words), np.int64)
    order, cuts = own.by_target(buckets)
    for kind, target, payload in zip(kinds, owners, payloads, strict=True):
        if kind == COUNTS:
            counts[order[cuts[target] : cuts[target + 1]]] = undump(payload)[0]
    return counts


def _globals(right: pa.Table) -> tuple[list[list[int]], dict[int, list[int]]]:
    """The model's constants, and the sums of the heavy contexts that the bucket has a slice of."""
    found = list(zip(*_rows(right, "kind", "stats", "context"), strict=True))
    return [s for k, s, _ in found if k == CONSTANTS], {c: s for k, s, c in found if k == SPLIT}


def _evaluate(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    rows = []
    kinds, owners, payloads = _rows(left, "kind", "part", "payload")
    constants, split = _globals(right)
    total = constants[0][0] if constants else 0
    if left.num_rows:
        rows += [(p, HEADER, x, total) for k, p, x in zip(kinds, owners, payloads, strict=True) if k == HEADER]
        own = Bucket(kinds, owners, payloads)
        counts = _counts_in_order(own, buckets, *_rows(right, "kind", "part", "payload"))
        if len(own.pair):
            model = Model(own, counts, constants[0], split)
            score = np.log10(model.pair_p)
            word_count = counts[own.word_number]
            base = np.log10((word_count + ADD) / (model.total + ADD * (model.kinds + 1)))
            known = (word_count > 0).astype(np.float64)
            at = 0
            for owner, size, document, times in zip(own.parts, own.sizes, own.documents, own.occurrences, strict=True):
                number = own.pair[at : at + size]
                at += size
                texts, where = np.unique(document, return_inverse=True)
                add = [np.bincount(where, np.repeat(v[number], times), minlength=len(texts)) for v in (score, base, known)]
                rows.append((owner, PAIRS, dump(small(texts), add[0], add[1], small(add[2].astype(np.int64))), total))
    return _table(rows, ["part", "kind", "payload", "train_tokens"])


def _collect_sums(table: pa.Table) -> pa.Table:
    kinds, payloads, totals = _rows(table, "kind", "payload", "train_tokens")
    header = undump(payloads[kinds.index(HEADER)])
    ids, tokens, place, train = json.loads(header[0].tobytes()), header[1], header[2], header[3]
    score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for kind, payload in sorted(zip(kinds, payloads, strict=True)):
        if kind == PAIRS:
            texts, s, b, k = undump(payload)
            score[texts] += s
            base[texts] += b
            known[texts] += k
    return pa.table(
        [pa.array(ids, pa.string()), pa.array(train == 0), pa.array(tokens.astype(np.int64)), pa.array(known[place]), pa.array(np.full(len(ids), totals[0], np.int64)), pa.array(base[place]), pa.array(score[place])],
        names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def _bucketed(docs: DataFrame, modulus: int, id_col: str, text_col: str, buckets: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Occurrences by bucket, and the answers (with the model's constants) for each bucket."""
    if not buckets:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        buckets = max(1, min(SPREAD * parts(docs.sparkSession), -(-size // LEAST_BYTES)), -(-size // BUCKET_BYTES))
    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    heavy = find_heavy(chosen, buckets)
    occurrences = chosen.mapInArrow(lambda it: _occurrences(it, heavy, modulus), OCCURRENCES)
    requests = occurrences.groupBy("bucket").applyInArrow(lambda t: _request(t, heavy), REQUESTS)
    answers = requests.groupBy("target").applyInArrow(lambda t: _answer(t, heavy), ANSWERS)

    def sums(kind: int, n: int, *by: str) -> DataFrame:
        found = answers.where(F.col("kind") == kind).groupBy(*by).agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(n)])
        return found.select(*by, F.array(*[f"s{i}" for i in range(n)]).alias("stats"))

    def rows(df: DataFrame, kind: int, context) -> DataFrame:
        return df.select("bucket", F.lit(0).cast("long").alias("part"), F.lit(kind).alias("kind"), F.lit(None).cast("binary").alias("payload"), "stats", context.cast("long").alias("context"))

    constants = rows(sums(CONSTANTS, 2 + 2 * (K + 1)).select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "stats"), CONSTANTS, F.lit(None))
    everything = answers.where(F.col("kind") == COUNTS).unionByName(constants)
    if len(heavy.context):
        homes = docs.sparkSession.createDataFrame(heavy.homes(), "context long, bucket int")
        everything = everything.unionByName(rows(sums(SPLIT, 2 * (K + 1), "context").join(F.broadcast(homes), "context"), SPLIT, F.col("context")))
    return occurrences, everything, buckets


def score_texts(docs: DataFrame, modulus: int = 10, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Scores of all texts by the model of those whose crc32(id as text) modulo `modulus` isn't 0.

    buckets: parts of the model, by the size of the texts unless given.
    """
    occurrences, answers, buckets = _bucketed(docs, modulus, id_col, text_col, buckets)
    sums = occurrences.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(lambda a, b: _evaluate(a, b, buckets), SUMS)
    found = sums.groupBy("part").applyInArrow(_collect_sums, "key string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    kind = docs.schema[id_col].dataType.simpleString()
    return found.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", id_col)


def model_tables(docs: DataFrame, modulus: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pair table, by bucket: context, word, count, log10 of the pair's probability, log10 alpha of the context."""
    occurrences, answers, buckets = _bucketed(docs, modulus, id_col, text_col)

    def table(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, owners, payloads = _rows(left, "kind", "part", "payload")
        own = Bucket(kinds, owners, payloads)
        constants, split = _globals(right)
        model = Model(own, _counts_in_order(own, buckets, *_rows(right, "kind", "part", "payload")), constants[0], split)
        seen = np.flatnonzero(own.count > 0)
        bucket = left.column("bucket")[0].as_py() if left.num_rows else 0
        return pa.table(
            [pa.array(np.full(len(seen), bucket), pa.int32()), pa.array(own.context[seen].astype(np.int64)), pa.array(own.word[seen].astype(np.int64)), pa.array(own.count[seen]), pa.array(np.log10(model.pair_p[seen])), pa.array(np.log10(np.maximum(model.alpha[model.head[seen]], 1e-300)))],
            names=["bucket", "context", "word", "count", "log10_p", "log10_alpha"],
        )

    return occurrences.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(table, "bucket int, context long, word long, count long, log10_p double, log10_alpha double")
