"""Unigram segmentation over a SentencePiece vocabulary: token counts, N-best encoding, decoding.

The vocabulary is the piece file of the public tokenizers; its scores are used as they stand and added as
64-bit floats. An Aho-Corasick automaton over the pieces' bytes enumerates every match while all distinct
segments of a block advance one byte at a time together (numpy arrays, one lane per segment).

Rules of the tokenizer that are kept: a blank is put before each text; blanks become U+2581; each character
without a piece of its own is an unknown one (lowest score - 10), spelled in byte pieces; between equal
scores the candidate with the earliest start (the longest last piece) wins. No piece goes on past a blank
that follows another character, and none holds a line feed, so texts fall into independent segments there.

The library adds 32-bit floats along a whole text, which loses digits once an unknown character has added
-10^9; here sums are exact, so results equal the library's wherever its own sums are.

Defined cases: a null text counts as empty; an empty text has no pieces, score 0 and one segmentation.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from ._spark import extended, map_rows, quoted
from ._text import blocks, expand, per_document, span_hashes, utf8

BLANK, FEED = 0x20, 0x0A
META = "▁".encode()
N_BEST = 4


class Pieces:
    """The vocabulary and its automaton. Node 0 is the root; `step` is the full transition table."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.surface = [p.piece.replace("▁", " ").encode() for p in model.pieces]
        self.score = np.array([p.score for p in model.pieces], np.float64)
        matched = [i for i, p in enumerate(model.pieces) if p.type in (1, 4, 5)]
        self.unknown = min(p.score for p in model.pieces if p.type == 1) - 10.0
        self.byte_piece = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_piece[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
        self.length = np.array([len(s) for s in self.surface], np.int64)
        self._automaton(matched)

    def _automaton(self, matched: list[int]) -> None:
        used = sorted({b for i in matched for b in self.surface[i]})
        self.symbol = np.zeros(256, np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        child: list[dict[int, int]] = [{}]
        piece, depth = [-1], [0]
        for i in matched:
            node = 0
            for b in self.surface[i]:
                below = child[node].get(b)
                if below is None:
                    below = child[node][b] = len(child)
                    child.append({})
                    piece.append(-1)
                    depth.append(depth[node] + 1)
                node = below
            piece[node] = i
        n = len(child)
        step = np.zeros((n, self.width), np.int32)
        suffix = np.zeros(n, np.int64)
        self.piece = np.array(piece, np.int64)
        output = np.zeros(n, np.int64)  # nearest proper suffix that is a piece
        queue = [0]
        for node in queue:
            if node:
                step[node] = step[suffix[node]]
            for b, below in child[node].items():
                suffix[below] = step[suffix[node], self.symbol[b]] if node else 0
                output[below] = suffix[below] if piece[suffix[below]] >= 0 else output[suffix[below]]
                step[node, self.symbol[b]] = below
                queue.append(below)
        self.step, self.output = step.ravel(), output
        self.first_match = np.where(self.piece >= 0, np.arange(n), output)
        self.single = {self.surface[i] for i in matched if len(self.surface[i].decode(errors="replace")) == 1}


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a blank before each and U+2581 as a blank; segment starts, ends, document numbers.

    An empty text gets no blank and has no segment.
    """
    raw = data.tobytes()
    if META in raw:
        texts = [raw[a:b].replace(META, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    sizes = np.diff(offsets)
    full = sizes > 0
    at = np.concatenate([[0], np.cumsum(sizes + full)])
    out = np.full(int(at[-1]), BLANK, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(full), sizes)] = data
    blank, feed = out == BLANK, out == FEED
    start = np.zeros(len(out), bool)
    start[1:] = (blank[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
    start[at[:-1][full]] = True
    starts = np.flatnonzero(start)
    return out, starts, np.append(starts[1:], len(out))[: len(starts)], np.searchsorted(at, starts, side="right") - 1


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of one occurrence of every distinct segment, and each segment's number among them."""
    _, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[first], ends[first], number


class Lattice:
    """Best scores into every node of each segment: node k of a segment lies before its byte k."""

    def __init__(self, model: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False):
        order = np.argsort(starts - ends, kind="stable")
        length = (ends - starts)[order]
        n = len(order)
        self.base = np.zeros(n, np.int64)
        np.cumsum((length + 1)[:-1], out=self.base[1:])
        total = int((length + 1).sum())
        self.best = np.full(total, -np.inf)
        self.best[self.base] = 0.0
        self.count = np.zeros(total, np.int32)
        self.from_piece = np.full(total, -1, np.int32)  # -2: an unknown character
        self.step_back = np.zeros(total, np.int32)
        self.rival = np.full(total, -np.inf) if second else None
        symbol, lead = model.symbol[data], (data & 0xC0) != 0x80
        begin = starts[order]
        state = np.zeros(n, np.int64)
        char_at = np.zeros(n, np.int64)
        alive = n
        for j in range(int(length[0]) if n else 0):
            alive = int(np.searchsorted(-length[:alive], -j, side="left"))
            place = begin[:alive] + j
            state[:alive] = model.step[state[:alive] * model.width + symbol[place]]
            is_lead = lead[place]
            char_at[:alive][is_lead] = j
            here = self.base[:alive] + j + 1
            node = model.first_match[state[:alive]]
            lane = np.flatnonzero(node)
            node = node[lane]
            whole = np.zeros(alive, bool)
            while len(lane):
                piece = model.piece[node]
                size = model.length[piece]
                whole[lane[size == j + 1 - char_at[lane]]] = True
                target = here[lane]
                self._offer(target, self.best[target - size] + model.score[piece], self.count[target - size] + 1, piece, size)
                node = model.output[node]
                keep = np.flatnonzero(node)
                lane, node = lane[keep], node[keep]
            after = np.minimum(place + 1, len(data) - 1)
            closes = ((j + 1 == length[:alive]) | lead[after]) & ~whole
            lane = np.flatnonzero(closes)
            if len(lane):
                size = j + 1 - char_at[lane]
                target = here[lane]
                self._offer(target, self.best[target - size] + model.unknown, self.count[target - size] + size, np.full(len(lane), -2), size)
        self.end = np.empty(n, np.int64)
        self.end[order] = self.base + length
        self.root = np.empty(n, np.int64)
        self.root[order] = self.base

    def _offer(self, target, score, count, piece, size) -> None:
        better = score > self.best[target]
        if self.rival is not None:
            self.rival[target] = np.maximum(self.rival[target], np.where(better, self.best[target], score))
        target, score, count, piece, size = (x[better] for x in (target, score, count, piece, size))
        self.best[target], self.count[target], self.from_piece[target], self.step_back[target] = score, count, piece, size


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The number of pieces of each text's best segmentation, and its score, without building the pieces."""

    def run(batches):
        model = load(path)
        for batch in batches:
            for part in blocks(batch):
                data, offsets = utf8(part.column(1))
                out, starts, ends, document = segments(data, offsets)
                a, b, number = distinct(out, starts, ends)
                lattice = Lattice(model, out, a, b)
                n = part.num_rows
                counts = per_document(lattice.count[lattice.end][number], document, n).astype(np.int64)
                scores = per_document(lattice.best[lattice.end][number], document, n)
                seen = per_document(np.ones(len(number)), document, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(seen), pa.array(counts), pa.array(scores)], names=["key", "n_bytes", "n_segments", "n_tokens", "score"])

    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(run, f"key {kind}, n_bytes long, n_segments long, n_tokens long, score double").withColumnRenamed("key", id_col)


def _edges(model: Pieces, text: bytes) -> list[list[tuple[int, int, float]]]:
    """For each node, the pieces that end there as (start, piece, score), the earliest start first."""
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(text) + 1)]
    state, char = 0, 0
    for j, b in enumerate(text):
        if b & 0xC0 != 0x80:
            char = j
        state = int(model.step[state * model.width + model.symbol[b]])
        node, whole = int(model.first_match[state]), False
        while node:
            piece = int(model.piece[node])
            size = int(model.length[piece])
            whole |= size == j + 1 - char
            into[j + 1].append((j + 1 - size, piece, float(model.score[piece])))
            node = int(model.output[node])
        if not whole and (j + 1 == len(text) or text[j + 1] & 0xC0 != 0x80):
            into[j + 1].append((char, -2, model.unknown))
    return into


def n_best_segment(model: Pieces, text: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of one segment, best first: A-star from the end towards the start.

    The forward Viterbi score of a node is exactly what the rest of a path can still gain, so paths leave
    the queue in the order of their total scores. Equal totals leave in the order of insertion.
    """
    into = _edges(model, text)
    gain = [0.0] + [-np.inf] * len(text)
    for node in range(1, len(text) + 1):
        gain[node] = max((gain[a] + s for a, _, s in into[node]), default=-np.inf)
    queue, born, found = [(-gain[-1], 0, len(text), 0.0, None)], 0, []
    while queue and len(found) < n:
        _, _, node, done, path = heapq.heappop(queue)
        if node == 0:
            ids = []
            while path:
                (start, piece, end), path = path
                ids += [piece] if piece >= 0 else [int(model.byte_piece[x]) for x in text[start:end]]
            found.append((done, ids))
            continue
        for start, piece, s in into[node]:
            if gain[start] > -np.inf:
                born += 1
                heapq.heappush(queue, (-(done + s + gain[start]), born, start, done + s, ((start, piece, node), path)))
    return found


def _best_paths(model: Pieces, data: np.ndarray, starts: np.ndarray, lattice: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of every segment's best path in a row, their counts, and the loss of the second-best path."""
    at, n = lattice.end.copy(), len(lattice.end)
    size = lattice.count[lattice.end].astype(np.int64)
    tail = np.cumsum(size)
    ids = np.zeros(int(tail[-1]) if n else 0, np.int32)
    loss = np.full(n, np.inf)
    live = np.flatnonzero(at > lattice.root)
    while len(live):
        node = at[live]
        loss[live] = np.minimum(loss[live], lattice.best[node] - lattice.rival[node])
        piece, back = lattice.from_piece[node], lattice.step_back[node].astype(np.int64)
        known = piece >= 0
        tail[live[known]] -= 1
        ids[tail[live[known]]] = piece[known]
        strange = live[~known]
        if len(strange):
            wide = back[~known]
            tail[strange] -= wide
            first = starts[strange] + (node[~known] - lattice.root[strange]) - wide
            ids[expand(tail[strange], wide)] = model.byte_piece[data[expand(first, wide)]]
        at[live] -= back
        live = live[at[live] > lattice.root[live]]
    return ids, size, loss


def decode_bytes(model: Pieces, ids: np.ndarray) -> bytes:
    """The text of one sequence of ids, as UTF-8; the blank that was put before it is taken off."""
    joined = b"".join([model.surface[i] for i in ids.tolist()])
    return joined[1:] if joined[:1] == b" " else joined


def least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least finite values, ascending; of equal values the first ones."""
    if len(values) <= n:
        return np.flatnonzero(np.isfinite(values))
    limit = np.partition(values, n - 1)[n - 1]
    below = np.flatnonzero(values < limit)
    equal = np.flatnonzero(values == limit)[: n - len(below)] if np.isfinite(limit) else below[:0]
    return np.sort(np.concatenate([below, equal]))


def encode_n_best(docs: DataFrame, path: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """The n best segmentations of each text, one row per rank: score, n_tokens, ids_crc32 and ids.

    Segments are independent, so a text's n best paths differ from its best one only in the n - 1 segments
    whose second-best path loses least (of equal losses the first); A-star runs on those, and their combinations are
    ranked, of equal totals those first that were found first, from the text's start on. Fewer rows come out if a text
    has fewer segmentations. `round_trip` says whether this rank's ids decode to the text as it was given.
    """

    def run(batches):
        model = load(path)
        for batch in batches:
            for part in blocks(batch):
                yield from encode_block(model, part)

    def encode_block(model: Pieces, part: pa.RecordBatch):
        data, offsets = utf8(part.column(1))
        out, starts, ends, document = segments(data, offsets)
        a, b, number = distinct(out, starts, ends)
        lattice = Lattice(model, out, a, b, second=True)
        ids, size, loss = _best_paths(model, out, a, lattice)
        first = np.cumsum(size) - size
        flat = ids[expand(first[number], size[number])]
        begin = np.concatenate([[0], np.cumsum(size[number])])
        score = lattice.best[lattice.end][number]
        docs_in = part.num_rows
        total = per_document(score, document, docs_in)
        segment_from = np.searchsorted(document, np.arange(docs_in + 1))
        losses = loss[number]
        known: dict[int, list] = {}
        raw, given = out.tobytes(), data.tobytes()
        rows: list[tuple] = []
        for d in range(docs_in):
            lo, hi = int(segment_from[d]), int(segment_from[d + 1])
            best = flat[begin[lo] : begin[hi]]
            same = decode_bytes(model, best) == given[offsets[d] : offsets[d + 1]]
            own = losses[lo:hi]
            if n > 1 and hi > lo:
                pick = least(own, n - 1) + lo
            else:
                pick = np.zeros(0, np.int64)
            ranked = [(float(total[d]), ())]
            for s in pick.tolist():
                k = int(number[s])
                if k not in known:
                    known[k] = n_best_segment(model, raw[a[k] : b[k]], n)
                options = known[k]
                ranked = sorted(((t - options[0][0] + o[0], (*c, (s, r))) for t, c in ranked for r, o in enumerate(options)), key=lambda x: -x[0])[:n]
            for rank, (value, choice) in enumerate(ranked):
                pieces, at, back = [], int(begin[lo]), same
                for s, r in choice:
                    if r:
                        pieces += [flat[at : begin[s]], np.array(known[int(number[s])][r][1], np.int32)]
                        at = int(begin[s + 1])
                        back &= b"".join([model.surface[i] for i in known[int(number[s])][r][1]]) == raw[starts[s] : ends[s]]
                pieces.append(flat[at : begin[hi]])
                whole = np.concatenate(pieces) if len(pieces) > 1 else pieces[0]
                rows.append((d, rank, value, len(whole), zlib.crc32(whole.astype("<u4").tobytes()), whole if with_ids else None, bool(back)))
        cols = list(zip(*rows, strict=True))
        taken = part.column(0).take(pa.array(cols[0], pa.int64()))
        arrays = [taken, pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[6], pa.bool_())]
        names = ["key", "rank", "score", "n_tokens", "ids_crc32", "round_trip"]
        if with_ids:
            arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    chosen = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    schema = f"key {kind}, rank int, score double, n_tokens long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return chosen.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The text of each row's ids in a new last column (null ids: null text)."""
    carried = [c for c in encoded.columns if c != text_col]
    position = carried.index(ids_col)

    def run(batches):
        model = load(path)
        for batch in batches:
            lists = batch.column(position).to_pylist()
            texts = [None if x is None else decode_bytes(model, np.array(x, np.int64)).decode(errors="replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*carried, text_col])

    kept = encoded.select(*[F.col(quoted(c)) for c in carried])
    return map_rows(kept, run, extended(kept.schema, StructField(text_col, StringType())))
