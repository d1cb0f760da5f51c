"""Each operator against a plain Python version, on texts that include nulls, empty, long and repeated ones."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataforge.llm import katz, language, neardup, packing, pii, quality, tiff, toxicity, unigram
from strataforge.llm._text import utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in river stone walks under green light 42 naïve café über straße niño ну да ΩΩ x".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def texts():
    rows = [None, "", " ", "\n\n", "a", "A  b\tc\r\nd", "x" * 5000, "word " * 3000, prose(1, 40), prose(1, 40), prose(2, 400), "日本語 テキスト 😀 end", "tab\x0bfeed\x0c", "a\n" * 50, prose(3, 25)]
    return list(enumerate(rows)) + [(3, "same id"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", "de", None][k % 3], "s", 0) for k, (i, t) in enumerate(texts())], DOCS).withColumn("key", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def blank(spark):
    """Texts without a word only."""
    return spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "", None, None, None)], DOCS)


def test_tables_of_empty_texts(blank, spark):
    assert tiff.text_media_digest(blank).count() == 3
    assert [r.n_tokens for r in unigram.count_tokens(blank, piece_file()).collect()] == [0, 0, 0]
    assert [(r.n_tokens, r.score, r.round_trip) for r in unigram.encode_n_best(blank, piece_file()).collect()] == [(0, 0.0, True)] * 3
    assert [r.length for r in packing.pack(blank, word_file()).collect()] == [1, 1, 1]
    assert {r.lang_pred for r in language.identify(blank, {"en": b"\x01\x02"}).collect()} == {"und"} and language.learn(blank) == {}
    assert [r.kept for r in quality.verdicts(blank).collect()] == [False] * 3 and quality.keep_good(blank).count() == 0
    assert {r.doc_id: r.class_id for r in neardup.classes(blank).collect()} == {1: 1, 2: 2, None: None} and neardup.keep_one(blank).count() == 3
    assert [r.spans for r in pii.find(blank).collect()] == [""] * 3 and pii.redact(blank).count() == 3
    assert {r.n_tokens for r in katz.score_texts(blank).collect()} == {1}
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, None)], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score(blank, labels).collect()}) == 1


# TIFF
def test_texts_survive_tiff(docs):
    rows = tiff.text_media_digest(docs).collect()
    assert len(rows) == len(texts())
    left = collections.Counter()
    for _, text in texts():
        raw = (text or "").encode()
        left[hashlib.sha256(raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))).hexdigest()] += 1
    assert collections.Counter(r.payload_sha256 for r in rows) == left
    assert all(r.error is None and r.payload_bytes % 192 == 0 for r in rows)


def lzw(data: bytes) -> bytes:
    codes, table, width, out = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    now, size = b"", 258
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        codes.append((table[now], width))
        table[now + bytes([b])] = size
        size += 1
        width = 9 if size < 511 + 1 and size <= 511 else (size).bit_length() if size > 511 else 9
        if size == 4094:
            codes.append((256, 12))
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        now = bytes([b])
    codes += [(table[now], width), (257, width)] if now else [(257, width)]
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def pack_bits(data: bytes) -> bytes:
    out, i = b"", 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out, i = out + bytes([257 - run, data[i]]), i + run
        else:
            out, i = out + bytes([0, data[i]]), i + 1
    return out


def tiff_file(order: str, pages: list[tuple]) -> bytes:
    """pages: (image rows x columns, compression, predictor, tile side or 0)."""
    body = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for image, compression, predictor, tile in pages:
        height, width = image.shape
        blocks = []
        for y in range(0, height, tile or height):
            for x in range(0, width, tile or width):
                block = np.zeros((tile or height, tile or width), np.uint8)
                part = image[y : y + block.shape[0], x : x + block.shape[1]]
                block[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    block[:, 1:] -= block[:, :-1].copy()
                raw = block.tobytes()
                blocks.append({1: lambda b: b, 5: lzw, 8: zlib.compress, 32773: pack_bits}[compression](raw))
        places = []
        for b in blocks:
            places.append(len(body))
            body += b
        while len(body) % 2:
            body += b"\0"
        at_places = len(body)
        body += struct.pack(f"{order}{len(blocks)}I", *places)
        at_sizes = len(body)
        body += struct.pack(f"{order}{len(blocks)}I", *map(len, blocks))
        n = len(blocks)
        entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, compression), (277, 3, 1, 1), (317, 3, 1, predictor)]
        entries += [(322, 4, 1, tile), (323, 4, 1, tile), (324, 4, n, places[0] if n == 1 else at_places), (325, 4, n, len(blocks[0]) if n == 1 else at_sizes)] if tile else [(273, 4, n, places[0]), (278, 4, 1, height), (279, 4, n, len(blocks[0]))]
        struct.pack_into(f"{order}I", body, link, len(body))
        body += struct.pack(f"{order}H", len(entries))
        for tag, kind, count, value in sorted(entries):
            body += struct.pack(f"{order}HHI", tag, kind, count) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_of_all_compressions(spark, order):
    r = np.random.default_rng(5)
    images = [r.integers(0, 4, (37, 50), dtype=np.uint8), np.zeros((16, 16), np.uint8), r.integers(0, 256, (70, 33), dtype=np.uint8)]
    pages = [(im, c, p, t) for im in images for c in (1, 5, 8, 32773) for p in (1, 2) for t in (0, 16)]
    files = spark.createDataFrame([(1, tiff_file(order, pages)), (2, None), (3, b""), (4, b"II*\0junk"), (5, tiff_file(order, pages)[:200])], "id int, media binary")
    rows = tiff.tiff_pages(files).collect()
    mine = sorted((x for x in rows if x.id == 1), key=lambda x: x.page)
    assert [bytes(x.pixels) for x in mine] == [im.tobytes() for im, *_ in pages]
    assert {x.id for x in rows if x.error} == {4, 5} and not any(x.id in (2, 3) for x in rows)


def one_page(order: str, tags: dict[int, tuple[int, ...]], strips: list[bytes]) -> bytes:
    """A file of one page; tags: values of 32 bits."""
    body, places = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0)), []
    for strip in strips:
        places.append(len(body))
        body += strip
    entries = {**tags, 273: tuple(places), 279: tuple(map(len, strips))}
    at = {}
    for tag, values in entries.items():
        at[tag] = len(body)
        body += struct.pack(f"{order}{len(values)}I", *values)
    struct.pack_into(f"{order}I", body, 4, len(body))
    body += struct.pack(f"{order}H", len(entries))
    for tag, values in sorted(entries.items()):
        body += struct.pack(f"{order}HHII", tag, 4, len(values), values[0] if len(values) == 1 else at[tag])
    return bytes(body) + b"\0\0\0\0"


@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_of_other_samples(order):
    r = np.random.default_rng(7)
    page = lambda tags, strips: next(tiff.read_pages(one_page(order, tags, strips)))
    # floating point: bytes of each row from most to least significant, then differences
    real = r.normal(size=(5, 7)).astype(f"{order}f4")
    planes = real.astype(">f4").view(np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    delta = planes.copy()
    delta[:, 1:] -= planes[:, :-1]
    got = page({256: (7,), 257: (5,), 258: (32,), 259: (8,), 277: (1,), 278: (5,), 317: (3,)}, [zlib.compress(delta.tobytes())])
    assert got["pixels"] == real.tobytes() and got["error"] is None
    # three samples of 16 bits, chunky with differences and in planes
    colour = r.integers(0, 1 << 16, (4, 6, 3)).astype(f"{order}u2")
    steps = colour.astype(np.uint16)
    steps[:, 1:] -= colour[:, :-1].astype(np.uint16)
    tags = {256: (6,), 257: (4,), 258: (16, 16, 16), 259: (1,), 277: (3,), 278: (4,)}
    assert page({**tags, 317: (2,)}, [steps.astype(f"{order}u2").tobytes()])["pixels"] == colour.tobytes()
    assert page({**tags, 284: (2,)}, [colour[:, :, k].tobytes() for k in range(3)])["pixels"] == colour.tobytes()
    # samples of less than a byte, with PackBits
    for bits in (1, 2, 4):
        small = r.integers(0, 1 << bits, (9, 13), dtype=np.uint8)
        rows = ["".join(format(v, f"0{bits}b") for v in row) for row in small]
        raw = b"".join(int(row.ljust(-(-len(row) // 8) * 8, "0"), 2).to_bytes(-(-len(row) // 8), "big") for row in rows)
        tags = {256: (13,), 257: (9,), 258: (bits,), 259: (32773,), 278: (9,)}
        assert page(tags, [pack_bits(raw)])["pixels"] == small.tobytes()
        turned = bytes(int(format(b, "08b")[::-1], 2) for b in raw) if bits == 1 else None
        assert turned is None or page({**tags, 266: (2,)}, [pack_bits(turned)])["pixels"] == small.tobytes()


def test_damaged_pages_give_error_rows():
    grey = {258: (8,), 259: (1,), 278: (4,)}
    huge = one_page("<", {**grey, 256: (1 << 20,), 257: (1 << 20,)}, [b"abcd"])
    bomb = one_page("<", {**grey, 256: (1 << 14,), 257: (1 << 13,), 259: (8,), 278: (1 << 13,)}, [zlib.compress(b"\0" * 100)])
    short = one_page("<", {**grey, 256: (4,), 257: (4,)}, [b"0123456789"])
    strange = one_page("<", {**grey, 256: (4,), 257: (1,), 259: (7,)}, [b"0123"])
    for blob in (huge, bomb, short, strange):
        (row,) = tiff.read_pages(blob)
        assert row["error"] and row.get("pixels") is None
    deep = bytes(range(256)) * 40
    assert tiff._inflate(zlib.compress(b"\0" * 10**7), 8, 1000) == b"\0" * 1000 and tiff.unpack_lzw(lzw(deep), 500)[:500] == deep[:500]
    # a page that can't be decoded doesn't end the file
    good = np.arange(64, dtype=np.uint8).reshape(8, 8)
    blob = bytearray(tiff_file("<", [(good, 1, 1, 0), (good, 8, 1, 0), (good, 5, 2, 0)]))
    first = blob.index(struct.pack("<HHIHH", 259, 3, 1, 1, 0))
    blob[first + 8 : first + 10] = struct.pack("<H", 99)
    assert [(x["page"], x["error"] is None, x.get("pixels")) for x in tiff.read_pages(bytes(blob))] == [(0, False, None), (1, True, good.tobytes()), (2, True, good.tobytes())]


def test_pack_bits_runs():
    assert tiff.unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80])) == bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4)


# unigram pieces
def piece_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(piece_file(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_segments_equal_the_library(library):
    model = unigram.load(piece_file())
    words = sorted({w for w in prose(9, 300).split() if all(ord(c) < 0x250 for c in w)} | {"hest", "theashnt", "unbelievable", "aaaaaaa"})
    for word in words:
        own = unigram.n_best_segment(model, b" " + word.encode(), 4)
        theirs = library.nbest_encode_as_ids(word, 4)
        scores = [sum(library.get_score(i) for i in ids) for ids in theirs]
        if min(scores) > -1e8:
            assert [s for s, _ in own] == scores and own[0][1] == theirs[0]


def test_counts_and_n_best_agree_with_a_plain_search(docs, empty):
    model = unigram.load(piece_file())
    counted = unigram.count_tokens(docs, piece_file()).collect()
    ranked = unigram.encode_n_best(docs, piece_file()).collect()
    best = [r for r in ranked if r["rank"] == 0]
    assert sorted(r.n_tokens for r in counted) == sorted(r.n_tokens for r in best)
    assert all(r.round_trip for r in ranked)
    for _, text in texts():
        if text and len(text) < 60:
            whole = unigram.n_best_segment(model, b" " + text.encode(), 4)
            mine = sorted((r for r in ranked if r["rank"] == 0 and unigram.decode_bytes(model, np.array(r.ids)) == text.encode()), key=lambda r: str(r.doc_id))
            scores = sorted((r.score for r in ranked if r.doc_id == mine[0].doc_id and unigram.decode_bytes(model, np.array(r.ids)) == text.encode()), reverse=True)
            assert scores[: len(whole)] == pytest.approx([s for s, _ in whole])
    assert unigram.count_tokens(empty, piece_file()).count() == 0 and unigram.encode_n_best(empty, piece_file()).count() == 0


def test_round_trip_is_told_by_rank(spark):
    rows = [(1, "a\u2581b"), (2, "a b c"), (3, "Ünï 😀 x"), (4, "")]
    encoded = unigram.encode_n_best(spark.createDataFrame(rows, "doc_id long, text string"), piece_file())
    got = unigram.decode(encoded, piece_file()).collect()
    assert len(got) >= 12 and all(r.round_trip == (r.decoded == dict(rows)[r.doc_id]) for r in got)
    assert {r.round_trip for r in got if r.doc_id == 1} == {False} and all(r.round_trip for r in got if r.doc_id > 1)


def test_least_values_have_a_tie_rule():
    inf = np.inf
    for values, n, places in ([3, 1, 2, 1, 1], 2, [1, 3]), ([inf, 5, inf], 2, [1]), ([2, 2], 3, [0, 1]), ([], 2, []), ([1, 0, 1, 0, 1], 3, [0, 1, 3]), ([inf] * 4, 2, []):
        assert unigram.least(np.array(values, float), n).tolist() == places


def viterbi(model, text):
    """Count and score by a plain dynamic program over all pieces: between equal scores the earliest start."""
    raw = (" " + text.replace("\u2581", " ")).encode() if text else b""
    score = {model.surface[i]: model.score[i] for i in model.piece[model.piece >= 0].tolist()}
    longest = max(map(len, score))
    best = [(0.0, 0)] + [None] * len(raw)
    for end in range(1, len(raw) + 1):
        whole = raw[max(0, end - 4) : end].decode(errors="ignore")[-1:].encode() if end == len(raw) or raw[end] & 0xC0 != 0x80 else b""
        for start in range(max(0, end - longest), end):
            if best[start] is None:
                continue
            piece = raw[start:end]
            if piece in score:
                offer = (best[start][0] + score[piece], best[start][1] + 1)
            elif piece == whole:
                offer = (best[start][0] + model.unknown, best[start][1] + len(piece))
            else:
                continue
            if best[end] is None or offer[0] > best[end][0]:
                best[end] = offer
    return best[-1][1], best[-1][0]


def test_counts_equal_a_plain_viterbi_on_whole_texts(spark, sf, docs):
    model = unigram.load(piece_file())
    table = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").select("doc_id", "text").limit(60)
    for own in (table, docs.select("doc_id", F.left("text", F.lit(900)).alias("text")).where("doc_id IS NOT NULL AND doc_id <> 3")):
        given = {r.doc_id: r.text or "" for r in own.collect()}
        for r in unigram.count_tokens(own, piece_file()).collect():
            assert (r.n_tokens, pytest.approx(r.score, rel=1e-12)) == viterbi(model, given[r.doc_id]), r.doc_id


def test_counts_equal_the_librarys_lattice(spark, sf, library):
    """Whole texts against the first of the library's N-best; texts with unknown characters lose digits there."""
    table = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").select("doc_id", "text")
    given, compared = {r.doc_id: r.text for r in table.collect()}, 0
    for r in unigram.count_tokens(table, piece_file()).collect():
        if given[r.doc_id] and "\u2581" not in given[r.doc_id] and r.score > -1e8:
            ids = library.nbest_encode_as_ids(given[r.doc_id], 2)[0]
            compared += 1
            assert (len(ids), sum(library.get_score(i) for i in ids)) == (r.n_tokens, r.score), r.doc_id
    assert compared > 15


def test_decoding_gives_texts_back(docs):
    encoded = unigram.encode_n_best(docs.where("doc_id IS NOT NULL AND doc_id <> 3"), piece_file(), n=1)
    got = {r.doc_id: r.decoded for r in unigram.decode(encoded, piece_file()).collect()}
    assert got == {i: t or "" for i, t in texts() if i is not None and i != 3}


# packing
def word_file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_pieces_hold_the_tokenizers_ids(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_file())
    rows = packing.pack(docs, word_file(), with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by = collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) == 1 << r.bucket and r.offset == 0 and r.length <= 2048
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by[r.doc_id].append(r)
    for i, text in texts():
        if i is not None and i != 3:
            mine = sorted(by[i], key=lambda r: r.start)
            ids = [x for r in mine for x in r.ids]
            assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [1] and all(r.doc_tokens == len(ids) for r in mine)
            assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine[:-1]]).tolist()
    assert packing.pack(empty, word_file()).count() == 0


def test_word_ids_with_marks_and_bars():
    from tokenizers import Tokenizer

    odd = ["don't, stop!!", "a|b ||| c", "(x).", "...", "end.Start", "é,", "l'été's 's", "A.B,C;", "no break　wide", "x" * 300 + ".", "<|endoftext|> a", "Foo<|endoftext|>Bar <|ENDOFTEXT|>x", "<|startoftext|>. <|<|endoftext|>|>, A|<|endoftext|>'s"]
    known = packing.WordIds(word_file())
    ids, total = packing.text_ids(known, *utf8(pa.array(odd)))
    whole = [Tokenizer.from_file(word_file()).encode(t, add_special_tokens=False).ids + [1] for t in odd]
    assert total.tolist() == [len(w) for w in whole] and ids.tolist() == [i for w in whole for i in w]


# language
def test_parse_counts_the_longest_matches():
    sample = bytes(random.Random(4).choices(range(5), k=300))
    codes = bytes(random.Random(5).choices(range(5), k=700))
    count, i = 0, 0
    while i < len(codes):
        n = 1
        while i + n < len(codes) and codes[i : i + n + 1] in sample:
            n += 1
        i, count = i + n, count + 1
    got = language.phrase_counts(np.frombuffer(codes, np.uint8), np.array([0, 700]), [language.parse_table(sample)])
    assert got[0, 0] == count


def test_languages_are_told_apart(spark, sf, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = language.learn(docs.where(language.fold("doc_id", 5) != 0))
    rows = language.identify(docs, samples).join(docs.select("doc_id", "lang"), "doc_id").where(language.fold("doc_id", 5) == 0).collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    assert language.identify(empty, samples).count() == 0
    assert language.learn(empty) == {}


def test_samples_draw_on_all_rows(spark):
    long, short = "ab " * 30000, ["cde", "", None, "fgh ij"]
    rows = [(i, t, "x") for i, t in enumerate([long, *short])] + [(7, "q" * 40, "y")] * 300 + [(None, "zz", "y"), (9, "text", None)]
    samples = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    code = lambda t: language.symbols(*utf8(pa.array([t])))[0].tobytes()
    assert set(samples) == {"x", "y"} and language.SAMPLE_SYMBOLS - 4 < len(samples["x"]) <= language.SAMPLE_SYMBOLS and all(code(t) in samples["x"] for t in ("cde", "fgh ij", "ab ab"))
    assert len(samples["y"]) == language.SAMPLE_ROWS * 41 and set(samples["y"]) == {0, ord("q") - 96}


def test_more_languages_than_a_group(spark):
    own = {f"l{k:02}": " ".join("".join(random.Random(100 * k + j).choices("abcdefghijklmnop", k=5)) for j in range(40)) for k in range(2 * language.GROUP + 3)}
    table = spark.createDataFrame([(i, t, name) for i, (name, t) in enumerate(own.items())], "doc_id long, text string, lang string")
    rows = language.identify(table, language.learn(table)).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == len(own) and all(r.lang_pred == r.lang for r in rows)


def test_texts_without_letters_are_undetermined(docs):
    rows = {r.doc_id: r for r in language.identify(docs, {"en": language.symbols(*utf8(pa.array([prose(1, 300)])))[0].tobytes()}).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == "und" and rows[0].score == 0 and rows[4].lang_pred == "en"
    kept = language.keep_known(docs, {"en": b"\x01\x02\x03"})
    assert kept.columns == docs.columns and kept.where("text IS NULL OR trim(text) = ''").count() == 0


# quality
def test_base_counts_equal_plain_counts(docs):
    rows = [t or "" for _, t in texts()] + ["one two three four five six seven eight nine\n" * 3, "l1 a\nl1 a\n\n\n \nl1 a "]
    got = [c.tolist() for c in quality.base_counts(*utf8(pa.array(rows)))]
    for k, text in enumerate(rows):
        w = tokens(text)
        lines = [x for x in text.split("\n") if tokens(x)]
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {p for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        assert [g[k] for g in got] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)]


def test_probabilities_add_up_to_one():
    code, _ = quality.trigrams(*utf8(pa.array([prose(3, 500)])))
    model = quality.Model([np.bincount(code, minlength=64**3)])
    for context in np.unique(code // 64)[:40].tolist() + [77]:
        assert (2.0 ** model.log2(context * 64 + np.arange(64))).sum() == pytest.approx(1, abs=1e-4)


def test_perplexity_equals_a_plain_model():
    """Kneser-Ney probabilities by their definition on a few trigrams."""
    code, _ = quality.trigrams(*utf8(pa.array([prose(5, 200)])))
    grams = collections.Counter(code.tolist())
    model = quality.Model([np.bincount(code, minlength=64**3)])

    def parts(counts):
        n = [sum(1 for c in counts if c == r) for r in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        raw = [(r - (r + 1) * y * n[r] / n[r - 1]) if n[r - 1] else (0.5, 0.75, 1.0)[r - 1] for r in (1, 2, 3)]
        return [0, *(min(max(d, 0), r + 1) for r, d in enumerate(raw))]

    two = collections.Counter(g % 4096 for g in grams)
    one = collections.Counter(g % 64 for g in two)
    d3, d2, d1 = parts(grams.values()), parts(two.values()), parts(one.values())

    def chain(c, context, table, d, below):
        own = {g: n for g, n in table.items() if g // 64 == context}
        total = sum(own.values())
        if not total:
            return below
        return (max(own.get(context * 64 + c, 0) - d[min(3, own.get(context * 64 + c, 0))], 0) + sum(d[min(3, n)] for n in own.values()) * below) / total

    for g in list(grams)[:25]:
        total = sum(one.values())
        p1 = (max(one[g % 64] - d1[min(3, one[g % 64])], 0) + sum(d1[min(3, n)] for n in one.values()) / 64) / total
        p = chain(g % 64, g // 64, grams, d3, chain(g % 64, g // 64 % 64, two, d2, p1))
        assert model.log2(np.array([g]))[0] == pytest.approx(math.log2(p), rel=1e-4)


def test_verdicts_keep_clean_documents(spark, sf, docs, empty):
    read = spark.read.parquet
    found = quality.verdicts(read(f"{sf}/documents.parquet")).join(read(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in found}
    assert share[1] > 0.95 and share.get(0, 0) < share[1]
    rows = quality.verdicts(docs).collect()
    assert len(rows) == len(texts()) and not any(r.kept for r in rows if r.n_words < 20)
    assert quality.verdicts(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_all_languages_have_models(spark):
    """40 languages, more than are broadcast; and texts of one that occurs with null `lang` only."""

    def written(name, n):
        letters = random.Random(name).sample("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 9)
        r = random.Random(f"{name}{n}")
        words = ["".join(random.Random(f"{name}{k}").choice(letters) for _ in range(2 + k % 6)) for k in range(80)]
        return " ".join(r.choice(words) for _ in range(60 + r.randrange(9)))

    def check(names):
        rows = [(i, written(str(name), i), name) for i, name in enumerate([*names, *names[:1]] * 25)]
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = {r.doc_id: r for r in quality.verdicts(table).collect()}
        assert [got[i].model for i, _, _ in rows] == [name or "" for _, _, name in rows]
        kept = {i for i, r in got.items() if r.kept}
        assert len(kept) > 0.98 * len(rows) and kept == {r.doc_id for r in quality.keep_good(table).collect()}

    check([f"x{k}" for k in range(40)])
    check(["x0", "x1", None])


def test_other_scripts_have_models(spark):
    """Texts of scrambled letters lie outside the bands of a Cyrillic and of a Greek language."""
    rows, words = [], {"ru": "река камень медленно под зелёный свет старая мельница поле ячмень идёт находит".split(), "el": "ποτάμι πέτρα αργά κάτω πράσινο φως παλιός μύλος χωράφι κριθάρι βρίσκει".split()}
    for lang, own in words.items():
        r = random.Random(lang)
        rows += [(len(rows) + i, " ".join(r.choices(own, k=50 + r.randrange(30))), lang) for i in range(80)]
        rows += [(len(rows) + i, " ".join("".join(r.choices("".join(own), k=6)) for _ in range(60)), lang) for i in range(3)]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i, kept in got.items() if not kept and i % 83 < 80] == [] and not any(kept for i, kept in got.items() if i % 83 >= 80)


def test_scripts_beyond_the_first_plane_have_models(spark):
    """Scrambled letters lie outside the bands of a Gothic language (from U+10330 on), scrambled vowel signs outside those of a language in Devanagari."""
    rows, gothic = [], {c: chr(0x10330 + k) for k, c in enumerate("abgdeqzhþiklmnjup")}
    words = {"got": ["".join(gothic.get(c, c) for c in w) for w in "diupa munda handu meina bagme kaupa mandali gibande hilpam niman lagide dailja".split()], "hi": "नदी पत्थर धीरे हरी रोशनी पुराना चक्की मैदान जौ ढूँढता किनारे मिट्टी".split()}
    for lang, own in words.items():
        r = random.Random(lang)
        rows += [(len(rows) + i, " ".join(r.choices(own, k=50 + r.randrange(30))), lang) for i in range(80)]
        rows += [(len(rows) + i, " ".join("".join(r.choices("".join(own), k=6)) for _ in range(60)), lang) for i in range(3)]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i, kept in got.items() if not kept and i % 83 < 80] == [] and not any(kept for i, kept in got.items() if i % 83 >= 80)


def test_every_code_point_has_a_symbol_of_its_kind():
    table = quality.symbol_table()
    kinds = {"é": range(31, 58), "𐌰": range(31, 58), "𠀀": range(31, 58), "𞤀": range(31, 58), "\u0301": range(31, 58), "ि": range(31, 58), "٣": [53], "𝟘": [53], "½": [53], "\u3000": [58], "\u2028": [61], "…": [62], "😀": [62], "\U0010ffff": [62]}
    assert len(table) == 0x110000 and all(table[ord(c)] in wanted for c, wanted in kinds.items()) and table[ord("𞤀")] == table[ord("𞤢")]


def test_trigrams_of_several_texts():
    code, document = quality.trigrams(*utf8(pa.array(["ab", "", None, "c"])))
    at = lambda *s: (s[0] * 64 + s[1]) * 64 + s[2]
    assert code.tolist() == [at(0, 0, 1), at(0, 1, 2), at(1, 2, 63), at(0, 0, 3), at(0, 3, 63)] and document.tolist() == [0, 0, 0, 3, 3]


# near-duplicates
def test_classes_equal_brute_force(spark):
    r = random.Random(8)
    base = [[f"w{r.randrange(900)}" for _ in range(120)] for _ in range(25)]
    rows = []
    for words in base:
        for change in (0, 0, 1, 2, 6, 20):
            copy = list(words)
            for _ in range(change):
                copy[r.randrange(len(copy))] = f"n{r.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += ["", None, "a b", "a b", "A  b", "one two three four five six", "line " * 400, "line " * 500]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in neardup.classes(docs).collect()}
    sets = {}
    for i, text in enumerate(rows):
        w = [t.lower() for t in tokens(text)]
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def weight(n):
        return 1 + math.log(n)

    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b:
                same = 0.0
                for s in a.keys() & b.keys():
                    same += 1 / sum(max(weight(a[t]) / weight(a[s]) if t in a else 0, weight(b[t]) / weight(b[s]) if t in b else 0) for t in a.keys() | b.keys())
                if same >= 0.8:
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in sets}
    kept = neardup.keep_one(docs.withColumns({"mark": F.lit(1), "mark_": F.lit(2), "row": F.lit(3)}))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({root(i) for i in sets})
    assert kept.columns == ["doc_id", "text", "mark", "mark_", "row"] and {(x.mark, x.mark_, x.row) for x in kept.collect()} == {(1, 2, 3)}


def test_near_duplicates_of_odd_tables(docs, empty):
    rows = neardup.classes(docs).collect()
    assert len(rows) == len(texts())
    assert {r.class_id for r in rows if r.doc_id in (8, 9)} == {8}
    assert neardup.classes(empty).count() == 0 and neardup.keep_one(empty).count() == 0
    assert neardup.keep_one(docs).where("doc_id IS NULL").count() == 2


def test_signatures_estimate_the_similarity():
    a, b = np.arange(1, 401, dtype=np.uint64) * np.uint64(7919), np.arange(101, 501, dtype=np.uint64) * np.uint64(7919)
    document = np.repeat([0, 1], 400)
    s = neardup.signatures(document, np.concatenate([a, b]), np.ones(800, np.int64), 2, slots=4000)
    assert (s[0] == s[1]).mean() == pytest.approx(300 / 500, abs=0.04)


# personal data
def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            good = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]
            if good:
                out.append((m.start(), k, m.end()))
    return [f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(out)]


PRIVATE = [
    "a@b.c-d@e.f", "a@b.c_d@e.f x..y@z.q. 1.2.3.4.5.6.7.8 001.002.0003.255", "4111 1111-1111 1111 and 4111  1111 1111 1111", "+1 (017) 555-7713. +49 30 123456789012345", "x@@y.z é@b.co.uk, 41111111111111114",
    "1 " * 20000, "a@" + "b." * 9000 + "c", "9" * 30000, "a.b.c@d.e.f...", "+1-2-3-4-5-6-7-8-9-0-", "1.2.3.256 300.1.1.1.1 1.1.1.99999999999999999999", "call tel 555-123-4567", " 4111111111111111  a@b.c",
]


def test_base_spans_equal_the_patterns(spark, docs, empty):
    rows = spark.createDataFrame(list(enumerate([*PRIVATE, None, ""])), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(rows).collect()}
    for i, text in enumerate([*PRIVATE, None, ""]):
        spans = base_spans(text or "")
        assert found[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), text
        assert set(spans) <= set(found[i].spans.split(",")) | {""}
    assert pii.find(docs).count() == len(texts()) and pii.find(empty).count() == 0


def test_redaction(spark, docs):
    clash = ["found", "row", "base_", "every_", "plain_", "email_", "spans", "cut", "key", "kind"]
    rows = spark.createDataFrame([(1, "mail é.x@y.org now, +1 (017) 555-7713!", *clash), (2, None, *clash), (3, "nothing", *clash)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    got = {r.doc_id: r for r in pii.redact(rows).collect()}
    assert {i: r.text for i, r in got.items()} == {1: "mail é[EMAIL] now, [PHONE]!", 2: None, 3: "nothing"}
    assert pii.redact(rows).columns == rows.columns and all(r[c] == c for r in got.values() for c in clash)


CLEAR = {
    "email": ["write to jo.doe@mail.org today"], "ip": ["from 10.20.30.40 to"], "card": ["paid with 4111 1111 1111 1111 here"], "phone": ["ring +49 30 1234567 please"],
    "tel": ["phone: 555-123-4567 today", "reach me at (212) 555-0142 today"], "secret": ["token = ab12cd34ef56gh78ij90kl12 end"], "ssn": ["SSN: 123-45-6789 on file", "my social security number is 123-45-6789."],
    "iban": ["to DE89 3704 0044 0532 0130 00 by", "to DE89370400440532013000 by", "to ES91 2100 0418 4502 0005 1332 EUR by", "to GB82 WEST 1234 5698 7654 32 OK"],
}
OTHERWISE = ["part 123-45-6789 is", "SSN: 000-45-6789 is", "SSN: 123-00-6789 is", "SSN: 123-45-0000 is", "tel 123-45-6789 is", "row 155-123-4567 is", "to DE88 3704 0044 0532 0130 00 by", "nothing"]


def test_clear_cases_of_each_kind(spark):
    """Enough of each case, so that thresholds rest on more than single ones."""
    rows = [(kind, text) for kind, own in CLEAR.items() for text in own] + [("", text) for text in OTHERWISE]
    table = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows * 30)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(table).collect()}
    for i, (kind, text) in enumerate(rows):
        assert {s.split(":")[0] for s in got[i].split(",")} == {kind}, (text, got[i])
    found = got[[text for _, text in rows].index(CLEAR["iban"][2])]
    assert found == "iban:3:32"
    redacted = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert redacted[[text for _, text in rows].index(CLEAR["ssn"][0])] == "SSN: [SSN] on file"


def test_views_find_what_no_strict_check_names(spark):
    """Each view judges by what it can see: the words in front of a wrong card number, the form of a key without a name."""
    r = random.Random(5)
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    cards = ["4" + "".join(r.choices("0123456789", k=15)) for _ in range(12000)]
    right, wrong = [c for c in cards if luhn(c)][:900], [c for c in cards if not luhn(c)][:303]
    form = lambda: "aB1" + "".join(r.choices("abcDEF0123", k=25))
    keys = [form() for _ in range(903)]
    rows = [f"card number: {c} is" for c in right] + [f"item {c} is" for c in wrong[:300]] + [f"token = {k} is" for k in keys[:900]] + [f"lower-case-file_name_{i:06d} is" for i in range(300)]
    names = [f"card number: {c} is" for c in wrong[300:]], [f"we saw {k} is" for k in keys[900:]]
    table = spark.createDataFrame(list(enumerate([*rows, *names[0], *names[1]])), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.find(table).collect()}
    at = len(rows)
    assert [got[at + i].spans for i in range(3)] == ["card:13:29"] * 3 and [got[at + i].n_card for i in range(3)] == [0] * 3
    assert [got[at + 3 + i].spans for i in range(3)] == ["secret:7:35"] * 3 and {got[at + i].n_unchecked for i in range(6)} == {1}
    assert sum(x.n_unchecked for x in got.values()) == 6 and all(got[i].spans == "" for i in (*range(900, 1200), *range(2100, 2400)))


def test_native_plan(spark, sf):
    plan = pii.find(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Katz
@pytest.mark.parametrize("buckets", [None, 64])
def test_katz_equals_a_plain_model(docs, empty, buckets):
    rows = katz.score_texts(docs, 3, buckets=buckets).collect()
    assert len(rows) == len(texts())
    lower = lambda t: [w for w in tokens(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))] + [None]
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 3
    c, pairs, contexts = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in texts():
        if fold(i):
            w = lower(t)
            c.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
            contexts.update(["<s>", *w[:-1]])
    n, v = sum(c.values()), len(c)
    times = lambda counter: [sum(1 for x in counter.values() if x == r) for r in range(1, katz.K + 2)]
    dw, dp = katz.discounts(times(c)), katz.discounts(times(pairs))
    cut = lambda d, r: r * (d[r] if r <= katz.K else 1)
    left = 1 - sum(cut(dw, r) for r in c.values()) / n
    p1 = lambda w: cut(dw, c[w]) / n if c[w] else left
    kept, below = collections.Counter(), collections.Counter()
    for (a, w), r in pairs.items():
        kept[a] += cut(dp, r)
        below[a] += p1(w)

    def p2(a, w):
        if not contexts[a]:
            return p1(w)
        scale = contexts[a] + katz.RESERVE * (contexts[a] - kept[a] <= 1e-9 * contexts[a])
        return cut(dp, pairs[a, w]) / scale if pairs[a, w] else (1 - kept[a] / scale) / (1 - below[a]) * p1(w)

    for a in list(contexts)[:20]:
        assert sum(p2(a, w) for w in c) + p2(a, "unseen word") == pytest.approx(1)
    expected = sorted((sum(math.log10(p2(a, w)) for a, w in zip(["<s>", *lower(t)[:-1]], lower(t), strict=True)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lower(t)), len(lower(t)), sum(c[w] > 0 for w in lower(t))) for _, t in texts())
    got = sorted((r.score, r.base_score, r.n_tokens, r.n_known) for r in rows)
    assert np.allclose(np.array(expected), np.array(got)) and {r.train_tokens for r in rows} == {n}
    assert katz.score_texts(empty).count() == 0


def test_heavy_contexts_are_dealt_out():
    heavy = katz.Heavy({5: 0.4, 9: 0.02}, 50)
    context, word = np.repeat(np.array([5, 9, 11], np.uint64), 1000), np.arange(3000, dtype=np.uint64)
    bucket = heavy.bucket(context, word)
    assert [len(set(bucket[context == c].tolist())) for c in (5, 9, 11)] == [41, 3, 1]
    assert set(zip(context[:2000].tolist(), bucket[:2000].tolist(), strict=True)) <= set(heavy.homes())


def test_katz_tables_reuse_the_exchange(docs):
    table = katz.model_tables(docs, 3).toPandas()
    assert (table["count"] > 0).all() and (table.log10_p <= 0).all()
    df = katz.score_texts(docs, 3)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


# toxicity
def test_toxic_documents_are_found(spark, docs, empty):
    r = random.Random(2)
    mild = "stone river walks green light under water slowly again".split()
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(mild) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(["zorgling", "Z0rgling!", "vextule", "vextules"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.score(d, y.where("doc_id % 2 = 0")).collect()}
    assert got == dict(labels)
    scores = toxicity.score(docs, y).collect()
    assert len(scores) == len(texts()) and all(0 <= x.score <= 1 for x in scores)
    assert toxicity.score(empty, y).count() == 0
    assert all(x.predicted == 0 for x in toxicity.score(docs, y.where("false")).collect())


def test_folding_and_exceptions():
    folded = toxicity.fold(*utf8(pa.array(["Id10t, ІDIОT! 10 $5", None, "trash can trash"])))
    assert folded[0] == " idiot idiot " and folded[1] == "  "
    found = toxicity._automaton(((" idiot ", 2.0), (" trash ", 3.0)), toxicity.EXCEPTIONS)
    assert toxicity.match_weight(found, folded[0]) == (4.0, 2) and toxicity.match_weight(found, folded[2]) == (3.0, 1)


def test_folding_of_runs_and_borders():
    cases = {
        "l00ser 1diot a$$hole @$$ idi07 !d10t": "looser idiot asshole idiot idiot", "Z0rgling! idiot!!! idiot!1": "zorgling idiot idiot",
        "10 $5 3+4 100%idiot |idiot| b!+ch C++": "idiot idiot bitch c", "!!wow wow!!no": "wow wowiino", "1d": "id", "10": "", "x😀1diot": "x idiot",
    }
    assert toxicity.fold(*utf8(pa.array(list(cases)))) == [f" {v} " for v in cases.values()]
    assert toxicity.fold(*utf8(pa.array(["idiot", "1", "", "0x"]))) == [" idiot ", "  ", "  ", " ox "]


def test_phrases_that_are_meant_well(spark):
    """An entry is toxic, but not in a phrase that other texts have too."""
    clean = [(i, "stone river zorg lamp walks under light") for i in range(30)] + [(100 + i, "stone river walks under light") for i in range(60)]
    toxic = [(200 + i, f"stone river you {'zorg' if i % 2 else 'zorg blat'} walks under light") for i in range(60)]
    d = spark.createDataFrame([*clean, *toxic, (300, "a zorg lamp walks"), (301, "you zorg walks")], "doc_id long, text string")
    y = spark.createDataFrame([*[(i, 0) for i, _ in clean], *[(i, 1) for i, _ in toxic]], "doc_id long, toxic int")
    sample = d.join(y, "doc_id").select("text", "toxic")
    assert "zorg lamp" in toxicity.meant_well(sample, {" zorg ": 3.0}) and "you zorg" not in toxicity.meant_well(sample, {" zorg ": 3.0})
    assert toxicity.meant_well(sample, {}) == ()
    score = lambda **k: {r.doc_id: r.score for r in toxicity.score(d, y, **k).collect()}
    assert score()[300] < score()[301]


def test_flat_curves():
    none = np.zeros(0)
    for toxic, share in ((none, 0), (np.zeros(3), 0), (np.ones(3), 1)):
        slope, base = toxicity.fit_curve(np.ones(len(toxic)), toxic)
        assert slope == 0 and 1 / (1 + math.exp(-base)) == pytest.approx(share, abs=1e-9)


def test_disguised_words_are_found(spark):
    rows = [(i, " ".join(["stone river walks under light"] * 9) + (" idiot" if i % 4 == 0 else "")) for i in range(80)]
    rows += [(100 + k, f"stone river {w} walks") for k, w in enumerate(["1diot", "id1ot", "1d10t", "idi07", "!diot", "river"])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.score(d, y).collect()}
    assert [got[100 + k] for k in range(6)] == [1, 1, 1, 1, 1, 0]
