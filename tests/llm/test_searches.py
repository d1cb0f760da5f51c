"""Spelling variants, repair of conversations, and wavelet matrices against plain versions; odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType
from strataforge.llm import conversations, registry, tiff, variants, wavelet
from strataforge.llm.conversations import DUE, NEXT, ROLES, Repair, Row, search

DOCS = "doc_id long, text string, word string, n long, key string, gram long"


# spelling variants
def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    near, replaced = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            replaced[i, w[:i] + w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in replaced.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_variants_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    got = {tuple(r) for r in registry.op11_spelling_variants(spark, sf).collect()}
    assert got == want and any(x[1] for x in want)


@pytest.mark.parametrize("how", [{}, {"least": 1}, {"longest": 3}, {"size": 50}])
def test_variants_of_dense_words(spark, how):
    """Words over three letters, nearly all of them near to many others; accents, repeats of one letter, a very long word."""
    r = random.Random(5)
    words = Counter("".join(r.choice("ab\u00e9") for _ in range(r.randint(5, 8))) for _ in range(600)) + Counter({"a" * k: k for k in range(5, 12)}) + Counter({"xy" * 3000: 4, "xy" * 3000 + "z": 9})
    table = spark.createDataFrame(sorted(words.items()), "word string, n long")
    assert {tuple(x) for x in variants.group_variants(table, **how).collect()} == plain_variants(words)


def test_words_of_odd_tables(spark):
    rows = [(None, None), (1, ""), (2, "Hello HELLO hell\u00d7 " * 3), (2, "Hello"), (None, "Stra\u00dfe " * 4), (3, "\u0130stanbul na\u00efvet\u00e9 " * 5), (4, "abcdefghij" * 20_000)] + [(5, "abcdefghij" * 20_000)] * 2
    docs = spark.createDataFrame([(*x, "w", 1, "k", 2) for x in rows], DOCS)
    assert {r.word: r.n for r in variants.vocabulary(docs).collect()} == plain_words(rows)
    assert variants.group_variants(variants.vocabulary(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        variants.near_pairs(variants.vocabulary(docs), longest=6)


def test_checksums_of_runs():
    r = np.random.default_rng(1)
    data = r.integers(97, 123, 5000).astype(np.uint8)
    starts = np.sort(r.choice(4000, 300, replace=False))
    ends = starts + r.integers(1, 200, 300)
    heads = np.array([zlib.crc32(str(k).encode()) for k in range(300)], np.uint32)
    got = variants.run_checksums(data, starts, ends, heads)
    assert got.tolist() == [zlib.crc32(str(k).encode() + data[a:b].tobytes()) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]


# conversations
def cheapest(rows):
    """Forward over (rows done, state), all costs and initials."""

    def insert(found):
        for _ in range(6):
            for s, (c, a) in list(found.items()):
                found[DUE[s]] = min(found.get(DUE[s], (c + 3, a + "I")), (c + 3, a + "I"))
        return found

    now = insert({0: (0, "")})
    for row in rows:
        then = {}
        for s, (c, a) in now.items():
            ways = [(s, c + 4, "D")]
            if not row.gone:
                ways.append((DUE[s], c + 3 + 3 * row.cut_off, "R"))
                if row.role[:1] in NEXT[s]:
                    ways.append((NEXT[s][row.role[:1]], c + 3 * row.cut_off, "K"))
            for to, cost, letter in ways:
                then[to] = min(then.get(to, (cost, a + letter)), (cost, a + letter))
        now = insert(then)
    return min(now[s] for s in (0, 3) if s in now)


def random_rows(r, n):
    return [Row(r.choice(("user", "assistant", "system", "tool", "")), "x", r.random() < 0.2, r.random() < 0.25) for _ in range(n)]


def test_search_equals_a_plain_program():
    r = random.Random(1)
    for _ in range(2000):
        rows = random_rows(r, r.choice((0, 1, 2, 3, 5, 8, 13, 30)))
        assert search(rows, 0, True)[0] == cheapest(rows)


@pytest.mark.parametrize("roles", ["tool", "user", "system", "user assistant", "user user assistant system tool"])
def test_search_visits_few_nodes(roles):
    rows = [Row(roles.split()[k % len(roles.split())], "x", k % 11 == 3, k % 3 == 0) for k in range(64)]
    count = [0]
    assert search(rows, 0, True, count)[0] == cheapest(rows) and count[0] < 30_000


def test_blocks_equal_one_search():
    r = random.Random(2)
    for _ in range(200):
        small, whole = Repair(4), Repair(1000)
        for k in range(r.choice((0, 3, 7, 20, 60))):
            row = (k, r.choice(("user", "assistant", "system", "tool")), r.choice(("ab", "ab.", "")), r.random() < 0.1)
            small.add(*row)
            whole.add(*row)
        assert small.result() == whole.result()


def plain_repair(rows):
    """The contract's columns of each conversation of (conv, turn, role, text)."""
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = kept[conv]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in kept.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
        seen, faults, found = set(), Counter(), []
        for _, role, text in own:
            bare = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            found.append(Row(role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        turns = [x[0] for x in own if x[0] is not None]
        cost, audit = cheapest(found)
        state, lines, rest = 0, [], iter(found)
        for letter in audit:
            row = next(rest) if letter != "I" else None
            if letter == "D":
                continue
            state = NEXT[state][row.role[:1]] if letter == "K" else DUE[state]
            lines.append(f"{row.role if letter == 'K' else ROLES[state - 2]}:{row.text if row else ''}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repairs_equal_plain_ones(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in registry.op12_conversation_repair(spark, sf).collect()}
    assert got == plain_repair(rows)


def test_repairs_of_odd_tables(spark):
    r = random.Random(3)
    text = lambda: r.choice((None, "", " ", "Yes.", "No", "\u00e9t\u00e9!\n", "." * 3, "long " * 2000))
    rows = [(r.choice((None, 1, 2, 3)), r.choice((None, 0, 1, 5, 9)), r.choice((None, "user", "assistant", "system", "", "U")), text()) for _ in range(80)] + [(9, t, "user", "same.") for t in range(300)] + [(10, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(300)]
    table = spark.createDataFrame([(*x, "k", True, "r") for x in rows], "conv_id long, turn long, role string, text string, conv string, present boolean, repeat string")
    got = {x.conv: tuple(x)[1:] for x in conversations.repair(conversations.damage(table)).collect()}
    assert got == plain_repair(rows)
    assert conversations.repair(conversations.damage(table.limit(0))).count() == 0


# wavelet matrices
@pytest.mark.parametrize("n, most", [(0, 5), (1, 1), (10, 3), (65_536, 300), (150_000, 49_408), (131_072, 70_000)])
def test_matrix_answers(n, most):
    r = np.random.default_rng(n)
    ids = r.integers(0, most, n).astype(np.int32)
    shard = wavelet.Shard(wavelet.build(ids, pa.array([7]), np.array([n]), 5))
    assert shard.before == 5 and (shard.extract() == ids).all()
    at = r.integers(0, n, 300) if n else np.zeros(0, np.int64)
    assert (shard.access(at) == ids[at]).all()
    for token in (0, 1, most - 1, most + 5, 1 << 20):
        for a, b in ((0, n), (n // 3, n - n // 5)):
            places = a + np.flatnonzero(ids[a:b] == token)
            assert shard.count(token, a, b) == len(places) and (shard.find(token, a, b) == places).all()
    with pytest.raises(ValueError):
        wavelet.Shard(b"x" * 100)


def plain_ids(rows):
    from tokenizers import Tokenizer

    known, out, start = Tokenizer.from_file(registry.tokenizer("word_bpe_49k.json")), [], 0
    for key, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*known.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, ids))
        start += len(ids)
    return out


def test_shards_hold_the_ids(spark, tmp_path):
    rows = [(None, "no id"), (3, None), (3, "b a b"), (3, "a b"), (1, ""), (2, "word " * 3000), (2, "word " * 3000), (-7, "caf\u00e9 \u6f22 x"), (5, "b")]
    docs = spark.createDataFrame([(*x, "w", 1, "k", 2) for x in rows], DOCS)
    wavelet.write_shards(docs, f"{tmp_path}/t", registry.tokenizer("word_bpe_49k.json"), shard=100)
    shards, want = wavelet.read_shards(spark, f"{tmp_path}/t"), plain_ids(rows)
    assert shards.count() > 1
    digests = sorted(wavelet.document_digests(shards, LongType()).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in digests] == [(k, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, s, ids in want]
    assert [(r.key, r.start, r.ids) for r in sorted(wavelet.documents_ids(shards, LongType()).collect(), key=lambda r: r.start)] == want
    flat = [i for _, _, ids in want for i in ids]
    b = want[-1][2][0]
    assert {r.token: r.n for r in wavelet.token_counts(shards, [1, b, 49_000]).collect()} == {t: flat.count(t) for t in (1, b, 49_000)}
    places = wavelet.token_places(shards, b, LongType()).collect()
    assert sorted((r.position, r.key, r.offset) for r in places) == [(s + o, k, o) for k, s, ids in want for o, i in enumerate(ids) if i == b]
    wavelet.write_shards(docs.limit(0), f"{tmp_path}/e", registry.tokenizer("word_bpe_49k.json"))
    assert wavelet.document_digests(wavelet.read_shards(spark, f"{tmp_path}/e"), LongType()).count() == 0


def test_ids_of_a_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {tuple(r) for r in registry.op13_wavelet_shards(spark, sf).collect()}
    assert got == {(k, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, s, ids in plain_ids(rows)}


# pages
def test_wide_samples_give_error_rows():
    """24-bit samples with differences: an error row, not a lost job."""
    page = bytearray(tiff.write_page(b"x" * 192))
    page = page.replace(b"\x02\x01\x03\x00\x01\x00\x00\x00\x08\x00", b"\x02\x01\x03\x00\x01\x00\x00\x00\x18\x00")
    (found,) = tiff.read_pages(bytes(page))
    assert found["error"]


def test_digest_of_texts(spark):
    rows = [(k, t) for k, t in enumerate([None, "", "a", "b" * 192, "c" * 193, "\u00e9" * 5000])]
    got = {r.doc_id: r for r in tiff.text_media_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        raw = (text or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        media, r = tiff.write_page(padded), got[k]
        image = np.frombuffer(padded, np.uint8).reshape(-1, 192, 1)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), tiff.feature(image))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert {tuple(r[c] for c in want.columns) for r in got.collect()} == set(want.fetchall())
