"""Operators 1, 3 and 9 against the libraries."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from orthoquilt.llm import bpe, packing, token_counts
from orthoquilt.llm.common import tokenizer_file

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_file(BYTES))
    t.no_truncation()
    t.no_padding()
    return t


def texts_of(spark, sf):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_ids_equal_the_library(library, tricky):
    got = bpe.Encoder(bpe.Vocabulary(tokenizer_file(BYTES)))([t or "" for t in tricky])
    for text, raw in zip(tricky, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_native_ids_equal_the_library(library, tricky):
    code = packing.native_encoder(tokenizer_file(BYTES))
    blanks = [" " * 30_000, "x" + "\n \t" * 10_000 + "y", ("a" + " " * 1999) * 20, " " * 5000 + "<|endoftext|>" + "\u3000" * 5000 + "z"]
    for text in [*tricky, *blanks]:
        assert np.frombuffer(code(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, (text or "")[:50]


def test_texts_beyond_a_block(library):
    """Several texts of over a million characters: block borders, long runs without blanks, and nothing of these is remembered."""
    r = np.random.default_rng(1)
    words = " ".join("".join(map(chr, r.integers(97, 123, n))) for n in r.integers(1, 9, 200_000))
    texts = [words, "y" * 1_200_000, "".join(map(chr, r.integers(0x4E00, 0x9FFF, 50_000))), "short"]
    code = bpe.Encoder(bpe.Vocabulary(tokenizer_file(BYTES)))
    got = [x for block in bpe.in_blocks(texts) for x in code(block)]
    native = packing.native_encoder(tokenizer_file(BYTES))
    for text, raw in zip(texts, got, strict=True):
        assert raw == native(text)
    assert max(map(len, [*code.young, *code.pieces_young])) <= bpe.LONG
    assert np.frombuffer(got[0], "<u4").tolist() == library.encode(words, add_special_tokens=False).ids
    count = token_counts.Counter(tokenizer_file(WORDS))
    t = Tokenizer.from_file(tokenizer_file(WORDS))
    assert [n for block in bpe.in_blocks(texts[:1] + texts[3:]) for n in count(block)] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts[:1] + texts[3:]]
    count(["z" * 50_000])
    assert max(map(len, [*count.young, *count.pieces])) <= bpe.LONG


def test_long_piece_equals_short_pieces():
    vocab = bpe.Vocabulary(tokenizer_file(BYTES))
    for piece in (b"internationalization", b"aaaaaaaaab", b"xyzzy" * 9):
        assert bpe.merge_long(vocab, piece) == bpe.merge_rows(vocab, [piece], 64)[0]


def test_round_trip_query(spark, sf, library):
    found = {r["doc_id"]: r for r in bpe.op1_bpe_encode_decode(spark, sf).collect()}
    for doc, text in texts_of(spark, sf).items():
        ids = library.encode(text, add_special_tokens=False).ids
        r = found[doc]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_columns(documents, no_documents):
    path = tokenizer_file(BYTES)
    back = bpe.decode(bpe.encode(documents, path), path)
    assert back.count() == documents.count()
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())
    assert bpe.encode(no_documents, path).count() == 0
    assert bpe.round_trip_digests(no_documents, path).count() == 0


def test_counts_equal_the_library(spark, sf, documents, no_documents, tricky):
    path = tokenizer_file(WORDS)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    counter = token_counts.counter(path)
    for text in tricky:
        assert counter([text or ""])[0] == count(text), text
    found = {r["doc_id"]: r for r in token_counts.op9_token_counts(spark, sf).collect()}
    for doc, text in texts_of(spark, sf).items():
        assert (found[doc]["n_tokens"], found[doc]["n_bytes"]) == (count(text), len(text.encode()))
        assert found[doc]["over_limit"] == (found[doc]["n_tokens"] > 2048)
    assert token_counts.token_counts(documents, path).count() == documents.count()
    assert token_counts.token_counts(no_documents, path).count() == 0


def check_packing(pieces, ids_of):
    """Every id lies in one piece, and sequences are gapless and within the capacity."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= packing.CAPACITY
    assert sorted(by_seq) == list(range(len(by_seq)))
    for (doc, n), own in by_doc.items():
        ids = ids_of[doc, n]
        whole = sorted(own, key=lambda p: p["start"])
        copies = sum(p["length"] for p in own) // n
        assert sum(p["length"] for p in own) == copies * n
        for p in whole:
            assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
        if copies == 1:
            at = 0
            for p in whole:
                assert p["start"] == at
                at += p["length"]
    return len(by_seq)


def test_packing(spark, sf, library, documents, no_documents):
    def raw(text):
        return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()

    texts = texts_of(spark, sf)
    ids_of = {(d, len(raw(t)) // 4): raw(t) for d, t in texts.items()}
    pieces = packing.op3_packing(spark, sf).collect()
    assert {p["doc_id"] for p in pieces} == set(texts)
    sequences = check_packing(pieces, ids_of)
    tokens = sum(n for _, n in ids_of)
    assert sequences <= -(-tokens // packing.CAPACITY) * 1.02 + 1
    rows = documents.collect()
    found = packing.packed(documents, tokenizer_file(BYTES)).collect()
    check_packing(found, {(r["doc_id"], len(raw(r["text"])) // 4): raw(r["text"]) for r in rows})
    assert sum(p["length"] for p in found) == sum(len(raw(r["text"])) // 4 for r in rows)
    assert packing.packed(no_documents, tokenizer_file(BYTES)).count() == 0


def first_fit_decreasing(counts):
    room = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            k = next((k for k, left in enumerate(room) if left >= n), None)
            if k is None:
                room.append(1024 - n)
            else:
                room[k] -= n
    return len(room)


def test_patterns_meet_every_length():
    rng = np.random.default_rng(3)
    for counts in ({}, {1: 1}, {1023: 5}, {int(n): int(k) for n, k in zip(rng.integers(1, 1024, 60), rng.integers(1, 90, 60), strict=True)}):
        p = packing.plan(counts)
        inside = sum(int((r[:, 1] - r[:, 0]).sum()) for r in p.rows.values())
        assert inside + sum(counts[n] - first for n, (first, _) in p.stream.items()) == sum(counts.values())
        total = sum(n * k for n, k in counts.items())
        assert -(-total // 1024) <= p.sequences <= first_fit_decreasing(counts)


@pytest.mark.parametrize("low, high", [(1, 1024), (400, 700), (520, 530), (342, 512)])
def test_padding_is_little_for_any_histogram(low, high):
    rng = np.random.default_rng(low)
    lengths, copies = np.unique(rng.integers(low, high, 5000), return_counts=True)
    counts = dict(zip(lengths.tolist(), copies.tolist(), strict=True))
    total = sum(n * k for n, k in counts.items())
    assert packing.plan(counts).sequences * 1024 <= total * 1.01 + 1024


def test_the_linear_program_reaches_its_bound():
    rng = np.random.default_rng(6)
    counts = {int(n): int(k) for n, k in zip(*np.unique(np.clip(rng.lognormal(5.5, 0.8, 3000), 1, 1023).astype(int), return_counts=True), strict=True)}
    found = packing.cutting_patterns(counts)
    made = dict.fromkeys(counts, 0.0)
    for pattern, used in found:
        assert sum(n * k for n, k in pattern.items()) <= 1024
        for n, k in pattern.items():
            made[n] += k * used
    assert all(abs(made[n] - c) < 1e-5 * c + 1e-6 for n, c in counts.items())
    assert sum(u for _, u in found) <= sum(n * k for n, k in counts.items()) / 1024 * 1.006


def test_cut_documents(spark, library):
    """Texts of which no two fit into a sequence: they are cut, and the pieces' checksums are right."""
    texts = [" ".join(f"word{(i * 7 + k) % 90}" for k in range(210 + 3 * i)) for i in range(40)]
    raw = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.packed(docs, tokenizer_file(BYTES)).collect()
    sequences = check_packing(pieces, {(i, len(b) // 4): b for i, b in raw.items()})
    assert sequences <= sum(map(len, raw.values())) / 4096 * 1.01 + 1 and len(pieces) > 40
