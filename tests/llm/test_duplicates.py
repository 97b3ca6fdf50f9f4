"""Operators 2 and 4 against brute force."""

from __future__ import annotations

import base64
import hashlib
import random

import xxhash

from orthoquilt.llm import chunks, simhash
from orthoquilt.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Smallest id reachable, by all pairs."""
    root = {p: p for p in prints.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints.items():
        least[find(p)] = min(d, least.get(find(p), d))
    return {d: least[find(p)] for d, p in prints.items()}


def test_fingerprints(tricky):
    for t in tricky:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
        assert simhash.fingerprint(t, block=5) == plain_fingerprint(t)


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_query(spark, sf):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = plain_classes(prints)
    found = simhash.op2_simhash(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


def test_large_buckets_lose_no_link(spark):
    """Fingerprints that share all but a few bits, so that buckets overflow."""
    r = random.Random(1)
    base = r.getrandbits(64)
    values = {base}
    while len(values) < 150:
        v = base
        for _ in range(r.randint(1, 5)):
            v ^= 1 << r.randrange(0, 64, 5)
        values.add(v)
    values |= {r.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    prints = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(d, simhash.signed(p)) for d, p in prints.items()], "doc_id long, fp long")
    want = plain_classes(prints)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == want
    small = simhash.linked(df.select("fp"), bucket=4).count()
    assert small > 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and roots[500] == roots[501] != roots[0]
    assert components(edges.where("false")).count() == 0


def test_edge_cases(documents, no_documents):
    found = simhash.near_duplicates(simhash.fingerprints(documents))
    assert found.count() == documents.count()
    kept = simhash.kept_documents(documents)
    assert kept.columns == documents.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert None in ids and 0 in ids and not {1, 2, 3} & ids  # blank texts are one group
    assert simhash.kept_documents(no_documents).count() == 0


def test_kept_documents_keeps_one_of_each_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    classes = {r["component_id"] for r in simhash.op2_simhash(spark, sf).collect()}
    assert {r["doc_id"] for r in simhash.kept_documents(docs).select("doc_id").collect()} == classes


def test_chunks_partition_the_text_and_resist_shifts(word_soup):
    text = word_soup(3000).encode()
    ends = chunks.cuts(text)
    assert ends[-1] == len(text) and all(a < b for a, b in zip(ends, ends[1:]))
    assert ends == chunks.cuts(text, block=1000)
    own, moved = chunks.chunk_set(text), chunks.chunk_set(b"some words before it all " + text)
    assert chunks.containment(own, moved) > 0.98
    assert chunks.containment(own, chunks.chunk_set(word_soup(3000).encode())) < 0.2
    assert chunks.containment(own, own) == 1.0
    assert chunks.containment({}, {}) == 1.0 and chunks.containment({}, own) == 0.0


def plain_chunks(raw):
    """Chunks by the definition: roll the gear hash byte by byte, cut at the first place that the masks allow."""
    out, begin = [], 0
    hashes, h = [], 0
    for b in raw:
        h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        hashes.append(h)
    while begin < len(raw):
        end = min(begin + 128, len(raw))
        for at in range(begin + 8, end + 1):
            if hashes[at - 1] & (0xFC000000 if at - begin < 32 else 0xF0000000) == 0:
                end = at
                break
        out.append(raw[begin:end])
        begin = end
    return out


def plain_likeness(a, b):
    own, other = set(plain_chunks(a)), set(plain_chunks(b))
    total = sum(map(len, own))
    return sum(len(x) for x in own & other) / total if total else float(not other)


def test_chunks_equal_the_definition(tricky, word_soup):
    for text in [*tricky, word_soup(500), "é" * 400]:
        raw = (text or "").encode()
        ends = [0, *chunks.cuts(raw)]
        assert [raw[a:b] for a, b in zip(ends, ends[1:])] == plain_chunks(raw)


def check_successors(rows, found):
    key = lambda r: (r[0] is not None, r[0] or 0)
    order = sorted(rows, key=key)
    by_id = {r["doc_id"]: r for r in found}
    for i, (doc, text) in enumerate(order):
        follow = order[(i + 1) % len(order)][1] or ""
        t = text or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + follow[:k]
        r = by_id[doc]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == plain_likeness(t.encode(), edited.encode())
        assert r["near_next"] == plain_likeness(t.encode(), follow.encode())
        assert base64.b64decode(r["edited_fingerprint"]) == chunks.packed(chunks.chunk_set(edited.encode()))
        assert r["near_edited"] == chunks.likeness(r["fingerprint"], r["edited_fingerprint"])


def test_chunk_query(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_successors(rows, chunks.op4_document_fingerprints(spark, sf).collect())


def test_chunk_edge_cases(spark, documents, no_documents):
    assert chunks.fingerprinted(documents).count() == documents.count()
    assert chunks.fingerprinted(no_documents).count() == 0
    one = chunks.fingerprinted(spark.createDataFrame([(5, "alone here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"alone heal").hexdigest()
