"""Byte-pair encoding and decoding (operator 1).

A segment tree over adjacent pairs holds `rank * width + position` in its leaves, so its
root is the leftmost pair of the lowest rank. A merge changes three leaves, each
a logarithmic point update. Short pieces of a batch are merged side by side in numpy, one
tree a row; a piece longer than `WIDE` symbols gets a tree of its own.

Null texts encode as empty; very long texts are taken whole; a table without rows gives
none; ids that repeat give a row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orthoquilt.llm.common import small_batches, table, tokenizer_file

#: Symbols of the longest piece that is merged side by side with others.
WIDE = 64
#: Entries of a worker's younger cache generation (it becomes the older one when full), and the characters of the longest entry.
CACHED, LONG = 200_000, 64
NONE = np.int64(1) << 60

#: Equals the library's pattern on texts without the characters of ODD.
QUICK = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A blank between white space: there the text may not be cut at single blanks.
TIGHT = re.compile(r" (?<=\s )(?=\s|\Z)")
CONTROL = re.compile("[\x1c-\x1f]")


@lru_cache(1)
def exact_pattern():
    import regex

    blank = r"\p{White_Space}"
    return regex.compile(
        rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{blank}\p{{L}}\p{{N}}]+|{blank}+(?![^{blank}])|{blank}+"
    )


@lru_cache(1)
def odd_pattern() -> re.Pattern:
    """Characters that the classes of `re` and of the vocabulary's pattern see differently."""
    import sys

    import regex

    every = "".join(chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    odd = set(map(chr, range(28, 32)))
    for exact, quick in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\p{White_Space}", r"\s")):
        odd |= set(regex.findall(exact, every)) ^ set(re.findall(quick, every))
    spans: list[list[int]] = []
    for c in sorted(map(ord, odd)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def split(text: str) -> list[str]:
    """The pieces into which the vocabulary's pattern splits a text."""
    quick = not CONTROL.search(text) if text.isascii() else not odd_pattern().search(text)
    return (QUICK if quick else exact_pattern()).findall(text)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        data = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        ids: dict[str, int] = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = ids[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        self.size = size
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        self.rank = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        cut = "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({cut})") if cut else None
        lens = np.array([len(x) for x in self.bytes_of], np.int64)
        self.token_len, self.token_at = lens, np.concatenate([[0], np.cumsum(lens)[:-1]])
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE where they do not merge; negative symbols never do."""
        want = a * self.size + b
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        out, step = [], 1 << 18
        for k in range(0, len(ids), step):
            part = ids[k : k + step]
            lens = self.token_len[part]
            ends = np.cumsum(lens)
            total = int(ends[-1])
            out.append(self.blob[np.arange(total) + np.repeat(self.token_at[part] - (ends - lens), lens)].tobytes())
        return b"".join(out)


def merge_rows(vocab: Vocabulary, pieces: list[bytes], width: int) -> list[bytes]:
    """Merge pieces of at most `width` (a power of two) bytes side by side; the ids of each as little-endian uint32."""
    m = len(pieces)
    lens = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
    inside = np.arange(width)[None, :] < lens[:, None]
    sym = np.where(inside, vocab.byte_id[raw], -1)
    grid = np.broadcast_to(np.arange(width), (m, width))
    # position width stands for "none"; an extra column takes what is written there
    nxt = np.where(grid + 1 < lens[:, None], grid + 1, width)
    nxt = np.hstack([nxt, np.full((m, 1), width)]).ravel()
    prv = np.hstack([np.where(grid > 0, grid - 1, width), np.full((m, 1), width)]).ravel()
    ranks = vocab.pair_ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(m, width - 1)
    leaves = np.full((m, width), NONE)
    leaves[:, :-1] = np.where(ranks < NONE, ranks * width + grid[:, :-1], NONE)
    sym = np.hstack([sym, np.full((m, 1), -1)]).ravel()
    tree = np.full((m, 2 * width), NONE)
    tree[:, width:] = leaves
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    tree = tree.ravel()
    live = np.flatnonzero(tree[1 :: 2 * width] < NONE)
    while len(live):
        root = tree[live * (2 * width) + 1]
        line, node = live * (width + 1), live * (2 * width)
        pos = root % width
        gone = nxt[line + pos]
        after = nxt[line + gone]
        before = prv[line + pos]
        fused = vocab.made[root // width]
        sym[line + pos] = fused
        sym[line + gone] = -1
        nxt[line + pos] = after
        prv[line + after] = pos
        right = vocab.pair_ranks(fused, sym[line + after])
        left = vocab.pair_ranks(np.where(before < width, sym[line + before], -1), fused)
        tree[node + width + gone] = NONE
        tree[node + width + pos] = np.where(right < NONE, right * width + pos, NONE)
        # a missing left neighbour rewrites the merged leaf with what it has
        left_at = np.where(before < width, before, pos)
        tree[node + width + left_at] = np.where(
            before < width, np.where(left < NONE, left * width + before, NONE), tree[node + width + pos]
        )
        for changed in (gone, pos, left_at):
            at = (changed + width) >> 1
            while at[0]:
                kids = node + 2 * at
                tree[node + at] = np.minimum(tree[kids], tree[kids + 1])
                at = at >> 1
        live = live[tree[node + 1] < NONE]
    sym = sym.reshape(m, width + 1)[:, :width]
    kept = sym >= 0
    flat = sym[kept].astype("<u4").tobytes()
    ends = np.cumsum(kept.sum(1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def merge_long(vocab: Vocabulary, piece: bytes) -> bytes:
    """The same for one long piece, with a tree of its own."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    sym = vocab.byte_id[np.frombuffer(piece, np.uint8)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    leaves = np.full(width, NONE)
    ranks = vocab.pair_ranks(sym[:-1], sym[1:])
    leaves[: n - 1] = np.where(ranks < NONE, ranks * width + np.arange(n - 1), NONE)
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append(np.minimum(rows[-1][::2], rows[-1][1::2]))
    tree = [int(NONE), *np.concatenate(rows[::-1]).tolist()]
    sym, none, rank, made, size = sym.tolist(), int(NONE), vocab.rank, vocab.made.tolist(), vocab.size

    def put(at: int, value: int) -> None:
        at += width
        tree[at] = value
        while at > 1:
            at >>= 1
            least = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == least:
                break
            tree[at] = least

    while tree[1] < none:
        r, pos = divmod(tree[1], width)
        gone = nxt[pos]
        after, before = nxt[gone], prv[pos]
        sym[pos] = made[r]
        sym[gone] = -1
        nxt[pos] = after
        put(gone, none)
        if after < n:
            prv[after] = pos
            k = rank.get(sym[pos] * size + sym[after])
            put(pos, none if k is None else k * width + pos)
        else:
            put(pos, none)
        if before >= 0:
            k = rank.get(sym[before] * size + sym[pos])
            put(before, none if k is None else k * width + before)
    return np.array([s for s in sym if s >= 0], "<u4").tobytes()


def merge_all(vocab: Vocabulary, pieces: Iterable[str]) -> dict[str, bytes]:
    """The ids of each piece (a string that the pattern has split off)."""
    by_width: dict[int, list[str]] = {}
    out: dict[str, bytes] = {}
    for p in pieces:
        n = len(p.encode())
        if n == 1:
            out[p] = np.uint32(vocab.byte_id[ord(p)]).tobytes()
        elif n > WIDE:
            out[p] = merge_long(vocab, p.encode())
        elif n:
            by_width.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(p)
    for width, group in by_width.items():
        for k in range(0, len(group), 20_000):
            part = group[k : k + 20_000]
            out.update(zip(part, merge_rows(vocab, [p.encode() for p in part], width), strict=True))
    return out


class Encoder:
    """Encodes texts by a vocabulary; what was merged before is remembered in two generations."""

    cached = CACHED

    def __init__(self, vocab: Vocabulary, merge: Callable[[Vocabulary, Iterable[str]], dict[str, bytes]] = merge_all):
        self.vocab, self.merge = vocab, merge
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces_young: dict[str, bytes] = {}
        self.pieces_old: dict[str, bytes] = {}
        self.long: set[str] = set()

    def _learn(self, chunks: set[str]) -> None:
        """Make every chunk (a run between single blanks, with its blank) known."""
        need: dict[str, list[str]] = {}
        for c in chunks.difference(self.young):
            if (v := self.old.get(c)) is not None:
                self.young[c] = v
            else:
                need[c] = split(c)
        wanted: set[str] = set()
        for pieces in need.values():
            wanted.update(pieces)
        self._learn_pieces(wanted)
        get = self.pieces_young.__getitem__
        for c, pieces in need.items():
            self.young[c] = b"".join(map(get, pieces))

    def _learn_pieces(self, wanted: set[str]) -> None:
        new = []
        for p in wanted.difference(self.pieces_young):
            if (v := self.pieces_old.get(p)) is not None:
                self.pieces_young[p] = v
            else:
                new.append(p)
        self.pieces_young.update(self.merge(self.vocab, new))
        self.long.update(p for p in new if len(p) > LONG)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        if len(self.young) > self.cached:
            self.old, self.young = self.young, {}
        if len(self.pieces_young) > self.cached:
            self.pieces_old, self.pieces_young = self.pieces_young, {}
        cut, special = self.vocab.cut, self.vocab.special
        jobs: list[list[tuple[bool, list[str]] | int]] = []
        chunks: set[str] = set()
        pieces: set[str] = set()
        for text in texts:
            job: list[tuple[bool, list[str]] | int] = []
            parts = [text]
            if cut and any(s in text for s in special):
                parts = cut.split(text)
            for part in parts:
                if len(parts) > 1 and part in special:
                    job.append(special[part])
                elif part and ("\0" in part or TIGHT.search(part)):
                    whole = split(part)
                    pieces.update(whole)
                    job.append((False, whole))
                elif part:
                    # chunks after the first begin with their blank
                    runs = part.replace(" ", "\0 ").split("\0")
                    chunks.update(runs)
                    job.append((True, runs))
            jobs.append(job)
        self._learn(chunks)
        self._learn_pieces(pieces)
        of = (self.pieces_young.__getitem__, self.young.__getitem__)
        out = []
        for job in jobs:
            ids = [np.uint32(x).tobytes() if isinstance(x, int) else b"".join(map(of[x[0]], x[1])) for x in job]
            out.append(ids[0] if len(ids) == 1 else b"".join(ids))
        for x in [c for c in chunks if len(c) > LONG]:  # so the number of entries bounds their bytes
            del self.young[x]
        while self.long:
            del self.pieces_young[self.long.pop()]
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker and file; it lives as long as the worker."""
    return Encoder(Vocabulary(path))


def in_blocks(texts: list[str | None], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Nulls as empty, in runs of about `chars` characters."""
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the array column `ids` of each text's token ids."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in df.schema.fields if f.name != ids), T.StructField(ids, T.ArrayType(T.LongType()))])
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            at = batch.schema.names.index(text)
            found = [x for block in in_blocks(batch.column(at).to_pylist()) for x in code(block)]
            lists = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in found], pa.list_(pa.int64()))
            keep = [i for i, n in enumerate(batch.schema.names) if n != ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), lists], [*(batch.schema.names[i] for i in keep), ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the column `text`: the tokens' bytes as UTF-8 (what is no UTF-8 becomes U+FFFD; null ids: empty)."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField(text, T.StringType())])
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = encoder(path).vocab
        for batch in batches:
            rows = batch.column(batch.schema.names.index(ids)).to_pylist()
            found = pa.array([vocab.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in rows], pa.string())
            keep = [i for i, n in enumerate(batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), found], [*(batch.schema.names[i] for i in keep), text])

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for block in in_blocks(batch.column(1).to_pylist()):
                for raw in code(block):
                    ids = np.frombuffer(raw, "<u4")
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(raw).hexdigest())
                    back = code.vocab.decode(ids)
                    of_text.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of `documents`."""
    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
