"""Token counts (operator 9) by heap-and-linked-list byte-pair merging.

For every word the lowest-rank adjacent pair is popped from a heap and its two symbols become one in a
linked list; the count is the initial symbols less the merges, and no ids are made. A worker
remembers the counts of the words it has met.

Null texts count 0 tokens and 0 bytes; very long texts and words are taken whole; repeated rows
give a row each; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orthoquilt.llm.bpe import CONTROL, LONG, byte_letters, in_blocks, odd_pattern
from orthoquilt.llm.common import small_batches, table, tokenizer_file

CACHED = 200_000
LIMIT = 2048
#: The vocabulary's pattern on words without odd characters (each number by itself).
QUICK = re.compile(r"'(?:[sdmt]|ll|ve|re)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


@lru_cache(1)
def exact_pattern():
    import regex

    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


class Counter:
    def __init__(self, path: str):
        data = json.load(open(path, encoding="utf-8"))
        self.letters = {b: c for c, b in byte_letters().items()}
        self.end = data["model"].get("end_of_word_suffix") or ""
        self.special = [x["content"] for x in data["added_tokens"]]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        number: dict[str, int] = data["model"]["vocab"]
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            self.rank.setdefault(number[a] << 32 | number[b], r)
        self.made = [number[a + b] for a, b in pairs]
        #: Of each byte, inside a piece and at its end; a symbol that the vocabulary lacks is dropped, as in the library.
        self.inner = [number.get(self.letters[b], -1) for b in range(256)]
        self.last = [number.get(self.letters[b] + self.end, -1) for b in range(256)]
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece that the pattern has split off."""
        raw = piece.encode()
        inner = self.inner
        sym = [inner[b] for b in raw[:-1]]
        sym.append(self.last[raw[-1]])
        if -1 in sym:
            sym = [s for s in sym if s >= 0]
        n = len(sym)
        if n < 2:
            return n
        rank_of, made, push, pop = self.rank.get, self.made, heapq.heappush, heapq.heappop
        heap = []
        before = sym[0] << 32
        for i in range(1, n):
            s = sym[i]
            if (r := rank_of(before | s)) is not None:
                heap.append(r << 32 | i - 1)
            before = s << 32
        heapq.heapify(heap)
        nxt, prv, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            r, i = divmod(pop(heap), 1 << 32)
            j = nxt[i]
            if j >= n or sym[i] < 0 or rank_of(sym[i] << 32 | sym[j]) != r:
                continue  # one of the two has been merged meanwhile
            merges += 1
            s = sym[i] = made[r]
            sym[j] = -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := rank_of(s << 32 | sym[k])) is not None:
                    push(heap, r << 32 | i)
            h = prv[i]
            if h >= 0 and (r := rank_of(sym[h] << 32 | s)) is not None:
                push(heap, r << 32 | h)
        return n - merges

    def word(self, word: str) -> int:
        quick = not CONTROL.search(word) if word.isascii() else not odd_pattern().search(word)
        total, known = 0, self.pieces
        for piece in (QUICK if quick else exact_pattern()).findall(word):
            if (n := known.get(piece)) is None:
                n = self.merged(piece)
                if len(piece) <= LONG:
                    known[piece] = n
            total += n
        return total

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        if len(self.pieces) > 2 * CACHED:
            self.pieces = {}
        jobs, words = [], set()
        for text in texts:
            extra, parts = 0, [text]
            if self.cut and any(s in text for s in self.special):
                parts = self.cut.split(text)
                extra = sum(p in self.special for p in parts)
                parts = [p for p in parts if p not in self.special]
            own: list[str] = []
            for p in parts:
                if not p.isascii():
                    if not unicodedata.is_normalized("NFC", p):
                        p = unicodedata.normalize("NFC", p)
                    p = p.replace("Σ", "σ")  # the library lowers each character by itself
                own += self.runs(p.lower())
            words.update(own)
            jobs.append((extra, own))
        young, old = self.young, self.old
        for w in words.difference(young):
            v = old.get(w)
            young[w] = self.word(w) if v is None else v
        get = young.__getitem__
        found = [extra + sum(map(get, own)) for extra, own in jobs]
        for w in [w for w in words if len(w) > LONG]:  # so the number of entries bounds their bytes
            del young[w]
        return found

    @staticmethod
    def runs(text: str) -> list[str]:
        """Runs without blanks; the four control characters that only Python takes for blanks stay inside."""
        return re.split(r"[ \t-\r\x85\xa0  -     　]+", text) if CONTROL.search(text) else text.split()


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether that is over the limit, for df's doc_id and text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            sizes, found = [], []
            for block in in_blocks(batch.column(1).to_pylist()):
                sizes += [len(t) if t.isascii() else len(t.encode()) for t in block]
                found += count(block)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every whole text of `documents`."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
