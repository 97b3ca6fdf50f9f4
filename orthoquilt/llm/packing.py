"""Packing documents into sequences (operator 3).

Every document is cut at multiples of the capacity; what remains of each (shorter than one
sequence) is packed by cutting-stock column generation on the histogram of lengths. That histogram has fewer rows
than the capacity, so it fits the driver whatever the input. A simplex holds the linear program; a knapsack dynamic program prices new
patterns, several a time, until the Farley bound is near. Pattern counts are rounded down; patterns are then used once more
while documents last, and the few left over are put together by subset sums. Only sequences that are full but for `SLACK` are made so. Documents of
lengths that no such sequence takes (all of them between two fifths and two thirds of the capacity, say) follow each
other in a stream that is cut at the capacity, so padding stays under `SLACK` for any histogram, but for the last sequence. Documents get ranks
within their length, and each rank its place by arithmetic on the patterns: no document moves to the driver.

Null texts count as empty (one end token); very long texts give many full sequences; equal
lengths and repeated rows are told apart by their ranks; an empty table gives no pieces; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoquilt.llm.bpe import Vocabulary, merge_all, split
from orthoquilt.llm.common import small_batches, stored, table, tokenizer_file

CAPACITY = 1024
#: Stop pricing once the objective is within this share of Farley's bound, or of what the tokens fill.
GAP = 0.005
#: Share of a sequence that may be padding; documents that would leave more are cut.
SLACK = 0.01
#: Columns that are priced from one dynamic program.
COLUMNS = 30
#: Length from which a run of white space is split by our own pattern.
BLANK = 2000
#: Documents of one length in a ranking bucket, about.
BUCKET_ROWS = 20_000


class NativeEncoder:
    """Encodes whole texts by a native encoder over the same ranks; nothing is remembered."""

    def __init__(self, vocab: Vocabulary):
        import public_tokenizers
        import tiktoken

        self.vocab = vocab
        ranks = {b: i for i, b in enumerate(vocab.bytes_of) if b and i not in vocab.special.values()}
        self.native = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def part(self, text: str) -> array:
        # blank runs of many thousands are too deep for the native pattern; a run of BLANK has two of these places
        if len(text) > BLANK and re.search(r"\s\s", text[:: BLANK // 2]) and re.search(rf"\s{{{BLANK}}}", text):
            return array("I", b"".join(merge_once(self.vocab, split(text))))
        return array("I", self.native.encode_ordinary(text))

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian uint32."""
        special = self.vocab.special
        if not any(s in text for s in special):
            return self.part(text).tobytes()
        parts = self.vocab.cut.split(text)
        return b"".join((array("I", [special[p]]) if p in special else self.part(p)).tobytes() for p in parts if p)


def merge_once(vocab: Vocabulary, pieces: list[str]) -> Iterator[bytes]:
    found = merge_all(vocab, set(pieces))
    return map(found.__getitem__, pieces)


@lru_cache(2)
def native_encoder(path: str) -> NativeEncoder:
    return NativeEncoder(Vocabulary(path))


def tokenised(df: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, doc_tokens, CRCs of each full piece, length, CRC and ids of the rest, and a CRC of the whole."""
    small_batches(df.sparkSession)
    step = 4 * CAPACITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = native_encoder(path), np.uint32(end_id).tobytes()
        for batch in batches:
            counts, full, rest, rest_crc, rest_ids, whole = [], [], [], [], [], []
            for text in batch.column(1):
                raw = code(text.as_py() or "") + end
                n = len(raw) // 4
                cut = n // CAPACITY * step
                counts.append(n)
                full.append([zlib.crc32(raw[k : k + step]) for k in range(0, cut, step)])
                rest.append(n % CAPACITY)
                rest_crc.append(zlib.crc32(raw[cut:]))
                rest_ids.append(raw[cut:])
                whole.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(full, pa.list_(pa.int64())),
                    pa.array(rest, pa.int32()),
                    pa.array(rest_crc, pa.int64()),
                    pa.array(rest_ids, pa.binary()),
                    pa.array(whole, pa.int64()),
                ],
                ["doc_id", "doc_tokens", "full_crc", "rest", "rest_crc", "rest_ids", "whole_crc"],
            )

    return df.select("doc_id", "text").mapInArrow(
        run, "doc_id long, doc_tokens long, full_crc array<long>, rest int, rest_crc long, rest_ids binary, whole_crc long"
    )


def best_fills(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each room, and the item last added (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    use = np.flatnonzero(value > 1e-12)
    if not len(use):
        return best, last
    lens, worth = lengths[use], value[use]
    upto = np.searchsorted(lens, np.arange(capacity + 1), side="right")
    for room in range(int(lens[0]), capacity + 1):
        k = upto[room]
        got = best[room - lens[:k]] + worth[:k]
        i = int(got.argmax())
        if got[i] > best[room - 1] + 1e-12:
            best[room], last[room] = got[i], use[i]
        else:
            best[room] = best[room - 1]
    return best, last


def fullest(left: dict[int, float], capacity: int) -> dict[int, int]:
    """The longest length left and, by a subset-sum over bits, one of each of those that fill its sequence best."""
    lengths = sorted((n for n in left if left[n] > 0), reverse=True)
    first = lengths[0]
    room = capacity - first
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for n in [n for n in lengths if n <= room and left[n] > (n == first)]:
        grown = (reach | reach << n) & mask
        if grown != reach:
            steps.append((n, reach))
            reach = grown
    total = reach.bit_length() - 1
    pattern = {first: 1}
    for n, before in reversed(steps):
        if not before >> total & 1:
            pattern[n] = pattern.get(n, 0) + 1
            total -= n
    return pattern


def first_basis(counts: dict[int, int], capacity: int) -> tuple[list[dict[int, int]], list[float], list[int]]:
    """Patterns of which each ends one length that no later one holds (so they form a triangular basis),
    how often each is used, and the lengths they end; lengths that end together get a pattern of their
    own, used 0 times."""
    left: dict[int, float] = dict(counts)
    patterns, used, ends = [], [], []
    while left:
        pattern = fullest(left, capacity)
        times = min(left[n] / k for n, k in pattern.items())
        ended = [n for n, k in pattern.items() if left[n] - k * times <= 1e-9]
        patterns += [pattern, *({n: capacity // n} for n in ended[1:])]
        used += [times, *(0.0 for _ in ended[1:])]
        ends += ended
        for n, k in pattern.items():
            left[n] -= k * times
        for n in ended:
            del left[n]
    return patterns, used, ends


def cutting_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], float]]:
    """(pattern as length -> copies, times used) of a near-optimal linear program over the histogram."""
    lengths = np.array(sorted(counts), np.int64)
    m = len(lengths)
    if not m:
        return []
    demand = np.array([counts[int(x)] for x in lengths], float)
    row_of = {int(n): i for i, n in enumerate(lengths)}
    start, times, ends = first_basis(counts, capacity)
    patterns = [{row_of[n]: k for n, k in p.items()} for p in start]
    holds: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for j, p in enumerate(patterns):
        for i, k in p.items():
            holds[i].append((j, k))
    inverse = np.zeros((m, m))
    for j, n in enumerate(ends):  # forward substitution, in the order in which lengths end
        i = row_of[n]
        row = inverse[j]
        row[i] = 1.0
        for t, k in holds[i]:
            if t < j:
                row -= k * inverse[t]
        row /= patterns[j][i]
    used = np.array(times)
    dual = inverse.sum(0)

    def pivoted(fresh: dict[int, int]) -> bool:
        """Take a column into the basis, if it is still worth more than one."""
        nonlocal dual, inverse
        if sum(k * dual[i] for i, k in fresh.items()) <= 1 + 1e-6:
            return False
        move = np.zeros(m)
        for i, k in fresh.items():
            move += k * inverse[:, i]
        ok = move > 1e-7
        if not ok.any():
            return False
        ratio = np.where(ok, used / np.where(ok, move, 1), np.inf)
        step = max(0.0, float(ratio.min()))
        out = int(np.where(ratio <= step + 1e-9, move, -1).argmax())  # of ties the steadiest pivot
        np.subtract(used, step * move, out=used)
        used[out] = step
        np.maximum(used, 0, out=used)
        row = inverse[out] / move[out]
        dual = dual + (1 - move.sum()) * row
        inverse -= np.outer(move, row)
        inverse[out] = row
        patterns[out] = fresh
        return True

    pivots, refreshed, least, since = 0, 0, used.sum(), 0
    # Farley: the duals divided by the best column's worth are feasible. Degenerate pivots may stand still; after
    # many rounds without gain any more the plan is as good as it gets (what it leaves unfilled is cut).
    area = float(lengths @ demand) / capacity
    while since < 200 and used.sum() > (1 + GAP) * area:  # no plan needs fewer sequences than the tokens fill
        best, last = best_fills(np.maximum(dual, 0), lengths, capacity)
        if best[capacity] <= 1 + GAP:
            break
        worth = dual + np.where(lengths <= capacity, best[capacity - lengths], -1)
        for i in np.argsort(-worth)[:COLUMNS]:  # the best column of all is that of the first of these
            fresh: dict[int, int] = {int(i): 1}
            room = capacity - int(lengths[i])
            while room > 0 and best[room] > 0:
                if last[room] < 0:
                    room -= 1
                    continue
                fresh[int(last[room])] = fresh.get(int(last[room]), 0) + 1
                room -= int(lengths[last[room]])
            pivots += pivoted(fresh)
        if pivots - refreshed >= 200:  # rounding errors do not add up
            refreshed = pivots
            basis = np.zeros((m, m))
            for j, p in enumerate(patterns):
                for i, k in p.items():
                    basis[i, j] = k
            inverse = np.linalg.inv(basis)
            dual = inverse.sum(0)
            used = np.maximum(inverse @ demand, 0)
        since = 0 if used.sum() < least * (1 - 1e-6) else since + 1
        least = min(least, used.sum())
    return [({int(lengths[i]): k for i, k in p.items()}, float(u)) for p, u in zip(patterns, used, strict=True)]


@dataclass
class Plan:
    """Where the documents of each length go: for each length rows (first rank, rank behind the last,
    first sequence, copies in a sequence, offset of the first copy); the ranks from which on a length is in the
    stream, with the place of the first; the sequence with which the stream begins, and the number of sequences."""

    rows: dict[int, np.ndarray]
    stream: dict[int, tuple[int, int]]
    whole: int
    sequences: int


def plan(counts: dict[int, int], capacity: int = CAPACITY, slack: float = SLACK) -> Plan:
    left = dict(counts)
    at = dict.fromkeys(counts, 0)
    rows: dict[int, list[tuple[int, int, int, int, int]]] = {n: [] for n in counts}
    sequences = 0
    enough = lambda pattern: sum(n * k for n, k in pattern.items()) >= (1 - slack) * capacity

    def take(pattern: dict[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows[n].append((at[n], at[n] + k * times, sequences, k, offset))
            at[n] += k * times
            left[n] -= k * times
            offset += n * k
        sequences += times

    found = [(pattern, used) for pattern, used in cutting_patterns(counts, capacity) if enough(pattern)]
    for pattern, used in sorted(found, key=lambda x: -x[1]):
        times = min([int(used + 1e-6), *(left[n] // k for n, k in pattern.items())])
        if times > 0:
            take(pattern, times)
    # a pattern that was rounded down by most is used once more where its documents are still there
    for pattern, _ in sorted(found, key=lambda x: x[1] + 1e-6 - int(x[1] + 1e-6), reverse=True):
        if all(left[n] >= k for n, k in pattern.items()):
            take(pattern, 1)
    stream, place = {}, 0
    while any(left.values()):
        pattern = fullest(left, capacity)
        if enough(pattern):
            take(pattern, min(left[n] // k for n, k in pattern.items()))
        else:  # no others of those left fill up the longest
            n = max(pattern)
            stream[n] = (at[n], place)
            place += n * left[n]
            left[n] = 0
    whole = sequences
    return Plan({n: np.array(r, np.int64).reshape(-1, 5) for n, r in rows.items()}, stream, whole, whole - -place // capacity)


def packed(df: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """The pieces of df's documents (doc_id, text) in their sequences."""
    spark = df.sparkSession
    docs = stored(tokenised(df, path, end_id), "tokens")
    lengths = {r[0]: r[1] for r in docs.where("rest > 0").groupBy("rest").count().collect()}  # fewer rows than CAPACITY
    placed = plan(lengths)
    buckets = max(1, sum(lengths.values()) // BUCKET_ROWS)
    # Ranks: within (length, bucket) by a sort, plus what the buckets before hold. No key gathers in a task.
    # Ids go along only for lengths that may be cut.
    cut = F.col("rest").isin(list(placed.stream)) if placed.stream else F.lit(False)
    marked = docs.withColumn("rest_ids", F.when(cut, F.col("rest_ids"))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "whole_crc", "doc_tokens"), F.lit(buckets)).cast("int"))
    held = marked.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum(F.size("full_crc")).alias("f"))
    ahead = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        "rest", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rank0"), F.coalesce(F.sum("f").over(ahead), F.lit(0)).alias("full0")
    )
    # full pieces: numbered within their rest length, after the lengths before
    of_rest = {r[0]: r[1] for r in held.groupBy("rest").agg(F.sum("f")).collect()}
    base, first_full = placed.sequences, {}
    for n in sorted(of_rest):
        first_full[n] = base
        base += of_rest[n]
    inside = Window.partitionBy("rest", "bucket").orderBy("doc_id", "whole_crc", "doc_tokens", "rest_crc")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = marked.select(
        "*",
        (F.row_number().over(inside) - 1).alias("r"),
        F.coalesce(F.sum(F.size("full_crc")).over(earlier), F.lit(0)).alias("f"),
    ).join(starts, ["rest", "bucket"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int | None]] = [[] for _ in range(7)]
            for doc, tokens, full, rest, crc, ids, rank, full_at in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                for k, c in enumerate(full):
                    for col, v in zip(out, (doc, k * CAPACITY, CAPACITY, c, tokens, first_full[rest] + full_at + k, 0), strict=True):
                        col.append(v)
                if not rest:
                    continue
                first, place = placed.stream.get(rest, (rank + 1, 0))
                if rank >= first:  # in the stream, maybe across two sequences
                    seq, offset = divmod(place + (rank - first) * rest, CAPACITY)
                    cut = min(rest, CAPACITY - offset)
                    seq += placed.whole
                    pieces = [(doc, tokens - rest, cut, crc if cut == rest else zlib.crc32(ids[: 4 * cut]), tokens, seq, offset)]
                    if cut < rest:
                        pieces.append((doc, tokens - rest + cut, rest - cut, zlib.crc32(ids[4 * cut :]), tokens, seq + 1, 0))
                else:
                    rows = placed.rows[rest]
                    lo, _, seq, copies, offset = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1].tolist()
                    pieces = [(doc, tokens - rest, rest, crc, tokens, seq + (rank - lo) // copies, offset + (rank - lo) % copies * rest)]
                for piece in pieces:
                    for col, v in zip(out, piece, strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(col, pa.int64()) for col in out],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select(
        "doc_id", "doc_tokens", "full_crc", "rest", "rest_crc", "rest_ids", (F.col("r") + F.col("rank0")).alias("rank"), (F.col("f") + F.col("full0")).alias("full_at")
    ).mapInArrow(place, columns)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all `documents` into sequences of at most 1024 tokens."""
    return packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
