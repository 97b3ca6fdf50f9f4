"""Document fingerprints by content-defined chunking (operator 4).

A gear hash over the last 32 bytes decides where a text may be cut: by a hard mask up to the normal
chunk length, by an easier one after it (normalised chunking), so an edit moves only the
boundaries near it. The fingerprint is the set of chunk digests, each with its chunk's length. The
likeness of A to B is A's containment: the length of A's distinct chunks that B has too, by the length of all
of them (two empty texts: 1; an empty and another: 0).

For each document's successor by id, compressed texts are dealt once by ranges of (id, hash of the
text) and sorted; successors inside a range are neighbours, and the ends of the ranges, one row each, are joined.

Null texts count as empty; very long texts are taken whole; rows of one id follow each other by the
hash of their texts; null ids come first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoquilt.llm.common import small_batches, stored, table

SHORTEST, NORMAL, LONGEST = 8, 32, 128
#: Bytes of a chunk in a fingerprint.
CHUNK = 9
GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Top bits, which all 32 bytes of the window reach: six for the hard mask, four of them for the easy one.
HARD, EASY = np.uint32(0xFC000000), np.uint32(0xF0000000)


def cuts(raw: bytes, block: int = 1 << 22) -> list[int]:
    """Where the chunks of raw end."""
    n = len(raw)
    marks: list[int] = []
    firm: list[bool] = []
    for k in range(0, n, block):
        lead = min(k, 31)
        h = GEAR[np.frombuffer(raw, np.uint8, min(block, n - k) + lead, k - lead)]
        for s in (1, 2, 4, 8, 16):
            more = h[:-s] << np.uint32(s)
            h = h.copy()
            h[s:] += more
        h = h[lead:]
        at = np.flatnonzero((h & EASY) == 0)
        marks += (at + (k + 1)).tolist()
        firm += ((h[at] & HARD) == 0).tolist()
    out, begin, i, m = [], 0, 0, len(marks)
    while begin < n:
        low, middle, end = begin + SHORTEST, begin + NORMAL, begin + LONGEST
        while i < m and marks[i] < low:
            i += 1
        while i < m and marks[i] < middle and not firm[i]:
            i += 1
        begin = marks[i] if i < m and marks[i] <= end else min(end, n)
        out.append(begin)
    return out


def chunk_set(raw: bytes) -> dict[int, int]:
    """Digest -> length of the distinct chunks, in the order of the text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    begin, found = 0, {}
    for end in cuts(raw):
        found.setdefault(digest(raw[begin:end]), end - begin)
        begin = end
    return found


def packed(chunks: dict[int, int]) -> bytes:
    """The fingerprint as bytes: of each chunk 64 bits of digest and its length less one."""
    return struct.pack("<" + "QB" * len(chunks), *(x for d, n in chunks.items() for x in (d, n - 1)))


def in_common(a: bytes, b: bytes) -> int:
    """How many bytes of whole chunks two fingerprints share at their beginnings."""
    n = min(len(a), len(b)) // CHUNK * CHUNK
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else np.zeros(0, int)
    return int(differ[0]) // CHUNK * CHUNK if len(differ) else n


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    total = sum(own.values())
    if not total:
        return 0.0 if other else 1.0
    return sum(own[d] for d in own.keys() & other.keys()) / total


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def judged(text: str, own: dict[int, int], following: str, next_chunks: dict[int, int]) -> tuple:
    new = edited(text, following).encode()
    new_chunks = chunk_set(new)
    fp, new_fp = packed(own), packed(new_chunks)
    shared = in_common(fp, new_fp)  # an edit leaves the chunks before it, so they are kept once
    return (
        len(text), hashlib.sha256(new).hexdigest(), fp, shared, new_fp[shared:],
        containment(own, new_chunks), containment(own, next_chunks),
    )


_FOUND = "n_chars long, edited_sha256 string, fp binary, shared int, rest binary, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.float64()]


def fingerprinted(df: DataFrame) -> DataFrame:
    """For df's doc_id and text: fingerprints of the text and of its edited text, and their likeness."""
    small_batches(df.sparkSession)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in batches:
            z = pa.array([press((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], ["doc_id", "h", "z"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        last = None
        for batch in batches:
            for doc, z in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                z = z.as_py()
                text = open_(z).decode()
                chunks = chunk_set(text.encode())
                if last is None:
                    rows.append((1, part, doc, *[None] * 7, z))
                else:
                    rows.append((0, part, last[0], *judged(last[1], last[2], text, chunks), None))
                last = (doc, text, chunks, z)
                if len(rows) >= 500:
                    yield emit(rows)
                    rows = []
        if last is not None:
            rows.append((2, part, last[0], *[None] * 7, last[3]))
        if rows:
            yield emit(rows)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), *_TYPES, pa.binary()]
        names = ["kind", "part", "doc_id", *(x.split()[0] for x in _FOUND.split(", ")), "z"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for z, follow in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b = open_(z).decode(), open_(follow).decode()
                out.append(judged(a, chunk_set(a.encode()), b, chunk_set(b.encode())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True))],
                ["doc_id", *(x.split()[0] for x in _FOUND.split(", "))],
            )

    dealt = (
        df.select("doc_id", F.xxhash64("text").alias("h"), "text")
        .mapInArrow(shrink, "doc_id long, h long, z binary")
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
    )
    found = stored(dealt.mapInArrow(judge, f"kind int, part int, doc_id long, {_FOUND}, z binary"), "chunks")
    # one row for each range: which range follows it
    order = found.where("kind = 1").groupBy("part").agg(F.first("doc_id").alias("first"))
    by_part = Window.orderBy("part")
    follows = order.select(
        "part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next")
    )
    heads = found.where("kind = 1").select(F.col("part").alias("next"), F.col("z").alias("follow"))
    ends = found.where("kind = 2").select("part", "doc_id", "z").join(follows, "part").join(heads, "next")
    ends = ends.select("doc_id", "z", "follow").mapInArrow(stitch, f"doc_id long, {_FOUND}")
    every = found.where("kind = 0").select(ends.columns).union(ends)
    whole = F.concat(F.expr("substring(fp, 1, shared)"), F.col("rest"))
    return every.select("doc_id", "n_chars", "edited_sha256", "fp", whole.alias("edited_fp"), "near_edited", "near_next")


def likeness(a: str, b: str) -> float:
    """The containment of the first fingerprint (as the queries give them) in the second."""
    def read(x: str) -> dict[int, int]:
        return {d: n + 1 for d, n in struct.iter_unpack("<QB", base64.b64decode(x))}

    return containment(read(a), read(b))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every whole text of `documents` and its edited text."""
    found = fingerprinted(table(spark, sf_dir, "documents"))
    line = lambda c: F.translate(F.base64(c), "\r\n", "")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", line("fp").alias("fingerprint"), line("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
