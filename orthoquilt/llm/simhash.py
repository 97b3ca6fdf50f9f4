"""SimHash near-duplicates (operator 2) by covering locality-sensitive hashing.

A text's 64-bit fingerprint has a bit set where over half of its shingle hashes have it. For a radius of
2 every bit position gets one of the seven nonzero vectors of GF(2)^3, and table v (again one of
the seven) keeps the positions whose vector is not orthogonal to v. Two differing positions span
at most two dimensions, so some v is orthogonal to both: every pair within the radius
agrees in a table, with no chance involved.

Only distinct fingerprints enter the tables. A bucket of at most `BUCKET` of them is compared pair
by pair. The members of a larger one send themselves to each fingerprint at distance one or less within the
bucket's free bits: two members are within the radius exactly if they meet at such a midpoint, all that
meet there are linked, and at most 28 can meet. So no group, however large, is paired.

Null and blank texts have fingerprint zero and are linked like any other; very long texts are taken
whole, in blocks; equal texts are one node; rows with null ids get the component of their fingerprint, and
an id only if another row has one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.llm.common import bounded_or_shuffled, small_batches, stored, table
from orthoquilt.llm.components import components

RADIUS = 2
#: Fingerprints in a bucket that are compared pair by pair.
BUCKET = 32
#: Rows from which a fingerprint is looked up in a broadcast table.
HOT = 100_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3, block: int = 200_000) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    # bytes.split() splits at exactly the six ASCII blanks
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    whole = b" ".join(words)
    at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    begins = at[:n].tolist()
    ends = (at[min(shingle, len(words)) :][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, block):
        h = np.array([digest(whole[a:b], 42) for a, b in zip(begins[k : k + block], ends[k : k + block], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of df's doc_id and text, and `more` long columns as they are."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], ["doc_id", "fp", *more])

    return df.select("doc_id", "text", *more).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask for each nonzero v of GF(2)^(radius + 1): the bits whose vector is not orthogonal to v."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` exactly as all pairs within the radius would."""
    masks = covering_masks()
    rows = fps.select(
        "fp",
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks))).alias("t", "key"),
    )
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(rows.join(sizes, ["t", "key"]), "buckets")
    lists = shared.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= RADIUS
    small = (
        lists.select("m", F.explode("m").alias("a"))
        .select("a", F.explode(F.filter("m", lambda y: (y > F.col("a")) & near(F.col("a"), y))).alias("b"))
    )

    def midpoints(fp: Column, t: int) -> Column:
        free = [1 << i for i in range(64) if not masks[t] >> i & 1]
        return F.array(fp, *(fp.bitwiseXOR(F.lit(signed(x))) for x in free))

    pick = F.when(F.col("t") == 0, midpoints(F.col("fp"), 0))
    for t in range(1, len(masks)):
        pick = pick.when(F.col("t") == t, midpoints(F.col("fp"), t))
    # at most 28 fingerprints meet at a midpoint of one table
    met = shared.where(F.col("n") > bucket).select("fp", F.explode(pick).alias("mid"))
    stars = (
        met.groupBy("mid").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1)
        .select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    )
    return small.union(stars)


def classes(prints: DataFrame) -> DataFrame:
    """fp, root and component_id (the smallest doc_id of its component; null if none of its rows has an id) of the distinct
    fingerprints of prints, and n, how many rows have the fingerprint."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = components(linked(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    # a fingerprint without links is the root of itself
    of_group = rooted.join(least, "root").select("fp", "root", "least")
    label = nodes.join(of_group, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"), "n")
    return stored(label, "classes")


def labelled(prints: DataFrame, label: DataFrame) -> DataFrame:
    """prints with the other columns of `classes`. A fingerprint of over `HOT` rows is looked up in a broadcast table (there are
    at most rows / HOT of them, and its size is checked), so none of these gathers in a task; the others are joined by shuffling."""
    names = [*prints.columns, "root", "component_id"]
    hot = bounded_or_shuffled(label.where(F.col("n") > HOT).drop("n"))
    cold = prints.join(hot.select("fp"), "fp", "left_anti").join(label.where(F.col("n") <= HOT).drop("n"), "fp")
    return prints.join(hot, "fp").select(names).union(cold.select(names))


def near_duplicates(prints: DataFrame) -> DataFrame:
    """doc_id, fp, and component_id: the smallest doc_id that links of at most 2 differing bits reach."""
    prints = stored(prints, "prints")
    return labelled(prints, classes(prints)).select("doc_id", "fp", "component_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each group, all columns as they were. The row of the smallest id stays (rows without an
    id come last; of several texts of one id that of the least hash). Rows are told apart by id and text, so a row goes only if its own
    text is in a group; of rows that repeat both, one stays."""
    own, used = docs.columns, set(docs.columns)
    doc, mark = (next(f"{x}{k}" for k in range(len(used) + 1) if f"{x}{k}" not in used) for x in ("__doc", "__mark"))
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select("doc_id", "text", F.xxhash64(text).alias("h"))
    prints = stored(fingerprints(hashed, more=("h",)), "prints")
    rows = stored(labelled(prints, classes(prints)).groupBy("root", "doc_id", "h").agg(F.count("*").alias("n")), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    # partial aggregates: a root with a third of all rows is no more work than another
    best = bounded_or_shuffled(rows.groupBy("root").agg(F.min(key).alias("k"), F.count("*").alias("m")).where("m > 1").select("root", F.col("k.doc_id").alias("d0"), F.col("k.h").alias("h0")))
    gone = rows.join(best, "root").where(~(F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("h") == F.col("h0"))))
    gone = bounded_or_shuffled(gone.select(F.col("doc_id").alias(doc), F.col("h").alias(mark)))
    # ids and hashes have been shuffled so far; texts move only if very many rows go
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(mark)), "left_anti")
    again = bounded_or_shuffled(rows.where("n > 1").select(F.col("doc_id").alias(doc), F.col("h").alias(mark)))
    if not again.take(1):
        return kept.select(own)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(mark))
    repeated = kept.join(again, same).dropDuplicates([doc, mark])
    return kept.join(again, same, "left_anti").select(own).union(repeated.select(own))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all `documents`."""
    found = near_duplicates(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
