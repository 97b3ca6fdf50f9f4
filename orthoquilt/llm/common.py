"""What the operators share: table reads, shared-folder tables, Arrow batch limits."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: the ASCII blanks only.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary package keeps a file (a parameter everywhere it is used)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once; a plain column would be put into each use, lambdas included."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Bound what one Arrow batch may hold, so long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. In local mode, where all share one disk, a temporary one will do; a cluster must name one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orthoquilt-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def _hadoop_path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """path, whose files go when the driver's JVM ends."""
    where, files = _hadoop_path(spark, path)
    files.deleteOnExit(where)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where, files = _hadoop_path(spark, path)
    files.delete(where, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(gone_at_exit(spark, path))


def bounded_or_shuffled(df: DataFrame, rows: int = 50_000, megabytes: int = 16) -> DataFrame:
    """Store df (scalars and lists of strings), and mark it for broadcast only if it has at most `rows` rows and its
    strings at most `megabytes`; a larger one is left to a shuffled join."""
    kept = stored(df, "side")
    held_by = {"string": F.octet_length, "binary": F.octet_length, "array<string>": lambda c: F.octet_length(F.array_join(c, "")) + 8 * F.size(c)}
    strings = sum((F.coalesce(held_by[kind](F.col(c)), F.lit(0)) for c, kind in kept.dtypes if kind in held_by), F.lit(0))
    n, held = kept.agg(F.count("*"), F.coalesce(F.sum(strings.cast("long")), F.lit(0))).first()  # one row
    return F.broadcast(kept) if n <= rows and held <= megabytes << 20 else kept


def in_fold(doc_id: int | None, of: int, held: int) -> bool:
    """True if crc32 of the id's decimal text leaves `held` when divided by `of`; None is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of == held


def fold(column, of: int):
    """The same remainder as a Column (null id: null)."""
    return F.pmod(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(of))


def give_back() -> None:
    """Hand what this process has freed back to the system; Arrow's pool and the C heap would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def one_thread() -> None:
    """Keep libraries from starting threads inside a Python worker."""
    for name in ("RAYON_NUM_THREADS", "OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
