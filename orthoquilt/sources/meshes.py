"""PLY meshes: a Python data source that emits vertices or faces, and a writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KIND = {
    "char": "b", "uchar": "B", "short": "h", "ushort": "H", "int": "i", "uint": "I", "float": "f", "double": "d",
    "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "float32": "f", "float64": "d",
}


def parse_ply(data: bytes, part: str) -> Iterator[tuple]:
    """(id, x, y, z) of the vertices, or (id, v0, v1, v2) of the faces; larger faces become fans."""
    head, _, body = data.partition(b"end_header\n")
    elements: list[tuple[str, int, list[list[str]]]] = []
    form = "ascii"
    for line in head.decode("ascii").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            form = word[1]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            elements[-1][2].append(word[1:])
    order = ">" if "big" in form else "<"
    tokens = iter(body.split()) if form == "ascii" else None
    at = 0

    def value(kind: str):
        nonlocal at
        if tokens is not None:
            text = next(tokens)
            return float(text) if _KIND[kind] in "fd" else int(text)
        (found,) = struct.unpack_from(order + _KIND[kind], body, at)
        at += struct.calcsize(_KIND[kind])
        return found

    faces = 0
    for name, count, properties in elements:
        for k in range(count):
            row = {}
            for p in properties:
                row[p[-1]] = [value(p[2]) for _ in range(value(p[1]))] if p[0] == "list" else value(p[0])
            if name == part == "vertex":
                yield k, float(row["x"]), float(row["y"]), float(row["z"])
            elif name == part == "face":
                corner = next(v for v in row.values() if isinstance(v, list))
                for a, b in zip(corner[1:], corner[2:]):
                    yield faces, corner[0], a, b
                    faces += 1


class PlyReader(DataSourceReader):
    def __init__(self, path: str, part: str):
        self.path, self.part = path, part

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from parse_ply(f.read(), self.part)


class PlySource(DataSource):
    """spark.read.format("ply").option("part", "vertex" or "face").load(local path)"""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "vertex_id long, x double, y double, z double" if self.options.get("part", "vertex") == "vertex" else "face_id long, v0 long, v1 long, v2 long"

    def reader(self, schema) -> DataSourceReader:
        return PlyReader(self.options["path"], self.options.get("part", "vertex"))


def read_ply(spark: SparkSession, path: str, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a mesh file that any of Spark's file systems holds; the shift is added to the vertices."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(part: str, schema: str) -> DataFrame:
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64() if x.endswith("long") else pa.float64() for x in schema.split(", ")]

        def run(batches):
            for batch in batches:
                for data in batch.column(0):
                    block: list[tuple] = []
                    for row in parse_ply(data.as_py(), part):
                        block.append(row)
                        if len(block) == 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names)
                            block = []
                    if block:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names)

        return files.mapInArrow(run, schema)

    vertices = rows("vertex", "vertex_id long, x double, y double, z double")
    moved = vertices.select("vertex_id", *((F.col(k) + float(s)).alias(k) for k, s in zip("xyz", shift, strict=True)))
    return moved, rows("face", "face_id long, v0 long, v1 long, v2 long")


def write_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """An ASCII PLY file on the driver, written row by row. Vertex ids must be dense."""
    n, m = vertices.count(), faces.count()
    with open(path, "w", encoding="ascii") as f:
        f.write(f"ply\nformat ascii 1.0\nelement vertex {n}\nproperty double x\nproperty double y\nproperty double z\n")
        f.write(f"element face {m}\nproperty list uchar int vertex_indices\nend_header\n")
        for r in vertices.orderBy("vertex_id").toLocalIterator():
            f.write(f"{r['x']!r} {r['y']!r} {r['z']!r}\n")
        for r in faces.orderBy("face_id").toLocalIterator():
            f.write(f"3 {r['v0']} {r['v1']} {r['v2']}\n")


def decimated(vertices: DataFrame, faces: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """A coarser mesh: vertices of a grid cell become their mean, faces that lose a corner go. (Vertex clustering, not edge collapse.)"""
    cell = F.xxhash64(*(F.floor(F.col(k) / size) for k in "xyz"))
    keyed = vertices.withColumn("__c", cell)
    merged = keyed.groupBy("__c").agg(F.min("vertex_id").alias("vertex_id"), *(F.avg(k).alias(k) for k in "xyz"))
    to = keyed.select(F.col("vertex_id").alias("was"), "__c").join(merged.select("__c", F.col("vertex_id").alias("now")), "__c").select("was", "now")
    out = faces
    for v in ("v0", "v1", "v2"):
        out = out.join(to.withColumnRenamed("was", v), v).drop(v).withColumnRenamed("now", v)
    kept = out.where("v0 <> v1 and v1 <> v2 and v0 <> v2").select("face_id", "v0", "v1", "v2")
    return merged.drop("__c"), kept


def mesh_hash(vertices: DataFrame, faces: DataFrame) -> str:
    """A digest of the mesh's rows that does not depend on their order."""
    part = lambda df: df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h")).agg(F.sum("h").cast("string"), F.count("*")).first()
    import hashlib

    return hashlib.sha256(repr((tuple(part(vertices)), tuple(part(faces)))).encode()).hexdigest()
