"""GeoTIFF files as cell(path, band, row, col, value) and back.

Files are decoded block after block (strips or tiles), a batch of rows each, so a worker holds one file's bytes and one block.
Plain, deflate, LZW and PackBits data are read, with or without horizontal differences; deflate is written. Big files should be tiled beforehand:
a file is one task, and Spark's binary reader takes files of up to 2 GB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "path string, band int, row long, col long, value double"
INFO = "path string, height long, width long, bands int, transform array<double>, epsg int, nodata double"
#: Field types of the format: size and struct letter.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
#: Tags of the format.
WIDTH, HEIGHT, BITS, PACKING, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113


def tags_of(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first image's tags."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
    (n,) = struct.unpack_from(order + ("Q" if big else "H"), data, at)
    at += 8 if big else 2
    found = {}
    for k in range(n):
        p = at + (20 if big else 12) * k
        tag, kind = struct.unpack_from(order + "HH", data, p)
        (count,) = struct.unpack_from(order + ("Q" if big else "I"), data, p + 4)
        size, letter = _TYPES.get(kind, (1, "B"))
        room, where = (8, p + 12) if big else (4, p + 8)
        if size * count > room:
            (where,) = struct.unpack_from(order + ("Q" if big else "I"), data, where)
        if letter == "s":
            found[tag] = (data[where : where + count].split(b"\0")[0].decode("latin1"),)
        else:
            found[tag] = struct.unpack_from(order + letter * count, data, where)
    return order, found


def unlzw(data: bytes) -> bytes:
    """Data packed by LZW with codes of 9 to 12 bits, highest bit first."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None:
                table.append(last + entry[:1])
            last = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


UNPACK = {1: bytes, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpackbits}


def info_of(data: bytes) -> tuple:
    """height, width, bands, transform (a, b, c, d, e, f of x = a col + b row + c, y = d col + e row + f), EPSG code and nodata."""
    _, t = tags_of(data)
    transform = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    if TRANSFORM in t:
        m = t[TRANSFORM]
        transform = [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif PIXEL_SCALE in t and TIE_POINT in t:
        (sx, sy, _), (i, j, _, x, y, _) = t[PIXEL_SCALE], t[TIE_POINT][:6]
        transform = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
    keys = t.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    epsg = codes.get(3072) or codes.get(2048)
    nodata = float(t[NODATA][0]) if NODATA in t and t[NODATA][0].strip() else None
    return t[HEIGHT][0], t[WIDTH][0], t.get(SAMPLES, (1,))[0], [float(v) for v in transform], epsg, nodata


def blocks_of(data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first band, first row, first column, array of rows, columns, bands) of each strip or tile, cut to the image."""
    order, t = tags_of(data)
    height, width, samples = t[HEIGHT][0], t[WIDTH][0], t.get(SAMPLES, (1,))[0]
    bits, form = t.get(BITS, (1,))[0], t.get(FORMAT, (1,))[0]
    if bits % 8:
        raise ValueError("samples of whole bytes are read")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
    unpack = UNPACK.get(t.get(PACKING, (1,))[0])
    if unpack is None:
        raise ValueError(f"compression {t[PACKING][0]} is not read")
    planar = t.get(PLANAR, (1,))[0] == 2
    per = 1 if planar else samples
    if TILES in t:
        bw, bh, starts, sizes = t[TILE_WIDTH][0], t[TILE_HEIGHT][0], t[TILES], t[TILE_BYTES]
    else:
        bw, bh, starts, sizes = width, min(t.get(ROWS, (height,))[0], height), t[STRIPS], t[STRIP_BYTES]
    across, down = -(-width // bw), -(-height // bh)
    for k, (at, n) in enumerate(zip(starts, sizes, strict=True)):
        plane, rest = divmod(k, across * down)
        r, c = divmod(rest, across)
        rows = bh if TILES in t else min(bh, height - r * bh)
        a = np.frombuffer(unpack(data[at : at + n]), kind, rows * bw * per).reshape(rows, bw, per)
        if t.get(PREDICTOR, (1,))[0] == 2:
            a = np.cumsum(a, axis=1, dtype=kind)
        yield plane, r * bh, c * bw, a[: height - r * bh, : width - c * bw]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def files_in(spark: SparkSession, folder: str, suffix: str = ".tif") -> DataFrame:
    """path and content of the files of a folder. Unlike Spark's own reader it takes names with colons, as those of tiles; the names are listed on the
    driver, and each file is read where its row is."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in where.get_file_info(fs.FileSelector(base)) if f.is_file and f.path.endswith(suffix))
    many = min(max(1, len(names)), 10 * spark.sparkContext.defaultParallelism)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(name) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read()], pa.binary())], ["path", "content"])

    return spark.createDataFrame([(n,) for n in names], "path string").repartition(many, "path").mapInArrow(load, "path string, content binary")


def raster_info(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: size, bands, transform, EPSG code and nodata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.float64())
        for batch in batches:
            rows = [info_of(data.as_py()) for data in batch.column(1)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [x.split()[0] for x in INFO.split(", ")])

    return _files(spark, path).mapInArrow(run, INFO)


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """path, band (from 0), row, col and value of every cell of one file or a folder of them."""
    return decoded(_files(spark, path))


def decoded(files: DataFrame) -> DataFrame:
    """The cells of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for band, row, col, block in blocks_of(data.as_py()):
                    for top in range(0, block.shape[0], 256):
                        part = block[top : top + 256]
                        i, j, b = (x.ravel() for x in np.indices(part.shape))
                        v = part.ravel().astype(float)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(v), pa.string()), pa.array((b + band).astype(np.int32)), pa.array(i + row + top), pa.array(j + col), pa.array(v)],
                            [x.split()[0] for x in CELL.split(", ")],
                        )

    return files.select("path", "content").mapInArrow(run, CELL)


def geotiff_bytes(a: np.ndarray, transform: list[float], epsg: int | None = None, nodata: float | None = None) -> bytes:
    """A deflated GeoTIFF of an array of rows, columns, bands."""
    height, width, bands = a.shape
    a = np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<"))
    rows = max(1, (1 << 20) // max(1, width * bands * a.itemsize))
    strips = [zlib.compress(a[k : k + rows].tobytes()) for k in range(0, height, rows)]
    form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    sx, b, c, d, e, f = transform
    tags: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (a.itemsize * 8,) * bands), (PACKING, 3, (8,)), (PHOTOMETRIC, 3, (1,)),
        (STRIPS, 4, tuple(0 for _ in strips)), (SAMPLES, 3, (bands,)), (ROWS, 4, (rows,)), (STRIP_BYTES, 4, tuple(map(len, strips))),
        (PLANAR, 3, (1,)), (FORMAT, 3, (form,) * bands), (TRANSFORM, 12, (sx, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)),
    ]
    if epsg:
        geographic = epsg in (4326, 4979)
        tags.append((GEO_KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, epsg)))
    if nodata is not None:
        tags.append((NODATA, 2, f"{nodata:g}\0".encode()))
    at = 8 + 2 + 12 * len(tags) + 4
    tail, places = bytearray(), {}
    for tag, kind, values in tags:
        size = _TYPES[kind][0] * len(values)
        if size > 4:
            places[tag] = at + len(tail)
            tail += bytes(size + size % 2)
    first = at + len(tail)
    starts = tuple(first + sum(map(len, strips[:k])) for k in range(len(strips)))
    head = bytearray(b"II*\0" + struct.pack("<IH", 8, len(tags)))
    for tag, kind, values in tags:
        values = starts if tag == STRIPS else values
        raw = values if isinstance(values, bytes) else struct.pack("<" + _TYPES[kind][1] * len(values), *values)
        head += struct.pack("<HHI", tag, kind, len(values))
        if tag in places:
            head += struct.pack("<I", places[tag])
            tail[places[tag] - at : places[tag] - at + len(raw)] = raw
        else:
            head += raw.ljust(4, b"\0")
    return bytes(head + b"\0\0\0\0" + tail + b"".join(strips))


def encoded(tiles: DataFrame, transform: tuple[float, ...], kind: str = "uint8", nodata: float = 0.0, epsg: int | None = None) -> DataFrame:
    """name and content (GeoTIFF) of each tile of tiles(name, col_off, row_off, width, height, i, j, value): cells that are not there hold
    nodata, so tiles at a raster's edge are padded to their full size. A task holds one tile."""

    def one(table: pa.Table) -> pa.Table:
        first = {c: table[c][0].as_py() for c in ("name", "col_off", "row_off", "width", "height")}
        a = np.full((first["height"], first["width"], 1), nodata, kind)
        v = table["value"].to_numpy(zero_copy_only=False).astype(float)
        ok = np.isfinite(v)
        a[table["i"].to_numpy()[ok], table["j"].to_numpy()[ok], 0] = v[ok]
        sx, b, c, d, e, f = transform
        x, y = first["col_off"], first["row_off"]
        moved = [sx, b, sx * x + b * y + c, d, e, d * x + e * y + f]
        return pa.table({"name": [first["name"]], "content": pa.array([geotiff_bytes(a, moved, epsg, nodata)], pa.binary())})

    columns = ("name", "col_off", "row_off", "width", "height", "i", "j", "value")
    return tiles.select(*columns).groupBy("name").applyInArrow(one, "name string, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Write files (name, content) into a folder that all executors reach, each where its row is. A repeated task writes the same files again."""

    def save(rows: Iterator) -> None:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        for row in rows:
            with where.open_output_stream(f"{base}/{row['name']}") as out:
                out.write(bytes(row["content"]))

    files.select("name", "content").foreachPartition(save)
