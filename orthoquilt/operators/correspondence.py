"""Which face each pixel of each camera sees: obs(camera_id, i, j, face_id), and what is looked up through it.

Cameras whose views lie near each other form a block; blocks and faces are matched by the ground cells that their boxes share (an equi join; a pair is
kept at the first shared cell only). A task draws the faces of a block, as they stream in, into the depth images of its cameras, row by row of each
triangle. The box of a view is that of its pyramid between the lowest and the highest face, so what a camera meets does not grow with the scene.
Pixels that see nothing have no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoquilt.functions.distortion import ideal
from orthoquilt.operators.cameras import location
from orthoquilt.relations import checkpointed


#: Depth from which on a camera sees.
NEAR = 1e-6
#: Pixels of the depth images that a task holds (those of one camera if it has more), faces and pixels that it draws at once, and sides of a block in cells.
BLOCK_PIXELS, FACES, DRAWN, BLOCK_CELLS = 4_000_000, 20_000, 1_000_000, 2
#: Numbers of a camera: its inverse transform, f, width, height, principal point, box of its view.
CAMERA_NUMBERS = 25


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def bounds_of(faces: DataFrame) -> list[float] | None:
    """Least and greatest x, y and z of the faces' corners; None without faces."""
    row = list(faces.agg(*(f(g(*(F.col(f"{p}.{k}") for p in "abc"))) for k in "xyz" for f, g in ((F.min, F.least), (F.max, F.greatest)))).first())
    return None if None in row else row


def farthest(cameras: DataFrame, bounds: list[float]) -> float:
    """A distance within which every camera has all faces (from two rows of bounds)."""
    at = location(F.col("cam_to_world"))
    of_cameras = cameras.agg(*(f(at[k]) for k in "xyz" for f in (F.min, F.max))).first()
    if of_cameras[0] is None:
        return 1.0
    span = [max(bounds[2 * k + 1], of_cameras[2 * k + 1]) - min(bounds[2 * k], of_cameras[2 * k]) for k in range(3)]
    return max(sum(v * v for v in span) ** 0.5, NEAR)


def inverses(m: np.ndarray) -> np.ndarray:
    """The inverses of affine transforms (n, 16), operation by operation as in linalg.inverse; not finite where there is none."""
    e = lambda i, j: m[:, 4 * (i % 3) + j % 3]
    shift = [m[:, 4 * i + 3] for i in range(3)]
    det = (
        e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))
    )
    out = np.zeros_like(m)
    out[:, 15] = 1
    for i in range(3):
        part = [(e(j + 1, i + 1) * e(j + 2, i + 2) - e(j + 1, i + 2) * e(j + 2, i + 1)) / det for j in range(3)]
        for j in range(3):
            out[:, 4 * i + j] = part[j]
        out[:, 4 * i + 3] = -(part[0] * shift[0] + part[1] * shift[1] + part[2] * shift[2])
    return out


def footprints(m: np.ndarray, lens: np.ndarray, deep: float, bounds: list[float]) -> np.ndarray:
    """The box x0, x1, y0, y1 of what cameras (transforms, and f, w, h, px, py in pixels of the scale) see up to the depth `deep` within the bounds of all faces;
    not a number, or a low end above the high one, where that is nothing."""
    f, w, h, px, py = lens.T
    pad = 1e-6 * (1 + deep)

    def world(x: np.ndarray, y: np.ndarray, z: float) -> np.ndarray:
        return np.stack([m[:, 4 * i] * x + m[:, 4 * i + 1] * y + m[:, 4 * i + 2] * z + m[:, 4 * i + 3] for i in range(3)], 1)

    corner = lambda j, i: world((j - w / 2 - px) * deep / f, (i - h / 2 - py) * deep / f, deep)
    points = [world(0 * f, 0 * f, 0), corner(0, 0), corner(w, 0), corner(w, h), corner(0, h)]
    low, high = bounds[4] - pad, bounds[5] + pad
    box = np.tile([np.inf, -np.inf, np.inf, -np.inf], (len(m), 1))
    for a, b in [(0, k) for k in range(1, 5)] + [(k, k % 4 + 1) for k in range(1, 5)]:
        # the shares of the edge of the pyramid at which it enters and leaves the layer of the faces
        u, v = points[a], points[b]
        dz = v[:, 2] - u[:, 2]
        with np.errstate(all="ignore"):
            s, t = (low - u[:, 2]) / dz, (high - u[:, 2]) / dz
        flat, held = dz == 0, (u[:, 2] >= low) & (u[:, 2] <= high)
        enter = np.where(flat, np.where(held, 0, np.inf), np.maximum(0, np.minimum(s, t)))
        leave = np.where(flat, 1, np.minimum(1, np.maximum(s, t)))
        for share in (enter, leave):
            at = u[:, :2] + (v - u)[:, :2] * np.where(enter <= leave, share, np.nan)[:, None]
            for k in (0, 1):
                box[:, 2 * k] = np.fmin(box[:, 2 * k], at[:, k] - pad)
                box[:, 2 * k + 1] = np.fmax(box[:, 2 * k + 1], at[:, k] + pad)
    return np.stack([f(box[:, k], bounds[k]) for k, f in enumerate((np.maximum, np.minimum) * 2)], 1)


def viewing(batches: Iterator[pa.RecordBatch], deep: float, bounds: list[float], side: float) -> Iterator[pa.RecordBatch]:
    """The cameras that can see a face, with their numbers and the place (bx, by) of their block."""
    for batch in batches:
        n = len(batch)
        m = batch["m"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, 16)
        lens = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("f", "w", "h", "px", "py")], 1)
        with np.errstate(all="ignore"):
            inverse, box = inverses(m), footprints(m, lens, deep, bounds)
            sees = (box[:, 0] <= box[:, 1]) & (box[:, 2] <= box[:, 3]) & np.isfinite(inverse).all(1) & np.isfinite(lens).all(1) & (lens[:, 1] >= 1) & (lens[:, 2] >= 1)
        numbers, box = np.concatenate([inverse, lens, box], 1)[sees], box[sees]
        place = lambda k: pa.array(np.floor((box[:, k] + box[:, k + 1]) / 2 / side).astype(np.int64))  # noqa: E731, B023
        arrays = [batch["camera_id"].filter(pa.array(sees)), pa.FixedSizeListArray.from_arrays(numbers.ravel(), CAMERA_NUMBERS).cast(pa.list_(pa.float64())), place(0), place(2)]
        yield pa.RecordBatch.from_arrays(arrays, names=["camera_id", "numbers", "bx", "by"])


def in_front(p: np.ndarray, ids: np.ndarray, near: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """What is left of triangles (n, 3 corners, x y z in a camera's axes) in front of the plane z = near, with their ids: none, one or two each."""
    front = p[:, :, 2] > near
    n = front.sum(1)
    if (n == 3).all():
        return p, ids

    def cut(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = (near - a[:, 2]) / (b[:, 2] - a[:, 2])
        return a + (b - a) * t[:, None]

    parts, owners = [p[n == 3]], [ids[n == 3]]
    for k in range(3):
        fa, fb, fc = front[:, k], front[:, (k + 1) % 3], front[:, (k + 2) % 3]
        one, two = fa & ~fb & ~fc, ~fa & fb & fc
        a, b, c = (p[one, (k + m) % 3] for m in range(3))
        parts.append(np.stack([a, cut(a, b), cut(a, c)], 1))
        a, b, c = (p[two, (k + m) % 3] for m in range(3))
        parts += [np.stack([b, c, cut(c, a)], 1), np.stack([b, cut(c, a), cut(b, a)], 1)]
        owners += [ids[one], ids[two], ids[two]]
    return np.concatenate(parts), np.concatenate(owners)


class View:
    """A camera's depth image."""

    def __init__(self, camera_id: int | None, numbers: np.ndarray):
        self.camera_id, self.m = camera_id, numbers[:16]
        self.f, self.w, self.h, self.px, self.py = numbers[16:21]
        self.box = numbers[21:25]
        size = int(self.w) * int(self.h)
        self.depth, self.face = np.full(size, np.inf), np.full(size, np.iinfo(np.int64).max)

    def draw(self, ids: np.ndarray, corners: np.ndarray, boxes: np.ndarray, reach: float | None) -> None:
        """Faces (n, 3, 3 in the world; boxes x0, x1, y0, y1) by depth; the lowest id on a tie."""
        x0, x1, y0, y1 = self.box
        met = (boxes[0] <= x1) & (boxes[1] >= x0) & (boxes[2] <= y1) & (boxes[3] >= y0)
        x, y, z = (corners[met, :, k] for k in range(3))
        row = lambda i: self.m[4 * i] * x + self.m[4 * i + 1] * y + self.m[4 * i + 2] * z + self.m[4 * i + 3]
        last = row(3)
        p, ids = np.stack([row(0) / last, row(1) / last, row(2) / last], 2), ids[met]
        if reach is not None:
            within = p[:, :, 2].min(1) <= reach
            p, ids = p[within], ids[within]
        p, ids = in_front(p, ids)
        x, y, z = p[:, :, 0] * self.f / p[:, :, 2] + self.w / 2 + self.px, p[:, :, 1] * self.f / p[:, :, 2] + self.h / 2 + self.py, p[:, :, 2]
        first, last = np.maximum(0, np.ceil(y.min(1) - 0.5)), np.minimum(self.h - 1, np.floor(y.max(1) - 0.5))
        left, right = np.maximum(0, np.ceil(x.min(1) - 0.5)), np.minimum(self.w - 1, np.floor(x.max(1) - 0.5))
        shown = (first <= last) & (left <= right)
        rows = np.where(shown, last - first + 1, 0).astype(np.int64)
        ends = np.cumsum(rows)
        at = 0
        while at < len(rows):  # triangles of at most DRAWN rows, one at least
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DRAWN, "right")))
            if rows[at:to].any():
                own = np.repeat(np.arange(at, to), rows[at:to])
                i = first[own] + (np.arange(len(own)) - np.repeat(ends[at:to] - rows[at:to] - (ends[at - 1] if at else 0), rows[at:to]))
                self.rows(ids, x, y, z, own, i)
            at = to

    def rows(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, own: np.ndarray, i: np.ndarray) -> None:
        """Draw the rows i of the triangles `own`: a row's pixels lie between the sides' crossings of its middle, which is taken with some room."""
        mid = i + 0.5
        low, high = np.full(len(own), np.inf), np.full(len(own), -np.inf)
        tx, ty = x[own], y[own]
        for k in range(3):
            ax, ay, bx, by = tx[:, k], ty[:, k], tx[:, (k + 1) % 3], ty[:, (k + 1) % 3]
            dy = by - ay
            steep = np.abs(dy) > 1e-3
            t = np.clip((mid - ay) / np.where(steep, dy, 1.0), 0, 1)
            met = (np.minimum(ay, by) <= mid + 1e-3) & (np.maximum(ay, by) >= mid - 1e-3)
            cross = ax + (bx - ax) * t
            room = 0.01 + 1e-9 * np.maximum(np.abs(ax), np.abs(bx)) + np.where(steep, np.abs(bx - ax) * (1e-3 / np.where(steep, np.abs(dy), 1.0)) * ((t == 0) | (t == 1)), 0)
            low = np.where(met, np.minimum(low, np.where(steep, cross, np.minimum(ax, bx)) - room), low)
            high = np.where(met, np.maximum(high, np.where(steep, cross, np.maximum(ax, bx)) + room), high)
        left, right = np.maximum(0, np.ceil(low - 0.5)), np.minimum(self.w - 1, np.floor(high - 0.5))
        n = np.where(left <= right, right - left + 1, 0).astype(np.int64)
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DRAWN, "right")))
            m = n[at:to]
            if m.any():
                j = np.repeat(left[at:to], m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
                self.pixels(ids, x, y, z, np.repeat(own[at:to], m), np.repeat(i[at:to], m), j)
            at = to

    def pixels(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Draw the pixels (i, j) of the triangles `own` whose centres these hold."""
        u, v = j + 0.5, i + 0.5

        def side(a: int, b: int) -> np.ndarray:
            dx, dy = x[:, b] - x[:, a], y[:, b] - y[:, a]
            return dx[own] * (v - y[own, a]) - dy[own] * (u - x[own, a])

        wp, wq, wr = side(1, 2), side(2, 0), side(0, 1)
        total = wp + wq + wr
        held = (((wp >= 0) & (wq >= 0) & (wr >= 0)) | ((wp <= 0) & (wq <= 0) & (wr <= 0))) & (total != 0)
        if not held.any():
            return
        own, wp, wq, wr = own[held], wp[held], wq[held], wr[held]
        depth = total[held] / (wp / z[own, 0] + wq / z[own, 1] + wr / z[own, 2])
        # the double itself is rounded, halves up, as SQL does; its shortest decimal form can be a half where the double is under one
        scaled = depth * 1e9
        whole = np.trunc(scaled)
        depth = (whole + (scaled - whole >= 0.5)) / 1e9
        at = (i[held] * self.w + j[held]).astype(np.int64)
        close = depth <= self.depth[at]
        own, depth, at = own[close], depth[close], at[close]
        was = self.depth[at]
        np.minimum.at(self.depth, at, depth)
        now = self.depth[at]
        self.face[at[now < was]] = np.iinfo(np.int64).max
        best = depth == now
        np.minimum.at(self.face, at[best], ids[own[best]])

    def seen(self) -> Iterator[pa.RecordBatch]:
        found = np.flatnonzero(self.depth < np.inf)
        for k in range(0, len(found), DRAWN):
            at = found[k : k + DRAWN]
            camera = pa.repeat(pa.scalar(self.camera_id, pa.int64()), len(at))
            i, j = np.divmod(at, int(self.w))
            yield pa.RecordBatch.from_arrays([camera, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(self.face[at]), pa.array(self.depth[at])], names=["camera_id", "i", "j", "face_id", "depth"])


def drawn(batches: Iterator[pa.RecordBatch], reach: float | None) -> Iterator[pa.RecordBatch]:
    """The pixels that see something, from rows (block, kind, id, numbers) in the order of blocks: in each the cameras (kind 0) come before the faces."""
    block, views, waiting, n = None, [], [], 0

    def draw() -> None:
        nonlocal waiting, n
        if waiting:
            ids, corners = (np.concatenate(parts) for parts in zip(*waiting, strict=True))
            low, high = corners.min(1), corners.max(1)
            for view in views:
                view.draw(ids, corners, (low[:, 0], high[:, 0], low[:, 1], high[:, 1]), reach)
        waiting, n = [], 0

    for batch in batches:
        blocks, kinds = batch["block"].to_numpy(), batch["kind"].to_numpy()
        change = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *change], [*change, len(blocks)], strict=True):
            if a == b:
                continue
            if block is None or blocks[a] != block:
                draw()
                for view in views:
                    yield from view.seen()
                block, views = blocks[a], []
            rows = batch.slice(a, b - a)
            numbers = rows["numbers"].flatten().to_numpy(zero_copy_only=False).astype(float)
            if kinds[a] == 0:
                views += [View(k, v) for k, v in zip(rows["id"].to_pylist(), numbers.reshape(-1, CAMERA_NUMBERS), strict=True)]
            else:
                waiting.append((rows["id"].to_numpy(), numbers.reshape(-1, 3, 3)))
                n += b - a
                if n >= FACES:
                    draw()
    draw()
    for view in views:
        yield from view.seen()


def visible_faces(cameras: DataFrame, faces: DataFrame, scale: float, reach: float | None, cell: float, principal_point: bool = False) -> DataFrame:
    """obs of faces (face_id, a, b, c points in the cameras' world) at an image scale. The pixel centre counts; the nearest face wins,
    the lowest id on a tie. Faces that reach behind a camera are cut at its plane. `reach` is how deep cameras see; None sets no limit."""
    col = F.col
    shift = (lambda c: col(c) * scale) if principal_point else (lambda c: F.lit(0.0))
    narrow = cameras.select(
        "camera_id", "cam_to_world", (col("f") * scale).alias("f"), F.floor(col("image_width") * scale).alias("w"), F.floor(col("image_height") * scale).alias("h"),
        shift("cx").alias("px"), shift("cy").alias("py"),
    )
    bounds = bounds_of(faces)
    if bounds is None:
        return cameras.join(faces.select("face_id"), F.lit(False)).select("camera_id", F.lit(0).alias("i"), F.lit(0).alias("j"), "face_id")
    deep, side = farthest(narrow, bounds) if reach is None else reach, cell * BLOCK_CELLS
    posed = narrow.select(col("camera_id").cast("long").alias("camera_id"), col("cam_to_world").alias("m"), "f", "w", "h", "px", "py").where("size(m) = 16 and not exists(m, v -> v is null)")
    view = checkpointed(posed.mapInArrow(lambda batches: viewing(batches, deep, bounds, side), "camera_id long, numbers array<double>, bx long, by long"))
    at = lambda k: F.get("numbers", F.lit(k))
    pixels = view.groupBy("bx", "by").agg(F.ceil(F.sum(at(17) * at(18)) / BLOCK_PIXELS).alias("parts"))
    deal = F.pmod(F.xxhash64("camera_id"), F.greatest(F.lit(1), col("parts")))
    view = view.join(pixels, ["bx", "by"]).select("camera_id", "numbers", F.xxhash64("bx", "by", deal).alias("block"))
    boxes = checkpointed(view.groupBy("block").agg(*(f(at(n)).alias(k) for k, f, n in (("x0", F.min, 21), ("x1", F.max, 22), ("y0", F.min, 23), ("y1", F.max, 24)))))
    count, (rows, names) = boxes.count(), view.agg(F.count("*"), F.count_distinct("camera_id")).first()
    tri = faces.select("face_id", "a", "b", "c")
    for k in "xy":
        low, high = (g(*(col(f"{p}.{k}") for p in "abc")) for g in (F.least, F.greatest))
        tri = tri.withColumn(f"__f{k}", F.floor(low / cell).cast("long")).withColumn(f"c{k}", F.explode(_cells(low, high, cell)))
        boxes = boxes.withColumn(f"__lo{k}", F.floor(col(f"{k}0") / cell).cast("long")).withColumn(f"c{k}", F.explode(_cells(col(f"{k}0"), col(f"{k}1"), cell)))
    first = (col("cx") == F.greatest("__lox", "__fx")) & (col("cy") == F.greatest("__loy", "__fy"))
    pairs = tri.join(boxes.select("block", "cx", "cy", "__lox", "__loy"), ["cx", "cy"]).where(first)
    rows_of = lambda df, kind, key, numbers: df.select("block", F.lit(kind).alias("kind"), col(key).cast("long").alias("id"), numbers.alias("numbers"))
    both = rows_of(view, 0, "camera_id", col("numbers"))
    both = both.union(rows_of(pairs, 1, "face_id", F.array(*(col(f"{p}.{k}") for p in "abc" for k in "xyz"))))
    dealt = both.repartition(max(1, min(count, 64 + count // 4)), "block").sortWithinPartitions("block", "kind")
    got = dealt.mapInArrow(lambda batches: drawn(batches, reach), "camera_id long, i int, j int, face_id long, depth double")
    if rows > names:  # a camera that is there twice: its images are laid over each other
        got = got.groupBy("camera_id", "i", "j").agg(F.min(F.struct("depth", "face_id"))["face_id"].alias("face_id"))
    kind = lambda df, c: col(c).cast(df.schema[c].dataType).alias(c)
    return got.select(kind(cameras, "camera_id"), "i", "j", kind(faces, "face_id"))


def through_lens(obs: DataFrame, cameras: DataFrame, scale: float) -> DataFrame:
    """obs of the distorted image: each of its pixels takes the face of the ideal pixel it comes from."""
    size = cameras.select("camera_id", "distortion", *(F.col(c).cast("double") for c in ("f", "cx", "cy", "image_width", "image_height")))
    grid = size.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.col("image_height") * scale).cast("int") - 1)))
    grid = grid.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(F.col("image_width") * scale).cast("int") - 1)))
    at = ideal((F.col("j") + 0.5) / scale, (F.col("i") + 0.5) / scale, F.col("distortion"), F.col("f"), F.col("cx"), F.col("cy"), F.col("image_width"), F.col("image_height"))
    aimed = grid.select("camera_id", "i", "j", F.explode(F.array(at)).alias("at"))
    aimed = aimed.select("camera_id", F.col("i").alias("to_i"), F.col("j").alias("to_j"), F.floor(F.col("at.y") * scale).cast("int").alias("i"), F.floor(F.col("at.x") * scale).cast("int").alias("j"))
    # Spark takes the grid for as small as the cameras' table and would broadcast it
    return aimed.hint("merge").join(obs, ["camera_id", "i", "j"]).select("camera_id", F.col("to_i").alias("i"), F.col("to_j").alias("j"), "face_id")


def rendered(obs: DataFrame, face_value: DataFrame) -> DataFrame:
    """obs with the columns of face_value; faces without a value give null."""
    return obs.join(face_value, "face_id", "left")


def projected(obs: DataFrame, pixels: DataFrame, value: str = "class_id") -> DataFrame:
    """camera_id, face_id and value of pixels (camera_id, i, j, value): of several pixels on a face the last in row order counts."""
    # merged: where pixels come of an explode, Spark takes them for as small as what they were made of, and the broadcast would fill the driver
    met = obs.join(pixels.select("camera_id", "i", "j", value).hint("merge"), ["camera_id", "i", "j"])
    return met.groupBy("camera_id", "face_id").agg(F.max(F.struct("i", "j", F.col(value).alias("v")))["v"].alias(value))
