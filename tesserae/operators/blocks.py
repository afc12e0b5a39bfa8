"""Images as rows of array blocks instead of rows of pixels.

A block is a square of an image with all its planes as one array of doubles, so an image of
n pixels is n / size^2 rows.  Work on single blocks is a map; work that looks at
neighbors gathers, for each block, the strips of the blocks around it that lie within a
depth (``map_overlap``): one shuffle of the image and its halos.  No task sees more than a block and its halo.

Arrays are compressed one by one: Spark hands a task many blocks at once, as many as their
shuffled size suggests, and masks and labels shrink by far more than a hundred times on the way.

Planes hold doubles; NaN is a pixel that is not there.  ``stat`` is one number that a step
tells about a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.components import connected_components
from tesserae.session import materialise

SIZE = 256
CODEC = "zstd"
KEYS = ["img", "by", "bx"]
_FRAME = "img string, by long, bx long, ih long, iw long, size int"
SCHEMA = _FRAME + ", planes int, h int, w int, data binary, stat double"
_PART = _FRAME + ", y long, x long, planes int, h int, w int, data binary"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Tile:
    """A block's place in its image, and the place of the block in an array with halo."""

    img: str
    y0: int
    x0: int
    h: int
    w: int
    ih: int
    iw: int
    top: int = 0
    left: int = 0

    def inner(self, a: np.ndarray) -> np.ndarray:
        return a[..., self.top : self.top + self.h, self.left : self.left + self.w]

    def grid(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and column numbers of the block's pixels in the image."""
        return np.arange(self.y0, self.y0 + self.h)[:, None], np.arange(self.x0, self.x0 + self.w)[None, :]


def _tile(row) -> Tile:
    y0, x0 = int(row.by) * int(row.size), int(row.bx) * int(row.size)
    return Tile(row.img, y0, x0, min(int(row.size), int(row.ih) - y0), min(int(row.size), int(row.iw) - x0), int(row.ih), int(row.iw))


def _array(row) -> np.ndarray:
    shape = int(row.planes), int(row.h), int(row.w)
    data = pa.decompress(row.data, 8 * shape[0] * shape[1] * shape[2], CODEC, asbytes=True) if row.data else b""
    return np.frombuffer(data, np.float64).reshape(shape)


def _fields(a: np.ndarray) -> dict:
    a = np.ascontiguousarray(a, np.float64)
    return {"planes": a.shape[0], "h": a.shape[1], "w": a.shape[2], "data": pa.compress(a.tobytes(), CODEC, asbytes=True) if a.size else b""}


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator:
    for batch in batches:
        yield from batch.itertuples(index=False)


def to_blocks(pixels: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of pixel rows ``y, x, c, val``, with ``img`` if there are several images.

    An image reaches from 0 to its last pixel; every one of its blocks is there.  An empty
    table gives no blocks; of rows for one pixel and channel the largest value counts.
    """
    rows = pixels if "img" in pixels.columns else pixels.withColumn("img", F.lit("image"))
    keyed = rows.select("img", F.floor(F.col("y") / size).cast("long").alias("by"), F.floor(F.col("x") / size).cast("long").alias("bx"), "y", "x", "c", F.col("val").cast("double").alias("val"))
    frame = keyed.groupBy("img").agg((F.max("y") + 1).cast("long").alias("ih"), (F.max("x") + 1).cast("long").alias("iw"), (F.max("c") + 1).cast("int").alias("many"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / size).cast("long")))
    grid = frame.withColumn("by", span("ih")).withColumn("bx", span("iw"))

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        y, x, c = (part["y"] % size).astype(int), (part["x"] % size).astype(int), part["c"].astype(int)
        a = np.full((c.max() + 1, y.max() + 1, x.max() + 1), np.nan)
        np.fmax.at(a, (c, y, x), part["val"])
        return pd.DataFrame([{"img": first["img"], "by": first["by"], "bx": first["bx"], **_fields(a)}])

    made = keyed.groupBy(*KEYS).applyInPandas(gather, "img string, by long, bx long, planes int, h int, w int, data binary")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            tile = _tile(row)
            a = np.full((int(row.many), tile.h, tile.w), np.nan)
            if row.data is not None:
                own = _array(row)
                a[: own.shape[0], : own.shape[1], : own.shape[2]] = own
            yield _one(row, tile, a, 0.0)

    return grid.withColumn("size", F.lit(size)).join(made, KEYS, "left").mapInPandas(whole, SCHEMA)


def _one(row, tile: Tile, a: np.ndarray, stat: float) -> pd.DataFrame:
    return pd.DataFrame([{"img": row.img, "by": tile.y0 // int(row.size), "bx": tile.x0 // int(row.size), "ih": tile.ih, "iw": tile.iw, "size": int(row.size), **_fields(a), "stat": stat}])[NAMES]


def to_pixels(blocks: DataFrame, plane: int | None = None, above: float | None = None) -> DataFrame:
    """``img, y, x, c, val`` of one plane or all; only values over ``above`` if it is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            a, tile = _array(row), _tile(row)
            there = ~np.isnan(a) if above is None else a > above
            if plane is not None:
                there[[c for c in range(len(a)) if c != plane]] = False
            c, y, x = np.nonzero(there)
            yield pd.DataFrame({"img": row.img, "y": y + tile.y0, "x": x + tile.x0, "c": c.astype(np.int32), "val": a[there]})

    return blocks.mapInPandas(run, "img string, y long, x long, c int, val double")


def map_blocks(blocks: DataFrame, func: Callable[[np.ndarray, Tile], tuple[np.ndarray, float]]) -> DataFrame:
    """Every block by itself: ``func`` gets planes and place, and returns planes and ``stat``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            tile = _tile(row)
            yield _one(row, tile, *func(_array(row), tile))

    return blocks.mapInPandas(run, SCHEMA)


def _halos(blocks: DataFrame, depth: int) -> DataFrame:
    """The parts of blocks that lie within ``depth`` of each block, keyed by the block they go to."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            a, tile, size = _array(row), _tile(row), int(row.size)
            out = []
            span = lambda at, n, end: range(max((at - depth) // size, 0), min((at + n - 1 + depth) // size, (end - 1) // size) + 1)
            for ty in span(tile.y0, tile.h, tile.ih):
                for tx in span(tile.x0, tile.w, tile.iw):
                    ya, yb = max(ty * size - depth, tile.y0), min((ty + 1) * size + depth, tile.y0 + tile.h)
                    xa, xb = max(tx * size - depth, tile.x0), min((tx + 1) * size + depth, tile.x0 + tile.w)
                    if ya < yb and xa < xb:
                        part = _fields(a[:, ya - tile.y0 : yb - tile.y0, xa - tile.x0 : xb - tile.x0])
                        out.append({"img": row.img, "by": ty, "bx": tx, "ih": tile.ih, "iw": tile.iw, "size": size, "y": ya, "x": xa, **part})
            yield pd.DataFrame(out)

    return blocks.mapInPandas(send, _PART)


def _with_halo(parts: pd.DataFrame, depth: int) -> tuple[np.ndarray, Tile]:
    """The array of a block and its halo, put together from its parts."""
    row = next(parts.itertuples(index=False))
    tile = _tile(row)
    y0, x0 = max(tile.y0 - depth, 0), max(tile.x0 - depth, 0)
    y1, x1 = min(tile.y0 + tile.h + depth, tile.ih), min(tile.x0 + tile.w + depth, tile.iw)
    canvas = np.full((int(row.planes), y1 - y0, x1 - x0), np.nan)
    for part in parts.itertuples(index=False):
        y, x = int(part.y) - y0, int(part.x) - x0
        canvas[:, y : y + int(part.h), x : x + int(part.w)] = _array(part)
    return canvas, Tile(tile.img, tile.y0, tile.x0, tile.h, tile.w, tile.ih, tile.iw, tile.y0 - y0, tile.x0 - x0)


def map_overlap(blocks: DataFrame, depth: int, func: Callable[[np.ndarray, Tile], tuple[np.ndarray, float]], only: DataFrame | None = None) -> DataFrame:
    """Every block with up to ``depth`` pixels around it, as far as the image reaches.

    ``func`` returns the planes of the block itself (``tile.inner``) and its ``stat``.  With
    ``only`` (``img, by, bx``) no other block is made.
    """

    def gather(parts: pd.DataFrame) -> pd.DataFrame:
        canvas, placed = _with_halo(parts, depth)
        return _one(next(parts.itertuples(index=False)), placed, *func(canvas, placed))

    sent = _halos(blocks, depth)
    if only is not None:
        sent = sent.join(only.select(*KEYS).distinct(), KEYS, "left_semi")
    return sent.groupBy(*KEYS).applyInPandas(gather, SCHEMA)


def overlap_rows(blocks: DataFrame, depth: int, func: Callable[[np.ndarray, Tile], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that ``func`` makes of every block with up to ``depth`` pixels around it."""
    return _halos(blocks, depth).groupBy(*KEYS).applyInPandas(lambda parts: func(*_with_halo(parts, depth)), schema)


def _scatter(a: np.ndarray, y0: int, x0: int, img: str, ih: int, iw: int, size: int) -> list[dict]:
    """Parts of an array at a place of an image, one for each block of ``size`` that it reaches into."""
    out = []
    h, w = a.shape[1:]
    for ty in range(y0 // size, (y0 + h - 1) // size + 1):
        for tx in range(x0 // size, (x0 + w - 1) // size + 1):
            ya, yb = max(ty * size, y0), min((ty + 1) * size, y0 + h)
            xa, xb = max(tx * size, x0), min((tx + 1) * size, x0 + w)
            out.append({"img": img, "by": ty, "bx": tx, "ih": ih, "iw": iw, "size": size, "y": ya, "x": xa, **_fields(a[:, ya - y0 : yb - y0, xa - x0 : xb - x0])})
    return out


def _paste(sent: DataFrame) -> DataFrame:
    """Blocks of the parts that reach into them."""

    def gather(parts: pd.DataFrame) -> pd.DataFrame:
        row = next(parts.itertuples(index=False))
        tile = _tile(row)
        canvas = np.full((int(row.planes), tile.h, tile.w), np.nan)
        for part in parts.itertuples(index=False):
            y, x = int(part.y) - tile.y0, int(part.x) - tile.x0
            canvas[:, y : y + int(part.h), x : x + int(part.w)] = _array(part)
        return _one(row, tile, canvas, 0.0)

    return sent.groupBy(*KEYS).applyInPandas(gather, SCHEMA)


def reblock(blocks: DataFrame, size: int) -> DataFrame:
    """The same images in blocks of another size."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            tile = _tile(row)
            yield pd.DataFrame(_scatter(_array(row), tile.y0, tile.x0, row.img, tile.ih, tile.iw, size))

    return _paste(blocks.mapInPandas(send, _PART))


def resize_nearest(blocks: DataFrame, sizes: DataFrame, size: int | None = None) -> DataFrame:
    """Images of the height and width in ``sizes`` (``img, h, w``): each pixel is the nearest of the old image.

    A place is divided by the scale and rounded, halves to even; the last pixels repeat.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def places(start: int, n: int, old: int, new: int) -> np.ndarray:
            low, high = max(int((start - 1) * new / old), 0), min(int((start + n + 1) * new / old) + 1, new)
            if start + n == old:
                high = new
            at = np.arange(low, high)
            source = np.clip(np.round(at / (new / old)).astype(np.int64), 0, old - 1)
            return at[(source >= start) & (source < start + n)], source[(source >= start) & (source < start + n)] - start

        for row in _rows(batches):
            a, tile = _array(row), _tile(row)
            ys, from_y = places(tile.y0, tile.h, tile.ih, int(row.new_h))
            xs, from_x = places(tile.x0, tile.w, tile.iw, int(row.new_w))
            if len(ys) and len(xs):
                yield pd.DataFrame(_scatter(a[:, from_y][:, :, from_x], int(ys[0]), int(xs[0]), row.img, int(row.new_h), int(row.new_w), size or int(row.size)))

    return _paste(blocks.join(sizes.select("img", F.col("h").alias("new_h"), F.col("w").alias("new_w")), "img").mapInPandas(send, _PART))


def count_values(blocks: DataFrame, plane: int = 0) -> DataFrame:
    """``img, by, bx, value, n`` of the numbers over 0 in every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            a = _array(row)[plane]
            value, n = np.unique(a[a > 0].astype(np.int64), return_counts=True)
            yield pd.DataFrame({"img": row.img, "by": row.by, "bx": row.bx, "value": value, "n": n})

    return blocks.mapInPandas(run, "img string, by long, bx long, value long, n long")


def settle(blocks: DataFrame, func: Callable[[np.ndarray, Tile], tuple[np.ndarray, float]], label: str, max_rounds: int = 10_000) -> DataFrame:
    """``map_overlap`` of depth 1 until no block changes any more.

    ``func`` tells by ``stat`` whether the block changed; only neighbors of changed blocks
    work again.  Rounds are as many as the blocks that one influence passes through.
    """
    now = materialise(blocks, label)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for _ in range(max_rounds):
        changed = now.where("stat > 0")
        if changed.isEmpty():
            return now
        around = changed.select("img", "by", "bx", near.alias("s")).select("img", (F.col("by") + F.col("s.i")).alias("by"), (F.col("bx") + F.col("s.j")).alias("bx")).distinct()
        again = map_overlap(now, 1, func, around)
        rest = now.join(around, KEYS, "left_anti").withColumn("stat", F.lit(0.0))
        now = materialise(again.unionByName(rest.select(NAMES)), label)
    raise RuntimeError(f"{label} did not settle")


def local_components(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Component numbers from 1 in order of their first pixels, and how many there are.

    Runs of rows are united with those of the row above that they touch.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded.ravel())
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # in rows of w + 2; a run covers start to stop - 1 of the mask's row
    row = start // (w + 2)
    a, b = start - row * (w + 2), stop - row * (w + 2)
    parent = list(range(len(start)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        i_end, j_end = j, int(first[y + 1])
        while i < i_end and j < j_end:
            if a[i] < b[j] + reach and a[j] < b[i] + reach:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(start))], np.int64)
    kept, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w), np.int64)
    flat = out.ravel()
    length = b - a
    if len(start):
        places = np.repeat(row * w + a - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        flat[places] = np.repeat(number + 1, length)
    return out, len(kept)


def _borders(blocks: DataFrame, plane: int) -> DataFrame:
    """``img, by, bx, y, x, id`` of the pixels along the borders of blocks, with a value over 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            a, tile = _array(row)[plane], _tile(row)
            edge = np.zeros(a.shape, bool)
            edge[[0, -1]] = True
            edge[:, [0, -1]] = True
            y, x = np.nonzero(edge & (a > 0))
            yield pd.DataFrame({"img": row.img, "by": row.by, "bx": row.bx, "y": y + tile.y0, "x": x + tile.x0, "id": a[y, x].astype(np.int64)})

    return blocks.mapInPandas(run, "img string, by long, bx long, y long, x long, id long")


def relabel(blocks: DataFrame, plane: int, names: DataFrame) -> DataFrame:
    """Replaces numbers of a plane by ``names`` (``img, by, bx, old, new``); others stay."""
    lists = names.groupBy(*KEYS).agg(F.collect_list(F.struct("old", "new")).alias("n")).select(*KEYS, F.col("n.old").alias("olds"), F.col("n.new").alias("news"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            tile, a = _tile(row), _array(row)
            if row.olds is not None:
                a = a.copy()
                olds, news = np.array(row.olds, np.float64), np.array(row.news, np.float64)
                order = np.argsort(olds)
                at = np.minimum(np.searchsorted(olds[order], a[plane]), len(olds) - 1)
                hit = olds[order][at] == a[plane]
                a[plane][hit] = news[order][at][hit]
            yield _one(row, tile, a, float(row.stat))

    return blocks.join(lists, KEYS, "left").mapInPandas(run, SCHEMA)


def merge_borders(blocks: DataFrame, plane: int, diagonal: bool = False, same: Column | None = None) -> DataFrame:
    """Gives numbers that touch across borders of blocks the least number among them.

    Only border pixels meet, in an equality join; components are found over numbers, not
    pixels.  ``same`` may ask more of ``a`` and ``b``.
    """
    edge = materialise(_borders(blocks, plane), "borders")
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    asked = edge.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
    asked = asked.select("img", (F.col("y") + F.col("s.i")).alias("y"), (F.col("x") + F.col("s.j")).alias("x"), F.col("id").alias("a"), F.col("by").alias("oy"), F.col("bx").alias("ox"))
    met = asked.join(edge.select("img", "y", "x", "by", "bx", F.col("id").alias("b")), ["img", "y", "x"]).where("(by <> oy or bx <> ox) and a <> b")
    pairs = met if same is None else met.where(same)
    node = lambda c: F.struct("img", F.col(c).alias("id"))
    found = connected_components(pairs.select(node("a").alias("a"), node("b").alias("b")).distinct())
    names = found.select(F.col("node.img").alias("img"), F.col("node.id").alias("old"), F.col("component.id").alias("new")).where("old <> new")
    places = edge.select(*KEYS, F.col("id").alias("old")).distinct()
    return relabel(blocks, plane, places.join(names, ["img", "old"]))


def label_components(blocks: DataFrame, plane: int = 0, diagonal: bool = False) -> DataFrame:
    """Replaces a plane by components of its values over 0: each is named by the number, from 1, of its first pixel."""

    def own(a: np.ndarray, tile: Tile) -> tuple[np.ndarray, float]:
        found, n = local_components(a[plane] > 0, diagonal)
        y, x = tile.grid()
        number = y * tile.iw + x + 1
        names = np.zeros(n + 1)
        inside = found > 0
        names[1:] = np.inf
        np.minimum.at(names, found[inside], number[inside])
        a = a.copy()
        a[plane] = names[found]
        return a, 0.0

    return merge_borders(materialise(map_blocks(blocks, own), "components"), plane, diagonal)
