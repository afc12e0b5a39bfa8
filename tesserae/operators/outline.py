"""Outlines of labels, and how straight they are.

An outline point is the middle of a pixel side between a label and anything else; such
sides are those that only one pixel of the label has, so one grouped count finds them.
Each side runs from corner to corner with the label on its left, which orders them; where
two pixels of a label meet at a corner only, the outline stays with its pixel.  An outline
is traced within one task: it has some square root of the label's pixels.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends of a pixel's sides from their middle, in half pixels: (start y, start x) and (end y, end x).
_SIDES = {(0, 1): ((1, 0), (-1, 0)), (-1, 0): ((0, 1), (0, -1)), (0, -1): ((-1, 0), (1, 0)), (1, 0): ((0, -1), (0, 1))}


def outline_sides(labels: DataFrame) -> DataFrame:
    """``label, my, mx, sy, sx, ey, ex``: outline points and the corners before and after, in half pixels."""
    sides = F.array(*[F.struct(F.lit(my).alias("y"), F.lit(mx).alias("x"), F.lit(sy).alias("sy"), F.lit(sx).alias("sx"), F.lit(ey).alias("ey"), F.lit(ex).alias("ex")) for (my, mx), ((sy, sx), (ey, ex)) in _SIDES.items()])
    own = labels.where("label <> 0").select("label", "y", "x", F.explode(sides).alias("s"))
    y, x = 2 * F.col("y") + F.col("s.y"), 2 * F.col("x") + F.col("s.x")
    found = own.groupBy("label", y.alias("my"), x.alias("mx")).agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s"))
    at = lambda c, d: (F.col(c) + F.col(f"s.{d}")).alias(d)
    return found.where("n = 1").select("label", "my", "mx", at("my", "sy"), at("mx", "sx"), at("my", "ey"), at("mx", "ex"))


def trace(sides: np.ndarray) -> list[np.ndarray]:
    """Closed outlines ``(n, 2)`` from rows ``my, mx, sy, sx, ey, ex``; each starts at its least point."""
    order = np.lexsort((sides[:, 1], sides[:, 0]))
    sides = sides[order]
    leaving: dict[tuple[int, int], list[int]] = {}
    for i, (sy, sx) in enumerate(sides[:, 2:4].tolist()):
        leaving.setdefault((sy, sx), []).append(i)
    rows = sides.tolist()
    # The label's pixel lies left of the way: the same pixel again means the same middle from the next side.
    pixel = [(my + (ex - sx) // -2, mx + (ey - sy) // 2) for my, mx, sy, sx, ey, ex in rows]
    done = [False] * len(rows)
    out = []
    for first in range(len(rows)):
        if done[first]:
            continue
        path, i = [], first
        while not done[i]:
            done[i] = True
            path.append(i)
            ways = leaving[rows[i][4], rows[i][5]]
            i = next((k for k in ways if pixel[k] == pixel[i]), ways[0])
        out.append(sides[path, :2] / 2)
    return out


def resampled(points: np.ndarray, most: int) -> np.ndarray:
    """A closed outline of at most ``most`` points, equally far apart along it."""
    if len(points) + 1 <= most:
        return points
    closed = np.concatenate([points, points[:1]])
    along = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(closed, axis=0).T))])
    want = np.linspace(0.0, along[-1], most)[:-1]
    return np.stack([np.interp(want, along, closed[:, k]) for k in (0, 1)], axis=1)


def alignment(angle: np.ndarray) -> np.ndarray:
    """1 along an axis, 0 halfway between two."""
    a = np.abs(angle) % math.pi
    return 1 - np.minimum(a, np.minimum(np.abs(a - math.pi / 2), np.abs(a - math.pi))) / (math.pi / 4)


def longest_straight(points: np.ndarray, tolerance: float) -> tuple[float, float]:
    """Length and alignment of the longest chord whose points between all lie within ``tolerance`` of it.

    From every start the end moves on along the closed outline until a chord fails; all
    starts move together.  Of equal chords the best aligned counts.
    """
    n = len(points)
    best = (0.0, 0.0)
    if n < 3:
        return best
    starts = np.arange(n)
    for gap in range(2, n):
        p, q = points[starts], points[(starts + gap) % n]
        d = q - p
        length = np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2)
        between = points[(starts[:, None] + np.arange(1, gap)[None, :]) % n] - p[:, None, :]
        off = np.abs(d[:, :1] * between[:, :, 1] - d[:, 1:] * between[:, :, 0]).max(axis=1)
        point = length < 1e-12
        with np.errstate(divide="ignore", invalid="ignore"):
            fits = point | (off / length <= tolerance)
        real = fits & ~point
        if real.any():
            longest = length[real].max()
            if longest >= best[0]:
                among = alignment(np.arctan2(d[real, 0], d[real, 1])[length[real] == longest]).max()
                best = max(best, (float(longest), float(among)))
        starts = starts[fits]
        if not len(starts):
            break
    return best


def cut_scores(labels: DataFrame, tolerance: float = 0.75, min_area: int = 20, max_points: int = 500) -> DataFrame:
    """``label, area, y, x, max_straight_edge_ratio, cardinal_alignment_score, cut_score``.

    The longest straight piece of the longest outline in units of the diameter of a disc of the same area, how
    well it follows an axis, and their product.  Labels of fewer than ``min_area`` pixels have nulls.
    """
    if tolerance < 0 or min_area < 1 or max_points < 3:
        raise ValueError("tolerance must be 0 or more, min_area 1 or more, max_points 3 or more")
    own = labels.where("label <> 0")
    area = own.groupBy("label").agg(F.count(F.lit(1)).alias("area"), F.avg(F.col("y").cast("double")).alias("y"), F.avg(F.col("x").cast("double")).alias("x"))

    def score(part: pd.DataFrame) -> pd.DataFrame:
        outlines = trace(part[["my", "mx", "sy", "sx", "ey", "ex"]].to_numpy(np.int64))
        longest = max(outlines, key=len)
        length, aligned = longest_straight(resampled(longest, max_points), tolerance)
        return pd.DataFrame({"label": [part["label"].iloc[0]], "straight": [length], "aligned": [aligned]})

    kind = labels.schema["label"].dataType.simpleString()
    straight = outline_sides(own).groupBy("label").applyInPandas(score, f"label {kind}, straight double, aligned double")
    ratio = F.col("straight") / F.sqrt(4 * F.col("area") / math.pi)
    enough = lambda c: F.when(F.col("area") >= min_area, c)
    return area.join(straight, "label").select(
        "label",
        "area",
        "y",
        "x",
        enough(ratio).alias("max_straight_edge_ratio"),
        enough(F.col("aligned")).alias("cardinal_alignment_score"),
        enough(ratio * F.col("aligned")).alias("cut_score"),
    )


#: Lengths of an outline at a border pixel, by 1 + 2 x (border pixels beside it) + 10 x (border pixels at its corners).
BORDER_LENGTHS = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: 2**0.5, 33: 2**0.5, 13: (1 + 2**0.5) / 2, 23: (1 + 2**0.5) / 2}
_R = math.pi / 4 / 2**0.5
#: Crofton's lengths in four directions for the sixteen 2 x 2 windows, by code.
CROFTON = (0.0, math.pi / 4 + _R, _R, 2 * _R, 0.0, math.pi / 4 + _R, 0.0, _R, math.pi / 4, math.pi / 2, _R, _R, math.pi / 4, math.pi / 2, 0.0, 0.0)
#: Bits of a 2 x 2 window's code: the pixel, the one above, the one to the left, the one above that.
_WINDOW = ((0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8))


def _euler(code: int) -> int:
    """Four times what a window adds to the Euler number of an image whose pixels touch at corners too."""
    n = bin(code).count("1")
    return {1: 1, 3: -1}.get(n, -2 if code in (6, 9) else 0)


def perimeters(labels: DataFrame) -> DataFrame:
    """``label, perimeter, perimeter_crofton, euler_number``; the Euler number is parts less holes.

    Pixels add themselves to the places that look at them, so grouped sums do it all and no label is held as a whole.
    """
    own = labels.where("label <> 0").select("label", "y", "x")
    # Border pixels have a side of the outline; they tell their neighbors, and themselves.
    y, x = (F.col("my") - (F.col("ex") - F.col("sx")) / 2) / 2, (F.col("mx") + (F.col("ey") - F.col("sy")) / 2) / 2
    border = outline_sides(own).select("label", y.cast("long").alias("y"), x.cast("long").alias("x")).distinct()
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1 if not (i or j) else 2 if not (i and j) else 10).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    seen = border.withColumn("s", F.explode(around)).groupBy("label", (F.col("y") + F.col("s.i")).alias("y"), (F.col("x") + F.col("s.j")).alias("x")).agg(F.sum("s.w").alias("code"), F.max((F.col("s.w") == 1).cast("int")).alias("own"))
    table = F.create_map(*[F.lit(v) for pair in BORDER_LENGTHS.items() for v in pair])
    length = seen.where("own = 1").groupBy("label").agg(F.sum(F.coalesce(F.element_at(table, F.col("code").cast("int")), F.lit(0.0))).alias("perimeter"))
    windows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(b).alias("b")) for i, j, b in _WINDOW])
    codes = own.withColumn("s", F.explode(windows)).groupBy("label", (F.col("y") + F.col("s.i")).alias("y"), (F.col("x") + F.col("s.j")).alias("x")).agg(F.sum("s.b").cast("int").alias("code"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("code") + 1)
    shape = codes.groupBy("label").agg(F.sum(pick(CROFTON)).alias("perimeter_crofton"), (F.sum(pick([_euler(c) for c in range(16)])) / 4).cast("long").alias("euler_number"))
    return length.join(shape, "label").select("label", "perimeter", "perimeter_crofton", "euler_number")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in order, from the least point."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(some) -> list:
        out: list = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    rows = points.tolist()
    return np.array(chain(rows) + chain(rows[::-1]))


def hull_rows(corners: np.ndarray) -> np.ndarray:
    """Rows ``y, first x, last x`` of the pixels whose middles lie in a hull, its edge included."""
    out = []
    following = np.roll(corners, -1, axis=0)
    for y in range(math.ceil(corners[:, 0].min() - 1e-9), math.floor(corners[:, 0].max() + 1e-9) + 1):
        xs = []
        for (ya, xa), (yb, xb) in zip(corners.tolist(), following.tolist(), strict=True):
            if min(ya, yb) <= y <= max(ya, yb):
                xs += [xa, xb] if ya == yb else [xa + (y - ya) * (xb - xa) / (yb - ya)]
        low, high = math.ceil(min(xs) - 1e-9), math.floor(max(xs) + 1e-9)
        if low <= high:
            out.append((y, low, high))
    return np.array(out)


def widest(points: np.ndarray) -> float:
    """The largest distance of two points: of opposite corners of their hull, as calipers turn around it."""
    c = hull(points)
    n = len(c)
    if n < 3:
        return float(np.hypot(*(c[0] - c[-1])))
    best, j = 0.0, 1
    turn = lambda i, k: abs((c[(i + 1) % n][0] - c[i][0]) * (c[k][1] - c[i][1]) - (c[(i + 1) % n][1] - c[i][1]) * (c[k][0] - c[i][0]))
    for i in range(n):
        while turn(i, (j + 1) % n) > turn(i, j):
            j = (j + 1) % n
        for p in (i, (i + 1) % n):
            for q in (j, (j + 1) % n):
                best = max(best, float(np.hypot(*(c[p] - c[q]))))
    return best


def hulls(labels: DataFrame) -> DataFrame:
    """``label, area, area_convex, solidity, feret_diameter_max``.

    The hull is that of the outline points; its pixels are counted row by row, and the
    diameter is the largest distance of outline points of these pixels.
    """
    own = labels.where("label <> 0")

    def measure(part: pd.DataFrame) -> pd.DataFrame:
        rows = hull_rows(hull(part[["my", "mx"]].to_numpy(np.float64) / 2))
        y, low, high = rows.T.astype(float)
        ends = np.concatenate([np.stack([y, low - 0.5], 1), np.stack([y, high + 0.5], 1), np.stack([y - 0.5, low], 1), np.stack([y - 0.5, high], 1), np.stack([y + 0.5, low], 1), np.stack([y + 0.5, high], 1)])
        covered = {int(r[0]): (r[1], r[2]) for r in rows}
        # A point above or below a pixel is on the outline where the next row doesn't cover it.
        free = [p for p in ends.tolist() if p[0] == int(p[0]) or any(not (covered.get(int(p[0] + d), (1, 0))[0] <= p[1] <= covered.get(int(p[0] + d), (1, 0))[1]) for d in (0.5, -0.5))]
        return pd.DataFrame({"label": [part["label"].iloc[0]], "area_convex": [int((high - low + 1).sum())], "feret_diameter_max": [widest(np.array(free))]})

    kind = labels.schema["label"].dataType.simpleString()
    made = outline_sides(own).groupBy("label").applyInPandas(measure, f"label {kind}, area_convex long, feret_diameter_max double")
    area = own.groupBy("label").agg(F.count(F.lit(1)).alias("area"))
    return area.join(made, "label").select("label", "area", "area_convex", (F.col("area") / F.col("area_convex")).alias("solidity"), "feret_diameter_max")
