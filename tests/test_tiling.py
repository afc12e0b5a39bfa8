"""Tile grids and tissue classes against plain loops over a small image."""

import pytest

from tesserae.operators import tiling


def _area(spark, rows):
    return spark.createDataFrame(rows, "y long, x long")


def _plain(bounds, mask, h, w, least):
    y0, x0, y1, x1 = bounds
    cells = [(y, x) for y in range(max(y0, 0), min(y1, h)) for x in range(max(x0, 0), min(x1, w))]
    if not cells:
        return "background", False
    share = sum(c in mask for c in cells) / len(cells)
    if share >= least:
        return "tissue", True
    return ("partial_tissue" if share else "background"), False


@pytest.mark.parametrize(("tile", "centered"), [((70, 90), False), ((70, 90), True), ((300, 300), False)])
def test_grid_and_classes(spark, tile, centered):
    h, w = 200, 230
    mask = {(y, x) for y in range(h) for x in range(w) if (y - 90) ** 2 + (x - 120) ** 2 < 80**2}
    size = spark.createDataFrame([(h, w)], "h long, w long")
    dots = _area(spark, sorted(mask))
    tiles = tiling.make_tiles(size, tile, dots if centered else None)
    rows = tiling.classify_tiles(tiles, dots, size, 0.6).collect()
    covered = [(y, x) for r in rows for y in range(r.y0, r.y1) for x in range(r.x0, r.x1)]
    assert len(covered) == len(set(covered))
    if centered:
        assert any((r.y0 + r.y1) / 2 == 90 or (r.x0 + r.x1) / 2 == 120 for r in rows)
    else:
        assert len(covered) == h * w
    for r in rows:
        assert (r.tile_classification, r.suitable) == _plain((r.y0, r.x0, r.y1, r.x1), mask, h, w, 0.6)


def test_spots(spark):
    spots = spark.createDataFrame([(1, 5.0, 10.0), (2, 30.0, 10.0), (3, 5.0, 20.0), (4, 5.0, 30.0), (5, 900.0, 43.0)], "id long, x double, y double")
    assert tiling.row_spacing(spots).first()["spacing"] == 10.0
    mask = {(y, x) for y in range(5, 26) for x in range(0, 8)}
    size = spark.createDataFrame([(50, 50)], "h long, w long")
    tiles = tiling.classify_tiles(tiling.spot_tiles(spots), _area(spark, sorted(mask)), size, 0.7)
    for r in tiles.collect():
        assert (r.tile_classification, r.suitable) == _plain((r.y0, r.x0, r.y1, r.x1), mask, 50, 50, 0.7)
    classes = {r.id: r.tile_classification for r in tiling.spot_classes(spots, tiles.where("id < 5")).collect()}
    assert classes[5] is None
    assert classes[2] == "background"


def test_empty_and_wrong(spark):
    none = _area(spark, [])
    assert tiling.make_tiles(tiling.image_size(none), (8, 8)).count() == 0
    size = spark.createDataFrame([(10, 10)], "h long, w long")
    rows = tiling.classify_tiles(tiling.make_tiles(size, (8, 8), none), none, size).collect()
    assert [r.tile_classification for r in rows] == ["background"] * 4
    with pytest.raises(ValueError):
        tiling.make_tiles(size, (0, 8))
    with pytest.raises(ValueError):
        tiling.spot_tiles(spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"))
