"""Windows, patterns, images and stains on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import stats
from tesserae.operators import images, patterns, qc, stain, tables
from tesserae.operators.components import connected_components
from tesserae.sources import readers


def test_window_grid(spark):
    points = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 200.0, 200.0)], "lib int, id long, x double, y double")
    assert tables.window_corners(points, 100).count() == 4
    rows = tables.window_corners(points, 100, 20).orderBy("window_id").collect()
    assert len(rows) == 9
    assert (rows[0]["x0"], rows[0]["x1"], rows[-1]["x0"], rows[-1]["x1"]) == (0, 100, 160, 200)
    kept = tables.window_corners(points, 100, 20, drop_partial=True).orderBy("window_id").collect()
    assert (len(kept), kept[-1]["x0"], kept[-1]["x1"]) == (4, 80, 180)


def test_distances_reach_one(spark):
    points = spark.createDataFrame([(0, i, float(i), 0.0, "a" if i == 0 else "b") for i in range(5)], "lib int, id long, x double, y double, cl string")
    got = {r["id"]: (r["dist_raw"], r["dist_norm"]) for r in tables.var_by_distance(points, ["a"]).collect()}
    assert got == {0: (0.0, None), 1: (1.0, 0.0), 2: (2.0, 0.5), 3: (3.0, 0.75), 4: (4.0, 1.0)}


def test_hull_of_a_lattice(spark):
    points = spark.range(25).select(F.lit(0).alias("lib"), "id", (F.col("id") % 5).cast("double").alias("x"), F.floor(F.col("id") / 5).cast("double").alias("y"))
    row = patterns.hull_areas(points).first()
    assert (row["area"], row["corners"]) == (16.0, 4)


def test_adjusted_p(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])] + [(9, None)], "id long, p double")
    got = {r["id"]: r["p_adj"] for r in stats.adjust(df, "p", key=["id"]).collect()}
    assert got[9] is None
    assert [round(got[i], 6) for i in range(4)] == [0.04, 0.053333, 0.053333, 0.5]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 103: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_smoothing_keeps_the_mass(spark):
    pixels = spark.createDataFrame([(y, x, 0, 100.0 if (y, x) == (3, 0) else 0.0) for y in range(8) for x in range(6)], "y long, x long, c int, val double")
    out = images.smooth(pixels)
    assert out.count() == 48
    assert out.agg(F.sum("val")).first()[0] == pytest.approx(100.0)


def test_histogram_closes_the_last_bin(spark):
    pixels = spark.createDataFrame([(0, x, 0, float(x)) for x in range(11)], "y long, x long, c int, val double").withColumn("g", F.lit(1))
    got = {r["bin"]: r["n"] for r in images.histogram(pixels, ["g"]).collect()}
    assert got == {**{i: 1 for i in range(9)}, 9: 2}


def test_regions_and_stitching(spark):
    cells = [(y, x, 1 if x < 10 else 2) for y in range(10) for x in range(22) if x not in (10, 11)]
    labels = spark.createDataFrame(cells, "y long, x long, label long")
    rows = {r["label"]: r for r in images.regions(labels).collect()}
    assert (rows[1]["area"], rows[1]["centroid_x"], rows[2]["centroid_x"]) == (100, 4.5, 16.5)
    groups = {r["label"]: (r["group_id"], r["n_pieces"]) for r in qc.stitch_groups(labels).collect()}
    assert groups == {1: (1, 2), 2: (1, 2)}


def test_planted_stains(spark):
    rng = np.random.default_rng(0)
    basis = stain.REFERENCE / np.linalg.norm(stain.REFERENCE, axis=1)[:, None]
    amounts = np.vstack([np.column_stack([rng.uniform(0.5, 1.5, 300), np.zeros(300)]), np.column_stack([np.zeros(300), rng.uniform(0.5, 1.5, 300)]), rng.uniform(0.2, 1.0, (300, 2))])
    rgb = np.exp(-amounts @ basis) * 256 - 1
    df = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(rgb)], "y long, x long, r double, g double, b double")
    fit = stain.fit_macenko(df)
    assert (np.degrees(np.arccos(np.clip(np.abs(np.diag(basis @ fit.matrix)), 0, 1))) < 12).all()
    again = stain.apply_macenko(df, fit, fit).orderBy("y").toPandas()[["r", "g", "b"]].to_numpy()
    assert np.abs(again - np.round(rgb)).max() <= 2


def test_readers(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% c\n3 2 2\n1 2 5\n3 1 7\n")
    assert sorted(map(tuple, readers.read_counts(spark, f"file://{tmp_path}/m.mtx").collect())) == [(0, 1, 5.0), (2, 0, 7.0)]
    (tmp_path / "c.csv").write_text("cell,A,Blank-1\n1,2,0\n2,0,3\n")
    (tmp_path / "m.csv").write_text("id,center_x,center_y\n1,0.5,1.5\n")
    got = readers.vizgen(spark, f"file://{tmp_path}", "c.csv", "m.csv")
    assert sorted(map(tuple, got.expr.collect())) == [("1", "A", 2.0)]
    assert got.blanks.count() == 1
    assert {r["cell"]: r["x"] for r in got.obs.collect()} == {"1": 0.5, "2": None}


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
