"""Tables of stitched cells against pandas."""

import numpy as np
import pandas as pd
import pytest

from tesserae.operators import stitching

GROUPS = [(1, 1, 3, 0.8), (2, 1, 3, 0.8), (5, 1, 3, 0.8), (3, 3, 1, None), (7, 4, 2, 0.6), (4, 4, 2, 0.6)]
CELLS = [(1, 10, 1.0, 0.5, False, "b", None), (2, 7, 5.0, 0.9, True, "a", 2.5), (5, 4, 6.0, None, False, "c", 1.0), (3, 3, 2.0, 0.1, False, "d", 4.0), (7, 9, 8.0, 0.2, False, "e", -1.0), (4, 1, 4.0, 0.3, False, "f", 0.0), (9, 6, 9.0, 0.4, True, "g", 7.0)]


def frames(spark):
    groups = spark.createDataFrame(GROUPS, "label long, group_id long, n_pieces long, confidence double")
    return spark.createDataFrame(CELLS, "label long, area int, centroid_y double, cut_score double, is_outlier boolean, kind string, extra double"), groups


@pytest.mark.parametrize("strategy", [*stitching.STRATEGIES, len])
def test_table(spark, strategy):
    cells, groups = frames(spark)
    got = {r["label"]: r for r in stitching.stitched_table(cells, groups, strategy).collect()}
    frame = pd.DataFrame(CELLS, columns=cells.columns).sort_values("label")
    frame["g"] = frame["label"].map({g[0]: g[1] for g in GROUPS}).fillna(frame["label"])
    assert set(got) == set(frame["g"])
    for g, part in frame.groupby("g"):
        row = got[g]
        assert (row["centroid_y"], row["cut_score"]) == pytest.approx((part["centroid_y"].mean(), part["cut_score"].max()))
        assert (row["is_outlier"], row["kind"], row["n_pieces"], row["is_stitched"]) == (part["is_outlier"].any(), part["kind"].iloc[0], len(part), len(part) > 1)
        expected = len(part) if callable(strategy) else part["area"].iloc[0] if strategy == "first" else getattr(part["area"], strategy)()
        assert row["area"] == pytest.approx(expected)


@pytest.mark.parametrize("strategy", stitching.STRATEGIES)
def test_features(spark, strategy):
    _, groups = frames(spark)
    dense = {1: [1.0, 0.0, 2.0], 2: [0.0, 0.0, 3.0], 5: [4.0, -2.0, 0.0], 3: [5.0, 0.0, 0.0], 4: [0.0, 1.0, -6.0], 7: [8.0, 0.0, -7.0], 9: [0.0, 3.0, 0.0]}
    rows = [(k, f"f{i}", v) for k, vs in dense.items() for i, v in enumerate(vs) if v]
    got = {(r["label"], r["feature"]): r["value"] for r in stitching.stitched_features(spark.createDataFrame(rows, "label long, feature string, value double"), groups, strategy).collect()}
    of = {g[0]: g[1] for g in GROUPS}
    expected = {}
    for g in {of.get(k, k) for k in dense}:
        block = np.array([dense[k] for k in sorted(dense) if of.get(k, k) == g])
        made = block[0] if strategy == "first" else getattr(np, strategy)(block, axis=0)
        expected |= {(g, f"f{i}"): v for i, v in enumerate(made) if v}
    assert got == pytest.approx(expected)


def test_unknown_strategies(spark):
    cells, groups = frames(spark)
    with pytest.raises(ValueError):
        stitching.stitched_table(cells, groups, "mode")
    with pytest.raises(ValueError):
        stitching.stitched_features(cells, groups, len)
