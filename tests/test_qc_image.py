"""Ranks, and quality of tiles with and without tissue."""

import numpy as np
import pytest

from tesserae.functions import stats
from tesserae.operators import qc


def test_average_ranks(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, 300).astype(float)
    got = {r["k"]: r["rank"] for r in stats.average_ranks(spark.createDataFrame(list(enumerate(values.tolist())), "k long, v double"), "v", "rank").collect()}
    for k, v in enumerate(values):
        assert got[k] == (values < v).sum() + ((values == v).sum() + 1) / 2


def test_tissue_tiles_are_ranked_among_themselves(spark):
    rng = np.random.default_rng(3)
    rows = []
    for tx in range(6):
        for y in range(8):
            for x in range(8):
                value = 100.0 + rng.integers(0, 1 + 20 * tx)
                rows += [(0, tx, y, tx * 8 + x, c, float(value)) for c in range(3)]
    pixels = spark.createDataFrame(rows, "ty long, tx long, y long, x long, c int, val double")
    mask = spark.createDataFrame([(y, x) for y in range(8) for x in range(24, 48)] + [(0, 0)], "y long, x long")
    got = {r["tx"]: r for r in qc.qc_image(pixels, mask).collect()}
    assert [got[t]["is_tissue"] for t in range(6)] == [False] * 3 + [True] * 3
    assert [got[t]["unfocus_score"] for t in range(3)] == [None] * 3
    assert sorted(got[t]["unfocus_score"] for t in range(3, 6))[-1] == pytest.approx(1.0) and got[3]["is_outlier"]
    assert not any(got[t]["is_outlier"] for t in range(3))
    everywhere = {r["tx"]: r for r in qc.qc_image(pixels).collect()}
    assert everywhere[0]["unfocus_score"] == pytest.approx(1.0) and everywhere[0]["is_outlier"] and not everywhere[5]["is_outlier"]
    alone = qc.qc_image(pixels.where("tx = 2")).first()
    assert (alone["unfocus_score"], alone["is_outlier"]) == (0.0, False)
