"""Neighbors of feature vectors against brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tesserae.operators import niche

K = 15


def brute(ids, rows):
    z = (rows - rows.mean(0)) / rows.std(0, ddof=1)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2).round(9))
    return {i: sorted((d[a, b], j) for b, j in enumerate(ids) if j != i)[:K] for a, i in enumerate(ids)}


@pytest.mark.parametrize("shape", ["spread", "lattice"])
def test_feature_neighbors_are_the_nearest(spark, shape):
    rng = np.random.default_rng(7)
    # Spread: near vectors stand far apart in id.  Lattice: shares of few neighbors, so many are equal.
    rows = rng.normal(size=(900, 3)) if shape == "spread" else rng.multinomial(8, [0.4, 0.3, 0.2, 0.1], size=900) / 8
    ids = rng.permutation(900).tolist()
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, rows, strict=True)], "id long, v array<double>").select("id", array_to_vector(F.col("v")).alias("features"))
    got = {}
    for r in niche.feature_neighbors(frame, K).collect():
        got.setdefault(r["src"], {})[r["dst"]] = 1 / r["w"] - 1
    expected = brute(ids, rows)
    assert all(len(got[i]) == K and i not in got[i] for i in ids)
    # Ties may be told apart by rounding, so distances are compared, not ids.
    assert all(np.allclose(sorted(got[i].values()), [d for d, _ in expected[i]], atol=1e-4) for i in ids)
    if shape == "spread":
        recall = np.mean([len(set(got[i]) & {j for _, j in expected[i]}) / K for i in ids])
        assert recall >= 0.9
