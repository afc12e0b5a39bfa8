"""Blocks on their way between tasks are small: a task may be handed all blocks of a partition at once."""

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import blocks as bl
from tesserae.operators import segmentation


def test_blocks_and_halos_are_compressed(spark):
    disc = spark.range(0, 512 * 512).select(F.floor(F.col("id") / 512).alias("y"), (F.col("id") % 512).alias("x"), F.lit(0).alias("c"))
    disc = disc.withColumn("val", (((F.col("y") - 250) ** 2 + (F.col("x") - 240) ** 2) < 10_000).cast("double"))
    image = bl.to_blocks(disc)
    for made in (image, segmentation.distance_transform(image)):
        most = made.agg(F.max(F.length("data")), F.max(F.col("planes") * F.col("h") * F.col("w") * 8)).first()
        assert most[1] >= 256 * 256 * 8 and most[0] < most[1] / 5


def test_arrays_return_as_they_were():
    rng = np.random.default_rng(1)
    for shape in ((1, 3, 4), (2, 256, 256), (0, 5, 5), (3, 0, 7)):
        a = np.where(rng.random(shape) < 0.2, np.nan, rng.random(shape))
        back = bl._array(type("Row", (), bl._fields(a)))
        assert back.shape == shape and np.array_equal(a, back, equal_nan=True)
