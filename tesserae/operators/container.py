"""Layers of images as one pixel table ``(image_id, layer, z, y, x, c, val)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import blocks, segmentation
from tesserae.operators.images import gray, otsu

COLUMNS = ["image_id", "layer", "z", "y", "x", "c", "val"]
SCHEMA = "image_id string, layer string, z long, y long, x long, c int, val double"


class ImageContainer:
    """Named layers over shared dimensions; every change returns a new container."""

    def __init__(self, pixels: DataFrame):
        missing = set(COLUMNS) - set(pixels.columns)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        self.pixels = pixels.select(COLUMNS)

    @classmethod
    def from_pixels(cls, pixels: DataFrame, image_id: str = "image", layer: str = "image", z: int = 0) -> ImageContainer:
        return cls(pixels.select(F.lit(image_id).alias("image_id"), F.lit(layer).alias("layer"), F.lit(z).cast("long").alias("z"), "y", "x", "c", "val"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ImageContainer:
        return cls(spark.read.schema(SCHEMA).parquet(path))

    def save(self, path: str) -> None:
        self.pixels.write.mode("errorifexists").partitionBy("layer").parquet(path)

    @classmethod
    def concat(cls, parts: Sequence[ImageContainer], library_ids: Sequence[int] | None = None) -> ImageContainer:
        """Stacks images along z; the places must differ."""
        ids = list(library_ids or range(len(parts)))
        if len(set(ids)) != len(parts):
            raise ValueError("library ids must be unique, one for each image")
        out = None
        for z, part in zip(ids, parts, strict=True):
            rows = part.pixels.withColumn("z", F.lit(z).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return cls(out)

    def layer(self, name: str) -> DataFrame:
        return self.pixels.where(F.col("layer") == name)

    def layers(self) -> list[str]:
        return sorted(r["layer"] for r in self.pixels.select("layer").distinct().collect())

    def shape(self) -> DataFrame:
        return self.pixels.groupBy("image_id", "layer").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count_distinct("z").alias("depth"), F.count_distinct("c").alias("channels"))

    def rename(self, old: str, new: str) -> ImageContainer:
        return ImageContainer(self.pixels.withColumn("layer", F.when(F.col("layer") == old, F.lit(new)).otherwise(F.col("layer"))))

    def add(self, pixels: DataFrame, layer: str) -> ImageContainer:
        """Adds a layer; it must fit the extents of the container."""
        new = pixels.withColumn("layer", F.lit(layer)).select(COLUMNS)
        frame = self.pixels.groupBy("image_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
        out = new.join(frame, "image_id", "left").where(F.col("_h").isNull() | (F.col("y") > F.col("_h")) | (F.col("x") > F.col("_w")))
        if not out.isEmpty():
            raise ValueError("the layer does not fit the image")
        return ImageContainer(self.pixels.unionByName(new))

    def drop(self, layer: str) -> ImageContainer:
        return ImageContainer(self.pixels.where(F.col("layer") != layer))

    def subset(self, cells: DataFrame) -> DataFrame:
        """Cells inside the extent of the image, edges included."""
        box = self.pixels.agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
        inside = F.col("y").between(F.col("_y0"), F.col("_y1")) & F.col("x").between(F.col("_x0"), F.col("_x1"))
        return cells.crossJoin(F.broadcast(box)).where(inside).select(cells.columns)

    def apply(self, func: Callable[[pd.DataFrame], pd.DataFrame], layer: str, new_layer: str, chunk: int = 256, depth: int = 0) -> ImageContainer:
        """Applies ``func`` to chunks of a layer, each with ``depth`` pixels around it.

        ``func`` gets and returns y, x, c, val; what it returns outside the chunk is cut off.
        """
        rows = self.layer(layer)
        reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - depth) / chunk), F.floor((F.col(c) + depth) / chunk)))
        spread = rows.withColumn("_ty", reach("y")).withColumn("_tx", reach("x")).where("_ty >= 0 and _tx >= 0")

        def run(part: pd.DataFrame) -> pd.DataFrame:
            ty, tx = int(part["_ty"].iloc[0]), int(part["_tx"].iloc[0])
            made = func(part[["y", "x", "c", "val"]])
            made = made[(made["y"] // chunk == ty) & (made["x"] // chunk == tx)]
            return made.assign(image_id=part["image_id"].iloc[0], layer=new_layer, z=int(part["z"].iloc[0]))[COLUMNS]

        done = spread.groupBy("image_id", "z", "_ty", "_tx").applyInPandas(run, SCHEMA)
        return ImageContainer(self.pixels.where(F.col("layer") != new_layer).unionByName(done))

    def segment(
        self,
        layer: str,
        new_layer: str = "segmented",
        threshold: float | None = None,
        above: bool = True,
        method: str | Callable[[np.ndarray], np.ndarray] = "components",
        channel: int | None = None,
        chunk: int = blocks.SIZE,
        depth: int = 30,
    ) -> ImageContainer:
        """Adds labels of every image and z, all in one plan; pixels without a label have no row.

        ``components`` of the pixels on one side of a threshold, Otsu's of each image if none is given, touching at
        corners too; ``watershed`` (``segmentation.watershed``); or a function of chunks
        (``segmentation.segment_chunks``).  Without ``channel`` the first two use the gray level.
        """
        rows = self.layer(layer).select(F.concat_ws("/", "z", "image_id").alias("img"), "y", "x", "c", "val")
        if channel is not None:
            rows = rows.where(F.col("c") == channel).withColumn("c", F.lit(0))
        if callable(method):
            made = segmentation.segment_chunks(blocks.to_blocks(rows, chunk), method, depth)
        else:
            level = gray(rows) if channel is None else rows.drop("c")
            if method == "watershed":
                made = segmentation.watershed(blocks.to_blocks(level.withColumn("c", F.lit(0)), chunk), threshold, above)
            elif method == "components":
                known = level.withColumn("threshold", F.lit(float(threshold))) if threshold is not None else level.join(otsu(level, by=["img"]), "img")
                mask = known.where(F.col("val") >= F.col("threshold") if above else F.col("val") < F.col("threshold"))
                found = blocks.label_components(blocks.to_blocks(mask.select("img", "y", "x", F.lit(0).alias("c"), F.lit(1.0).alias("val")), chunk), 0, diagonal=True)
                # A row of numbers is one longer than the mask is wide.
                made = blocks.map_blocks(found, lambda a, tile: (np.where(a > 0, a + (a - 1) // tile.iw, 0.0), 0.0))
            else:
                raise ValueError(f"unknown method {method}")
        labels = blocks.to_pixels(made, 0, above=0.0)
        place = F.split("img", "/", 2)
        out = labels.select(place[1].alias("image_id"), F.lit(new_layer).alias("layer"), place[0].cast("long").alias("z"), "y", "x", "c", "val")
        return ImageContainer(self.pixels.where(F.col("layer") != new_layer).unionByName(out))
