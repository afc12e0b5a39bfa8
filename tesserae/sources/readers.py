"""Readers for the file layouts of spatial assays, as DataFrames with explicit schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of spot position files without a header.
POSITIONS = ("barcode", "in_tissue", "array_row", "array_col", "pxl_a", "pxl_b")
SCALE_FACTORS = "spot_diameter_fullres double, tissue_hires_scalef double, fiducial_diameter_fullres double, tissue_lowres_scalef double"


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, value`` (from 0) of a coordinate MatrixMarket file, gzipped or not."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("%")))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    cells = parts.select((F.get("p", F.lit(0)).cast("long") - 1).alias("row"), (F.get("p", F.lit(1)).cast("long") - 1).alias("col"), F.get("p", F.lit(2)).cast("double").alias("value"), F.monotonically_increasing_id().alias("_at"))
    # The first line that is no comment gives the size.
    first = cells.agg(F.min("_at").alias("_at"))
    return cells.join(F.broadcast(first), "_at", "left_anti").drop("_at")


def read_wide_counts(spark: SparkSession, path: str, key: str = "cell") -> DataFrame:
    """``cell, gene, value`` of a CSV with a row for each cell; zeros are left out."""
    wide = spark.read.option("header", True).csv(path)
    name = key if key in wide.columns else wide.columns[0]
    genes = [c for c in wide.columns if c != name]
    long = wide.withColumn(name, F.col(f"`{name}`").cast("string")).unpivot(name, genes, "gene", "value")
    return long.select(F.col(f"`{name}`").alias("cell"), "gene", F.col("value").cast("double").alias("value")).where("value <> 0")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".mtx", ".mtx.gz")):
        return read_matrix_market(spark, path)
    if path.endswith((".csv", ".txt", ".csv.gz")):
        return read_wide_counts(spark, path)
    raise ValueError(f"unknown format of {path}")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Spot positions, with or without a header."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in POSITIONS)).csv(path).where("barcode <> 'barcode'")
    return raw.select("barcode", *[F.col(c).cast("int").alias(c) for c in POSITIONS[1:]])


@dataclass
class Assay:
    """Tables of one assay; ``obs`` has cell, lib, x, y and more, ``expr`` cell, gene, value."""

    obs: DataFrame
    expr: DataFrame
    library: DataFrame | None = None
    blanks: DataFrame | None = None
    images: DataFrame | None = None


def visium(spark: SparkSession, path: str, counts_file: str, library_id: str, load_images: bool = False) -> Assay:
    """Spots with positions joined to their barcodes, and the library's scale factors."""
    expr = read_counts(spark, f"{path}/{counts_file}")
    places = read_positions(spark, f"{path}/spatial/tissue_positions_list.csv")
    cells = expr.select("cell").distinct()
    obs = cells.join(places.withColumnRenamed("barcode", "cell"), "cell", "left").select("cell", F.lit(library_id).alias("lib"), F.col("pxl_b").cast("double").alias("x"), F.col("pxl_a").cast("double").alias("y"), "in_tissue", "array_row", "array_col")
    scale = spark.read.schema(SCALE_FACTORS).option("multiLine", True).json(f"{path}/spatial/scalefactors_json.json").withColumn("lib", F.lit(library_id))
    images = spark.read.format("image").load(f"{path}/spatial/*.png") if load_images else None
    return Assay(obs, expr, scale, images=images)


def vizgen(spark: SparkSession, path: str, counts_file: str, meta_file: str, library_id: str = "library") -> Assay:
    """Cells with their centers; features named blank are kept apart."""
    expr = read_wide_counts(spark, f"{path}/{counts_file}")
    meta = spark.read.option("header", True).csv(f"{path}/{meta_file}")
    key = meta.columns[0]
    own = meta.withColumnRenamed(key, "cell").withColumn("cell", F.col("cell").cast("string"))
    obs = expr.select("cell").distinct().join(own, "cell", "left").withColumns({"lib": F.lit(library_id), "x": F.col("center_x").cast("double"), "y": F.col("center_y").cast("double")})
    blank = F.contains("gene", F.lit("Blank"))
    return Assay(obs, expr.where(~blank), blanks=expr.where(blank))


def nanostring(spark: SparkSession, path: str, counts_file: str, meta_file: str, fov_file: str | None = None) -> Assay:
    """Cells named by number and field of view that both files have, local coordinates first."""
    counts = spark.read.option("header", True).csv(f"{path}/{counts_file}")
    meta = spark.read.option("header", True).csv(f"{path}/{meta_file}")
    cell = F.concat_ws("_", "cell_ID", "fov").alias("cell")
    genes = [c for c in counts.columns if c not in ("fov", "cell_ID")]
    wide = counts.select(cell, *[F.col(f"`{g}`") for g in genes])
    places = meta.select(cell, F.col("fov").alias("lib"), F.col("CenterX_local_px").cast("double").alias("x"), F.col("CenterY_local_px").cast("double").alias("y"), F.col("CenterX_global_px").cast("double").alias("global_x"), F.col("CenterY_global_px").cast("double").alias("global_y"))
    obs = places.join(wide.select("cell"), "cell", "left_semi")
    expr = wide.unpivot("cell", genes, "gene", "value").select("cell", "gene", F.col("value").cast("double").alias("value")).where("value <> 0").join(places.select("cell"), "cell", "left_semi")
    library = spark.read.option("header", True).csv(f"{path}/{fov_file}") if fov_file else None
    return Assay(obs, expr, library)


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, y, x, c, val`` of image files that Spark decodes; channels are red, green, blue."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("image_id"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))
    rows = raw.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    cells = rows.select("image_id", "y", "w", "n", F.expr("substring(data, y * w * n + 1, w * n)").alias("row")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("n") - 1)))
    value = F.conv(F.hex(F.expr("substring(row, i + 1, 1)")), 16, 10).cast("double")
    channel = F.col("i") % F.col("n")
    return cells.select("image_id", F.col("y").cast("long").alias("y"), F.floor(F.col("i") / F.col("n")).alias("x"), F.when(F.col("n") >= 3, F.when(channel < 3, 2 - channel).otherwise(channel)).otherwise(channel).cast("int").alias("c"), value.alias("val"))


def element_centroids(labels: DataFrame) -> DataFrame:
    """``id, x, y`` of every label but 0."""
    return labels.where("label <> 0").groupBy(F.col("label").alias("id")).agg(F.avg(F.col("x").cast("double")).alias("x"), F.avg(F.col("y").cast("double")).alias("y"))


def expression(expr: DataFrame, genes: list[str] | None = None, layer: str | None = None, highly_variable: DataFrame | None = None) -> DataFrame:
    """The rows of a layer and of some features: those named, else the highly variable ones."""
    out = expr.where(F.col("layer") == layer) if layer is not None and "layer" in expr.columns else expr
    if genes is not None:
        return out.where(F.col("gene").isin(genes))
    if highly_variable is not None:
        return out.join(highly_variable.where("highly_variable").select("gene"), "gene", "left_semi")
    return out


def relabelled(expr: DataFrame, genes: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Features under another name; repeated names get a number."""
    n = F.row_number().over(Window.partitionBy(symbol).orderBy("gene"))
    names = genes.select("gene", F.when(n > 1, F.concat(F.col(symbol), F.lit("-"), (n - 1).cast("string"))).otherwise(F.col(symbol)).alias("_s"))
    return expr.join(names, "gene").drop("gene").withColumnRenamed("_s", "gene")


def pick_level(levels: DataFrame, prefer: str = "coarsest") -> DataFrame:
    """The pyramid level of each image with the fewest or the most pixels; ``levels`` has image_id, level, height, width."""
    size = F.col("height").cast("long") * F.col("width")
    best = F.min_by("level", size) if prefer == "coarsest" else F.max_by("level", size)
    return levels.groupBy("image_id").agg(best.alias("level"))


#: Schemas of the tables that operators share.
SCHEMAS = {
    "obs": "lib string, id bigint, x double, y double, cl string",
    "expr": "id bigint, gene string, value double",
    "edges": "lib string, src bigint, dst bigint, w double, dist double",
    "pixels": "y bigint, x bigint, c int, val double",
    "label_pixels": "y bigint, x bigint, label bigint",
}
