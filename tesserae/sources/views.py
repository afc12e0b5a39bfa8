"""Spatial views of the warehouse tables: the cells, counts and pixels that queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import table


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on a square lattice, 40 wide; a library is ten rows."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.floor(k / 400.0).cast("long").alias("lib"),
        k.alias("id"),
        (k % 40).cast("double").alias("x"),
        F.floor(k / 40.0).cast("double").alias("y"),
        F.col("c_mktsegment").alias("cl"),
        F.col("c_acctbal").alias("value"),
    )


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scattered points without equal coordinates; a library is a brand."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("lib"),
        k.alias("id"),
        ((k * 7919 % 10007) / 10.0).alias("x"),
        ((k * 104729 % 10009) / 10.0).alias("y"),
        F.col("p_type").alias("cl"),
    )


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as cells on a lattice 25 wide; a library is twenty rows."""
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(k / 500.0).cast("long").alias("lib"),
        k.alias("id"),
        (k % 25).cast("double").alias("x"),
        F.floor(k / 25.0).cast("double").alias("y"),
        F.concat(F.lit("c"), F.col("label")).alias("cl"),
    )


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the embeddings as measured features, in long form."""
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vec.select("id", F.posexplode("v").alias("g", "value")).select("id", F.concat(F.lit("g"), F.col("g")).alias("gene"), F.round(F.col("value").cast("double"), 4).alias("value"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative counts made of the features; zeros are absent."""
    up = F.floor(F.greatest(F.col("value"), F.lit(0.0)) * 20).cast("double")
    return expr(spark, sf_dir).withColumn("value", up).where("value > 0")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as an image: a row of 21 RGB pixels for each vector, values 0 to 255."""
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.slice("embedding", 1, 63).alias("v"))
    flat = vec.select("y", F.posexplode("v").alias("i", "e"))
    return flat.select(
        F.col("y").cast("long").alias("y"),
        F.floor(F.col("i") / 3.0).cast("long").alias("x"),
        (F.col("i") % 3).cast("int").alias("c"),
        F.least(F.greatest(F.floor((F.round(F.col("e").cast("double"), 4) + 1) * 127.5), F.lit(0)), F.lit(255)).cast("double").alias("val"),
    )


def label_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 8 x 5 pixels with gaps on the image's grid; 0 is background."""
    at = pixels(spark, sf_dir).where("c = 0").select("y", "x")
    gap = (F.col("y") % 10 < 2) | (F.col("x") % 7 < 2)
    label = F.floor(F.col("y") / 10.0) * 3 + F.floor(F.col("x") / 7.0) + 1
    return at.select("y", "x", F.when(gap, F.lit(0)).otherwise(label).cast("long").alias("label"))


#: Places of cells in ``cell_pixels``, and the sides of the tiles that cut them.
CELL_STEP, CELL_TILE = 28, 200


def cell_pixels(spark: SparkSession, sf_dir: str, least: int = 5, cut: bool = True) -> DataFrame:
    """``y, x, label``: a slanted ellipse for each embedding, 25 in a row, drawn from its first components.

    Half axes are ``least`` to ``least + 3`` pixels.  With ``cut`` two rows and columns at the
    borders of tiles are empty and the pieces of a cell are labels of their own.  All is
    done with whole numbers.
    """
    e = lambda i, n: F.pmod(F.round(F.element_at("embedding", i + 1).cast("double") * 10000).cast("long"), F.lit(n))
    k = F.col("vec_id").cast("long")
    middle = lambda at, i: at.cast("long") * CELL_STEP + CELL_STEP // 2 + e(i, 3) - 1
    cells = table(spark, sf_dir, "embeddings").select(k.alias("id"), middle(F.floor(k / 25), 3).alias("cy"), middle(k % 25, 4).alias("cx"), (e(0, 4) + least).alias("a"), (e(1, 4) + least).alias("b"), (e(2, 5) - 2).alias("s"))
    reach = lambda n: F.explode(F.sequence(F.lit(-n), F.lit(n)))
    at = cells.withColumn("dy", reach(least + 3)).withColumn("dx", reach(2 * least + 6))
    u = F.col("dx") * 4 + F.col("s") * F.col("dy")
    inside = u * u * F.col("a") * F.col("a") + 16 * F.col("dy") * F.col("dy") * F.col("b") * F.col("b") <= 16 * F.col("a") * F.col("a") * F.col("b") * F.col("b")
    pixels = at.where(inside).select("id", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x")).where("y >= 0 and x >= 0")
    if not cut:
        return pixels.groupBy("y", "x").agg(F.max(F.col("id") + 1).alias("label"))
    tile = lambda c: F.floor(F.col(c) / CELL_TILE).cast("long") % 2
    whole = lambda c: (F.col(c) < CELL_TILE - 1) | ~(F.col(c) % CELL_TILE).isin(0, CELL_TILE - 1)
    return pixels.where(whole("y") & whole("x")).groupBy("y", "x").agg(F.max(F.col("id") * 4 + tile("y") * 2 + tile("x") + 1).alias("label"))


#: Directions of the corners of ``polygons``, and of the squares that are their holes.
CORNERS, HOLE = ((4, 0), (2, 3), (-2, 3), (-4, 0), (-2, -3), (2, -3)), ((1.25, 1.25), (-1.25, 1.25), (-1.25, -1.25), (1.25, -1.25))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, ring, k, x, y``: a hexagon with a square hole for each embedding; its corners lie as far out as the first components tell."""
    k = F.col("vec_id").cast("long")
    far = lambda i: F.pmod(F.round(F.element_at("embedding", i + 1).cast("double") * 10000).cast("long"), F.lit(5)) / 4.0 + 1
    at = lambda ring, i, dx, dy, f: F.struct(F.lit(ring).alias("ring"), F.lit(i).alias("k"), (F.col("cx") + f * dx).alias("x"), (F.col("cy") + f * dy).alias("y"))
    corners = [at(0, i, dx, dy, far(i)) for i, (dx, dy) in enumerate(CORNERS)] + [at(1, i, dx, dy, F.lit(1.0)) for i, (dx, dy) in enumerate(HOLE)]
    middle = table(spark, sf_dir, "embeddings").withColumns({"cx": (k % 25 * CELL_STEP + CELL_STEP // 2).cast("double"), "cy": (F.floor(k / 25) * CELL_STEP + CELL_STEP // 2).cast("double")})
    return middle.select((k + 1).alias("label"), F.explode(F.array(*corners)).alias("p")).select("label", "p.*")


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, x, y, radius``: a disc of radius 4 to 6 for each part; some overlap."""
    k = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(k.alias("label"), (k * 7919 % 10007 / 8.0).alias("x"), (k * 104729 % 10009 / 8.0).alias("y"), (k % 3 + 4).cast("double").alias("radius"))


#: The same views for SQL.
VIEWS_SQL = {
    "polygons": f"""SELECT vec_id::BIGINT + 1 AS label, r AS ring, i AS k, vec_id % 25 * {CELL_STEP} + {CELL_STEP // 2} + f * dx AS x, vec_id // 25 * {CELL_STEP} + {CELL_STEP // 2} + f * dy AS y FROM (
 SELECT vec_id, r, i, dx, dy, CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE ((round(embedding[i + 1]::DOUBLE * 10000)::BIGINT % 5 + 5) % 5) / 4.0::DOUBLE + 1 END AS f FROM embeddings,
 (VALUES {", ".join(f"({r}, {i}, {dx}::DOUBLE, {dy}::DOUBLE)" for r, ring in enumerate((CORNERS, HOLE)) for i, (dx, dy) in enumerate(ring))}) v(r, i, dx, dy))""",
    "discs": "SELECT p_partkey::BIGINT AS label, p_partkey * 7919 % 10007 / 8.0::DOUBLE AS x, p_partkey * 104729 % 10009 / 8.0::DOUBLE AS y, (p_partkey % 3 + 4)::DOUBLE AS radius FROM part",
    "lattice": "SELECT floor(c_custkey / 400.0)::BIGINT AS lib, c_custkey AS id, (c_custkey % 40)::DOUBLE AS x, floor(c_custkey / 40.0)::DOUBLE AS y, c_mktsegment AS cl, c_acctbal AS value FROM customer",
    "cloud": "SELECT p_brand AS lib, p_partkey AS id, (p_partkey * 7919 % 10007) / 10.0::DOUBLE AS x, (p_partkey * 104729 % 10009) / 10.0::DOUBLE AS y, p_type AS cl FROM part",
    "spots": "SELECT floor(vec_id / 500.0)::BIGINT AS lib, vec_id AS id, (vec_id % 25)::DOUBLE AS x, floor(vec_id / 25.0)::DOUBLE AS y, concat('c', label) AS cl FROM embeddings",
    "expr": "SELECT vec_id AS id, concat('g', i) AS gene, round(embedding[i + 1]::DOUBLE, 4) AS value FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)",
    "counts": "SELECT * FROM (SELECT id, gene, floor(greatest(value, 0.0) * 20)::DOUBLE AS value FROM expr) WHERE value > 0",
    "pixels": "SELECT vec_id::BIGINT AS y, floor(i / 3.0)::BIGINT AS x, (i % 3)::INT AS c, least(greatest(floor((round(embedding[i + 1]::DOUBLE, 4) + 1) * 127.5), 0), 255)::DOUBLE AS val FROM embeddings, range(63) r(i)",
    "cell_pixels": f"""SELECT y, x, max(id * 4 + y // {CELL_TILE} % 2 * 2 + x // {CELL_TILE} % 2 + 1) AS label FROM (SELECT id, cy + dy AS y, cx + dx AS x FROM (
 SELECT vec_id::BIGINT AS id, (vec_id // 25) * {CELL_STEP} + {CELL_STEP // 2} + (q[4] % 3 + 3) % 3 - 1 AS cy, (vec_id % 25) * {CELL_STEP} + {CELL_STEP // 2} + (q[5] % 3 + 3) % 3 - 1 AS cx, (q[1] % 4 + 4) % 4 + 5 AS a, (q[2] % 4 + 4) % 4 + 5 AS b, (q[3] % 5 + 5) % 5 - 2 AS s
 FROM (SELECT vec_id, list_transform(embedding[1:5], lambda v: round(v::DOUBLE * 10000)::BIGINT) AS q FROM embeddings)), range(-8, 9) i(dy), range(-16, 17) j(dx)
 WHERE (dx * 4 + s * dy) * (dx * 4 + s * dy) * a * a + 16 * dy * dy * b * b <= 16 * a * a * b * b)
 WHERE y >= 0 AND x >= 0 AND (y < {CELL_TILE - 1} OR y % {CELL_TILE} NOT IN (0, {CELL_TILE - 1})) AND (x < {CELL_TILE - 1} OR x % {CELL_TILE} NOT IN (0, {CELL_TILE - 1})) GROUP BY y, x""",
    "label_pixels": "SELECT y, x, (CASE WHEN y % 10 < 2 OR x % 7 < 2 THEN 0 ELSE floor(y / 10.0) * 3 + floor(x / 7.0) + 1 END)::BIGINT AS label FROM pixels WHERE c = 0",
}


def with_views(*names: str) -> str:
    """``WITH`` and the named views, those they need first."""
    needs = {"counts": ["expr"], "label_pixels": ["pixels"]}
    order: list[str] = []
    for name in names:
        for x in [*needs.get(name, []), name]:
            if x not in order:
                order.append(x)
    return "WITH RECURSIVE " + ", ".join(f"{x} AS ({VIEWS_SQL[x]})" for x in order)
