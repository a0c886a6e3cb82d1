"""Rasters derived from the driver's tables, in Spark and as SQL common tables.

Four images of 32x32 cells, values 0..255, from lineitem; colour images from the
same rows by line number; points from embeddings; one-dimensional signals from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, IMAGES = 32, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession) -> DataFrame:
    n = F.col("id")
    return spark.range(IMAGES * SIDE * SIDE).select((n % IMAGES).alias("image_id"), ((n / IMAGES).cast("long") % SIDE).cast("int").alias("y"), (n / (IMAGES * SIDE)).cast("int").alias("x"))


def _summed(spark: SparkSession, sf_dir: str, **sums) -> DataFrame:
    q = F.round("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % IMAGES).alias("image_id"), (F.col("l_orderkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x"), *(F.when(c, q).otherwise(0).alias(n) for n, c in sums.items())
    )
    rows = rows.unionByName(_cells(spark).select("*", *(F.lit(0).cast("long").alias(n) for n in sums)))
    out = rows.groupBy("image_id", "y", "x").agg(*((F.sum(n) % 256).cast("double").alias(n) for n in sums))
    return out.select("image_id", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), "y", "x", *sums)


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(spark, sf_dir, v=F.lit(True))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(spark, sf_dir, **{c: F.col("l_linenumber") % 3 == i for i, c in enumerate("rgb")})


def mask(spark: SparkSession, sf_dir: str, above: int = 128) -> DataFrame:
    return gray(spark, sf_dir).withColumn("v", (F.col("v") > above).cast("double"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points, in hundredths."""
    p = F.transform("embedding", lambda e: F.round(e.cast("double") * 100))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), p.alias("p"))


def _sql(*sums: tuple[str, str]) -> str:
    cols = ", ".join(f"(sum(CASE WHEN {c} THEN round(l_quantity)::BIGINT ELSE 0 END) % 256)::DOUBLE AS {n}" for n, c in sums)
    got = ", ".join(f"coalesce(a.{n}, 0)::DOUBLE AS {n}" for n, _ in sums)
    return (
        f"SELECT i.i::BIGINT AS image_id, {SIDE} AS h, {SIDE} AS w, y.y::INT AS y, x.x::INT AS x, {got} FROM range({IMAGES}) i(i), range({SIDE}) y(y), range({SIDE}) x(x) "
        f"LEFT JOIN (SELECT l_suppkey % {IMAGES} AS image_id, l_orderkey % {SIDE} AS y, l_partkey % {SIDE} AS x, {cols} FROM lineitem GROUP BY 1, 2, 3) a "
        "ON a.image_id = i.i AND a.y = y.y AND a.x = x.x"
    )


GRAY = _sql(("v", "true"))
RGB = _sql(*((c, f"l_linenumber % 3 = {i}") for i, c in enumerate("rgb")))
MASK = f"SELECT image_id, h, w, y, x, (v > 128)::INT::DOUBLE AS v FROM ({GRAY})"
POINTS = "SELECT vec_id AS point_id, [round(e::DOUBLE * 100) FOR e IN embedding] AS p FROM embeddings"


#: Sides of volumes; there is one for every 16 suppliers, so that their number grows with the data.
DEPTH, HEIGHT, WIDTH = 6, 12, 10


def volume(spark: SparkSession, sf_dir: str, above: int | None = None) -> DataFrame:
    """Volumes (image_id, d, h, w, z, y, x, v) of values 0..255 from lineitem; with ``above``, 1 where they are greater and else 0."""
    image, q = F.floor(F.col("l_suppkey") / 16).alias("image_id"), F.round("l_quantity").cast("long")
    at = [(F.col("l_linenumber") - 1 + F.col("l_orderkey")) % DEPTH, F.col("l_partkey") % HEIGHT, F.col("l_orderkey") % WIDTH]
    rows = table(spark, sf_dir, "lineitem").select(image, *(a.cast("int").alias(n) for a, n in zip(at, "zyx", strict=True)), q.alias("q"))
    sums = rows.groupBy("image_id", "z", "y", "x").agg((F.sum("q") % 256).cast("double").alias("v"))
    cells = rows.select("image_id").distinct()
    for n, size in zip("zyx", (DEPTH, HEIGHT, WIDTH), strict=True):
        cells = cells.withColumn(n, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    v = F.coalesce("v", F.lit(0.0))
    if above is not None:
        v = (v > above).cast("double")
    sizes = [F.lit(n).alias(c) for c, n in zip("dhw", (DEPTH, HEIGHT, WIDTH), strict=True)]
    return cells.join(sums, ["image_id", "z", "y", "x"], "left").select("image_id", *sizes, "z", "y", "x", v.alias("v"))


VOLUME = (
    f"SELECT i.image_id, {DEPTH} AS d, {HEIGHT} AS h, {WIDTH} AS w, z.z::INT AS z, y.y::INT AS y, x.x::INT AS x, coalesce(a.v, 0.0)::DOUBLE AS v "
    f"FROM (SELECT DISTINCT l_suppkey // 16 AS image_id FROM lineitem) i, range({DEPTH}) z(z), range({HEIGHT}) y(y), range({WIDTH}) x(x) "
    f"LEFT JOIN (SELECT l_suppkey // 16 AS image_id, (l_linenumber - 1 + l_orderkey) % {DEPTH} AS z, l_partkey % {HEIGHT} AS y, l_orderkey % {WIDTH} AS x, (sum(round(l_quantity)::BIGINT) % 256)::DOUBLE AS v FROM lineitem GROUP BY ALL) a "
    "ON a.image_id = i.image_id AND a.z = z.z AND a.y = y.y AND a.x = x.x"
)


def volume_mask(above: int) -> str:
    return f"SELECT * REPLACE ((v > {above})::INT::DOUBLE AS v) FROM ({VOLUME})"


def ctes(**parts: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in parts.items())
