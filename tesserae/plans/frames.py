"""Pixel relations and what every operator needs of them.

An image is a set of rows (image_id, h, w, y, x, v): its size travels with its
pixels, so no operator has to guess it or join for it. Every cell of the grid is
there once. Colour images have r, g and b in place of v.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE = ["image_id", "h", "w"]
PIXEL = [*IMAGE, "y", "x"]
#: Type name to least and greatest value; floating types keep what they get.
LIMITS = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "uint32": (0, 2**32 - 1), "int32": (-(2**31), 2**31 - 1), "bool": (0, 1)}


def cast_to(v: Column, dtype: str) -> Column:
    """Rounds half away from zero and saturates; bool truncates; floating types stay."""
    if dtype not in LIMITS:
        return v.cast("double")
    if dtype == "bool":
        return F.when(F.abs(v) >= 1, 1.0).otherwise(0.0)
    low, high = LIMITS[dtype]
    return F.least(F.greatest(F.round(v), F.lit(float(low))), F.lit(float(high)))


def shown(v: Column | str, digits: int = 6) -> Column:
    """A double rounded so that another order of summation gives the same, without a negative zero."""
    return F.round(F.col(v) if isinstance(v, str) else v, digits) + F.lit(0.0)


def grid(images: DataFrame) -> DataFrame:
    """Every cell of images (image_id, h, w)."""
    rows = images.select(*IMAGE, F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))


def images_of(px: DataFrame) -> DataFrame:
    return px.select(*IMAGE).distinct()


def inside() -> Column:
    return F.col("y").between(0, F.col("h") - 1) & F.col("x").between(0, F.col("w") - 1)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``; in a local session without it, the SQL warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: what follows depends on files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their place (from 1) among the rows of equal ``key`` in a total order, without one task for a key.

    Sorted ranges are stored with each row's place in its range; the numbers of rows in ranges, one for each key and range, give the rest.
    """
    spread = rows.select("*", *(o.alias(f"__o{i}") for i, o in enumerate(order)))
    names = [key, *(f"__o{i}" for i in range(len(order)))]
    ranges = spread.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names[1:])
    ranges = stored(ranges.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    ranges = ranges.withColumn("__range", F.shiftright("__at", 33))
    each = ranges.groupBy(key, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select(key, "__range", (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__add"))
    return ranges.join(each, [key, "__range"]).withColumn(name, F.col("__at") + F.col("__add")).drop("__at", "__range", "__add")
