"""Images as files: a catalogue, readers and a PNG writer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """name, extension and path of a folder's files; dots within a name are dropped, files without extension skipped,
    and of several files for a name the last path wins."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    base = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", base.alias("base")).where(c("base").rlike(r"^.+\.[^.]+$"))
    named = rows.select("path", F.regexp_replace(F.regexp_extract("base", r"^(.+)\.([^.]+)$", 1), r"\.", "").alias("name"), F.regexp_extract("base", r"\.([^.]+)$", 1).alias("extension"))
    return named.groupBy("name").agg(F.max_by("extension", "path").alias("extension"), F.max("path").alias("path"))


def default_path(spark: SparkSession) -> str:
    """Folder of sample images: the setting ``spark.tesserae.path`` of the session; there are none in the package."""
    path = spark.conf.get("spark.tesserae.path", None)
    if not path:
        raise ValueError("set spark.tesserae.path to a folder of images")
    return path


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of image files by Spark's own reader: image_id (hash of the path), path, h, w, y, x and v, or r, g, b.

    Files that it cannot read are left out.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    cell = F.explode(F.sequence(F.lit(0), c("height") * c("width") - 1))
    at = rows.select(F.xxhash64("origin").alias("image_id"), c("origin").alias("path"), c("height").alias("h"), c("width").alias("w"), c("nChannels").alias("n"), "data", cell.alias("i"))
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(data, i * n + {k} + 1, 1)")), 16, 10).cast("double")
    channel = lambda k: F.when(c("n") == 1, byte(0)).otherwise(byte(k))
    return at.select("image_id", "path", "h", "w", F.floor(c("i") / c("w")).cast("int").alias("y"), (c("i") % c("w")).cast("int").alias("x"), channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def png(a: np.ndarray) -> bytes:
    """An 8-bit PNG of (h, w), (h, w, 3) or (h, w, 4) values."""
    h, w = a.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if a.ndim == 2 else a.shape[2]]
    data = np.clip(np.floor(a + 0.5), 0, 255).astype(np.uint8).reshape(h, -1)
    body = np.hstack([np.zeros((h, 1), np.uint8), data]).tobytes()
    part = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def encoded(px: DataFrame) -> DataFrame:
    """One PNG for each image: image_id, png."""
    channels = [n for n in ("v", "r", "g", "b", "a") if n in px.columns]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(rows["h"].iloc[0]), int(rows["w"].iloc[0]), len(channels)))
        a[rows["y"], rows["x"]] = rows[channels]
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "png": [png(a[:, :, 0] if len(channels) == 1 else a)]})

    return px.select("image_id", "h", "w", "y", "x", *channels).groupBy("image_id").applyInPandas(run, "image_id long, png binary")


def save_images(px: DataFrame, folder: str) -> DataFrame:
    """Writes <image_id>.png into a folder that all executors share; returns image_id and path. Rewriting gives the same files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = [f"{folder}/{i}.png" for i in batch["image_id"]]
            for path, data in zip(paths, batch["png"], strict=True):
                with open(path, "wb") as f:
                    f.write(data)
            yield pd.DataFrame({"image_id": batch["image_id"], "path": paths})

    return encoded(px).mapInPandas(write, "image_id long, path string")
