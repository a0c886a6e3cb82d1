import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.sources import raster_files as R

from .test_trees import pixels


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(R.RasterFiles)
    return spark


def part(name, x):
    return struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))


def filtered_png(a, bits, kind, palette=None):
    """A PNG whose lines take the five filters in turn."""
    h, line = a.shape[0], a.reshape(a.shape[0], -1)
    step = max(1, R.SAMPLES[kind] * bits // 8)
    raw = [np.frombuffer(r.astype(">u2" if bits == 16 else np.uint8).tobytes(), np.uint8).astype(int) for r in line]
    if bits < 8:
        raw = [np.packbits(np.unpackbits(r.astype(np.uint8)[:, None], axis=1)[:, -bits:].ravel()).astype(int) for r in raw]
    out = b""
    for y, r in enumerate(raw):
        up = raw[y - 1] if y else np.zeros_like(r)
        left, corner = (np.concatenate([np.zeros(step, int), x[:-step]])[: len(r)] for x in (r, up))
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        out += bytes([y % 5]) + ((r - [0 * r, left, up, (left + up) // 2, paeth][y % 5]) % 256).astype(np.uint8).tobytes()
    head = struct.pack(">IIBBBBB", a.shape[1], h, bits, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + (part(b"PLTE", palette.tobytes()) if palette is not None else b"") + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


def test_files_of_all_kinds_and_damaged_ones(source, tmp_path):
    rng = np.random.default_rng(1)
    gray, deep, rgb, rgba, two = rng.integers(0, 256, (11, 7)), rng.integers(0, 65536, (6, 5)), rng.integers(0, 256, (12, 5, 3)), rng.integers(0, 256, (7, 4, 4)), rng.integers(0, 4, (6, 9))
    palette = rng.integers(0, 256, (4, 3)).astype(np.uint8)
    files = {"gray.png": filtered_png(gray, 8, 0), "deep.png": filtered_png(deep, 16, 0), "rgb.png": filtered_png(rgb, 8, 2), "rgba.png": filtered_png(rgba, 8, 6), "two.png": filtered_png(two, 2, 0), "map.png": filtered_png(two, 2, 3, palette)}
    files |= {"p.pgm": R.encoded(gray, "pgm"), "p.ppm": R.encoded(rgb, "ppm"), "cut.png": files["gray.png"][:60], "empty.png": b"", "other.txt": b"hello", "short.pgm": b"P5\n9 9\n255\n123", "_hidden.png": b"x"}
    for name, b in files.items():
        (tmp_path / name).write_bytes(b)
    got = {os.path.basename(r.path): r for r in source.read.format("raster_files").load(str(tmp_path)).collect()}
    assert set(got) == set(files) - {"_hidden.png"}
    assert {n for n, r in got.items() if r.error} == {"cut.png", "empty.png", "other.txt", "short.pgm"}
    wants = {"gray.png": gray, "deep.png": deep, "rgb.png": rgb, "rgba.png": rgba, "two.png": two * 85, "map.png": palette[two], "p.pgm": gray, "p.ppm": rgb}
    for name, want in wants.items():
        r = got[name]
        a = np.frombuffer(r.data, ">u2" if r.bits == 16 else np.uint8).reshape(r.h, r.w, r.channels)
        assert (a == want.reshape(a.shape)).all(), name
    cells = R.rows_as_images(source.read.format("raster_files").option("suffix", ".ppm").load(str(tmp_path))).collect()
    assert len(cells) == 60 and all((r.v0, r.v1, r.v2, r.v3) == (*rgb[r.y, r.x], None) for r in cells)


@pytest.mark.parametrize("kind", ["png", "pgm"])
def test_written_files_come_back(source, tmp_path, kind):
    images = [np.random.default_rng(k).integers(0, 256, (5 + k, 8)).astype(float) for k in range(4)]
    folder = str(tmp_path / "out")
    os.mkdir(folder)
    R.images_as_rows(pixels(source, images)).repartition(3).write.format("raster_files").option("format", kind).mode("append").save(folder)
    assert sorted(os.listdir(folder)) == [f"{k}.{kind}" for k in range(4)]
    for r in source.read.format("raster_files").load(folder).collect():
        assert np.frombuffer(r.data, np.uint8).tolist() == images[int(os.path.basename(r.path)[0])].ravel().tolist()
    R.images_as_rows(pixels(source, images[:1])).write.format("raster_files").option("format", kind).mode("overwrite").save(folder)
    assert os.listdir(folder) == [f"0.{kind}"]


def test_a_failed_task_leaves_no_file(source, tmp_path):
    rows = R.images_as_rows(pixels(source, [np.ones((3, 3)), np.ones((3, 3))]))
    broken = rows.withColumn("data", F.when(F.col("name") == "1", F.lit(b"short")).otherwise(F.col("data"))).repartition(2, "name")
    with pytest.raises(Exception, match="reshape"):
        broken.write.format("raster_files").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="columns are missing"):
        rows.drop("h").write.format("raster_files").mode("append").save(str(tmp_path))
