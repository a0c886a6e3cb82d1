"""``raster_files``: image files as a data source, read by partitions and written with commit and abort.

    spark.dataSource.register(RasterFiles)
    rows = spark.read.format("raster_files").load(folder)
    images_as_rows(px).write.format("raster_files").option("format", "pgm").mode("append").save(folder)

A row is a file: path, h, w, channels, bits, its samples (big-endian where there are 16 bits), and
why it could not be read, if so. Files are found and written through Arrow's file systems, so that a
folder can be any that these open (local or mounted, HDFS, object stores).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .images import png

SCHEMA = "path string, h int, w int, channels int, bits int, data binary, error string"
#: Bytes of files that a partition reads, about.
TOGETHER = 64 << 20
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def unfiltered(raw: bytes, h: int, line: int, step: int) -> np.ndarray:
    """Scan lines of a PNG with their filters undone; ``step`` is a pixel's bytes."""
    rows = np.frombuffer(raw, np.uint8)
    if len(rows) != h * (line + 1):
        raise ValueError("scan lines are missing")
    rows, out, above = rows.reshape(h, line + 1), np.zeros((h, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(h):
        kind, x = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            now = x
        elif kind == 2:
            now = x + above
        elif kind == 1:
            now = np.empty(line, np.uint8)
            for k in range(step):
                now[k::step] = np.cumsum(x[k::step], dtype=np.uint8)
        elif kind in (3, 4):
            now, up, cur = bytearray(line), above.tolist(), x.tolist()
            for i in range(line):
                a, b, d = now[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - d
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                now[i] = (cur[i] + guess) & 255
            now = np.frombuffer(bytes(now), np.uint8)
        else:
            raise ValueError(f"filter {kind} is unknown")
        out[y] = above = now
    return out


def decoded_png(b: bytes) -> tuple[int, int, int, int, bytes]:
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(b):
        size, name = struct.unpack(">I4s", b[at : at + 8])
        part = b[at + 8 : at + 8 + size]
        if len(part) < size or zlib.crc32(name + part) != struct.unpack(">I", b[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a part is cut or damaged")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    w, h, bits, kind, _, _, laced = head
    if laced:
        raise ValueError("interlaced files are not read")
    n = SAMPLES[kind]
    rows = unfiltered(zlib.decompress(b"".join(body)), h, (w * n * bits + 7) // 8, max(1, n * bits // 8))
    if bits < 8:
        rows = np.unpackbits(rows, axis=1)[:, : w * bits].reshape(h, w, bits) @ (1 << np.arange(bits)[::-1])
        rows = (rows if kind == 3 else rows * 255 // (2**bits - 1)).astype(np.uint8)
    if kind == 3:
        rows, n = palette[rows.reshape(h, w)], 3
    return h, w, n, 16 if bits == 16 else 8, rows.tobytes()


def decoded_pnm(b: bytes) -> tuple[int, int, int, int, bytes]:
    m = re.match(rb"P([56])\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", b)
    if not m:
        raise ValueError("header is not that of a binary PGM or PPM")
    n, w, h, top = (3 if m[1] == b"6" else 1, *(int(m[i]) for i in (2, 3, 4)))
    bits = 8 if top < 256 else 16
    data = b[m.end() : m.end() + h * w * n * bits // 8]
    if len(data) < h * w * n * bits // 8:
        raise ValueError("samples are missing")
    return h, w, n, bits, data


def decoded(b: bytes) -> tuple[int, int, int, int, bytes]:
    """h, w, channels, bits, samples."""
    if b.startswith(b"\x89PNG\r\n\x1a\n"):
        return decoded_png(b)
    if b[:2] in (b"P5", b"P6"):
        return decoded_pnm(b)
    raise ValueError("format is not known")


def encoded(a: np.ndarray, kind: str) -> bytes:
    """A PNG, or a binary PGM or PPM, of (h, w) or (h, w, n) values in 8 bits."""
    if kind == "png":
        return png(a)
    if a.ndim == 3 and a.shape[2] not in (1, 3):
        raise ValueError("pgm and ppm have one or three channels")
    colour = a.ndim == 3 and a.shape[2] == 3
    head = b"P%d\n%d %d\n255\n" % (6 if colour else 5, a.shape[1], a.shape[0])
    return head + np.clip(np.floor(a + 0.5), 0, 255).astype(np.uint8).tobytes()


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), os.path.abspath(folder))


class Reader(DataSourceReader):
    def __init__(self, folder: str, suffix: str | None):
        self.folder, self.suffix = folder, suffix

    def partitions(self) -> list[Files]:
        system, at = _open(self.folder)
        infos = system.get_file_info(fs.FileSelector(at)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
        out, held = [Files([])], 0
        for info in sorted((i for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")) and i.base_name.endswith(self.suffix or "")), key=lambda i: i.path):
            if held + info.size > TOGETHER and out[-1].paths:
                out, held = [*out, Files([])], 0
            out[-1].paths.append(info.path)
            held += info.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _open(self.folder)
        for path in partition.paths:
            try:
                with system.open_input_stream(path) as f:
                    yield (path, *decoded(f.read()), None)
            except Exception as e:  # noqa: BLE001 - whatever a file holds, it is a row
                yield path, None, None, None, None, None, f"{type(e).__name__}: {e}"


class Writer(DataSourceWriter):
    """Tasks write to a folder of the job's own; commit moves their files, abort deletes the folder."""

    def __init__(self, folder: str, kind: str, overwrite: bool):
        self.folder, self.kind, self.overwrite = folder, kind, overwrite
        self.apart = f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, at = _open(self.folder)
        task, names = uuid.uuid4().hex, []
        system.create_dir(f"{at}/{self.apart}/{task}", recursive=True)
        for r in rows:
            a = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], r["channels"])
            name = f"{task}/{r['name']}.{self.kind}"
            with system.open_output_stream(f"{at}/{self.apart}/{name}") as f:
                f.write(encoded(a[:, :, 0] if r["channels"] == 1 else a, self.kind))
            names.append(name)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _open(self.folder)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(at)):
                if info.type == fs.FileType.File and info.base_name.endswith(f".{self.kind}"):
                    system.delete_file(info.path)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{at}/{self.apart}/{name}", f"{at}/{name.partition('/')[2]}")
        system.delete_dir(f"{at}/{self.apart}") if system.get_file_info(f"{at}/{self.apart}").type == fs.FileType.Directory else None

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _open(self.folder)
        if system.get_file_info(f"{at}/{self.apart}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.apart}")


class RasterFiles(DataSource):
    """Options: ``path``; reading: ``suffix`` of file names; writing: ``format`` (png, pgm, ppm), columns name, h, w, channels, data."""

    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("suffix"))

    def writer(self, schema, overwrite: bool) -> Writer:
        missing = {"name", "h", "w", "channels", "data"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        kind = self.options.get("format", "png")
        if kind not in ("png", "pgm", "ppm"):
            raise ValueError("format is png, pgm or ppm")
        return Writer(self.options["path"], kind, overwrite)


def images_as_rows(px: DataFrame) -> DataFrame:
    """One row (name, h, w, channels, data) for each image of pixels, as the sink takes them; values are rounded to 8 bits."""
    names = [n for n in ("v", "r", "g", "b", "a") if n in px.columns]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["h"].iloc[0]), int(rows["w"].iloc[0])
        a = np.zeros((h, w, len(names)))
        a[rows["y"], rows["x"]] = rows[names]
        data = np.clip(np.floor(a + 0.5), 0, 255).astype(np.uint8).tobytes()
        return pd.DataFrame({"name": [str(rows["image_id"].iloc[0])], "h": [h], "w": [w], "channels": [len(names)], "data": [data]})

    return px.select("image_id", "h", "w", "y", "x", *names).groupBy("image_id").applyInPandas(run, "name string, h int, w int, channels int, data binary")


def rows_as_images(files: DataFrame) -> DataFrame:
    """Pixels (image_id, path, h, w, y, x, v0 ... v3) of the files that could be read; gray files have v0 only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["image_id", "path", "h", "w", "y", "x", "v0", "v1", "v2", "v3"]
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], ">u2" if r["bits"] == 16 else np.uint8).reshape(r["h"], r["w"], r["channels"]).astype(float)
                y, x = np.mgrid[: r["h"], : r["w"]].astype(np.int32)
                n = y.size
                whole = [pa.array(np.full(n, r["image_id"])), pa.array([r["path"]] * n), pa.array(np.full(n, r["h"], np.int32)), pa.array(np.full(n, r["w"], np.int32))]
                values = [pa.array(a[:, :, k].ravel()) if k < r["channels"] else pa.nulls(n, pa.float64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(y.ravel()), pa.array(x.ravel()), *values], names=names)

    rows = files.where("error is null").select(F.xxhash64("path").alias("image_id"), "path", "h", "w", "channels", "bits", "data")
    return rows.mapInArrow(run, "image_id long, path string, h int, w int, y int, x int, v0 double, v1 double, v2 double, v3 double")
