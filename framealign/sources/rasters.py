"""Raw rasters and numpy arrays as DataFrames: Python data sources `raw_raster` and `npy_cube`.

Both split files into ranges of lines, seek to each and give long rows (product_id, band, line, sample, value, valid). Options: path,
lines, samples, offset, dtype, prefix, suffix (bytes around each line), stride, rows (lines per partition), product_id (of a single
file; else the name of each). Filters on line and sample are taken over by the reader, so a window of an image reads its lines only
and gives its samples only.

A path is a local one or a URI of any file system that Arrow knows (file, hdfs, s3, gs ...), a file, a folder or a pattern of names
(* and ?) in a folder, or several with commas between them. All tasks must reach it.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .cubes import npy_header

SCHEMA = "product_id string, band int, line int, sample int, value float, valid boolean"
ROWS = 256


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def files_of(path: str) -> list[tuple[str, int]]:
    """Files (as they can be opened again) and sizes of a path option."""
    out = []
    for one in path.split(","):
        folder, _, name = one.rpartition("/")
        pattern = any(c in name for c in "*?")  # in a URI these would mean something else
        system, place = file_system((folder or ".") if pattern else one)
        asked = folder if pattern else one
        head = asked[: len(asked) - len(place)] if asked.endswith(place) else ""
        info = system.get_file_info(place)
        if info.type == fs.FileType.File:
            out.append((one, info.size))
            continue
        for found in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if found.type == fs.FileType.File and fnmatch.fnmatch(found.base_name, name if pattern else "*") and not found.base_name.startswith((".", "_")):
                out.append((head + found.path, found.size))
    if not out:
        raise FileNotFoundError(f"no file at {path}")
    return sorted(out)


def read_range(path: str, start: int, size: int) -> bytes:
    system, place = file_system(path)
    with system.open_input_file(place) as f:
        f.seek(start)
        return f.read(size)


class Lines(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    positive = True

    def __init__(self, options: dict):
        self.files = files_of(options["path"])
        self.stride, self.rows = max(1, int(options.get("stride", 1))), max(1, int(options.get("rows", ROWS)))
        self.named = options.get("product_id") if len(self.files) == 1 else None
        self.low, self.high = {"line": 0, "sample": 0}, {"line": 1 << 62, "sample": 1 << 62}

    def product(self, path: str) -> str:
        return self.named or os.path.splitext(path.rsplit("/", 1)[-1])[0].upper()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of line and sample narrow the ranges; every filter is still checked by Spark."""
        for f in filters:
            name = (getattr(f, "attribute", None) or ("",))[0]
            if name in self.low:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low[name] = max(self.low[name], int(f.value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high[name] = min(self.high[name], int(f.value) + 1)
            yield f

    def lines(self, path: str) -> int:
        raise NotImplementedError

    def block(self, path: str, start: int, stop: int) -> np.ndarray:
        """Values (band, line, sample) of a range of lines."""
        raise NotImplementedError

    def partitions(self) -> list[Lines]:
        out = []
        for path, _ in self.files:
            high = min(self.lines(path), self.high["line"])
            out += [Lines(path, s, min(s + self.rows, high)) for s in range(self.low["line"], high, self.rows)]
        return out

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        first = -(-self.low["sample"] // self.stride) * self.stride
        for start in range(part.start, part.stop, 32):
            stop = min(start + 32, part.stop)
            wanted = [k for k in range(start, stop) if k % self.stride == 0]
            if not wanted:
                continue
            whole = self.block(part.path, start, stop)
            values = whole[:, [k - start for k in wanted], first : min(self.high["sample"], whole.shape[2]) : self.stride].astype(np.float32)
            bands, n, m = values.shape
            flat = values.ravel()
            yield pa.record_batch(
                [pa.array([self.product(part.path)] * len(flat), pa.string()), pa.array(np.repeat(np.arange(bands, dtype=np.int32), n * m)), pa.array(np.tile(np.repeat(np.array(wanted, np.int32), m), bands)),
                 pa.array(np.tile(first + np.arange(0, m * self.stride, self.stride, dtype=np.int32), bands * n).astype(np.int32)), pa.array(flat), pa.array(np.isfinite(flat) & (flat > 0 if self.positive else True))],
                names=["product_id", "band", "line", "sample", "value", "valid"],
            )


class RawReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.count, self.samples = int(options["lines"]), int(options["samples"])
        self.dtype, self.offset = np.dtype(options["dtype"]), int(options.get("offset", 0))
        self.prefix, self.suffix = int(options.get("prefix", 0)), int(options.get("suffix", 0))
        self.step = self.prefix + self.samples * self.dtype.itemsize + self.suffix
        if self.count <= 0 or self.samples <= 0:
            raise ValueError("lines and samples must be positive")
        for path, size in self.files:
            if size < self.offset + self.step * self.count - self.suffix:
                raise ValueError(f"the file is shorter than its declared raster: {path}")

    def lines(self, path: str) -> int:
        return self.count

    def block(self, path: str, start: int, stop: int) -> np.ndarray:
        raw = read_range(path, self.offset + start * self.step, (stop - start) * self.step).ljust((stop - start) * self.step, b"\0")
        rows = np.frombuffer(raw, np.uint8).reshape(stop - start, self.step)[:, self.prefix : self.prefix + self.samples * self.dtype.itemsize]
        return np.ascontiguousarray(rows).view(self.dtype)[None]


class CubeReader(_Reader):
    """.npy arrays; of three axes the smallest first or last one is the band axis."""

    positive = False

    def __init__(self, options: dict):
        super().__init__(options)
        self.about = {}
        for path, _ in self.files:
            head = read_range(path, 0, 4096)
            kind, shape, error = npy_header(head)
            if error or "'fortran_order': True" in head[:256].decode("latin-1"):
                raise ValueError(f"{path}: {error or 'columns first'}")
            if len(shape) not in (2, 3):
                raise ValueError("an array of two or three axes is needed")
            start = 12 + int.from_bytes(head[8:12], "little") if head[6] >= 2 else 10 + int.from_bytes(head[8:10], "little")
            self.about[path] = np.dtype(kind), shape, start, len(shape) == 3 and shape[2] < shape[0]

    def lines(self, path: str) -> int:
        _, shape, _, last = self.about[path]
        return shape[0] if last or len(shape) == 2 else shape[1]

    def block(self, path: str, start: int, stop: int) -> np.ndarray:
        kind, shape, at, last = self.about[path]

        def rows(first: int, n: int, per: list[int]) -> np.ndarray:
            size = prod(per) * kind.itemsize
            return np.frombuffer(read_range(path, at + first * size, n * size), kind).reshape(n, *per)

        if len(shape) == 2:
            return rows(start, stop - start, shape[1:])[None]
        if last:
            return np.moveaxis(rows(start, stop - start, shape[1:]), 2, 0)
        return np.stack([rows(band * shape[1] + start, stop - start, shape[2:]) for band in range(shape[0])])


class RawRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return RawReader(self.options)


class NpyCube(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_cube"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return CubeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let it hand them its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (RawRaster, NpyCube):
        spark.dataSource.register(source)


#: Reader of each file ending; None: known, but not decoded.
READERS = {"npy": "npy_cube", "img": "raw_raster", "raw": "raw_raster", "dat": "raw_raster", "tif": None, "tiff": None, "png": None, "jpg": None, "jpeg": None, "webp": None, "bmp": None}


def load(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Pixels of files of several formats as one table; sources: options of each (path and, for raw rasters, their byte layout).

    Arrays are one read; raw rasters of the same layout are one read too. A file that no reader decodes is an error.
    """
    register(spark)
    reads: dict[tuple, list[str]] = {}
    for options in sources:
        ending = options["path"].rsplit(".", 1)[-1].lower()
        kind = READERS.get(ending)
        if kind is None:
            raise ValueError(f"{options['path']}: {'not decoded' if ending in READERS else 'unknown kind of file'}")
        layout = tuple(sorted((k, str(v)) for k, v in options.items() if k != "path"))
        reads.setdefault((kind, layout), []).append(options["path"])
    parts = [spark.read.format(kind).options(path=",".join(paths), **dict(layout)).load() for (kind, layout), paths in reads.items()]
    if not parts:
        raise ValueError("no sources")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def preview_stride(lines: int, samples: int, most: int = 2048) -> int:
    return max(1, -(-max(lines, samples) // most))


def bounded_reads(pixels, lines: int):  # noqa: ANN001, ANN201
    """First, middle and last line, 64 samples each: line, n, all_finite, lo, hi. The filter reaches the reader."""
    from pyspark.sql import functions as F

    some = pixels.filter(F.col("line").isin(0, lines // 2, lines - 1) & (F.col("sample") < 64))
    return some.groupBy("product_id", "line").agg(F.count("value").alias("n"), F.bool_and(~F.isnan("value")).alias("all_finite"), F.min("value").alias("lo"), F.max("value").alias("hi"))
