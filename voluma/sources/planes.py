"""Volume files read by ranges: a Spark data source whose partitions are ranges of a file's slowest axis.

Only headers are read to plan a scan, and a task reads the bytes of its own range and nothing else; a scan's bounds of coordinates and
names of volumes cut ranges and files before anything is read.  They are arguments of the scan: conditions that Spark 4.1 pushes
into a Python source are shared by all uses of the same DataFrame, which makes a union of two of them wrong.  Compressed files can't
be entered in the middle: such a file is one partition that is decompressed as a stream, plane by plane.  Paths are those of
pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import io
import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .volumes import HEADER, HEADS, MICRON, nifti_header, volume_name

VOXELS = "volume_id string, path string, z int, y int, x int, value float"
HEADERS = f"path string, {HEADER}"
ENDINGS = (".nii", ".nii.gz", ".npy", ".raw")
AXES = ("z", "y", "x")


@dataclass
class Layout:
    """Where a file's voxels are: sizes by z, y, x, the type, the offset of the first, and whether z is the slowest axis (else x)."""

    path: str
    shape: tuple[int, int, int]
    dtype: str
    offset: int
    z_slowest: bool
    scale: tuple[float, float]
    affine: list[float]
    zooms: list[float]
    unit: int
    qform: int
    sform: int

    @property
    def compressed(self) -> bool:
        return self.path.endswith(".gz")

    @property
    def slow(self) -> str:
        return "z" if self.z_slowest else "x"

    @property
    def plane_bytes(self) -> int:
        n = self.shape[0] if self.z_slowest else self.shape[2]
        return math.prod(self.shape) // n * np.dtype(self.dtype).itemsize

    def row(self) -> tuple:
        return (self.path, volume_name(self.path), *self.shape, np.dtype(self.dtype).name, self.affine, self.zooms, self.unit, self.qform, self.sform)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The volume files at a path: itself, or all those below a folder, by name."""
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.split(":", 1)[0] + "://"
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.type == pafs.FileType.File]
    return [prefix + f for f in sorted(found) if f.endswith(ENDINGS) and not any(p.startswith(("_", ".")) for p in f[len(inner) :].split("/"))]


def read_range(file: pa.NativeFile, offset: int, size: int) -> bytes:
    """All bytes of a range; a file that ends before is an error."""
    data = file.read_at(size, offset)
    if len(data) < size:
        raise ValueError(f"a file ends {size - len(data)} bytes early")
    return data


def layout_of(path: str, spacing: float = 1.0) -> Layout:
    """The layout of a file, by its header alone."""
    fs, inner = file_system(path)
    if path.endswith((".nii", ".nii.gz")):
        if path.endswith(".gz"):
            with fs.open_input_stream(inner, compression="gzip") as f:
                head = f.read(HEADS[1])
        else:
            with fs.open_input_file(inner) as f:
                head = f.read_at(HEADS[1], 0)
        h = nifti_header(head)
        return Layout(path, h.shape, h.dtype, h.offset, False, h.scale, h.affine, h.zooms, h.unit, h.qform, h.sform)
    affine, zooms = np.diag([spacing] * 3 + [1.0]).ravel().tolist(), [spacing] * 3
    if path.endswith(".npy"):
        with fs.open_input_file(inner) as f:
            size = struct.unpack("<I", read_range(f, 8, 4))[0] if read_range(f, 6, 1) > b"\x01" else struct.unpack("<H", read_range(f, 8, 2))[0]
            head = io.BytesIO(read_range(f, 0, size + (12 if read_range(f, 6, 1) > b"\x01" else 10)))
        version = np.lib.format.read_magic(head)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        if dtype.hasobject:
            raise ValueError(f"{path} holds objects")
        offset, kind = head.tell(), dtype.str
    else:
        side, side_inner = file_system(f"{path}.json")
        with side.open_input_stream(side_inner) as f:
            spec = json.loads(f.read())
        shape, fortran, kind, offset = spec["shape"], False, np.dtype(spec["dtype"]).str, 0
    if len(shape) != 3 or min(shape) < 1:
        raise ValueError(f"{path} is no 3-D volume")
    return Layout(path, tuple(shape), kind, offset, not fortran, (1.0, 0.0), affine, zooms, MICRON, 0, 0)


@dataclass
class Range(InputPartition):
    layout: Layout
    first: int
    last: int

    def __init__(self, layout: Layout, first: int, last: int):
        super().__init__(None)
        self.layout, self.first, self.last = layout, first, last


def planes_of(part: Range) -> Iterator[tuple[int, np.ndarray]]:
    """The planes of a range along the slow axis, each by the two other axes in the order of z, y, x."""
    at, fs_path = part.layout, file_system(part.layout.path)
    fs, inner = fs_path
    nz, ny, nx = at.shape
    sides = (ny, nx) if at.z_slowest else (ny, nz)

    def plane(data: bytes) -> np.ndarray:
        out = np.frombuffer(data, at.dtype).reshape(sides)
        out = out if at.z_slowest else out.T
        return out if at.scale == (1.0, 0.0) else out * at.scale[0] + at.scale[1]

    size = at.plane_bytes
    if not at.compressed:
        with fs.open_input_file(inner) as f:
            for i in range(part.first, part.last + 1):
                yield i, plane(read_range(f, at.offset + i * size, size))
        return
    with fs.open_input_stream(inner, compression="gzip") as f:
        left = at.offset + part.first * size
        while left:
            step = len(f.read(min(left, 1 << 20)))
            if not step:
                raise ValueError(f"{at.path} ends early")
            left -= step
        for i in range(part.first, part.last + 1):
            data = f.read(size)
            if len(data) < size:
                raise ValueError(f"{at.path} ends early")
            yield i, plane(data)


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.spacing, self.size = float(options.get("spacing", 1.0)), int(options.get("bytes", 32 << 20))
        self.headers = options.get("content", "voxels") == "headers"
        within = json.loads(options.get("within", "{}"))
        self.bounds = {a: within.get(a, [None, None]) for a in AXES}
        self.volumes = set(json.loads(options["volumes"])) if "volumes" in options else None

    def partitions(self) -> list[InputPartition]:
        found = [p for path in self.paths for p in listed(path)]
        found = [p for p in found if self.volumes is None or volume_name(p) in self.volumes]
        if self.headers:
            return [InputPartition(p) for p in found]
        out: list[InputPartition] = []
        for p in found:
            at = layout_of(p, self.spacing)
            ends = {a: (max(0, self.bounds[a][0] or 0), n - 1 if self.bounds[a][1] is None else min(n - 1, self.bounds[a][1])) for a, n in zip(AXES, at.shape)}
            if any(low > high for low, high in ends.values()):
                continue
            first, last = ends[at.slow]
            step = last - first + 1 if at.compressed else max(1, self.size // at.plane_bytes)
            out += [Range(at, i, min(last, i + step - 1)) for i in range(first, last + 1, step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple | pa.RecordBatch]:
        if self.headers:
            if partition is not None:
                yield layout_of(partition.value, self.spacing).row()
            return
        if not isinstance(partition, Range):
            return
        at, name = partition.layout, volume_name(partition.layout.path)
        sides = [a for a in AXES if a != at.slow]
        cut = tuple(slice(self.bounds[a][0] or 0, None if self.bounds[a][1] is None else self.bounds[a][1] + 1) for a in sides)
        for i, plane in planes_of(partition):
            a, b = (c[cut].ravel().astype(np.int32) for c in np.indices(plane.shape))
            plane = plane[cut]
            fixed = np.full(a.size, i, np.int32)
            z, y, x = (fixed, a, b) if at.z_slowest else (a, b, fixed)
            texts = [pa.array([t] * a.size, pa.string()) for t in (name, at.path)]
            yield pa.RecordBatch.from_arrays([*texts, *map(pa.array, (z, y, x)), pa.array(plane.ravel().astype(np.float32))], [c.split()[0] for c in VOXELS.split(", ")])


class VolumeSource(DataSource):
    """format("volume"): options path (file or folder) or paths (a JSON list), bytes (of a range), spacing (of files without a header),
    content (voxels or headers), within (JSON: axis -> first and last place, null for none) and volumes (a JSON list of names)."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return HEADERS if self.options.get("content", "voxels") == "headers" else VOXELS

    def reader(self, schema) -> DataSourceReader:
        return VolumeReader(dict(self.options))


Bounds = dict[str, tuple[int | None, int | None]]


def _source(spark: SparkSession, path: str | list[str], volumes: list[str] | None, **options: str | int | float) -> DataFrame:
    spark.dataSource.register(VolumeSource)
    given = {"path": path} if isinstance(path, str) else {"paths": json.dumps(path)}
    given |= {} if volumes is None else {"volumes": json.dumps(volumes)}
    return spark.read.format("volume").options(**given, **options).load()


def scan_voxels(spark: SparkSession, path: str | list[str], within: Bounds | None = None, volumes: list[str] | None = None, range_bytes: int = 32 << 20, spacing: float = 1.0) -> DataFrame:
    """volume_id, path, z, y, x, value of the voxels of the files at ``path``; ``within`` (axis -> first and last place, None for no
    bound) and ``volumes`` limit what is read."""
    return _source(spark, path, volumes, bytes=range_bytes, spacing=spacing, within=json.dumps(within or {}))


def scan_headers(spark: SparkSession, path: str | list[str], volumes: list[str] | None = None, spacing: float = 1.0) -> DataFrame:
    """path and the header row (see ``volumes.HEADER``) of every file, read from its first bytes, a task per file."""
    return _source(spark, path, volumes, content="headers", spacing=spacing)
