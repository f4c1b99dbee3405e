"""Volume files as voxel tables: NIfTI-1 and NIfTI-2 (.nii, .nii.gz), NPY, and raw bytes with a JSON sidecar; and NIfTI output.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reads will do; a file is one row (2 GB at most).
"""

from __future__ import annotations

import gzip
import io
import json
import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: NIfTI-1 datatype codes.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
MICRON = 3
#: Bytes before the voxels of NIfTI-1 and NIfTI-2, whose sizes are of 16 and 64 bits; the second's mark.
HEADS, NIFTI2 = (352, 544), b"n+2\0\r\n\x1a\n"
SCHEMA = "volume_id string, z int, y int, x int, value float"
HEADER = "volume_id string, nz int, ny int, nx int, dtype string, affine array<double>, zooms array<double>, unit int, qform int, sform int"


def quaternion_matrix(b: float, c: float, d: float, zooms: list[float], qfac: float) -> np.ndarray:
    """Rotation by a unit quaternion, scaled to the spacing; the third axis is reversed where ``qfac`` is negative."""
    a = max(0.0, 1.0 - b * b - c * c - d * d) ** 0.5
    turn = np.array(
        [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
    )
    return turn * np.array([zooms[0], zooms[1], zooms[2] * (-1 if qfac < 0 else 1)])


def quaternion_of(matrix: np.ndarray) -> tuple[float, tuple[float, float, float]]:
    """qfac and the quaternion (b, c, d) of the nearest rotation to the directions of a 3x3 matrix."""
    turn = matrix / np.sqrt((matrix**2).sum(axis=0))
    u, _, v = np.linalg.svd(turn)
    turn = u @ v
    qfac = 1.0 if np.linalg.det(turn) > 0 else -1.0
    turn = turn * np.array([1, 1, qfac])
    # The quaternion is the main eigenvector of this symmetric form of the rotation.
    (xx, xy, xz), (yx, yy, yz), (zx, zy, zz) = turn
    form = np.array([[xx + yy + zz, zy - yz, xz - zx, yx - xy], [zy - yz, xx - yy - zz, yx + xy, zx + xz], [xz - zx, yx + xy, yy - xx - zz, zy + yz], [yx - xy, zx + xz, zy + yz, zz - xx - yy]])
    q = np.linalg.eigh(form)[1][:, -1]
    q = -q if q[0] < 0 else q
    return qfac, (float(q[1]), float(q[2]), float(q[3]))


def target_affine(affine: list[float], shape: list[int], new_shape: list[int], spacing: float) -> list[float]:
    """Flattened affine of a grid of ``spacing`` that keeps the axes' directions and the centre; singular axes are an error."""
    m = np.array(affine, float).reshape(4, 4)
    length = np.sqrt((m[:3, :3] ** 2).sum(axis=0))
    if not np.isfinite(m).all() or (length <= 0).any() or np.linalg.det(m[:3, :3]) == 0:
        raise ValueError("the affine's axes must be finite and independent")
    if not (np.isfinite(spacing) and spacing > 0) or min(*shape, *new_shape) < 1:
        raise ValueError("spacing and sizes must be positive")
    out = np.eye(4)
    out[:3, :3] = m[:3, :3] / length * spacing
    middle = m[:3, :3] @ ((np.array(shape) - 1) / 2) + m[:3, 3]
    out[:3, 3] = middle - out[:3, :3] @ ((np.array(new_shape) - 1) / 2)
    return out.ravel().tolist()


class NiftiHeader(NamedTuple):
    shape: tuple[int, int, int]
    dtype: str
    offset: int
    scale: tuple[float, float]
    affine: list[float]
    zooms: list[float]
    unit: int
    qform: int
    sform: int


def nifti_header(data: bytes) -> NiftiHeader:
    """What the first 544 bytes of a 3-D NIfTI file say (352 of NIfTI-1); the affine is that of the sform, else of the qform, else of the spacing."""
    order = "<" if len(data) >= 348 and struct.unpack("<i", data[:4])[0] in (348, 540) else ">"
    second = len(data) >= 540 and struct.unpack(order + "i", data[:4])[0] == 540 and data[4:12] in (NIFTI2, b"ni2" + NIFTI2[3:])
    if not second and (len(data) < 348 or struct.unpack(order + "i", data[:4])[0] != 348 or data[344:347] not in (b"n+1", b"ni1")):
        raise ValueError("not a NIfTI-1 file, nor a NIfTI-2 file")
    dim = struct.unpack(order + "8q", data[16:80]) if second else struct.unpack(order + "8h", data[40:56])
    shape = [d for d in dim[1 : dim[0] + 1]]
    while len(shape) > 3 and shape[-1] == 1:
        shape.pop()
    if len(shape) != 3 or min(shape) < 1:
        raise ValueError(f"a volume has three axes that are not empty, not {shape}")
    code = struct.unpack_from(order + "h", data, 12 if second else 70)[0]
    if code not in DTYPES:
        raise ValueError(f"datatype {code} is not read")
    real, qfac_at, sform_at, qform_at = ("d", 104, 400, 352) if second else ("f", 76, 280, 256)
    qfac, *zooms = struct.unpack_from(order + "4" + real, data, qfac_at)
    offset, slope, inter = struct.unpack_from(order + ("q2d" if second else "3f"), data, 168 if second else 108)
    qform, sform = struct.unpack_from(order + ("2i" if second else "2h"), data, 344 if second else 252)
    unit = struct.unpack_from(order + "i", data, 500)[0] if second else data[123]
    matrix = np.eye(4)
    if sform > 0:
        matrix[:3] = np.array(struct.unpack_from(order + "12" + real, data, sform_at)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *origin = struct.unpack_from(order + "6" + real, data, qform_at)
        matrix[:3, :3] = quaternion_matrix(b, c, d, zooms, qfac)
        matrix[:3, 3] = origin
    else:
        matrix[:3, :3] = np.diag(zooms)
    scale = (slope, inter) if slope not in (0.0, 1.0) or inter and slope else (1.0, 0.0)
    return NiftiHeader(tuple(shape), order + DTYPES[code], int(offset), scale, matrix.ravel().tolist(), zooms, unit & 7, qform, sform)


def parse_nifti(data: bytes) -> tuple[np.ndarray, list[float], list[float], int, int, int]:
    """Array, flattened affine, zooms, unit, qform and sform codes of a 3-D NIfTI file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    h = nifti_header(data[: HEADS[1]])
    out = np.frombuffer(data, h.dtype, int(np.prod(h.shape)), h.offset).reshape(h.shape, order="F")
    if h.scale != (1.0, 0.0):
        out = out * h.scale[0] + h.scale[1]
    return out, h.affine, h.zooms, h.unit, h.qform, h.sform


def nifti_head(shape: Sequence[int], dtype: np.dtype, affine: list[float], unit: int = MICRON, qform: int = 0, sform: int = 2) -> bytes:
    """The bytes before the voxels, with the affine as sform, and as qform where its code is not 0: 352 of NIfTI-1, or, as its sizes
    end at 32,767, 544 of NIfTI-2 for a longer axis."""
    code = next(k for k, v in DTYPES.items() if np.dtype(v) == dtype)
    matrix = np.array(affine, float).reshape(4, 4)
    zooms = np.sqrt((matrix[:3, :3] ** 2).sum(axis=0))
    qfac, quaternion = quaternion_of(matrix[:3, :3]) if qform > 0 else (1.0, (0.0, 0.0, 0.0))
    if max(shape) > 32_767:
        head = bytearray(HEADS[1])
        struct.pack_into("<i8s2h8q", head, 0, 540, NIFTI2, code, dtype.itemsize * 8, 3, *shape, 1, 1, 1, 1)
        struct.pack_into("<8dq2d", head, 104, qfac, *zooms, 0, 0, 0, 0, HEADS[1], 1, 0)
        struct.pack_into("<2i", head, 344, qform, sform)
        if qform > 0:
            struct.pack_into("<6d", head, 352, *quaternion, *matrix[:3, 3])
        if sform > 0:
            struct.pack_into("<12d", head, 400, *matrix[:3].ravel())
        struct.pack_into("<i", head, 500, unit)
        return bytes(head)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, qfac, *zooms, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[123] = unit
    struct.pack_into("<2h", head, 252, qform, sform)
    if qform > 0:
        struct.pack_into("<6f", head, 256, *quaternion, *matrix[:3, 3])
    if sform > 0:
        struct.pack_into("<12f", head, 280, *matrix[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head)


def nifti_bytes(array: np.ndarray, affine: list[float], unit: int = MICRON, qform: int = 0, sform: int = 2) -> bytes:
    """A gzipped NIfTI file; deterministic."""
    head = nifti_head(array.shape, array.dtype, affine, unit, qform, sform)
    return gzip.compress(head + array.astype(array.dtype.newbyteorder("<")).tobytes(order="F"), mtime=0)


def _array(path: str, data: bytes, sidecars: dict[str, dict], spacing: float = 1.0) -> tuple[np.ndarray, list[float], list[float], int, int, int]:
    if path.endswith((".nii", ".nii.gz")):
        return parse_nifti(data)
    if path.endswith(".npy"):
        out = np.load(io.BytesIO(data), allow_pickle=False)
    else:
        spec = sidecars.get(path.rsplit("/", 1)[-1])
        if spec is None:
            raise ValueError(f"{path} has no JSON sidecar with dtype and shape")
        out = np.frombuffer(data, spec["dtype"]).reshape(spec["shape"])
    if out.ndim != 3 or out.size == 0:
        raise ValueError(f"{path} is no 3-D volume")
    return out, np.diag([spacing] * 3 + [1.0]).ravel().tolist(), [spacing] * 3, MICRON, 0, 0


def volume_name(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    for end in (".nii.gz", ".nii", ".npy", ".raw"):
        name = name.removesuffix(end)
    return name


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sidecar: the volume files, each with the text of ``<file>.json`` beside it, if there is one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    side = files.where("path like '%.json'").select(F.expr("left(path, length(path) - 5)").alias("path"), F.col("content").cast("string").alias("sidecar"))
    return files.where("path not like '%.json'").join(side, "path", "left")


def _known(file: str, sidecar: str | None, given: dict[str, dict]) -> dict[str, dict]:
    return given if sidecar is None else given | {file.rsplit("/", 1)[-1]: json.loads(sidecar)}


def read_volumes(spark: SparkSession, path: str, sidecars: dict[str, dict] | None = None) -> DataFrame:
    """volume_id, z, y, x, value: every voxel of the files, one plane at a time.

    A raw file's dtype and shape come from ``<file>.json`` beside it, or from ``sidecars`` (file name -> dtype and shape).
    """
    return voxels_in(_files(spark, path), sidecars)


def voxels_in(files: DataFrame, sidecars: dict[str, dict] | None = None) -> DataFrame:
    """The same of a table of files: path, content, sidecar (a JSON text, or null)."""
    given = sidecars or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data, side in zip(*(batch.column(i).to_pylist() for i in range(3))):
                array = _array(file, data, _known(file, side, given))[0]
                y, x = (c.ravel().astype(np.int32) for c in np.indices(array.shape[1:]))
                for z, plane in enumerate(array):
                    columns = [pa.array([volume_name(file)] * y.size), pa.array(np.full(y.size, z, np.int32)), pa.array(y), pa.array(x), pa.array(plane.ravel().astype(np.float32))]
                    yield pa.RecordBatch.from_arrays(columns, ["volume_id", "z", "y", "x", "value"])

    return files.select("path", "content", "sidecar").mapInArrow(run, SCHEMA)


def read_headers(spark: SparkSession, path: str, sidecars: dict[str, dict] | None = None, spacing: float = 1.0) -> DataFrame:
    """volume_id, nz, ny, nx, dtype, affine (16 numbers by rows), zooms, unit, qform, sform of the files.

    NPY and raw files have no header: their voxels are cubes of ``spacing``.
    """
    given = sidecars or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, data, side in zip(batch["path"], batch["content"], batch["sidecar"]):
                array, affine, zooms, *codes = _array(file, bytes(data), _known(file, side, given), spacing)
                rows.append((volume_name(file), *array.shape, array.dtype.name, affine, zooms, *codes))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])

    return _files(spark, path).mapInPandas(run, HEADER)


def to_nifti(voxels: DataFrame, volumes: DataFrame, value: str = "value", dtype: str = "f4") -> DataFrame:
    """volume_id, content: a NIfTI file per volume (dense from the sizes in ``volumes``; absent voxels are 0) with the affine, unit and
    codes of the header rows in ``volumes`` (as ``read_headers`` gives them; without codes: sform 2, micron).

    A voxel outside its volume's size is an error.  A file holds a whole volume, so a volume is gathered in one task here, and
    only here.
    """
    codes = {"unit": MICRON, "qform": 0, "sform": 2}
    head = [F.col(c) if c in volumes.columns else F.lit(v).alias(c) for c, v in codes.items()]
    places = [F.collect_list(F.col(c).cast("int")).alias(c) for c in ("y", "x")]
    planes = voxels.groupBy("volume_id", "z").agg(*places, F.collect_list(F.col(value).cast("double")).alias("v"))
    joined = volumes.select("volume_id", "nz", "ny", "nx", "affine", *head).join(planes, "volume_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        out = np.zeros((first.nz, first.ny, first.nx), dtype)
        for z, y, x, v in zip(pdf["z"], pdf["y"], pdf["x"], pdf["v"]):
            if y is None:
                continue
            y, x = np.asarray(y), np.asarray(x)
            if not 0 <= z < first.nz or min(y.min(), x.min()) < 0 or y.max() >= first.ny or x.max() >= first.nx:
                raise ValueError(f"{first.volume_id} has voxels outside its size")
            out[int(z), y, x] = v
        return pd.DataFrame({"volume_id": [first.volume_id], "content": [nifti_bytes(out, list(first.affine), int(first.unit), int(first.qform), max(1, int(first.sform)))]})

    return joined.groupBy("volume_id").applyInPandas(run, "volume_id string, content binary")
