"""Files that belong together, published together: a Spark data source that writes whole files, and volumes and cases written by it.

Tasks write the pieces of files that they are given into a staging folder beside the target; only when all tasks are done does the
driver put the files of the winning attempts together under their names and rename the folder, so a reader finds all files of a
write or none.  Volumes are written in pieces (each a gzip member of some planes), so no task holds a volume.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .planes import file_system
from .results import finite
from .volumes import MICRON, nifti_head

FILES = "file string, part int, content binary"
#: Voxels of a part of a volume's file, which a task holds at once; a part has one plane at least.
PART = 1 << 19


@dataclass
class Written(WriterCommitMessage):
    """The staged files of one task: name and place."""

    files: list[tuple[str, str]]


class BundleWriter(DataSourceWriter):
    """Rows (file, part, content): a file is the contents of its parts in order; the parts of a file come to one task."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}.{uuid.uuid4().hex}.staging"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, base = file_system(self.staging)
        own, files, out = f"{base}/{uuid.uuid4().hex}", [], None
        last: tuple[str, int] | None = None
        try:
            for row in iterator:
                name, part = row.file, row.part
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} is no name of a file below the target")
                if last is None or last[0] != name:
                    if out is not None:
                        out.close()
                    place = f"{own}/{len(files)}"
                    fs.create_dir(own, recursive=True)
                    out, expected = fs.open_output_stream(place), 0
                    files.append((name, place))
                if part != expected:
                    raise ValueError(f"{name} has part {part} where part {expected} should be")
                out.write(row.content)
                last, expected = (name, part), expected + 1
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, target = file_system(self.path)
        _, staging = file_system(self.staging)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for name, _ in files]
        if len(set(names)) < len(names):
            raise ValueError("a file was written by more than one task")
        ready = f"{staging}/ready"
        fs.create_dir(ready, recursive=True)
        for folder in sorted({n.rsplit("/", 1)[0] for n in names if "/" in n}):
            fs.create_dir(f"{ready}/{folder}", recursive=True)
        for name, place in files:
            fs.move(place, f"{ready}/{name}")
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            if not self.overwrite:
                raise FileExistsError(self.path)
            fs.delete_dir(target)
        fs.move(ready, target)
        fs.delete_dir(staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, staging = file_system(self.staging)
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class BundleSource(DataSource):
    """format("bundle"): option path, the folder of the files."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        fs, inner = file_system(path)
        if not overwrite and fs.get_file_info(inner).type != pafs.FileType.NotFound:
            raise FileExistsError(path)
        return BundleWriter(path, overwrite)


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Publish rows (file, part, content) as files below ``path``: all of them or none.  A path that exists is an error unless
    ``overwrite``; so is a part that is missing."""
    files.sparkSession.dataSource.register(BundleSource)
    rows = files.select("file", F.col("part").cast("int").alias("part"), "content").repartition("file").sortWithinPartitions("file", "part")
    rows.write.format("bundle").mode("overwrite" if overwrite else "append").save(path)


def volume_parts(voxels: DataFrame, volumes: DataFrame, value: str = "value", dtype: str = "f4", planes: int = 16) -> DataFrame:
    """volume_id, part, content: a gzipped NIfTI file per volume in parts, the header and then some planes of its slowest axis (x) each,
    ``planes`` of them or as many as have PART voxels.

    Volumes are dense from the sizes in ``volumes`` (with affine and, if they are there, unit, qform and sform; else micron, 0 and
    2); absent voxels are 0, a voxel outside its volume's size is an error.
    """
    given = {"unit": MICRON, "qform": 0, "sform": 2}
    codes = [F.col(c).cast("int") if c in volumes.columns else F.lit(v).alias(c) for c, v in given.items()]
    each = F.greatest(F.lit(1), F.least(F.lit(planes), F.floor(F.lit(PART) / (F.col("nz").cast("long") * F.col("ny"))))).cast("int").alias("_each")
    heads = volumes.select("volume_id", "nz", "ny", "nx", "affine", each, *codes)
    last = F.ceil(F.col("nx") / F.col("_each")).cast("int") - 1
    ranges = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(last > 0, last).otherwise(0))))
    inside = (F.col("z") >= 0) & (F.col("z") < F.col("nz")) & (F.col("y") >= 0) & (F.col("y") < F.col("ny")) & (F.col("x") >= 0) & (F.col("x") < F.col("nx"))
    wrong = F.raise_error(F.concat(F.col("volume_id").cast("string"), F.lit(" has voxels outside its size"))).cast("int")
    sizes = volumes.select(F.col("volume_id").alias("_id"), "nz", "ny", "nx", each)
    rows = voxels.select(F.col("volume_id").alias("_own"), "z", "y", "x", F.col(value).cast("double").alias("v")).join(F.broadcast(sizes), F.col("_own") == F.col("_id"))
    placed = rows.withColumnRenamed("_own", "volume_id").drop("_id")
    placed = placed.select("volume_id", F.when(inside, F.floor(F.col("x") / F.col("_each")).cast("int")).otherwise(wrong).alias("part"), "z", "y", "x", "v")
    kind = np.dtype(dtype)

    def run(own: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"volume_id": [], "part": [], "content": []})
        h = own.iloc[0]
        first, count = int(h.part) * int(h._each), min(int(h._each), int(h.nx) - int(h.part) * int(h._each))
        out = np.zeros((int(h.nz), int(h.ny), count), kind)
        out[there["z"], there["y"], there["x"] - first] = there["v"]
        content = gzip.compress(out.astype(kind.newbyteorder("<")).tobytes(order="F"), mtime=0)
        if h.part == 0:
            size = (int(h.nz), int(h.ny), int(h.nx))
            content = gzip.compress(nifti_head(size, kind, list(h.affine), int(h.unit), int(h.qform), max(1, int(h.sform))), mtime=0) + content
        return pd.DataFrame({"volume_id": [h.volume_id], "part": [h.part], "content": [content]})

    id_type = dict(volumes.dtypes)["volume_id"]
    return ranges.groupBy("volume_id", "part").cogroup(placed.groupBy("volume_id", "part")).applyInPandas(run, f"volume_id {id_type}, part int, content binary")


def sorted_json(document: Column) -> Column:
    """A JSON text with keys by name at every level and an indent of two."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), indent=2, sort_keys=True, ensure_ascii=False) + "\n")

    return run(F.to_json(document, {"ignoreNullFields": "false"}))


def case_files(scores: DataFrame, masks: DataFrame, volumes: DataFrame, records: DataFrame, path: str, planes: int = 16) -> DataFrame:
    """file, part, content: per volume ``<id>_score.nii.gz`` (single precision), ``<id>_mask.nii.gz`` (bytes) and ``<id>_metadata.json``:
    its row of ``records`` (volume_id and any columns; NaN and infinity are errors) with ``outputs``, the paths of the other two."""
    records = finite(records)
    named = [F.concat(F.col("volume_id").cast("string"), F.lit(f"_{k}.nii.gz")) for k in ("score", "mask")]
    parts = [volume_parts(scores, volumes, "value", "f4", planes).select(named[0].alias("file"), "part", "content")]
    parts.append(volume_parts(masks, volumes, "value", "u1", planes).select(named[1].alias("file"), "part", "content"))
    at = path.rstrip("/")
    outputs = F.struct(*[F.concat(F.lit(f"{at}/"), n).alias(k) for k, n in zip(("score", "mask"), named)]).alias("outputs")
    document = F.struct(*[F.col(c) for c in records.columns if c not in ("volume_id", "outputs")], outputs)
    name = F.concat(F.col("volume_id").cast("string"), F.lit("_metadata.json"))
    parts.append(records.select(name.alias("file"), F.lit(0).alias("part"), F.encode(sorted_json(document), "UTF-8").alias("content")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_cases(scores: DataFrame, masks: DataFrame, volumes: DataFrame, records: DataFrame, path: str, overwrite: bool = False) -> None:
    """Publish score, mask and metadata of all volumes (see ``case_files``) under ``path``, together or not at all."""
    write_files(case_files(scores, masks, volumes, records, path), path, overwrite)


def write_prepared(voxels: DataFrame, volumes: DataFrame, path: str, overwrite: bool = False) -> None:
    """``<id>.nii.gz`` in single precision, qform 1 and sform 2, micron: a prepared volume."""
    heads = volumes.withColumns({"unit": F.lit(MICRON), "qform": F.lit(1), "sform": F.lit(2)})
    write_files(volume_parts(voxels, heads).select(F.concat(F.col("volume_id").cast("string"), F.lit(".nii.gz")).alias("file"), "part", "content"), path, overwrite)
