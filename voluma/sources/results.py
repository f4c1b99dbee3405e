"""Result tables as files: metric CSV, JSON records, report lines.  A result shows up under its name only when it is complete.

Each writer leaves a folder of part files, written by the tasks that hold the rows; nothing is gathered first.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def published(df: DataFrame, path: str, kind: str, overwrite: bool = False, **options: str) -> None:
    """Write ``df`` beside ``path`` and rename it when all tasks are done; an existing ``path`` is an error unless ``overwrite``."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = target.suffix(f".{uuid.uuid4().hex}.part")
    fs = target.getFileSystem(conf)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    try:
        df.write.format(kind).options(**options).save(part.toString())
        if overwrite:
            fs.delete(target, True)
        if not fs.rename(part, target):
            raise OSError(f"cannot rename {part.toString()} to {path}")
    finally:
        fs.delete(part, True)


def ordered_columns(df: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """The identifiers in the order given, then all other columns by name."""
    return df.select(*identifiers, *sorted(set(df.columns) - set(identifiers)))


def write_metrics(df: DataFrame, path: str, identifiers: Sequence[str], overwrite: bool = False) -> None:
    """CSV with a header; null is an empty field. A table without rows is an error."""
    if df.isEmpty():
        raise ValueError(f"no rows for {path}")
    published(ordered_columns(df, identifiers), path, "csv", overwrite, header="true", nullValue="", emptyValue="")


def read_metrics(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A metric CSV with columns of the types in ``schema``; a field that doesn't parse is an error."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def finite(df: DataFrame) -> DataFrame:
    """``df``; a number of its columns that is NaN or infinite is an error when it is read."""

    def checked(name: str):
        bad = F.isnan(name) | (F.abs(name) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"{name} is not finite"))).otherwise(F.col(name)).alias(name)

    return df.select(*[checked(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema])


def write_records(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines with keys by name; NaN and infinity are errors."""
    published(ordered_columns(finite(df), []), path, "json", overwrite, ignoreNullFields="false")


def read_sidecars(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One row per JSON file (a file is one object), with the file's name in ``sidecar``."""
    rows = spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")
    return rows.withColumn("sidecar", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def markdown_rows(df: DataFrame, identifiers: Sequence[str], metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """The identifiers and ``line``, a row of a Markdown table: identifiers as they are, metrics with fixed digits, null empty."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identifiers]
    numbers = [F.coalesce(F.format_string(f"%.{digits}f", F.round(F.col(c).cast("double"), digits)), F.lit("")) for c in metrics]
    numbers = [F.when(F.col(c).isNotNull(), n).otherwise("") for c, n in zip(metrics, numbers)]
    return df.select(*identifiers, F.concat(F.lit("| "), F.concat_ws(" | ", *texts, *numbers), F.lit(" |")).alias("line"))


def summary_lines(df: DataFrame, by: Sequence[str], names: Sequence[str], width: int = 24, digits: int = 4) -> DataFrame:
    """Per row and name a fixed-width line: the name to the left, its number to the right. place counts from 0."""
    pairs = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for i, c in enumerate(names)]
    rows = df.select(*by, F.inline(F.array(*pairs)))
    number = F.when(F.col("value").isNotNull(), F.format_string(f"%.{digits}f", F.round("value", digits))).otherwise("-")
    return rows.select(*by, "place", F.concat(F.rpad("name", width, " "), F.lpad(number, 14, " ")).alias("line"))


def meta_lines(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per row and name a line ``name: value``; null is left out. place counts from 0."""
    pairs = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)]
    return df.select(*by, F.inline(F.array(*pairs))).where("value is not null").select(*by, "place", F.concat_ws(": ", "name", "value").alias("line"))
