"""JSON trees as tables of paths: configurations and records of any shape, compared path by path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import saved

CONTAINERS = ("OBJECT", "ARRAY")


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def tree_paths(rows: DataFrame, by: Sequence[str], document: str, depth: int = 100) -> DataFrame:
    """by, path, kind, value: a row for each leaf of the JSON texts in ``document``; path is ``$`` with ``.key`` and ``[place]`` steps.

    value is the leaf's JSON text, that of a number its double; an empty object or array is a leaf, so is null.  A null text has
    no rows, a text that is no JSON is an error.  Each level is one pass over the containers that are left.
    """
    by = list(by)
    level = rows.select(*by, F.lit("$").alias("path"), F.parse_json(document).alias("_v")).where("_v is not null")
    leaves = []
    for _ in range(depth):
        level = saved(level.withColumn("_kind", _kind(F.col("_v"))), "documents")
        size = F.length(F.to_json("_v"))
        inner = F.col("_kind").isin(*CONTAINERS) & (size > 2)  # more than a pair of brackets
        leaves.append(level.where(~inner))
        deeper = level.where(inner)
        if deeper.isEmpty():
            break
        # The pairs of an object keep their keys, those of an array their places.
        pairs = deeper.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        step = F.when(F.col("_kind") == "OBJECT", F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = pairs.select(*by, F.concat("path", step).alias("path"), F.col("value").alias("_v"))
    else:
        raise ValueError(f"a document is deeper than {depth}")
    out = leaves[0]
    for l in leaves[1:]:
        out = out.unionByName(l)
    number = F.col("_kind").isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    kind = F.when(number, "NUMBER").when(F.col("_kind") == "VOID", "NULL").otherwise(F.col("_kind"))
    text = F.when(number, F.try_variant_get("_v", "$", "double").cast("string")).otherwise(F.to_json("_v"))
    return out.select(*by, "path", kind.alias("kind"), text.alias("value"))


def tree_differences(a: DataFrame, b: DataFrame, by: Sequence[str], document: str, ignored: Sequence[str] = ()) -> DataFrame:
    """by, path, recorded, expected, problem: each path at which the documents of the same keys differ.

    A path that one side lacks is not null there but ``missing`` or ``extra``; 3 and 3.0 are equal, so are lists of equal members.
    ``ignored`` are paths that are left out with all below them.  Keys that only one side has differ in all their paths.
    """
    left, right = (tree_paths(x, by, document).withColumnsRenamed({"kind": f"_{n}", "value": n}) for x, n in ((a, "recorded"), (b, "expected")))
    both = left.join(right, [*by, "path"], "full")
    problem = F.when(F.col("_recorded").isNull(), "missing").when(F.col("_expected").isNull(), "extra")
    problem = problem.when((F.col("_recorded") != F.col("_expected")) | (F.col("recorded") != F.col("expected")), "value")
    out = both.select(*by, "path", "recorded", "expected", problem.alias("problem")).where("problem is not null")
    for p in ignored:
        out = out.where((F.col("path") != p) & ~F.startswith("path", F.lit(f"{p}.")) & ~F.startswith("path", F.lit(f"{p}[")))
    return out


def flattened(rows: DataFrame, by: Sequence[str], document: str) -> DataFrame:
    """by, name, value: the leaves of nested objects under their keys joined by ``_``; arrays are leaves of one text each."""
    leaves = tree_paths(rows, by, document)
    own = F.regexp_replace(F.expr("substring(path, 3)"), r"\[.*$", "")
    place = F.regexp_extract("path", r"(\[.*)$", 1)
    parts = leaves.select(*by, F.translate(own, ".", "_").alias("name"), place.alias("_place"), "value")
    whole = parts.groupBy(*by, "name").agg(F.array_sort(F.collect_list(F.struct("_place", "value"))).alias("_all"))
    return whole.select(*by, "name", F.array_join(F.transform("_all", lambda e: F.concat(e["_place"], F.when(e["_place"] != "", "=").otherwise(""), e["value"])), ",").alias("value"))


def checked_documents(a: DataFrame, b: DataFrame, by: Sequence[str], document: str, ignored: Sequence[str] = ()) -> DataFrame:
    """``a``; a document that differs from that of ``b`` anywhere is an error that names the first path."""
    by = list(by)
    wrong = tree_differences(a, b, by, document, ignored).groupBy(*by).agg(F.min("path").alias("_path"))
    out = a.join(wrong, by, "left")
    message = F.concat(F.lit("a document differs at "), F.col("_path"))
    return out.withColumn(document, F.when(F.col("_path").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col(document))).drop("_path")
