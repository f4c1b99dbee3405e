"""Volumes derived from the driver's tables; ``oracle`` states the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.intensity import percentile_normalise
from ..operators.raster import scatter

#: Methods of the cohort with their thresholds per domain.
METHODS = [("m0", 0.55, 0.52), ("m1", 0.50, 0.48), ("m2", 0.60, 0.62), ("m3", 0.45, 0.45)]

#: Voxels of a plane of f1; voxels of a volume whose values a task may hold at once.
PLANE, AT_ONCE = 64, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def f1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id (label), z (row of the label), y, x (place in the 8x8 vector), vec_id, pos, v, h (a small integer hash)."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("z", F.row_number().over(order) - 1)
    rows = rows.select(F.col("label").alias("volume_id"), "vec_id", "z", F.posexplode("embedding").alias("pos", "v"))
    rows = rows.withColumn("v", F.col("v").cast("double"))
    place = {"y": F.floor(F.col("pos") / 8).cast("int"), "x": (F.col("pos") % 8).cast("int")}
    return rows.withColumns(place).withColumn("h", ((F.col("vec_id") * 7919 + F.col("pos") * 104729) % 101).cast("int"))


def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f1_values with s (normalised score), prediction, target and nz."""
    depth = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("volume_id")).agg(F.count("*").cast("int").alias("nz"))
    deepest = depth.agg(F.max("nz")).first()[0] or 0
    rows = percentile_normalise(f1_values(spark, sf_dir), ["volume_id"], "v", into="s", single=False, by_range=deepest * PLANE > AT_ONCE)
    rows = rows.withColumn("prediction", F.col("s") >= 0.55).withColumn("target", F.col("s") + (F.col("h") - 50) / 250.0 >= 0.55)
    return rows.join(F.broadcast(depth), "volume_id")


def f2_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id, z, y, x, id, distance, p: many contributions to each voxel."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 8).cast("int").alias("volume_id"),
        F.pmod(days, F.lit(32)).cast("int").alias("z"),
        ((F.col("l_quantity").cast("int") - 1) % 16).cast("int").alias("y"),
        (F.col("l_orderkey") % 16).cast("int").alias("x"),
        F.col("l_suppkey").alias("id"),
        (F.col("l_tax") * 20).alias("distance"),
        (F.col("l_discount") * 9).alias("p"),
    )


def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id, z, y, x, dist, label, prob: sparse instance labels."""
    out = scatter(f2_contributions(spark, sf_dir), ["volume_id"], F.col("distance"), F.col("p"), F.col("id"))
    return out.withColumn("label", F.col("label").cast("int"))


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f1 for four methods: method, domain, split, threshold, score and both masks."""
    rows = f1(spark, sf_dir).drop("prediction")
    domain = F.when(F.col("volume_id") < 5, "human").otherwise("macaque")
    split = F.when(F.col("volume_id").isin(0, 9), "calibration").otherwise("heldout")
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("method"), F.lit(a).alias("human"), F.lit(b).alias("macaque")) for k, (m, a, b) in enumerate(METHODS)])
    rows = rows.withColumn("domain", domain).withColumn("split", split).select("*", F.explode(each).alias("m"))
    score = F.col("s") + ((F.col("vec_id") * 31 + F.col("pos") * 17 + F.col("m.k") * 13) % 101 - 50) / 400.0
    rows = rows.withColumn("threshold", F.when(F.col("domain") == "human", F.col("m.human")).otherwise(F.col("m.macaque"))).withColumn("score", score)
    return rows.withColumn("method", F.col("m.method")).withColumn("prediction", F.col("score") >= F.col("threshold")).drop("m")


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id (event type), z (day), y (hour), x (user mod 10), value: a sparse intensity volume."""
    keys = {"volume_id": F.col("event_type"), "z": (F.dayofmonth("ts") - 1).cast("int"), "y": F.hour("ts").cast("int"), "x": (F.col("user_id") % 10).cast("int")}
    rows = table(spark, sf_dir, "events").select(*[v.alias(k) for k, v in keys.items()], "value")
    return rows.groupBy(*keys).agg(F.round(F.avg("value"), 6).alias("value"))


def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """curve_id, ord, z, y, x, radius: points of poly-lines in a 32^3 grid."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        c.alias("curve_id"), o.alias("ord"), ((13 * o) % 32).cast("double").alias("z"), ((7 * o + c) % 32).cast("double").alias("y"), ((3 * o + 5 * c) % 32).cast("double").alias("x"), (1 + (c % 3) / 2.0).alias("radius")
    )
