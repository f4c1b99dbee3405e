"""Model outputs as tables: logits to masks, overlap scores, losses, best epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import argmax, at_least, bce_with_logits, clipped, log_sum_exp, sigmoid, softmax


def binary_output(rows: DataFrame, logit: Column, threshold: float = 0.5) -> DataFrame:
    """probability and mask of a single logit."""
    return rows.withColumn("probability", sigmoid(logit)).withColumn("mask", at_least("probability", threshold))


def class_output(rows: DataFrame, logits: str = "logits", threshold: float = 0.5) -> DataFrame:
    """probability (shell and interior together), mask, class (first largest), shell and interior masks of three logits."""
    p = softmax(logits)
    out = rows.withColumn("_p", p).withColumn("probability", clipped(F.col("_p")[1] + F.col("_p")[2], 0.0, 1.0))
    out = out.withColumn("class", argmax(logits)).withColumn("mask", at_least("probability", threshold)).drop("_p")
    return out.withColumn("shell", F.col("class") == 1).withColumn("interior", F.col("class") == 2)


def hard_dice(prediction: Column, target: Column) -> Column:
    """Dice of two boolean columns as an aggregate; 1 if both are empty."""
    both, p, t = F.count_if(prediction & target), F.count_if(prediction), F.count_if(target)
    return F.when(p + t == 0, F.lit(1.0)).otherwise(2 * both / (p + t))


def selection_score(rows: DataFrame, by: Sequence[str], predicted: str = "predicted", target: str = "target", weights: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """by, foreground_dice, shell_dice, interior_dice and their weighted mean selection_score."""
    p, t = F.col(predicted), F.col(target)
    out = rows.groupBy(*by).agg(hard_dice(p > 0, t > 0).alias("foreground_dice"), hard_dice(p == 1, t == 1).alias("shell_dice"), hard_dice(p == 2, t == 2).alias("interior_dice"))
    names = ("foreground_dice", "shell_dice", "interior_dice")
    return out.withColumn("selection_score", sum(w * F.col(n) for w, n in zip(weights, names)) / float(sum(weights)))


def masked_mean(value: Column, weight: Column, mask: Column) -> Column:
    """Weighted mean over a mask, as an aggregate; the weight is at least 1e-8."""
    return F.sum(value * weight * mask) / F.greatest(F.sum(weight * mask), F.lit(1e-8))


def soft_dice_loss(probability: Column, target: Column, mask: Column) -> Column:
    """1 - soft Dice with 1 added to both sides, as an aggregate per sample."""
    return 1 - (2 * F.sum(probability * target * mask) + 1) / (F.sum(probability * mask) + F.sum(target * mask) + 1)


def nested_loss(rows: DataFrame, by: Sequence[str], logits: str = "logits", target: str = "target", w_foreground: float = 1.0, w_core: float = 1.0, w_ce: float = 1.0, w_dice: float = 1.0) -> DataFrame:
    """by, foreground_loss, core_loss, loss: cross entropy and soft Dice of foreground against background and, inside the true
    foreground, of interior against shell."""
    x = F.col(logits)
    rows = rows.withColumn("_f", log_sum_exp(x[1], x[2]) - x[0]).withColumn("_c", x[2] - x[1])
    t = F.col(target)
    fg, core = F.when(t > 0, 1.0).otherwise(0.0), F.when(t == 2, 1.0).otherwise(0.0)
    one = F.lit(1.0)

    def part(logit: str, truth: Column, mask: Column) -> Column:
        return w_ce * masked_mean(bce_with_logits(logit, truth), one, mask) + w_dice * soft_dice_loss(sigmoid(logit), truth, mask)

    out = rows.groupBy(*by).agg(part("_f", fg, one).alias("foreground_loss"), part("_c", core, fg).alias("core_loss"))
    return out.withColumn("loss", (w_foreground * F.col("foreground_loss") + w_core * F.col("core_loss")) / (w_foreground + w_core))


def running_best(rows: DataFrame, by: Sequence[str], epoch: str, value: str) -> DataFrame:
    """rows with best (largest so far) and best_epoch (the earliest that reached it)."""
    w = Window.partitionBy(*by).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("best", F.max(value).over(w))
    return out.withColumn("best_epoch", F.max_by(F.col(epoch), F.struct(F.col(value), -F.col(epoch))).over(w))


def resume_pick(rows: DataFrame, by: Sequence[str], epoch: str, complete: str, path: str) -> DataFrame:
    """by, path, epoch, start_epoch: the newest complete checkpoint, else the newest; a complete epoch is not run again."""
    best = rows.groupBy(*by).agg(F.max(F.struct(F.col(complete).alias("complete"), F.col(epoch).alias("epoch"), F.col(path).alias("path"))).alias("b"))
    return best.select(*by, "b.path", "b.epoch", (F.col("b.epoch") + F.col("b.complete").cast("int")).alias("start_epoch"))


def argument_differences(old: Column, new: Column, ignored: Sequence[str] = ()) -> Column:
    """Keys of two maps whose values differ, but for the ignored ones."""
    pairs = F.map_zip_with(old, new, lambda k, a, b: ~a.eqNullSafe(b) & ~k.isin(list(ignored) or [""]))
    return F.array_sort(F.map_keys(F.map_filter(pairs, lambda k, v: v)))
