"""Binary classification metrics as aggregates and column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def confusion(df: DataFrame, *keys: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """n, tp, tn, fp, fn by key, in one pass."""
    a, p = F.col(actual), F.col(predicted)
    n = lambda x, y: F.count_if((p == x) & (a == y))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(1, 0).alias("fp"), n(0, 1).alias("fn"))


def ratio(x: Column, y: Column) -> Column:
    """Null on an empty denominator."""
    return F.when(y != 0, x / y)


def with_rates(df: DataFrame) -> DataFrame:
    """Adds accuracy, its Wilson interval, balanced accuracy, and precision and recall of either label to a confusion."""
    tp, tn, fp, fn, n = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn", "n"))
    acc = ratio(tp + tn, n)
    centre = (acc + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(acc * (1 - acc) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return df.withColumns({
        "accuracy": acc, "wilson_low": F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), "wilson_high": F.when(n > 0, F.least(F.lit(1.0), centre + half)),
        "balanced_accuracy": F.when((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2),
        "like_precision": ratio(tp, tp + fp), "like_recall": ratio(tp, tp + fn), "dislike_precision": ratio(tn, tn + fn), "dislike_recall": ratio(tn, tn + fp),
    })


def accepted(precision: Column, required: float) -> Column:
    """Null never passes."""
    return F.coalesce(precision >= required, F.lit(False))


def threshold_grid(scores: DataFrame, thresholds: list[float], like: float, dislike: float) -> DataFrame:
    """One row a threshold: its metrics and whether both precisions are accepted (scores: actual, score)."""
    grid = scores.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    at = scores.crossJoin(F.broadcast(grid)).withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
    return with_rates(confusion(at, "threshold")).withColumn("qualified", accepted(F.col("like_precision"), like) & accepted(F.col("dislike_precision"), dislike))


def best_threshold(grid: DataFrame) -> DataFrame:
    """The largest balanced accuracy among the qualified, else among all; the first of equals."""
    return grid.orderBy(F.col("qualified").desc(), F.col("balanced_accuracy").desc_nulls_last(), "threshold").limit(1)


def auc(df: DataFrame, actual: str = "actual", score: str = "score") -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half. Scores are summed by value first, so the running sum
    is over distinct scores, not over rows."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by.select("pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("won")).agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc")
    )
