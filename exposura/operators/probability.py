"""Quality of predicted probabilities: Brier, log loss, calibration error, ROC and PR areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from exposura.functions.columns import ratio
from exposura.functions.scale import ROWS_PER_TASK, running_totals
from exposura.session import materialize

CLIP = 1e-9


def clipped(probability: str) -> Column:
    return F.greatest(F.least(F.col(probability), F.lit(1 - CLIP)), F.lit(CLIP))


def probability_bin(probability: Column, bins: int = 10) -> Column:
    """Equal-width bin by comparing with the edges themselves (multiplying by 10 misplaces values on an edge)."""
    bin_number = F.lit(0)
    for edge in range(1, bins):
        bin_number = bin_number + (probability >= F.lit(edge / bins)).cast("int")
    return bin_number


def reliability(rows: DataFrame, label: str = "label", probability: str = "probability", bins: int = 10) -> DataFrame:
    work = rows.select(F.col(label).cast("double").alias("_y"), clipped(probability).alias("_p"))
    return work.groupBy(probability_bin(F.col("_p"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("_p").alias("mean_probability"), F.avg("_y").alias("observed_rate")
    )


def probability_metrics(rows: DataFrame, label: str = "label", probability: str = "probability", bins: int = 10) -> DataFrame:
    """One row: Brier score, log loss, expected calibration error, rows.

    Everything is summed per bin in one pass and put together from the ``bins`` sums.
    """
    y, p = F.col("_y"), F.col("_p")
    work = rows.select(F.col(label).cast("double").alias("_y"), clipped(probability).alias("_p"))
    per_bin = work.groupBy(probability_bin(p, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_sp"), F.sum("_y").alias("_sy"),
        F.sum((p - y) * (p - y)).alias("_se"),
        F.sum(y * F.log(p) + (1 - y) * F.log(1 - p)).alias("_ll"),
    )
    return per_bin.agg(
        (F.sum("_se") / F.sum("_n")).alias("brier_score"),
        (-F.sum("_ll") / F.sum("_n")).alias("log_loss"),
        (F.sum(F.abs(F.col("_sp") - F.col("_sy"))) / F.sum("_n")).alias("expected_calibration_error"),
        F.sum("_n").alias("rows"),
    )


def ranking_areas(
    rows: DataFrame, label: str = "label", probability: str = "probability", min_rows: int = ROWS_PER_TASK
) -> DataFrame:
    """One row: ROC area (ties count half) and average precision; null unless both classes occur.

    Labels are counted per distinct probability, and the running counts over those are sliced, so no
    task sorts the whole table.
    """
    counts = materialize(
        rows.select((F.col(label) > 0).alias("_y"), clipped(probability).alias("_p")).groupBy("_p").agg(
            F.count_if(F.col("_y")).alias("_pos"), F.count_if(~F.col("_y")).alias("_neg")
        )
    )
    totals = counts.agg(F.struct(F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg")).alias("t")).scalar()
    placed = running_totals(
        counts, F.col("_p"), {"_pos_below": F.col("_pos"), "_neg_below": F.col("_neg")}, min_rows=min_rows, stored=True
    )
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    recalled = totals["pos"] - F.col("_pos_below")
    shown = recalled + totals["neg"] - F.col("_neg_below")
    return placed.agg(
        F.sum(pos * (F.col("_neg_below") + neg / 2)).alias("_wins"),
        F.sum(pos * ratio(recalled, shown)).alias("_ap"),
        F.sum(pos).alias("_p"), F.sum(neg).alias("_n"),
    ).select(
        ratio(F.col("_wins"), F.col("_p") * F.col("_n")).alias("roc_auc"),
        F.when(F.col("_n") > 0, ratio(F.col("_ap"), F.col("_p"))).alias("pr_auc"),
    )
