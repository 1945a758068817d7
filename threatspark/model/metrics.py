"""Classifier metrics as aggregations. Input rows carry ``label`` (0/1) and ``score``; ``by`` groups them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatspark.operators import running
from threatspark.operators.reports import share

#: Scores are first counted in stretches of this width, then cut where the distinct scores are.
SCORE_WIDTH = 1 / 65536


def confusion_matrix(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp; a score at the threshold counts as positive."""
    positive, truth = F.col("score") >= threshold, F.col("label") == 1
    return scored.groupBy(*by).agg(
        F.count_if(~truth & ~positive).alias("tn"),
        F.count_if(~truth & positive).alias("fp"),
        F.count_if(truth & ~positive).alias("fn"),
        F.count_if(truth & positive).alias("tp"),
    )


def binary_metrics(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and error rates from one pass; empty denominators give 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion_matrix(scored, threshold, by).withColumns({
        "accuracy": share(tn + tp, tn + fp + fn + tp),
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": share(fp, fp + tn),
        "false_negative_rate": share(fn, fn + tp),
    })


def judged(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("score").isNotNull() & F.col("label").isNotNull())


def _by_score(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positives and negatives of each score; rows without a score or a label are left out, as from every count."""
    return judged(scored).groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Exact area under the ROC curve with tied scores averaged.

    Rows are first folded to distinct scores; each positive then counts the negatives below it plus half of its ties.
    """
    steps = running.running_sums(
        _by_score(scored, by), list(by), ["score"], F.col("score").cast("double"), {"neg_so_far": F.col("neg")},
        rows=rows, width=SCORE_WIDTH,
    )
    won = F.sum(F.col("pos") * (F.col("neg_so_far") - F.col("neg") / 2))
    sums = steps.groupBy(*by).agg(won.alias("_won"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    return sums.select(*by, share(F.col("_won"), F.col("_pos") * F.col("_neg")).alias("roc_auc"))


def roc_curve(scored: DataFrame, rows: int | None = None) -> DataFrame:
    """False and true positive rate at each distinct score, taken as threshold from high to low."""
    steps = running.running_sums(
        _by_score(scored, ()), [], [F.col("score").desc()], F.col("score").cast("double"),
        {"fp": F.col("neg"), "tp": F.col("pos")}, descending=True, rows=rows, width=SCORE_WIDTH,
    )
    total = judged(scored).agg(
        F.struct(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    ).scalar()
    return steps.select(
        F.col("score").alias("threshold"),
        share(F.col("fp"), total.getField("neg")).alias("fpr"),
        share(F.col("tp"), total.getField("pos")).alias("tpr"),
    )


def model_ranking(results: DataFrame) -> DataFrame:
    """The best model by F1; the earlier one wins ties. Input rows carry ``ordinal``, ``model`` and the metrics."""
    return results.orderBy(F.col("f1").desc(), "ordinal").limit(1)
