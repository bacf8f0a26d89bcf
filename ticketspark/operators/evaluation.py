"""Classification quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.ids import seeded_hash
from ticketspark.functions.labels import decode, encode
from ticketspark.functions.scores import argmax


def confusion(df: DataFrame, truth: str = "true_label", predicted: str = "pred_label") -> DataFrame:
    """A7. All sixteen cells, zeros included; rows are truth."""
    cells = df.sparkSession.createDataFrame(
        [(t, p, 0) for t in S.LABELS for p in S.LABELS], "true_label string, pred_label string, n long"
    )
    found = df.groupBy(F.col(truth).alias("true_label"), F.col(predicted).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return cells.unionByName(found).groupBy("true_label", "pred_label").agg(F.sum("n").alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)).cast("double")


def class_metrics(matrix: DataFrame) -> DataFrame:
    """A8. Precision, recall, F1 and support of each label from the confusion matrix."""
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)

    def side(label: str, truth: Column, said: Column, hits: Column) -> Column:
        return F.struct(F.col(label).alias("label"), truth.alias("truth"), said.alias("said"), hits.alias("hit"))

    none = F.lit(0).cast("long")
    sides = matrix.select(F.inline(F.array(
        side("true_label", F.col("n"), none, hit), side("pred_label", none, F.col("n"), none)
    )))
    totals = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("truth", "said", "hit")])
    precision, recall = _ratio(F.col("hit"), F.col("said")), _ratio(F.col("hit"), F.col("truth"))
    return totals.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * F.col("hit"), F.col("truth") + F.col("said")).alias("f1"),
        F.col("truth").alias("support"),
        F.col("said").alias("predicted"),
        F.col("hit").alias("hits"),
    )


def overall_metrics(per_class: DataFrame) -> DataFrame:
    """A8. Accuracy over all rows; macro F1 over the labels seen in truth or prediction only."""
    seen = (F.col("support") + F.col("predicted")) > 0
    return per_class.agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.coalesce(F.avg(F.when(seen, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
    )


def flat_metrics(matrix: DataFrame, names: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """A9. (metric, value): accuracy, macro_f1, then one row per name and label."""
    per_class = class_metrics(matrix)
    overall = overall_metrics(per_class).unpivot([], ["accuracy", "macro_f1"], "metric", "value")
    known = per_class.where(F.col("label").isin(S.LABELS))
    each = known.unpivot("label", list(names), "metric", "value").select(
        F.concat_ws("_", "metric", "label").alias("metric"), "value"
    )
    return overall.unionByName(each)


def logit_metrics(df: DataFrame, logits: str = "logits", label_id: str = "label_id") -> DataFrame:
    """X2. Logits and true ids to accuracy, macro_f1 and one f1 per label."""
    labelled = df.select(
        decode(F.col(label_id)).alias("true_label"), decode(argmax(F.col(logits))).alias("pred_label")
    )
    return flat_metrics(confusion(labelled), names=("f1",))


def error_sample(
    df: DataFrame,
    key: str,
    truth: str = "true_label",
    predicted: str = "pred_label",
    n: int = S.ERROR_SAMPLE,
    seed: int = S.SEED,
) -> DataFrame:
    """M4. Up to ``n`` wrong rows, chosen by a seeded hash of the unique ``key``; a top-k plan."""
    return df.where(F.col(truth) != F.col(predicted)).orderBy(seeded_hash(seed, F.col(key)), key).limit(n)


def label_ids(df: DataFrame, truth: str = "true_label", predicted: str = "pred_label") -> DataFrame:
    """F12. Both label columns as ids."""
    return df.withColumns({"y_true": encode(F.col(truth)), "y_pred": encode(F.col(predicted))})
