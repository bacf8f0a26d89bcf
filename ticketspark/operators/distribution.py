"""Label mixes (A2, A4, A5) and the rule lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketspark import schemas as S

# The warning texts.
MIX_UNKNOWN = "WARNING: 'priority' column missing or DataFrame is empty — cannot check distribution."
MIX_WORDING = "WARNING: priority='%s' is %.1f%% (target %.1f%%, diff %.1f%% > %.0f%% tolerance)"


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """A2. Count per label; the vocabulary is always there, labels outside it are kept too."""
    zeros = S.vocabulary(df.sparkSession).select("label", F.lit(0).cast("long").alias("n"))
    found = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return zeros.unionByName(found).groupBy("label").agg(F.sum("n").alias("n"))


def _mix(df: DataFrame, label: str, tolerance: float) -> DataFrame:
    """Targets next to counts; one pass over ``df``, the rest is a row per label."""
    targets = df.sparkSession.createDataFrame(list(S.TARGET_MIX.items()), "label string, target double")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    counts = label_counts(df, label).withColumn("total", total)
    share = F.try_divide(F.col("n"), F.col("total"))
    diff = share - F.col("target")
    return (
        counts.join(F.broadcast(targets), "label")  # four rows
        .withColumn("share", share)
        .withColumn("off_target", F.abs(diff) > tolerance)
        .withColumn("signed_diff", F.when(F.abs(diff) > tolerance, diff))
    )


def mix_check(df: DataFrame, label: str = "priority", tolerance: float = S.MIX_TOLERANCE) -> DataFrame:
    """A4, A5. Share of each label against its target, over all rows.

    ``off_target`` is a strict comparison; ``signed_diff`` shows only where it holds. An empty
    input gives NULL shares: nothing can be checked.
    """
    return _mix(df, label, tolerance).select("label", "n", "share", "target", "off_target", "signed_diff")


def mix_warnings(df: DataFrame, label: str = "priority", tolerance: float = S.MIX_TOLERANCE) -> DataFrame:
    """A4. One warning per label that is off target; one in all when there is nothing to check."""
    if label not in df.columns:
        return df.sparkSession.createDataFrame([(MIX_UNKNOWN,)], "warning string")
    off = F.format_string(
        MIX_WORDING, "label", F.col("share") * 100, F.col("target") * 100,
        F.abs(F.col("signed_diff")) * 100, F.lit(tolerance * 100),
    )
    empty = F.col("total") == 0
    return (
        _mix(df, label, tolerance).where(empty | F.col("off_target"))
        .select(F.when(empty, F.lit(MIX_UNKNOWN)).otherwise(off).alias("warning"))
        .distinct()
    )


def apply_rules(df: DataFrame, strict: bool = True) -> DataFrame:
    """J9. Priority by (customer_sentiment, issue_complexity); an unknown pair fails in strict mode."""
    found = df.join(
        F.broadcast(S.rule_table(df.sparkSession)),  # nine rows
        ["customer_sentiment", "issue_complexity"],
        "left",
    )
    if not strict:
        return found
    message = F.concat(
        F.lit("no rule for "),
        F.concat_ws(" / ", F.coalesce("customer_sentiment", F.lit("null")), F.coalesce("issue_complexity", F.lit("null"))),
    )
    return found.withColumn("priority", F.coalesce("priority", F.raise_error(message).cast("string")))
