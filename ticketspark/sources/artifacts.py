"""Evaluation results and event logs on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the evaluation artifacts.
ARTIFACTS = [
    "metrics", "confusion_matrix", "misclassified", "test_predictions", "training_args", "train_summary",
]


def write_artifacts(folder: str, **frames: DataFrame) -> None:
    """S10. One JSON dataset per artifact; absent ones are left out."""
    unknown = set(frames) - set(ARTIFACTS)
    if unknown:
        raise ValueError(f"unknown artifacts: {sorted(unknown)}")
    for name, frame in frames.items():
        frame.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def train_summary(split: DataFrame, runtime_sec: float, loss: float) -> DataFrame:
    """S10. Sizes of the three parts next to the run time and loss of a training."""
    sizes = {name: F.count_if(F.col("split") == name).alias(f"num_{name}_samples") for name in ("train", "val", "test")}
    return split.agg(*sizes.values()).select(
        F.lit(float(runtime_sec)).alias("train_runtime_sec"), F.lit(float(loss)).alias("train_loss"), "*"
    )


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """S12. JSON lines as text."""
    lines.select("value").write.mode(mode).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S11."""
    return spark.read.text(path)
