"""Which tickets to score, and with which model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.ids import run_of_artifact, safe_label


def unscored(tickets: DataFrame, predictions: DataFrame, model_version: str, since=None) -> DataFrame:
    """J3, P3. Tickets without a prediction of this version, optionally from a date on.

    Scored ids are made distinct first: a ticket with very many predictions then counts once per
    task, and the anti-join reuses the partitioning of that aggregate.
    """
    scored = predictions.where(F.col("model_version") == F.lit(model_version)).select("ticket_id").distinct()
    if since is not None:
        # Cast to the type of the column, so that the comparison reaches the scan.
        kind = tickets.schema["created_at"].dataType
        tickets = tickets.where(F.col("created_at") >= F.lit(since).cast(kind))
    return tickets.join(scored, "ticket_id", "left_anti")


def by_ids(tickets: DataFrame, ids: DataFrame | Sequence) -> DataFrame:
    """P4, J5. Exactly these tickets, scored or not; an empty list selects nothing."""
    if not isinstance(ids, DataFrame):
        kind = tickets.schema["ticket_id"].dataType.simpleString()
        ids = tickets.sparkSession.createDataFrame([(i,) for i in ids], f"ticket_id {kind}")
    return tickets.join(ids.select("ticket_id").distinct(), "ticket_id", "left_semi")


def select_for_scoring(
    tickets: DataFrame, predictions: DataFrame, model_version: str, since=None, ticket_ids=None
) -> DataFrame:
    """S5, P1. Ids win over ``since``, ``since`` over the default."""
    if ticket_ids is not None:
        chosen = by_ids(tickets, ticket_ids)
    else:
        chosen = unscored(tickets, predictions, model_version, since)
    return chosen.select("ticket_id", F.col("text").alias("ticket_text"))


def selection_mode(since=None, ticket_ids=None, dry_run: bool = False) -> str:
    if dry_run:
        return "dry-run"
    if ticket_ids is not None:
        return "explicit-ids"
    return "default" if since is None else "since"


def register_models(runs: DataFrame) -> DataFrame:
    """M7. Model versions from training runs.

    ``runs`` has display_name, run_id, artifact_uri, data_version, accuracy, macro_f1, create_time.
    Versions count up in order of registration, and the newest one of a name is its default.
    """
    accuracy, macro_f1 = (F.format_string("%.4f", F.col(c)) for c in ("accuracy", "macro_f1"))
    described = F.concat(
        F.lit("run_id="), "run_id", F.lit(" | data_version="), "data_version",
        F.lit(" | accuracy="), accuracy, F.lit(" | macro_f1="), macro_f1,
    )
    labels = F.create_map(
        F.lit("run-id"), safe_label(F.col("run_id")),
        F.lit("data-version"), safe_label(F.col("data_version")),
        F.lit("accuracy"), safe_label(accuracy),
        F.lit("macro-f1"), safe_label(macro_f1),
    )
    # One row per training run ever registered under a name: a small table by nature.
    registered = Window.partitionBy("display_name").orderBy("create_time", "run_id")
    newest = Window.partitionBy("display_name").orderBy(F.desc("create_time"), F.desc("run_id"))
    return runs.select(
        "display_name",
        F.row_number().over(registered).alias("version"),
        "run_id",
        "artifact_uri",
        described.alias("description"),
        labels.alias("labels"),
        (F.row_number().over(newest) == 1).alias("is_default"),
        "create_time",
    )


def promote(versions: DataFrame, new_runs: DataFrame) -> DataFrame:
    """M7. Existing versions plus new runs; old default flags are cleared by the newest run."""
    last = versions.groupBy("display_name").agg(F.max("version").alias("_last"))
    added = (
        register_models(new_runs)
        .join(last, "display_name", "left")
        .withColumn("version", F.col("version") + F.coalesce("_last", F.lit(0)))
        .drop("_last")
    )
    touched = new_runs.select("display_name").distinct().withColumn("_new", F.lit(True))
    kept = (
        versions.join(touched, "display_name", "left")
        .withColumn("is_default", F.col("is_default") & F.col("_new").isNull())
        .drop("_new")
    )
    return kept.unionByName(added)


def resolve_version(versions: DataFrame, display_name: str | None = None, pinned=None) -> DataFrame:
    """T6. Pinned version if given, else the newest default, else the newest; with its run id."""
    if display_name is not None:
        versions = versions.where(F.col("display_name") == display_name)
    if pinned is not None:
        versions = versions.where(F.col("version").cast("string") == F.lit(str(pinned)))
    return (
        versions.orderBy(F.desc("is_default"), F.desc("create_time"), F.desc("version"), "display_name")
        .limit(1)
        .withColumn("model_run_id", run_of_artifact(F.col("artifact_uri")))
    )


def require_version(resolved: DataFrame) -> tuple[str, str]:
    """The one resolved row as (version, run id); no row is an error."""
    row = resolved.select("version", "model_run_id").first()
    if row is None:
        raise LookupError("no model version is registered")
    return str(row["version"]), row["model_run_id"]


def empty_predictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.PREDICTIONS)
