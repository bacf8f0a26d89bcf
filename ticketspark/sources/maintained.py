"""Tables that runs keep up to date: the newest prediction per ticket, and the scored ids per model version.

A table is a base, bucketed and sorted by ticket, one row per ticket, and the rows of the runs since. ``compact`` folds
these into the next base. Merging is idempotent and does not depend on the order of the runs, so a run or a
compaction that is repeated after a failure, or a base that is read together with runs it already holds, changes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketspark import schemas as S
from ticketspark.operators.ranking import latest_per_key
from ticketspark.session import exists, folders, remove
from ticketspark.sources.tables import RUN

BASE = "base-"


@dataclass(frozen=True)
class Maintained:
    """One row per ``key`` below ``path``: the first by ``order``, which must be total but for equal rows."""

    spark: SparkSession
    path: str
    schema: T.StructType
    order: tuple[Column, ...]
    buckets: int
    key: str = "ticket_id"

    def add(self, rows: DataFrame, run_id: str) -> None:
        """The rows of a run; a repeated run replaces them. Keys that repeat in the run are merged first."""
        merged = latest_per_key(rows.select(*self.schema.names), [self.key], self.order)
        merged.write.mode("overwrite").parquet(f"{self.path}/runs/{RUN}={run_id}")

    def _bases(self) -> list[str]:
        """Complete bases, oldest first."""
        found = [name for name in folders(self.spark, self.path) if name.startswith(BASE)]
        return [name for name in found if exists(self.spark, f"{self.path}/{name}/_SUCCESS")]

    def _name(self, base: str) -> str:
        return f"maintained_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{base.removeprefix(BASE)}"

    def base(self) -> DataFrame:
        """The newest base; the session learns of its buckets if another one wrote it."""
        bases = self._bases()
        if not bases:
            return self.spark.createDataFrame([], self.schema)
        name = self._name(bases[-1])
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{bases[-1]}'")
        return self.spark.table(name)

    def _runs(self) -> list[str]:
        return folders(self.spark, f"{self.path}/runs")

    def rows(self, but: str | None = None) -> DataFrame:
        """One row per key. Keys that no run touched come from the base as they are, without a shuffle; after a
        compaction that is all of them. ``but`` leaves a run out that is being repeated."""
        return self._merged([run for run in self._runs() if run != f"{RUN}={but}"])

    def _merged(self, runs: list[str]) -> DataFrame:
        base = self.base()
        if not runs:
            return base
        since = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/runs/{run}" for run in runs])
        fresh = latest_per_key(since, [self.key], self.order)
        if not self._bases():
            return fresh
        touched = fresh.select(self.key)
        changed = latest_per_key(base.join(touched, self.key, "left_semi").unionByName(fresh), [self.key], self.order)
        return base.join(touched, self.key, "left_anti").select(*self.schema.names).unionByName(changed)

    def compact(self) -> None:
        """Fold the runs there are now into the next base; none of them may be repeated after that. The base before the last is removed, so queries that
        read the last one can end."""
        runs, bases = self._runs(), self._bases()
        if not runs:
            return
        base = f"{BASE}{int(bases[-1].removeprefix(BASE)) + 1 if bases else 0:06d}"
        # An unfinished try of the same base is replaced.
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(base)}")
        remove(self.spark, f"{self.path}/{base}")
        (
            self._merged(runs).repartition(self.buckets, self.key).write.option("path", f"{self.path}/{base}")
            .bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self._name(base))
        )
        for run in runs:
            remove(self.spark, f"{self.path}/runs/{run}")
        for old in bases[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(old)}")
            remove(self.spark, f"{self.path}/{old}")


def newest_predictions(spark: SparkSession, path: str, buckets: int, schema: T.StructType = S.PREDICTIONS) -> Maintained:
    """W1. The newest prediction of each ticket; equal times go to the larger id, as in the full ranking."""
    return Maintained(spark, path, schema, (F.desc("created_at"), F.desc("prediction_id")), buckets)


def scored_ids(spark: SparkSession, path: str, model_version: str, buckets: int, kind: str = "string") -> Maintained:
    """S5. The tickets that a model version has scored. Selecting what is left reads nothing else."""
    version = hashlib.md5(model_version.encode()).hexdigest()
    schema = T.StructType.fromDDL(f"ticket_id {kind}")
    return Maintained(spark, f"{path}/{version}", schema, (F.asc("ticket_id"),), buckets)


def unscored(tickets: DataFrame, scored: Maintained, since=None, but: str | None = None) -> DataFrame:
    """J3, P3. Tickets that are not in the index, optionally from a date on; the run ``but`` is repeated."""
    if since is not None:
        tickets = tickets.where(F.col("created_at") >= F.lit(since).cast(tickets.schema["created_at"].dataType))
    # One row per ticket that is scored; the index is in place where tickets are bucketed alike.
    return tickets.join(scored.rows(but), "ticket_id", "left_anti")
