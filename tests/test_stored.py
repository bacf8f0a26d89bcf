"""Tables that runs keep up to date, stored purges, and the event store."""

import os
import random
from datetime import datetime, timedelta

import pytest
from conftest import T0, minutes, pairs
from pyspark.sql import functions as F

from ticketspark.operators import events, queue, selection
from ticketspark.sources import event_store, maintained, purge, tables

PREDICTION = "prediction_id string, ticket_id string, predicted_priority string, created_at timestamp"


def _predictions(spark, rows):
    return spark.createDataFrame(rows, PREDICTION)


@pytest.mark.parametrize("seed", range(3))
def test_W1_maintained_equals_the_full_ranking(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [(f"p{i:03d}", f"t{draw.randrange(12)}", "low", minutes(draw.randrange(6))) for i in range(60)]
    runs = [rows[i::5] for i in range(5)]
    draw.shuffle(runs)
    newest = maintained.newest_predictions(spark, str(tmp_path / "newest"), 3, _predictions(spark, []).schema)
    assert newest.rows().count() == 0
    seen = []
    for number, run in enumerate([*runs, runs[0]]):
        newest.add(_predictions(spark, run), f"r{number}")
        seen += run
        if draw.random() < 0.5:
            newest.compact()
        want = queue.newest_prediction(_predictions(spark, seen))
        assert pairs(newest.rows(), "ticket_id", "prediction_id") == pairs(want, "ticket_id", "prediction_id")


def test_W1_a_compaction_that_failed_is_repeated(spark, tmp_path):
    newest = maintained.newest_predictions(spark, str(tmp_path / "newest"), 2, _predictions(spark, []).schema)
    newest.add(_predictions(spark, [("p1", "t1", "low", T0), ("p2", "t2", "low", T0)]), "a")
    newest.compact()
    newest.add(_predictions(spark, [("p3", "t1", "high", minutes(1))]), "b")
    # A base without its mark, as a lost driver leaves it; and a run that the base holds already.
    os.makedirs(tmp_path / "newest" / "base-000001" / "part")
    want = [("t1", "p3"), ("t2", "p2")]
    assert pairs(newest.rows(), "ticket_id", "prediction_id") == want
    newest.compact()
    newest.add(_predictions(spark, [("p3", "t1", "high", minutes(1))]), "b")
    assert pairs(newest.rows(), "ticket_id", "prediction_id") == want
    newest.compact()
    assert pairs(newest.rows(), "ticket_id", "prediction_id") == want
    assert sorted(os.listdir(tmp_path / "newest")) == ["base-000001", "base-000002", "runs"] and not os.listdir(tmp_path / "newest" / "runs")


def test_W1_queue_reads_one_row_per_ticket_in_place(spark, tmp_path):
    rows = spark.range(300).select(
        F.col("id").cast("string").alias("prediction_id"), (F.col("id") % 100).cast("string").alias("ticket_id"),
        F.lit("low").alias("predicted_priority"), F.lit(T0).alias("created_at"))
    newest = maintained.newest_predictions(spark, str(tmp_path / "newest"), 4, rows.schema)
    newest.add(rows, "r")
    newest.compact()
    tickets = rows.select("ticket_id", F.lit("u").alias("user_id"), "created_at", F.lit(None).cast("timestamp").alias("resolved_at")).distinct()
    stored = tables.save_bucketed(tickets, "w1_tickets", str(tmp_path / "tickets"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = newest.base()
        assert base.count() == 100
        plan = stored.join(base.drop("created_at"), "ticket_id", "left")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        left = maintained.unscored(stored, newest)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in left
        assert queue.triage_queue(stored, newest.rows(), limit=5).count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE w1_tickets")


def test_S5_index_of_scored_ids(spark, tmp_path):
    tickets = spark.createDataFrame([(f"t{i}", "text", minutes(i)) for i in range(6)], "ticket_id string, text string, created_at timestamp")
    history = spark.createDataFrame([("t0", "1"), ("t1", "1"), ("t1", "1"), ("t2", "2")], "ticket_id string, model_version string")
    index = {v: maintained.scored_ids(spark, str(tmp_path / "scored"), v, 2) for v in ("1", "2", "3/x")}
    for version, ids in index.items():
        ids.add(history.where(F.col("model_version") == version), "first")
    for version, ids in index.items():
        for since in (None, minutes(2)):
            want = selection.unscored(tickets, history, version, since)
            assert pairs(maintained.unscored(tickets, ids, since), "ticket_id") == pairs(want, "ticket_id")
        ids.compact()
    assert pairs(maintained.unscored(tickets, index["1"]), "ticket_id") == [("t2",), ("t3",), ("t4",), ("t5",)]


# --- Purge ---------------------------------------------------------------------------------------


@pytest.fixture
def stored(spark, tmp_path):
    def save(name, schema, runs):
        for run, rows in runs.items():
            tables.append_run(spark.createDataFrame(rows, schema), str(tmp_path / name), run)
        return str(tmp_path / name)

    return {
        "tickets": save("tickets", "ticket_id string, user_id string", {"a": [("t1", "u1"), ("t2", "u2")], "b": [("t3", "u3"), ("t4", None)], "c": [("t5", "u1")]}),
        "predictions": save("predictions", "prediction_id string, ticket_id string", {"a": [("p1", "t1"), ("p2", "t1")], "b": [("p3", "t2"), ("p4", "t5")], "c": [("p5", "t3")]}),
        "feedback": save("feedback", "feedback_id string, prediction_id string", {"a": [("f1", "p1"), ("f2", "p5")], "b": [("f3", "p5")], "c": [("f4", None)]}),
        "counters": save("counters", "user_id string, count long", {"a": [("u1", 1)], "b": [("u2", 2)]}),
    }


def _files(path):
    return {
        os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path) for name in names if not name.startswith(".")
    }


def _left(spark, stored):
    return {
        "tickets": pairs(spark.read.parquet(stored["tickets"]), "ticket_id"), "predictions": pairs(spark.read.parquet(stored["predictions"]), "prediction_id"),
        "feedback": pairs(spark.read.parquet(stored["feedback"]), "feedback_id"), "counters": pairs(spark.read.parquet(stored["counters"]), "user_id"),
    }


LEFT = {"tickets": [("t2",), ("t3",), ("t4",)], "predictions": [("p3",), ("p5",)], "feedback": [("f2",), ("f3",), ("f4",)], "counters": [("u2",)]}


def test_J10_rewrites_only_what_it_must(spark, stored):
    users = spark.createDataFrame([("u1",), ("nobody",), (None,)], "user_id string")
    before = {name: _files(path) for name, path in stored.items()}
    done = purge.purge_stored(spark, users, **stored)
    assert done == {"feedback": ["a"], "predictions": ["a", "b"], "tickets": ["a", "c"], "rate_limit_counters": ["a"]}
    assert _left(spark, stored) == LEFT
    for name, path in stored.items():
        after = _files(path)
        key = "rate_limit_counters" if name == "counters" else name
        for file, time in before[name].items():
            touched = any(f"{tables.RUN}={run}/" in file for run in done[key])
            assert touched or after[file] == time
        assert not any(purge.STAGED in file for file in after)
    assert not any(purge.purge_stored(spark, users, **stored).values())


@pytest.mark.parametrize("at", range(1, 12))
def test_J10_is_repeated_after_a_failure(spark, stored, monkeypatch, at):
    """It fails at the n-th removal, move or mark; the next try ends with the same rows."""
    steps = {"left": at}

    def failing(f):
        def step(*args):
            steps["left"] -= 1
            if steps["left"] == 0:
                raise RuntimeError("lost")
            return f(*args)

        return step

    users = spark.createDataFrame([("u1",)], "user_id string")
    with monkeypatch.context() as patch:
        for name in ("remove", "_move", "_mark"):
            patch.setattr(purge, name, failing(getattr(purge, name)))
        with pytest.raises(RuntimeError):
            purge.purge_stored(spark, users, **stored)
    purge.purge_stored(spark, users, **stored)
    assert _left(spark, stored) == LEFT


# --- Event store ---------------------------------------------------------------------------------

FIELDS = "ts timestamp, value string, severity string"


def _store(spark, path, runs):
    rows = []
    for run, (start, days) in enumerate(runs):
        part = [
            (T0 + timedelta(days=d, seconds=7 * k), f"{run}-{d}-{k}", "ERROR" if k % 3 == 0 else "INFO", ["prediction", "csv_upload", "batch_predict.error"][k % 3])
            for d in range(start, start + days) for k in range(6)
        ] + [(None, f"{run}-none", "INFO", "prediction")]
        event_store.store_events(spark.createDataFrame(part, f"{FIELDS}, event string"), path, str(run))
        rows += part
    return spark.createDataFrame(rows, f"{FIELDS}, event string")


@pytest.mark.parametrize(("names", "severities", "limit"), [
    (None, None, 5), (["prediction"], None, 3), (["prediction", "csv_upload"], ["INFO"], 7), (["ticket_created"], None, 5), (None, ["ERROR"], 1000), (None, None, 1000),
])
def test_S11_newest_of_the_store_equals_the_full_sort(spark, tmp_path, names, severities, limit):
    records = _store(spark, str(tmp_path), [(0, 5), (3, 4)])
    got = event_store.newest_stored(spark, str(tmp_path), FIELDS, names, severities, limit)
    want = events.newest_events(records, names, severities, limit)
    assert [tuple(r) for r in got.select("ts", "value", "event").collect()] == [tuple(r) for r in want.select("ts", "value", "event").collect()]


def test_S11_reads_the_last_days_only(spark, tmp_path):
    _store(spark, str(tmp_path), [(0, 20)])
    newest = event_store.newest_stored(spark, str(tmp_path), FIELDS, ["prediction"], None, 3)
    assert newest.count() == 3
    read = {f.split("/day=")[1][:10] for f in newest.inputFiles()}
    assert len(read) <= 3 and max(read) == (T0 + timedelta(days=19)).strftime("%Y-%m-%d")


def test_S12_a_repeated_run_replaces_its_records(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2026, 1, 1), "v", "INFO", "prediction")], f"{FIELDS}, event string")
    for _ in range(2):
        event_store.store_events(rows, str(tmp_path), "1")
    assert event_store.newest_stored(spark, str(tmp_path), FIELDS).count() == 1
    assert event_store.newest_stored(spark, str(tmp_path / "none"), FIELDS).count() == 0


def test_J10_keys_are_found_once_for_all_folders(spark, tmp_path):
    path, seen = str(tmp_path / "rows"), spark.sparkContext.accumulator(0)
    spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 3).alias(tables.RUN)).write.partitionBy(tables.RUN).parquet(path)

    def marked(i):
        seen.add(1)
        return i

    gone = spark.range(0, 30, 5).select(F.udf(marked, "long")("id").alias("k"))
    assert purge.delete_rows(spark, path, gone, "k") == ["0", "1", "2"]
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [i for i in range(30) if i % 5]
    assert seen.value <= 12
