import json
import re

import numpy as np
import pytest
from conftest import T0, column, minutes, pairs
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.operators import queue, selection
from ticketspark.plans import scoring
from ticketspark.session import scratch_path
from ticketspark.sources import maintained, tables

def run_ts():
    return F.lit(T0)



@pytest.fixture
def four(make_tickets):
    days = {"T-001": -10, "T-002": -5, "T-003": -1, "T-004": 0}
    return make_tickets([(t, "a", minutes(d * 1440 - 720), None) for t, d in days.items()])


def _ids(df):
    return sorted(column(df, "ticket_id"))


def test_J3_default_and_new_version(four, make_predictions):
    done = make_predictions([("p1", "T-001", "low", minutes(0), "1"), ("p3", "T-003", "low", minutes(0), "1"), ("p4", "T-003", "low", minutes(1), "1")])
    assert _ids(selection.select_for_scoring(four, done, "1")) == ["T-002", "T-004"]
    assert _ids(selection.select_for_scoring(four, done, "2")) == ["T-001", "T-002", "T-003", "T-004"]


def test_P3_since(four, make_predictions):
    assert _ids(selection.select_for_scoring(four, make_predictions([]), "1", since="2026-04-18")) == ["T-003", "T-004"]
    assert _ids(selection.select_for_scoring(four, make_predictions([]), "1", since="2026-04-19")) == ["T-003", "T-004"]
    done = make_predictions([("p3", "T-003", "low", minutes(0), "1")])
    assert _ids(selection.select_for_scoring(four, done, "1", since="2026-04-18")) == ["T-004"]


def test_P4_ids(four, make_predictions):
    done = make_predictions([("p2", "T-002", "low", minutes(0), "1")])
    assert _ids(selection.select_for_scoring(four, done, "1", since="2027-01-01", ticket_ids=["T-002", "T-004"])) == ["T-002", "T-004"]
    assert _ids(selection.select_for_scoring(four, done, "1", ticket_ids=[])) == []


def test_J3_reduces_scored_ids_before_the_join(spark, sf_dir):
    from ticketspark.plans import bindings as B

    plan = selection.unscored(B.tickets(spark, sf_dir), B.predictions(spark, sf_dir), "N")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "HashAggregate" in plan and "EqualTo(l_returnflag,N)" in plan


@pytest.fixture
def texts(spark):
    def make(*values):
        return spark.createDataFrame(
            [(f"t{i}", v, "a", T0) for i, v in enumerate(values)], "ticket_id string, text string, user_id string, created_at timestamp"
        )

    return make


def fixed_scorer(answers):
    """Scorer that looks its logits up by text."""

    def load():
        return lambda batch: np.array([answers[t] for t in batch])

    return scoring.batch_scorer(load, 2)


EVEN = {"good text": [0, 1, 0, 0], "more text": [0, 0, 0, 3], "ok": [2, 0, 0, 0]}


def run(spark, tickets, scorer, **options):
    path = options.pop("path", None) or scratch_path(spark, "test-predictions")
    lines = []
    history = tables.read_table(spark, path, S.PREDICTIONS)
    summary = scoring.run_batch(tickets, history, path, scorer, options.pop("version", "1"), "run-1", options.pop("run_id", "r1"), run_ts(), on_summary=lines.append, **options)
    return summary.first(), tables.read_table(spark, path, S.PREDICTIONS), json.loads(lines[0]), path


def test_M5_blank_and_null_are_skipped(spark, texts):
    summary, written, line, _ = run(spark, texts("good text", "", "more text", None, " 　\t"), fixed_scorer(EVEN))
    assert (summary.row_count, summary.row_count_scored, summary.row_count_skipped) == (5, 2, 3)
    assert pairs(written, "ticket_id", "predicted_priority") == [("t0", "medium"), ("t2", "urgent")]
    assert line["event"] == "batch_run_summary" and line["severity"] == "INFO"
    assert line["class_distribution"] == {"low": 0, "medium": 1, "high": 0, "urgent": 1}
    assert summary.selection_mode == "default"


def test_M5_empty(spark, texts):
    summary, written, line, _ = run(spark, texts(), fixed_scorer(EVEN))
    assert (summary.row_count, summary.avg_confidence) == (0, 0.0) and written.count() == 0
    assert line["class_distribution"] == dict.fromkeys(S.LABELS, 0)
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", line["started_at"])


def test_A1_nothing_scored(spark, texts):
    summary, *_ = run(spark, texts(" "), fixed_scorer(EVEN))
    assert (summary.row_count, summary.row_count_skipped, summary.avg_confidence) == (1, 1, 0.0)


def test_M5_dry_run(spark, texts):
    summary, written, *_ = run(spark, texts("good text", "ok", "more text"), fixed_scorer(EVEN), dry_run=True, ticket_ids=["t0", "t1"])
    assert summary.selection_mode == "dry-run" and summary.row_count_scored == 2 and written.count() == 0


def test_M5_rerun_and_new_version(spark, texts):
    tickets = texts("good text", "ok")
    *_, path = run(spark, tickets, fixed_scorer(EVEN))
    again, written, *_ = run(spark, tickets, fixed_scorer(EVEN), path=path, run_id="r2")
    assert again.row_count == 0 and written.count() == 2
    other, written, *_ = run(spark, tickets, fixed_scorer(EVEN), path=path, run_id="r3", version="2")
    assert other.row_count_scored == 2 and written.count() == 4
    forced, written, *_ = run(spark, tickets, fixed_scorer(EVEN), path=path, run_id="r4", ticket_ids=["t0"])
    assert forced.selection_mode == "explicit-ids" and written.count() == 5
    assert written.select("prediction_id").distinct().count() == 5


def test_M5_with_an_index_reads_no_history(spark, texts):
    scored = maintained.scored_ids(spark, scratch_path(spark, "ids"), "1", 2)
    newest = maintained.newest_predictions(spark, scratch_path(spark, "newest"), 2)
    kept = {"scored": scored, "newest": newest}
    _, _, _, path = run(spark, texts("good text", " "), fixed_scorer(EVEN), **kept)
    # The history is empty here: what is left follows from the index alone. Blank texts are selected again, as ever.
    blind = selection.empty_predictions(spark)
    options = {"on_summary": lambda line: None, **kept}
    again = scoring.run_batch(texts("good text", " ", "ok"), blind, path, fixed_scorer(EVEN), "1", "run-1", "r2", run_ts(), **options)
    assert (again.first().row_count, again.first().row_count_scored) == (2, 1)
    # A run that is repeated does not find itself in the index.
    repeat = scoring.run_batch(texts("good text", " ", "ok"), blind, path, fixed_scorer(EVEN), "1", "run-1", "r2", run_ts(), **options)
    assert repeat.first().row_count_scored == 1 and tables.read_table(spark, path, S.PREDICTIONS).count() == 2
    scored.compact()
    newest.compact()
    assert sorted(column(scored.rows(), "ticket_id")) == ["t0", "t2"]
    full = queue.newest_prediction(tables.read_table(spark, path, S.PREDICTIONS))
    assert pairs(newest.rows(), "ticket_id", "prediction_id") == pairs(full, "ticket_id", "prediction_id")
    other = maintained.scored_ids(spark, scratch_path(spark, "ids"), "2", 2)
    assert scoring.run_batch(texts("good text"), blind, path, fixed_scorer(EVEN), "2", None, "r3", run_ts(), on_summary=lambda line: None, scored=other).first().row_count == 1


def test_S6_retry_replaces_its_own_rows(spark, texts):
    *_, path = run(spark, texts("good text", "ok"), fixed_scorer(EVEN))
    scored = scoring.score(texts("good text", "ok").select("ticket_id", F.col("text").alias("ticket_text")), fixed_scorer(EVEN))
    rows = scoring.prediction_rows(scored, "1", "run-1", "r1", run_ts())
    assert tables.append_predictions(rows, path, "r1") == 2
    assert tables.read_table(spark, path, S.PREDICTIONS).count() == 2
    assert tables.append_predictions(rows, path, "r2", overwrite=True) == 2
    assert tables.read_table(spark, path, S.PREDICTIONS).count() == 4
    assert tables.append_predictions(rows.limit(0), path, "r3") == 0


def test_M5_failure_still_summarises(spark, texts):
    def load():
        raise RuntimeError("no model")

    lines, path = [], scratch_path(spark, "test-failed")
    with pytest.raises(Exception, match="no model"):
        scoring.run_batch(texts("good text"), selection.empty_predictions(spark), path, scoring.batch_scorer(load), "1", None, "r1", run_ts(), on_summary=lines.append)
    assert json.loads(lines[0])["row_count"] == 0
    assert tables.read_table(spark, path, S.PREDICTIONS).count() == 0


def test_A1_mix_and_average(spark):
    labels = ["low", "medium", "medium", "high", "urgent"]
    rows = [(False, p, c) for p, c in zip(labels, [0.5, 0.6, 0.7, 0.8, 0.9])]
    got = scoring.summarise(spark.createDataFrame(rows, "skipped boolean, predicted_priority string, confidence double")).first()
    assert got.class_distribution == {"low": 1, "medium": 2, "high": 1, "urgent": 1}
    assert got.avg_confidence == pytest.approx(0.7)


def test_X1_scores(spark, texts):
    tickets = texts("good text").select("ticket_id", F.col("text").alias("ticket_text"))
    row = scoring.score(tickets, fixed_scorer(EVEN)).first()
    e = np.exp([-1, 0, -1, -1])
    assert set(row.all_scores) == set(S.LABELS)
    assert row.confidence == pytest.approx(e[1] / e.sum()) and sum(row.all_scores.values()) == pytest.approx(1)


def test_X1_contract(spark, texts):
    tickets = texts("ok", "good text").select("ticket_id", F.col("text").alias("ticket_text"))
    with pytest.raises(ValueError):
        scoring.batch_scorer(lambda: None, 0)
    short = scoring.batch_scorer(lambda: lambda batch: np.zeros((1, 4)), 2)
    with pytest.raises(Exception, match="logits"):
        short(tickets.coalesce(1)).collect()

    def never():
        raise RuntimeError("loaded")

    assert scoring.batch_scorer(never)(texts(" ", None).select("ticket_id", F.col("text").alias("ticket_text"))).count() == 2


def test_S8_ticket_and_prediction_share_the_id(spark):
    scored = spark.createDataFrame(
        [("q1", "a text", "high", 0.8, {"high": 0.8}, "1", "run", 120)],
        "request_id string, text string, predicted_priority string, confidence double, all_scores map<string,double>, model_version string, model_run_id string, latency_ms int",
    )
    tickets, predictions = tables.ticket_and_prediction(scored, F.lit("a"), run_ts())
    assert column(tickets, "ticket_id") == column(predictions, "ticket_id")
    assert column(tickets, "source") == ["paste"]
    assert sorted(tickets.columns) == sorted(S.TICKETS.fieldNames())
    assert sorted(predictions.columns) == sorted(S.PREDICTIONS.fieldNames())


@pytest.fixture
def runs(spark):
    def make(*rows):
        return spark.createDataFrame(
            [("m", r, f"store/runs/{r}/model/", "v1", a, f, minutes(t)) for r, a, f, t in rows],
            "display_name string, run_id string, artifact_uri string, data_version string, accuracy double, macro_f1 double, create_time timestamp",
        )

    return make


def test_M7_T6_versions(runs):
    versions = selection.register_models(runs(("Run.1", 0.9123456, 0.9, 1), ("Run.2", 0.8, 0.7, 2)))
    first = versions.where("version = 1").first()
    assert first.description == "run_id=Run.1 | data_version=v1 | accuracy=0.9123 | macro_f1=0.9000"
    assert first.labels == {"run-id": "run-1", "data-version": "v1", "accuracy": "0-9123", "macro-f1": "0-9000"}
    assert selection.require_version(selection.resolve_version(versions)) == ("2", "Run.2")
    assert selection.require_version(selection.resolve_version(versions, pinned=1)) == ("1", "Run.1")
    flagged = versions.withColumn("is_default", F.col("version") == 1)
    assert selection.require_version(selection.resolve_version(flagged)) == ("1", "Run.1")
    unflagged = versions.withColumn("is_default", F.lit(False))
    assert selection.require_version(selection.resolve_version(unflagged)) == ("2", "Run.2")
    with pytest.raises(LookupError):
        selection.require_version(selection.resolve_version(versions, pinned=9))


def test_M7_promote(runs):
    old = selection.register_models(runs(("a", 0.9, 0.9, 1), ("b", 0.8, 0.7, 2)))
    new = selection.promote(old, runs(("c", 0.7, 0.7, 3)))
    assert pairs(new, "version", "run_id", "is_default") == [(1, "a", False), (2, "b", False), (3, "c", True)]


def test_X1_loads_once_per_worker_process(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda batch: np.zeros((len(batch), 4))

    tickets = spark.range(400).repartition(40).select(F.col("id").cast("string").alias("ticket_id"), F.lit("some text").alias("ticket_text"))
    scorer = scoring.batch_scorer(load)
    for _ in range(2):
        assert scoring.score(tickets, scorer).where("not skipped").count() == 400
        scoring.score(tickets, scorer).write.format("noop").mode("overwrite").save()
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) and 0 < len(loads) < 40


def test_M5_writes_a_line_per_scored_ticket_and_an_error_record(spark, texts):
    path = scratch_path(spark, "test-lines")
    for _ in range(2):
        run(spark, texts("good text", " ", "more text"), fixed_scorer(EVEN), events_path=path)
    lines = [json.loads(v) for v in column(spark.read.text(path), "value")]
    assert sorted((x["ticket_id"], x["input_preview"], x["input_length_chars"], x["run_id"]) for x in lines) == [
        ("t0", "good text", 9, "r1"), ("t2", "more text", 9, "r1")]

    def load():
        raise RuntimeError("no model")

    errors, summaries = [], []
    with pytest.raises(Exception, match="no model"):
        scoring.run_batch(texts("good text"), selection.empty_predictions(spark), path, scoring.batch_scorer(load), "1", None, "r9", run_ts(),
                          on_summary=summaries.append, on_error=errors.append)
    record = json.loads(errors[0])
    assert (record["severity"], record["event"]) == ("ERROR", "batch_predict.error") and "no model" in record["error"] and record["traceback"]
