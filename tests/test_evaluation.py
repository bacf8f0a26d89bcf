import pytest
from conftest import column, pairs
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions import ids, labels, scores
from ticketspark.operators import contracts, evaluation


@pytest.fixture
def judged(spark):
    def make(truth, predicted):
        rows = [(i, S.LABELS[t], S.LABELS[p]) for i, (t, p) in enumerate(zip(truth, predicted))]
        return spark.createDataFrame(rows, "id long, true_label string, pred_label string")

    return make


def _metrics(df):
    per_class = evaluation.class_metrics(evaluation.confusion(df))
    return {r.label: r for r in per_class.collect()}, evaluation.overall_metrics(per_class).first()


def test_A8_perfect(judged):
    each, overall = _metrics(judged([0, 1, 2, 3] * 2, [0, 1, 2, 3] * 2))
    assert (overall.accuracy, overall.macro_f1) == (1.0, 1.0)
    assert all((r.precision, r.recall, r.f1, r.support) == (1.0, 1.0, 1.0, 2) for r in each.values())


def test_A8_one_wrong(judged):
    each, overall = _metrics(judged([0, 1, 2, 3], [0, 1, 2, 2]))
    assert overall.accuracy == 0.75 and overall.macro_f1 == pytest.approx((1 + 1 + 2 / 3) / 4)
    assert (each["high"].precision, each["high"].recall, each["high"].f1) == (0.5, 1.0, pytest.approx(2 / 3))
    assert (each["urgent"].precision, each["urgent"].recall, each["urgent"].f1, each["urgent"].support) == (0, 0, 0, 1)


def test_A8_absent_classes(judged):
    each, overall = _metrics(judged([0, 1], [0, 1]))
    assert overall.macro_f1 == 1.0 and len(each) == 4 and each["urgent"].f1 == 0.0


def test_A8_empty(judged):
    _, overall = _metrics(judged([], []))
    assert (overall.accuracy, overall.macro_f1) == (0.0, 0.0)


def test_A7(judged):
    matrix = evaluation.confusion(judged([0, 1, 2, 3, 0], [0, 1, 2, 2, 1]))
    cells = {(t, p): n for t, p, n in pairs(matrix, "true_label", "pred_label", "n")}
    assert len(cells) == 16 and sum(cells.values()) == 5
    assert (cells["low", "low"], cells["low", "medium"], cells["urgent", "high"], cells["urgent", "urgent"]) == (1, 1, 1, 0)


def test_A9(judged):
    flat = dict(pairs(evaluation.flat_metrics(evaluation.confusion(judged([0, 1], [0, 0]))), "metric", "value"))
    assert len(flat) == 14 and flat["accuracy"] == 0.5 and flat["precision_low"] == 0.5 and flat["recall_medium"] == 0.0


def test_M4(judged):
    few = evaluation.error_sample(judged([0, 1, 2, 3], [0, 2, 2, 0]), "id", n=10)
    assert sorted(column(few, "id")) == [1, 3]
    assert evaluation.error_sample(judged([0], [0]), "id").count() == 0
    many = judged([0] * 100, [1] * 100)
    got = column(evaluation.error_sample(many, "id"), "id")
    assert len(got) == len(set(got)) == 20 and got == column(evaluation.error_sample(many.repartition(9), "id"), "id")
    assert set(got) != set(column(evaluation.error_sample(many, "id", seed=1), "id"))


def test_X2(spark):
    df = spark.createDataFrame([([5.0, 1.0, 0.0, 0.0], 0), ([1.0, 1.0, 0.0, 0.0], 1), ([0.0, 0.0, 0.0, 9.0], 3)], "logits array<double>, label_id int")
    flat = dict(pairs(evaluation.logit_metrics(df), "metric", "value"))
    assert set(flat) == {"accuracy", "macro_f1", "f1_low", "f1_medium", "f1_high", "f1_urgent"}
    assert flat["accuracy"] == pytest.approx(2 / 3)


def test_F11(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0, 0.0],), (None,)], "x array<double>")
    p = scores.softmax(F.col("x"))
    row, none = df.select(p.alias("p"), scores.top_label(p).alias("l"), scores.score_map(p).alias("m")).collect()
    assert row.p == [0.5, 0.5, 0.0, 0.0] and row.l == "low" and set(row.m) == set(S.LABELS)
    assert none.p is None and none.l is None


def test_F10(spark):
    given = {"low": 0.01, "medium": 0.04, "high": 0.15, "urgent": 0.8}
    df = spark.createDataFrame([(given,)], "m map<string,double>")
    assert column(df.select(scores.scores_from_json(scores.scores_to_json(F.col("m"))).alias("m")), "m") == [given]


def test_F8_F13_F14_F17(spark):
    df = spark.createDataFrame([("2026-04-19 02:03:04.5",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    row = df.select(ids.run_id("pred", F.col("t")).alias("r"), ids.iso_utc(F.col("t")).alias("i")).first()
    assert (row.r, row.i) == ("pred-20260419-020304", "2026-04-19T02:03:04Z")
    names = spark.createDataFrame([("Run.1 é_x-" + "y" * 70,)], "x string")
    assert column(names.select(ids.safe_label(F.col("x")).alias("y")), "y") == [("run-1-é_x-" + "y" * 70)[:63]]
    uris = ["s://b/runs/run-7/model/", "s://b/runs/run-7/model", "s://b/runs/run-7", "model", "x//"]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    assert column(df.select(ids.run_of_artifact(F.col("u")).alias("r")), "r") == ["run-7", "run-7", "run-7", "model", "x"]
    two = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", "bc")], "x string, y string").select(ids.row_id("x", "y").alias("i"))
    a, b, c = column(two, "i")
    assert a == c != b


def test_F12_ids(judged):
    row = evaluation.label_ids(judged([3], [0])).first()
    assert (row.y_true, row.y_pred) == (3, 0)


def test_P11_P12_U2(spark):
    df = spark.createDataFrame([("low",), ("super-urgent",)], "priority string")
    assert column(contracts.unknown_labels(df, "priority"), "label") == ["super-urgent"]
    with pytest.raises(Exception, match="super-urgent"):
        contracts.require_known_labels(df, "priority").collect()
    with pytest.raises(ValueError, match="ticket_text"):
        contracts.require_columns(df, ["ticket_text", "priority"])


def test_P15(spark):
    tables = {
        "tickets": spark.createDataFrame([("t1", "x", "csv", "a", 1), ("t1", None, "csv", "a", 1)], "ticket_id string, text string, source string, user_id string, created_at int"),
        "feedback": spark.createDataFrame([("p1", "thumbs_up"), ("p9", "meh")], "prediction_id string, verdict string"),
        "predictions": spark.createDataFrame([("p1", "t1", "low", 0.5, "1", 1), ("p2", "t9", "odd", 0.5, "1", 1)], "prediction_id string, ticket_id string, predicted_priority string, confidence double, model_version string, created_at int"),
    }
    broken = {(t, r): n for t, r, n in pairs(contracts.contract_report(tables), "table_name", "rule", "violations") if n}
    assert broken == {
        ("tickets", "not_null(text)"): 1, ("tickets", "unique(ticket_id)"): 1, ("feedback", "domain(verdict)"): 1,
        ("feedback", "reference(prediction_id->predictions)"): 1, ("predictions", "reference(ticket_id->tickets)"): 1,
    }


def test_P15_each_table_is_scanned_once(spark, tmp_path):
    kinds = {
        "tickets": "ticket_id string, text string, source string, user_id string, created_at timestamp",
        "predictions": "prediction_id string, ticket_id string, predicted_priority string, confidence double, model_version string, created_at timestamp",
        "feedback": "prediction_id string, verdict string", "rate_limit_counters": "user_id string, window_start timestamp, count long",
    }
    tables = {}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.schema(kind).parquet(str(tmp_path / name))
    report = contracts.contract_report(tables)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4 and plan.count("Exchange hashpartitioning") == 1
    assert {r.violations for r in report.collect()} == {0} and report.count() == 22


def test_P15_keys_of_several_columns_and_a_hot_reference(spark):
    tables = {
        "rate_limit_counters": spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", None, 3), ("a", None, 4), (None, 1, 5), ("a", 2, 6)], "user_id string, window_start int, count long"),
        "predictions": spark.range(900).select(
            F.col("id").alias("prediction_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("gone").alias("ticket_id"), F.lit("low").alias("predicted_priority"),
            F.lit(0.5).alias("confidence"), F.lit("1").alias("model_version"), F.lit(1).alias("created_at")),
        "tickets": spark.createDataFrame([("hot", "x", "csv", "a", 1)], "ticket_id string, text string, source string, user_id string, created_at int"),
        "feedback": spark.createDataFrame([("7", None)], "prediction_id string, verdict string"),
    }
    broken = {(t, r): n for t, r, n in pairs(contracts.contract_report(tables), "table_name", "rule", "violations") if n}
    assert broken == {
        ("rate_limit_counters", "unique(user_id,window_start)"): 2, ("rate_limit_counters", "not_null(user_id)"): 1,
        ("rate_limit_counters", "not_null(window_start)"): 2, ("predictions", "reference(ticket_id->tickets)"): 600, ("feedback", "not_null(verdict)"): 1,
    }


def test_labels_cover_both_orders():
    assert sorted(S.LABELS) == sorted(S.QUEUE_ORDER) and labels._labels is not None
