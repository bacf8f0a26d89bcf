from datetime import datetime, timedelta

import pytest
from conftest import T0, column, pairs
from pyspark.sql import functions as F

from ticketspark.operators import feedback, ranking, usage


@pytest.fixture
def requests(spark):
    """rows of (event_id, user_id, seconds after noon)"""

    def make(*rows):
        return spark.createDataFrame(
            [(i, u, T0 + timedelta(seconds=s)) for i, u, s in rows], "event_id long, user_id string, ts timestamp"
        )

    return make


def test_W3_boundary(requests):
    df = requests((1, "a", 0), (2, "a", 10), (3, "a", 59.999), (4, "a", 60))
    assert pairs(usage.request_decisions(df, limit=2), "event_id", "allowed") == [(1, True), (2, True), (3, False), (4, True)]


def test_W3_users_are_independent(requests):
    df = requests(*[(i, "a", i / 10) for i in range(51)], (100, "b", 1))
    got = dict(pairs(usage.request_decisions(df), "event_id", "allowed"))
    assert got[49] and not got[50] and got[100]


@pytest.mark.parametrize("window", ["minute", "hour", "day"])
def test_W3_hot_windows_are_numbered_the_same(spark, window):
    # One user holds most rows, many at the very same time.
    df = spark.range(4000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("u"), F.col("id") % 50)).otherwise("hot").alias("user_id"),
        (F.lit(T0) + F.make_dt_interval(secs=(F.col("id") * 37 % 700 / 3).cast("decimal(18,6)"))).alias("ts"),
    )
    plain = usage.request_decisions(df, 50, window)
    sliced = usage.request_decisions(df.repartition(5), 50, window, parts=40)
    names = ("event_id", "window_start", "request_number", "allowed")
    assert pairs(plain, *names) == pairs(sliced, *names)


def test_F7_A10(requests, spark):
    df = spark.createDataFrame(
        [(1, "u", datetime(2026, 4, 1, 14, 37, 42, 123456)), (2, "u", datetime(2026, 4, 1, 14, 37, 0)),
         (3, "u", datetime(2026, 4, 1, 14, 38, 0)), (4, "v", datetime(2026, 4, 1, 14, 37, 59))],
        "event_id long, user_id string, ts timestamp",
    )
    assert pairs(usage.request_counts(df), "user_id", "window_start", "count") == [
        ("u", datetime(2026, 4, 1, 14, 37), 2), ("u", datetime(2026, 4, 1, 14, 38), 1), ("v", datetime(2026, 4, 1, 14, 37), 1)
    ]


def test_F7_keeps_the_zoneless_type(spark, sf_dir):
    from ticketspark.plans import bindings as B

    assert dict(usage.request_counts(B.requests(spark, sf_dir)).dtypes)["window_start"] == "timestamp_ntz"


def test_A11_T5(requests):
    df = requests(*[(i, "a", 0) for i in range(52)], *[(100 + i, "b", 0) for i in range(51)], *[(200 + i, "c", 0) for i in range(50)])
    assert column(usage.limit_breaches(usage.request_counts(df)), "user_id") == ["a", "b"]
    assert column(usage.limit_breaches(usage.request_counts(df), top=1), "count") == [52]


def test_R2_sweep(requests):
    counts = usage.request_counts(requests((1, "a", 0), (2, "a", 60), (3, "a", 120)))
    assert usage.sweep(counts, F.lit(T0 + timedelta(seconds=60))).count() == 2


@pytest.fixture
def world(spark, make_tickets, make_predictions):
    from conftest import minutes

    tickets = make_tickets([("t1", "a", minutes(0), None), ("t2", "b", minutes(0), None)])
    predictions = make_predictions([("p1", "t1", "low", minutes(0), "1"), ("p2", "t2", "high", minutes(0), "1")])
    given = spark.createDataFrame(
        [("q1", "p1", "a", "thumbs_up", None), ("q2", "p1", "a", "thumbs_down", "no"), ("q3", "p2", "a", "thumbs_up", None),
         ("q4", "zz", "a", "thumbs_up", None), ("q5", "p1", "a", "meh", None)],
        "request_id string, prediction_id string, user_id string, verdict string, note string",
    )
    return given, predictions, tickets


def test_J4_P13(world):
    accepted, rejected = feedback.accept_feedback(*world)
    assert sorted(column(accepted, "request_id")) == ["q1", "q2"]
    assert pairs(rejected, "request_id", "reason") == [
        ("q3", "unknown_prediction"), ("q4", "unknown_prediction"), ("q5", "bad_verdict")
    ]


def test_J11(world):
    given, predictions, _ = world
    assert pairs(feedback.enrich_feedback(given, predictions), "request_id", "ticket_id", "predicted_priority") == [
        ("q1", "t1", "low"), ("q2", "t1", "low"), ("q3", "t2", "high"), ("q4", None, None), ("q5", "t1", "low")
    ]


def test_S9(world):
    from ticketspark import schemas as S
    from ticketspark.sources.tables import feedback_rows

    accepted, _ = feedback.accept_feedback(*world)
    rows = feedback_rows(accepted, F.lit(T0))
    assert rows.columns == S.FEEDBACK.fieldNames()
    assert rows.select("feedback_id").distinct().count() == 2


def test_W3_a_burst_at_one_instant_lies_in_many_ranges(spark):
    df = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("hot").alias("user_id"), F.lit(T0).alias("ts"))
    sizes = column(ranking.in_ranges(df, [F.col("user_id"), F.col("ts"), F.col("event_id")], 10).groupBy("_part").count(), "count")
    assert len(sizes) == 10 and max(sizes) < 4_000
    got = usage.request_decisions(df, 50, parts=10)
    assert got.where(F.col("request_number") != F.col("event_id") + 1).count() == 0 and got.count() == 20_000


def test_W5_an_outlier_moves_no_other_row(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 7, F.lit(2**60)).otherwise(F.col("id")).alias("k"))
    assert max(column(ranking.in_ranges(df, [F.col("k")], 10).groupBy("_part").count(), "count")) < 4_000
    assert ranking.dense_index(df, "k", "i", 10).where("k > 7 AND k < 20000 AND i <> k - 1").count() == 0


def test_T3_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (None,), (None,), (0,)], "k long")
    for n, want in ((0, []), (2, [0, 1]), (4, [0, 1, 1, 1]), (5, [0, 1, 1, 1, None]), (9, [0, 1, 1, 1, None, None])):
        assert sorted(column(ranking.first_rows(df, "k", n, 3), "k"), key=lambda k: (k is None, k or 0)) == want


def test_T3_few_rows_are_cut_before_any_shuffle_and_nothing_is_written(spark, monkeypatch):
    df = spark.range(10_000, numPartitions=8).select((F.col("id") * 7919 % 10_007).alias("k"), F.lit("x").alias("v"))
    monkeypatch.setattr(ranking, "written", None)
    rows = ranking.first_rows(df, "k", 1000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    shuffle = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert any("WindowGroupLimit" in line for line in lines[shuffle:]) and "TakeOrderedAndProject" in plan
    assert sorted(column(rows, "k")) == sorted(i * 7919 % 10_007 for i in range(10_000))[:1000]
