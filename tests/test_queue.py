import pytest
from conftest import column, minutes, nulls_first, pairs
from pyspark.sql import functions as F

from ticketspark.operators import queue


@pytest.fixture
def ordered(make_tickets, make_predictions):
    ages = {"t1": (-5, "low"), "t2": (-4, "urgent"), "t3": (-3, "medium"), "t4": (-1, "urgent"), "t5": (-2, "high")}
    tickets = make_tickets([(t, "a", minutes(m), None) for t, (m, _) in ages.items()])
    return tickets, make_predictions([(f"p{t}", t, p, minutes(m), "1") for t, (m, p) in ages.items()])


def test_T1_order(ordered):
    assert column(queue.triage_queue(*ordered, user_id="a"), "ticket_id") == ["t4", "t2", "t5", "t3", "t1"]


def test_T1_limit(ordered):
    assert queue.triage_queue(*ordered, limit=2).count() == 2
    for bad in (0, 501, 1000):
        with pytest.raises(ValueError):
            queue.triage_queue(*ordered, limit=bad)


def test_P8_pending_is_unknown_and_last(make_tickets, make_predictions):
    tickets = make_tickets([("t1", "a", minutes(0), None), ("t2", "a", minutes(5), None), ("t3", "a", minutes(4), None)])
    predictions = make_predictions([("p1", "t1", "low", minutes(0), "1"), ("p3", "t3", "", minutes(0), "1")])
    rows = queue.triage_queue(tickets, predictions).collect()
    assert [(r.ticket_id, r.predicted_priority) for r in rows] == [("t1", "low"), ("t2", "unknown"), ("t3", "unknown")]
    assert rows[1].all_scores == {} and rows[1].prediction_id is None
    assert rows[0].all_scores["medium"] == 0.77


def test_P2_scope_and_resolved(make_tickets, make_predictions):
    tickets = make_tickets([("t1", "a", minutes(0), None), ("t2", "a", minutes(1), minutes(2)), ("t3", "b", minutes(0), None)])
    none = make_predictions([])
    assert column(queue.triage_queue(tickets, none, user_id="a"), "ticket_id") == ["t1"]
    assert column(queue.triage_queue(tickets, none, user_id="a", include_resolved=True), "ticket_id") == ["t2", "t1"]
    assert column(queue.triage_queue(tickets, none, user_id="c"), "ticket_id") == []


def test_W1_tie_goes_to_larger_id(make_predictions):
    p = make_predictions([("p1", "t", "low", minutes(0), "1"), ("p2", "t", "high", minutes(0), "1"), ("p0", "t", "urgent", minutes(-1), "1")])
    assert column(queue.newest_prediction(p), "prediction_id") == ["p2"]


def test_W1_does_not_depend_on_partitioning(make_predictions):
    p = make_predictions([(f"p{i:03d}", f"t{i % 7}", "low", minutes(i % 5), "1") for i in range(200)])
    wanted = pairs(queue.newest_prediction(p), "ticket_id", "prediction_id")
    for n in (1, 13):
        assert pairs(queue.newest_prediction(p.orderBy(F.rand(n)).repartition(n)), "ticket_id", "prediction_id") == wanted


def test_W1_plan_cuts_before_the_shuffle(ordered):
    plan = queue.triage_queue(*ordered)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "TakeOrderedAndProject" in plan


def test_J2_lookup(ordered):
    assert column(queue.ticket_lookup(*ordered, "t2", "a"), "predicted_priority") == ["urgent"]
    assert queue.ticket_lookup(*ordered, "t2", "b").count() == 0
    assert queue.ticket_lookup(*ordered, "nope", "a").count() == 0


def test_J2_filter_reaches_both_scans(spark, sf_dir):
    from ticketspark.plans import bindings as B

    found = queue.ticket_lookup(B.tickets(spark, sf_dir), B.predictions(spark, sf_dir), 5, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,5)" in plan and "EqualTo(l_orderkey,5)" in plan


def test_J2_many(ordered, spark):
    asked = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("zz", "a")], "ticket_id string, user_id string")
    assert pairs(queue.lookup_many(asked, *ordered), "ticket_id", "user_id", "found") == [
        ("t1", "a", True), ("t1", "b", False), ("zz", "a", False)
    ]


def test_queue_per_user(make_tickets, make_predictions):
    tickets = make_tickets([(f"t{i}", "ab"[i % 2], minutes(i), None) for i in range(6)])
    rows = pairs(queue.queue_per_user(tickets, make_predictions([]), limit=2), "user_id", "position", "ticket_id")
    assert rows == [("a", 1, "t4"), ("a", 2, "t2"), ("b", 1, "t5"), ("b", 2, "t3")]


def test_T2_history(make_tickets):
    tickets = make_tickets([("t1", "a", minutes(0), None), ("t2", "a", minutes(3), minutes(4)), ("t3", "b", minutes(1), None)])
    assert column(queue.user_history(tickets, "a"), "ticket_id") == ["t2", "t1"]
    assert column(queue.user_history(tickets), "ticket_id") == ["t2", "t1", "t3"]


def test_P10_A14_A3(make_tickets, make_predictions):
    tickets = make_tickets([("t1", "a", minutes(0), None), ("t2", "a", minutes(1), minutes(2)), ("t3", "b", minutes(0), None)])
    records = queue.with_newest_prediction(tickets, make_predictions([("p1", "t1", "low", minutes(0), "1")]))
    classified, waiting = queue.split_pending(records)
    assert column(classified, "ticket_id") == ["t1"] and sorted(column(waiting, "ticket_id")) == ["t2", "t3"]
    assert queue.queue_counts(records).first().asDict() == {"total": 3, "classified": 1, "pending": 2}
    assert [tuple(r) for r in queue.status_counts(tickets).collect()] == [("a", 1, 1), ("b", 1, 0)]


def test_P14_resolutions(spark, make_tickets):
    tickets = make_tickets([("t1", "a", minutes(0), None), ("t2", "a", minutes(0), minutes(1)), ("t3", "b", minutes(0), None)])
    changes = spark.createDataFrame(
        [("c1", "t1", "a", "resolve", minutes(2)), ("c2", "t1", "a", "resolve", minutes(3)), ("c3", "t2", "a", "reopen", minutes(4)),
         ("c4", "t3", "a", "resolve", minutes(5)), ("c5", "zz", "a", "resolve", minutes(5)), ("c6", "t1", "b", "reopen", minutes(9))],
        "change_id string, ticket_id string, user_id string, action string, changed_at timestamp",
    )
    after = queue.apply_resolutions(tickets, changes)
    assert after.columns == tickets.columns
    assert pairs(after, "ticket_id", "resolved_at") == sorted([("t1", minutes(3)), ("t2", None), ("t3", None)], key=nulls_first)
    assert sorted(column(queue.rejected_resolutions(tickets, changes), "change_id")) == ["c4", "c5", "c6"]


def test_J10_purge(spark, make_tickets, make_predictions):
    tickets = make_tickets([("t1", "a", minutes(0), None), ("t2", "b", minutes(0), None)])
    predictions = make_predictions([("p1", "t1", "low", minutes(0), "1"), ("p2", "t2", "low", minutes(0), "1")])
    feedback = spark.createDataFrame([("f1", "p1"), ("f2", "p2"), ("f3", "p2")], "feedback_id string, prediction_id string")
    counters = spark.createDataFrame([("a", 1), ("b", 2)], "user_id string, count int")
    left = queue.purge_users(spark.createDataFrame([("a",)], "user_id string"), tickets, predictions, feedback, counters)
    assert column(left["tickets"], "ticket_id") == ["t2"]
    assert column(left["predictions"], "prediction_id") == ["p2"]
    assert sorted(column(left["feedback"], "feedback_id")) == ["f2", "f3"]
    assert column(left["rate_limit_counters"], "user_id") == ["b"]


def test_bucketed_tables_need_no_shuffle(spark, sf_dir, tmp_path):
    from ticketspark.operators.selection import unscored
    from ticketspark.plans import bindings as B
    from ticketspark.sources.tables import save_bucketed

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tickets = save_bucketed(B.tickets(spark, sf_dir), "bucketed_tickets", str(tmp_path / "t"), 4)
        predictions = save_bucketed(B.predictions(spark, sf_dir), "bucketed_predictions", str(tmp_path / "p"), 4)
        for df in (queue.with_newest_prediction(tickets, predictions), unscored(tickets, predictions, "N")):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        names = ("ticket_id", "prediction_id")
        plain = queue.with_newest_prediction(B.tickets(spark, sf_dir), B.predictions(spark, sf_dir))
        assert pairs(queue.with_newest_prediction(tickets, predictions), *names) == pairs(plain, *names)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_tickets")
        spark.sql("DROP TABLE IF EXISTS bucketed_predictions")
