import os
from datetime import timedelta

import pytest
from conftest import T0, pairs
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.operators import usage
from ticketspark.plans import bindings as B
from ticketspark.plans import scoring
from ticketspark.sources import maintained, tables
from ticketspark.streaming import limits, pending, windows


@pytest.fixture
def folder(tmp_path):
    class Folder:
        def __getattr__(self, name):
            return str(tmp_path / name)

    return Folder()


def _arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


REQUESTS = "event_id long, user_id string, ts timestamp"


def _requests(*rows):
    return [(i, u, T0 + timedelta(seconds=s)) for i, u, s in rows]


def test_R1_equals_batch_once_closed(spark, folder):
    rows = _requests((1, "a", 0), (2, "a", 30), (3, "a", 61), (4, "b", 5), (5, "b", 3600))
    _arrive(spark, folder.inbox, rows[:2], REQUESTS)

    def step():
        stream = windows.request_windows(windows.read_stream(spark, folder.inbox))
        windows.to_table(stream, folder.out, folder.checkpoint).awaitTermination()

    step()
    _arrive(spark, folder.inbox, rows[2:], REQUESTS)
    step()
    batch = usage.request_counts(spark.read.parquet(folder.inbox)).where(F.col("window_start") < F.lit(T0 + timedelta(seconds=3000)))
    names = ("user_id", "window_start", "count")
    # The row an hour later closes all windows but its own.
    assert pairs(spark.read.parquet(folder.out), *names) == pairs(batch, *names)


def _decide(spark, folder, *rows, **options):
    """One more file arrives; a new query goes on from the checkpoint."""
    _arrive(spark, folder.inbox, _requests(*rows), REQUESTS)
    limits.decide_stream(windows.read_stream(spark, folder.inbox), folder.out, folder.checkpoint, **{"limit": 2, **options}).awaitTermination()
    return {i: (n, ok, late) for i, n, ok, late in pairs(spark.read.parquet(folder.out), "event_id", "request_number", "allowed", "late")}


def _counters(spark, folder):
    state = spark.read.format("statestore").option("stateVarName", "count").load(folder.checkpoint)
    return {(r.key.user_id, r.key._start_ms): r.value.n for r in state.collect()}


def test_R4_continues_over_batches_and_restarts(spark, folder):
    _decide(spark, folder, (1, "a", 0), (2, "a", 10), (3, "b", 0))
    _decide(spark, folder, (4, "a", 5), (5, "a", 70), (6, "b", 1))
    got = _decide(spark, folder, (7, "a", 20), (8, "b", 2), (9, "c", 0))
    # Numbered by arrival: request 4 came after 2, although its clock is earlier.
    assert got == {i: (*d, False) for i, d in {
        1: (1, True), 2: (2, True), 3: (1, True), 4: (3, False), 5: (1, True), 6: (2, True), 7: (4, False), 8: (3, False), 9: (1, True)}.items()}
    minute = {r.window_start: i for i, r in enumerate(usage.request_counts(spark.read.parquet(folder.inbox)).select("window_start").distinct().orderBy("window_start").collect())}
    counts = pairs(usage.request_counts(spark.read.parquet(folder.inbox)), "user_id", "window_start", "count")
    assert {(u, int(w.timestamp() * 1000)): n for u, w, n in counts} == _counters(spark, folder) and len(minute) == 2


def test_R4_files_in_one_query_are_batches(spark, folder):
    for rows in ([(1, "a", 0), (2, "a", 10)], [(3, "a", 5)], [(4, "a", 1), (5, None, 3), (6, "a", 2)]):
        _arrive(spark, folder.inbox, _requests(*rows), REQUESTS)
    stream = windows.read_stream(spark, folder.inbox, files_per_batch=1)
    limits.decide_stream(stream, folder.out, folder.checkpoint, limit=2).awaitTermination()
    numbers = {i: n for i, n in pairs(spark.read.parquet(folder.out), "event_id", "request_number")}
    assert numbers == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 5}


def test_R4_a_clock_in_the_future_resets_nothing(spark, folder):
    ahead = 100 * 365 * 86400
    _decide(spark, folder, (1, "a", 0), (2, "a", 1), (3, "a", 2), (4, "b", ahead))
    got = _decide(spark, folder, (5, "a", 3))
    assert got[4] == (1, True, False) and got[5] == (4, False, False)


def test_R2_R4_late_requests_are_named_and_old_counters_removed(spark, folder):
    past = -200 * 86400
    _decide(spark, folder, (1, "a", past), (2, "a", past + 1), (3, "a", past + 2), keep="1 hour")
    _decide(spark, folder, (4, "b", past + 7200), keep="1 hour")
    got = _decide(spark, folder, (5, "a", past + 3), (6, "b", past + 7201), keep="1 hour")
    # Never numbered from 1 again; the other user goes on.
    assert got[5] == (None, False, True) and got[6] == (2, True, False)
    assert {user for user, _ in _counters(spark, folder)} == {"b"}


def test_streams_over_a_file_and_over_part_files(spark, folder, tmp_path):
    rows = spark.createDataFrame(_requests((1, "a", 0), (2, "b", 1), (3, "c", 2)), REQUESTS)
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "events.parquet"))
    rows.toPandas().to_parquet(str(tmp_path / "events.parquet"), coerce_timestamps="us")
    for place in (tmp_path, tmp_path / "many"):
        stream = windows.table_stream(spark, str(place), "events.parquet")
        assert stream.isStreaming
        query = stream.select("event_id").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
        query.awaitTermination()
        assert pairs(spark.table("seen"), "event_id") == [(1,), (2,), (3,)]


TICKETS = "ticket_id string, text string"


@pytest.mark.parametrize("indexed", [False, True])
def test_R3_scores_each_ticket_once(spark, folder, indexed):
    scorer = scoring.column_scorer(B.text_features, B.text_logits)

    def step(version="1"):
        stream = windows.read_stream(spark, folder.inbox, files_per_batch=1)
        index = maintained.scored_ids(spark, folder.ids, version, 2) if indexed else None
        pending.score_pending_stream(
            stream, folder.out, getattr(folder, "checkpoint" + version), scorer, version, "run", F.lit(T0), index).awaitTermination()
        return tables.read_table(spark, folder.out, S.PREDICTIONS)

    _arrive(spark, folder.inbox, [("t1", "some text"), ("t2", " ")], TICKETS)
    assert pairs(step(), "ticket_id", "model_version") == [("t1", "1")]
    _arrive(spark, folder.inbox, [("t1", "some text"), ("t3", "more text")], TICKETS)
    done = step()
    assert pairs(done, "ticket_id", "model_version") == [("t1", "1"), ("t3", "1")]
    same = scoring.score(spark.createDataFrame([("t1", "some text"), ("t3", "more text")], "ticket_id string, ticket_text string"), scorer)
    assert pairs(done, "ticket_id", "predicted_priority", "confidence") == pairs(same, "ticket_id", "predicted_priority", "confidence")


def test_R4_stores_go_by_cores(spark, folder):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "40")
    try:
        got = _decide(spark, folder, (1, "a", 0), (2, "a", 10), (3, None, 0))
        assert spark.conf.get(name) == "40"
    finally:
        spark.conf.set(name, before)
    assert got == {1: (1, True, False), 2: (2, True, False), 3: (1, True, False)}
    stores = [p for p in os.listdir(f"{folder.checkpoint}/state/0") if p.isdigit()]
    assert len(stores) == spark.sparkContext.defaultParallelism


def test_R4_whole_numbers_with_nulls_stay(spark, folder):
    """Such a column held doubles on its way through pandas, which are exact to 2^53 only."""
    big = 2**53 + 1
    rows = [(2, "a", T0, None), (1, "a", T0, big), (None, "a", T0, big + 2), (3, "a", None, 5)]
    _arrive(spark, folder.inbox, rows, REQUESTS + ", size long")
    limits.decide_stream(windows.read_stream(spark, folder.inbox), folder.out, folder.checkpoint, limit=2).awaitTermination()
    got = pairs(spark.read.parquet(folder.out), "event_id", "size", "request_number", "allowed")
    assert got == [(None, big + 2, 3, False), (1, big, 1, True), (2, None, 2, True), (3, 5, 1, True)]


def test_R4_many_counters_in_a_bucket(spark, folder, monkeypatch):
    """A group is a bucket, not a user and window: its counters still are apart, also beyond what the store is asked at once."""
    monkeypatch.setattr(limits, "BUCKETS", 2)
    monkeypatch.setattr(limits, "PACKET_ROWS", 100)
    users = [None, *(f"u{i}" for i in range(400))]
    first = [(i, u, (i % 3) * 60) for i, u in enumerate(users)]
    got = _decide(spark, folder, *first)
    assert set(got.values()) == {(1, True, False)} and len(got) == 401
    again = [(1000 + 2 * i + k, u, (i % 3) * 60 + k) for i, u in enumerate(users) for k in range(2)]
    got = _decide(spark, folder, *again)
    assert {got[1000 + 2 * i] for i in range(401)} == {(2, True, False)} and {got[1001 + 2 * i] for i in range(401)} == {(3, False, False)}
    counters = _counters(spark, folder)
    assert len(counters) == 401 and set(counters.values()) == {3} and {user for user, _ in counters} == set(users)


def test_R2_all_counters_of_closed_windows_go(spark, folder):
    past = -200 * 86400
    _decide(spark, folder, *((i, f"u{i}", past + i % 60) for i in range(700)), keep="1 hour")
    assert len(_counters(spark, folder)) == 700
    _decide(spark, folder, (1000, "b", past + 7200), keep="1 hour")
    got = _decide(spark, folder, (1001, "u5", past + 5), keep="1 hour")
    assert got[1001] == (None, False, True) and {user for user, _ in _counters(spark, folder)} == {"b"}
