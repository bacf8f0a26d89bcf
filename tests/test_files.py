import json

import pytest
from conftest import T0, column, pairs
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.operators import evaluation, events, generation
from ticketspark.plans import queries
from ticketspark.sources import artifacts, datasets, uploads


@pytest.fixture
def upload(spark, tmp_path):
    def make(**files):
        for name, data in files.items():
            (tmp_path / f"{name}.csv").write_bytes(data if isinstance(data, bytes) else data.encode())
        return uploads.read_uploads(spark, str(tmp_path))

    return make


def test_S1_headers(upload):
    texts = upload(
        a="text\nfirst ticket here\nsecond ticket\n", b="id,message\n1,from message\n", c="Description ,x\nfrom description,1\n",
        d="TICKET_TEXT\nfrom ticket text\n", e="unknown_col,other\nfirst column,zz\n", f="message,text\nthe message,the text\n",
    )
    assert sorted(column(texts, "text")) == sorted([
        "first ticket here", "second ticket", "from message", "from description", "from ticket text", "first column", "the message"
    ])


def test_S1_short_blank_and_empty(upload):
    texts = upload(a="text\nok\n\n  padded text  \n    \n1234\n12345\n", b="text\n")
    assert sorted(column(texts, "text")) == ["12345", "padded text"]
    assert pairs(uploads.upload_counts(texts), "accepted", "skipped") == [(2, 0)]


def test_S1_byte_order_mark(upload):
    texts = upload(a=b"\xef\xbb\xbfother,\xef\xbb\xbftext\nfirst one,second one\n", b=b"\xef\xbb\xbftext,a\nmarked file,zzzzzz\n")
    assert "marked file" in column(texts, "text")


def test_S1_ragged_quotes_and_bad_bytes(upload):
    texts = upload(
        a='id,text\n1\n2,"two\nlines, ""quoted"""\n3,three is here,extra\n', b=b"text\nbad \xff byte\n", c="text,text\nfirst value,last value\n"
    )
    assert sorted(column(texts, "text")) == ["bad � byte", "last value", 'two\nlines, "quoted"', "three is here"][:1] + [
        "last value", "three is here", 'two\nlines, "quoted"'
    ]


def test_T4_cap_keeps_file_order(upload):
    texts = upload(a="text\n" + "".join(f"ticket number {i}\n" for i in range(600)), b="text\nonly one here\n")
    capped = uploads.cap_uploads(texts)
    rows = [t for _, t in pairs(capped.where(F.col("file").endswith("a.csv")), "position", "text")]
    assert rows == [f"ticket number {i}" for i in range(500)]
    assert pairs(uploads.upload_counts(texts), "accepted", "skipped") == [(1, 0), (500, 100)]


def test_S1_splittable_mode(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text\n" + "".join(f"ticket number {i}\n" for i in range(50)))
    texts = uploads.read_uploads(spark, str(tmp_path), multi_line=False)
    assert [t for _, t in pairs(uploads.cap_uploads(texts, 3), "position", "text")] == [f"ticket number {i}" for i in range(3)]


def _by_one_task(spark, path):
    """What a reader of whole files gives: the text column of each file, in order."""
    out = []
    for file in sorted(path.glob("*.csv")):
        rows = [list(r) for r in spark.read.options(multiLine=True, quote='"', escape='"').csv(str(file)).collect()]
        names = [(h or "").strip().lower() for h in rows[0]]
        place = next((i for i, n in enumerate(names) if n in S.UPLOAD_COLUMNS), 0)
        out += [t for r in rows[1:] if len(t := (r[place] or "").strip()) >= S.MIN_UPLOAD_CHARS]
    return out


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_S1_one_file_is_read_by_many_tasks(spark, tmp_path, block):
    """Blocks of a few bytes cut records, quoted line breaks and pairs of quotes anywhere."""
    fields = [
        "plain text", '"quoted, with comma"', '"two\nlines here"', '"say ""hi"" twice"', '"ends in quote"""', '"\n\n\nthree breaks"', '5" screen broken',
        '"crlf\r\ninside"', '""', '"a,""b\n"",c"', 'tail" quote', '"many\n""quotes""\n""\nin ""\nit"', "",
    ]
    rows = "".join(f"{i},{fields[(i * 7) % len(fields)]},{fields[i % len(fields)]}\n" for i in range(60))
    (tmp_path / "a.csv").write_text("id,note,text\n" + rows, newline="")
    (tmp_path / "b.csv").write_text('"text\n",message\n' + rows.replace("\n", "\r\n") if block == 64 else "text\n" + "fine text\n" * 3, newline="")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(block))
    try:
        texts = uploads.read_uploads(spark, str(tmp_path))
        got = [r.text for r in texts.orderBy("file", "line").collect()]
        n_tasks = spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions()
    finally:
        spark.conf.set(name, before)
    assert n_tasks >= 2
    want = [t.replace("\r\n", "\n") for t in _by_one_task(spark, tmp_path)]
    assert [t.replace("\r\n", "\n") for t in got] == want


def test_S7(upload):
    texts = upload(a="text\nfirst ticket\nfirst ticket\n")
    rows = uploads.pending_tickets(uploads.cap_uploads(texts), "user", F.lit(T0))
    assert rows.columns == S.TICKETS.fieldNames()
    got = rows.collect()
    assert len({r.ticket_id for r in got}) == 2 and {(r.source, r.user_id, r.created_at, r.resolved_at) for r in got} == {("csv", "user", T0, None)}
    assert sorted(column(rows, "ticket_id")) == sorted(r.ticket_id for r in got)


CSV = 'ticket_id,ticket_text,priority\n3,third text, HIGH \n1,first text,low\n2,,low\n4,fourth text,\n5,NA,low\n6,sixth text,Urgent\n'


def test_S2(spark, tmp_path):
    path = tmp_path / "set.csv"
    path.write_text(CSV)
    rows = datasets.load_labelled(spark, str(path))
    assert pairs(rows, "ticket_id", "priority") == [("1", "low"), ("3", "high"), ("6", "urgent")]
    assert pairs(datasets.load_labelled(spark, str(path), max_rows=2), "ticket_id") == [("1",), ("3",)]
    assert pairs(datasets.load_labelled(spark, str(path), max_rows=1), "ticket_id") == [("3",)]


@pytest.mark.parametrize(("ids", "cap", "kept"), [
    (["a", "b", "c", "d"], 2, ["a", "b"]), (["1", "1", "1", "1", "2"], 2, ["1", "1"]), (["9", "8", "7", "1", "2"], 2, ["8", "9"]),
    (["", str(10**25), "-5"], 2, [None, str(10**25)]), (["1"], 5, ["1"]), (["1"], 0, []),
])
def test_S2_cap_counts_rows_of_the_files(spark, tmp_path, ids, cap, kept):
    for part, some in enumerate((ids[:2], ids[2:])):
        # The later file is much larger, which changes the order in which Spark packs them.
        (tmp_path / f"part-{part}.csv").write_text("ticket_id,ticket_text,priority\n" + "".join(f"{i},{'text ' * (1 + 900 * part)},low\n" for i in some))
    got = datasets.load_labelled(spark, str(tmp_path), max_rows=cap)
    assert sorted(column(got, "ticket_id"), key=str) == sorted(kept, key=str)


def test_S4_last_file_wins(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("ticket_id,ticket_text\n1,old\n2,only\n")
    (tmp_path / "part-1.csv").write_text("ticket_id,ticket_text\n1,new\n" + "".join(f"{i},{'x' * 900}\n" for i in range(10, 300)))
    texts = generation.existing_texts(datasets.saved_texts(spark, str(tmp_path)), "position")
    assert pairs(texts.where("ticket_id < 10"), "ticket_id", "ticket_text") == [(1, "new"), (2, "only")]


def test_S1_header_with_a_line_break(upload):
    texts = upload(a='"Ticket\nnumber","a, b",text\n1,x,first good row\n2,y,second good row\n')
    assert sorted(column(texts, "text")) == ["first good row", "second good row"]


def test_S2_checks(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("ticket_id,ticket_text,priority\n1,text,super-urgent\n")
    with pytest.raises(Exception, match="super-urgent"):
        datasets.load_labelled(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "short.csv").write_text("ticket_id,priority\n1,low\n")
    with pytest.raises(ValueError, match="ticket_text"):
        datasets.load_labelled(spark, str(tmp_path / "short.csv"))


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_S3_round_trip(spark, tmp_path, format):
    rows = [(1, 'quote " comma , back\\slash'), (2, "line\nbreak"), (3, "  outer blanks  "), (4, "é 　")]
    path = str(tmp_path / "out")
    datasets.write_dataset(spark.createDataFrame(rows, "ticket_id long, ticket_text string"), path, format)
    back = datasets.read_csv(spark, path) if format == "csv" else spark.read.parquet(path)
    assert pairs(back.select(F.col("ticket_id").cast("long").alias("i"), "ticket_text"), "i", "ticket_text") == rows


def test_S4(spark, tmp_path):
    assert datasets.saved_texts(spark, str(tmp_path / "missing.csv")).count() == 0
    (tmp_path / "raw.csv").write_text("ticket_id,ticket_text,x\n1,old,a\n1,new,b\n2,,c\n3, ,d\n")
    assert pairs(datasets.saved_texts(spark, str(tmp_path / "raw.csv")), "ticket_id", "ticket_text") == [(1, "new"), (1, "old")]


def test_S10(spark, tmp_path):
    judged = spark.createDataFrame([("low", "low"), ("high", "low")], "true_label string, pred_label string")
    matrix = evaluation.confusion(judged)
    split = spark.createDataFrame([("train",), ("train",), ("test",)], "split string")
    summary = artifacts.train_summary(split, 1.5, 0.25)
    artifacts.write_artifacts(str(tmp_path), metrics=evaluation.flat_metrics(matrix), confusion_matrix=matrix, train_summary=summary)
    assert spark.read.json(str(tmp_path / "confusion_matrix")).count() == 16
    assert summary.first().asDict() == {
        "train_runtime_sec": 1.5, "train_loss": 0.25, "num_train_samples": 2, "num_val_samples": 0, "num_test_samples": 1
    }
    with pytest.raises(ValueError):
        artifacts.write_artifacts(str(tmp_path), other=matrix)


def test_S12_fields(spark):
    df = spark.createDataFrame([("t1", "x" * 150, 0.5, None)], "ticket_id string, text string, confidence double, model_run_id string")
    (line,) = column(events.event_lines(df, "ticket_created", text="text"), "value")
    record = json.loads(line)
    assert list(record) == ["severity", "event", *events.EVENT_FIELDS["ticket_created"]]
    assert record["prediction_id"] is None and record["latency_ms"] is None
    assert record["input_preview"] == "x" * 100 and record["input_length_chars"] == 150 and record["model_run_id"] is None
    (line,) = column(events.event_lines(spark.createDataFrame([(500, "boom", "/predict")], "status_code int, error string, endpoint string"), "model_endpoint_error"), "value")
    assert json.loads(line) == {"severity": "ERROR", "event": "model_endpoint_error", "status_code": 500, "error": "boom", "endpoint": "/predict"}
    (line,) = column(events.message_lines(spark.createDataFrame([("hello",)], "m string"), "m", "WARNING"), "value")
    assert json.loads(line) == {"severity": "WARNING", "message": "hello"}
    assert set(events.EVENT_FIELDS) == set(S.LOG_EVENTS)


def test_S11(spark, tmp_path):
    lines = [json.dumps({"severity": s, "event": e, "ts": t}) for s, e, t in (
        ("INFO", "prediction", "2026-01-01"), ("ERROR", "model_endpoint_error", "2026-01-03"), ("INFO", "ticket_created", "2026-01-02"),
    )] + ["not json"]
    artifacts.write_lines(spark.createDataFrame([(x,) for x in lines], "value string"), str(tmp_path / "log"))
    records = events.parse_lines(artifacts.read_lines(spark, str(tmp_path / "log")), "severity string, event string, ts string")
    assert column(events.newest_events(records, events=["prediction", "ticket_created"]), "event") == ["ticket_created", "prediction"]
    assert column(events.newest_events(records, severities=["ERROR"]), "event") == ["model_endpoint_error"]
    assert column(events.newest_events(records.where("event is not null"), limit=1), "ts") == ["2026-01-03"]


def test_S2_S4_files_grow_in_number_not_in_rows(spark, tmp_path):
    rows = spark.range(450_000).select(F.col("id").alias("ticket_id"), F.lit("x").alias("ticket_text"))
    queries._in_files(rows, "ticket_id", str(tmp_path / "csv"))
    back = datasets.read_csv(spark, str(tmp_path / "csv"), with_place=True)
    sizes = [r["count"] for r in back.groupBy("_file").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 200_000
    first = datasets.first_rows(back, datasets.PLACE, 3)
    assert [r["ticket_id"] for r in first.collect()] == ["0", "1", "2"]
