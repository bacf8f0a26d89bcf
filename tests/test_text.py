import re
import sys

import pytest
from conftest import column, pairs
from pyspark.sql import functions as F

from ticketspark.functions import text
from ticketspark.operators import cleaning
from ticketspark.sources import tables


@pytest.fixture(scope="module")
def every_character(spark):
    codes = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    return spark.createDataFrame([(c, f"a{chr(c)}b", chr(c)) for c in codes], "code int, between string, alone string")


def test_F1_F6_agree_with_python_on_every_character(every_character):
    got = every_character.select("code", text.word_count("between").alias("n"), text.is_blank("alone").alias("blank")).collect()
    for row in got:
        assert row.n == len(f"a{chr(row.code)}b".split()), hex(row.code)
        assert row.blank == (chr(row.code).strip() == ""), hex(row.code)


CASES = ["", " ", " 　", "\t\n", "one", " one  two ", "a\x1cb\x85c d", "x" * 50, "é ü　日本 語", None]


def test_F1_F6_on_texts(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, t string").select(
        "i", text.strip("t").alias("s"), text.word_count("t").alias("n"),
        *[text.has_words("t", k).alias(f"h{k}") for k in (0, 1, 2, 3)],
    )
    for row in df.collect():
        case = CASES[row.i]
        if case is None:
            assert row.s is None and row.n is None
            continue
        assert row.s == case.strip() and row.n == len(case.split())
        assert [row.h0, row.h1, row.h2, row.h3] == [row.n >= k for k in (0, 1, 2, 3)]


def test_has_words_is_linear_on_one_long_word(spark):
    df = spark.range(1).select(F.repeat(F.lit("x"), 2_000_000).alias("t"))
    assert column(df.select(text.has_words("t", 10).alias("h")), "h") == [False]


def test_F2(spark):
    df = spark.createDataFrame([("  HIGH ",), ("High_Priority",), ("other",), (None,), ("",)], "x string")
    assert column(df.select(text.normalise_label("x").alias("y")), "y") == ["high", "high_priority", "other", None, ""]
    assert column(df.select(text.display_label("x").alias("y")), "y") == ["unknown", "high", "unknown", "unknown", "unknown"]


def test_F9(spark):
    df = spark.createDataFrame([("T-1, T-2 ,,T-3",), ("  ",), (None,)], "x string")
    assert column(df.select(text.comma_list("x").alias("y")), "y") == [["T-1", "T-2", "T-3"], [], None]


def test_P6_P7(spark):
    df = spark.createDataFrame(
        [("12345",), (" 1234 ",), (None,), ("　",), ("x" * 10_000,), ("x" * 10_001,), (" " * 10_001,)], "t string"
    )
    got = df.select(text.long_enough("t").alias("ok"), text.reject_reason("t").alias("why")).collect()
    assert [tuple(r) for r in got] == [
        (True, None), (False, None), (False, "missing"), (False, "blank"), (True, None), (True, "too_long"), (False, "too_long")
    ]


def test_P9(spark):
    df = spark.createDataFrame([("a" * 250,), ("b" * 199 + "  tail",), ("short",), (None,)], "t string")
    got = df.select(text.log_preview("t").alias("p"), text.list_preview("t").alias("d")).collect()
    assert [r.p for r in got] == ["a" * 100, "b" * 100, "short", None]
    assert [r.d for r in got] == ["a" * 200 + "...", "b" * 199 + "...", "short", ""]


WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()


def sentence(n, tag=""):
    return " ".join([tag + w for w in WORDS[:n]])


@pytest.fixture
def mixed(spark):
    rows = [sentence(11), sentence(12), sentence(13), "", sentence(9), sentence(15), sentence(15)]
    return spark.createDataFrame(list(enumerate(rows, 1)), "ticket_id long, ticket_text string")


def test_M8_A6_mixed(mixed):
    assert sorted(column(cleaning.clean(mixed), "ticket_id")) == [1, 2, 3, 6]
    assert cleaning.clean_counters(mixed).first().asDict() == {
        "seen": 7, "dropped_blank": 1, "dropped_duplicate": 1, "dropped_short": 1, "dropped_total": 3, "kept": 4
    }


def test_M8_boundary_and_stage_order(spark):
    rows = [(1, sentence(10)), (2, sentence(9)), (3, sentence(9)), (4, None), (5, " 　"), (6, sentence(10).upper()), (7, sentence(10) + " ")]
    df = spark.createDataFrame(rows, "ticket_id long, ticket_text string")
    # Copies are case- and space-sensitive; the second short copy counts as a duplicate.
    assert sorted(column(cleaning.clean(df), "ticket_id")) == [1, 6, 7]
    got = cleaning.clean_counters(df).first()
    assert (got.dropped_blank, got.dropped_duplicate, got.dropped_short, got.kept) == (2, 1, 1, 3)


def test_M8_empty(spark):
    df = spark.createDataFrame([], "ticket_id long, ticket_text string")
    assert cleaning.clean(df).count() == 0
    assert set(cleaning.clean_counters(df).first()) == {0}


def test_W2_one_text_in_a_third_of_all_rows(spark):
    df = spark.range(3000).select(
        F.col("id").alias("ticket_id"),
        F.when(F.col("id") % 3 == 1, "same").otherwise(F.concat(F.lit("t"), "id")).alias("ticket_text"),
    )
    kept = cleaning.drop_duplicate_texts(df.repartition(7))
    assert kept.count() == 2001 and kept.where("ticket_text = 'same'").first().ticket_id == 1


def test_W2_repeated_key_keeps_its_own_text(spark):
    df = spark.createDataFrame([(1, "copy"), (2, "copy"), (2, "own"), (2, None)], "ticket_id long, ticket_text string")
    assert pairs(cleaning.drop_duplicate_texts(df), "ticket_id", "ticket_text") == [(1, "copy"), (2, None), (2, "own")]


def _plain_dedup(rows):
    """Per text the smallest key, NULL last; NULL texts all stay."""
    best = {}
    for key, text in rows:
        if text is not None:
            best[text] = min(best.get(text, (True, 0)), (key is None, key or 0))
    return sorted([(None if none else key, text) for text, (none, key) in best.items()] + [r for r in rows if r[1] is None], key=repr)


@pytest.mark.parametrize("rows", [
    [(1, "t"), (1, "t"), (2, "t")],
    [(None, "t"), (1, "t"), (2, "t")],
    [(None, "t"), (None, "t"), (None, "u"), (3, "v")],
    [(None, None), (None, None), (1, None), (1, None), (1, "x"), (1, "x"), (None, "x")],
    [(2, "a"), (2, "b"), (1, "b"), (1, "b"), (3, "a"), (3, "c"), (None, "c"), (None, "d"), (None, "d")],
    [],
])
def test_W2_true_repeats_and_null_keys(spark, rows):
    df = spark.createDataFrame(rows, "ticket_id long, ticket_text string").repartition(3)
    kept = cleaning.drop_duplicate_texts(df)
    assert sorted(pairs(kept, "ticket_id", "ticket_text"), key=repr) == _plain_dedup(rows)
    long = df.withColumn("ticket_text", F.concat("ticket_text", F.lit(" " + sentence(10))))
    assert cleaning.clean(long).count() == cleaning.clean_counters(long).first().kept


def test_W2_leaves_a_bucketed_table_in_place(spark, tmp_path):
    """Broadcast off: only the marks are exchanged, never the scan of the texts."""
    rows = spark.range(400).select((F.col("id") % 300).alias("ticket_id"), F.concat(F.lit("t"), F.col("id") % 97).alias("ticket_text"))
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    table = tables.save_bucketed(rows, "w2_texts", str(tmp_path / "texts"), 4)
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        kept = cleaning.drop_duplicate_texts(table)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        whole = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(pairs(kept, "ticket_id", "ticket_text"), key=repr) == _plain_dedup([tuple(r) for r in rows.collect()])
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
        spark.sql("DROP TABLE w2_texts")
    assert "SortMergeJoin" in plan and "ticket_text" in whole
    lines = whole.splitlines()
    for at, line in enumerate(lines):
        if "Exchange" in line:
            depth = re.search(r"[A-Z]", line).start()
            below = [later for later in lines[at + 1:] if re.search(r"[A-Z(]", later)]
            inside = []
            for later in below:
                if re.search(r"[A-Z]", later).start() <= depth:
                    break
                inside.append(later)
            assert not any("Scan" in x and "ticket_text" in x for x in inside)


def test_W2_groups_digests_not_texts(spark):
    df = spark.createDataFrame([(1, "a")], "ticket_id long, ticket_text string")
    plan = cleaning.drop_duplicate_texts(df)._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate ["):].splitlines()[0]
    assert "_digest" in grouped and "ticket_text" not in grouped


def test_P7_split(spark):
    df = spark.createDataFrame([("fine",), (" ",)], "ticket_text string")
    good, bad = cleaning.split_valid(df)
    assert column(good, "ticket_text") == ["fine"] and pairs(bad, "reason") == [("blank",)]


def test_python_space_set_is_the_fixed_set():
    assert set(text.SPACES) == {chr(c) for c in range(sys.maxunicode) if chr(c).isspace()}
