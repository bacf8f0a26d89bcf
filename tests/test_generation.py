import json

import pytest
from conftest import column, nulls_first, pairs
from pyspark.sql import functions as F

from ticketspark.functions.replies import reply_strings
from ticketspark.operators import dataset, generation

REPLIES = {
    '["text1", "text2", "text3"]': ["text1", "text2", "text3"],
    '```json\n["a", "b"]\n```': ["a", "b"],
    '```\n["a"]\n```  ': ["a"],
    '```JSON ["a"]```': ["a"],
    'Here you go:\n["a", "b"]\nThanks.': ["a", "b"],
    'Sure [ok]: ["a"]': None,
    '["line\\nbreak", "quo\\"te", "é"]': ["line\nbreak", 'quo"te', "é"],
    '["a]", "[b"]': ["a]", "[b"],
    '```json\u3000["a"]\u00a0```': ["a"],
    '["raw\ttab"]': None,
    '["\\u00e9\\ud83d\\ude00"]': ["é😀"],
    '["a"] and ["b"]': None,
    '["a"]]': None,
    '["a"], ["b"]': None,
    '["a"]}': ["a"],
    '["a",]': None,
    '["bad \\x escape"]': None,
    ' [ "a" ,\n"b" ] ': ["a", "b"],
    "[]": [],
    "": None,
    "plain text": None,
    '{"a": "b"}': None,
    '{"a": ["x", "y"]}': ["x", "y"],
    "[1, 2, 3]": None,
    '["a", null]': None,
    "[null]": None,
    '["a", 1]': None,
    '["a", ["b"]]': None,
    '["a", true]': None,
    '"just a string"': None,
    '["unclosed"': None,
}


def test_F16(spark):
    df = spark.createDataFrame([(i, raw) for i, raw in enumerate(REPLIES)], "i int, raw string")
    got = dict(df.select("i", reply_strings(F.col("raw")).alias("x")).collect())
    assert got == dict(enumerate(REPLIES.values()))
    nothing = spark.createDataFrame([(None,)], "raw string")
    assert column(nothing.select(reply_strings(F.col("raw")).alias("x")), "x") == [None]


def test_F16_long_replies(spark):
    text = "x" * 300_000 + '\\"' * 50_000
    df = spark.createDataFrame([(json.dumps([text, "b"]),)], "raw string")
    assert column(df.select(reply_strings(F.col("raw")).alias("x")), "x") == [[text, "b"]]


@pytest.fixture
def todo(spark):
    rows = spark.createDataFrame([(i,) for i in (2, 3, 5, 8, 13, 21, 34)], "ticket_id long")
    return generation.chunked(rows)


def test_W5(todo, spark):
    assert pairs(todo, "batch_id", "pos", "ticket_id") == [
        (1, 0, 2), (1, 1, 3), (1, 2, 5), (1, 3, 8), (1, 4, 13), (2, 0, 21), (2, 1, 34)
    ]
    with pytest.raises(ValueError):
        generation.chunked(todo, size=0)


def test_M9_J8(spark, todo):
    five = '["a", "b", "c", "d", "e"]'
    raw = [(1, 1, '["too", "short"]'), (1, 2, five), (1, 3, five.upper()), (2, 1, "x"), (2, 2, "[1, 2]"), (2, 3, "no"), (2, 4, '["y", "z"]')]
    replies = spark.createDataFrame(raw, "batch_id long, attempt int, raw string")
    sizes = todo.groupBy("batch_id").agg(F.count("*").alias("n_rows"))
    accepted = generation.accepted_replies(replies, sizes)
    assert pairs(accepted, "batch_id", "attempt") == [(1, 2)]
    merged = generation.merge_replies(todo, accepted)
    assert pairs(merged, "ticket_id", "ticket_text") == sorted(
        [(2, "a"), (3, "b"), (5, "c"), (8, "d"), (13, "e"), (21, None), (34, None)], key=nulls_first
    )


def test_S4_W6_J7_A12(spark):
    saved = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, "  ", 3), (2, None, 4), (3, "x", 5)], "ticket_id long, ticket_text string, position long")
    existing = generation.existing_texts(saved, "position")
    assert pairs(existing, "ticket_id", "ticket_text") == [(1, "new"), (3, "x")]
    grid = spark.range(1, 5).withColumnRenamed("id", "ticket_id")
    assert sorted(column(generation.still_to_do(grid, existing), "ticket_id")) == [2, 4]
    merged = spark.createDataFrame([(2, "made"), (4, None)], "ticket_id long, ticket_text string")
    whole = generation.resume(grid, existing, merged)
    assert pairs(whole, "ticket_id", "ticket_text") == sorted([(1, "new"), (2, "made"), (3, "x"), (4, None)], key=nulls_first)
    assert generation.completion(whole).first().asDict() == {"total": 4, "filled": 3, "missing": 1, "share": 0.75}
    assert generation.completion(whole.limit(0)).first().share is None


def test_F15(spark):
    grid = dataset.build_grid(spark, noise_rate=None).where("ticket_id <= 6")
    first, second = generation.prompt_batches(grid).orderBy("batch_id").collect()
    assert (first.n_rows, second.n_rows) == (5, 1)
    assert first.prompt.startswith("Given the following 5 customer support scenarios, write one ticket message")
    assert "JSON array of exactly 5 strings" in first.prompt and "exactly 1 strings" in second.prompt
    assert "\nScenarios:\n1. Write a single customer support message" in first.prompt
    assert "\n5. Write a single" in first.prompt and "\n6. " not in first.prompt
    assert "- Product: Laptop (Electronics)\n- Customer sentiment: neutral\n- Issue complexity: less\n" in first.prompt
    assert first.prompt.endswith("not stated explicitly.")
