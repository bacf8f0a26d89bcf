"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketspark.llm import bagminhash, bitsliced, exact_dedup, maxent_lm, mixing, pieces, simple8b, substring_dedup, toxicity, warc
from ticketspark.llm.queries import vocabulary
from ticketspark.session import scratch_path

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PHRASE = " ".join(f"p{i}" for i in range(40))
# Columns named as the operators' own, and an id that repeats.
DOCS = "doc_id long, text string, source string, digest int, block int, node string, kept string, start int, row_id int"
ROWS = [
    (1, "a  b c", "s"), (2, None, None), (3, "", "s"), (4, LONG, "t"), (5, "a b\tc", None), (6, "a b c ", "s"), (6, "a b c ", "s"),
    (None, "a bc", "u"), (None, None, "u"), (8, " \n", "t"), (9, PHRASE + " x", "s"), (10, "y " + PHRASE, "s"), (11, "ünïcödé ▁ ok", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 1, 2, "n", "k", 3, 4) for i, t, s in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.filter("false")


def bag(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_op6(docs, none):
    got = bag(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept")
    # "a  b c" is the longest of its group, with 6 code points as (6, "a b c "); the smaller id stays.
    assert got == sorted([
        (1, 1, 5, True), (5, 1, 5, False), (6, 1, 5, False), (6, 1, 5, False), (None, 1, 5, False), (2, 8, 4, False), (3, 8, 4, False),
        (8, 8, 4, True), (None, 8, 4, False), (4, 4, 1, True), (9, 9, 1, True), (10, 10, 1, True), (11, 11, 1, True),
    ], key=repr)
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns and bag(kept, "doc_id") == sorted([(1,), (8,), (4,), (9,), (10,), (11,)], key=repr)
    twice = docs.filter("doc_id = 6")
    assert exact_dedup.keep_first_copies(twice).count() == 1
    assert bag(exact_dedup.exact_groups(twice), "kept") == [(False,), (True,)]
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.keep_first_copies(none).count() == 0


def test_op6_has_no_python_and_no_hot_merge(spark, docs):
    copies = spark.range(0, 3000, 1, 6).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    groups = exact_dedup.exact_groups(copies)
    assert "Python" not in groups._jdf.queryExecution().executedPlan().toString()
    assert bag(groups.filter("kept"), "doc_id", "group_size") == [(0, 3000)]


def test_op7(docs, none):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = bag(pieces.decode(pieces.encode(docs, path), path), "doc_id", "ids", "text")
    assert got == sorted(((i, model.encode(t or "", add_eos=True), model.decode(model.encode(t or "", add_eos=True))) for i, t, _ in ROWS), key=repr)
    assert pieces.decode(pieces.encode(none, path), path).count() == 0
    assert bag(pieces.encode_and_decode(docs, path), "doc_id", "ids", "text") == got and pieces.encode_and_decode(none, path).count() == 0


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a", " a", "a ", "a  b", "▁", "▁▁ a▁", "\t\n", "a\tb", "日本 語", "\U0001f600 x", "é", "\x00", " " * 40 + "x",
])
def test_op7_texts(text):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = pieces.Encoder(path)([text])[0]
    import numpy as np

    ids = np.frombuffer(raw, "<i4")
    assert ids.tolist() == model.encode(text, add_eos=True)
    assert pieces.Decoder(path)([ids]) == [model.decode(ids.tolist())]
    assert pieces.Decoder(path)([ids[1:]]) == [model.decode(ids[1:].tolist())]
    assert pieces.Decoder(path)([None]) == [None]


def test_op7_plain_texts_need_no_python_per_run():
    """Only runs with bytes of longer characters are cut and looked up one by one; all is as in the library."""
    path = vocabulary("piece_bpe_32k.model")
    values = ["one two\nthree", None, "", " ", "a  b ", "\x00 a", "日本 語 x", "▁▁a", "é è"]
    encoder, decoder = pieces.Encoder(path), pieces.Decoder(path)
    raw = [np.frombuffer(r, "<i4") for r in encoder(values)]
    assert [r.tolist() for r in raw] == [[*decoder.model.encode(v or ""), decoder.model.eos_id()] for v in values]
    plain = decoder(raw[:5])
    assert plain == [decoder.model.decode(r.tolist()) for r in raw[:5]] and not decoder.table
    assert decoder(raw) == [decoder.model.decode(r.tolist()) for r in raw] and decoder.table


def test_op10_n_grams_of_many_words_at_once():
    """The same buckets as word by word, whatever the width of the characters, and the same scores as text by text."""
    words = ["", "a", "ab", "...", "<>", "don't", "(Word),", "é", "naïveté", "日本語", "🙂ab🙂", "x" * 40, "İi"]
    flat, sizes = toxicity.bags(words)
    bags = [toxicity.subwords(w) for w in words]
    assert flat.tolist() == [b for bag in bags for b in bag] and sizes.tolist() == list(map(len, bags))
    assert [len(a) for a in toxicity.bags([])] == [0, 0]
    buckets = np.random.default_rng(3).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    texts = [" ".join(words), None, "", *words]
    together = toxicity.Scorer(buckets, -1.0, limit=4).all(texts)
    assert together == [toxicity.Scorer(buckets, -1.0)(t) for t in texts]


def test_op4(spark, docs, none):
    import zlib

    import numpy as np
    import tokenizers

    path = vocabulary("word_bpe_49k.json")
    model = tokenizers.Tokenizer.from_file(path)
    files = simple8b.write_token_files(docs, simple8b.token_folder(docs), path)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, text, _ in order:
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert bag(simple8b.token_summary(files), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    lists = {(r.doc_id, r.start): r.ids for r in simple8b.read_token_files(files).collect()}
    assert [len(lists[i, s]) for i, s, _, _ in want] == [n for _, _, n, _ in want]
    assert simple8b.token_summary(simple8b.write_token_files(none, simple8b.token_folder(docs), path)).count() == 0


@pytest.mark.parametrize("text", [
    "It's don't THE The 12a34 <|endoftext|> x<|startoftext|>y", "É’Ü ﬁ İ ΑΣ Σ", "á éx", "\x00\x1f\x7f ~`^ 1٣", "ß ÿ×÷ µª", "日本語 テスト", "...!!!a,b;c",
])
def test_op4_texts(text):
    import tokenizers

    path = vocabulary("word_bpe_49k.json")
    assert simple8b.word_encoder(path, None)([text])[0].tolist() == tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_op3(docs, none):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeated(docs, block_bytes=2000).collect()}
    assert (9, 41, 40, "x") in got and (10, 41, 40, "y") in got
    assert (6, 3, 0, "a b c") in got and (2, 0, 0, "") in got and (8, 0, 0, "") in got
    # The long text repeats itself with period 977.
    assert (4, 30_000, 30_000, "") in got
    assert len(substring_dedup.remove_repeated(docs).collect()) == len(ROWS)
    assert substring_dedup.remove_repeated(none).count() == 0


def test_op8(docs, none):
    documents, nodes, links = bagminhash.near_duplicates(docs)
    got = bag(documents, "doc_id", "class_id", "class_size", "kept")
    # Equal words are one class, whatever the white space; texts without words are alone.
    same = [(1, 1, 4, True), (5, 1, 4, False), (6, 1, 4, False), (6, 1, 4, False)]
    alone = [(2, 2, 1, True), (3, 3, 1, True), (8, 8, 1, True), (None, None, 1, True), (None, None, 1, True)]
    assert [r for r in got if r[0] not in (4, 9, 10, 11)] == sorted(same + alone, key=repr)
    # 36 of 38 runs are shared.
    assert (9, 9, 2, True) in got and (10, 9, 2, False) in got and links.count() == 1
    kept = bagminhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert bag(kept, "doc_id") == sorted([(1,), (2,), (3,), (4,), (8,), (9,), (11,), (None,), (None,)], key=repr)
    assert bagminhash.near_duplicates(none)[0].count() == 0 and bagminhash.keep_one_of_each(none).count() == 0


def test_op9(docs, none):
    got = maxent_lm.score_documents(docs).collect()
    assert len(got) == len(ROWS) and all(math.isfinite(r.score) and r.score <= 0 and r.base_score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 8)} == {1}
    assert maxent_lm.score_documents(none).count() == 0
    # Nothing to learn from: one unknown place.
    alone = maxent_lm.score_documents(docs, F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in alone} == {(0, 0, 0.0)}


def test_op9_counts_meet_summed(spark, docs):
    """A shard gets every key once, however many tasks count it; before, it got each task's own count."""
    frame = maxent_lm.learning(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.lit(False))

    def counted(parts):
        made = maxent_lm.count_contexts(frame.repartition(parts), np.empty(0, np.uint64))
        out = {}
        for r in made.collect():
            keys, counts = np.frombuffer(r["keys"], "<u4").tolist(), np.frombuffer(r["counts"], "<i8").tolist()
            assert all(k // maxent_lm.CLASSES // (maxent_lm.FREQUENT + 1) % maxent_lm.SHARDS == r["shard"] for k in keys)
            assert len(set(keys)) == len(keys) and not out.keys() & set(keys)
            out |= zip(keys, counts, strict=True)
        return out, made._jdf.queryExecution().optimizedPlan().toString()

    one, plan = counted(1)
    assert one and counted(40)[0] == one
    assert "sum(n" in plan[plan.index("FlatMapGroupsInArrow"):plan.index("MapInArrow send")]


def test_op10(spark, docs, none):
    labels = spark.createDataFrame(
        [(1, 0, "x"), (4, 0, "x"), (9, 1, "x"), (9, 0, "x"), (10, 1, "x"), (None, 1, "x"), (11, None, "x"), (77, 1, "x"), (6, 5, "x")],
        "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    left = toxicity.reject_toxic(docs, labels)
    assert left.columns == docs.columns and {2, 3, 8} <= {r.doc_id for r in left.collect()}
    assert {r.score for r in toxicity.toxicity(docs, labels.filter("false")).collect()} == {0.0}
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.reject_toxic(none, labels).count() == 0


def test_op5(docs, none):
    mixed = mixing.mix_sources(docs, budget=70_000, target_entropy=0.5, max_repeats=3.0)
    got = mixed.collect()
    # ``start`` of the input gives way to the operator's own.
    assert mixed.columns == [c for c in docs.columns if c != "start"] + ["epoch", "n_tokens", "start", "place"]
    assert mixing.keep_mixed(docs).columns == docs.columns and {r.start for r in mixing.keep_mixed(docs).collect()} == {3}
    assert {r.doc_id for r in got if r.source == "t"} == {4, 8} and max(r.epoch for r in got) <= 2
    assert mixing.mix_sources(none).count() == 0


OWN_NAMES = (
    "row start place epoch n_tokens of_source quota in_block block_start _mix_row _mix_none _mix_source _mix_hash p stay copy _digest _copy _stay_id "
    "_mark mark node component bucket size room rank digest leaf kept keep_id group_size shard slot length"
).split()


@pytest.mark.parametrize("stage", [mixing.keep_mixed, exact_dedup.keep_first_copies, bagminhash.keep_one_of_each])
def test_columns_named_as_the_operators_own_pass_unchanged(spark, stage):
    rows = [(i, t, "s", *[f"{name}-{i}" for name in OWN_NAMES]) for i, t, _ in ROWS if i not in (None, 6)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'`{n}` string' for n in OWN_NAMES)}")
    kept = stage(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert got and all(r[name] == f"{name}-{r.doc_id}" for r in got for name in OWN_NAMES)


def test_op8_near_copies_below_the_threshold_cost_few_pairs(spark, monkeypatch):
    """Each copy has a sixth of its shingles to itself: all share bands with many, none has room for a partner."""
    import random

    base, draw, n = [f"b{i}" for i in range(300)], random.Random(5), 300
    texts = []
    for i in range(n):
        words = list(base)
        for place in draw.sample(range(0, 300, 5), 10):
            words[place] = f"own{i}x{place}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pairs, verify = [], bagminhash.verified
    monkeypatch.setattr(bagminhash, "verified", lambda p, *rest: (pairs.append(p.count()), verify(p, *rest))[1])
    documents, _, _ = bagminhash.near_duplicates(docs)
    assert documents.filter("class_size > 1").count() == 0
    # Every member met the first pivots of its buckets, and nobody after that.
    assert len(pairs) == 1 and pairs[0] < 20 * n


def test_op8_near_copies_with_shared_edits_cost_few_pairs(spark, monkeypatch):
    """Every shingle is in many copies, so that all have room for partners of any size; most pairs share a band and miss
    the threshold by some shingles."""
    import random

    import pyarrow as pa

    base, draw, n = [f"b{i}" for i in range(150)], random.Random(5), 150
    texts = []
    for i in range(n):
        words = list(base)
        for place in draw.sample(range(5, 145, 5), 4):
            words[place] = f"other{place}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pairs, verify = [], bagminhash.verified
    monkeypatch.setattr(bagminhash, "verified", lambda p, *rest: (pairs.append(p.count()), verify(p, *rest))[1])
    documents, _, links = bagminhash.near_duplicates(docs)
    got = {r.doc_id: r.class_id for r in documents.collect()}
    left, right = zip(*((a, b) for a in range(n) for b in range(a)), strict=True)
    column = pa.array([t for _, t in texts])
    found = bagminhash.similarities(column.take(pa.array(left)), column.take(pa.array(right)))
    parent = list(range(n))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    linked = [(a, b) for a, b, s in zip(left, right, found, strict=True) if s >= 0.8]
    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {i: find(i) for i in range(n)}
    # After the first pivots only pairs that can be links were made.
    assert sum(pairs[1:]) <= len(linked) + n


def test_op8_parities_bound_what_texts_lack():
    """Never more than the true number, for texts of one and of two lengths of bit strings, and close to it."""
    import pyarrow as pa

    from ticketspark.llm.word_hash import Words

    words = [f"w{i % 211}" for i in range(300)]
    other = [w if i % 50 else "new" for i, w in enumerate(words)]
    bits = [np.array(p) for p in bagminhash.parities(pa.array([" ".join(words), " ".join(other), " ".join(words[:250]), "a", ""])).to_pylist()]
    assert [len(b) for b in bits] == [16, 16, 8, 8, 8]
    counts = [{}, {}, {}]
    for d, h, c in zip(*bagminhash.shingle_counts(Words(pa.array([" ".join(words), " ".join(other), " ".join(words[:250])]))), strict=True):
        counts[d][h] = c
    folded = [b if len(b) == 8 else b[:8] ^ b[8:] for b in bits]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        x, y = (bits[a], bits[b]) if len(bits[a]) == len(bits[b]) else (folded[a], folded[b])
        true = sum(abs(counts[a].get(h, 0) - counts[b].get(h, 0)) for h in counts[a].keys() | counts[b].keys())
        assert 0.7 * true <= np.bitwise_count((x ^ y).view(np.uint64)).sum() <= true


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 300_000
    rows = [(1, "http://a", "<p>é"), (2, None, "<p>é"), (3, "http://b\n c", None), (4, "u", ""), (5, "u", big), (5, "u", big), (None, "u", "<p>é"), (7, "u", "a\r\n\r\nWARC/1.1")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, revisit int")


def test_op2(spark, pages):
    packages = warc.write_packages(pages, scratch_path(spark, "packages"), max_bytes=200)
    got = bag(warc.read_packages(packages, True), "page_id", "payload_bytes", "record_type", "refers_to", "payload")
    big = b"<p>" + b"x" * 300_000
    assert got == sorted([
        (1, 5, "revisit", 2, b""), (2, 5, "response", None, "<p>é".encode()), (None, 5, "revisit", 2, b""), (3, 0, "revisit", 4, b""),
        (4, 0, "response", None, b""), (5, len(big), "response", None, big), (5, len(big), "response", None, big),
        (7, 13, "response", None, b"a\r\n\r\nWARC/1.1"),
    ], key=repr)
    # A task per package, however small they are.
    tasks = warc.read_packages(packages).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == packages.count() > 4
    digests = {r.page_id: r.payload_digest for r in warc.read_packages(packages).collect()}
    assert digests[1] == digests[2] == warc.payload_digest("<p>é".encode()) and len(digests[7]) == 32
    all_kept = warc.read_packages(warc.write_packages(pages, scratch_path(spark, "packages"), min_revisit_bytes=6))
    assert {r.record_type for r in all_kept.collect()} == {"response"}
    empty = warc.write_packages(pages.filter("false"), scratch_path(spark, "packages"))
    assert warc.read_packages(empty).count() == 0


VECTORS = "vec_id long, embedding array<double>, score int, block string"


def brute_top_k(rows, k=10):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_op1(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (100, [0.0, 0.0]), (200, None), (300, [1.0, nan]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [None, 1.0]), (4, [inf, 0.0]),
            (5, [-0.0001, 9.5]), (None, [1.0, 1.0]), (400, [2.0]), (6, [-3.0]), (500, []), (7, [30000.0, -30000.0])]
    frame = spark.createDataFrame([(*r, 1, "b") for r in rows], VECTORS)
    got = sorted(tuple(r) for r in bitsliced.top_k(frame, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top_k(rows)
    assert bitsliced.top_k(frame.filter("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_op1_large_components(spark):
    big = float(2**33)
    rows = [(0, [40000.0, -0.5]), (100, [1.0, big]), (1, [50000.0, 3.0]), (2, [-70000.0, 0.25]), (3, [0.001, -100.0]), (200, [-65536.0, 0.0]),
            (4, [0.5, 0.5]), (300, [0.0]), (5, [-float(2**53)])]
    frame = spark.createDataFrame([(*r, 1, "b") for r in rows], VECTORS)
    assert sorted(tuple(r) for r in bitsliced.top_k(frame, F.col("vec_id") % 100 == 0).collect()) == brute_top_k(rows)
    for over in ([(0, [1e12]), (1, [1e12])], [(0, [0.0]), (1, [1e300])]):
        with pytest.raises(Exception, match="does not fit a long"):
            bitsliced.top_k(spark.createDataFrame([(*r, 1, "b") for r in over], VECTORS), F.col("vec_id") % 100 == 0).collect()


def test_op10_long_texts_do_not_use_up_the_budget(spark):
    """The text that comes first in hash order is above the whole budget; then all toxic texts are above theirs."""
    ids = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    first = ids.orderBy(F.xxhash64("doc_id")).first().doc_id
    word = F.when(F.col("toxic") == 1, "wretchful ").otherwise("kettle ")
    plain = ids.withColumn("text", F.repeat(word, F.lit(5)))

    def bound(long):
        docs = plain.withColumn("text", F.when(long, F.repeat(word, F.lit(1000))).otherwise(F.col("text"))).select("doc_id", "text")
        return toxicity.train(docs, ids, F.lit(True), max_chars=4000)

    without = toxicity.train(plain.filter(F.col("doc_id") != first), ids, F.lit(True))
    got = bound(F.col("doc_id") == first)
    assert got is not None and all(np.array_equal(got[k], without[k]) for k in without)
    assert bound(F.col("toxic") == 1) is not None
