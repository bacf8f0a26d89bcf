"""Shards, manifest and collocations against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ticketspark.llm import merkle_manifest, phrase_stripes, shard_shuffle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, draw int, rank int, leaf int, prefix int"
CLASH = (1, "s", 2, 3, 4, 5)


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 977}\n" for i in range(30_000))
    rows = [
        (1, "a  b\nc", "en", "s", 5), (2, None, None, None, None), (3, "", "de", "s", 0), (4, long, "en", "t", 9), (6, "x\n", "en", "s", 2),
        (6, "x\n", "en", "s", 2), (None, "y", "en", "u", 1), (None, None, None, "u", None), (8, "\n\n", "fr", "ünï", 2), (10, "z", "en", "", 1),
        (12, "no feed", "en", "t", 7), *[(100 + i, f"text {i}\nmore", "en", "big", 9) for i in range(400)],
    ]
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(5)


# --- Shards --------------------------------------------------------------------------------------


@pytest.mark.parametrize(("total", "marked", "drawn"), [(50, 20, 10), (1000, 63, 500), (300, 280, 290), (5, 0, 5), (0, 0, 0)])
def test_hypergeometric_follows_its_law(spark, total, marked, drawn):
    n = 20_000
    draw = shard_shuffle.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), (F.col("id") + 0.5) / n)
    got = {r.x: r["count"] / n for r in spark.range(n).select(draw.alias("x")).groupBy("x").count().collect()}
    for x in range(max(0, drawn - total + marked), min(marked, drawn) + 1):
        exact = math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn)
        assert abs(got.pop(x, 0) - exact) < 2 / n
    assert not got


@pytest.mark.parametrize("shards", [1, 16])
def test_matrix_has_exact_margins(spark, shards):
    sizes = {p: n for p, n in enumerate([0, 5, 1, 1000, 33, 0, 7, 2, 2, 2, 90])}
    rows = shard_shuffle.communication_matrix(spark.createDataFrame(list(sizes.items()), "part long, n long"), shards, 5).collect()
    assert {r.part: sum(r.to) for r in rows} == sizes
    total = sum(sizes.values())
    assert [sum(r.to[s] for r in rows) for s in range(shards)] == [total // shards + (s < total % shards) for s in range(shards)]


def test_shuffle_is_uniform(spark):
    """Over some seeds the rows of each input partition meet each shard, and the halves of its slots, equally often."""
    rows, seen, runs = spark.range(96, numPartitions=3), Counter(), 6
    for seed in range(runs):
        for r in shard_shuffle.shuffle_shards(rows, 4, seed).collect():
            seen[r.document["id"] // 32, r.shard, r.slot // 12] += 1
    expected = 4 * runs  # 96 / (3 * 4 * 2)
    assert sum((seen[p, s, h] - expected) ** 2 / expected for p in range(3) for s in range(4) for h in range(2)) < 60  # 23 degrees at most


def test_op11(docs):
    got = shard_shuffle.shard_of_documents(docs).collect()
    given = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == given
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert shard_shuffle.shard_of_documents(docs.filter("false")).count() == 0
    again = shard_shuffle.shard_of_documents(docs).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_op11_buckets_and_whole_rows(spark, docs):
    small = shard_shuffle.shuffle_shards(docs, 3, bucket_rows=10)
    assert sorted(map(repr, (r.document for r in small.collect()))) == sorted(map(repr, docs.collect()))
    assert Counter((r.shard, r.slot) for r in small.collect()) == Counter((s, i) for s in range(3) for i in range(137))
    path = shard_shuffle.write_shards(docs, shards=3)
    back = spark.read.parquet(path)
    assert back.count() == 411 and set(back.select("document.*").columns) == set(docs.columns)
    plan = shard_shuffle.shard_of_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- Manifest ------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    """(root, the siblings of each leaf left and right, level by level)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, place in enumerate(at):
            first = place - place % 3
            paths[leaf].append((level[first:place], level[place + 1:first + 3]))
        level = [digest(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [place // 3 for place in at]
    return level[0], paths


def plain_manifest(rows):
    out, groups = [], defaultdict(list)
    for r in rows:
        head = [entry(v) for v in (r.doc_id, r.source, r.lang, r.n_chars)]
        tampered = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        seen = r.text.replace("\n", "") if tampered else r.text
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, digest(*head, entry(r.text)), digest(*head, entry(seen)), r.doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([leaf for *_, leaf, _, _ in sorted(groups[s])]) for s in order]
    root, above = plain_tree([top for top, _ in trees])
    for source, (top, paths), high in zip(order, trees, above, strict=True):
        for (_, _, leaf, seen, doc_id), path in zip(sorted(groups[source]), paths, strict=True):
            node = seen
            for left, right in path + high:
                node = digest(*left, node, *right)
            proof = digest(*(d for left, right in path + high for d in [*left, *right]))
            out.append((doc_id, leaf, top, root, proof, node, node == root))
    return sorted(out, key=repr)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_op12(docs):
    got = sorted((tuple(r[n] for n in NAMES) for r in merkle_manifest.verified_manifest(docs).collect()), key=repr)
    assert got == plain_manifest(docs.collect())
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 4, 82])
def test_op12_sizes(docs, n):
    few = docs.filter("source = 'big'").orderBy("doc_id").limit(n)
    got = sorted((tuple(r[x] for x in NAMES) for r in merkle_manifest.verified_manifest(few).collect()), key=repr)
    assert got == (plain_manifest(few.collect()) if n else [])


def test_op12_many_sources(spark):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 100).alias("source"), F.lit("en").alias("lang"),
        F.lit(1).alias("n_chars"), F.lit("a\nb").alias("text"))
    got = sorted((tuple(r[x] for x in NAMES) for r in merkle_manifest.verified_manifest(docs).collect()), key=repr)
    assert got == plain_manifest(docs.collect())


# --- Collocations --------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    f, words = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        text = (r.text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            ws = re.findall(r"[^ \t]+", piece)
            words[lang] += len(ws)
            for i in range(len(ws)):
                for m in range(1, 5):
                    if i + m <= len(ws):
                        f[lang][tuple(ws[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


TEXTS = [
    "the cat sat on the mat. THE CAT sat, on the mat; the cat\tsat", "new york city is new york city! new york", "a a a a a a a", None, "",
    "x\x0by\x0cz\rx y z x y z x y z", "É é ÉÉ Ünï É é ÉÉ Ünï É é ÉÉ", "...,,;\n\n  \t ", "of the of the of the of the end",
]


@pytest.mark.parametrize(("least", "top", "block", "ranges"), [(1, 1000, 10 ** 6, 10 ** 6), (2, 1000, 10, 20), (3, 4, 1, 7)])
def test_op13(spark, least, top, block, ranges):
    rows = [(i, t, [None, "en", "de"][i % 3]) for i, t in enumerate(TEXTS * 4)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, prefix int, total int, n int").repartition(3)
    got = sorted(tuple(r) for r in phrase_stripes.collocations(docs, least, top, block, ranges).collect())
    assert got == plain_collocations(docs.collect(), least, top)
    assert phrase_stripes.collocations(docs.filter("false")).count() == 0


def test_op13_a_long_text_is_cut_at_ends_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrase_stripes, "BLOCK_BYTES", 40)
    docs = spark.createDataFrame([(1, " ".join(TEXTS[0] for _ in range(30)) + " " + "w " * 500, "en")], "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in phrase_stripes.collocations(docs, 2, 50, 100, 50).collect())
    assert got == plain_collocations(docs.collect(), 2, 50)
