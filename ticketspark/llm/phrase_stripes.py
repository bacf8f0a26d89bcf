"""Phrase collocations from stripes: each prefix keys an associative counter of its next words.

Texts become blocks of word numbers, of one language each. For phrases of one to four words in turn, a block sends its
stripes: sorted by prefix, the words that follow each prefix in the block, and how often. Stripes that meet in a range are added
element by element. A sum is the count of prefix and next word, which is also the total of the prefix that is one
word longer. The largest entry of a stripe is the most frequent extension of its prefix to the right; entries
regrouped by their last words give the one to the left. A phrase that lies in a longer one of a certain count also lies in
one only one word longer with at least that count, so these two maxima decide subsumption.

Blocks learn which of their entries are frequent, one bit each, and the first block that has one names it. A phrase with an
infrequent part is infrequent, so a block goes on with the stretches of words in which every run of the last size is
frequent; what is dropped could not have counted. Inside a message a run is 40 bits of its prefix's hash and 40 independent
bits of its own; with the range, itself a hash, runs are told apart by 80 bits and log2 of the ranges (seven or more from
100 million words on): for ten billion distinct runs the chance that any two are taken for one is below one in a hundred million.

A stripe's entries go to ranges by prefix and slice of the next word, which spreads a prefix that a third of all positions
share, the empty prefix of single words above all; a block sends one entry per distinct run, however often it has it.
A range holds about ``range_words`` entries at most, whatever the input; messages are at most one per entry.
The first ``top`` phrases of a language are found in rounds of salted groups, so no task ranks all its candidates.

Defined results: a null text is empty, a null language ``und``; empty texts give no words; repeated rows count again; ties
are ordered by phrase, bytewise; an empty table gives an empty result; further columns are ignored. A very long text is
taken apart at ends of pieces.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ticketspark.llm.word_hash import mix
from ticketspark.session import partitions, written

#: Ends of pieces.
ENDS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 4
LEAST = 30
#: Per cent of a phrase's count that a longer one must have to replace it.
SUBSUMED = 80
TOP = 2000
SCALE = 2_000_000
#: Words that a task counts at a time, and bytes of a text that it takes apart at a time.
BLOCK_WORDS = 2_000_000
BLOCK_BYTES = 4 << 20
#: Words of the input per range.
RANGE_WORDS = 1_000_000
#: Bytes of a key inside a message.
KEY = 5
GOLD = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Texts of one language as word numbers; 0 ends a piece."""

    def __init__(self):
        self.numbers = defaultdict()
        self.numbers.default_factory = lambda: len(self.numbers) + 1
        self.parts: list[np.ndarray] = []
        self.n_words = 0

    def add(self, words: list[bytes]) -> int:
        """Words in order, with a line feed at each end of a piece; returns how many are words."""
        numbers = self.numbers
        part = np.fromiter((0 if w == b"\n" else numbers[w] for w in words if w), np.int32)
        self.parts += [part, np.zeros(1, np.int32)]
        found = int(np.count_nonzero(part))
        self.n_words += found
        return found

    def row(self, lang: str, number: int) -> dict:
        return {
            "lang": lang, "block": number, "n_words": self.n_words, "numbers": squeezed(np.concatenate(self.parts).tobytes()),
            "words": squeezed(b"\n".join(self.numbers)),
        }


BLOCKS = "lang string, block long, n_words long, numbers binary, words binary"
BLOCKS_ARROW = pa.schema([
    ("lang", pa.string()), ("block", pa.int64()), ("n_words", pa.int64()), ("numbers", pa.binary()), ("words", pa.binary())])

def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, "zstd", asbytes=True) if data else b"")


def unsqueezed(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""


def block_maker(block_words: int):
    marks = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
    end = re.compile(b"[" + re.escape(ENDS) + b"]")

    def pieces(text: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            stop = end.search(text, at + BLOCK_BYTES) if len(text) - at > BLOCK_BYTES else None
            until = stop.end() if stop else len(text)
            yield text[at:until]
            at = until

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 32, 0, 0
        blocks: dict[str, Block] = defaultdict(Block)

        def out() -> pa.RecordBatch:
            rows = [b.row(lang, first + made + i) for i, (lang, b) in enumerate(blocks.items())]
            return pa.RecordBatch.from_pylist(rows, BLOCKS_ARROW)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for piece in pieces(text.as_buffer().to_pybytes()):
                    held += blocks[lang].add(piece.translate(marks).replace(b"\n", b" \n ").split(b" "))
                    if held >= block_words:
                        yield out()
                        made, held = made + len(blocks), 0
                        blocks.clear()
        if blocks:
            yield out()

    return make


def grams(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of ``size`` words in lexicographic order, (size, runs), their counts, and for every occurrence
    its position and its run."""
    padded = np.concatenate([numbers, np.zeros(size, numbers.dtype)]).astype(np.int64)
    whole = padded[: len(numbers)] > 0
    for k in range(1, size):
        whole &= padded[k: k + len(numbers)] > 0
    at = np.flatnonzero(whole)
    base = int(padded.max(initial=0)) + 1
    key, shorter = padded[at], []
    for k in range(1, size):
        # Runs found so far are numbered anew, in order, so that keys stay small.
        runs, key = np.unique(key, return_inverse=True)
        shorter.append(runs)
        key = key * base + padded[at + k]
    runs, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    words = []
    for known in reversed(shorter):
        words.append(runs % base)
        runs = known[runs // base]
    return np.stack([runs, *reversed(words)]), counts, at, place


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def keys_of(lang: str, found: np.ndarray, words: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per run the key of its prefix, that of the whole run, and its range: by prefix, moved on by the slice of the next word."""
    prefix = np.full(found.shape[1], xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for numbers in found[:-1]:
        prefix = mix(prefix * GOLD + words[numbers])
    following = words[found[-1]]
    of = (mix(prefix, 13) + mix(following, 17)) % np.uint64(ranges)
    return prefix, mix(prefix * GOLD + following, 1), of.astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """The low ``KEY`` bytes of each key."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :KEY] = low
    return out.view(np.uint64).ravel()


def stripes_of(row: dict, size: int, ranges: int):
    """(runs, counts, positions, run of each position, words, prefix and run keys in order of the ranges, that order, ranges)."""
    found, counts, at, place = grams(np.frombuffer(unsqueezed(row["numbers"]), np.int32), size)
    spelled = unsqueezed(row["words"]).split(b"\n")
    prefix, run, of = keys_of(row["lang"], found, np.concatenate([np.zeros(1, np.uint64), hashes_of(spelled)]), ranges)
    order = np.argsort(of, kind="stable")
    return found, counts, at, place, spelled, prefix[order], run[order], order, of[order]


MESSAGES = "range long, block long, prefixes binary, runs binary, counts binary"
MESSAGES_ARROW = pa.schema([
    ("range", pa.int64()), ("block", pa.int64()), ("prefixes", pa.binary()), ("runs", pa.binary()), ("counts", pa.binary())])
ANSWERS = "range long, block long, frequent binary, named binary, f binary"
ANSWERS_ARROW = pa.schema([
    ("range", pa.int64()), ("block", pa.int64()), ("frequent", pa.binary()), ("named", pa.binary()), ("f", pa.binary())])


def sender(size: int, ranges: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's stripes, one row per range."""
        for batch in batches:
            for row in batch.to_pylist():
                _, counts, _, _, _, prefix, run, order, of = stripes_of(row, size, ranges)
                counts = counts[order].astype(np.uint32)
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True)) if len(of) else []
                for lo in range(0, len(cuts), 1000):
                    part = cuts[lo:lo + 1000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(of[a]) for a, _ in part], pa.int64()), pa.array([row["block"]] * len(part), pa.int64()),
                        *[pa.array([packed(x[a:b]) for a, b in part], pa.binary()) for x in (prefix, run)],
                        pa.array([counts[a:b].tobytes() for a, b in part], pa.binary()),
                    ], schema=MESSAGES_ARROW)

    return send


def merger(least: int):
    def merge(group: pa.Table) -> pa.Table:
        """Stripes added element by element: which entries of each block are frequent, and how frequent those are that this
        block is the first to have."""
        group = group.sort_by("block")
        prefix, run = (np.concatenate([unpacked(b) for b in group.column(name).to_pylist()]) for name in ("prefixes", "runs"))
        each = [np.frombuffer(b, np.uint32) for b in group.column("counts").to_pylist()]
        lengths, counts = [len(c) for c in each], np.concatenate(each)
        order = np.lexsort((run, prefix))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(prefix[order]) != 0) | (np.diff(run[order]) != 0)
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(counts[order].astype(np.int64), starts)
        whole = np.empty(len(order), np.int64)
        whole[order] = np.repeat(sums, np.diff(np.append(starts, len(order))))
        first = np.zeros(len(order), bool)
        first[order[starts]] = True
        frequent = whole >= least
        rows, at = [], 0
        for block, length in zip(group.column("block").to_pylist(), lengths, strict=True):
            hits = frequent[at:at + length]
            if hits.any():
                named = np.flatnonzero(hits & first[at:at + length])
                rows.append((block, np.packbits(hits).tobytes(), named.astype(np.int32).tobytes(), whole[at:at + length][named].tobytes()))
            at += length
        number = group.column("range")[0].as_py()
        blocks, flags, named, f = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table([
            pa.array([number] * len(rows), pa.int64()), pa.array(blocks, pa.int64()), pa.array(flags, pa.binary()),
            pa.array(named, pa.binary()), pa.array(f, pa.binary()),
        ], schema=ANSWERS_ARROW)

    return merge


STATE = f"{BLOCKS}, phrases array<string>, f array<long>"
STATE_ARROW = pa.schema([*BLOCKS_ARROW, ("phrases", pa.list_(pa.string())), ("f", pa.list_(pa.int64()))])


def learner(size: int, ranges: int):
    def learn(block: pa.Table, answers: pa.Table) -> pa.Table:
        """A block's frequent phrases that no earlier block names, and what longer phrases can still lie in: stretches
        of words in which every run of ``size`` words is frequent, longer than one such run."""
        if not block.num_rows or not answers.num_rows:
            return pa.Table.from_pylist([], STATE_ARROW)
        row = block.to_pylist()[0]
        numbers = np.frombuffer(unsqueezed(row["numbers"]), np.int32)
        found, counts, at, place, spelled, _, _, order, of = stripes_of(row, size, ranges)
        frequent, f = np.zeros(len(counts), bool), np.zeros(len(counts), np.int64)
        for answer in answers.to_pylist():
            lo, hi = np.searchsorted(of, [answer["range"], answer["range"] + 1])
            frequent[order[lo:hi]] = np.unpackbits(np.frombuffer(answer["frequent"], np.uint8), count=hi - lo).astype(bool)
            f[order[lo + np.frombuffer(answer["named"], np.int32)]] = np.frombuffer(answer["f"], np.int64)
        named = np.flatnonzero(f)
        words = [None, *(w.decode() for w in spelled)]
        row["phrases"] = [" ".join(words[i] for i in run) for run in found[:, named].T.tolist()]
        row["f"] = f[named].tolist()
        hits = at[frequent[place]]
        # Stretches of neighbouring positions, of two or more.
        edge = np.flatnonzero(np.diff(hits) != 1)
        first, last = np.append(hits[:1], hits[edge + 1]), np.append(hits[edge], hits[-1:])
        longer = last > first
        # Each stretch, and a 0 after it.
        first, length = first[longer], (last - first)[longer] + size
        inside = np.arange((length + 1).sum()) - np.repeat(np.cumsum(length + 1) - length - 1, length + 1)
        source = np.minimum(np.repeat(first, length + 1) + inside, len(numbers) - 1)
        out = np.where(inside < np.repeat(length, length + 1), numbers[source], 0)
        # Only words that are left keep a number; 0 stays 0.
        used, again = np.unique(np.append(out, 0), return_inverse=True)
        row["numbers"] = squeezed(again[:-1].astype(np.int32).tobytes())
        row["words"] = squeezed(b"\n".join(spelled[i - 1] for i in used[1:]))
        return pa.Table.from_pylist([row], STATE_ARROW)

    return learn


def phrase_counts(
    docs: DataFrame, least: int = LEAST, block_words: int = BLOCK_WORDS, range_words: int = RANGE_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of one to four words with f >= ``least``, and the words of each language."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    state = written(texts.mapInArrow(block_maker(block_words), BLOCKS), "phrase-blocks")
    totals = state.groupBy("lang").agg(F.sum("n_words").alias("n")).filter("n > 0")
    n_words = state.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(partitions(docs.sparkSession), -(-n_words // range_words))
    out = None
    for size in range(1, LONGEST + 1):
        blocks = state.select(*BLOCKS_ARROW.names)
        sent = blocks.mapInArrow(sender(size, ranges), MESSAGES)
        answers = sent.groupBy("range").applyInArrow(merger(least), ANSWERS)
        state = written(
            blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(learner(size, ranges), STATE), f"phrase-blocks-{size}")
        found = state.select("lang", F.explode(F.arrays_zip("phrases", "f")).alias("e")).select(
            "lang", F.col("e.phrases").alias("phrase"), F.lit(size).alias("size"), F.col("e.f").alias("f"))
        out = found if out is None else out.unionByName(found)
    return out, totals


def longer_maxima(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a phrase that is one word longer on either side."""
    known = phrases.filter("size > 2")
    right = known.select("lang", F.expr("substring_index(phrase, ' ', size - 1)").alias("phrase"), "f")
    left = known.select("lang", F.expr("substring_index(phrase, ' ', 1 - size)").alias("phrase"), "f")
    return right.unionByName(left).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of all phrases of two or more words: their lowest-scoring cut."""
    parts = phrases.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of_phrase"), "f")
    cuts = phrases.filter("size > 1").select(
        "lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - size)").alias("tail"))
    for part, name in (("head", "l"), ("tail", "r")):
        known = parts.withColumnRenamed("f", name)
        cuts = cuts.join(known, (F.col("lang") == F.col("of_lang")) & (F.col(part) == F.col("of_phrase"))).drop("of_lang", "of_phrase", part)
    exact = f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    return cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def first_of_each(rows: DataFrame, group: str, key: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each group with ``rank``, by rounds over ever fewer salted groups."""
    salts = partitions(rows.sparkSession)
    while salts > 1:
        salt = F.pmod(F.xxhash64(key), F.lit(salts))
        inside = F.row_number().over(W.partitionBy(group, salt).orderBy(*order))
        rows = rows.withColumn("rank", inside).filter(F.col("rank") <= top)
        salts //= 32
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, block_words: int = BLOCK_WORDS, range_words: int = RANGE_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two to four words of each language."""
    phrases, words = phrase_counts(docs, least, block_words, range_words)
    longer = longer_maxima(phrases)
    free = F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * SUBSUMED)
    candidates = scored(phrases).join(longer, ["lang", "phrase"], "left").filter(free).drop("longer")
    best = first_of_each(candidates, "lang", "phrase", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
