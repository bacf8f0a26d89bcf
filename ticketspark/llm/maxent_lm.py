"""A hashed maximum-entropy language model with a class-factored softmax.

P(text) = product of P(class | context) x P(word | class) over the words and one end. The most frequent words
and the end are classes of their own; other words fall into classes by their shape (ASCII or not, last
character, a hash of the letters before it). Features of a context are hashed into ``ROWS`` rows of weights: the
class of the word before (n-gram), the last frequent word however far back (skip), and the two together.
Inside a class a word has its smoothed relative frequency, with one place for unknown words.

Training gathers counts of (context, class) from all learning documents; their number is bounded by the
classes, and each round the tasks return the gradient of their contexts' part of the log-likelihood, the
driver adds these bounded tables and takes one step. Scores are computed in numpy, one softmax for
each distinct context of a block.

Word counts are never gathered whole: a block of documents sends its distinct words once, as sorted lists of
hashes per range, and gets the counts of just these words back, so a frequent word is one number per
block. Words are told apart by 64-bit hashes.

Defined results: null and empty texts consist of the end alone; null ids count as learning rows (not held out);
without learning rows all counts are 0; repeated rows count each; other columns stay out; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark.llm.common import fold, slices, texts
from ticketspark.llm.word_hash import BYTE, Words, mix
from ticketspark.session import written

FREQUENT = 159
SUFFIXES = 12
SHAPES = 2 * 4 * SUFFIXES
CLASSES = FREQUENT + 1 + SHAPES
END_CLASS = FREQUENT
START = CLASSES  # as the word before the first
ROWS = 1 << 12
ROUNDS = 30
SHARDS = 16
BLOCK_BYTES = 8 << 20
END = np.uint64(0xE27D0000E27D0001)
KIND = np.full(256, 0, np.uint8)
KIND[:128] = 3
for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    KIND[low:high] = 0
KIND[0x2E], KIND[0x2C] = 1, 2


def shapes(words: Words) -> np.ndarray:
    """Shape class of every word, from its bytes."""
    if not len(words):
        return np.empty(0, np.uint8)
    raw = words.raw
    wide = np.concatenate([[0], np.cumsum(raw >= 128)])
    foreign = (wide[words.ends] > wide[words.starts]).astype(np.int64)
    kind = KIND[raw[words.ends - 1]].astype(np.int64)
    tail = np.maximum(words.ends - 1 - (kind > 0), words.starts)
    before = np.maximum(tail - 1, words.starts)
    suffix = mix(BYTE[raw[tail]] + BYTE[raw[before]] * np.uint64(3)) % np.uint64(SUFFIXES)
    return ((foreign * 4 + kind) * SUFFIXES + suffix.astype(np.int64)).astype(np.uint8)


class Tokens:
    """The words of a column of texts, each text with its end."""

    def __init__(self, column: pa.StringArray):
        words = Words(column, lower=True)
        self.n_docs, self.counts = words.n_docs, words.counts + 1
        self.first = words.first[:-1] + np.arange(words.n_docs)
        at = np.arange(len(words)) + words.doc
        n = len(words) + words.n_docs
        self.hashes, self.shapes = np.full(n, END, np.uint64), np.zeros(n, np.uint8)
        self.hashes[at], self.shapes[at] = words.hashes, shapes(words)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def __len__(self) -> int:
        return len(self.hashes)

    def classes(self, frequent: np.ndarray) -> np.ndarray:
        """``frequent``: sorted hashes; the class of a frequent word is its place there."""
        out = FREQUENT + 1 + self.shapes.astype(np.int64)
        if len(frequent):
            place = np.minimum(np.searchsorted(frequent, self.hashes), len(frequent) - 1)
            out = np.where(frequent[place] == self.hashes, place, out)
        out[self.hashes == END] = END_CLASS
        return out

    def contexts(self, classes: np.ndarray) -> np.ndarray:
        """Number of (class before, last frequent word before) for every token."""
        n = len(classes)
        before = np.empty(n, np.int64)
        before[1:] = classes[:-1]
        before[self.first] = START
        seen = np.maximum.accumulate(np.where(classes < FREQUENT, np.arange(n), -1)) if n else classes
        last = np.full(n, -1)
        last[1:] = seen[:-1]
        start = np.repeat(self.first, self.counts)
        frequent = np.where(last >= start, classes[last], FREQUENT)
        return before * (FREQUENT + 1) + frequent


def feature_rows(contexts: np.ndarray) -> np.ndarray:
    """Hashed rows of the three features of each context, (contexts, 3)."""
    before, last = np.divmod(contexts, FREQUENT + 1)
    values = np.stack([before, last, contexts], 1).astype(np.uint64) * np.uint64(4) + np.arange(3, dtype=np.uint64)
    return (mix(values, 11) % np.uint64(ROWS)).astype(np.int64)


def log_shares(contexts: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(class | context), (contexts, classes)."""
    rows = feature_rows(contexts)
    logits = weights[rows[:, 0]] + weights[rows[:, 1]] + weights[rows[:, 2]] + bias
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def merge_counts(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sum of counts by key; further columns belong to the key."""
    keys, counts, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
    distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return distinct, np.bincount(place, counts, len(distinct)).astype(np.int64), *(r[first] for r in rest)


def range_cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(hashes, [np.uint64((b << 64) // ranges) for b in range(1, ranges)]), [len(hashes)]])


def learning(frame: DataFrame, held: Column) -> DataFrame:
    return frame.withColumn("learn", ~held)


def count_words(frame: DataFrame, ranges: int) -> DataFrame:
    """hash, n, shape of every distinct token of the learning rows, as lists per range."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            hashes, counts, shape = merge_counts(held)
            cuts = range_cuts(hashes, ranges)
            rows = [
                {"range": b, "hashes": hashes[lo:hi].tobytes(), "counts": counts[lo:hi].tobytes(), "shapes": shape[lo:hi].tobytes()}
                for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo
            ]
            return pa.RecordBatch.from_pylist(rows, pa.schema(
                [("range", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("shapes", pa.binary())]))

        for part in slices(batches):
            tokens = Tokens(part.column(1))
            if len(tokens):
                held.append(merge_counts([(tokens.hashes, np.ones(len(tokens)), tokens.shapes)]))
                size += len(held[-1][0])
            if size > 1_500_000:
                merged = merge_counts(held)
                held, size = [merged], len(merged[0])
                if size > 1_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def add(group: pa.Table) -> pa.Table:
        parts = [tuple(np.frombuffer(r[k], t) for k, t in (("hashes", "<u8"), ("counts", "<i8"), ("shapes", "u1"))) for r in group.to_pylist()]
        hashes, counts, shape = merge_counts(parts)
        return pa.table({"hash": hashes.view(np.int64), "n": counts, "shape": shape.astype(np.int32)})

    sent = frame.filter("learn").select("doc_id", "text").mapInArrow(send, "range long, hashes binary, counts binary, shapes binary")
    return sent.groupBy("range").applyInArrow(add, "hash long, n long, shape int")


def count_contexts(frame: DataFrame, frequent: np.ndarray) -> DataFrame:
    """shard, keys (context x CLASSES + class), counts over the learning rows.

    Spark adds the counts of a key, with a combine in each map task, so a shard meets every key once however many
    tasks sent it: at most CLASSES x contexts / SHARDS of them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            keys, counts = merge_counts(held)
            for lo in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:lo + 100_000]), pa.array(counts[lo:lo + 100_000])], ["key", "n"])

        for part in slices(batches):
            tokens = Tokens(part.column(1))
            classes = tokens.classes(frequent)
            held.append(merge_counts([(tokens.contexts(classes) * CLASSES + classes, np.ones(len(tokens)))]))
            size += len(held[-1][0])
            if size > 2_000_000:
                merged = merge_counts(held)
                held, size = [merged], len(merged[0])
                if size > 1_000_000:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({
            "shard": group["shard"][:1], "keys": [group["key"].to_numpy().astype("<u4").tobytes()],
            "counts": [group["n"].to_numpy().astype("<i8").tobytes()],
        })

    sent = frame.filter("learn").select("doc_id", "text").mapInArrow(send, "key long, n long")
    summed = sent.groupBy("key").agg(F.sum("n").alias("n"))
    shard = F.expr(f"key div {CLASSES * (FREQUENT + 1)} % {SHARDS}")
    return summed.withColumn("shard", shard).groupBy("shard").applyInArrow(pack, "shard long, keys binary, counts binary")


def gradient(keys: np.ndarray, counts: np.ndarray, weights: np.ndarray, bias: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the log-likelihood per token over some contexts, and the log-likelihood."""
    contexts, classes = np.divmod(keys.astype(np.int64), CLASSES)
    distinct, place = np.unique(contexts, return_inverse=True)
    g_weights, g_bias, value = np.zeros_like(weights), np.zeros_like(bias), 0.0
    for lo in range(0, len(distinct), 4096):
        inside = (place >= lo) & (place < lo + 4096)
        some = distinct[lo:lo + 4096]
        seen = np.zeros((len(some), CLASSES), np.float32)
        seen[place[inside] - lo, classes[inside]] = counts[inside] / total
        logs = log_shares(some, weights, bias)
        value += float((seen * logs).sum())
        error = seen - seen.sum(1, keepdims=True) * np.exp(logs)
        rows = feature_rows(some)
        for f in range(3):
            order = np.argsort(rows[:, f], kind="stable")
            used, first = np.unique(rows[order, f], return_index=True)
            g_weights[used] += np.add.reduceat(error[order], first, axis=0)
        g_bias += error.sum(0)
    return g_weights, g_bias, value


def train(
    counted: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3, prior: float = 1.0,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias, by Adam on gradients that the tasks compute on their contexts; the weights have a Gaussian prior
    of precision ``prior``, which holds small inputs back from fitting single contexts."""
    spark = counted.sparkSession
    total = int(class_counts.sum())
    weights = np.zeros((ROWS, CLASSES), np.float32)
    bias = np.log((class_counts + 0.5) / (total + 0.5 * CLASSES)).astype(np.float32)
    one, two = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1 if total else 1):
        # Four megabytes, whatever the input.
        now = spark.sparkContext.broadcast((weights, bias))

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            w, b = now.value
            summed = None
            for batch in batches:
                for row in batch.to_pylist():
                    g, _, _ = gradient(np.frombuffer(row["keys"], "<u4"), np.frombuffer(row["counts"], "<i8"), w, b, total)
                    summed = g if summed is None else summed + g
            if summed is not None:
                used = np.flatnonzero(summed.any(1))
                yield pa.RecordBatch.from_pydict({"rows": [used.astype("<i4").tobytes()], "values": [summed[used].astype("<f4").tobytes()]})

        total_gradient = np.zeros_like(weights)
        # One row per task, and there are at most SHARDS tasks with rows.
        for row in counted.mapInArrow(run, "rows binary, values binary").collect():
            total_gradient[np.frombuffer(row["rows"], "<i4")] += np.frombuffer(row["values"], "<f4").reshape(-1, CLASSES)
        # The driver's copy goes too.
        now.destroy()
        total_gradient -= prior / total * weights
        one += 0.2 * (total_gradient - one)
        two += 0.05 * (total_gradient ** 2 - two)
        pace = rate / (1 + step / 10)
        weights = weights + pace * (one / (1 - 0.8 ** step)) / (np.sqrt(two / (1 - 0.95 ** step)) + 1e-7)
    return weights, bias


def score_documents(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held`` is a condition on doc_id; by default one fold of five is held out.
    """
    held = F.coalesce(fold("doc_id") == 1 if held is None else held, F.lit(False))
    frame = learning(texts(docs, id_col, text_col), held)
    size = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // block_bytes))

    counted = written(count_words(frame, ranges), "word-counts")
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(np.array(END).view(np.int64))
    top = counted.filter(F.col("hash") != end).orderBy(F.col("n").desc(), "hash").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r["hash"] for r in top], np.int64).view(np.uint64))
    place = {h: i for i, h in enumerate(frequent.view(np.int64).tolist())}
    by_shape = {r["shape"]: (r["c"], r["v"]) for r in counted.filter(F.col("hash") != end).groupBy("shape").agg(
        F.sum("n").alias("c"), F.count("*").alias("v")).collect()}
    ends = counted.filter(F.col("hash") == end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    class_counts, class_words = np.zeros(CLASSES, np.int64), np.ones(CLASSES, np.int64)
    for shape, (count, words) in by_shape.items():
        mine = [r for r in top if r["shape"] == shape]
        class_counts[FREQUENT + 1 + shape] = count - sum(r["n"] for r in mine)
        class_words[FREQUENT + 1 + shape] = words - len(mine) + 1
    for r in top:
        class_counts[place[r["hash"]]] = r["n"]
    class_counts[END_CLASS] = ends

    weights, bias = train(written(count_contexts(frame, frequent).repartition(SHARDS, "shard"), "context-counts"), class_counts)
    model = frame.sparkSession.sparkContext.broadcast((weights, bias))
    id_type = frame.schema["doc_id"].dataType.simpleString()
    blocks = frame.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(ranges)))

    def tokens_of(group: pa.Table) -> Tokens:
        return Tokens(pa.concat_arrays(group["text"].chunks) if group["text"].num_chunks else pa.array([], pa.string()))

    def send(group: pa.Table) -> pa.Table:
        tokens = tokens_of(group)
        learn = group["learn"].combine_chunks().to_numpy(zero_copy_only=False)
        hashes, counts = merge_counts([(tokens.hashes, learn[tokens.doc])])
        cuts = range_cuts(hashes, ranges)
        rows = [(b, hashes[lo:hi].tobytes(), counts[lo:hi].astype("<u4").tobytes())
                for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        b, h, c = zip(*rows, strict=True)
        block = group["block"][0].as_py()
        return pa.table({"range": pa.array(b, pa.int64()), "block": pa.array([block] * len(b), pa.int64()), "hashes": list(h), "counts": list(c)})

    def answer(group: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["counts"], "<u4")) for r in group.to_pylist()]
        hashes, counts = merge_counts(parts)
        back = [counts[np.searchsorted(hashes, h)].astype("<u8") for h, _ in parts]
        narrow = [b.astype("<u4") if b.max() < 1 << 32 else b for b in back]
        return pa.table({"block": group["block"], "range": group["range"], "counts": [b.tobytes() for b in narrow]})

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = tokens_of(group)
        hashes, place = np.unique(tokens.hashes, return_inverse=True)
        cuts, known = range_cuts(hashes, ranges), np.zeros(len(hashes), np.int64)
        for row in answers.to_pylist():
            lo, hi = cuts[row["range"]], cuts[row["range"] + 1]
            known[lo:hi] = np.frombuffer(row["counts"], "<u4" if len(row["counts"]) == 4 * (hi - lo) else "<u8")
        counts = known[place]
        classes = tokens.classes(frequent)
        contexts = tokens.contexts(classes)
        distinct_contexts, at = np.unique(contexts, return_inverse=True)
        of_class = np.empty(len(tokens))
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(0, len(distinct_contexts) + 4096, 4096))
        for step, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            logs = log_shares(distinct_contexts[step * 4096:(step + 1) * 4096], *model.value)
            some = order[lo:hi]
            of_class[some] = logs[at[some] - step * 4096, classes[some]]
        inside = np.where(
            classes <= FREQUENT, 0.0, np.log((counts + 0.5) / (class_counts[classes] + 0.5 * class_words[classes])))
        base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        n = tokens.n_docs
        return pa.table({
            "doc_id": group["doc_id"], "held_out": pa.compute.invert(group["learn"]), "n_tokens": tokens.counts.astype(np.int64),
            "n_known": np.bincount(tokens.doc, counts > 0, n).astype(np.int64), "train_tokens": np.full(n, total, np.int64),
            "base_score": np.bincount(tokens.doc, base, n), "score": np.bincount(tokens.doc, of_class + inside, n) / np.log(10),
        })

    asked = blocks.groupBy("block").applyInArrow(send, "range long, block long, hashes binary, counts binary")
    answers = asked.groupBy("range").applyInArrow(answer, "block long, range long, counts binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
