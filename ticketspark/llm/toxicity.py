"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams, so a misspelling that was never
seen still shares most of its vectors with the word it stands for. The distinct words of ``SPAN``
consecutive places are averaged over these places and go into a linear softmax; a text is toxic if any
of its spans is, so one insult is not thinned out by a long text. Embeddings and softmax are trained
jointly in numpy, with Adam.

Learning uses at most ``max_rows`` labelled rows, half of them toxic if there are as many, taken in the
order of a hash of their id, and of these at most ``max_chars`` characters, half for each label. A text that does not
fit is passed over and costs nothing; a label none of whose texts fits keeps its shortest one. That sample is
the only data that meets in one task. Scoring reads every whole text where it lies, without a shuffle;
a task keeps a table of bounded size with a number for each distinct word.

Defined results: null and empty texts get the score of an empty span; labels that are null, not 0 or 1, or without a
document are not used, a document with contradicting labels counts as toxic; without a toxic and a
clean row to learn from all scores are 0; a null id is never held out; other columns stay out.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark.llm.common import WORD, fold, slices, texts

BUCKETS = 1 << 17
SIZE = 8
SPAN = 12
TABLE = 200_000


def cleaned(word: str) -> str:
    word = word.lower()
    while word and not word[0].isalnum():
        word = word[1:]
    while word and not word[-1].isalnum():
        word = word[:-1]
    return word


def subwords(word: str) -> list[int]:
    """Buckets of the word's 3- to 5-grams with boundary marks; no bucket for the word itself, which a
    misspelling would not share."""
    raw = f"<{cleaned(word)}>"
    grams = [raw[i:i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1)] or [raw]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


def crc_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


CRC = crc_steps()


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of all words one after the other, and how many each has. All n-grams are hashed together: the crc32
    of a run of characters goes on from that of the run one shorter."""
    raw = [f"<{cleaned(word)}>" for word in words]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    sizes = np.maximum(sum(np.maximum(length - n + 1, 0) for n in (3, 4, 5)), 1)
    flat = np.full(int(sizes.sum()), zlib.crc32(b"<>") % BUCKETS, np.int32)  # what a word without n-grams has
    # Blanks behind the last character stand for those that the last runs lack.
    data = np.frombuffer(("".join(raw) + " " * 5).encode("utf-8", "surrogatepass"), np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
    width = np.diff(np.append(at, len(data)))
    n_chars = len(at) - 5
    of = np.repeat(length, length)
    left = np.repeat(np.cumsum(length), length) - np.arange(n_chars)  # characters from here to the end of the word
    to = np.repeat(np.cumsum(sizes) - sizes, length) + of - left
    state = np.full(n_chars, 0xFFFFFFFF, np.uint32)
    for n in range(1, 6):
        start, bytes_of = at[n - 1:n - 1 + n_chars], width[n - 1:n - 1 + n_chars]
        state = CRC[(state ^ data[start]) & 255] ^ (state >> 8)
        for byte in (1, 2, 3):
            longer = np.flatnonzero(bytes_of > byte)
            before = state[longer]
            state[longer] = CRC[(before ^ data[start[longer] + byte]) & 255] ^ (before >> 8)
        if n >= 3:
            room = left >= n
            flat[to[room]] = ~state[room] % BUCKETS
            to = to + np.maximum(of - n + 1, 0)
    return flat, sizes


def group_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


def fit(rows: Iterable[tuple[str, int]], steps: int = 100, rate: float = 0.1, decay: float = 1e-6, seed: int = 7) -> dict | None:
    """Embeddings, softmax weights and bias from (text, label) rows.

    With two classes the loss reaches a bucket's vector along the difference of the two softmax columns
    only, so a step needs one number per span, word and bucket.
    """
    known: dict[str, int] = {}
    tokens, sizes, spans_of, labels = array("i"), array("i"), array("i"), array("b")
    for text, label in rows:
        words = WORD.findall(text)
        for i in range(0, len(words), SPAN):
            span = {known.setdefault(w, len(known)) for w in words[i:i + SPAN]}
            tokens.extend(span)
            sizes.append(len(span))
        if words:
            spans_of.append(-(-len(words) // SPAN))
            labels.append(label)
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return None
    flat, bag_sizes = (np.concatenate(x) for x in zip(*(bags(part) for part in cut(list(known))), strict=True))
    del known
    tokens, sizes, spans_of = (np.frombuffer(x, np.int32) for x in (tokens, sizes, spans_of))
    span_starts = np.cumsum(sizes) - sizes
    text_starts = np.cumsum(spans_of) - spans_of
    owner = np.repeat(np.arange(len(y)), spans_of)
    bag_starts = np.cumsum(bag_sizes) - bag_sizes

    random = np.random.default_rng(seed)
    weights = {
        "vectors": random.normal(0, 0.1, (BUCKETS, SIZE)),
        "softmax": random.normal(0, 0.5, (SIZE, 2)),
        "bias": np.array([0.0, -5.0]),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    for step in range(1, steps + 1):
        side = weights["softmax"][:, 1] - weights["softmax"][:, 0]
        of_word = group_sums((weights["vectors"] @ side)[flat], bag_starts) / bag_sizes
        margin = group_sums(of_word[tokens], span_starts) / SPAN + weights["bias"][1] - weights["bias"][0]
        share = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        # A text is toxic if any of its spans is: 1 - p = product of (1 - share).
        clean = group_sums(np.logaddexp(0, margin), text_starts)
        pull = np.where(y == 1, -1 / np.expm1(np.clip(clean, 1e-6, 30)), 1.0)
        back = share * pull[owner] / len(y)
        to_word = np.bincount(tokens, np.repeat(back / SPAN, sizes), len(bag_sizes))
        to_bucket = np.bincount(flat, np.repeat(to_word / bag_sizes, bag_sizes), BUCKETS)
        along = weights["vectors"].T @ to_bucket
        gradient = {
            "vectors": np.outer(to_bucket, side) + decay * weights["vectors"],
            "softmax": np.stack([-along, along], 1), "bias": np.array([-back.sum(), back.sum()]),
        }
        for k, g in gradient.items():
            one, two = moments[k]
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            weights[k] -= rate * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.99 ** step)) + 1e-8)
    return weights


def margins(weights: dict) -> tuple[np.ndarray, float]:
    """What each bucket adds to the logit of label 1 over label 0, and the bias."""
    side = weights["softmax"][:, 1] - weights["softmax"][:, 0]
    return (weights["vectors"] @ side).astype(np.float32), float(weights["bias"][1] - weights["bias"][0])


def cut(words: list[str], size: int = 1 << 14) -> Iterator[list[str]]:
    for at in range(0, len(words), size):
        yield words[at:at + size]


class Scorer:
    """Scores from a table of distinct words -> the mean of what their buckets add."""

    def __init__(self, buckets: np.ndarray, bias: float, limit: int = TABLE):
        self.buckets, self.bias, self.limit, self.table = buckets.astype(float), bias, limit, {}

    def learn(self, words: set[str]) -> None:
        new = words - self.table.keys()
        if len(self.table) + len(new) > self.limit:
            self.table, new = {}, words
        for part in cut(list(new)):
            flat, sizes = bags(part)
            added, ends = self.buckets[flat].tolist(), np.cumsum(sizes).tolist()
            for word, a, b in zip(part, [0, *ends], ends, strict=False):
                self.table[word] = sum(added[a:b]) / (b - a)

    def all(self, texts: list[str | None]) -> list[float]:
        words_of = [WORD.findall(text) if text else [] for text in texts]
        self.learn(set().union(*words_of))
        of_word, out = self.table.__getitem__, []
        for words in words_of:
            # Without words one empty span is left.
            of_span = [sum(map(of_word, set(words[i:i + SPAN]))) for i in range(0, max(len(words), 1), SPAN)]
            margin = np.array(of_span) / SPAN + self.bias
            out.append(float(-np.expm1(-np.logaddexp(0, margin).sum())))
        return out

    def __call__(self, text: str | None) -> float:
        return self.all([text])[0]


def sample(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str, max_rows: int) -> DataFrame:
    """order, text, label of the rows to learn from; ``learn_from`` is a condition on doc_id of ``labels``."""
    marks = (
        labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & learn_from)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    # Each task sends its first rows of a label only.
    clean, toxic = (marks.filter(F.col("label") == label).orderBy("order", "doc_id").limit(max_rows // 2) for label in (0, 1))
    taken = clean.unionByName(toxic)
    # At most max_rows narrow rows.
    return texts(docs).join(F.broadcast(taken), "doc_id").select("order", "text", "label")


def train(
    docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "toxic", max_rows: int = 8_000,
    max_chars: int = 40_000_000,
) -> dict | None:
    """Embeddings and softmax from a bounded sample; None where it has one class only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            left, used, shortest = [max_chars // 2] * 2, set(), {}
            for part in slices(batches):
                for _, text, label in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if len(text) <= left[label]:
                        left[label] -= len(text)
                        used.add(label)
                        yield text, label
                    elif label not in used and len(text) < len(shortest.get(label, text + " ")):
                        shortest[label] = text
            for label in sorted(shortest.keys() - used):
                yield shortest[label], label

        weights = fit(rows())
        if weights:
            yield pa.RecordBatch.from_pylist([{k: v.astype("<f4").tobytes() for k, v in weights.items()}])

    chosen = sample(docs, labels, learn_from, label_col, max_rows).repartition(1).sortWithinPartitions("order")
    made = chosen.mapInArrow(run, "vectors binary, softmax binary, bias binary").collect()
    shapes = {"vectors": (BUCKETS, SIZE), "softmax": (SIZE, 2), "bias": (2,)}
    return {k: np.frombuffer(made[0][k], "<f4").reshape(shape) for k, shape in shapes.items()} if made else None


def score(docs: DataFrame, weights: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    frame = texts(docs, id_col, text_col)
    if weights is None:
        return frame.select("doc_id", F.lit(0.0).alias("score"))
    # Half a megabyte, whatever the input.
    model = frame.sparkSession.sparkContext.broadcast(margins(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for part in slices(batches):
            made = pa.array(scorer.all(part.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), made], ["doc_id", "score"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels that are not held out."""
    scored = score(docs, train(docs, labels, ~held_out(), **bounds))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, scored where they lie."""
    weights = train(docs, labels, ~held_out(), **bounds)
    if weights is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(margins(weights))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for part in slices(batches):
            yield part.filter(pa.array([score < 0.5 for score in scorer.all(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
