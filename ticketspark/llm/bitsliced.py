"""Exact top-k search by inner product with a bit-sliced index.

Each component x becomes the integer floor(1024 x). The index holds blocks of ``BLOCK`` vectors: for
each dimension the bits of (value - smallest value of the block), one bitmap over the block's rows per
bit, rows in id order. A query's scores are a sum of such slices: a positive weight adds a dimension's
slices, a negative one those of the complement, each shifted by the places of the weight's bits, so all
terms are non-negative and the rest is one constant per query. Carry-save adders on whole bitmaps leave
the scores of all rows as slices again. The top k rows are found from the most significant slice down;
rows that tie at the boundary are resolved by their ids, and the scores of the chosen rows are read back
from the slices. Each block gives at most k rows per query, of which a rank over all blocks keeps k.

Queries travel in groups of ``GROUP``. A pair of block and group is one row of work; both sides
are keyed by (block, group), so work is spread evenly whatever the ids are. Defined results: vectors
that are null, or hold a null or a non-finite component take no part, nor do null ids; a component whose integer, or
a found score, does not fit a long is an error, and slices are as wide as a block's values need; a query meets vectors of its own length only, and no row with its own id; rows that repeat an id
are rows of their own as candidates, and one query per distinct vector; ties go to the smaller id;
an empty vector scores 0; an empty table has no rows; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketspark.session import written

BLOCK = 8192
GROUP = 128
SCALE = 1024
LARGEST = float(2**63 // SCALE)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dims, q (integers) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    fits = F.forall("x", lambda v: (v >= -LARGEST) & (v < LARGEST))
    q = F.when(fits, F.transform("x", lambda v: F.floor(v * SCALE))).otherwise(F.raise_error("a component does not fit a long"))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
        .select("vec_id", F.size("x").alias("dims"), q.alias("q"),
                F.monotonically_increasing_id().alias("row_id"))
    )


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def build_blocks(rows: DataFrame, n_rows: int) -> DataFrame:
    """The index: one row per block with its ids, smallest value and slices."""
    blocks = max(1, -(-n_rows // BLOCK))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id").combine_chunks()
        block, dims = group["block"][0].as_py(), group["dims"][0].as_py()
        values = matrix(group["q"].combine_chunks(), dims).astype(np.int64)
        low = int(values.min(initial=0))
        width = max(1, (int(values.max(initial=0)) - low).bit_length())
        # Modulo 2^64, where the difference of two longs fits.
        lifted = (values.view(np.uint64) - np.uint64(low % (1 << 64))).T
        packed = np.stack([
            np.packbits(((lifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little") for b in range(width)], 1)
        padded = np.zeros((dims, width, -(-len(group) // 64) * 8), np.uint8)
        padded[:, :, :packed.shape[2]] = packed
        return pa.table({
            "block": [block], "dims": [dims], "low": pa.array([low], pa.int64()), "width": pa.array([width], pa.int32()),
            "ids": [np.asarray(group["vec_id"], dtype="<i8").tobytes()], "slices": [padded.tobytes()],
        }, schema=pa.schema([
            ("block", pa.int64()), ("dims", pa.int32()), ("low", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()),
            ("slices", pa.binary()),
        ]))

    return keyed.groupBy("block", "dims").applyInArrow(run, "block long, dims int, low long, width int, ids binary, slices binary")


def add_up(terms: np.ndarray) -> np.ndarray:
    """Sum of bit-sliced numbers, (numbers, slices, words) -> (slices, words): carry-save adders down to
    two numbers, then one addition with carry."""
    while len(terms) > 2:
        whole = len(terms) // 3
        a, b, c = terms[:whole], terms[whole:2 * whole], terms[2 * whole:3 * whole]
        half = a ^ b
        carry = np.zeros_like(a)
        carry[:, 1:] = ((a & b) | (half & c))[:, :-1]
        terms = np.concatenate([half ^ c, carry, terms[3 * whole:]])
    if len(terms) == 1:
        return terms[0]
    a, b = terms
    out, carry = np.empty_like(a), np.zeros_like(a[0])
    for s in range(len(a)):
        half = a[s] ^ b[s]
        out[s] = half ^ carry
        carry = (a[s] & b[s]) | (half & carry)
    return out


def score_slices(slices: np.ndarray, low: int, query: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices of (score - constant) for all rows of a block, and the constant."""
    dims, width, words = slices.shape
    # The absolute value of the smallest long fits without a sign only.
    weight = np.abs(query).view(np.uint64)
    places = max(1, int(weight.max(initial=0)).bit_length())
    total = width + places + max(1, dims).bit_length()
    ones = (1 << width) - 1
    # Row value v = low + u; a negative weight takes ones - u, the complement, instead of -u.
    constant = sum(query.tolist()) * low - sum(weight[query < 0].tolist()) * ones
    sum_ = np.zeros((1, total, words), np.uint64)
    for place in range(places - 1, -1, -1):
        sum_[:, 1:] = sum_[:, :-1].copy()
        sum_[:, 0] = 0
        chosen = np.flatnonzero((weight >> np.uint64(place)) & np.uint64(1))
        if len(chosen):
            terms = np.zeros((len(chosen) + len(sum_), total, words), np.uint64)
            terms[:len(chosen), :width] = slices[chosen]
            terms[:len(chosen), :width][query[chosen] < 0] ^= np.uint64(0xFFFFFFFFFFFFFFFF)
            terms[len(chosen):] = sum_
            sum_ = add_up(terms)[None]
    return sum_[0], constant


def positions(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def top_rows(scores: np.ndarray, allowed: np.ndarray, n: int, k: int) -> np.ndarray:
    """Places of the k highest rows; of rows that tie at the boundary the first."""
    sure, open_ = np.zeros_like(allowed), allowed
    for s in range(len(scores) - 1, -1, -1):
        tried = sure | (open_ & scores[s])
        count = int(np.bitwise_count(tried).sum())
        if count > k:
            open_ = open_ & scores[s]
        else:
            sure, open_ = tried, open_ & ~scores[s]
            if count == k:
                return positions(sure, n)
    found = positions(sure, n)
    return np.concatenate([found, positions(open_, n)[:k - len(found)]])


def read_back(bits: np.ndarray, constant: int) -> np.ndarray:
    """Scores from the bits of the chosen rows, (slices, rows)."""
    if len(bits) <= 62 and abs(constant) < 1 << 62:
        return (bits.astype(np.int64) << np.arange(len(bits))[:, None]).sum(0) + constant
    values = [sum(1 << s for s in np.flatnonzero(row).tolist()) + constant for row in bits.T]
    if any(not -1 << 63 <= v < 1 << 63 for v in values):
        raise OverflowError("a score does not fit a long")
    return np.array(values, np.int64)


def search_block(ids: np.ndarray, low: int, slices: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    n = len(ids)
    rows = np.zeros(slices.shape[2] * 64, np.uint8)
    rows[:n] = 1
    everyone = np.packbits(rows, bitorder="little").view(np.uint64)
    for query_id, query in zip(query_ids.tolist(), queries, strict=True):
        scores, constant = score_slices(slices, low, query)
        allowed = everyone
        own = np.arange(*np.searchsorted(ids, [query_id, query_id + 1]))
        if len(own):
            allowed = everyone.copy()
            for place in own.tolist():
                allowed[place // 64] &= ~np.uint64(1 << (place % 64))
        chosen = top_rows(scores, allowed, n, k)
        bits = (scores[:, chosen // 64] >> (chosen % 64).astype(np.uint64)) & np.uint64(1)
        yield query_id, ids[chosen], read_back(bits, constant)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with every other row.

    ``is_query`` is a condition on vec_id.
    """
    rows = written(quantised(vectors, id_col, vector_col), "quantised")
    queries = rows.filter(is_query).dropDuplicates(["vec_id", "q"])
    index = written(build_blocks(rows, rows.count()), "bit-slices")
    groups = max(1, -(-queries.count() // GROUP))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    bundles = (
        queries.withColumn("group", group).groupBy("group", "dims")
        .agg(F.collect_list(F.struct("vec_id", "q")).alias("queries"))
    )
    # A stated query set against all rows, in blocks: each pair of block and group is one row of work.
    left = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    places = index.select("block", "dims")
    right = places.join(bundles, "dims")
    work = left.join(right, ["block", "dims", "group"]).repartition("block", "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at] for i, name in enumerate(batch.schema.names)}
                dims, width = row["dims"].as_py(), row["width"].as_py()
                ids = np.frombuffer(row["ids"].as_py(), "<i8")
                raw = np.frombuffer(row["slices"].as_py(), np.uint64)
                made = row["queries"].values
                found = list(search_block(
                    ids, row["low"].as_py(), raw.reshape(dims, width, -(-len(ids) // 64)), made.field("vec_id").to_numpy(),
                    matrix(made.field("q"), dims).astype(np.int64), k,
                ))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)),
                    pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([v for _, _, v in found])),
                ], ["query_id", "vec_id", "score"])

    # Repeated query rows of one id and different vectors count as one query with the better score.
    found = work.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
