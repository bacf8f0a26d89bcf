"""Near-duplicates of texts by BagMinHash signatures, bands and verified multiset overlap.

A text is the multiset of its runs of ``SHINGLE`` words; similarity is the weighted Jaccard of the
multiplicities. Signatures come from Poisson processes over the discretised weights: the levels of a
shingle's weight are grouped in dyadic ranges (0,1], (1,2], (2,4], ... with one process each, of a rate equal
to the range's width. Each point of a process has a level inside its range and a register, both from bits of one
hash; it counts for a text whose multiplicity reaches that level, and each register keeps its earliest
point. Two registers agree with probability equal to the weighted Jaccard, without bias, and a
text costs about ``REGISTERS`` x (ln REGISTERS + 6) points whatever its length, since points after the last
register's time are never made.

Texts with equal words are one node. Nodes that share a band of ``ROWS`` registers are candidates. In a
bucket, each member is held against the first few nodes (pivots) of another component than its own; verified
links join components, buckets within one component are done, and the others go on with eight times the pivots, until
every member has met every other or their component. So a group of n copies that reach the threshold with their pivots costs about n comparisons, no bucket
is cut, and a link is only left out between texts that are already connected. After the first pivot, members that can reach
the threshold with nobody are told apart exactly: what a text shares with any other is at most the shingles that some
other open text has too, so a text with many shingles of its own has room for partners up to a certain size only, and
pairs without that room are never made. Of two texts that are left, the parities of their shingles' counts in bins differ in
no more bins than there are shingles that only one of them has; pairs that differ in more than the threshold
allows are never made either, which is exact too. Two members of several buckets meet in the first of these only. 128 registers in 25 bands of
5 miss a pair of similarity 0.8 once in 20,000.

Defined results: null texts, and texts without words, are alone; texts with fewer words than a shingle have
one shingle, all their words; repeated ids and rows count as documents of their own, a class is named by its
smallest id (null ids last); an empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketspark.llm.common import slices, texts
from ticketspark.llm.components import components
from ticketspark.llm.word_hash import Words, mix
from ticketspark.session import written

SHINGLE = 5
REGISTERS = 128
ROWS = 5
BANDS = REGISTERS // ROWS
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_counts(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, multiplicity), in order of document and hash."""
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    starts = np.flatnonzero(words.room() >= size)
    doc = np.concatenate([words.doc[starts], short])
    hashes = np.concatenate([
        words.runs(starts, size), mix(words.runs(words.first[short], words.counts[short]), 5),
    ])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def registers(doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Earliest point of every register, (documents, registers); infinite for documents without shingles."""
    weight = np.bincount(doc, counts, n_docs)
    out = np.full(n_docs * m, np.inf)
    ranges = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
    item = np.repeat(np.arange(len(doc)), ranges)
    level = np.arange(len(item)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    width = np.where(level > 0, np.left_shift(1, np.maximum(level - 1, 0)), 1)
    seed = mix(hashes[item] + level.astype(np.uint64) * GOLD, 3)
    owner, most = doc[item], counts[item]
    clock, number = np.zeros(len(item)), np.zeros(len(item), np.uint64)
    limit = np.where(weight > 0, m / np.maximum(weight, 1) * (np.log(m) + 6), 0)
    pending = np.full(len(item), -1.0)  # time of a point that was made but lay behind the limit
    active = np.arange(len(item))
    while len(active):
        live = active
        while len(live):
            fresh = live[pending[live] < 0]
            u = (mix(seed[fresh] + (number[fresh] * np.uint64(2) + np.uint64(1)) * GOLD) >> np.uint64(11)).astype(float)
            pending[fresh] = clock[fresh] - np.log((u + 0.5) / (1 << 53)) / width[fresh]
            live = live[pending[live] < limit[owner[live]]]
            clock[live] = pending[live]
            pending[live] = -1
            bits = mix(seed[live] + (number[live] * np.uint64(2) + np.uint64(2)) * GOLD)
            number[live] += np.uint64(1)
            register = (bits % np.uint64(m)).astype(np.int64)
            place = ((bits >> np.uint64(32)).astype(np.int64) & (width[live] - 1)) + np.where(level[live] > 0, width[live], 0) + 1
            counted = place <= most[live]
            np.minimum.at(out, owner[live][counted] * m + register[counted], clock[live][counted])
        # Where a register is still open, all points up to twice the time are made.
        open_ = np.isinf(out.reshape(n_docs, m)).any(1) & (weight > 0)
        limit = np.where(open_, limit * 2, limit)
        active = active[open_[owner[active]]]
    return out.reshape(n_docs, m)


def band_keys(earliest: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, (documents, bands)."""
    values = mix(np.ascontiguousarray(earliest).view(np.uint64))
    keys = np.empty((len(values), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(values), band + 1, np.uint64)
        for column in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * GOLD + values[:, column])
        keys[:, band] = key
    return keys.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (of the raw text), n_words, k1 and k2 (of the words), bands."""
    frame = texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column(1))
            first = np.where(words.counts > 0, words.first[:-1], 0)
            k1, k2 = (words.runs(first, words.counts, salt).view(np.int64) for salt in (6, 7))
            keys = band_keys(registers(*shingle_counts(words), words.n_docs))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(words.counts), pa.array(k1), pa.array(k2), bands],
                ["doc_id", "mark", "n_words", "k1", "k2", "bands"])

    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, mark long, n_words long, k1 long, k2 long, bands array<long>")


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard of the shingles of texts at equal places."""
    sides = [shingle_counts(Words(column)) for column in (left, right)]
    n = len(left)
    pair = np.concatenate([s[0] for s in sides])
    hashes = np.concatenate([s[1] for s in sides])
    counts = np.concatenate([s[2] for s in sides])
    order = np.lexsort((hashes, pair))
    pair, hashes, counts = pair[order], hashes[order], counts[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1]))
    both = np.bincount(pair[same], np.minimum(counts[same], counts[same + 1]), n)
    total = np.bincount(pair, counts, n)
    return both / np.maximum(total - both, 1)


def verified(pairs: DataFrame, node_texts: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose texts reach the threshold, with the similarity."""
    # The text of b comes first, as b is seldom repeated; the hot pivots are joined by wide rows, which AQE splits.
    with_b = pairs.join(node_texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(node_texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4 << 20):
            found = similarities(part.column(2), part.column(3))
            hit = pa.array(found >= threshold)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(hit), part.column(1).filter(hit), pa.array(found).filter(hit)], ["a", "b", "similarity"])

    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def parities(column: pa.StringArray) -> pa.ListArray:
    """Per text a bit string, as 64-bit integers: bit i is the parity of the shingles in bin i, repeats counted. There are
    512 bins, or the power of two that is at least twice the shingles. Half of a string laid on the other by XOR is the string of half the bins."""
    words = Words(column)
    doc, hashes, counts = shingle_counts(words)
    size = np.bincount(doc, counts, words.n_docs)
    bins = np.exp2(np.ceil(np.log2(np.maximum(2 * size, 512)))).astype(np.int64)
    ends = np.cumsum(bins)
    odd = counts % 2 == 1
    place = (mix(hashes[odd], 8) & (bins[doc[odd]] - 1).astype(np.uint64)).astype(np.int64) + (ends - bins)[doc[odd]]
    bits = (np.bincount(place, minlength=int(bins.sum())) & 1).astype(np.uint8)
    packed = np.packbits(bits, bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends // 64).astype(np.int32)), pa.array(packed))


def apart(left: Column | str, right: Column | str) -> Column:
    """At least so many shingles are in one of the two texts only, from their parities; 0 where one text is more than
    twice as long, or has no parities."""
    n = F.least(F.size(left), F.size(right))

    def folded(side):
        halves = F.zip_with(F.slice(side, F.lit(1), n), F.slice(side, n + 1, n), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(side) == n, F.col(side) if isinstance(side, str) else side).otherwise(halves)

    differ = F.aggregate(
        F.zip_with(folded(left), folded(right), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)
    return F.when((n > 0) & (F.greatest(F.size(left), F.size(right)) <= 2 * n), differ).otherwise(0)


def with_room(members: DataFrame, nodes: DataFrame, node_texts: DataFrame, threshold: float) -> DataFrame:
    """``members`` (bucket, node, further columns) with size and room, the largest size of a text that the node could be similar enough to;
    without members whose bucket has nobody that small. Those that are left get their parities.

    The shingles that x shares with y are at most m, those of x that another member of any bucket has too. From
    shared >= t / (1 + t) (size(x) + size(y)) follows size(y) <= m (1 + t) / t - size(x), for both of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            doc, hashes, counts = shingle_counts(Words(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), part.column(0).take(pa.array(doc)), pa.array(counts.astype(np.int64))], ["shingle", "node", "n"])

    open_nodes = members.select("node").distinct()
    spelled = node_texts.join(open_nodes, "node", "left_semi").select("node", "text").mapInArrow(run, "shingle long, node long, n long")
    # Shingles of one text only; common ones merge before they move.
    alone = spelled.groupBy("shingle").agg(F.count("*").alias("nodes"), F.min("node").alias("node"), F.min("n").alias("n")).filter("nodes = 1")
    own = alone.groupBy("node").agg(F.sum("n").alias("own"))
    size = F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1))
    room = (F.col("size") - F.coalesce("own", F.lit(0))) * ((1 + threshold) / threshold) - F.col("size") + 1e-6
    sized = nodes.select("node", size.alias("size")).join(open_nodes, "node").join(own, "node", "left").select("node", "size", room.alias("room"))
    placed = members.join(written(sized, "rooms"), "node")
    least = placed.groupBy("bucket").agg(F.min("size").alias("least"))
    left = written(placed.join(least, "bucket").filter("room >= least").drop("least"), "buckets-with-room")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), parities(part.column(1))], ["node", "parity"])

    marked = node_texts.join(left.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(bits, "node long, parity array<long>")
    return written(left.join(marked, "node"), "buckets-with-parities")


def joined_further(joined: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) with the new links; only components that a new link touches are worked on."""
    of = [joined.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")) for side in "ab"]
    lifted = found.join(of[0], "a", "left").join(of[1], "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = components(lifted)
    moved = joined.join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
    return written(moved.select("node", F.coalesce("now", "component").alias("component")).unionByName(merged), "joined")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, nodes, links).

    documents: doc_id, mark, node (null for texts without words), class_id, class_size, kept.
    nodes: node, first_id, first_mark, size (documents with these words).
    links: a, b, similarity between nodes.
    """
    spark = docs.sparkSession
    signed = written(signatures(docs, id_col, text_col), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("first")
    grouped = signed.filter("n_words > 0").groupBy("k1", "k2", "n_words").agg(first, F.count("*").alias("size"), F.any_value("bands").alias("bands"))
    nodes = written(grouped.select(
        F.monotonically_increasing_id().alias("node"), "k1", "k2", "n_words", F.col("first.doc_id").alias("first_id"),
        F.col("first.mark").alias("first_mark"), "size", "bands",
    ), "nodes")
    # The low halves of a node's bands tell in which bucket two nodes meet first; only there are they made a pair.
    prints = F.transform("bands", lambda key: F.shiftright(F.shiftleft(key, 32), 32).cast("int"))
    members = nodes.select("node", prints.alias("prints"), F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    live = written(members.join(shared, "bucket").select(
        "bucket", "band", "node", "prints", F.lit(1).cast("long").alias("size"), F.lit(1e300).alias("room"),
        F.array().cast("array<long>").alias("parity")), "buckets")
    wanted = nodes.join(live.select("node").distinct(), "node", "left_semi").select("node", "first_id", "first_mark")
    raw = texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    same = raw["doc_id"].eqNullSafe(wanted["first_id"]) & (raw["mark"] == wanted["first_mark"])
    node_texts = written(raw.join(wanted, same).select("node", "text").dropDuplicates(["node"]), "node-texts")

    links = spark.createDataFrame([], "a long, b long, similarity double")
    tested = spark.createDataFrame([], "a long, b long")
    joined = spark.createDataFrame([], "node long, component long")
    pivots, before, bounded = 1, 0, False
    while True:
        # A bucket whose members are all in one component is done.
        placed = live.join(joined, "node", "left").select("bucket", "band", "node", "prints", "size", "room", "parity", F.coalesce("component", "node").alias("component"))
        spread = placed.groupBy("bucket").agg(
            F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        open_ = written(placed.join(spread.select("bucket", "n"), "bucket"), "open-buckets")
        most = open_.agg(F.max("n")).first()[0]
        if most is None:
            break
        if pivots > 1 and not bounded:
            # Ranks begin anew among those that are left; pairs that were tested are known.
            live, before, bounded = with_room(open_.select("bucket", "band", "node", "prints"), nodes, node_texts, threshold), 0, True
            continue
        # The order is the same in all buckets, so that buckets with the same nodes have the same pivots.
        # Rank filters keep at most ``pivots`` rows of a bucket per task before any row moves.
        rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.xxhash64("node"), "node"))
        chosen = open_.withColumn("rank", rank).filter((F.col("rank") <= pivots) & (F.col("rank") > before))
        chosen = chosen.select(
            "bucket", F.col("node").alias("a"), F.col("component").alias("of_a"), F.col("size").alias("size_a"), F.col("room").alias("room_a"),
            F.col("prints").alias("prints_a"), F.col("parity").alias("parity_a"))
        first = F.array_position(F.zip_with("prints", "prints_a", lambda x, y: x == y), True) == F.col("band") + 1
        # Both have (1 - t) / (1 + t) of their shingles to themselves at most.
        near = apart("parity", "parity_a") * (1 + threshold) <= (F.col("size") + F.col("size_a")) * (1 - threshold) + 1e-6
        met = chosen.join(open_, "bucket").filter(F.expr("component <> of_a and room >= size_a and room_a >= size") & near & first)
        pairs = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = written(verified(pairs, node_texts, threshold), "verified")
        links, tested = links.union(found), tested.union(pairs)
        if not found.isEmpty():
            joined = joined_further(joined, found)
        if pivots >= most:
            break
        pivots, before = pivots * 8, pivots

    named = nodes.join(joined, "node", "left").select(
        "k1", "k2", "n_words", "node", "size", "first_id", "first_mark", F.coalesce("component", "node").alias("component"))
    first_id = F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "first_mark")).alias("first")
    classes = named.groupBy("component").agg(first_id, F.sum("size").alias("class_size"))
    placed = named.join(classes, "component").select(
        "k1", "k2", "n_words", "node", F.col("first.first_id").alias("class_id"), F.col("first.first_mark").alias("class_mark"), "class_size")
    # Documents without words find no node and are alone.
    documents = signed.select("doc_id", "mark", "n_words", "k1", "k2").join(placed, ["k1", "k2", "n_words"], "left").select(
        "doc_id", "mark", "node",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("node").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))).alias("kept"),
    )
    return documents, nodes.select("node", "first_id", "first_mark", "size"), links


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns, whatever their names.

    Rows travel in a struct and move once, by id and mark, which the rank inside these needs too.
    """

    def key(doc_id: Column, mark: Column) -> Column:
        """One value that is never null."""
        return F.concat_ws("/", F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")), mark.cast("string"))

    documents, _, _ = near_duplicates(docs, threshold, id_col, text_col)
    stay = documents.filter("kept").select(key(F.col("doc_id"), F.col("mark")).alias("stay"))
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(F.col(id_col), mark).alias("stay"))
    # Of rows that repeat id and text one stays.
    copy = F.row_number().over(W.partitionBy("stay").orderBy("stay"))
    return rows.join(stay, "stay", "left_semi").withColumn("copy", copy).filter("copy = 1").select("row.*")
