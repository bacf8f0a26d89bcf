"""Removal of repeated passages with difference-cover anchors.

A window is ``length`` consecutive words. With a difference cover D modulo v, any two places i and j have
a shift below v that puts both at cover positions, so two equal windows share an aligned anchor: the hash of
length - v + 1 words at a cover position. Only the |D| / v places of the cover are hashed and moved. Where
an anchor occurs more than once, the windows around it are hashed whole, and those that occur more
than once are removed; every other place is out after the first round.

Documents lie in blocks of some megabytes, by a hash of their row. A block sends each distinct hash once, so
a passage in a third of all documents is a few numbers per block and not a hot key; hashes travel as
sorted lists per (block, range of hashes), and what comes back is one bit per hash, which the block reads
against its own list. Anchors travel as 32 bits within their range (a chance hit there only costs time);
windows as 80 bits.

Defined results: null and empty texts have no words and give an empty text; texts below ``length`` words are
kept whole; every input row gives one row, repeated ids too; other columns stay out; an empty table gives no
rows. Very long texts are never cut, a text lies in one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketspark.llm.common import texts
from ticketspark.llm.word_hash import Words

# Perfect difference sets.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
BLOCK_BYTES = 8 << 20
ANCHORS, WINDOWS = 0, 1
SENT = "bucket long, block long, kind int, hashes binary, more binary, again binary"
BACK = "block long, bucket long, kind int, bits binary"


def period_for(length: int) -> int:
    """The sparsest cover whose anchors keep at least half of the window."""
    return max(v for v in COVERS if length - v + 1 >= max(1, length / 2))


def split_points(buckets: int) -> np.ndarray:
    """Last hash of each range."""
    return np.array([((b + 1) << 64) // buckets - 1 for b in range(buckets)], np.uint64)


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


class Block:
    """One block's words, and its hashes in the order in which they are sent."""

    def __init__(self, column: pa.ChunkedArray, length: int, period: int, buckets: int):
        self.words = Words(pa.concat_arrays([c for c in column.chunks]) if column.num_chunks else pa.array([], pa.string()))
        self.length, self.period, self.buckets = length, period, buckets
        self.room = self.words.room()

    def lists(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Distinct hashes, place in them of every hash, whether they occur again here, (range, from, to)."""
        distinct, first, place, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        cuts = np.concatenate([[0], np.searchsorted(distinct, split_points(self.buckets), "right")])
        cells = [(b, int(cuts[b]), int(cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts)).tolist()]
        self.first = first
        return distinct, place, counts > 1, cells

    def anchors(self):
        size = self.length - self.period + 1
        cover = np.zeros(self.period, bool)
        cover[list(COVERS[self.period])] = True
        self.anchor_at = np.flatnonzero(cover[self.words.places() % self.period] & (self.room >= size))
        return self.lists(self.words.runs(self.anchor_at, size))

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the repeated anchors."""
        at = self.anchor_at[repeated]
        first = np.maximum(at - self.period + 1, np.repeat(self.words.first[:-1], self.words.counts)[at])
        change = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(change, first, 1)
        np.add.at(change, at + 1, -1)
        return np.flatnonzero((np.cumsum(change[:-1]) > 0) & (self.room >= self.length))

    def windows(self, starts: np.ndarray):
        self.check = (self.words.runs(starts, self.length, 1) & np.uint64(0xFFFF)).astype("<u2")
        return self.lists(self.words.runs(starts, self.length, 2))

    def repeated(self, found, bits: dict[int, bytes]) -> np.ndarray:
        """For every hash, in the order of the places, whether it is repeated anywhere."""
        distinct, place, again, cells = found
        flags = again.copy()
        for bucket, lo, hi in cells:
            if bucket in bits:
                flags[lo:hi] |= flags_of(bits[bucket], hi - lo)
        return flags[place]

    def rows(self, kind: int, block: int, found) -> pa.Table:
        distinct, _, again, cells = found
        rows = []
        for bucket, lo, hi in cells:
            if kind == ANCHORS:
                base = np.uint64((bucket << 64) // self.buckets)
                shift = np.uint64(max(0, 33 - self.buckets.bit_length()))
                sent, more = ((distinct[lo:hi] - base) >> shift).astype("<u4"), b""
            else:
                sent, more = distinct[lo:hi].astype("<u8"), self.check[self.first[lo:hi]].tobytes()
            rows.append((bucket, block, kind, sent.tobytes(), more, bits_of(again[lo:hi])))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        names = ["bucket", "block", "kind", "hashes", "more", "again"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def compare(group: pa.Table) -> pa.Table:
    """For one range of hashes: to each block one bit per hash it sent, set if it occurs again anywhere."""
    kind = group["kind"][0].as_py()
    parts = [np.frombuffer(raw.as_py(), "<u4" if kind == ANCHORS else "<u8") for raw in group["hashes"]]
    sizes = [len(p) for p in parts]
    hashes = np.concatenate(parts)
    again = np.concatenate([flags_of(raw.as_py(), n) for raw, n in zip(group["again"], sizes, strict=True)])
    if kind == WINDOWS:
        more = np.concatenate([np.frombuffer(raw.as_py(), "<u2") for raw in group["more"]])
        order = np.lexsort((more, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (more[order][1:] != more[order][:-1])
    else:
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
    number = np.cumsum(new) - 1
    total = np.bincount(number, 1 + again[order])
    flags = np.empty(len(order), bool)
    flags[order] = total[number] > 1
    out = [(b.as_py(), g.as_py(), kind, bits_of(f)) for b, g, f in
           zip(group["block"], group["bucket"], np.split(flags, np.cumsum(sizes)[:-1]), strict=True) if f.any()]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table({n: pa.array(c, k) for n, c, k in zip(["block", "bucket", "kind", "bits"], columns, kinds, strict=True)})


def bits_by_range(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {r["bucket"]: r["bits"] for r in table.to_pylist() if r["kind"] == kind}


def remove_repeated(
    docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one blank)."""
    rows = texts(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // block_bytes))
    period = period_for(length)
    row = F.xxhash64(F.monotonically_increasing_id())
    blocks = rows.withColumn("block", F.pmod(row, F.lit(buckets)))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def send_anchors(group: pa.Table) -> pa.Table:
        block = Block(group["text"], length, period, buckets)
        return block.rows(ANCHORS, group["block"][0].as_py(), block.anchors())

    def send_windows(group: pa.Table, bits: pa.Table) -> pa.Table:
        block = Block(group["text"], length, period, buckets)
        repeated = block.repeated(block.anchors(), bits_by_range(bits, ANCHORS))
        return block.rows(WINDOWS, group["block"][0].as_py(), block.windows(block.candidates(repeated)))

    def cut(group: pa.Table, bits: pa.Table) -> pa.Table:
        block = Block(group["text"], length, period, buckets)
        words = block.words
        starts = block.candidates(block.repeated(block.anchors(), bits_by_range(bits, ANCHORS)))
        gone = starts[block.repeated(block.windows(starts), bits_by_range(bits, WINDOWS))]
        change = np.zeros(len(words) + 1, np.int32)
        change[gone] += 1
        np.add.at(change, gone + length, -1)
        keep = np.cumsum(change[:-1]) == 0
        return pa.table({
            "doc_id": group["doc_id"], "n_words": pa.array(words.counts),
            "n_removed": pa.array(np.bincount(words.doc[~keep], minlength=words.n_docs).astype(np.int64)), "kept": words.joined(keep),
        })

    anchor_bits = blocks.groupBy("block").applyInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(compare, BACK)
    sent = blocks.groupBy("block").cogroup(anchor_bits.groupBy("block")).applyInArrow(send_windows, SENT)
    window_bits = sent.groupBy("bucket").applyInArrow(compare, BACK)
    return blocks.groupBy("block").cogroup(anchor_bits.union(window_bits).groupBy("block")).applyInArrow(
        cut, f"doc_id {id_type}, n_words long, n_removed long, kept string")
