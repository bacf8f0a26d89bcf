"""Token ids in files of Simple-8b words.

A file holds the documents of one key range in ascending id order:

    magic | blocks | block directory | document directory | footer

A block is up to ``BLOCK`` consecutive ids in 64-bit little-endian words, its escaped values behind
them. The top four bits of a word select how many values share the other 60 bits, lowest first. Values
of more than 60 bits are escapes: the word names none of the value, which stands in the block's escape
list, so blocks decode without a scan word by word. The block directory has the offset, words, values
and escapes of each block; the document directory the id and the end of each document; so any range of
documents is read by its byte range.

Files are written by the tasks of a range partitioning, one each, under a name of its own that appears
when the file is complete: a task that runs again replaces its file by the same bytes. Defined results:
null texts are empty and hold the end id only; a null id comes first and is stored as the smallest
64-bit integer (which therefore cannot be an id); equal ids follow in text order; an empty table gives
no file and no rows; other columns stay out.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketspark.llm.common import WORD, Output, file_system, per_process, slices, texts
from ticketspark.session import scratch_path, written

# The layout of the words, as (values, bits) by selector; 14 is not used, 15 is an escape.
LAYOUT = [
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30),
    (1, 60),
]
ESCAPE = 15
MAGIC = b"S8BIDS01"
BLOCK = 4096
FOOTER = "<QQQQQ8s"  # blocks, block directory, documents, document directory, values, magic
NO_ID = -(1 << 63)
COUNTS = np.zeros(16, np.int64)
COUNTS[:14] = [n for n, _ in LAYOUT]
COUNTS[ESCAPE] = 1


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned value, by 16-bit digits from the top."""
    table = np.zeros(1 << 16, np.uint8)
    for bit in range(16):
        table[1 << bit:] = bit + 1
    top = int(values.max(initial=0))
    out = table[(values & np.uint64(0xFFFF)).astype(np.uint16)]
    for shift in (16, 32, 48):
        if top >> shift:
            digit = ((values >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            out = np.where(digit > 0, table[digit] + np.uint8(shift), out)
    return out


def pack(values: np.ndarray, block: int = BLOCK) -> list[tuple[bytes, int, int, int]]:
    """(bytes, words, values, escapes) for each run of ``block`` values. All blocks advance together."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return []
    n_blocks = -(-n // block)
    # Widest value of each window that starts at a place; no window reaches beyond its block.
    bits = np.full((n_blocks, block + 60), 255, np.uint8)
    inside = np.full(n_blocks * block, 255, np.uint8)
    inside[:n] = bit_lengths(values)
    bits[:, :block] = inside.reshape(n_blocks, block)
    selector = np.full((n_blocks, block), ESCAPE, np.uint8)
    widest, reach = bits, 1
    for k in range(len(LAYOUT) - 1, -1, -1):
        count, width = LAYOUT[k]
        if count > reach:
            step = count - reach
            widest = np.concatenate([np.maximum(widest[:, :-step], widest[:, step:]), np.full((n_blocks, step), 255, np.uint8)], 1)
            reach = count
        selector[widest[:, :block] <= width] = k
    take = np.zeros(n_blocks * block + 1, np.int64)
    take[:-1] = COUNTS[selector.ravel()]
    take[n:] = 0
    at = np.arange(n_blocks) * block
    ends = np.minimum(at + block, n)
    steps = []
    while (at < ends).any():
        steps.append(at.copy())
        at += np.where(at < ends, take[at], 0)
    start = np.stack(steps, 1)
    fresh = start < ends[:, None]
    number = fresh.sum(1)
    start = start[fresh]
    chosen = selector.ravel()[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k in np.unique(chosen):
        if k == ESCAPE:
            continue
        rows = np.flatnonzero(chosen == k)
        count, width = LAYOUT[k]
        first, word = start[rows], words[rows]
        for j in range(count):
            word |= values[first + j] << np.uint64(j * width)
        words[rows] = word
    out, cuts = [], np.concatenate([[0], np.cumsum(number)]).tolist()
    for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        escaped = values[start[lo:hi][chosen[lo:hi] == ESCAPE]]
        size = int(ends[b]) - b * block
        out.append((words[lo:hi].astype("<u8").tobytes() + escaped.astype("<u8").tobytes(), hi - lo, size, len(escaped)))
    return out


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of whole words, in order; works on many blocks at once."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[chosen]
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for k in np.unique(chosen):
        rows = chosen == k
        if k == ESCAPE:
            out[start[rows]] = escapes
            continue
        number, width = LAYOUT[k]
        mask, word, place = np.uint64((1 << width) - 1), words[rows], start[rows]
        for j in range(number):
            out[place + j] = (word >> np.uint64(j * width)) & mask
    return out


class Writer:
    """Documents in, one file out; holds a few megabytes of ids at a time."""

    def __init__(self, uri: str, flush_at: int = 256 * BLOCK):
        self.out = Output(uri)
        self.out.write(MAGIC)
        self.flush_at, self.held, self.n_held = flush_at, [], 0
        self.blocks, self.doc_ids, self.ends, self.values = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(np.asarray(ids, np.uint64))
        self.n_held += len(ids)
        self.values += len(ids)
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.ends.append(self.values)
        if self.n_held >= self.flush_at:
            self.flush(self.n_held - self.n_held % BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint64)
        for at in range(0, n, self.flush_at):
            for data, words, size, escapes in pack(ids[at:min(at + self.flush_at, n)]):
                self.blocks.append((self.out.size, words, size, escapes))
                self.out.write(data)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> dict:
        self.flush(self.n_held)
        block_at = self.out.size
        self.out.write(np.array(self.blocks, "<u8").reshape(-1, 4).tobytes())
        docs_at = self.out.size
        self.out.write(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.ends, "<u8").tobytes())
        self.out.write(struct.pack(FOOTER, len(self.blocks), block_at, len(self.doc_ids), docs_at, self.values, MAGIC))
        self.out.close()
        return {"n_docs": len(self.doc_ids), "n_values": self.values, "n_bytes": self.out.size}


class Reader:
    """Directories at once, blocks by byte range."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = struct.calcsize(FOOTER)
        blocks, block_at, docs, docs_at, self.values, magic = struct.unpack(FOOTER, self.file.read_at(tail, size - tail))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.blocks = np.frombuffer(self.file.read_at(blocks * 32, block_at), "<u8").reshape(-1, 4).astype(np.int64)
        self.block_ends = np.cumsum(self.blocks[:, 2]) if blocks else np.empty(0, np.int64)
        raw = self.file.read_at(docs * 16, docs_at)
        self.doc_ids, self.ends = np.frombuffer(raw[: docs * 8], "<i8"), np.frombuffer(raw[docs * 8:], "<u8").astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``, counted through the file."""
        if stop <= start:
            return np.empty(0, np.uint64)
        lo = int(np.searchsorted(self.block_ends, start, "right"))
        hi = int(np.searchsorted(self.block_ends, stop, "left")) + 1
        first, last = self.blocks[lo], self.blocks[hi - 1]
        raw = np.frombuffer(self.file.read_at(int(last[0] + (last[1] + last[3]) * 8 - first[0]), int(first[0])), "<u8")
        parts, at = [], 0
        escapes = []
        for _, words, _, extra in self.blocks[lo:hi].tolist():
            parts.append(raw[at:at + words])
            escapes.append(raw[at + words:at + words + extra])
            at += words + extra
        ids = unpack(np.concatenate(parts), np.concatenate(escapes))
        skipped = int(self.block_ends[lo] - self.blocks[lo][2])
        return ids[start - skipped:stop - skipped]

    def documents(self, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of documents, their starts, their tokens joined) for runs of about ``limit`` tokens."""
        starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        at = 0
        while at < len(self.ends):
            stop = max(at + 1, int(np.searchsorted(self.ends, starts[at] + limit, "right")))
            yield self.doc_ids[at:stop], starts[at:stop], self.read(int(starts[at]), int(self.ends[stop - 1]))
            at = stop


# Fixed value: the splitting rule of a known tokenizer. Texts of ASCII and Latin-1 letters fall by it into runs
# of letters, digits and signs that the tokenizer never joins.
SPLIT_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-`{-~"
RUN = re.compile(f"[{LETTERS}]+|[0-9]|[{SIGNS}]+")
OTHER = re.compile(f"[^{LETTERS}0-9{SIGNS}\x20\x09-\x0D]|<\\|")

# Byte-level characters of the Latin-1 letters: printable bytes stand for themselves, the others follow from 256 on.
PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = dict(zip([b for b in range(256) if b not in PLAIN], range(256, 512), strict=False))
BYTE_LEVEL = {c: "".join(chr(BYTES.get(b, b)) for b in chr(c).encode()) for c in range(128, 256)}


class Table(dict):
    """Chunk -> ids as bytes; each chunk goes through the tokenizer once while the table holds it."""

    def __init__(self, tokenizer_path: str, limit: int):
        import tokenizers

        super().__init__()
        self.model, self.limit = tokenizers.Tokenizer.from_file(tokenizer_path), limit
        with open(tokenizer_path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_runs = (steps[0].get("pattern") or {}).get("Regex") == SPLIT_RULE and rules["normalizer"]["normalizers"][-1]["type"] == "Lowercase"

    def __missing__(self, chunk: str) -> bytes:
        if self.by_runs and RUN.fullmatch(chunk):
            # What the tokenizer's own steps make of a run: lower case, then one character per byte.
            ids = [t.id for t in self.model.model.tokenize(chunk.lower().translate(BYTE_LEVEL))]
        else:
            ids = self.model.encode(chunk, add_special_tokens=False).ids
        made = self[chunk] = np.array(ids, "<u4").tobytes()
        return made

    def chunks(self, text: str) -> list[str]:
        if self.by_runs and not OTHER.search(text):
            return RUN.findall(text.lower())
        return WORD.findall(text)

    def encode(self, text: str | None, end: bytes) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, self.chunks(text or ""))) + end, "<u4")


def word_encoder(tokenizer_path: str, end_id: int | None, limit: int = 500_000) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts to ids with a tokenizer that never joins text across ASCII white space, with a table of bounded
    size that a worker process keeps between its tasks."""
    table = per_process(("tokens", tokenizer_path, limit), lambda: Table(tokenizer_path, limit))
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    return lambda values: [table.encode(v, end) for v in values]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode and write; returns one row per file: part, path, n_docs, n_values, n_bytes, start."""
    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, encode = TaskContext.get().partitionId(), None, None
        path = f"{folder}/ids-{part:06d}.s8b"
        for rows in slices(batches):
            writer = writer or Writer(path)
            encode = encode or word_encoder(tokenizer_path, end_id)
            for doc_id, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids)
        if writer:
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, **writer.close()}])

    files = written(ordered.mapInArrow(run, "part long, path string, n_docs long, n_values long, n_bytes long"), "token-files")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per file; each file is a whole partition of texts.
    return files.withColumn("start", F.coalesce(F.sum("n_values").over(before), F.lit(0)))


def _apart(files: DataFrame) -> DataFrame:
    """A task per file: as many ranges as paths, and a stated count is not merged again."""
    return files.select("path", "start").repartitionByRange(max(files.count(), 1), "path")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), ids, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for doc_ids, starts, ids in Reader(row["path"]).documents():
                    offsets = np.append(starts - starts[0], len(ids)).astype("int32")
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids, mask=doc_ids == NO_ID),
                        pa.array(starts + row["start"]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64))),
                    ], ["doc_id", "start", "ids"])

    return _apart(files).mapInArrow(run, "doc_id long, start long, ids array<long>")


def token_summary(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for doc_ids, starts, ids in Reader(row["path"]).documents():
                    raw = memoryview(ids.astype("<u4").tobytes())
                    edges = np.append(starts - starts[0], len(ids))
                    crc = [zlib.crc32(raw[a * 4:b * 4]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(starts + row["start"]),
                        pa.array(np.diff(edges)), pa.array(crc, pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _apart(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(docs: DataFrame) -> str:
    """A folder of its own below the shared one."""
    return scratch_path(docs.sparkSession, "ids")
