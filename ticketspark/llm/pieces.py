"""SentencePiece encoding and decoding with a table of distinct chunks.

A chunk is a run of white-space markers and the characters up to the next marker. Where no piece of
the model holds a marker behind another character, no merge can cross a chunk's start, so a text's ids
are the ids of its chunks one after the other. Each task therefore segments every distinct chunk once,
keeps it in a table of at most ``TABLE`` entries (and those of the slice at hand), and joins the ids
back by position. Decoding is the same with the runs of ids that start at a piece with a marker.

The work needs no shuffle: a task reads its rows once, and a lost one is simply run again. Defined
results: null and empty texts have the end id only, and decode to an empty text; null ids decode to
null; rows and ids may repeat; other columns stay out; literal markers count as white space, as in the
library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketspark.llm.common import per_process, slices, texts

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE = 150_000


def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any(MARK in name.lstrip(MARK) for name in names):
        raise ValueError("a piece of this model crosses white-space markers")
    if model.encode("a  b ") != model.encode(f"a{MARK}{MARK}b{MARK}") or names[model.encode("a")[0]][0] != MARK:
        raise ValueError("this model does not keep white space behind a marker in front")
    return model, names


class Encoder:
    """Chunk without its first marker -> ids, as the bytes of 32-bit integers."""

    def __init__(self, path: str, limit: int = TABLE):
        self.model, names = load(path)
        self.limit, self.table = limit, {}
        self.lone = np.array([names.index(MARK)], "<i4").tobytes()
        self.end = np.array([self.model.eos_id()], "<i4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        if len(self.table) > self.limit:
            self.table = {}
        new = list(chunks - self.table.keys())
        # The library puts one marker in front by itself.
        made = self.model.encode(new, num_threads=1)
        ends = np.append(0, np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))) * 4
        raw, ends = np.fromiter(chain.from_iterable(made), "<i4", ends[-1] // 4).tobytes(), ends.tolist()
        for chunk, a, b in zip(new, ends, ends[1:], strict=False):
            self.table[chunk] = raw[a:b] or self.lone

    def __call__(self, values: pa.StringArray | list[str | None]) -> list[bytes]:
        column = values if isinstance(values, pa.Array) else pa.array(values, pa.string())
        column = pc.replace_substring(pc.fill_null(column, ""), MARK, " ")
        # Where every blank stands alone behind another character, the words between them are the chunks, without their marker.
        runs = pc.or_(pc.match_substring(column, "  "), pc.or_(pc.starts_with(column, " "), pc.equal(column, "")))
        plain = np.flatnonzero(~runs.to_numpy(zero_copy_only=False))
        out = [b""] * len(column)
        if len(plain):
            raw, edges = self.joined(pc.split_pattern(column.take(pa.array(plain)), " "))
            for place, a, b in zip(plain.tolist(), edges, edges[1:], strict=False):
                out[place] = raw[a:b] + self.end
        others = np.flatnonzero(runs.to_numpy(zero_copy_only=False))
        cut = [CHUNK.findall(MARK + v.replace(" ", MARK)) if v else [] for v in column.take(pa.array(others)).to_pylist()]
        self.learn({chunk[1:] for chunks in cut for chunk in chunks})
        for place, chunks in zip(others.tolist(), cut, strict=True):
            out[place] = b"".join(self.table[chunk[1:]] for chunk in chunks) + self.end
        return out

    def joined(self, words: pa.ListArray) -> tuple[bytes, list[int]]:
        """Ids of all words one after the other, and where each text's begin: only distinct words are looked up in Python."""
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        self.learn(set(known))
        ids = list(map(self.table.__getitem__, known))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = coded.indices.to_numpy()
        length = sizes[at]
        ends = np.append(0, np.cumsum(length))
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], length) + np.arange(ends[-1])
        offsets = words.offsets.to_numpy()
        return np.frombuffer(b"".join(ids), "<i4")[place].tobytes(), (ends[offsets - offsets[0]] * 4).tolist()


class Decoder:
    """Run of ids, as bytes -> text."""

    def __init__(self, path: str, limit: int = TABLE):
        self.model, names = load(path)
        self.limit, self.table = limit, {}
        self.starts = np.array([name.startswith(MARK) for name in names])
        # Decoded behind this piece, a run keeps its own white space.
        self.front = self.model.encode("a")[0]
        self.front_text = self.model.decode([self.front])
        every = range(len(names))
        alone = [t[len(self.front_text):] for t in self.model.decode([[self.front, i] for i in every])]
        # Bytes of longer characters mean something together only.
        self.bound = np.array([self.model.is_byte(i) and not "\x01" <= alone[i] <= "\x7f" for i in every])
        # What each piece adds to the text, and what it adds in front.
        self.alone = pa.array([*alone, *[t.removeprefix(" ") if s else t for t, s in zip(alone, self.starts.tolist(), strict=True)]], pa.string())

    def learn(self, runs: set[bytes]) -> None:
        if len(self.table) > self.limit:
            self.table = {}
        new = list(runs - self.table.keys())
        decoded = self.model.decode([[self.front, *np.frombuffer(r, "<i4").tolist()] for r in new]) if new else []
        for run, text in zip(new, decoded, strict=True):
            self.table[run] = text[len(self.front_text):]

    def __call__(self, values: list[np.ndarray | None]) -> list[str | None]:
        sizes = np.array([0 if ids is None else len(ids) for ids in values], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *(ids for ids in values if ids is not None)])
        edges = np.append(0, np.cumsum(sizes))
        bound = np.append(0, np.cumsum(self.bound[flat]))[edges]
        front = edges[:-1][sizes > 0]
        flat[front] += len(self.starts)
        # Pieces that stand one after the other are the text: its ends are ends of pieces.
        pieces = self.alone.take(pa.array(flat))
        _, offsets, data = pieces.buffers()
        ends = np.frombuffer(offsets, np.int32)[pieces.offset:][edges] if len(flat) else np.zeros(len(edges), np.int32)
        texts = pa.StringArray.from_buffers(len(values), pa.py_buffer(np.ascontiguousarray(ends)), data if len(flat) else pa.py_buffer(b"")).to_pylist()
        others = [i for i, ids in enumerate(values) if ids is None or bound[i + 1] > bound[i]]
        for i, text in zip(others, self.by_runs([values[i] for i in others]), strict=True):
            texts[i] = text
        return texts

    def by_runs(self, values: list[np.ndarray | None]) -> list[str | None]:
        cut = []
        for ids in values:
            if ids is None:
                cut.append(None)
                continue
            at = np.flatnonzero(self.starts[ids])
            edges = (np.unique(np.concatenate([[0], at, [len(ids)]])) * 4).tolist()
            raw = ids.astype("<i4").tobytes()
            cut.append([raw[a:b] for a, b in zip(edges, edges[1:], strict=False)])
        self.learn(set().union(*(runs for runs in cut if runs)))
        get = self.table.__getitem__
        joined = [None if runs is None else "".join(map(get, runs)) for runs in cut]
        # The library takes one blank off the front of a text that starts with a marker.
        return [
            t[1:] if t and t[0] == " " and ids is not None and len(ids) and self.starts[ids[0]] else t
            for t, ids in zip(joined, values, strict=True)
        ]


def id_lists(raw: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def lists_of(column: pa.ListArray) -> list[np.ndarray | None]:
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int, with the end id behind them)."""
    frame = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("pieces", model_path), lambda: Encoder(model_path))
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), id_lists(encoder(part.column(1)))], ["doc_id", "ids"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text: what the library's decode gives for the ids."""
    frame = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_process(("texts", model_path), lambda: Decoder(model_path))
        for part in slices(batches):
            made = pa.array(decoder(lists_of(part.column(1))), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], ["doc_id", "ids", "text"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, text: ``decode(encode(docs))`` in one pass, so that rows go to Python and back once."""
    frame = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("pieces", model_path), lambda: Encoder(model_path))
        decoder = per_process(("texts", model_path), lambda: Decoder(model_path))
        for part in slices(batches):
            raw = encoder(part.column(1))
            made = pa.array(decoder([np.frombuffer(r, "<i4") for r in raw]), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), id_lists(raw), made], ["doc_id", "ids", "text"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
