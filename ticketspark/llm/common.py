"""Small helpers that several operators share."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, so that no other column can clash; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``limit`` bytes; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fold(key: str | Column, *parts: str) -> Column:
    """crc32 of the id as text, modulo 5: the folds of the learning operators."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key) % 5


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store behind a path, for reads of byte ranges and for files that Spark has no writer for."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return pa.fs.FileSystem.from_uri(uri)
    return pa.fs.LocalFileSystem(), uri


def per_process(key: tuple, make):
    """One object per Python worker process, kept between its tasks. Code that travels by value has
    no module of its own on an executor, so the objects hang in a module made for them."""
    store = sys.modules.setdefault("_ticketspark_kept", types.ModuleType("_ticketspark_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


class Output:
    """A file that appears under its name only when it is complete, so a task may be run again."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.draft)
        self.size = 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        """Nothing to do before the file is complete."""

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.draft, self.path)
