"""Training CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.text import is_blank, normalise_label
from ticketspark.operators.contracts import require_columns, require_known_labels
from ticketspark.operators.ranking import first_rows

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


#: Place of a row in a folder of files: file name, then row in the file.
PLACE = ["_file", "_row"]


def read_csv(spark: SparkSession, path: str, with_place: bool = False) -> DataFrame:
    """All columns as text; the literals that mean "missing" become NULL.

    With ``with_place`` rows carry ``PLACE``. A file that may hold quoted line breaks is read by one task, which numbers
    its rows in order; in which order Spark takes the files does not matter.
    """
    df = spark.read.options(**CSV).csv(path)
    place = [F.col("_metadata.file_path").alias(PLACE[0]), F.monotonically_increasing_id().alias(PLACE[1])] if with_place else []
    return df.select(*[F.when(~F.col(f"`{c}`").isin(S.NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns], *place)


def write_dataset(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """S3. Columns in the order of ``df``; CSV gets a header."""
    writer = df.write.mode(mode)
    if format == "csv":
        # Line breaks, quotes and outer blanks of texts survive the round trip.
        writer.options(
            header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        ).csv(path)
    else:
        writer.format(format).save(path)


def labelled(
    df: DataFrame,
    text_column: str = "ticket_text",
    label_column: str = "priority",
    max_rows: int | None = None,
    order: Sequence[str] = ("ticket_id",),
) -> DataFrame:
    """S2. Rows with text and label, label normalised; a label outside the vocabulary fails.

    The cap keeps exactly the first ``max_rows`` of the rows that passed the filters, in the order of the columns
    ``order``.
    """
    require_columns(df, [text_column, label_column])
    rows = df.where(F.col(text_column).isNotNull() & F.col(label_column).isNotNull())
    rows = require_known_labels(rows.withColumn(label_column, normalise_label(label_column)), label_column)
    return rows if max_rows is None else first_rows(rows, order, max_rows)


def load_labelled(spark: SparkSession, path: str, max_rows: int | None = None, **columns: str) -> DataFrame:
    """S2 on CSV files; the cap goes by the order of the rows in the files."""
    if max_rows is None:
        return labelled(read_csv(spark, path), **columns)
    return labelled(read_csv(spark, path, with_place=True), max_rows=max_rows, order=PLACE, **columns).drop(*PLACE)


def saved_texts(spark: SparkSession, path: str) -> DataFrame:
    """S4. (ticket_id, ticket_text, position) with a text; a missing file gives no rows.

    ``position`` orders rows by file name and row, so the last value of a ticket is the one in the last file.
    """
    try:
        df = read_csv(spark, path, with_place=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "ticket_id long, ticket_text string, position struct<file: string, row: long>")
    return (
        df.select(
            F.col("ticket_id").cast("long"), "ticket_text", F.struct(F.col(PLACE[0]).alias("file"), F.col(PLACE[1]).alias("row")).alias("position")
        )
        .where(~is_blank("ticket_text"))
    )
