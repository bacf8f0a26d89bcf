"""Uploaded CSV files to pending tickets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.ids import row_id
from ticketspark.functions.text import long_enough, strip
from ticketspark.operators.ranking import first_in_group
from ticketspark.session import written

BYTE_ORDER_MARK = chr(0xFEFF)


# A field that is complete on its line, and what stands before an unfinished one. All loops are possessive, so a scan is
# linear and needs no stack. A quote opens a field only at its start; two quotes inside a quoted field are one.
_CLOSED = r'"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELDS = rf'(?:(?:{_CLOSED}|[^",][^,]*+|),)*+'
_OPEN = r'"[^"]*+(?:""[^"]*+)*+\z'
#: The line ends inside quotes, if it starts outside of them, or inside.
_OPENS = rf"\A{_FIELDS}{_OPEN}"
_STAYS = rf'\A[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+(?:,{_FIELDS}{_OPEN}))'


def _inside_before(lines: DataFrame) -> DataFrame:
    """Lines with ``inside``, whether they start inside a quoted field.

    A line maps the state before it to the state after it: it leaves the state, turns it, or sets it. The state
    before a line is what the nearest line that sets it says, turned as often as lines in between turn it; first inside each
    block of a file, then over the blocks, one row each.
    """
    quoted = F.instr("value", '"') > 0
    opens, stays = quoted & F.col("value").rlike(_OPENS), ~quoted | F.col("value").rlike(_STAYS)
    turns = (opens & ~stays).cast("int")
    lines = lines.withColumns({"_sets": F.when(opens == stays, opens), "_turns": turns})

    def before(keys: list[str], order: str, start: Column) -> Column:
        so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        turned = F.coalesce(F.sum("_turns").over(so_far), F.lit(0))
        set_to = F.last(F.when(F.col("_sets").isNotNull(), F.struct("_sets", F.col("_turned").alias("at"))), ignorenulls=True).over(so_far)
        # ``_turned`` counts the turns up to and with a line.
        known = F.when(set_to.isNotNull(), set_to["_sets"].cast("int") + turned - set_to["at"]).otherwise(start.cast("int") + turned)
        return known % 2 == 1

    def up_to(keys: list[str], order: str) -> Column:
        return F.sum("_turns").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

    per_block = lines.withColumn("_turned", up_to(["file", "block"], "row"))
    # What a block does as a whole: both states taken through it.
    last = F.max_by(F.struct("_sets", "_turned"), F.when(F.col("_sets").isNotNull(), F.col("row")))
    blocks = per_block.groupBy("file", "block").agg(F.max("_turned").alias("_all"), last.alias("_last")).select(
        "file", "block",
        F.when(F.col("_last").isNotNull(), (F.col("_last._sets").cast("int") + F.col("_all") - F.col("_last._turned")) % 2 == 1).alias("_sets"),
        F.when(F.col("_last").isNotNull(), 0).otherwise(F.col("_all") % 2).alias("_turns"),
    ).withColumn("_turned", up_to(["file"], "block"))
    starts = blocks.select("file", "block", before(["file"], "block", F.lit(False)).alias("_start"))
    return per_block.join(starts, ["file", "block"]).withColumn("inside", before(["file", "block"], "row", F.col("_start")))


def _records(spark: SparkSession, paths: Sequence[str], multi_line: bool) -> DataFrame:
    """(file, line, record) of all CSV records that are not empty. Files are cut into blocks like any text.

    Lines of a block that start outside quotes begin a record; those after it that start inside belong to it. A record that
    goes on in the next blocks gets their first lines, one row per block.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", r"\r\z", "").alias("value"),
    )
    if not multi_line:
        return lines.where("value <> ''").select("file", F.struct("block", "row").alias("line"), F.col("value").alias("record"))
    in_block = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.when(~F.col("inside"), F.col("row"))).over(in_block)
    parts = _inside_before(lines).withColumn("begun", begun).groupBy("file", "block", "begun").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]), "\n").alias("record"))
    # Written, so that rows are numbered once and the file is read once.
    parts = written(parts, "csv-records")
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy("file", "block").agg(F.max("begun").alias("last"), F.count_if(F.col("begun").isNull()).alias("heads"))
    owner = F.last(F.when(F.col("last").isNotNull(), F.struct("block", "last")), ignorenulls=True).over(in_file)
    owners = ends.withColumn("owner", owner).where("heads > 0 and owner is not null").select("file", "block", "owner")
    carried = parts.where("begun is null").join(owners, ["file", "block"]).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("block", "record"))).alias("more"))
    carried = carried.select(
        "file", F.col("owner.block").alias("block"), F.col("owner.last").alias("begun"),
        F.array_join(F.transform("more", lambda x: x["record"]), "\n").alias("more"))
    whole = parts.where("begun is not null").join(carried, ["file", "block", "begun"], "left")
    return whole.select(
        "file", F.struct("block", F.col("begun").alias("row")).alias("line"), F.concat_ws("\n", "record", "more").alias("record")
    ).where("record <> ''")


def _text_position(header: Column) -> Column:
    """Position of the first header that names a text column, else 0.

    Where that very name is repeated its last column counts, as a record keyed by name has it.
    """
    names = F.transform(header, lambda h: F.lower(strip(F.coalesce(h, F.lit("")))))
    hits = F.transform(names, lambda name: name.isin(S.UPLOAD_COLUMNS))
    first = F.greatest(F.array_position(hits, True), F.lit(1)).cast("int")
    same = F.array_position(F.reverse(header), F.element_at(header, first))
    return F.when(same > 0, F.size(header) - same).otherwise(first - 1).cast("int")


def read_uploads(spark: SparkSession, *paths: str, multi_line: bool = True) -> DataFrame:
    """S1. (file, line, text) of all texts long enough to keep; each file has its own header.

    Big files are read by many tasks, also where quoted fields hold line breaks; ``multi_line=False`` says that there are
    none, and saves the search for them. Lines end with a line feed, after a carriage return or not. A missing field
    reads as blank and is dropped.
    """
    records = _records(spark, paths, multi_line)
    heads = records.groupBy("file").agg(F.min_by("record", "line").alias("_head"), F.min("line").alias("_head_line"))
    heads = written(heads, "csv-heads")
    # One number: commas inside quotes count too, the columns too many stay NULL.
    width = (heads.agg(F.max(F.regexp_count("_head", F.lit(",")))).first()[0] or 0) + 1
    columns = [f"c{i}" for i in range(width)]

    def fields(record: str) -> Column:
        parsed = F.from_csv(record, ", ".join(f"{c} string" for c in columns), {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
        return F.transform(F.array(parsed), lambda row: F.array(*[row[c] for c in columns]))[0]

    without_mark = F.transform(fields("_head"), lambda h: F.regexp_replace(h, f"^{BYTE_ORDER_MARK}", ""))
    heads = heads.select("file", "_head_line", _text_position(without_mark).alias("_pos"))
    return (
        records.join(heads, "file")
        .where(F.col("line") > F.col("_head_line"))
        .select("file", "line", strip(F.get(fields("record"), F.col("_pos"))).alias("text"))
        .where(long_enough("text"))
    )


def cap_uploads(texts: DataFrame, cap: int = S.UPLOAD_CAP) -> DataFrame:
    """T4. The first ``cap`` texts of each file in file order, with ``position`` from 1."""
    return first_in_group(texts, ["file"], [F.col("line")], cap)


def upload_counts(texts: DataFrame, cap: int = S.UPLOAD_CAP) -> DataFrame:
    """T4. Accepted and skipped per file; only the overflow is skipped, short rows are not in it."""
    n = F.count(F.lit(1))
    return texts.groupBy("file").agg(
        F.least(n, F.lit(cap)).alias("accepted"), F.greatest(n - cap, F.lit(0)).alias("skipped")
    )


def pending_tickets(capped: DataFrame, user_id: Column | str, run_ts: Column, source: str = "csv") -> DataFrame:
    """S7. Ticket rows without a prediction; one time stamp for the whole batch."""
    user = F.lit(user_id) if isinstance(user_id, str) else user_id
    return capped.select(
        row_id("file", "position", user, run_ts).alias("ticket_id"),
        F.col("text"),
        F.lit(source).alias("source"),
        user.alias("user_id"),
        run_ts.alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )
