"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every row belongs to one of ``8 ** rounds`` leaf nodes by a hash of its own. A leaf's run is its rows
aggregated by digest: the best row and the number of rows. In each round a node exchanges runs with
the seven others that differ from it in one octal digit: a run goes to the node whose digit is that of
its digest, and runs that meet are merged, which keeps the smallest identifier of each digest. After
the last round each node holds a complete, disjoint part of the digests. No node ever receives more
than eight runs with one digest, however many copies a text has, and the answers return to the rows by
(leaf, digest), so a hot text is spread over all leaves on the way back too.

Equal means equal normalised text: digests are SHA-256, and each merge also compares the number of
code points. Defined results: a null text is empty; an empty table gives an empty result; a null id
loses against any other; of rows that repeat id and text exactly one stays; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ticketspark.session import written

BLANKS = " \t\n\x0b\f\r"
DIGIT = 3


def rounds_for(docs: DataFrame) -> int:
    """Rounds that give at least as many nodes as a shuffle has partitions."""
    partitions, rounds = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    while 8 ** rounds < partitions:
        rounds += 1
    return rounds


def bare_text(text_col: str) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANKS, "")


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bare = bare_text(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(bare, 256)).alias("digest"),
        F.length(bare).alias("bare_length"),
        F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("length"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def merge_round(runs: DataFrame, place: int) -> DataFrame:
    """Send each run to the node that has the digest's digit at ``place``, and merge those that meet."""
    shift = DIGIT * place
    digit = F.shiftright(F.xxhash64("digest"), shift).bitwiseAND(7)
    node = F.col("node") - F.shiftleft(F.shiftright("node", shift).bitwiseAND(7), shift) + F.shiftleft(digit, shift)
    return (
        runs.withColumn("node", node).groupBy("node", "digest", "bare_length")
        .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and length (code points).

    Of equal texts the longest original stays, then the smallest id.
    """
    rounds = rounds or rounds_for(docs)
    rows = written(digest_rows(docs, id_col, text_col), "digests")
    leaf = F.pmod(F.xxhash64("row_id"), F.lit(8 ** rounds))
    best = F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    rows = rows.withColumn("leaf", leaf)
    leaves = rows.groupBy("leaf", "digest", "bare_length").agg(F.min(best).alias("best"), F.count("*").alias("size"))
    runs = leaves.withColumnRenamed("leaf", "node")
    for place in range(rounds):
        runs = merge_round(runs, place)
    winners = runs.select("digest", "bare_length", F.col("best").alias("winner"), F.col("size").alias("group_size"))
    answers = leaves.select("leaf", "digest", "bare_length").join(winners, ["digest", "bare_length"])
    return rows.join(answers, ["leaf", "digest", "bare_length"]).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("winner.row_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "length",
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Rows travel in a struct and move once, by id and digest, which the rank inside these needs too.
    """

    def key(doc_id: Column, digest: Column) -> Column:
        """One value that is never null."""
        return F.sha2(F.concat_ws("/", F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")), digest), 256)

    groups = exact_groups(docs, id_col, text_col, rounds).filter("kept")
    stay = groups.select(key(F.col("doc_id"), F.col("text_sha256")).alias("stay"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.length(text).alias("length"),
        key(F.col(id_col), F.sha2(bare_text(text_col), 256)).alias("stay"))
    # Of rows that repeat id and text one stays.
    copy = F.row_number().over(W.partitionBy("stay").orderBy(F.desc("length")))
    return rows.join(stay, "stay", "left_semi").withColumn("copy", copy).filter("copy = 1").select("row.*")
