"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix; DataFrame operations only.

1. Each input partition permutes its rows (a sort by a seeded hash inside the partition, no exchange) and the rows are
   written with their partition and their place in it.
2. The communication matrix says how many rows of partition p go to shard s. For a uniform permutation of all rows it is
   multivariate hypergeometric given the partitions' sizes and the shards' exact sizes. It is drawn from the top: the
   list of partitions is halved, each shard's room is split between the halves by hypergeometric draws, and so on down
   to single partitions. Each draw inverts the distribution around its mode, in double precision.
3. Partition p deals its permuted rows to the shards in runs, as long as its row of the matrix says; the rows move.
4. Each shard permutes what arrived: rows fall into buckets by a second hash, are ordered in a bucket by a third, and
   buckets follow each other, so no task holds a whole shard.

Only sizes of partitions are ever gathered in one row (one number per input partition, never per document). The law is
``rows``: counts of shards are at most one apart, larger ones first. Rows of equal texts are dealt independently.

Defined results: a null text has no bytes (size 1, checksum 0); a null or repeated id is a row like any other; an empty
table gives an empty result; further columns are kept inside ``document``, whatever their names. The shuffle depends on
the seed and on how the input is cut into partitions, on nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ticketspark.session import partitions, scratch_path, written

SHARDS = 16
#: Expected rows of a bucket in the second permutation.
BUCKET_ROWS = 250_000
#: Nodes of the drawing tree that one task works on before they are dealt out.
NODES_A_TASK = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that follows from ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0 ** -53)


def _steps(first: Column, last: Column, by: int) -> Column:
    """first, first + by, … last; nothing if last lies before first."""
    left = (last >= first) if by > 0 else (last <= first)
    return F.when(left, F.sequence(first, last, F.lit(by).cast("long"))).otherwise(F.array().cast("array<long>"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` rows are among the ``marked`` ones, by inverting the distribution at ``u``.

    Weights relative to the mode follow from ratios of neighbours, out to 9 standard deviations and 32 rows, beyond
    which lies less than 53 bits of ``u`` can tell. Exact for fewer than 2^53 rows.
    """

    def inverted(g: Column) -> Column:
        t, k, n = g["t"], g["k"], g["n"]
        low, high = F.greatest(F.lit(0.0), n - (t - k)), F.least(n, k)
        mode = F.least(high, F.greatest(low, F.floor((n + 1) * (k + 1) / (t + 2)).cast("double")))
        share = k / F.greatest(t, F.lit(1.0))
        reach = F.ceil(F.sqrt(n * share * (1 - share)) * 9).cast("double") + 32
        bounds = F.struct(
            mode.alias("mode"), F.least(high, mode + reach).cast("long").alias("high"),
            F.greatest(low, mode - reach).cast("long").alias("low"),
        )

        def walk(b: Column) -> Column:
            up, down = _steps(b["mode"].cast("long") + 1, b["high"], 1), _steps(b["mode"].cast("long") - 1, b["low"], -1)

            def above(x: Column) -> Column:
                return (k - x + 1) * (n - x + 1) / (x * (t - k - n + x))

            def below(x: Column) -> Column:
                return (x + 1) * (t - k - n + x + 1) / ((k - x) * (n - x))

            def mass(xs: Column, ratio) -> Column:
                """Weight of all ``xs`` relative to the mode's."""
                start = F.struct(F.lit(1.0).alias("w"), F.lit(-1.0).alias("s"))
                return F.aggregate(
                    xs, start, lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["s"] + a["w"]).alias("s")),
                    lambda a: a["s"] + a["w"])

            def search(xs: Column, ratio, target: Column) -> Column:
                """The last value before which no more mass than ``target`` lies, from the mode on."""
                start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), b["mode"].cast("long").alias("x"))
                return F.aggregate(xs, start, lambda a, x: F.struct(
                    (a["w"] * ratio(x)).alias("w"), (a["s"] + a["w"]).alias("s"),
                    F.when(a["s"] + a["w"] <= target, x).otherwise(a["x"]).alias("x")), lambda a: a["x"])

            def found(m: Column) -> Column:
                target = u * (1 + m["up"] + m["down"])
                return F.when(target < 1 + m["up"], search(up, above, target)).otherwise(search(down, below, target - m["up"]))

            return _let(F.struct(mass(up, above).alias("up"), mass(down, below).alias("down")), found)

        return _let(bounds, walk)

    given = F.struct(total.cast("double").alias("t"), marked.cast("double").alias("k"), drawn.cast("double").alias("n"))
    return _let(given, inverted)


def dealt(room: Column, drawn: Column, draw: Callable[[Column], Column]) -> Column:
    """How many of ``drawn`` rows go to each shard, ``room`` being what the shards still take; ``draw`` gives the uniform
    number of the i-th shard."""
    total = F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(drawn.alias("n"), total.alias("t"), F.array().cast("array<long>").alias("to"))

    def step(a: Column, i: Column) -> Column:
        here = F.get(room, i)
        return _let(hypergeometric(a["t"], here, a["n"], draw(i)), lambda x: F.struct(
            (a["n"] - x).alias("n"), (a["t"] - here).alias("t"), F.concat(a["to"], F.array(x)).alias("to")))

    return F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), start, step, lambda a: a["to"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """``part`` and ``to``, the rows it sends to each shard, for ``sizes`` of (part, n). Rows add up to n, columns to the
    shards' sizes."""
    parts = F.sort_array(F.collect_list(F.struct("part", "n")))
    root = sizes.agg(parts.alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("n_parts"))
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (
        F.expr(f"total div {shards}") + F.when(s < F.col("total") % shards, 1).otherwise(0)).cast("long"))
    nodes = root.select(F.struct("parts", room.alias("room")).alias("node"), "n_parts").filter("n_parts > 0")
    many = root.first()["n_parts"]
    node, level = F.col("node"), 0

    def split(node: Column, level: int) -> Column:
        half = F.expr("cast(size(node.parts) div 2 as int)")
        left = F.slice(node["parts"], F.lit(1), half)
        right = F.slice(node["parts"], half + 1, F.size(node["parts"]) - half)
        rows = F.aggregate(left, F.lit(0).cast("long"), lambda a, p: a + p["n"])

        def draw(i: Column) -> Column:
            return uniform(F.lit(seed), F.lit(level), F.get(node["parts"], F.lit(0))["part"], i)

        both = _let(dealt(node["room"], rows, draw), lambda to: F.array(
            F.struct(left.alias("parts"), to.alias("room")),
            F.struct(right.alias("parts"), F.zip_with(node["room"], to, lambda a, b: a - b).alias("room"))))
        return F.when(F.size(node["parts"]) > 1, both).otherwise(F.array(node))

    while 2 ** level < many:
        nodes = nodes.select(F.explode(split(node, level)).alias("node"))
        level += 1
        if 2 ** level == NODES_A_TASK and 2 ** level < many:
            nodes = nodes.repartition(partitions(sizes.sparkSession), F.get(node["parts"], F.lit(0))["part"])
    return nodes.select(F.get(node["parts"], F.lit(0))["part"].alias("part"), node["room"].alias("to"))


def shuffle_shards(rows: DataFrame, shards: int = SHARDS, seed: int = 11, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row of ``rows`` in ``document``, its ``shard`` from 0 and its ``slot`` there, gapless from 0."""
    spark = rows.sparkSession
    draw = F.xxhash64(F.lit(seed), F.lit("local"), F.monotonically_increasing_id())
    permuted = rows.select(F.struct(F.col("*")).alias("document"), draw.alias("draw")).sortWithinPartitions("draw")
    # The id's upper bits are the partition, its lower 33 the place after the sort.
    local = written(permuted.select("document", F.monotonically_increasing_id().alias("id")), "permuted")
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    sizes = local.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    matrix = written(communication_matrix(sizes, shards, seed), "matrix")
    n_rows = local.count()
    buckets = max(-(-partitions(spark) // shards), -(-n_rows // (shards * bucket_rows)), 1)

    ends = F.aggregate(F.col("to"), F.array().cast("array<long>"), lambda a, n: F.concat(
        a, F.array(n + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))
    # One row per input partition.
    sent = local.withColumn("part", part).join(matrix.select("part", ends.alias("ends")), "part").select(
        "document", F.xxhash64(F.lit(seed), F.lit("shard"), "id").alias("draw"), "id",
        F.size(F.filter("ends", lambda end: end <= place)).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "id"), F.lit(buckets)).alias("bucket"),
    )
    so_far = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("draw", "id"))
    return sent.join(before, ["shard", "bucket"]).select("document", "shard", (F.col("before") + inside - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS, seed: int = 11) -> str:
    """Whole rows as Parquet, one folder per shard; files hold runs of ``slot``. Returns the folder."""
    path = path or scratch_path(docs.sparkSession, "shards")
    shuffle_shards(docs, shards, seed).write.partitionBy("shard").parquet(path)
    return path


def shard_of_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """doc_id, size (bytes of the text and 1), text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_shards(rows, shards, seed).select(
        "document.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
