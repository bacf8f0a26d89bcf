"""Training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketspark import schemas as S
from ticketspark.functions.ids import seeded_hash
from ticketspark.functions.labels import encode, shift
from ticketspark.operators.distribution import apply_rules
from ticketspark.operators.ranking import rank_cutoff, rank_cutoffs
from ticketspark.operators.taxonomy import issue_rows, product_rows

# --- Grid ----------------------------------------------------------------------------------------


def grid_size() -> int:
    return len(issue_rows()) * len(product_rows()) * len(S.SENTIMENTS) * len(S.COMPLEXITIES)


def grid_cells(df: DataFrame, cell: Column) -> DataFrame:
    """J6, W4. Taxonomy columns for a 0-based cell number of the grid.

    A cell number spells the position in each of the four dimensions, complexity running fastest,
    so four look-ups in fixed tables replace the cross product.
    """
    spark = df.sparkSession
    issues = spark.createDataFrame(
        issue_rows(), "_issue int, issue_area string, issue_category string, issue_sub_category string"
    )
    products = spark.createDataFrame(product_rows(), "_product int, product_category string, product_sub_category string")
    n_products, n_sentiments, n_complexities = len(product_rows()), len(S.SENTIMENTS), len(S.COMPLEXITIES)
    sentiments = F.array(*[F.lit(x) for x in S.SENTIMENTS])
    complexities = F.array(*[F.lit(x) for x in S.COMPLEXITIES])

    def part(divisor: int, modulus: int | None = None) -> Column:
        whole = F.floor(cell / divisor)
        return (whole if modulus is None else whole % modulus).cast("int")

    return (
        df.withColumns({
            "_issue": part(n_products * n_sentiments * n_complexities),
            "_product": part(n_sentiments * n_complexities, n_products),
            "customer_sentiment": F.get(sentiments, part(n_complexities, n_sentiments)),
            "issue_complexity": F.get(complexities, part(1, n_complexities)),
        })
        .join(F.broadcast(issues), "_issue")  # 70 rows
        .join(F.broadcast(products), "_product")  # 18 rows
        .drop("_issue", "_product")
    )


def build_grid(spark: SparkSession, noise_rate: float | None = S.NOISE_RATE, seed: int = S.SEED) -> DataFrame:
    """M1. All 11,340 labelled cells with ids from 1, noise included unless its rate is None."""
    ids = spark.range(1, grid_size() + 1).withColumnRenamed("id", "ticket_id")
    grid = apply_rules(grid_cells(ids, F.col("ticket_id") - 1)).select(*S.GRID_COLUMNS)
    return grid if noise_rate is None else apply_noise(grid, "priority", "ticket_id", noise_rate, seed)


# --- Noise ---------------------------------------------------------------------------------------


def apply_noise(
    df: DataFrame, label: str, key: str, rate: float = S.NOISE_RATE, seed: int = S.SEED
) -> DataFrame:
    """M2. Move exactly ``max(1, round(n * rate))`` labels (all, if fewer) one level up or down.

    The rows with the smallest seeded hash of the unique ``key`` are moved; their number is exact
    and the choice does not depend on partitioning. A move at either end of the scale may leave
    the label as it was.
    """
    chosen = seeded_hash(seed, F.col(key))

    def last(n: Column) -> Column:
        return F.least(n, F.greatest(F.lit(1), F.bround(n * F.lit(float(rate)), 0))).cast("long")

    cutoff = rank_cutoff(df.select(chosen.alias("_hash")), last).agg(F.max("cutoff")).scalar()
    step = F.when(F.substring(seeded_hash(seed, F.lit("step"), F.col(key)), 1, 1) < "8", F.lit(-1)).otherwise(1)
    moved = F.when(chosen <= cutoff, shift(F.col(label), step)).otherwise(F.col(label))
    return df.withColumn(label, moved)


# --- Split ---------------------------------------------------------------------------------------


def _largest_remainder(classes: DataFrame, label: str, size: str, total: Column, draws: Column, into: str) -> DataFrame:
    """Share ``draws`` out in proportion to ``size``; remainders go to the largest, then label order.

    ``classes`` has one row per label.
    """
    whole = Window.partitionBy(F.lit(0))
    by_remainder = whole.orderBy(F.desc("_rest"), encode(F.col(label)), F.col(label))
    exact = F.col(size) / total * draws
    return (
        classes.withColumn("_floor", F.floor(exact).cast("long"))
        .withColumn("_rest", exact - F.col("_floor"))
        .withColumn("_open", draws - F.sum("_floor").over(whole))
        .withColumn(into, F.col("_floor") + (F.row_number().over(by_remainder) <= F.col("_open")).cast("long"))
        .drop("_floor", "_rest", "_open")
    )


def _drawn(size: Column, total: Column, share: float, n_classes: Column, whole: Window) -> Column:
    """Rows to take off, rounded up; fails where a label has a single row or would get none."""
    drawn = F.ceil(total * F.lit(share)).cast("long")
    thin = (F.min(size).over(whole) < 2) | (drawn < n_classes) | (total - drawn < n_classes)
    return F.when(thin, F.raise_error(F.lit("a label has too few rows for three parts")).cast("long")).otherwise(drawn)


def split_quotas(df: DataFrame, label: str, sizes: tuple[float, float, float] = S.SPLIT_SIZES) -> DataFrame:
    """M3. Rows per label for train, val and test; one row per label.

    Test is taken off first, then val as its share of what is left; both totals round up.
    """
    train, val, test = sizes
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"the three parts make {train + val + test} of the rows, not all of them")
    whole = Window.partitionBy(F.lit(0))
    n_classes = F.count(F.lit(1)).over(whole)
    known = df.where(F.col(label).isNotNull())
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumn("_total", F.sum("_n").over(whole))
    test_total = _drawn(F.col("_n"), F.col("_total"), float(test), n_classes, whole)
    first = _largest_remainder(
        counts.withColumn("_train_total", F.col("_total") - test_total),
        label, "_n", F.col("_total"), F.col("_train_total"), "_rest_n",
    )
    second = first.withColumn("_rest_total", F.sum("_rest_n").over(whole))
    val_total = _drawn(F.col("_rest_n"), F.col("_rest_total"), val / (train + val), n_classes, whole)
    third = _largest_remainder(
        second.withColumn("_train_total", F.col("_rest_total") - val_total),
        label, "_rest_n", F.col("_rest_total"), F.col("_train_total"), "train",
    )
    return third.select(
        label, "train", (F.col("_rest_n") - F.col("train")).alias("val"), (F.col("_n") - F.col("_rest_n")).alias("test")
    )


def stratified_split(
    df: DataFrame, label: str, key: str, sizes: tuple[float, float, float] = S.SPLIT_SIZES, seed: int = S.SEED
) -> DataFrame:
    """M3. ``split`` column with exact sizes per label; disjoint and complete by construction.

    Per label, rows in order of a seeded hash of the unique ``key`` fill test, then val, then
    train. Only the two cut-off hashes per label are looked up, so the rows are never shuffled.
    """
    order = seeded_hash(seed, F.col(key))
    # A row without a label belongs to no class and to no part.
    df = df.where(F.col(label).isNotNull())
    quotas = split_quotas(df, label, sizes)
    ranks = quotas.select(
        F.col(label).alias("_class"),
        F.inline(F.array(
            F.struct(F.lit("test").alias("name"), F.col("test").alias("rank")),
            F.struct(F.lit("val").alias("name"), (F.col("test") + F.col("val")).alias("rank")),
        )),
    )
    hashed = df.select(F.col(label).alias("_class"), order.alias("_hash"))
    found = rank_cutoffs(hashed, ranks, "_class")
    cutoffs = found.groupBy("_class").agg(
        F.max(F.when(F.col("name") == "test", F.col("cutoff"))).alias("_test_cut"),
        F.max(F.when(F.col("name") == "val", F.col("cutoff"))).alias("_val_cut"),
    )
    split = (
        F.when(order <= F.col("_test_cut"), "test").when(order <= F.col("_val_cut"), "val").otherwise("train")
    )
    # One row per label.
    return (
        df.join(F.broadcast(cutoffs), F.col(label) == F.col("_class"), "left")
        .withColumn("split", split)
        .drop("_class", "_test_cut", "_val_cut")
    )


def split_sizes(split: DataFrame) -> DataFrame:
    """A13."""
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
