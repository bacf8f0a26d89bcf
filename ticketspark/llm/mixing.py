"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets a weight in proportion to p ** exponent: 1 leaves the shares
as they are, 0 makes them equal. The exponent is bisected: the largest one that reaches the target entropy (a
fraction of that of equal shares), but not so small that a source is repeated more often than ``max_repeats``.
Each job halves the interval six times by looking at 63 points at once; only sums over the sources reach the driver.

A source's quota is its weight's part of the budget. It is realised as permutations of blocks: the rows of a
source lie in blocks by a hash; each epoch has an order of the blocks, and inside a block of its rows,
from a seeded hash; rows are taken in this order, epoch after epoch, while the tokens taken before
are below the quota. So whole epochs take every row once, and the last one a random part. A hot source is as
many blocks as others together; running sums are over blocks, and over the rows of one block.

Defined results: a null source is a source of its own; null texts are empty; rows without tokens are taken with the
tokens around them, and once if their source has no tokens at all; repeated rows are rows of their own; an empty
table gives no rows; a budget of null is the number of tokens there are. Input columns travel in a struct, so no name of theirs
can clash; ``mix_sources`` leaves out those that are named as one of its own four.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketspark.session import written

KEY = ["_mix_none", "_mix_source"]
BLOCK_TOKENS = 1 << 20
POINTS = 64


def token_count(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def curve(shares: DataFrame, low: float, high: float, budget_share: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest number of repeats) at 65 exponents from ``low`` to ``high``."""
    points = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
    sums = []
    for a in points:
        power = F.pow("p", F.lit(a))
        sums += [F.sum(power), F.sum(power * F.log("p")), F.max(power / F.col("p"))]
    row = shares.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
    out = []
    for i, a in enumerate(points):
        z, e, most = row[3 * i:3 * i + 3]
        out.append((a, math.log(z) - a * e / z, budget_share * most / z))
    return out


def bisect(shares: DataFrame, budget_share: float, good, low: float = 0.0, high: float = 1.0, rounds: int = 6) -> tuple[float, float]:
    """Neighbouring exponents between which ``good(entropy, repeats)`` changes; it must change once at most."""
    for _ in range(rounds):
        seen = [(a, good(h, r)) for a, h, r in curve(shares, low, high, budget_share)]
        if all(ok == seen[0][1] for _, ok in seen):
            return (low, low) if low == high else (seen[0][0], seen[-1][0])
        change = next(i for i in range(1, len(seen)) if seen[i][1] != seen[i - 1][1])
        low, high = seen[change - 1][0], seen[change][0]
    return low, high


def exponent_for(shares: DataFrame, budget_share: float, target_entropy: float, max_repeats: float) -> float:
    """``shares`` has p > 0 per source, with sum 1."""
    n = shares.count()
    wanted = target_entropy * math.log(n) if n else 0.0
    ends = curve(shares, 0.0, 1.0, budget_share) if n else []
    if not ends or ends[-1][1] >= wanted:
        flat = 1.0
    else:
        # Entropy falls as the exponent grows: the lower neighbour still reaches the target.
        flat = 0.0 if ends[0][1] < wanted else bisect(shares, budget_share, lambda h, r: h >= wanted)[0]
    if not ends or ends[0][2] <= max_repeats:
        few = 0.0
    else:
        # Repeats fall as well: the upper neighbour is within the limit, if any is.
        few = 1.0 if ends[-1][2] > max_repeats else bisect(shares, budget_share, lambda h, r: r <= max_repeats)[1]
    return max(flat, few)


def mixed_rows(
    docs: DataFrame, target_entropy: float = 0.95, max_repeats: float = 4.0, budget: int | None = None, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The rows of the mix: ``row`` (all columns of ``docs``), epoch, n_tokens, start (tokens of the source before the row,
    all epochs) and place (start as a part of the quota; sorting by it interleaves the sources)."""
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_mix_id"),
        F.col(source_col).isNull().alias("_mix_none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_mix_source"),
        token_count(text_col).alias("_mix_tokens"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_mix_hash"),
    )
    sizes = written(named.select(*KEY, "_mix_tokens", "_mix_hash"), "mix-sizes")
    total = sizes.agg(F.sum("_mix_tokens")).first()[0] or 0
    budget = total if budget is None else budget
    blocks = max(1, -(-total // block_tokens))
    block = F.pmod(F.col("_mix_hash"), F.lit(blocks))

    cells = sizes.groupBy(*KEY, block.alias("_mix_block")).agg(F.sum("_mix_tokens").alias("in_block"))
    sources = written(cells.groupBy(*KEY).agg(F.sum("in_block").alias("of_source")), "mix-sources")
    shares = sources.filter("of_source > 0").withColumn("p", F.col("of_source") / F.lit(float(max(total, 1))))
    exponent = exponent_for(shares, budget / max(total, 1), target_entropy, max_repeats)
    power = F.pow("p", F.lit(exponent))
    norm = shares.agg(F.sum(power)).first()[0] or 1.0
    quotas = shares.select(*KEY, "of_source", F.floor(power / norm * budget).cast("long").alias("quota"))
    # Rows of sources without any token cost nothing and are taken once.
    quotas = quotas.unionByName(sources.filter("of_source = 0").select(*KEY, F.lit(1).cast("long").alias("of_source"), F.lit(1).cast("long").alias("quota")))

    epochs = F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("of_source")).cast("int"))).alias("_mix_epoch")
    order = W.partitionBy(*KEY, "_mix_epoch").orderBy(F.xxhash64(F.lit(seed), "_mix_epoch", "_mix_block"), "_mix_block")
    before = F.coalesce(F.sum("in_block").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = (
        cells.join(quotas.filter("quota > 0"), KEY).select(*KEY, "_mix_block", "in_block", "of_source", "quota", epochs)
        .withColumn("block_start", before + F.col("_mix_epoch") * F.col("of_source")).filter("block_start < quota")
    )
    inside = W.partitionBy(*KEY, "_mix_block", "_mix_epoch").orderBy(F.xxhash64("_mix_epoch", "_mix_hash"), "_mix_hash", "_mix_id")
    start = F.col("block_start") + F.coalesce(F.sum("_mix_tokens").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        named.withColumn("_mix_block", block).join(plan, [*KEY, "_mix_block"]).withColumn("_mix_start", start).filter("_mix_start < quota")
        .select("row", F.col("_mix_epoch").alias("epoch"), F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_start").alias("start"),
                (F.col("_mix_start") / F.col("quota")).alias("place"))
    )


def mix_sources(docs: DataFrame, *bounds, **options) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, epoch, n_tokens, start and place."""
    rows = mixed_rows(docs, *bounds, **options)
    own = ["epoch", "n_tokens", "start", "place"]
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in own], *own)


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, whatever their names."""
    return mixed_rows(docs, **options).select("row.*")
