"""Merkle manifest of a dataset with inclusion proofs, by nested-interval labels.

A leaf is the digest of a row. Leaves of a source are ranked by id; every node of the source's tree carries the interval
[lo, hi) of leaf ranks that it covers, and three consecutive nodes of a level make one of the next. Subroots form the
tree above in the same way, ranked by source.

Nodes are kept in blocks: a block holds four levels of nodes above 81 consecutive ones, so its interval is a multiple of
81, 81^2, … ranks long. Built upward, each tier of blocks gathers the 81 tops below it, never more. Then ancestors are
attached downward: a block, and at last a leaf, joins the block whose interval contains it, by the interval's bucket on
that tier. Of the block's nodes the parent on each level is the one that contains the rank, and its siblings are the
nodes within the parent's interval less those that contain the rank: those that end before it stand left in the proof,
those that begin after it stand right. Each row takes part in one join, whatever the depth of the tree.

A source of any size is ranked in ranges of the whole order (source, id, leaf), and blocks are keyed by source and
bucket, so no task meets more than a range or a block of a hot source.

Defined results: a null id or source sorts first; equal ids are ordered by leaf digest, and rows repeated as a whole take
adjacent ranks; a null text, id, source, lang or n_chars enters the leaf as ``-``; an empty text as ``0:``; an empty table
gives an empty result; a single row is its own root with the proof of no siblings; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ticketspark.operators.ranking import in_ranges
from ticketspark.session import written

FAN = 3
#: Levels of one block.
HEIGHT = 4
#: Columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the inputs one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return hashed(*[field(F.col(name)) for name in FIELDS if name != "text"], field(text))


def ranked_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with grp and rank, groups with source, grp and n): grp numbers the sources from 0 in their order, rank the
    leaves of one."""
    rows = in_ranges(leaves, [F.col("source"), F.col("doc_id"), F.col("leaf")])
    # At most one row per range and source that begins in it.
    counts = written(rows.groupBy("source", "_part").agg(F.count("*").alias("rows")), "merkle-counts")
    groups = counts.groupBy("source").agg(F.min("_part").alias("_part"), F.sum("rows").alias("n"))
    in_order = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    begun = groups.groupBy("_part").agg(F.count("*").alias("begun"))
    begun = begun.select("_part", F.coalesce(F.sum("begun").over(in_order), F.lit(0)).alias("sources_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy("source"))
    groups = written(groups.join(begun, "_part").select(
        "source", "n", (F.col("sources_before") + place - 1).alias("grp")), "merkle-groups")
    parts_before = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.withColumn("shift", F.coalesce(F.sum("rows").over(parts_before), F.lit(0))).alias("c").join(
        groups.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
    shifts = shifts.select(F.col("c.source").alias("of"), F.col("_part").alias("of_part"), "shift", "grp", "n")
    inside = F.row_number().over(W.partitionBy("source", "_part").orderBy("doc_id", "leaf"))
    numbered = rows.withColumn("inside", inside).join(
        shifts, F.col("source").eqNullSafe(F.col("of")) & (F.col("_part") == F.col("of_part")))
    return numbered.select(*leaves.columns, "grp", "n", (F.col("shift") + F.col("inside") - 1).alias("rank")), groups


def depth(n: Column) -> Column:
    """Levels above ``n`` leaves: the smallest d with 3^d >= n."""
    powers = F.array(*[F.lit(FAN ** d).cast("long") for d in range(40)])
    return F.size(F.filter(powers, lambda power: power < n))


def _next_level(below: Column, height: Column, level: int) -> Column:
    """The nodes above ``below``, or none beyond the block's height."""
    count = F.ceil(F.size(below) / FAN).cast("int")

    def node(j: Column) -> Column:
        run = F.slice(below, j * FAN + 1, F.lit(FAN))
        return F.struct(
            F.get(run, F.lit(0))["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"),
            F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"))

    return F.when(height >= level, F.transform(F.sequence(F.lit(0), count - 1), node))


def blocks_above(tops: DataFrame, tier: int) -> DataFrame:
    """One block per 81 nodes of ``tops`` (grp, n, place, lo, hi, digest), place being the rank among the nodes of
    its tier: grp, n, place, lo, hi, ``levels`` (array of arrays of nodes) and the top's digest."""
    gathered = tops.groupBy("grp", F.expr(f"place div {FAN ** HEIGHT}").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("l0"))
    blocks = gathered.withColumn("height", F.least(F.lit(HEIGHT), depth(F.col("n")) - HEIGHT * tier))
    for level in range(1, HEIGHT + 1):
        blocks = blocks.withColumn(f"l{level}", _next_level(F.col(f"l{level - 1}"), F.col("height"), level))
    levels = F.filter(F.array(*[F.col(f"l{i}") for i in range(HEIGHT + 1)]), lambda x: x.isNotNull())
    top = F.get(F.element_at(levels, -1), F.lit(0))
    return blocks.select(
        "grp", "n", F.col("block").alias("place"), F.get("l0", F.lit(0))["lo"].alias("lo"),
        F.element_at("l0", -1)["hi"].alias("hi"), levels.alias("levels"), top["digest"].alias("digest"))


def siblings(levels: Column, rank: Column) -> Column:
    """Per level of a block, the digests left and right of the node that contains ``rank`` inside its parent."""

    def inside(parent: Column, nodes: Column) -> Column:
        def digests(keep) -> Column:
            near = F.filter(nodes, lambda x: (x["lo"] >= parent["lo"]) & (x["hi"] <= parent["hi"]) & keep(x))
            return F.array_join(F.transform(near, lambda x: x["digest"]), "")

        return F.struct(
            digests(lambda x: x["hi"] <= rank).alias("left"), digests(lambda x: x["lo"] > rank).alias("right"))

    def at(level: Column) -> Column:
        parent = F.filter(F.get(levels, level + 1), lambda x: (x["lo"] <= rank) & (rank < x["hi"]))
        return F.get(F.transform(parent, lambda p: inside(p, F.get(levels, level))), F.lit(0))

    heights = F.when(F.size(levels) > 1, F.sequence(F.lit(0), F.size(levels) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(heights, at)


PATH = "array<struct<left: string, right: string>>"


class Tree:
    """Blocks of the trees over ``leaves`` (grp, n, rank, digest), one tree per grp, built upward."""

    def __init__(self, leaves: DataFrame, name: str):
        self.tiers: list[DataFrame] = []
        tops = leaves.select(
            "grp", "n", F.col("rank").alias("place"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
        largest = leaves.agg(F.max(depth(F.col("n")))).first()[0]
        while largest is not None:
            tier = len(self.tiers)
            blocks = written(blocks_above(tops, tier), f"{name}-{tier}")
            self.tiers.append(blocks)
            if HEIGHT * (tier + 1) >= largest:
                break
            tops = blocks.filter(depth(F.col("n")) > HEIGHT * (tier + 1)).select("grp", "n", "place", "lo", "hi", "digest")

    def roots(self) -> DataFrame:
        """(grp, digest) of each tree."""
        ends = [
            blocks.filter((depth(F.col("n")) <= HEIGHT * (tier + 1)) & (depth(F.col("n")) >= HEIGHT * tier + (tier > 0)))
            .select("grp", "digest") for tier, blocks in enumerate(self.tiers)
        ]
        out = ends[0]
        for more in ends[1:]:
            out = out.unionByName(more)
        return out

    def labelled(self, above: DataFrame) -> DataFrame:
        """The lowest blocks with ``above``, the path from their tops to the very root. ``above`` has grp, the path from
        the tree's root on in ``path``, and further columns to hand down."""
        kept = [c for c in above.columns if c not in ("grp", "path")]
        known = None
        for tier in reversed(range(len(self.tiers))):
            blocks = self.tiers[tier]
            highest = depth(F.col("n")) <= HEIGHT * (tier + 1)
            # The group's path meets its topmost block only, one row per group.
            ends = blocks.filter(highest).join(above, "grp").withColumnRenamed("path", "above")
            if known is not None:
                lower = attached(blocks.filter(~highest), known, tier + 1, "lo", kept).withColumnRenamed("path", "above")
                ends = ends.unionByName(lower.select(*ends.columns))
            known = ends
        return known


def attached(rows: DataFrame, blocks: DataFrame, tier: int, rank: str, kept: list[str]) -> DataFrame:
    """``rows`` with ``path``, their siblings from the block of ``tier`` that contains them up to the very root."""
    length = FAN ** (HEIGHT * (tier + 1))
    holders = blocks.select(
        F.col("grp").alias("of_grp"), F.col("place").alias("of_bucket"), F.col("lo").alias("of_lo"), F.col("hi").alias("of_hi"),
        F.col("levels").alias("of_levels"), "above", *kept)
    bucket = F.expr(f"{rank} div {length}")
    contained = (
        (F.col("grp") == F.col("of_grp")) & (bucket == F.col("of_bucket"))
        & (F.col("of_lo") <= F.col(rank)) & (F.col(rank) < F.col("of_hi")))
    path = F.concat(siblings(F.col("of_levels"), F.col(rank)), F.col("above"))
    return rows.join(holders, contained).withColumn("path", path).drop("of_grp", "of_bucket", "of_lo", "of_hi", "of_levels", "above")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda node, run: hashed(run["left"], node, run["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, subroot, root, and ``path``, its siblings from its own run up to
    the root; ``tampered`` is the leaf after the change described in ``verified_manifest``."""
    text = F.col("text").cast("string")
    changed = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & (F.instr(text, "\n") > 0)
    leaves = written(docs.select(
        "doc_id", "source", leaf_of(text).alias("leaf"),
        F.when(changed, leaf_of(F.replace(text, F.lit("\n")))).alias("tampered")), "merkle-leaves")
    numbered, groups = ranked_leaves(leaves)
    numbered = written(numbered, "merkle-ranks")
    tree = Tree(numbered.select("grp", "n", "rank", F.col("leaf").alias("digest")), "merkle-blocks")
    if not tree.tiers:
        return leaves.select("doc_id", "source", "leaf", "tampered", *[F.lit("").alias(c) for c in ("subroot", "root")],
                             F.array().cast(PATH).alias("path"))
    subroots = written(tree.roots(), "merkle-subroots")
    n_groups = groups.count()
    above = subroots.select(
        F.lit(0).cast("long").alias("grp"), F.lit(n_groups).cast("long").alias("n"), F.col("grp").alias("rank"), "digest")
    top = Tree(above, "merkle-sources")
    root = top.roots().select(F.col("digest").alias("root"), F.lit(0).cast("long").alias("grp"))
    start = root.withColumn("path", F.array().cast(PATH))
    sources = attached(above.withColumnRenamed("digest", "subroot"), top.labelled(start), 0, "rank", ["root"])
    sources = written(sources.select(F.col("rank").alias("grp"), "subroot", "root", "path"), "merkle-paths")
    blocks = tree.labelled(sources)
    rows = attached(numbered, blocks, 0, "rank", ["subroot", "root"])
    return rows.select("doc_id", "source", "leaf", "tampered", "subroot", "root", "path")


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest with its proofs checked against a copy in which rows whose id has an even crc32 lost the line feeds of
    their texts: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = manifest(docs)
    proof = F.sha2(F.array_join(F.transform("path", lambda run: F.concat(run["left"], run["right"])), ""), 256)
    root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    checked = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), root.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
