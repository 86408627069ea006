"""Category trees: building them from ranked names, and merging two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.grid import dense_index

RANKS = ("family", "genus", "species")


def built(rows: DataFrame, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """``(id, name, rank, supercategory)`` from one column for each rank.

    The first rank's names come first, in order; each further rank by its parent's id and then
    its own name, ids going on. A name under several parents stays with the least of them.
    Null names have no row and end the line; category lists are small.
    """
    out, above, start = [], None, F.lit(0).cast("long")
    level = None
    for i, rank in enumerate(ranks):
        if i == 0:
            own = rows.where(F.col(rank).isNotNull()).select(F.col(rank).alias("name")).distinct().withColumn("parent", F.lit(None).cast("long"))
        else:
            parents = level.select(F.col("name").alias("parent_name"), F.col("id").alias("parent"))
            pairs = rows.where(F.col(rank).isNotNull() & F.col(ranks[i - 1]).isNotNull()).select(F.col(ranks[i - 1]).alias("parent_name"), F.col(rank).alias("name")).distinct()
            own = pairs.join(parents, "parent_name").groupBy("name").agg(F.min("parent").alias("parent"))
        # a small window for each parent; only the counts of parents are summed in order
        numbered = dense_index(own.withColumn("parent_", F.coalesce("parent", F.lit(0).cast("long"))), "parent_", "name", name="place", start=1).drop("parent_")
        if above is not None:
            numbered = numbered.crossJoin(F.broadcast(above))
            start = F.col("n_above")
        level = numbered.select((start + F.col("place")).cast("long").alias("id"), "name", F.lit(rank).alias("rank"), F.col("parent").alias("supercategory"))
        count = level.agg(F.count(F.lit(1)).alias("n_level"))
        above = count.select(F.col("n_level").alias("n_above")) if above is None else above.crossJoin(count).select((F.col("n_above") + F.col("n_level")).alias("n_above"))
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def merged(base: DataFrame, other: DataFrame, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """Two category tables as one: names that ``base`` has keep their ids; new ones get ids from its
    largest on, rank by rank and by their old id, with their parents' new ids. Rows without a rank are skipped."""
    base = base.where("rank is not null").select("id", "name", F.lower("rank").alias("rank"), "supercategory")
    other = other.where("rank is not null").select("id", "name", F.lower("rank").alias("rank"), "supercategory").where(F.col("rank").isin(*ranks))
    order = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("rank"))
    known = base.select(F.col("name").alias("known_name"), F.col("id").alias("known_id"))
    placed = other.join(known, F.col("name") == F.col("known_name"), "left")
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = dense_index(placed.where("known_id is null").withColumn("order_", order), "order_", "id", name="place", start=1).crossJoin(F.broadcast(top))
    fresh = fresh.select("id", "name", "rank", "supercategory", (F.col("top") + F.col("place")).cast("long").alias("new_id"))
    ids = fresh.select(F.col("id").alias("old"), "new_id").unionByName(placed.where("known_id is not null").select(F.col("id").alias("old"), F.col("known_id").alias("new_id")))
    parents = ids.select(F.col("old").alias("old_parent"), F.col("new_id").alias("parent"))
    new = fresh.join(parents, F.col("supercategory") == F.col("old_parent"), "left").select(F.col("new_id").alias("id"), "name", "rank", F.col("parent").alias("supercategory"))
    return base.unionByName(new)
