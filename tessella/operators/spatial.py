"""Spatial joins without an index: equi-joins on cells of a grid or a quadtree, refined by the boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import box as B

LEAST_LEVEL = -40  # of the quadtree: smaller boxes, and points, count as of this size


def _cells(df: DataFrame, box: str, cell: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(f"{box}.{a}") / cell), F.floor(F.col(f"{box}.{b}") / cell))
    return df.withColumn("cell_x", F.explode(span("minx", "maxx"))).withColumn("cell_y", F.explode(span("miny", "maxy")))


def cell_join(
    left: DataFrame,
    right: DataFrame,
    left_box: str,
    right_box: str,
    scope: list[tuple[str, str]] | None = None,
    cell: float | None = 128.0,
    predicate: Callable[[Column, Column], Column] = B.overlaps,
) -> DataFrame:
    """Inner join of rows whose boxes meet, within equal ``scope`` columns; column names must differ.

    Without a ``cell``, a ``quad_join``: for boxes of very different sizes.

    Each box goes to every cell that it touches. A pair is kept only in the cell of the
    lower corner of its common box, so it comes once and no distinct is needed. A cell as
    large as a usual box keeps the copies few; a crowded cell is an ordinary skewed join
    key. Rows with a null box match nothing. Neither side is broadcast: the planner knows
    a side's size from before its rows were multiplied, if at all.
    """
    if cell is None:
        return quad_join(left, right, left_box, right_box, scope, predicate)
    a = _cells(left.where(f"{left_box} is not null"), left_box, cell)
    b = _cells(right.where(f"{right_box} is not null"), right_box, cell).withColumnsRenamed({"cell_x": "other_x", "cell_y": "other_y"})
    x, y = F.col(left_box), F.col(right_box)
    on = (F.col("cell_x") == F.col("other_x")) & (F.col("cell_y") == F.col("other_y"))
    for p, q in scope or []:
        on &= F.col(p) == F.col(q)
    once = (F.floor(F.greatest(x["minx"], y["minx"]) / cell) == F.col("cell_x")) & (F.floor(F.greatest(x["miny"], y["miny"]) / cell) == F.col("cell_y"))
    return a.join(b.hint("merge"), on & once & predicate(x, y)).drop("cell_x", "cell_y", "other_x", "other_y")


def _level(box: Column) -> Column:
    """The level of the quadtree whose cells are as wide as the box's longer side, or up to twice that; negative for small boxes."""
    side = F.greatest(B.width(box), B.height(box)).cast("double")
    level = F.ceil(F.log2(F.greatest(side, F.lit(2.0**LEAST_LEVEL)))).cast("int")
    # the logarithm is rounded: one more where the cell came out too narrow
    return F.when(F.pow(F.lit(2.0), level) < side, level + 1).otherwise(level)


def _keys(box: Column, level: Column, tag: Column) -> Column:
    """The cells of a level that a box touches."""
    size = F.pow(F.lit(2.0), level)
    span = lambda a, b: F.sequence(F.floor(box[a] / size), F.floor(box[b] / size))
    key = lambda x, y: F.struct(tag.alias("tag"), level.alias("level"), x.alias("x"), y.alias("y"))
    return F.flatten(F.transform(span("minx", "maxx"), lambda x: F.transform(span("miny", "maxy"), lambda y: key(x, y))))


def _quad_keys(df: DataFrame, box: str, others: list[int], first: bool) -> DataFrame:
    """``df`` with a row for each key: its own cells, and the ancestors of these at the higher levels among ``others``.

    Of a pair the smaller box goes up to the level of the larger one. Tag 0 joins left boxes of any lower
    or equal level with right boxes at their own, tag 1 the rest; so two ancestors never meet.
    """
    own = F.col("quad_level")
    up = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > own)
    above = F.flatten(F.transform(up, lambda x: _keys(F.col(box), x, F.lit(0 if first else 1))))
    tags = [0, 1] if first and others else [0]
    keys = F.concat(*[_keys(F.col(box), own, F.lit(t)) for t in tags], above)
    return df.where(f"{box} is not null").withColumn("quad_level", _level(F.col(box))).withColumn("quad", F.explode(keys)).drop("quad_level")


def box_levels(df: DataFrame, box: str) -> list[int]:
    """The levels of a table's boxes: one for each power of two between the least and the greatest size."""
    return sorted(r.level for r in df.where(f"{box} is not null").select(_level(F.col(box)).alias("level")).distinct().collect())


def quad_join(
    left: DataFrame,
    right: DataFrame,
    left_box: str,
    right_box: str,
    scope: list[tuple[str, str]] | None = None,
    predicate: Callable[[Column, Column], Column] = B.overlaps,
) -> DataFrame:
    """As ``cell_join`` for boxes of any mixture of sizes: no cell size is chosen.

    Each box has a level of the quadtree by its longer side, and at most four cells there; for the join it also
    goes to the ancestors of these cells at the levels that the other table has above its own, again at most four
    each. A pair meets at the level of the larger box only, in the cell of the lower corner of the common
    box, so it comes once. Keys a box: four for each power of two that the other side's sizes span, whatever
    the areas. The levels of both tables (a few numbers) are counted while the plan is built.
    """
    a = _quad_keys(left, left_box, box_levels(right, right_box), True)
    b = _quad_keys(right, right_box, box_levels(left, left_box), False).withColumnRenamed("quad", "other_quad")
    on = F.lit(True)
    for part in ("tag", "level", "x", "y"):
        on &= F.col(f"quad.{part}") == F.col(f"other_quad.{part}")
    for p, q in scope or []:
        on &= F.col(p) == F.col(q)
    x, y, size = F.col(left_box), F.col(right_box), F.pow(F.lit(2.0), F.col("quad.level"))
    corner = lambda c: F.floor(F.greatest(x[f"min{c}"], y[f"min{c}"]) / size) == F.col(f"quad.{c}")
    return a.join(b.hint("merge"), on & corner("x") & corner("y") & predicate(x, y)).drop("quad", "other_quad")


def self_pairs(df: DataFrame, key: str, box: str, scope: str | None = None, cell: float | None = 128.0, predicate: Callable[[Column, Column], Column] = B.overlaps, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(key, other_key, box, other_box)`` of ordered pairs of different rows that meet; the columns ``carry`` come along in the same way."""
    columns = list(dict.fromkeys([key, box, *([scope] if scope else []), *carry]))
    left = df.select(*columns)
    right = df.select(*[F.col(c).alias(f"other_{c}") for c in columns])
    pairs = cell_join(left, right, box, f"other_{box}", [(scope, f"other_{scope}")] if scope else None, cell, predicate)
    return pairs.where(F.col(key) != F.col(f"other_{key}")).select(*[n for c in dict.fromkeys((key, box, *carry)) for n in (c, f"other_{c}")])


def contained_points(points: DataFrame, boxes: DataFrame, x: str, y: str, box: str, scope: list[tuple[str, str]] | None = None, cell: float = 128.0) -> DataFrame:
    """Inner join of points with the boxes they lie inside of, borders left out."""
    corner = lambda c: F.floor(F.col(c) / cell)
    a = points.withColumn("cell_x", corner(x)).withColumn("cell_y", corner(y))
    b = _cells(boxes, box, cell).withColumnsRenamed({"cell_x": "other_x", "cell_y": "other_y"})
    on = (F.col("cell_x") == F.col("other_x")) & (F.col("cell_y") == F.col("other_y")) & B.contains_point(F.col(box), F.col(x), F.col(y))
    for p, q in scope or []:
        on &= F.col(p) == F.col(q)
    return a.join(b.hint("merge"), on).drop("cell_x", "cell_y", "other_x", "other_y")
