import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.box import box
from tessella.operators import spatial


def boxes(n, seed, least, most, span):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w, h = (2 ** r.uniform(least, most) for _ in "xy")
        x, y = r.uniform(-span, span), r.uniform(-span, span)
        rows.append((i, r.choice("ab"), x, y, x + w, y + h))
    return rows


def frame(spark, rows, name):
    df = spark.createDataFrame(rows, f"{name} long, {name}_scope string, x0 double, y0 double, x1 double, y1 double")
    return df.select(name, f"{name}_scope", F.when(F.col("x0").isNotNull(), box("x0", "y0", "x1", "y1")).alias(f"{name}_box"))


def met(a, b, scoped):
    return sorted((p[0], q[0]) for p in a for q in b if None not in (p[2], q[2]) and (not scoped or p[1] == q[1]) and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5])


@pytest.mark.parametrize("scoped", [False, True])
def test_quad_join_of_one_to_a_million_pixels(spark, scoped):
    a = boxes(150, 1, 0, 20, 2e6) + [(900, "a", 0.0, 0.0, 1024.0, 1024.0), (901, "a", -8.0, -8.0, 8.0, 8.0), (902, "b", None, None, None, None)]
    b = boxes(150, 2, 0, 20, 2e6) + [(900, "a", 1023.0, 1023.0, 1024.5, 1024.5), (901, "a", 0.0, 0.0, 2.0**40 + 1, 5.0), (902, "a", 8.0, 8.0, 9.0, 9.0), (903, "a", None, None, None, None)]
    a += [(1000 + i, *x[1:]) for i, x in enumerate(boxes(150, 3, -3, 3, 8))]
    b += [(1000 + i, *x[1:]) for i, x in enumerate(boxes(150, 4, -3, 3, 8))]
    pairs = spatial.quad_join(frame(spark, a, "p"), frame(spark, b, "q"), "p_box", "q_box", [("p_scope", "q_scope")] if scoped else None)
    assert sorted((r.p, r.q) for r in pairs.select("p", "q").collect()) == met(a, b, scoped)


def test_quad_keys_are_few(spark):
    a = frame(spark, boxes(300, 5, 0, 20, 1e6), "p").where("p_box is not null")
    levels = spatial.box_levels(a, "p_box")
    assert len(levels) <= 21
    own = spatial._quad_keys(a, "p_box", levels, False)
    most = own.groupBy("p", "quad.level").count().agg(F.max("count")).first()[0]
    assert most <= 4
    # a single huge box costs its neighbours four keys each, not one for each of its pixels
    assert spatial._quad_keys(a, "p_box", [40], False).groupBy("p").count().agg(F.max("count")).first()[0] <= 8


def test_quad_join_of_nothing_and_points(spark):
    none = frame(spark, [], "p")
    some = frame(spark, [(1, "a", 0.0, 0.0, 1.0, 1.0), (2, "a", 0.5, 0.5, 0.5, 0.5)], "q")
    assert spatial.quad_join(none, some, "p_box", "q_box").count() == 0
    own = frame(spark, [(7, "a", 0.5, 0.5, 0.5, 0.5)], "p")
    touch = lambda x, y: (x["minx"] <= y["maxx"]) & (y["minx"] <= x["maxx"]) & (x["miny"] <= y["maxy"]) & (y["miny"] <= x["maxy"])
    assert sorted((r.p, r.q) for r in spatial.quad_join(own, some, "p_box", "q_box", predicate=touch).collect()) == [(7, 1), (7, 2)]


def test_self_pairs_without_a_cell_size(spark):
    rows = boxes(120, 8, 0, 12, 4000)
    got = spatial.self_pairs(frame(spark, rows, "p"), "p", "p_box", "p_scope", None)
    assert sorted((r.p, r.other_p) for r in got.collect()) == [(a, b) for a, b in met(rows, rows, True) if a != b]


def test_no_side_of_a_spatial_join_is_broadcast(spark):
    # a small file may stand for many rows once cells, or tiles, are exploded
    a, b = frame(spark, boxes(20, 6, 0, 6, 100), "p"), frame(spark, boxes(20, 7, 0, 6, 100), "q")
    spots = spark.range(5).select(F.col("id").alias("x"), F.col("id").alias("y"))
    joins = [spatial.cell_join(a, b, "p_box", "q_box"), spatial.quad_join(a, b, "p_box", "q_box"), spatial.contained_points(spots, a, "x", "y", "p_box")]
    for j in joins:
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
