"""Small tables on which results once differed from the SQL, or work grew with the pairs."""

import os

import duckdb
import pandas as pd
import pytest
from test_queries import rows

from stackwright.plans import registry

BASE = "/root/testdata/sf0.001"


def both(spark, name, folder, **tables):
    """A query's rows by Spark and by its SQL over small tables written to ``folder``."""
    con = duckdb.connect()
    for k, frame in tables.items():
        frame.to_parquet(os.path.join(folder, f"{k}.parquet"), index=False)
        con.execute(f"create view {k} as select * from '{folder}/{k}.parquet'")
    return rows(registry.queries()[name](spark, str(folder)).toPandas()), rows(con.sql(registry.oracle_sql()[name]).df())


def test_blends_on_a_half_round_as_the_sql_does(spark, tmp_path):
    customers = pd.DataFrame({"c_custkey": [1, 2], "c_acctbal": [10.0, 5.0]})
    orders = pd.DataFrame({"o_orderkey": [1], "o_custkey": [1], "o_totalprice": [920.0], "o_orderpriority": ["1"]})
    got, want = both(spark, "blended_rerank", tmp_path, customer=customers, orders=orders)
    assert got == want


def test_linkage_scores_copies_of_a_record_once(spark):
    from stackwright.operators import linkage

    made = [(i, ["The Red Door", "The Red Doors", "Blue Hat"][i % 3], "Ann Miller", i % 4) for i in range(180)]
    rows_of = spark.createDataFrame(made, "id long, title string, author string, editions int")
    left = linkage.described(rows_of.select("id", "title", "author"), "id", "title", "author")
    right = linkage.described(rows_of.withColumnRenamed("id", "work"), "work", "title", "author", "editions")
    x, y = linkage._people(left), linkage._people(right)
    titles, asked = linkage.scored_titles(x, y, linkage._places(y, "work"))
    assert asked.count() == 3 and titles.count() == 5
    got = {r.id: (r.work, r.method, r.score) for r in linkage.match_title_author(left, right, "id", "work").collect()}
    want = [max((w[3], w[0]) for w in made if w[1] == title)[1] for title in ("The Red Door", "The Red Doors", "Blue Hat")]
    assert got == {i: (want[i % 3], "title_author", 100.0) for i in range(180)}


def test_linkage_of_other_titles_takes_the_smallest_of_equal_keys_and_leaves_null_titles(spark):
    from stackwright.operators import linkage

    left = linkage.described(spark.createDataFrame([(1, "Crimson Harbour Lights", "Ann Miller"), (2, None, "Ann Miller"), (3, "Crimson Harbour Lights", None)], "id long, title string, author string"), "id", "title", "author")
    books = [(5, "Crimson Harbour Light", "Miller, Ann", None), (7, "Crimson Harbour Light", "Ann Miller", 2), (6, "Crimson Harbour Light", "A Miller", 2), (9, None, "Ann Miller", 9), (8, "Crimson Harbour Light", "Otto Ito", 9)]
    right = linkage.described(spark.createDataFrame(books, "work long, title string, author string, editions int"), "work", "title", "author", "editions")
    got = {r.id: (r.work, r.method) for r in linkage.match_title_author(left, right, "id", "work").collect()}
    assert got == {1: (6, "title_author"), 2: (None, "unmatched"), 3: (None, "unmatched")}


def test_blocked_linkage_links_rows_of_one_kind_once(spark, tmp_path):
    n = 60_000  # 30,000 rows asked and 30,000 answers of one key: 900 million pairs of rows
    parts = pd.DataFrame({"p_partkey": range(n), "p_name": "hot bolt", "p_brand": [f"Brand#{1 + i % 2}" for i in range(n)], "p_size": [5 if i % 2 or i < n // 2 else 50 for i in range(n)]})
    parts.to_parquet(tmp_path / "part.parquet", index=False)
    got = registry.queries()["blocked_linkage"](spark, str(tmp_path)).groupBy("work", "score", "decision").count().collect()
    # Brand 2 asks (side 0): all of size 5.  Brand 1 answers: the even rows, of size 5 up to the middle, else 50.
    assert {tuple(r) for r in got} == {(0, 100, "ambiguous", n // 2)}


def _equal_boxes(spark, n):
    from pyspark.sql import functions as F

    at = {"x0": 0.0, "y0": 0.0, "x1": 50.0, "y1": 40.0, "w": 50.0, "h": 40.0, "cx": 25.0, "cy": 20.0, "angle": 0.0}
    moved = F.when(F.col("id") == 0, 30.0).otherwise(0.0)
    return spark.range(n).withColumns({c: F.lit(v) + (moved if c in ("x0", "x1", "cx") else 0.0) for c, v in at.items()}).withColumn("scene", F.lit(1))


def test_equal_boxes_are_grouped_without_their_pairs(spark):
    from stackwright.operators import spatial

    n = 60_000
    got = spatial.overlap_groups(_equal_boxes(spark, n), "scene", 0.1, 100.0).collect()
    assert [tuple(r) for r in got] == [(1, n, 1.0, n * (n - 1) // 2)]
    none = spatial.overlap_groups(_equal_boxes(spark, n).filter("id < 2"), "scene", 0.5, 100.0).collect()
    assert [tuple(r) for r in none] == [(1, 2, 0.0, 0)]


def test_nearest_of_equal_boxes_without_their_pairs(spark):
    from stackwright.operators import spatial

    n = 60_000
    boxes = _equal_boxes(spark, n).withColumnRenamed("id", "box_id")
    points = spark.range(n).selectExpr("id as point_id", "1 as scene", "case when id = 7 then 55d + 24 else 20d end as x", "20d as y")
    got = spatial.nearest(points, boxes, "scene", 5.0).groupBy("box_id", "inside", "away", "ambiguous").count().collect()
    assert {tuple(r) for r in got} == {(1, True, 5.0, True, n - 1), (0, True, 24.0, False, 1)}


def test_pairs_of_equal_boxes_are_found_once_and_given_for_all_their_ids(spark):
    from stackwright.operators import spatial

    boxes = _equal_boxes(spark, 40)
    x, y = spatial._kinds(boxes.filter("id % 2 = 0"), "scene", "a"), spatial._kinds(boxes.filter("id % 2 = 1"), "scene", "b")
    assert spatial._kind_pairs(x, y, "scene", 0.2, 10.0).count() == 2
    got = {(r.a_id, r.b_id): r.iou for r in spatial.iou_pairs(boxes.filter("id % 2 = 0"), boxes.filter("id % 2 = 1"), "scene", 0.2, 10.0).collect()}
    assert got == {(a, b): 0.25 if a == 0 else 1.0 for a in range(0, 40, 2) for b in range(1, 40, 2)}


def test_greedy_matches_go_on_until_no_pair_is_left(spark, tmp_path):
    from stackwright.plans import reports

    n = 20  # Equal boxes on either side, 25 apart: each round of the SQL matches one pair, so 16 rounds leave four.
    parts = pd.DataFrame({"p_partkey": [k * 4000 + side * 2325 for side in (0, 1) for k in range(n)], "p_size": 50})
    got, cut = both(spark, "box_greedy_match", tmp_path, part=parts)
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    assert got == rows(con.execute(reports._greedy_sql(n)).df()) and len(got) == n
    assert len(cut) == 16 and set(cut) < set(got)
