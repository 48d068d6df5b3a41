"""Every query with SQL gives DuckDB's rows on the smallest tables; the others keep their own promises."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from stackwright.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if v is None or v is pd.NA or v != v:
        return "NULL"
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.9g}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted("|".join(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    got, want = registry.queries()[name](spark, DIR).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_match_best_finds_the_garbled_name(spark):
    from stackwright.plans.catalog import _asked

    got = registry.queries()["match_best"](spark, DIR).join(_asked(spark, DIR).withColumnRenamed("work", "truth"), "asked")
    assert got.count() > 0 and got.filter("work <> truth").count() <= 0.05 * got.count()


def test_greedy_matches_are_one_to_one(spark):
    p = registry.queries()["box_greedy_match"](spark, DIR).toPandas()
    assert not p.duplicated(["scene", "a_id"]).any() and not p.duplicated(["scene", "b_id"]).any()


def test_suppressed_boxes_do_not_overlap(spark):
    from stackwright.functions.geometry import box_iou

    p = registry.queries()["box_suppression"](spark, DIR).toPandas()
    for _, scene in p.groupby("scene"):
        r = list(scene[["cx", "cy", "w", "h", "angle"]].itertuples(index=False, name=None))
        assert all(box_iou(a, b) <= 0.3 + 1e-9 for i, a in enumerate(r) for b in r[:i])


def test_stratified_sample_keeps_quotas(spark):
    p = registry.queries()["quota_sample"](spark, DIR).toPandas()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").toPandas()
    for lang, n in docs.lang.value_counts().items():
        assert (p.lang == lang).sum() == math.floor(n * 0.1 + 0.5)


def test_greedy_cover_gains_fall(spark):
    gains = [r.gain for r in registry.queries()["greedy_cover"](spark, DIR).orderBy("place").collect()]
    assert gains == sorted(gains, reverse=True)


def test_whole_linkage_against_all_pairs(spark):
    parts = spark.read.parquet(f"{DIR}/part.parquet").select("p_partkey", "p_name", "p_size", "p_brand").collect()
    side = {r.p_partkey: int(r.p_brand[6:]) % 2 for r in parts}
    want = set()
    for a in (r for r in parts if not side[r.p_partkey]):
        found = sorted((-100 + abs(a.p_size - b.p_size), b.p_partkey) for b in parts if side[b.p_partkey] and a.p_name.split()[:2] == b.p_name.split()[:2])
        if found:
            score = -found[0][0]
            sure = len(found) == 1 or score + found[1][0] >= 1
            want.add((a.p_partkey, found[0][1], score, "rejected" if score < 90 else "accepted" if sure else "ambiguous"))
    got = registry.queries()["blocked_linkage"](spark, DIR).select("asked", "work", "score", "decision").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and any(r.asked % 20 for r in got)


def test_whole_nearest_boxes_against_all_pairs(spark):
    parts = [(r.p_partkey, r.p_size) for r in spark.read.parquet(f"{DIR}/part.parquet").select("p_partkey", "p_size").collect()]
    boxes = [(k, k % 25, k * 37 % 1000 + (20 + 4 * n) / 2, k * 53 % 800 + (15 + 3 * n) / 2, 20.0 + 4 * n, 15.0 + 3 * n) for k, n in parts]
    want = {}
    for k, _ in parts:
        x, y, found = k * 91 % 1000, k * 17 % 800, []
        for b, scene, cx, cy, w, h in boxes:
            inside, away = abs(x - cx) <= w / 2 and abs(y - cy) <= h / 2, math.hypot(x - cx, y - cy)
            if scene == k % 25 and (inside or away <= min(96.0, max(24.0, min(w, h) / 2))):
                found.append((not inside, away, b))
        found.sort()
        if found:
            unsure = len(found) > 1 and found[0][0] == found[1][0] and found[1][1] - found[0][1] < 5
            want[k] = (found[0][2], not found[0][0], unsure)
    got = registry.queries()["nearest_boxes"](spark, DIR).collect()
    assert {r.point_id: (r.box_id, r.inside, r.ambiguous) for r in got} == want and any(r.point_id % 4 for r in got)
