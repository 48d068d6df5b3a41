import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.functions import geometry as g
from stackwright.functions import names as na
from stackwright.functions import numbers as nu
from stackwright.functions import planar as pl
from stackwright.functions import quality as q
from stackwright.functions import text as tx
from stackwright.operators import etl, monitor, queue, spatial
from stackwright.sources import books, records, sinks
from stackwright.streaming import jobs


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize("a, b, want", [("abcd", "abc", 600 / 7), ("", "", 100.0), ("a", "", 0.0), ("kitten", "sitting", 200 * 4 / 13), ("same", "same", 100.0)])
def test_ratio_engines_agree(spark, a, b, want):
    native, udf = one(spark, tx.ratio(F.lit(a), F.lit(b)), tx.ratio_udf(F.lit(a), F.lit(b)))
    assert native == pytest.approx(want) and udf == pytest.approx(want)


def test_normalize(spark):
    assert one(spark, tx.normalize(F.lit("Café & Crème, 2!")))[0] == "cafe and creme 2"
    assert one(spark, tx.normalize_nfkd(F.lit("ﬁne  Ünder")))[0] == "fine under"
    for raw, want in (("11.22.63", "112263"), ("U.S.A.", "usa"), ("The \u200bCrown", "the crown"), ("It’s “A” – B&C", "it's a  bandc"), (" ( x ) ", "x "), ("Ａ１ Ł É", "a1 ł e")):
        assert one(spark, tx.normalize(F.lit(raw)), tx.normalize_nfkd(F.lit(raw))) == (want, want)
    assert one(spark, tx.tokens(F.lit("")))[0] == []


def test_names(spark):
    j = lambda *n: one(spark, tx.join_names(F.array(*map(F.lit, n))))[0]
    assert j("A") == "A" and j("A", "B") == "A and B" and j("A", "B", "C") == "A, B, and C"
    people = lambda a: [(p.family, list(p.tokens), p.inverted) for p in one(spark, na.people(F.lit(a)))[0]]
    assert people("Doe, Jane") == [("doe", ["doe", "jane"], True)]
    assert people("Jane Doe and John van Roe Jr.") == [("doe", ["jane", "doe"], False), ("roe", ["john", "roe"], False)]
    assert people("Le Guin, Ursula K.") == [("guin", ["guin", "ursula"], True)] and people("A, B, C & D")[0] == ("a", ["a"], False)
    assert people("Garcia Marquez, Gabriel") == [("gabriel", ["garcia", "marquez", "gabriel"], False)] and people("") == []
    ok = lambda a, b: one(spark, na.compatible(F.lit(a), F.lit(b)))[0]
    assert ok("J. Doe", "Jane Doe") and ok("Liu Cixin", "Cixin Liu") and ok("Ann Lee", "Ann Lee Moss") and ok("J.K. Marsh", "J. K. Marsh")
    assert not ok("Ann Roe", "Jane Doe") and not ok("", "Jane Doe") and not ok("Jan Green", "Jan Boyne")
    assert one(spark, na.family_keys(na.people(F.lit("Mary Anne Ito"))[0]))[0] == ["ito", "mary", "anne"]
    assert one(spark, na.block_keys(F.lit("The Red Ring of Sand"), F.lit("Roe, Jo")))[0] == ["roe|red", "roe|ring", "jo|red", "jo|ring"]
    assert one(spark, na.block_keys(F.lit("1984"), F.lit("")))[0] == [] and one(spark, na.block_keys(F.lit("1984"), F.lit("Ed Roe")))[0][:2] == ["roe|1984", "roe|nineteen"]


def test_book_numbers(spark):
    assert one(spark, tx.isbn13(F.lit("0-306-40615-2")))[0] == "9780306406157"
    assert one(spark, tx.isbn13(F.lit("978-0-306-40615-7")))[0] == "9780306406157"
    assert one(spark, tx.isbn10_ok(F.lit("080442957X")), tx.isbn10_ok(F.lit("0306406153")), tx.isbn13_ok(F.lit("9780306406158"))) == (True, False, False)
    assert one(spark, tx.isbn13(F.lit("junk")))[0] is None


def test_titles_and_numbers(spark):
    assert one(spark, tx.title_core(F.lit("The Long Road: A Tale (Roads, #3)")))[0] == "long road"
    assert one(spark, tx.number_in(F.lit("score: 42,463"), r"score: ([\d,]+)"), tx.path_id(F.lit("/book/show/12-x"))) == (42463, 12)
    core = lambda t: one(spark, tx.title_core(F.lit(t)))[0]
    assert core("The Songs of Amber: Volume II (Songs, #3-5)") == "songs of amber volume ii" and core("Hawk: Night, Part Three") == "hawk night part three"
    assert core("The Diamond Time: Or, a Girl's Primer") == "diamond time" and core("A The Hill—and & Dale") == "hilland and dale"
    stripped = lambda t: one(spark, tx.series_stripped(F.lit(t)))[0]
    assert stripped("Two Top 2 (The Saga Book 1)") == "Two Top 2" and stripped("A Court (A Court, #1") == "A Court"
    assert stripped("Jo (Book of the Year)") == "Jo (Book of the Year)" and stripped("Scarlet (Holmes Book One)") == "Scarlet"
    words = lambda n: one(spark, nu.in_words(F.lit(n)))[0]
    assert [words(n) for n in (0, 7, 40, 99, 100, 1805, 1900, 1984, 2000, 2105, 10000)] == ["", "seven", "forty", "ninety nine", "one hundred", "eighteen five", "nineteen", "nineteen eighty four", "two thousand", "two thousand one hundred five", "10000"]
    assert one(spark, tx.same_title(F.lit("1984"), F.lit("nineteen eighty-four")), tx.title_score(F.lit("amber volume 2"), F.lit("amber volume 3"))) == (True, 0.0)
    assert one(spark, tx.lookup_keys(F.lit("The Red Ring")))[0] == ["the red ring", "red ring", "a red ring", "red-ring"]
    assert "nineteen eighty-four" in one(spark, tx.lookup_keys(F.lit("1984")))[0]
    assert one(spark, tx.title_prefix(F.lit("The Hungry Games")), tx.title_prefix(F.lit("Help"))) == ("hungry games", None)
    assert one(spark, tx.ocr_variants(F.lit("c0rn")))[0] == ["corn", "c0m"] and one(spark, tx.ocr_variants(F.lit("c0rn"), F.lit(0.95)))[0] == []
    assert one(spark, tx.hit(F.lit("The Red Ring!"), F.lit("red ring")))[0] == (False, True)


def test_geometry(spark):
    box = F.struct(F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(4.0).alias("w"), F.lit(2.0).alias("h"), F.lit(0.5).alias("angle"))
    assert one(spark, g.polygon_area(g.corners(box)))[0] == pytest.approx(8.0)
    assert g.box_iou((0, 0, 2, 2, 0), (1, 0, 2, 2, 0)) == pytest.approx(1 / 3)
    assert g.box_iou((0, 0, 2, 2, 0), (0, 0, 2, 2, math.pi / 2)) == pytest.approx(1.0)
    assert g.box_iou((0, 0, 2, 2, 0), (9, 9, 2, 2, 0)) == 0.0
    assert g.convex_hull([(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5)]) == [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert one(spark, g.axial_difference(F.lit(0.1), F.lit(math.pi - 0.1)))[0] == pytest.approx(0.2)
    assert one(spark, g.rotated_iou(box, box))[0] == pytest.approx(1.0)


def test_ranked_is_dense_and_global(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n")).repartition(5)
    got = etl.ranked(df, "k", "n").orderBy("popularity_rank").collect()
    assert [r.popularity_rank for r in got] == list(range(1, 1001))
    assert [(-r.n, r.k) for r in got] == sorted((-r.n, r.k) for r in got)


def test_fold_rules(spark):
    rows = [(1, 1, True, "x"), (1, 2, False, None), (2, 1, True, None), (2, 2, False, None), (3, 1, False, None)]
    df = spark.createDataFrame(rows, "k int, o int, ok boolean, isbn string")
    got = {r.k: (r.o, r.ok) for r in etl.last_success(df, "k", "o", "ok", "isbn").collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (1, False)}


def test_upsert_and_insert_ignore(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, etl.upsert(a, b.distinct(), "k", ["v"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, etl.insert_ignore(a, b, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_sources(spark, tmp_path):
    (tmp_path / "d.txt").write_text('{"key": "/a/1", "name": "N"}\nt\t/a/2\t3\tx\t{"name": "M"}\nbroken\n{"key":\n')
    got = records.dump_records(records.lines(spark, str(tmp_path / "d.txt")), "key string, name string")
    assert sorted((r.key, r.name) for r in got.collect()) == [("/a/1", "N"), ("/a/2", "M")]
    (tmp_path / "c.csv").write_text('Title,Author,ISBN\n"A ""b"", c",Me,\n,No,1\n"two\nlines",You,9\n')
    assert sorted(map(tuple, records.catalog_csv(spark, str(tmp_path / "c.csv")).collect())) == [('A "b", c', "Me", None, None), ("two\nlines", "You", "9", None)]
    z = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"]), (2, [], ["x"])], "p int, x array<int>, y array<string>")
    assert sorted(map(tuple, records.zipped(z, ["x", "y"]).collect())) == [(1, 1, "a"), (1, 2, "b")]
    (tmp_path / "i.txt").write_text("3\nx\n 4 \n3\n")
    assert sorted(r.id for r in records.ids(records.lines(spark, str(tmp_path / "i.txt"))).collect()) == [3, 4]
    (tmp_path / "q.txt").write_text("1 0 0 1 0 1 1 0 1\n2 0 0\n")
    q = records.quads(records.lines(spark, str(tmp_path / "q.txt")), 10, 20).collect()
    assert len(q) == 1 and (q[0].points[2].x, q[0].points[2].y) == (10.0, 20.0)
    assert sinks.json_gz(spark.range(5), str(tmp_path / "out")) == 5


def test_require_fields(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": 2}\n{}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n')
    got = records.require_fields(records.lines(spark, str(tmp_path)), ["x", "y"]).collect()
    assert [(r.file.endswith("b.jsonl"), r.missing) for r in got] == [(True, ["y"])]


def test_streaks_and_tiles(spark):
    rows = [(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, True), (2, 1, False), (3, 1, True)]
    df = spark.createDataFrame(rows, "u int, o int, hit boolean")
    got = {r.u: (r.n, r.hits, r.streak) for r in monitor.trailing_streaks(df, "u", ["o"], F.col("hit")).collect()}
    assert got == {1: (4, 3, 2), 2: (1, 0, 0), 3: (1, 1, 1)}
    tiles = spatial.tiles(spark.createDataFrame([(25, 10)], "w int, h int"), "w", "h", 10, 8).collect()
    assert sorted((r.tile_x, r.tile_y) for r in tiles) == [(0, 0), (8, 0), (15, 0)]


def test_stream_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-01 05:00:00", "z")]
    spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = jobs.window_counts(stream, "ts", "k", "1 hour", "10 minutes").writeStream.format("memory").queryName("w").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start.hour, r.k, r.n) for r in spark.table("w").collect()) == [(0, "a", 2), (1, "b", 1)]


def test_stream_cooldowns(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:00:00")], "k long, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    q = jobs.cooldowns(stream, "k", "ts").writeStream.format("memory").queryName("c").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = {r.k: (r.attempts, r.retry_after.strftime("%H:%M")) for r in spark.table("c").collect()}
    assert got == {1: (2, "00:50"), 2: (1, "00:10")}


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_ranks_over_many_range_partitions(spark, coalesce):
    """Every row is ranked once, in order, whatever Spark makes of its partitions."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        n = 400_000
        rows = spark.range(0, n, 1, 9).select(F.col("id").alias("k"), (F.xxhash64("id") % 500).alias("c"), F.lit("x").alias("more"))
        out = etl.ranked(rows, "k", "c").select("k", "c", F.col("popularity_rank").alias("r")).toPandas().sort_values("r")
        assert out.r.tolist() == list(range(1, n + 1))
        want = out.sort_values(["c", "k"], ascending=[False, True])
        assert want.k.tolist() == out.k.tolist()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_totals_before_rows_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, None, 2), (2, 5, 3), (3, 5, 4), (4, 1, 10)], "k int, v int, w int")
    out = {r.k: r.before for r in etl.running_totals(rows, [F.col("v"), F.col("k")], F.col("w"), "before").collect()}
    assert out == {1: 0, 4: 2, 2: 12, 3: 15}
    assert etl.running_totals(rows.limit(0), ["v"], F.lit(1), "before").count() == 0


def test_plane_geometry(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    arrow = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    assert pl.is_convex(square) and not pl.is_convex(arrow)
    assert sum(g.area(t) for t in pl.triangles(arrow)) == pytest.approx(abs(g.area(arrow)))
    assert pl.overlap_area(square, [(2, 2), (6, 2), (6, 6), (2, 6)]) == pytest.approx(4) and pl.overlap_area(arrow, square) == pytest.approx(10)
    assert pl.segment_cross([(0, 0), (2, 2)], [(0, 2), (2, 0)]) == pytest.approx((0.5, 0.5)) and pl.segment_cross([(0, 0), (1, 0)], [(0, 1), (1, 1)]) is None
    assert pl.separating_angle(square, [(5, 0), (9, 0), (9, 4)]) == 0 and pl.separating_angle(square, arrow) is None
    assert pl.smooth(np.array([0, 0, 5, 0, 0.0]), 5).tolist() == [1, 1, 1, 1, 1] and pl.best_gap([5, 5, 0, 5, 5, 1, 5], 0, 6, [(1, 3)], 1) == 5
    assert pl.projective([(0, 0)] * 4, square) is None
    pts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in square))
    at = lambda x, y: one(spark, g.point_in_polygon(F.lit(x), F.lit(y), pts), pl.strictly_inside(F.lit(x), F.lit(y), pts), g.point_in_polygon(F.lit(x), F.lit(y), pts, boundary=False))
    assert at(2.0, 2.0) == (True, True, True) and at(0.0, 2.0)[:2] == (True, False) and at(9.0, 9.0) == (False, False, False)


def test_picture_gate(spark):
    flat, lines = bytes([128]) * 64, bytes([0, 255] * 32)
    got = one(spark, q.sharpness(F.lit(flat), F.lit(8)), q.sharpness(F.lit(lines), F.lit(8)), q.exposure(F.lit(flat)), q.exposure(F.lit(b"")))
    assert got[0] == 0 and got[1] > 0.99 and got[2] == pytest.approx(1 - 0.5 / 127.5) and got[3] == 0


def test_ring_and_rates(spark):
    ring = F.array(*map(F.lit, "abc"))
    assert one(spark, *(queue.successor(ring, F.lit(c)) for c in "acz")) == ("b", "a", "a")
    r = one(spark, queue.rate(F.lit(1), F.lit(0), F.lit(0)))[0]
    assert (r.success, r.per_minute) == (0.0, 0.0)


def test_absent_and_strict_json(spark, tmp_path):
    assert books.existing(spark, str(tmp_path / "none"), "a long").count() == 0
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": \n')
    assert books.existing(spark, str(tmp_path / "x.json"), "a long").filter("a = 1").count() == 1
    with pytest.raises(Exception):
        books.strict(spark, str(tmp_path / "x.json"), "a long").collect()
