"""Homes of nations and the numbers of profiles."""

from pyspark.sql import functions as F

from annalist.operators.numbering import dictionary, numbered
from annalist.plans.lands import home_boxes, home_lands


def test_homes(spark):
    box = lambda owner, part, x, y, area, *pids: ("d", owner, part, x, x + 4, y, y + 4, area, list(pids))
    parts = spark.createDataFrame([box("A", 1, 0, 0, 9, 1, 2), box("A", 5, 7, 0, 20, 5), box("A", 9, 60, 0, 30, 9), box("B", 20, 0, 50, 5, 20), box("B", 21, 50, 50, 5, 21), box("C", 30, 0, 90, 1, 30)], "of string, owner string, part long, x0 int, x1 int, y0 int, y1 int, area long, provinces array<long>")
    capitals = spark.createDataFrame([("d", "A", 2), ("d", "B", 999)], "of string, owner string, pid long")
    lands = home_lands(parts, capitals, 100)
    assert {(r.part, r.home, r.near) for r in lands.collect()} == {(1, True, True), (5, False, True), (9, False, False), (20, True, True), (21, False, False), (30, True, True)}
    assert {(r.owner, r.x0, r.x1, r.parts) for r in home_boxes(lands).collect()} == {("A", 0, 11, 2), ("B", 0, 4, 1), ("C", 0, 4, 1)}


def test_numbers_and_profiles(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("a"), "id").repartition(7)
    rows = sorted(numbered(df, ["a", "id"]).collect(), key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(5000)) and [(r.a, r.id) for r in rows] == sorted((r.a, r.id) for r in rows)
    held = spark.createDataFrame([(2, "x", [("gun", 1.0)]), (1, "x", [("gun", 1.0), ("hull", 2.0)]), (3, "y", [("gun", 1.0)]), (4, "y", None), (5, "z", [])], "at int, tag string, stats array<struct<k:string,v:double>>")
    profiles, uses = dictionary(held, ["at", "tag"], [F.col("stats")])
    assert sorted((r.profile, r["at"], r.holders) for r in profiles.collect()) == [(0, 1, 1), (1, 2, 2), (2, 4, 1), (3, 5, 1)]
    assert sorted((r["at"], r.profile) for r in uses.collect()) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)]
    assert numbered(df.limit(0), ["a"]).count() == 0
