"""Lands that hang together, a nation's home among them, and profiles that many holders share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import dictionary
from .base import query, table
from .space import ADJACENT, CELLS, q_components

#: Fixed: the share of a map's width within which islands belong to a home.
NEAR = 0.055


def home_lands(parts: DataFrame, capitals: DataFrame, width: int) -> DataFrame:
    """of, owner, part, home (that with the capital, else the largest, of equals the first), near: parts that a home includes.

    parts: of (a date), owner, part, x0, x1, y0, y1, area, provinces (array of pid); capitals: of, owner, pid. A part is near
    where its box lies less than a share of the map's width from the home's box, across narrow seas.
    """
    c = parts.join(capitals.select("of", "owner", F.col("pid").alias("capital")), ["of", "owner"], "left")
    has = F.coalesce(F.array_contains("provinces", F.col("capital")), F.lit(False))
    best = c.groupBy("of", "owner").agg(F.max_by(F.struct("part", "x0", "x1", "y0", "y1"), F.struct(has, "area", -F.col("part"))).alias("h"))
    gap = lambda a, b: F.greatest(F.lit(0), F.col(f"h.{a}0") - F.col(f"{a}1"), F.col(f"{a}0") - F.col(f"h.{a}1"))  # noqa: E731, ARG005
    away = F.sqrt(F.pow(gap("x", "x"), 2) + F.pow(gap("y", "y"), 2))
    j = parts.join(best, ["of", "owner"])
    return j.select("of", "owner", "part", "x0", "x1", "y0", "y1", "area", (F.col("part") == F.col("h.part")).alias("home"), (away < width * NEAR).alias("near"))


def home_boxes(lands: DataFrame) -> DataFrame:
    """of, owner, x0, x1, y0, y1, parts of each home with the parts near it."""
    return lands.where("near").groupBy("of", "owner").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("parts"))


@query(f"""
with recursive {CELLS}, {ADJACENT}, n as (select pid, arg_min(owner, p_partkey) as owner from c group by 1), s as (select a, b from e join n x on x.pid = a join n y on y.pid = b where x.owner = y.owner),
b2 as (select a, b from s union all select b, a from s), w as (select pid, pid as component from n union select b2.b, w.component from w join b2 on b2.a = w.pid),
g as (select pid, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, count(*) as area from c group by 1), k as (select pid, min(component) as part from w group by 1),
p as (select n.owner::bigint as owner, k.part, min(x0) as x0, max(x1) as x1, min(y0) as y0, max(y1) as y1, sum(area)::bigint as area, bool_or(pid = n.owner * 7 + 3) as capital from k join n using (pid) join g using (pid) group by 1, 2),
h as (select owner, arg_max({{'part': part, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1}}, (capital, area, -part)) as h from p group by 1)
select p.owner, p.part, p.area, p.part = h.part as home, sqrt(greatest(0, h.x0 - p.x1, p.x0 - h.x1) ** 2 + greatest(0, h.y0 - p.y1, p.y0 - h.y1) ** 2) < 64 * 0.055 as near from p join h using (owner)
""")
def q_home_lands(spark: SparkSession, sf: str) -> DataFrame:
    """Each owner's lands that hang together, its home, and the islands near it."""
    k = F.col("p_partkey")
    x, y = k % 64, F.floor(k / 64).cast("long")
    boxes = table(spark, sf, "part").select(x.alias("x"), y.alias("y"), (F.floor(x / 5) + 20 * F.floor(y / 4)).cast("long").alias("pid")).groupBy("pid").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("area"))
    joined = q_components(spark, sf).join(boxes, "pid").groupBy(F.lit("now").alias("of"), "owner", F.col("component").alias("part"))
    parts = joined.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("area").alias("area"), F.collect_list("pid").alias("provinces"))
    capitals = parts.select("of", "owner", (F.col("owner") * 7 + 3).alias("pid")).distinct()
    return home_lands(parts, capitals, 64).select("owner", "part", "area", "home", "near")


@query("""
with p as (select l_orderkey, string_agg(distinct l_returnflag || l_linestatus || (l_discount > 0.05)::varchar, ',' order by l_returnflag || l_linestatus || (l_discount > 0.05)::varchar) as kinds, count(*) % 4 as rest from lineitem group by 1),
f as (select kinds, rest, min(l_orderkey) as first, count(*) as holders from p group by all)
select row_number() over (order by first) - 1 as profile, first as l_orderkey, holders from f
""")
def q_profile_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Equal contents of orders under dense numbers, in the order of who held them first."""
    kind = F.concat("l_returnflag", "l_linestatus", (F.col("l_discount") > 0.05).cast("string"))
    held = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(kind)).alias("kinds"), (F.count("*") % 4).alias("rest"))
    profiles, _ = dictionary(held, ["l_orderkey"], [F.col("kinds"), F.col("rest")])
    return profiles.select("profile", "l_orderkey", "holders")
