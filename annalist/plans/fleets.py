"""Fleets, names and the world beside the nations, from gold tables; each function has a query over the test tables.

In the queries a supplier's nation stands for a nation, a part's brand for a type of hull, a year for a save.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import half_even, hull_power
from .base import cents, query, table
from .wars import unit_list


def _hulls(vs_heavy: bool) -> Column:
    return hull_power(F.col("gun"), F.col("hull"), F.col("evasion"), F.col("torpedo"), F.lit(vs_heavy))


def inventory(held: DataFrame, stats: DataFrame, on: list[str], keys: list[str], vs_heavy: bool = False) -> DataFrame:
    """held (keys, ship_type, count, crew) with share, percent of the key's hulls, and power at the crews' strength.

    stats (on, gun, hull, evasion, torpedo, heavy): one row of each type. A type without crew counts by its hulls, one
    without stats has no power. Types with no hulls go.
    """
    h = held.where(F.col("count") > 0).join(stats, on, "left")
    share = half_even(F.lit(100.0) * F.col("count") / F.sum("count").over(W.partitionBy(*keys)), 1)
    return h.select(*keys, "ship_type", "count", share.alias("share"), (_hulls(vs_heavy) * F.coalesce("crew", F.col("count").cast("double"))).alias("power"))


def fleets(held: DataFrame, stats: DataFrame, on: list[str], keys: list[str], vs_heavy: bool = False) -> DataFrame:
    """Each key's hulls in all, and heavy and other ones, power at strength and on paper, which are null where a type
    has no stats (not known); and torpedoes: whether any hull carries one."""
    h = held.join(stats.withColumn("told", F.lit(True)), on, "left").withColumn("one", _hulls(vs_heavy))
    g = h.groupBy(*keys).agg(
        F.sum("count").alias("total"), F.bool_and(F.coalesce("told", F.lit(False))).alias("known"), F.bool_or(F.coalesce(F.col("torpedo") > 0, F.lit(False))).alias("torpedoes"),
        F.sum(F.when(F.col("heavy"), F.col("count")).otherwise(0)).alias("heavy"), F.sum(F.col("one") * F.coalesce("crew", F.col("count").cast("double"))).alias("power"), F.sum(F.col("one") * F.col("count")).alias("design"),
    )
    sure = {c: F.when(F.col("known"), F.col(c)) for c in ("heavy", "power", "design")}
    return g.withColumn("other", F.when(F.col("known"), F.col("total") - F.col("heavy"))).withColumns(sure)


def hull_spans(held: DataFrame, at: str) -> DataFrame:
    """ship_type (``__all`` for any), first, last: the saves between which somebody held such a hull; whole: all of them."""
    some = held.where(F.col("count") > 0)
    span = some.select(F.explode(F.array(F.col("ship_type"), F.lit("__all"))).alias("ship_type"), at).groupBy("ship_type").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    ends = held.agg(F.min(at).alias("_a_"), F.max(at).alias("_b_"))  # one row
    return span.crossJoin(F.broadcast(ends)).withColumn("whole", (F.col("first") <= F.col("_a_")) & (F.col("last") >= F.col("_b_"))).drop("_a_", "_b_")


def since_first(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """df with since: percent more or less than the key's first reading, null where that is none or nothing changed."""
    first = F.first(value).over(W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn("since", F.when((first > 0) & (F.col(value) != first), half_even((F.col(value) / first - 1) * 100, 1)))


def with_world(series: DataFrame, world: DataFrame, name: str) -> DataFrame:
    """series with world's readings as one more, named World: its own total, for nobody's land counts too."""
    return series.unionByName(world.withColumn(name, F.lit("World")))


def country_names(seen: DataFrame, names: DataFrame, order: list[str]) -> DataFrame:
    """tag, government, name: under the last government seen, by name of ``tag_government``, else of ``tag``, else the tag.

    seen: tag, government and the order's columns; names: key, text.
    """
    last = seen.groupBy("tag").agg(F.max_by("government", F.struct(*order)).alias("government"))
    of = names.where("text <> ''").groupBy("key").agg(F.min("text").alias("text"))
    first = of.select(F.col("key").alias("k1"), F.col("text").alias("t1"))
    plain = of.select(F.col("key").alias("k2"), F.col("text").alias("t2"))
    d = last.join(first, F.concat_ws("_", "tag", "government") == F.col("k1"), "left").join(plain, F.col("tag") == F.col("k2"), "left")
    return d.select("tag", "government", F.coalesce("t1", "t2", "tag").alias("name"))


def strength(sides: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Brigades and ships of each key's nations, how many have figures, and how many have none (they are not guessed)."""
    d = sides.join(facts.withColumn("_told_", F.lit(True)), "tag", "left")
    return d.groupBy(*keys).agg(F.sum(F.coalesce("brigades", F.lit(0))).alias("brigades"), F.sum(F.coalesce("ships", F.lit(0))).alias("ships"), F.count("_told_").alias("told"), F.count_if(F.col("_told_").isNull()).alias("missing"))


def main_campaign(saves: DataFrame) -> DataFrame:
    """The campaign with the most saves, of equals the first by name: one row."""
    n = saves.groupBy("campaign").agg(F.count("*").alias("saves"))
    return n.agg(F.max("saves").alias("saves"), F.min_by("campaign", F.struct((-F.col("saves")).alias("less"), "campaign")).alias("campaign"))


def _held(spark: SparkSession, sf: str) -> DataFrame:
    l, p, s = (table(spark, sf, n) for n in ("lineitem", "part", "supplier"))  # noqa: E741
    g = l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("tag"), F.year("l_shipdate").cast("long").alias("year"), F.col("p_brand").alias("ship_type"))
    n = F.sum(F.col("l_quantity").cast("long"))
    return g.agg(n.alias("count"), F.when(n % 3 != 0, F.sum("l_linenumber") / F.lit(4.0)).alias("crew"))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*")
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("ship_type")).agg(
        n.alias("n"), F.max("p_size").cast("double").alias("gun"), (F.min("p_size") + 1.0).alias("hull"), ((n % 2) / F.lit(2.0)).alias("evasion"), (n % 4).cast("double").alias("torpedo"), (n % 2 == 0).alias("heavy"),
    )
    return g.where("n % 11 <> 0").drop("n")


HELD = """h as (select s_nationkey as tag, year(l_shipdate) as year, p_brand as ship_type, sum(l_quantity::bigint)::bigint as count,
    case when sum(l_quantity::bigint) % 3 <> 0 then sum(l_linenumber) / 4.0 end as crew
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by all),
s as (select p_brand as ship_type, max(p_size)::double as gun, min(p_size) + 1.0::double as hull, (count(*) % 2) / 2.0::double as evasion, (count(*) % 4)::double as torpedo, count(*) % 2 = 0 as heavy
  from part group by 1 having count(*) % 11 <> 0)"""


@query(f"""
with {HELD} select tag, year, ship_type, count, printf('%.1f', (100.0::double * count / sum(count) over (partition by tag, year))::double)::double as share, (gun * hull / (1 - evasion) * coalesce(crew, count))::double as power
from h left join s using (ship_type) where count > 0
""")
def q_hull_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Hulls by type with their share and current power."""
    return inventory(_held(spark, sf), _stats(spark, sf), ["ship_type"], ["tag", "year"])


@query(f"""
with {HELD}, j as (select h.*, s.gun, s.torpedo, s.heavy, (gun + torpedo) * hull / (1 - evasion) as one from h left join s using (ship_type)),
g as (select tag, year, sum(count)::bigint as total, bool_and(gun is not null) as known, bool_or(coalesce(torpedo > 0, false)) as torpedoes, sum(case when heavy then count else 0 end)::bigint as heavy,
  sum(one * coalesce(crew, count))::double as power, sum(one * count)::double as design from j group by 1, 2)
select tag, year, total, known, torpedoes, case when known then heavy end as heavy, case when known then total - heavy end as other, case when known then power end as power, case when known then design end as design from g
""")
def q_fleet_table(spark: SparkSession, sf: str) -> DataFrame:
    """Fleets against heavy hulls: all, heavy and other hulls, power where every type is known."""
    return fleets(_held(spark, sf), _stats(spark, sf), ["ship_type"], ["tag", "year"], vs_heavy=True)


@query(f"""
with {HELD}, e as (select min(year) as a, max(year) as b from h), x as (select ship_type, year from h where count > 400 union all select '__all', year from h where count > 400)
select ship_type, min(year) as first, max(year) as last, min(year) <= any_value(a) and max(year) >= any_value(b) as whole from x cross join e group by 1
""")
def q_hull_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The years in which some nation holds more than 400 hulls of a type."""
    held = _held(spark, sf)
    return hull_spans(held.withColumn("count", F.greatest(F.col("count") - 400, F.lit(0))), "year")


@query("""
with w as (select 'World' as nation, year(o_orderdate) as year, sum(round(o_totalprice * 100)::bigint)::bigint as cents from orders group by all),
n as (select n_name as nation, year(o_orderdate) as year, sum(round(o_totalprice * 100)::bigint)::bigint as cents from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
u as (select * from n union all select * from w), f as (select *, first_value(cents) over (partition by nation order by year) as first from u)
select nation, year, cents, case when first > 0 and cents <> first then printf('%.1f', ((cents / first - 1) * 100)::double)::double end as since from f
""")
def q_world_beside_nations(spark: SparkSession, sf: str) -> DataFrame:
    """Nations' yearly sums and the world's own beside them, each with its change since the first."""
    o, c, n = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    year, total = F.year("o_orderdate").cast("long").alias("year"), F.sum(cents("o_totalprice")).alias("cents")
    nations = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("nation"), year).agg(total)
    return since_first(with_world(nations, o.groupBy(year).agg(total), "nation"), ["nation"], "year", "cents")


@query("""
with seen as (select 'N' || c_nationkey as tag, arg_max(c_mktsegment, c_custkey) as government from customer group by 1),
names as (select distinct 'N' || c_nationkey || '_' || c_mktsegment as key, n_name || ' of ' || c_mktsegment as text from customer join nation on c_nationkey = n_nationkey where c_nationkey % 2 = 0
  union select 'N' || n_nationkey, n_name from nation where n_nationkey % 3 <> 0)
select tag, government, coalesce(a.text, b.text, tag) as name from seen left join names a on a.key = tag || '_' || government left join names b on b.key = tag
""")
def q_country_names(spark: SparkSession, sf: str) -> DataFrame:
    """The name of a nation under its last government, else its plain name, else its tag."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    tag = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    under = c.where("c_nationkey % 2 = 0").join(n, c.c_nationkey == n.n_nationkey).select(F.concat_ws("_", tag, "c_mktsegment").alias("key"), F.concat_ws(" of ", "n_name", "c_mktsegment").alias("text"))
    plain = n.where("n_nationkey % 3 <> 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("text"))
    return country_names(c.select(tag.alias("tag"), F.col("c_mktsegment").alias("government"), "c_custkey"), under.union(plain), ["c_custkey"])


@query("""
with p as (select distinct year(o_orderdate) as war, o_orderstatus as side, c_nationkey as tag from orders join customer on o_custkey = c_custkey),
f as (select s_nationkey as tag, count(*) as brigades, sum(s_suppkey % 7)::bigint as ships from supplier group by 1)
select war, side, sum(coalesce(brigades, 0))::bigint as brigades, sum(coalesce(ships, 0))::bigint as ships, count(brigades) as told, count(*) - count(brigades) as missing from p left join f using (tag) group by 1, 2
""")
def q_side_strength(spark: SparkSession, sf: str) -> DataFrame:
    """Brigades and ships of each side's nations, and those without figures counted."""
    o, c, s = (table(spark, sf, x) for x in ("orders", "customer", "supplier"))
    sides = o.join(c, o.o_custkey == c.c_custkey).select(F.year("o_orderdate").cast("long").alias("war"), F.col("o_orderstatus").alias("side"), F.col("c_nationkey").alias("tag")).distinct()
    facts = s.groupBy(F.col("s_nationkey").alias("tag")).agg(F.count("*").alias("brigades"), F.sum(F.col("s_suppkey") % 7).alias("ships"))
    return strength(sides, facts, ["war", "side"])


@query("""
with n as (select 'N' || c_nationkey as campaign, count(*) as saves from customer group by 1) select campaign, saves from n order by saves desc, campaign limit 1
""")
def q_main_campaign(spark: SparkSession, sf: str) -> DataFrame:
    """Of nations as campaigns and customers as saves, the one with the most."""
    return main_campaign(table(spark, sf, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("campaign")))


@query("""
with g as (select l_orderkey as battle, l_returnflag as unit, sum(l_quantity::bigint)::bigint as n from lineitem group by all)
select battle, string_agg(unit || ':' || n, ';' order by n desc, unit) as units from g group by 1
""")
def q_unit_list(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines by flag, as the units of a battle are written."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("battle"), F.col("l_returnflag").alias("unit")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    return g.groupBy("battle").agg(unit_list(F.array_sort(F.collect_list(F.struct("unit", "n")))).alias("units"))


@query("""
select l_orderkey as order_key, l_linenumber as line, printf('%.2f', l_extendedprice * (1 - l_discount))::double as paid, printf('%.0f', l_quantity / 2)::double as half, printf('%.5f', l_extendedprice / 7)::double as seventh from lineitem
""")
def q_half_even(spark: SparkSession, sf: str) -> DataFrame:
    """Rounding by exact binary values, ties to the even digit."""
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), half_even(price * (1 - off), 2).alias("paid"), half_even(F.col("l_quantity") / 2, 0).alias("half"), half_even(price / 7, 5).alias("seventh"),
    )
