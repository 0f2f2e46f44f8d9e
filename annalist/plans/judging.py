"""Queries over the test tables that run the rules' operators: triggers, what can be attained, where numbers begin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..sources.rules import TREE, attainable, tree
from . import alignment as A
from . import triggers as T
from .base import query, table

#: Rules over customers as nations: every family of conditions, nested blocks, and what cannot be known.
RULES = """
rich = { trigger = { money = 5000 civilized = yes } }
poor_or_small = { trigger = { OR = { NOT = { money = 0 } total_pops = 12 } } }
builders = { trigger = { government = BUILDING NOT = { has_country_flag = P technology = "1-URGENT" } } }
by_place = { trigger = { capital_scope = { OR = { continent = ASIA province_id = 7 } NOT = { province_id = 8 } } } }
unknown_place = { trigger = { OR = { capital_scope = { continent = EUROPE } war = yes } } }
busy = { trigger = { is_greater_power = yes AND = { technology = "5-LOW" technology = "2-HIGH" } OR = { has_country_flag = F owns = 3 } } }
late = { trigger = { year = 2001 ai = yes } }
groups = { trigger = { is_culture_group = EUROPE primary_culture = "NATION_7" OR = { exists = no capital = 7 } } }
one = { trigger = { tag = 42 } }
odd = { trigger = { OR = { moon = full prestige = 9 } NOT = { odd = 1 } } }
lenient = { trigger = { OR = { moon = full plurality = 3 } } }
draft = { trigger = { draft = "3-MEDIUM" NOT = { NOT = { revanchism = 1 } } } }
always = { icon = 1 }
"""


@query("""
with o as (select o_custkey as k, count(*) as n, bool_or(o_orderstatus = 'F') as f, bool_or(o_orderstatus = 'P') as p, bool_or(o_orderpriority = '1-URGENT') as urgent, bool_or(o_orderpriority = '2-HIGH') as high,
    bool_or(o_orderpriority = '5-LOW') as low, max(year(o_orderdate)) as y, count(*) filter (o_orderstatus = 'O') as open, min(o_orderpriority) as draft from orders group by 1),
c as (select c.c_custkey as tag, c_acctbal as money, c_mktsegment as gov, c_nationkey as cap, n_name, case when n_regionkey <> 4 then r_name end as continent, r_name as grp, c_acctbal > 0 as civ, coalesce(open >= 6, false) as war, coalesce(n >= 14, false) as gp, c_custkey % 10 = 3 as player,
    coalesce(o.n, 0) as pops, coalesce(f, false) as f, coalesce(p, false) as p, coalesce(urgent, false) as urgent, coalesce(high, false) as high, coalesce(low, false) as low, y, coalesce(open, 0) as open, draft
  from customer c left join o on o.k = c.c_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey),
r as (select tag, unnest([
  {'rule': 'rich', 'ok': money >= 5000 and civ}, {'rule': 'poor_or_small', 'ok': (not (money >= 0)) or pops >= 12}, {'rule': 'builders', 'ok': gov = 'BUILDING' and (not p and not urgent)},
  {'rule': 'by_place', 'ok': ((continent = 'ASIA' or cap = 7) and not (cap = 8))}, {'rule': 'unknown_place', 'ok': continent = 'EUROPE' or war}, {'rule': 'busy', 'ok': gp and low and high and f},
  {'rule': 'late', 'ok': y >= 2001 and not player}, {'rule': 'groups', 'ok': grp = 'EUROPE' and n_name = 'NATION_7' and cap = 7}, {'rule': 'one', 'ok': tag = 42}, {'rule': 'odd', 'ok': (null or pops % 11 >= 9) and not null},
  {'rule': 'lenient', 'ok': null or open >= 3}, {'rule': 'draft', 'ok': draft = '3-MEDIUM' and not (not (open >= 1))}, {'rule': 'always', 'ok': true}]) as x from c)
select tag as nation, x.rule as rule from r where x.ok
""")
def q_trigger_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Which rules hold of which nations, from a rule file's trees and long facts, in three-valued logic."""
    rows = spark.createDataFrame([("rules", *r) for r in tree(RULES)], TREE).withColumns({"folder": F.lit("common"), "name": F.lit("triggered_modifiers.txt")})
    o, n, r = table(spark, sf, "orders"), table(spark, sf, "nation"), table(spark, sf, "region")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == n["n_nationkey"], "left").join(r, F.col("n_regionkey") == r["r_regionkey"], "left")
    by = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max(F.year("o_orderdate")).alias("y"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.min("o_orderpriority").alias("draft"))
    c = c.join(by, "c_custkey", "left").na.fill(0, ["n", "open"])
    text = lambda key, v: F.struct(F.lit(key).alias("key"), v.cast("string").alias("text"), F.lit(None).cast("double").alias("number"))
    number = lambda key, v: F.struct(F.lit(key).alias("key"), F.lit(None).cast("string").alias("text"), v.cast("double").alias("number"))
    yes = lambda key, when: F.when(when, text(key, F.lit(None)))
    told = [
        text("tag", F.col("c_custkey")), text("government", F.col("c_mktsegment")), text("primary_culture", F.col("n_name")), text("is_culture_group", F.col("r_name")), text("draft", F.col("draft")), F.when(F.col("n_regionkey") != 4, text("continent", F.col("r_name"))),
        number("money", F.col("c_acctbal")), number("total_pops", F.col("n")), number("year", F.col("y")), number("capital", F.col("c_nationkey")), number("prestige", F.col("n") % 11), number("plurality", F.col("open")), number("revanchism", F.col("open")),
        yes("civilized", F.col("c_acctbal") > 0), yes("war", F.col("open") >= 6), yes("is_greater_power", F.col("n") >= 14), yes("ai", F.col("c_custkey") % 10 == 3),
    ]
    own = c.select(F.lit("now").alias("save_id"), F.col("c_custkey").cast("string").alias("tag"), F.inline(F.filter(F.array(*told), lambda x: x.isNotNull())))
    held = o.select(F.lit("now").alias("save_id"), F.col("o_custkey").cast("string").alias("tag"), F.inline(F.array(text("technology", F.col("o_orderpriority")), text("has_country_flag", F.col("o_orderstatus"))))).distinct()
    facts = own.unionByName(held.join(own.select("tag").distinct(), "tag", "left_semi"))
    reforms = spark.createDataFrame([("draft",)], "reform string")
    return T.judged(T.nodes(rows), facts, reforms).select(F.col("tag").cast("long").alias("nation"), "rule")


@query("""
with recursive l as (select o_orderpriority as campaign, (c_nationkey)::varchar as tag, l_partkey as tech from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where l_quantity > 45),
inv as (select p_partkey as inv, case when p_partkey % 4 <> 0 then p_partkey % 3 end as base from part),
able as (select distinct campaign, inv from inv join l on tech = inv where inv % 10 <> 0 or tag = (inv % 25)::varchar),
edges as (select inv, inv // 2 as other from inv where inv % 3 = 0 union select inv, inv - 40 from inv where inv % 5 = 1 and base - 1 <= 0),
campaigns as (select distinct campaign from l),
dead(campaign, inv) as (
  select campaign, inv from (select campaign, inv from campaigns, inv except select campaign, inv from able)
  union select campaign, edges.inv from campaigns, edges where edges.inv % 3 = 0 and other = edges.inv // 2 and other not in (select inv from inv)
  union select d.campaign, e.inv from dead d join edges e on e.other = d.inv)
select campaign, inv as invention from able except select campaign, inv from dead
""")
def q_attainable(spark: SparkSession, sf: str) -> DataFrame:
    """What each campaign can come to have: parts as inventions that need themselves as technology, half their number, and hope."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("invention"))
    line = table(spark, sf, "lineitem").where("l_quantity > 45").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    i = F.col("invention")
    rules = {
        "inventions": p.select("invention", F.when(i % 4 != 0, (i % 3).cast("double")).alias("base")), "techs": p.select("invention", i.alias("tech")), "tags": p.where("invention % 10 = 0").select("invention", (i % 25).cast("string").alias("tag")),
        "requires": p.where("invention % 3 = 0").select("invention", F.floor(i / 2).alias("other")), "blockers": p.where("invention % 5 = 1").select("invention", (i - 40).alias("other"), F.lit(-1.0).alias("factor")),
    }
    return attainable(rules, line.select(F.col("o_orderpriority").alias("campaign"), F.col("c_nationkey").cast("string").alias("tag"), F.col("l_partkey").alias("tech")))


HELD = """
h as (select n_regionkey as campaign, c_mktsegment as tag, list_sort(list(distinct o_orderpriority)) as techs, list_sort(list(distinct l_suppkey % 30)) as ids
  from customer join nation on n_nationkey = c_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where o_totalprice > 100 group by c_custkey, campaign, tag),
k as (select campaign, tag, techs, ids, count(*) as n from h group by all),
s as (select n_nationkey as seq, case when n_nationkey % 7 = 0 then [] else list_sort(list_distinct([['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][n_nationkey % 5 + 1], ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][n_regionkey + 1]])) end as needs,
  case when n_nationkey % 6 = 1 then ['BUILDING', 'MACHINERY'] else [] end as may from nation)"""


def _held(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What customers hold, each holding once, and the order of nations as inventions."""
    n = table(spark, sf, "nation")
    d = table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf, "orders").where("o_totalprice > 100"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    each = d.groupBy("c_custkey", F.col("n_regionkey").alias("campaign"), F.col("c_mktsegment").alias("tag")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("techs"), F.sort_array(F.collect_set(F.col("l_suppkey") % 30)).alias("ids"))
    kinds = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    both = F.sort_array(F.array_distinct(F.array(F.get(kinds, F.col("n_nationkey") % 5), F.get(kinds, F.col("n_regionkey")))))
    none = F.array().cast("array<string>")
    order = n.select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("invention"), F.when(F.col("n_nationkey") % 7 == 0, none).otherwise(both).alias("needs"), F.when(F.col("n_nationkey") % 6 == 1, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(none).alias("may"))
    return cut(each.groupBy("campaign", "tag", "techs", "ids").agg(F.count("*").alias("n"))), order


@query(f"""
with {HELD}, v as (select campaign, base, sum(case when s.seq is not null and len(list_filter(needs, lambda x: not list_contains(techs, x))) = 0 and (len(may) = 0 or list_contains(may, tag)) then 0 else n end)::bigint as bad, sum(n)::bigint as total
  from (select campaign, tag, techs, n, unnest(ids) as id from k) e cross join (values (1), (0)) b(base) left join s on s.seq = id - base group by all)
select campaign, base, bad, total, base = arg_min(base, bad * 10 + (1 - base)) over (partition by campaign) and bad / total <= 0.5 as chosen from v
""")
def q_index_bases(spark: SparkSession, sf: str) -> DataFrame:
    """How often each first number breaks the rules, and which is taken."""
    held, order = _held(spark, sf)
    counted = cut(A.violations(held, order))
    best = A.index_bases(counted, most=0.5).withColumnRenamed("base", "best")
    return counted.join(best, "campaign", "left").select("campaign", "base", "bad", "total", F.coalesce(F.col("base") == F.col("best"), F.lit(False)).alias("chosen"))


@query(f"""
with {HELD}, e as (select campaign, techs, n, unnest(ids) as id from k where len(techs) > 0), o as (select campaign, id, sum(n) as holders from e group by all having sum(n) >= 8),
j as (select o.campaign, o.id, o.holders, sh as shift, s.needs, '5-LOW' = any(coalesce(s.needs, [])) as lacks from o cross join unnest([-2, -1, 0, 1, 2]) t(sh) left join s on s.seq = o.id - 1 - sh),
f as (select j.campaign, j.id, j.shift, sum(n) filter (len(list_filter(j.needs, lambda x: not list_contains(techs, x))) = 0) as have from j join e on e.campaign = j.campaign and e.id = j.id where len(j.needs) > 0 and not j.lacks group by all),
c as (select j.campaign, j.shift, case when j.needs is null or len(j.needs) = 0 then 'unjudged' when lacks then 'ungated' when coalesce(have, 0) / holders >= 0.95 then 'settled' when coalesce(have, 0) / holders >= 0.5 then 'granted' else 'suspect' end as class from j left join f on f.campaign = j.campaign and f.id = j.id and f.shift = j.shift)
select campaign, shift, count(*) filter (class = 'settled') as settled, count(*) filter (class = 'granted') as granted, count(*) filter (class = 'suspect') as suspect, count(*) filter (class = 'unjudged') as unjudged, count(*) filter (class = 'ungated') as ungated from c group by all
""")
def q_index_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """How well the numbers of each campaign fit the order at five offsets."""
    held, order = _held(spark, sf)
    bases = held.select("campaign").distinct().withColumn("base", F.lit(1))
    technologies = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tech")).distinct().where("tech <> '5-LOW'")
    return A.scores(A.alignment(held, order, bases, technologies))
