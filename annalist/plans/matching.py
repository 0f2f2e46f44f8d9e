"""Sets, successions, candidates and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import query, table

OWNED = "o as (select l_suppkey % 40 as tag, (year(l_shipdate) - 1995) as save, list(distinct l_partkey % 60 order by l_partkey % 60) as land from lineitem where l_partkey % 60 % 40 = l_suppkey % 40 or (l_shipdate >= '1998-01-01' and l_partkey % 60 % 20 = l_suppkey % 40) group by all)"


def _owned(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    land, tag = F.col("l_partkey") % 60, F.col("l_suppkey") % 40
    own = line.where((land % 40 == tag) | ((F.col("l_shipdate") >= "1998-01-01") & (land % 20 == tag)))
    return own.groupBy(tag.alias("tag"), (F.year("l_shipdate") - 1995).cast("long").alias("save")).agg(F.array_sort(F.collect_set(land)).alias("land"))


@query(f"""
with {OWNED} select save + 1 as save, tag, 'vanished' as what from o where not exists (select 1 from o b where b.tag = o.tag and b.save = o.save + 1) and save < (select max(save) from o)
union all select save, tag, 'appeared' from o where not exists (select 1 from o b where b.tag = o.tag and b.save = o.save - 1) and save > (select min(save) from o)
""")
def q_appeared_vanished(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that a save has and the one before or after has not: anti-joins of neighbouring saves."""
    o = _owned(spark, sf).select("tag", "save")
    ends = F.broadcast(o.agg(F.min("save").alias("lo"), F.max("save").alias("hi")))
    gone = o.join(o.select("tag", (F.col("save") - 1).alias("save")), ["tag", "save"], "left_anti").join(ends).where("save < hi")
    new = o.join(o.select("tag", (F.col("save") + 1).alias("save")), ["tag", "save"], "left_anti").join(ends).where("save > lo")
    return gone.select((F.col("save") + 1).alias("save"), "tag", F.lit("vanished").alias("what")).union(new.select("save", "tag", F.lit("appeared")))


@query(f"""
with {OWNED} select b.save, a.tag as old, b.tag as new, len(list_intersect(a.land, b.land))::int as shared, round(len(list_intersect(a.land, b.land)) / len(a.land), 4) as share
from o a join o b on b.save = a.save + 1 and a.tag <> b.tag where len(list_intersect(a.land, b.land)) * 2 >= len(a.land)
""")
def q_succession(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that hold at least half of the land another held a save before: joined by province, not all to all."""
    o = _owned(spark, sf)
    p = o.select("tag", "save", F.size("land").alias("n"), F.explode("land").alias("pid"))
    a, b = p.select(F.col("tag").alias("old"), (F.col("save") + 1).alias("save"), "n", "pid"), p.select(F.col("tag").alias("new"), "save", "pid")
    g = a.join(b, ["save", "pid"]).where("old <> new").groupBy("save", "old", "new", "n").agg(F.count("*").cast("int").alias("shared"))
    return g.where("shared * 2 >= n").select("save", "old", "new", "shared", F.round(F.col("shared") / F.col("n"), 4).alias("share"))


@query("""
select o_custkey as tag, count(distinct year(o_orderdate)) as campaigns from orders group by 1 having count(distinct year(o_orderdate)) >= 2
""")
def q_shared_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Nations in at least two campaigns."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("tag")).agg(F.countDistinct(F.year("o_orderdate")).alias("campaigns")).where("campaigns >= 2")


FLAGS = "f as (select user_id % 5 as campaign, dayofyear(ts) as day, list(distinct event_id % 9 order by event_id % 9) as flags from events where event_id % 9 <= dayofyear(ts) % 10 group by all)"


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("day", F.dayofyear("ts").cast("long")).withColumn("flag", F.col("event_id") % 9)
    return e.where(F.col("flag") <= F.col("day") % 10).groupBy((F.col("user_id") % 5).alias("campaign"), "day").agg(F.array_sort(F.collect_set("flag")).alias("flags"))


@query(f"""
with {FLAGS} select campaign, day, len(flags)::int as flags, case when later is not null then len(list_filter(flags, lambda x: not list_contains(later, x))) end::double as lost
from (select *, lead(flags) over (partition by campaign order by day) as later from f)
""")
def q_flag_gap(spark: SparkSession, sf: str) -> DataFrame:
    """How many flags a save has that the next one lacks."""
    later = F.lead("flags").over(W.partitionBy("campaign").orderBy("day"))
    f = _flags(spark, sf).withColumn("later", later)
    return f.select("campaign", "day", F.size("flags").alias("flags"), F.when(F.col("later").isNotNull(), F.size(F.array_except("flags", "later"))).cast("double").alias("lost"))


@query(f"""
with {FLAGS}, p as (select a.campaign, a.day, len(list_filter(a.flags, lambda x: not list_contains(b.flags, x))) as lost from f a join f b on a.campaign = b.campaign and b.day > a.day)
select campaign, day, count(*) as later, min(lost)::int as least_lost, count(*) >= 2 and min(lost) >= 3 as stray from p group by 1, 2
""")
def q_stray(spark: SparkSession, sf: str) -> DataFrame:
    """Saves whose flags every later save of the campaign lacks."""
    f = _flags(spark, sf)
    b = f.select("campaign", F.col("day").alias("d"), F.col("flags").alias("fl"))
    p = f.join(b, "campaign").where("d > day").withColumn("lost", F.size(F.array_except("flags", "fl")))
    return p.groupBy("campaign", "day").agg(F.count("*").alias("later"), F.min("lost").alias("least_lost")).withColumn("stray", (F.col("later") >= 2) & (F.col("least_lost") >= 3))


@query("""
with h as (select l_orderkey, list(distinct l_partkey % 12) as held from lineitem group by 1)
select r.need, count(*) filter (len(list_intersect(h.held, r.parts)) = len(r.parts)) as attained, count(*) as nations from h cross join (values (1, [1]), (2, [1, 2]), (3, [3, 5, 7])) r(need, parts) group by 1
""")
def q_subset_required(spark: SparkSession, sf: str) -> DataFrame:
    """Rules whose required technologies a nation holds all of."""
    h = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 12).alias("held"))
    rules = [(1, [1]), (2, [1, 2]), (3, [3, 5, 7])]
    met = F.array(*(F.struct(F.lit(k).alias("need"), (F.size(F.array_except(F.array(*(F.lit(p).cast("long") for p in parts)), "held")) == 0).alias("has")) for k, parts in rules))
    return h.select(F.explode(met).alias("m")).groupBy("m.need").agg(F.count_if("m.has").alias("attained"), F.count("*").alias("nations"))


@query("""
with sold as (select l_suppkey % 20 as cand, list(distinct p_brand) as defined from lineitem join part on l_partkey = p_partkey group by 1),
save as (select list(distinct p_brand) as seen from part where p_size = 7),
m as (select cand, len(list_filter(seen, lambda x: not list_contains(defined, x)))::int as missing, len(list_filter(defined, lambda x: not list_contains(seen, x)))::int as unused from sold, save)
select cand, missing, unused, missing + unused as distance, row_number() over (order by missing, unused, cand) as place from m
""")
def q_candidate_match(spark: SparkSession, sf: str) -> DataFrame:
    """Which candidate's names fit those that a save uses: names missing, names unused, and the order of fit."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    sold = line.join(part, line.l_partkey == part.p_partkey).select((F.col("l_suppkey") % 20).alias("cand"), "p_brand").distinct()
    seen = part.where("p_size = 7").agg(F.collect_set("p_brand").alias("seen"))
    m = sold.groupBy("cand").agg(F.collect_set("p_brand").alias("defined")).join(F.broadcast(seen))
    m = m.select("cand", F.size(F.array_except("seen", "defined")).alias("missing"), F.size(F.array_except("defined", "seen")).alias("unused"))
    return m.select("*", (F.col("missing") + F.col("unused")).alias("distance"), F.row_number().over(W.partitionBy(F.lit(0)).orderBy("missing", "unused", "cand")).cast("long").alias("place"))


@query("""
select b.base, count(*) as judged, count(*) filter ((l_linenumber - b.base) % 3 = 0) as violations, round(100.0 * count(*) filter ((l_linenumber - b.base) % 3 = 0) / count(*), 3) as rate, round(100.0 * count(*) filter ((l_linenumber - b.base) % 3 = 0) / count(*), 3) <= 35 as settled
from lineitem cross join (select unnest([0, 1, 2, 3, 4]) as base) b where l_linenumber >= b.base group by 1
""")
def q_base_inference(spark: SparkSession, sf: str) -> DataFrame:
    """How often a numbering breaks its rules under each of five offsets."""
    line = table(spark, sf, "lineitem").select("l_linenumber", F.explode(F.array(*map(F.lit, range(5)))).alias("base")).where("l_linenumber >= base")
    bad = F.count_if((F.col("l_linenumber") - F.col("base")) % 3 == 0)
    rate = F.round(F.lit(100.0) * F.col("violations") / F.col("judged"), 3)
    return line.groupBy("base").agg(F.count("*").alias("judged"), bad.alias("violations")).select("*", rate.alias("rate"), (rate <= 35).alias("settled"))


@query("""
with t as (select c_custkey, nullif(c_acctbal, greatest(c_acctbal, 0)) as debt, nullif(c_mktsegment, 'MACHINERY') as seg from customer)
select c_custkey as nation, (debt < -500) and (seg = 'BUILDING') as all_of, (debt < -500) or (seg = 'BUILDING') as any_of, not (debt < -500) and not (seg = 'BUILDING') as none_of,
  coalesce((debt < -500) and (seg = 'BUILDING'), false) as counts from t
""")
def q_trigger_eval(spark: SparkSession, sf: str) -> DataFrame:
    """A rule's conditions in three-valued logic: unknown stays unknown, and counts only where it is true."""
    from ..functions.triggers import compile_trigger

    c = table(spark, sf, "customer")
    c = c.select(F.col("c_custkey").alias("nation"), F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("debt"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("seg"))
    known = {"poorer_than": lambda v: F.col("debt") < float(v), "segment": lambda v: F.col("seg") == v}
    two = [("poorer_than", "-500"), ("segment", "BUILDING")]
    both = compile_trigger(two, known)
    return c.select("nation", both.alias("all_of"), compile_trigger([("OR", two)], known).alias("any_of"), compile_trigger([("NOT", two)], known).alias("none_of"), F.coalesce(both, F.lit(False)).alias("counts"))


RATES = "r as (select o_custkey as nation, o_orderpriority as kind, count(*) * case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 when '3-MEDIUM' then 1 when '5-LOW' then -4 else 0 end as permille from orders group by o_custkey, o_orderpriority)"


@query(f"""
with {RATES} select nation, kind, permille, row_number() over (partition by nation order by kind, permille desc) as place from r where permille <> 0
""")
def q_contribution_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """What each source gives to a nation's rate."""
    return _rates(spark, sf).where("permille <> 0").withColumn("place", F.row_number().over(W.partitionBy("nation").orderBy("kind", F.desc("permille"))).cast("long"))


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    each = F.when(F.col("kind") == "1-URGENT", 3).when(F.col("kind") == "2-HIGH", 2).when(F.col("kind") == "3-MEDIUM", 1).when(F.col("kind") == "5-LOW", -4).otherwise(0)
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("nation"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))
    return g.select("nation", "kind", (F.col("n") * each).alias("permille"))


@query(f"""
with {RATES} select nation, greatest(0, sum(permille))::bigint as rate, trunc(greatest(4, 3) * (1 + sum(permille) / 100.0))::bigint as cap from r group by 1
""")
def q_rate(spark: SparkSession, sf: str) -> DataFrame:
    """A rate is the sum of its sources, at least 0; a cap is truncated."""
    s = F.sum("permille")
    return _rates(spark, sf).groupBy("nation").agg(F.greatest(F.lit(0), s).cast("long").alias("rate"), (F.lit(4) * (1 + s / F.lit(100.0))).cast("long").alias("cap"))


@query("""
select o_custkey as nation, o_orderdate as at_date, count(*) over (partition by o_custkey) as saves, dense_rank() over (partition by year(o_orderdate) order by o_custkey) as nth from orders
""")
def q_great_power_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places of nations in a save."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("nation"), F.col("o_orderdate").alias("at_date"), F.count("*").over(W.partitionBy("o_custkey")).alias("saves"), F.dense_rank().over(W.partitionBy(F.year("o_orderdate")).orderBy("o_custkey")).cast("long").alias("nth"))


@query("""
with a as (select p_brand, p_type, 1 as layer from part where p_size < 10), b as (select p_brand, min(p_type) as p_type, 2 as layer from part where p_size >= 45 group by 1), u as (select * from a union all select * from b)
select p_brand as name, arg_max(p_type, (layer, p_type)) as value, max(layer)::int as layer from u group by 1
""")
def q_layered_override(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a base layer that a later layer overrides."""
    part = table(spark, sf, "part")
    a = part.where("p_size < 10").select("p_brand", "p_type", F.lit(1).alias("layer"))
    b = part.where("p_size >= 45").groupBy("p_brand").agg(F.min("p_type").alias("p_type")).withColumn("layer", F.lit(2))
    return a.union(b).groupBy(F.col("p_brand").alias("name")).agg(F.max_by("p_type", F.struct("layer", "p_type")).alias("value"), F.max("layer").alias("layer"))


@query("""
with g as (select l_orderkey as war, l_suppkey % 4 as actor, l_returnflag as cb, count(*) as had, count(*) filter (l_linestatus = 'F') as took from lineitem group by all)
select war, actor, cb, had, took, case when took = had then 'met' when took > 0 then 'part' else 'none' end as outcome, (select count(distinct actor) from g b where b.war = g.war) as actors from g
""")
def q_goals_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """What a war's goals asked for and what was taken of it."""
    line = table(spark, sf, "lineitem")
    g = line.groupBy(F.col("l_orderkey").alias("war"), (F.col("l_suppkey") % 4).alias("actor"), F.col("l_returnflag").alias("cb")).agg(F.count("*").alias("had"), F.count_if(F.col("l_linestatus") == "F").alias("took"))
    g = g.withColumn("outcome", F.when(F.col("took") == F.col("had"), "met").when(F.col("took") > 0, "part").otherwise("none"))
    return g.withColumn("actors", F.size(F.collect_set("actor").over(W.partitionBy("war"))).cast("long"))


@query("""
select coalesce(a.k, b.k) as nation, a.n as engine, b.n as recount, a.n is not distinct from b.n as agrees from (select l_orderkey % 100 as k, count(*) as n from lineitem group by 1) a
full join (select o_orderkey % 100 as k, sum((select count(*) from lineitem where l_orderkey = o_orderkey))::bigint as n from orders group by 1) b on a.k = b.k
""")
def q_verify_recount(spark: SparkSession, sf: str) -> DataFrame:
    """One count made in two ways, side by side."""
    line, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    a = line.groupBy((F.col("l_orderkey") % 100).alias("k")).agg(F.count("*").alias("engine"))
    per = line.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    b = o.join(per, o.o_orderkey == per.l_orderkey, "left").groupBy((F.col("o_orderkey") % 100).alias("k")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("recount"))
    return a.join(b, "k", "full").select(F.col("k").alias("nation"), "engine", "recount", F.col("engine").eqNullSafe(F.col("recount")).alias("agrees"))


@query("""
with r as (select l_orderkey, l_linenumber, l_quantity < 0 as negative, l_discount > 0.09 as high, l_tax > l_discount as ordering, l_returnflag not in ('A', 'N', 'R') as flag from lineitem)
select rule, count(*) as violations from (select 'negative' as rule from r where negative union all select 'high' from r where high union all select 'ordering' from r where ordering union all select 'flag' from r where flag) group by 1
""")
def q_invariants_violations(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows break each rule, in one pass over them."""
    line = table(spark, sf, "lineitem")
    rules = {"negative": F.col("l_quantity") < 0, "high": F.col("l_discount") > 0.09, "ordering": F.col("l_tax") > F.col("l_discount"), "flag": ~F.col("l_returnflag").isin("A", "N", "R")}
    broken = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return line.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("violations"))


@query("""
select event_type as kind, count(distinct event_id) as events, count(*) filter (event_id % 3 = 0) as kept from (select * from events union all select * from events where event_id % 4 = 0) group by 1
""")
def q_stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream of files with repeats leaves: each file once, and every third of them."""
    e = table(spark, sf, "events")
    twice = e.union(e.where("event_id % 4 = 0"))
    return twice.groupBy(F.col("event_type").alias("kind")).agg(F.countDistinct("event_id").alias("events"), F.count_if(F.col("event_id") % 3 == 0).alias("kept"))
