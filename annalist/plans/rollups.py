"""Sums, shares and counts of nations: a customer's nation stands for a nation, an order line for a population group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.folds import brigades, compensated_sum, ordered
from ..operators.series import latest_wins, top_with_rest
from .base import cents, month, query, table


@query("""
with m as (select n_name as nation, year(o_orderdate) * 12 + month(o_orderdate) - 1 as month, count(*) as orders, sum(round(o_totalprice * 100)::bigint)::bigint as cents,
    count(*) filter (o_orderpriority = '1-URGENT') as urgent
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)
select nation, month, orders, cents, round(100.0 * urgent / orders, 3) as urgent_pct, (cents - lag(cents) over (partition by nation order by month))::double as gain,
  row_number() over (partition by month order by cents desc, nation) as rank from m
""")
def q_nation_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table by nation and month: counts, sums, a share, the gain since the last reading, the rank."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    m = j.groupBy(F.col("n_name").alias("nation"), month("o_orderdate").alias("month")).agg(F.count("*").alias("orders"), F.sum(cents("o_totalprice")).alias("cents"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return m.select(
        "nation", "month", "orders", "cents", F.round(F.lit(100.0) * F.col("urgent") / F.col("orders"), 3).alias("urgent_pct"),
        (F.col("cents") - F.lag("cents").over(W.partitionBy("nation").orderBy("month"))).cast("double").alias("gain"),
        F.row_number().over(W.partitionBy("month").orderBy(F.desc("cents"), "nation")).cast("long").alias("rank"),
    )


@query("""
select r_name as region, n_name as nation, grouping(r_name, n_name)::int as grain, count(*) as customers, sum(round(c_acctbal * 100)::bigint)::bigint as cents
from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)
""")
def q_nation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Customer, nation, region and world in one pass; the world's row has customers of no nation too."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    g = j.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.grouping_id().cast("int").alias("grain"), F.count("*").alias("customers"), F.sum(cents("c_acctbal")).alias("cents"))
    return g.select("region", "nation", "grain", "customers", "cents")


@query("""
select l_suppkey as supplier, sum(l_quantity)::bigint as people, round(sum((l_quantity * round(l_discount * 100))::bigint) / sum(l_quantity), 5) as weighted,
  round(sum(case when l_returnflag = 'N' then (l_quantity * round(l_discount * 100))::bigint end) / nullif(sum(case when l_returnflag = 'N' then l_quantity end), 0), 5) as weighted_n,
  round(100.0 * sum(case when l_linestatus = 'O' then l_quantity else 0 end) / sum(l_quantity), 3) as open_pct from lineitem group by 1
""")
def q_weighted_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Averages weighted by size, over all and over some rows, and a share of the whole."""
    line = table(spark, sf, "lineitem")
    x = (F.col("l_quantity") * F.round(F.col("l_discount") * 100)).cast("long")
    some = F.col("l_returnflag") == "N"
    return line.groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.sum("l_quantity").cast("long").alias("people"), F.round(F.sum(x) / F.sum("l_quantity"), 5).alias("weighted"),
        F.round(F.sum(F.when(some, x)) / F.nullif(F.sum(F.when(some, F.col("l_quantity"))), F.lit(0.0)), 5).alias("weighted_n"),
        F.round(F.lit(100.0) * F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity"), 3).alias("open_pct"),
    )


@query("""
select c_nationkey as nation, count(*) filter (c_mktsegment in ('BUILDING', 'MACHINERY')) as poor, count(*) filter (c_mktsegment in ('FURNITURE', 'HOUSEHOLD')) as middle,
  count(*) filter (c_mktsegment = 'AUTOMOBILE') as rich from customer group by 1
""")
def q_strata_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """People by stratum, a stratum for each type from a small table of rules, pivoted to columns."""
    c = table(spark, sf, "customer")
    strata = spark.createDataFrame([("BUILDING", "poor"), ("MACHINERY", "poor"), ("FURNITURE", "middle"), ("HOUSEHOLD", "middle"), ("AUTOMOBILE", "rich")], "type string, stratum string")
    j = c.join(F.broadcast(strata), c.c_mktsegment == strata.type)
    return j.groupBy(F.col("c_nationkey").alias("nation")).pivot("stratum", ["poor", "middle", "rich"]).count().na.fill(0)


@query("""
select l_suppkey as supplier, l_returnflag as kind, sum(l_quantity)::bigint as size, min(l_orderkey * 10 + l_linenumber) as first_seen,
  row_number() over (partition by l_suppkey order by sum(l_quantity) desc, min(l_orderkey * 10 + l_linenumber), l_returnflag) as place from lineitem group by 1, 2
""")
def q_first_seen_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sums by kind, largest first, ties in the order in which kinds are first seen."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("kind"))
    g = g.agg(F.sum("l_quantity").cast("long").alias("size"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seen"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("supplier").orderBy(F.desc("size"), "first_seen", "kind")).cast("long"))


@query("""
select c_nationkey as nation, count(*) as customers, count(*) filter (has) as with_orders, count(*) filter (coalesce(kind = 'F', true)) as regular, count(*) filter (not coalesce(kind = 'F', true)) as mobilised
from (select c_nationkey, c_custkey in (select o_custkey from orders) as has, (select min(o_orderstatus) from orders where o_custkey = c_custkey) as kind from customer) group by 1
""")
def q_regular_vs_mobilized(spark: SparkSession, sf: str) -> DataFrame:
    """A semi-join cuts the registry to what is referred to; what is not found counts as regular."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    kinds = o.join(c, o.o_custkey == c.c_custkey, "left_semi").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("kind"))
    j = c.join(kinds, c.c_custkey == kinds.o_custkey, "left")
    regular = F.coalesce(F.col("kind") == "F", F.lit(True))
    return j.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"), F.count("kind").alias("with_orders"), F.count_if(regular).alias("regular"), F.count_if(~regular).alias("mobilised"))


@query("""
with claims as (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) as nth from lineitem)
select p_partkey as part, coalesce(s_name, p_partkey::varchar) as region from part left join claims on p_partkey = l_partkey and nth = 1 left join supplier on l_suppkey = s_suppkey
""")
def q_first_region_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The first to claim a thing has it; what nobody claims is its own."""
    line, part, s = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    claim = line.groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("who"))
    j = part.join(claim, part.p_partkey == claim.l_partkey, "left").join(s, F.col("who") == s.s_suppkey, "left")
    return j.select(F.col("p_partkey").alias("part"), F.coalesce("s_name", F.col("p_partkey").cast("string")).alias("region"))


@query("""
select case p_type when 'ECONOMY' then 'food' when 'PROMO' then 'luxury' when 'LARGE' then 'heavy' else 'other' end as category, count(*) as goods, sum(round(p_retailprice * 100)::bigint)::bigint as cents
from part group by 1
""")
def q_default_category(spark: SparkSession, sf: str) -> DataFrame:
    """A lookup that falls back to a default."""
    part = table(spark, sf, "part")
    known = spark.createDataFrame([("ECONOMY", "food"), ("PROMO", "luxury"), ("LARGE", "heavy")], "type string, category string")
    j = part.join(F.broadcast(known), part.p_type == known.type, "left")
    return j.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("goods"), F.sum(cents("p_retailprice")).alias("cents"))


@query("""
with s as (select l_orderkey, list({'n': 0::bigint, 'saved': l_quantity, 'done': false} order by l_linenumber, l_partkey, l_suppkey, l_quantity) as xs from lineitem group by 1),
f as (select l_orderkey, list_reduce(xs, lambda a, x: case when x.saved >= 30 then {'n': a.n + floor(x.saved / 30)::bigint, 'saved': 0.0, 'done': true}
    when a.saved + x.saved >= 30 then {'n': a.n + 1, 'saved': 0.0, 'done': true} else {'n': a.n, 'saved': a.saved + x.saved, 'done': true} end, {'n': 0::bigint, 'saved': 0.0::double, 'done': false}) as r from s)
select l_orderkey as nation, r.n as brigades from f
""")
def q_ordered_fold_brigades(spark: SparkSession, sf: str) -> DataFrame:
    """Brigades of pops in order, where a large pop empties what smaller ones saved up."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ordered("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("xs"))
    sizes = F.transform("xs", lambda x: x["l_quantity"])
    return g.select(F.col("l_orderkey").alias("nation"), brigades(sizes, F.lit(1.0), F.lit(30.0)).alias("brigades"))


@query("""
select l_suppkey as nation, greatest(sum(1 + floor(l_quantity / (10 * case l_returnflag when 'A' then 1.0 when 'N' then 1.5 else 3.0 end))) filter (l_quantity >= 10), count(*) filter (l_linestatus = 'F'))::bigint as cap
from lineitem group by 1
""")
def q_brigade_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Brigades that soldiers above a floor support, by kind of land, but no fewer than there are."""
    by_land = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 1.5).otherwise(3.0)
    each = F.when(F.col("l_quantity") >= 10, 1 + F.floor(F.col("l_quantity") / (10 * by_land)))
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("nation")).agg(F.greatest(F.sum(each), F.count_if(F.col("l_linestatus") == "F")).cast("long").alias("cap"))


@query("""
select l_returnflag as kind, round(sum(l_extendedprice::decimal(18,2))::double, 2) as total from lineitem group by 1
""")
def q_compensated_sum(spark: SparkSession, sf: str) -> DataFrame:
    """A sum of doubles that does not depend on their order: each order's in order with a correction, then cents."""
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("xs"))
    g = g.select("l_returnflag", F.round(compensated_sum(F.col("xs")) * 100).cast("long").alias("c"))
    return g.groupBy(F.col("l_returnflag").alias("kind")).agg(F.round(F.sum("c") / F.lit(100.0), 2).alias("total"))


@query("""
with s as (select l_partkey % 50 as good, l_suppkey, sum(l_quantity)::bigint as supply from lineitem group by all),
r as (select *, row_number() over (partition by good order by supply desc, l_suppkey) as nth from s)
select good, case when nth <= 14 then l_suppkey::varchar else 'everyone else' end as name, least(nth, 15)::int as rank, sum(supply)::bigint as supply from r group by all
""")
def q_top14_with_rest(spark: SparkSession, sf: str) -> DataFrame:
    """The fourteen largest suppliers of each good, and one row for the rest."""
    s = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 50).alias("good"), F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").cast("long").alias("supply"))
    nth = F.row_number().over(W.partitionBy("good").orderBy(F.desc("supply"), "k"))
    d = s.withColumn("rank", F.least(nth, F.lit(15))).withColumn("name", F.when(F.col("rank") <= 14, F.col("k").cast("string")).otherwise("everyone else"))
    return d.groupBy("good", "name", "rank").agg(F.sum("supply").alias("supply"))


@query("""
with s as (select l_partkey % 50 as good, l_suppkey, sum(l_quantity)::bigint as supply from lineitem group by all),
r as (select *, row_number() over (partition by good order by supply desc, l_suppkey) as nth, sum(supply) over (partition by good) as total from s)
select good, total::bigint as total, round(100.0 * sum(supply) filter (nth <= 3) / total, 3) as top3_pct from r group by good, total
""")
def q_top3_share(spark: SparkSession, sf: str) -> DataFrame:
    """What share of a good its three largest suppliers have."""
    s = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 50).alias("good"), "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("supply"))
    r = s.withColumn("nth", F.row_number().over(W.partitionBy("good").orderBy(F.desc("supply"), "l_suppkey")))
    return r.groupBy("good").agg(F.sum("supply").alias("total"), F.round(F.lit(100.0) * F.sum(F.when(F.col("nth") <= 3, F.col("supply"))) / F.sum("supply"), 3).alias("top3_pct"))


@query("""
select l_partkey % 100 as good, sum(l_quantity)::bigint as supply, sum(case when l_returnflag = 'R' then 0 else l_quantity end)::bigint as sold, bool_and(l_returnflag = 'R') as never_sold,
  round(greatest(0.0, (sum(l_quantity) - sum(case when l_returnflag = 'R' then 0 else l_quantity end)) / sum(l_quantity) * 100), 3) as unsold_pct from lineitem group by 1
""")
def q_unsold(spark: SparkSession, sf: str) -> DataFrame:
    """Goods never sold at any date, and what of the supply is left over."""
    from ..functions.scalars import unsold_percent

    sold = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))
    g = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 100).alias("good"))
    g = g.agg(F.sum("l_quantity").alias("supply"), F.sum(sold).alias("sold"), F.bool_and(F.col("l_returnflag") == "R").alias("never_sold"))
    return g.select("good", F.col("supply").cast("long").alias("supply"), F.col("sold").cast("long").alias("sold"), "never_sold", F.round(unsold_percent(F.col("supply"), F.col("sold")), 3).alias("unsold_pct"))


@query("""
select case when l_suppkey % 3 = 0 then 'attackers' when l_suppkey % 3 = 1 then 'defenders' else 'others' end as side, l_returnflag as kind, sum(l_quantity)::bigint as men, count(distinct l_suppkey) as nations,
  round(100.0 * sum(l_quantity) / sum(sum(l_quantity)) over (partition by case when l_suppkey % 3 = 0 then 'attackers' when l_suppkey % 3 = 1 then 'defenders' else 'others' end), 3) as share_pct
from lineitem group by 1, 2
""")
def q_side_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the nations of each side, and what share each kind has in it."""
    k = F.col("l_suppkey") % 3
    side = F.when(k == 0, "attackers").when(k == 1, "defenders").otherwise("others")
    g = table(spark, sf, "lineitem").groupBy(side.alias("side"), F.col("l_returnflag").alias("kind")).agg(F.sum("l_quantity").cast("long").alias("men"), F.countDistinct("l_suppkey").alias("nations"))
    return g.withColumn("share_pct", F.round(F.lit(100.0) * F.col("men") / F.sum("men").over(W.partitionBy("side")), 3))


@query("""
with t as (select l_shipdate, l_returnflag, sum(l_quantity)::bigint as n from lineitem group by all),
k as (select year(l_shipdate) * 12 + month(l_shipdate) - 1 as month, l_returnflag as kind, sum(n)::bigint as size from t group by all)
select month, kind, size, max(size) over (partition by kind) as peak, round(100.0 * size / sum(size) over (partition by month), 2) as share_pct,
 (sum(size) over (partition by month) - size)::bigint as remainder from k
""")
def q_stacked_remainder(spark: SparkSession, sf: str) -> DataFrame:
    """A stacked series: each kind's size, its peak, its share of the month and what is left beside it."""
    k = table(spark, sf, "lineitem").groupBy(month("l_shipdate").alias("month"), F.col("l_returnflag").alias("kind")).agg(F.sum("l_quantity").cast("long").alias("size"))
    whole = F.sum("size").over(W.partitionBy("month"))
    return k.select("month", "kind", "size", F.max("size").over(W.partitionBy("kind")).alias("peak"), F.round(F.lit(100.0) * F.col("size") / whole, 2).alias("share_pct"), (whole - F.col("size")).alias("remainder"))


@query("""
with x as (select l_orderkey, l_linenumber, l_quantity, 'over' as reason from lineitem where l_quantity > 40 union all select l_orderkey, l_linenumber, l_quantity, 'late' from lineitem where l_returnflag = 'R' and l_quantity <= 40
  union all select l_orderkey, l_linenumber, l_quantity, 'counted' from lineitem where l_returnflag <> 'R' and l_quantity <= 40)
select reason, count(*) as pops, sum(l_quantity)::bigint as people from x group by 1
""")
def q_excluded_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    """People left out by the first reason that holds."""
    reason = F.when(F.col("l_quantity") > 40, "over").when(F.col("l_returnflag") == "R", "late").otherwise("counted")
    return table(spark, sf, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("pops"), F.sum("l_quantity").cast("long").alias("people"))


@query("""
select n_name as nation, s_name as rival, gap, place from (select n_name, s.s_name, abs(round(s.s_acctbal * 100)::bigint - m.cents) as gap,
  row_number() over (partition by n_name order by abs(round(s.s_acctbal * 100)::bigint - m.cents), s.s_acctbal desc, s.s_name) as place
  from (select n_name, max(round(s_acctbal * 100)::bigint) as cents from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 5 = 0 group by 1) m join supplier s on s.s_suppkey % 5 <> 0) where place <= 3
""")
def q_rivals3(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest rivals of each nation by size; nations are few, and the rivals are ranked as they join."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    own = s.where("s_suppkey % 5 = 0").join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("nation")).agg(F.max(cents("s_acctbal")).alias("cents"))
    rivals = s.where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("rival"), "s_acctbal", cents("s_acctbal").alias("size"))
    near = own.join(rivals).withColumn("gap", F.abs(F.col("size") - F.col("cents")))
    place = F.row_number().over(W.partitionBy("nation").orderBy("gap", F.desc("s_acctbal"), "rival")).cast("long")
    return near.withColumn("place", place).where("place <= 3").select("nation", "rival", "gap", "place")


@query("""
select c_custkey as customer, nullif(c_acctbal, greatest(c_acctbal, 0)) as debt, row_number() over (partition by c_nationkey order by nullif(c_acctbal, greatest(c_acctbal, 0)) asc nulls last, c_custkey) as up,
  row_number() over (partition by c_nationkey order by nullif(c_acctbal, greatest(c_acctbal, 0)) desc nulls last, c_custkey) as down from customer
""")
def q_nulls_last_sort_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Places within a nation in either direction, with nulls last in both."""
    c = table(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").alias("customer"), F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("debt"))
    one = W.partitionBy("c_nationkey")
    up, down = (F.row_number().over(one.orderBy(o, "customer")).cast("long") for o in (F.asc_nulls_last("debt"), F.desc_nulls_last("debt")))
    return c.select("customer", "debt", up.alias("up"), down.alias("down"))


@query("""
with p as (select l_orderkey, list(distinct l_partkey order by l_partkey) as parts, sum(l_quantity)::bigint as q from lineitem group by 1)
select dense_rank() over (order by size) as profile, size, count(*) as orders, sum(q)::bigint as people from (select len(parts) as size, q from p) group by size
""")
def q_dictionary_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Equal profiles get one number."""
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("size"), F.sum("l_quantity").cast("long").alias("q"))
    g = p.groupBy("size").agg(F.count("*").alias("orders"), F.sum("q").alias("people"))
    return g.select(F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("size")).cast("long").alias("profile"), "size", "orders", "people")


@query("""
select o_custkey as customer, date_trunc('month', o_orderdate) as month, o_orderkey as newest, o_orderstatus as status from orders
qualify row_number() over (partition by o_custkey, date_trunc('month', o_orderdate) order by o_orderdate desc, o_orderkey desc) = 1
""")
def q_latest_wins_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Of records of one month, the newest counts."""
    o = table(spark, sf, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    return latest_wins(o, ["o_custkey", "month"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("customer"), "month", F.col("o_orderkey").alias("newest"), F.col("o_orderstatus").alias("status"))


@query("""
with s as (select p_type as kind, p_brand as name, count(*) as n from part group by all), r as (select *, row_number() over (partition by kind order by n desc, name) as nth from s)
select kind, case when nth <= 5 then name else 'everyone else' end as name, least(nth, 6)::int as rank, sum(n)::bigint as n from r group by all
""")
def q_pie_remainder(spark: SparkSession, sf: str) -> DataFrame:
    """A pie of the five largest and a slice for everyone else."""
    s = table(spark, sf, "part").groupBy(F.col("p_type").alias("kind"), F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return top_with_rest(s, ["kind"], "name", "n", 5)
