"""Readings in time: gains, growth, changes, as-of and interval joins, alignment of campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import asof as A
from ..operators import series as S
from .base import cents, month, query, table


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), month("o_orderdate").alias("month")).agg(F.sum(cents("o_totalprice")).alias("cents"))


MONTHLY = "m as (select c_nationkey as nation, year(o_orderdate) * 12 + month(o_orderdate) - 1 as month, sum(round(o_totalprice * 100)::bigint)::bigint as cents from orders join customer on o_custkey = c_custkey group by all)"


@query(f"""
with {MONTHLY}, n as (select nation, month, case when month % 5 <> 0 then cents end as value from m)
select nation, month, (value - lag(value ignore nulls) over (partition by nation order by month))::double as gain from n
""")
def q_monthly_gain(spark: SparkSession, sf: str) -> DataFrame:
    """What a reading has gained on the last one that is not null."""
    n = _monthly(spark, sf).withColumn("value", F.when(F.col("month") % 5 != 0, F.col("cents")))
    return n.select("nation", "month", S.gain(n, ["nation"], "month", "value").cast("double").alias("gain"))


@query(f"""
with recursive {MONTHLY}, p as (select nation, month, cents::double as v, row_number() over (partition by nation order by month) as nth from m where cents > 0),
w as (select nation, nth, month, month as anchor, v as base, null::double as growth from p where nth = 1
  union all select p.nation, p.nth, p.month, case when p.month - w.anchor >= 3 then p.month else w.anchor end, case when p.month - w.anchor >= 3 then p.v else w.base end,
    case when p.month - w.anchor >= 3 then (pow(p.v / w.base, 12.0 / (p.month - w.anchor)) - 1) * 100 end from w join p on p.nation = w.nation and p.nth = w.nth + 1)
select nation, month, round(growth, 4) as growth from w
""")
def q_anchor_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Percent a year against an anchor that moves only after a quarter of a year."""
    m = _monthly(spark, sf).withColumn("t", F.col("month") / F.lit(12.0))
    g = S.anchored_growth(m.select("nation", F.col("month").cast("double").alias("month"), F.col("cents").alias("v")), ["nation"], "month", "v", 3.0)
    # the fold counts in months: a year's growth is the twelfth power of a month's
    yearly = (F.pow(F.col("growth") / 100 + 1, F.lit(12.0)) - 1) * 100
    return g.select("nation", F.col("month").cast("long").alias("month"), F.round(yearly, 4).alias("growth"))


@query(f"""
with {MONTHLY} select nation, month, round(cents * 100.0 / first_value(cents) over (partition by nation order by month), 4) as index,
  round((last_value(cents) over w - first_value(cents) over w) * 100.0 / first_value(cents) over w, 4) as change_pct, round(abs(last_value(cents) over w - first_value(cents) over w)::double / first_value(cents) over w, 4) as movement
from m window w as (partition by nation order by month rows between unbounded preceding and unbounded following)
""")
def q_rebase_100(spark: SparkSession, sf: str) -> DataFrame:
    """A series as an index of 100 at its first reading, and its change from first to last."""
    m = _monthly(spark, sf)
    w = W.partitionBy("nation").orderBy("month").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first("cents").over(w), F.last("cents").over(w)
    return m.select("nation", "month", F.round(S.rebase(["nation"], "month", "cents"), 4).alias("index"), F.round((last - first) * 100.0 / first, 4).alias("change_pct"), F.round(F.abs(last - first).cast("double") / first, 4).alias("movement"))


@query(f"""
with {MONTHLY} select nation, (month // 12)::bigint as year, max(month) as month, arg_max(cents, month) as cents from m group by nation, month // 12
""")
def q_last_of_year(spark: SparkSession, sf: str) -> DataFrame:
    """The last reading of each year."""
    m = _monthly(spark, sf)
    return m.groupBy("nation", F.floor(F.col("month") / 12).cast("long").alias("year")).agg(F.max("month").alias("month"), F.max_by("cents", "month").alias("cents"))


@query(f"""
with {MONTHLY} select a.nation, b.month, m.cents::double as cents from (select distinct nation from m) a cross join (select distinct month from m) b left join m on m.nation = a.nation and m.month = b.month
""")
def q_densify_series(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation at every date, with gaps where it has no reading."""
    m = _monthly(spark, sf)
    return S.densify(m, [m.select("nation").distinct(), m.select("month").distinct()], ["nation", "month"]).select("nation", "month", F.col("cents").cast("double").alias("cents"))


def _daily_state(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("day", F.dayofyear("ts").cast("long"))
    return e.groupBy("user_id", "day").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("owner"))


STATE = "s as (select user_id, dayofyear(ts) as day, arg_max(event_type, (ts, event_id)) as owner from events group by all)"


@query(f"""
with {STATE}, l as (select *, lag(owner) over (partition by user_id order by day) as before, row_number() over (partition by user_id order by day) as nth from s)
select user_id, day, owner, before from l where nth = 1 or owner is distinct from before
""")
def q_owner_cdc(spark: SparkSession, sf: str) -> DataFrame:
    """The days on which a province's owner changes, with the owner before."""
    return S.changes(_daily_state(spark, sf), ["user_id"], "day", "owner")


@query(f"""
with {STATE} select user_id, g.day, (select arg_max(owner, day) from s where s.user_id = u.user_id and s.day <= g.day) as owner from (select distinct user_id from s) u cross join (select unnest(range(1, 31))::bigint as day) g
""")
def q_cdc_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every province's owner on every day, replayed from the changes."""
    s = _daily_state(spark, sf)
    grid = s.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))).alias("day"))
    return S.replay(S.changes(s, ["user_id"], "day", "owner"), grid, ["user_id"], "day", "owner").select("user_id", "day", "owner")


def _wars_and_ledger(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("tick"), "event_type", "value")
    wars = e.where("event_type = 'purchase'").select("user_id", "tick")
    return wars, e.where("event_type = 'view'").select("user_id", "tick", F.col("tick").alias("save"), "value")


WARS = "w as (select user_id, event_id as tick from events where event_type = 'purchase'), v as (select user_id, event_id as tick, value from events where event_type = 'view')"


@query(f"""
with {WARS} select w.user_id, w.tick, coalesce((select max(tick) from v where v.user_id = w.user_id and v.tick <= w.tick), (select min(tick) from v where v.user_id = w.user_id))::double as save from w
""")
def q_asof_ledger_before(spark: SparkSession, sf: str) -> DataFrame:
    """The last ledger at or before a war's start, or else the first there is."""
    wars, ledger = _wars_and_ledger(spark, sf)
    return A.asof(wars, ledger, ["user_id"], "tick", ["save"], clamp=True).select("user_id", "tick", F.col("save").cast("double").alias("save"))


@query(f"""
with {WARS} select w.user_id, w.tick, coalesce((select min(tick) from v where v.user_id = w.user_id and v.tick >= w.tick), (select max(tick) from v where v.user_id = w.user_id))::double as save from w
""")
def q_asof_ledger_after(spark: SparkSession, sf: str) -> DataFrame:
    """The first ledger at or after a war's end, or else the last there is."""
    wars, ledger = _wars_and_ledger(spark, sf)
    return A.asof(wars, ledger, ["user_id"], "tick", ["save"], forward=True, clamp=True).select("user_id", "tick", F.col("save").cast("double").alias("save"))


@query(f"""
with {WARS}, b as (select w.user_id, w.tick, (select max(tick) from v where v.user_id = w.user_id and v.tick <= w.tick and w.tick - v.tick <= 200) as near, (select min(tick) from v where v.user_id = w.user_id and v.tick > w.tick) as later from w)
select user_id, tick, coalesce(near, later)::double as save from b
""")
def q_opening_save(spark: SparkSession, sf: str) -> DataFrame:
    """The save a war opens with: the last one before within a tolerance, else the first after."""
    wars, ledger = _wars_and_ledger(spark, sf)
    near = A.asof(wars, ledger, ["user_id"], "tick", ["save"], tolerance=200.0).withColumnRenamed("save", "near")
    later = A.asof(near, ledger, ["user_id"], "tick", ["save"], forward=True)
    return later.select("user_id", "tick", F.coalesce("near", "save").cast("double").alias("save"))


@query(f"""
with {WARS} select w.user_id, w.tick, (select arg_min(tick, (abs(v.tick - w.tick), v.tick)) from v where v.user_id = w.user_id)::double as save from w
""")
def q_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The save nearest to a date, the earlier of two."""
    wars, ledger = _wars_and_ledger(spark, sf)
    return A.nearest(wars, ledger, ["user_id"], "tick", ["save"]).select("user_id", "tick", F.col("save").cast("double").alias("save"))


@query("""
with w as (select user_id, event_type, min(event_id) as first, max(event_id) as last from events group by all)
select d.at, count(*) as running from (select unnest(range(0, (select max(event_id) + 1 from events), 100))::bigint as at) d join w on d.at between w.first and w.last group by 1
""")
def q_interval_running(spark: SparkSession, sf: str) -> DataFrame:
    """How many wars run on a date: counted by where they begin and end, not by pairs of dates and wars."""
    e = table(spark, sf, "events")
    wars = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    return A.running(wars, "first", "last", e.agg(F.max("event_id").alias("now")), 100)


@query("""
with p as (select dayofyear(ts) as day, user_id % 7 as pid, user_id, user_id % 2 as side, count(*) as men from events group by all)
select a.day, a.pid, sum(a.men)::bigint as men, count(distinct a.user_id) as nations from p a where exists (select 1 from p b where b.day = a.day and b.pid = a.pid and b.side <> a.side) group by 1, 2
""")
def q_contested(spark: SparkSession, sf: str) -> DataFrame:
    """Provinces where armies of opposite sides stand on a day: found by the sides there, not by pairs of armies."""
    p = table(spark, sf, "events").groupBy(F.dayofyear("ts").cast("long").alias("day"), (F.col("user_id") % 7).alias("pid"), "user_id").agg(F.count("*").alias("men"))
    g = p.groupBy("day", "pid").agg(F.sum("men").alias("men"), F.countDistinct("user_id").alias("nations"), F.countDistinct(F.col("user_id") % 2).alias("sides"))
    return g.where("sides > 1").select("day", "pid", "men", "nations")


@query("""
select user_id, event_id, event_type, date_diff('second', date_trunc('second', ts), date_trunc('second', lead(ts) over (partition by user_id order by event_id)))::double as until_next, row_number() over (partition by user_id, event_type, dayofyear(ts) order by event_id) as nth
from events
""")
def q_nth_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers the battles that look alike within a war, and how long until the next one."""
    e = table(spark, sf, "events")
    second = F.date_trunc("second", "ts").cast("long")
    until = (F.lead(second).over(W.partitionBy("user_id").orderBy("event_id")) - second).cast("double")
    return e.select("user_id", "event_id", "event_type", until.alias("until_next"), F.row_number().over(W.partitionBy("user_id", "event_type", F.dayofyear("ts")).orderBy("event_id")).cast("long").alias("nth"))


@query("""
with s as (select user_id, min(event_id) as first, max(event_id) as last from events group by 1), d as (select e.user_id, e.event_id - s.first as since, e.value, e.event_id from events e join s using (user_id))
select user_id, count(*) as readings, max(since) as span, (select min(m) from (select max(event_id - first) as m from events join s using (user_id) group by user_id)) as last_common,
  count(*) filter (since <= (select min(m) from (select max(event_id - first) as m from events join s using (user_id) group by user_id))) as shared from d group by 1
""")
def q_align_campaign_time(spark: SparkSession, sf: str) -> DataFrame:
    """Campaigns laid over each other by time since their start, and the last moment that all of them reach."""
    e = table(spark, sf, "events")
    d = e.withColumn("since", F.col("event_id") - F.min("event_id").over(W.partitionBy("user_id")))
    spans = d.groupBy("user_id").agg(F.max("since").alias("span"))
    common = spans.agg(F.min("span").alias("last_common"))
    j = d.join(F.broadcast(common))
    return j.groupBy("user_id", "last_common").agg(F.count("*").alias("readings"), F.max("since").alias("span"), F.count_if(F.col("since") <= F.col("last_common")).alias("shared")).select("user_id", "readings", "span", "last_common", "shared")


@query("""
with recursive r as (select user_id, event_type, event_id as s, event_id + (value * 20)::bigint as e, row_number() over (partition by user_id, event_type order by event_id) as nth from events),
w as (select user_id, event_type, nth, s, e as until, 1 as war from r where nth = 1
  union all select r.user_id, r.event_type, r.nth, r.s, greatest(w.until, r.e), case when r.s <= w.until then w.war else w.war + 1 end from w join r on r.user_id = w.user_id and r.event_type = w.event_type and r.nth = w.nth + 1)
select user_id, event_type, war, count(*) as records, min(s) as start, max(until) as until from w group by all
""")
def q_overlap_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one war from many saves, merged where their spans meet."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("s"), (F.col("event_id") + F.round(F.col("value") * 20).cast("long")).alias("e"))
    w = W.partitionBy("user_id", "event_type").orderBy("s")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("s") <= reach, 0).otherwise(1)
    d = e.withColumn("new", new).withColumn("war", F.sum("new").over(w).cast("int"))
    return d.groupBy("user_id", "event_type", "war").agg(F.count("*").alias("records"), F.min("s").alias("start"), F.max("e").alias("until"))


@query("""
select user_id, max(event_id) as last_battle, (select max(event_id) from events) - max(event_id) as quiet_for, (select max(event_id) from events) - max(event_id) > 50 as quiet, greatest(max(event_id) filter (event_type = 'view'), max(event_id))::double as fixed_end from events group by 1
""")
def q_quiet_wars(spark: SparkSession, sf: str) -> DataFrame:
    """Wars without a battle for long at the last save; an end is never before the last battle."""
    e = table(spark, sf, "events")
    g = e.groupBy("user_id").agg(F.max("event_id").alias("last_battle"), F.greatest(F.max(F.when(F.col("event_type") == "view", F.col("event_id"))), F.max("event_id")).cast("double").alias("fixed_end"))
    g = g.join(F.broadcast(e.agg(F.max("event_id").alias("now"))))
    quiet = F.col("now") - F.col("last_battle")
    return g.select("user_id", "last_battle", quiet.alias("quiet_for"), (quiet > 50).alias("quiet"), "fixed_end")
