"""A campaign's gold tables, from the tables of its snapshots (see sources.saves.tables) and small tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import half_even, month_shift, year_of
from ..operators.folds import brigades
from ..operators.series import anchored_growth, gain, latest_wins

#: Fixed: the strata where the rules have none.
STRATA = {"poor": ["farmers", "labourers", "slaves", "craftsmen", "soldiers", "serfs"], "middle": ["artisans", "bureaucrats", "clergymen", "clerks", "officers"], "rich": ["aristocrats", "capitalists"]}
#: Fixed: who can be mobilised where the rules don't tell.
MOBILISED = ("farmers", "labourers", "craftsmen")


def share(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, half_even(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))


def people(t: dict[str, DataFrame]) -> DataFrame:
    """Each population group with its owner, whether its culture is accepted, its state is colonial, it is occupied."""
    p = t["province"].select("save_id", "prov_ord", "owner", F.coalesce(F.nullif("controller", F.lit("")), "owner").alias("controller"), F.col("colonial").alias("own_level"), F.array_contains("cores", F.col("owner")).alias("is_core")).where("owner is not null and owner <> ''")
    accepted = t["country_list"].where("list = 'culture'").groupBy("save_id", F.col("tag").alias("owner")).agg(F.sort_array(F.collect_set("name")).alias("accepted"))
    own = t["country"].select("save_id", F.col("tag").alias("owner"), "primary_culture")
    colonial = t["state"].where("is_colonial > 0").select("save_id", F.col("tag").alias("owner"), F.explode("provinces").alias("pid"), "is_colonial").groupBy("save_id", "owner", "pid").agg(F.lit(True).alias("colonial_state"), F.max("is_colonial").alias("state_level"))
    x = t["pop"].join(p, ["save_id", "prov_ord"]).join(own, ["save_id", "owner"], "left").join(accepted, ["save_id", "owner"], "left").join(colonial, ["save_id", "owner", "pid"], "left")
    is_accepted = F.coalesce((F.col("culture") == F.col("primary_culture")) | F.array_contains("accepted", F.col("culture")), F.lit(False))
    return x.withColumn("is_accepted", is_accepted).withColumn("colonial_state", F.coalesce("colonial_state", F.lit(False))).withColumn("occupied", F.col("controller") != F.col("owner"))


def world_population(t: dict[str, DataFrame]) -> DataFrame:
    """The people of every province of a save, owned or not."""
    return t["pop"].groupBy("save_id").agg(F.sum("size").alias("world_pop"))


def nations(t: dict[str, DataFrame], per: float = 3000.0, rate: Column | None = None, mob_types=MOBILISED, occupied_too: bool = False, least: int = 1000, colony: float = 1.0, noncore: float = 1.0, protectorate: float = 1.0, tags: list[str] | None = None, min_pop: int = 0) -> DataFrame:
    """The fact table of nations by save: provinces, people, shares and averages, units, buildings, mobilisation.

    rate: the share of people that mobilise, a column of a nation's row (none by default). A nation has provinces.
    Of soldiers, each group of at least ``least`` supports one brigade and one more for each ``per`` people, times the
    rules' factor for protectorates (colonial level 1), other colonies, or provinces that are no core of their owner.
    """
    rate = F.lit(0.0) if rate is None else rate
    p = t["province"].where("owner is not null and owner <> ''").groupBy("save_id", F.col("owner").alias("tag")).agg(
        F.count("*").alias("provinces"), F.count_if(F.col("naval_base") > 0).alias("ports"), F.sum("naval_base").alias("naval_base_levels"), F.max("naval_base").alias("max_naval_base"),
        F.sum("railroad").alias("railroad_levels"), F.sum("fort").alias("fort_levels"), F.min("prov_ord").alias("first_seen"),
    )
    x = people(t)
    n, soldiers = F.col("size"), F.col("pop_type") == "soldiers"
    stratum = {k: F.sum(F.when(F.col("pop_type").isin(v), n).otherwise(0)).alias(f"pop_{k}") for k, v in STRATA.items()}
    mobile = F.col("pop_type").isin(*mob_types) & F.col("is_accepted") & ~F.col("colonial_state") & (F.lit(occupied_too) | ~F.col("occupied"))
    mean = lambda c, k: half_even(F.sum(F.coalesce(c, F.lit(0.0)) * n) / F.sum(n), k)
    home = F.when(~F.col("colonial_state"), n).otherwise(0)
    level = F.when(F.col("own_level") != 0, F.col("own_level")).otherwise(F.coalesce("state_level", F.lit(0)))
    times = F.when(level == 1, F.lit(protectorate)).when(level != 0, F.lit(colony)).when(~F.coalesce("is_core", F.lit(False)), F.lit(noncore)).otherwise(F.lit(1.0))
    g = x.groupBy("save_id", F.col("owner").alias("tag")).agg(
        F.sum(n).alias("total_pop"), F.sum(home).alias("pop_noncolonial"), mean(F.col("literacy"), 5).alias("avg_literacy"), mean(F.col("con"), 4).alias("avg_consciousness"), mean(F.col("mil"), 4).alias("avg_militancy"),
        half_even(F.sum(F.coalesce("literacy", F.lit(0.0)) * home) / F.nullif(F.sum(home), F.lit(0)), 5).alias("avg_literacy_stated"), F.sum(F.when(F.col("is_accepted"), n).otherwise(0)).alias("accepted_pop"),
        F.sum(F.when(F.col("culture") == F.col("primary_culture"), n).otherwise(0)).alias("primary_culture_pop"), F.sum(F.when(F.col("life_needs") < 1.0, n).otherwise(0)).alias("life_unmet"),
        F.sum(F.when(F.col("life_needs") < 0.05, n).otherwise(0)).alias("starving"), F.sum(F.when(soldiers & ~F.col("colonial_state"), n).otherwise(0)).alias("soldiers_noncolonial"), *stratum.values(),
        F.sum(F.when(soldiers & (n >= least), 1 + F.floor(n / (per * times))).otherwise(0)).alias("supported"), F.sum(F.when(mobile, n).otherwise(0)).alias("mobilization_pool"), F.count_if(mobile).alias("mobilization_pops"),
        F.array_sort(F.collect_list(F.when(mobile, F.struct("prov_ord", "pop_ord", "size")))).alias("mobile"),
    )
    kinds = t["pop"].select("save_id", F.col("id").alias("pop_id"), "pop_type").join(t["unit"].where("unit = 'regiment'").select("save_id", "pop_id"), ["save_id", "pop_id"], "left_semi").dropDuplicates(["save_id", "pop_id"])
    r = t["unit"].where("unit = 'regiment'").join(kinds, ["save_id", "pop_id"], "left").withColumn("regular", F.coalesce(F.col("pop_type") == "soldiers", F.lit(True)))
    r = r.groupBy("save_id", "tag").agg(F.count("*").alias("brigades"), F.count_if("regular").alias("regular_brigades"), F.count_if(~F.col("regular")).alias("mobilized_brigades"))
    ships = t["unit"].where("unit = 'ship'").groupBy("save_id", "tag").agg(F.count("*").alias("ships"))
    st = t["state"].groupBy("save_id", "tag").agg(F.count("*").alias("states"), F.sum("factories").alias("factory_count"), F.sum(F.aggregate("levels", F.lit(0.0), lambda a, b: a + b)).cast("long").alias("factory_levels"))
    tech = t["country_list"].where("list = 'technology' and bare").groupBy("save_id", "tag", "name").agg(F.min_by("value", "ord").alias("v")).where("v = '1'").groupBy("save_id", "tag").agg(F.count("*").alias("techs"))
    accepted = t["country_list"].where("list = 'culture'").groupBy("save_id", "tag").agg(F.array_join(F.sort_array(F.collect_set("name")), ";").alias("accepted_cultures"))
    on = ["save_id", "tag"]
    d = p.join(g, on, "left").join(t["country"].drop("ord"), on, "left").join(r, on, "left").join(ships, on, "left").join(st, on, "left").join(tech, on, "left").join(accepted, on, "left").join(t["saves"], "save_id")
    counted = ["total_pop", "brigades", "regular_brigades", "mobilized_brigades", "ships", "states", "factory_count", "factory_levels", "techs", "supported", "accepted_pop", "soldiers_noncolonial", "life_unmet", "starving"]
    d = d.na.fill(0, counted).where(F.col("total_pop") >= min_pop)
    if tags:
        d = d.where(F.col("tag").isin(tags))
    human = F.max(F.when(F.col("human") == "yes", 1)).over(W.partitionBy("save_id"))
    d = d.withColumns({
        "year": year_of(F.col("date")), "is_player": F.when(human == 1, F.coalesce(F.col("human") == "yes", F.lit(False))).otherwise(F.coalesce(F.col("tag") == F.col("player"), F.lit(False))),
        "accepted_pct": share(F.col("accepted_pop"), F.col("total_pop"), 2), "life_unmet_pct": share(F.col("life_unmet"), F.col("total_pop"), 3), "starving_pct": share(F.col("starving"), F.col("total_pop"), 3),
        "soldiers_noncolonial_pct": share(F.col("soldiers_noncolonial"), F.col("total_pop"), 3), "brigade_cap": F.greatest("supported", "regular_brigades"), "is_mobilized": F.coalesce(F.col("mobilize") == "yes", F.lit(False)),
        "mobilization_brigades": F.coalesce(brigades(F.transform("mobile", lambda s: s["size"]), rate, F.lit(float(per))), F.lit(0).cast("long")),
    })
    return d.drop("mobile", "supported", "human", "mobilize")


def long_counts(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """pops_by_type, pops_by_culture (largest first, ties as first seen), ships_by_type, brigades_by_type."""
    x, u = people(t), t["unit"]
    stamp = t["saves"].select("save_id", "date")
    by_type = x.groupBy("save_id", F.col("owner").alias("tag"), "pop_type").agg(F.sum("size").alias("size")).join(stamp, "save_id")
    by_culture = x.groupBy("save_id", F.col("owner").alias("tag"), "culture").agg(F.sum("size").alias("size"), F.max(F.col("is_accepted").cast("int")).alias("accepted"), F.min(F.struct("prov_ord", "pop_ord")).alias("seen"))
    by_culture = by_culture.withColumn("place", F.row_number().over(W.partitionBy("save_id", "tag").orderBy(F.desc("size"), "seen"))).drop("seen").join(stamp, "save_id")
    crew = F.greatest(F.coalesce("strength", F.lit(100.0)), F.lit(0.0)) / (1 - F.least(F.greatest(F.col("experience"), F.lit(0.0)), F.lit(0.95)))
    ships = u.where("unit = 'ship'").groupBy("save_id", "tag", F.col("kind").alias("ship_type")).agg(F.count("*").alias("count"), half_even(F.sum(crew) / 100, 3).alias("effective")).join(stamp, "save_id")
    regiments = u.where("unit = 'regiment'").groupBy("save_id", "tag", F.col("kind").alias("regiment_type")).agg(F.count("*").alias("count")).join(stamp, "save_id")
    return {"pops_by_type": by_type, "pops_by_culture": by_culture, "ships_by_type": ships, "brigades_by_type": regiments}


def prices(t: dict[str, DataFrame], last_update: DataFrame) -> DataFrame:
    """date, good, price: current prices and each save's monthly history, where the newest save wins a month.

    last_update: save_id, stamp of the newest month of its history. History blocks are in order, oldest first.
    """
    h = t["market"].where("pool = 'price_history' and good is not null")
    block = F.dense_rank().over(W.partitionBy("save_id").orderBy(F.desc("block"))) - 1
    h = h.withColumn("back", block).join(last_update, "save_id").select("save_id", month_shift(F.col("stamp"), F.col("back")).alias("date"), "good", "value", F.lit(0).alias("current"))
    now = t["market"].where("pool = 'price_pool' and good is not null").join(t["saves"].select("save_id", "date"), "save_id").select("save_id", "date", "good", "value", F.lit(1).alias("current"))
    both = h.union(now).join(t["saves"].select("save_id", "year_frac"), "save_id")
    best = latest_wins(both, ["date", "good"], [F.desc("year_frac"), F.desc("current")])
    return best.select("date", year_of(F.col("date")).alias("year"), "good", half_even(F.col("value"), 5).alias("price"))


def market_snapshot(t: dict[str, DataFrame]) -> DataFrame:
    """Each save's goods with their price, pools, and whether they are discovered and pegged (a demand over 1e9)."""
    pools = {"price_pool": "price", "worldmarket_pool": "world_pool", "supply_pool": "supply", "demand": "demand", "real_demand": "real_demand", "actual_sold": "actual_sold", "discovered_goods": "discovered"}
    m = t["market"].where(F.col("pool").isin(*pools) & F.col("good").isNotNull())
    g = m.groupBy("save_id", "good").pivot("pool", list(pools)).agg(F.max_by("value", "ord"))
    for a, b in pools.items():
        g = g.withColumnRenamed(a, b)
    g = g.withColumns({c: half_even(F.coalesce(c, F.lit(0.0)), 5 if c == "price" else 3) for c in pools.values()}).withColumns({"discovered": F.col("discovered") > 0, "pegged": F.col("demand") > 1e9})
    return g.join(t["saves"].select("save_id", "date"), "save_id")


def ownership_changes(t: dict[str, DataFrame]) -> DataFrame:
    """save_id, pid, owner, before: provinces whose owner is another than at the campaign's previous save."""
    p = t["province"].join(t["saves"].select("save_id", "campaign", "year_frac"), "save_id")
    w = W.partitionBy("campaign", "pid").orderBy("year_frac")
    p = p.withColumn("before", F.lag("owner").over(w)).withColumn("first", F.row_number().over(w) == 1)
    return p.where(F.col("first") | ~F.col("owner").eqNullSafe(F.col("before"))).select("campaign", "save_id", "pid", "owner", "before")


def successions(t: dict[str, DataFrame], may_form: DataFrame, least: float = 0.5) -> DataFrame:
    """campaign, save_id, old, new, share: nations that vanish as another appears on at least half of their land.

    may_form: old, new: who may form whom by decision. Otherwise the new nation must accept the old one's culture.
    """
    p = t["province"].where("owner <> ''").join(t["saves"].select("save_id", "campaign", "year_frac"), "save_id")
    nth = p.select("campaign", "save_id", "year_frac").distinct().withColumn("nth", F.row_number().over(W.partitionBy("campaign").orderBy("year_frac")))
    p = p.join(nth.select("save_id", "nth"), "save_id").select("campaign", "save_id", "nth", "pid", "owner")
    land = p.groupBy("campaign", "nth", "owner").agg(F.count("*").alias("n"))
    after = land.select("campaign", (F.col("nth") - 1).alias("nth"), "owner")
    before = land.select("campaign", (F.col("nth") + 1).alias("nth"), "owner")
    gone = land.join(after, ["campaign", "nth", "owner"], "left_anti").withColumnRenamed("owner", "old")
    new = land.join(before, ["campaign", "nth", "owner"], "left_anti").where("nth > 1").select("campaign", "nth", F.col("owner").alias("new"))
    had = p.select("campaign", (F.col("nth") + 1).alias("nth"), "pid", F.col("owner").alias("old"))
    shared = p.withColumnRenamed("owner", "new").join(had, ["campaign", "nth", "pid"]).where("old <> new").groupBy("campaign", "save_id", "nth", "old", "new").agg(F.count("*").alias("shared"))
    s = shared.join(new, ["campaign", "nth", "new"]).join(gone.select("campaign", (F.col("nth") + 1).alias("nth"), "old", "n"), ["campaign", "nth", "old"]).where(F.col("shared") >= least * F.col("n"))
    home = t["country"].join(t["saves"].select("save_id", "campaign"), "save_id").groupBy("campaign", F.col("tag").alias("old")).agg(F.max("primary_culture").alias("culture"))
    takes = t["country"].select("save_id", F.col("tag").alias("new"), F.col("primary_culture").alias("culture")).union(t["country_list"].where("list = 'culture'").select("save_id", F.col("tag").alias("new"), F.col("name").alias("culture"))).distinct()
    s = s.join(home, ["campaign", "old"], "left").join(takes.withColumn("accepts", F.lit(True)), ["save_id", "new", "culture"], "left").join(may_form.select("old", "new", F.lit(True).alias("may")), ["old", "new"], "left")
    return s.where("coalesce(accepts, may, false)").select("campaign", "save_id", "old", "new", half_even(F.col("shared") / F.col("n"), 4).alias("share"))


def war_records(t: dict[str, DataFrame]) -> DataFrame:
    """The records of wars in all saves, numbered (war) so that those of one war, by its name and leaders, have one number.

    They are one war where their spans meet. An open record reaches to the end of time.
    """
    w = t["war"].join(t["saves"].select("save_id", "campaign", "year_frac"), "save_id").where("start is not null")
    key = ["campaign", "name", "attacker", "defender"]
    w = w.withColumn("reach", F.when(F.col("active"), F.lit(9999.0)).otherwise(F.coalesce("until", "start")))
    by = W.partitionBy(*key).orderBy("start", "year_frac")
    new = F.when(F.col("start") <= F.max("reach").over(by.rowsBetween(W.unboundedPreceding, -1)), 0).otherwise(1)
    return w.withColumn("_new_", new).withColumn("war", F.sum("_new_").over(by)).drop("_new_", "reach")


def war_book(t: dict[str, DataFrame]) -> DataFrame:
    """Each war once. Start is the first, end that of a closed record, active if none is closed."""
    return war_records(t).groupBy("campaign", "name", "attacker", "defender", "war").agg(F.min("start").alias("start"), F.max(F.when(~F.col("active"), F.col("until"))).alias("until"), F.bool_and("active").alias("active"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("parties")))).alias("parties"), F.count("*").alias("records"))


def great_powers(t: dict[str, DataFrame]) -> DataFrame:
    """save_id, rank, tag: the save's list of great powers are numbers, from 1, in the order of its countries."""
    nth = t["country"].select("save_id", "tag", F.row_number().over(W.partitionBy("save_id").orderBy("ord")).alias("country_index"))
    return t["great_nation"].join(nth, ["save_id", "country_index"]).select("save_id", "rank", "tag")


def growth(n: DataFrame, measure: str, span: float = 0.25) -> DataFrame:
    """campaign, tag, year_frac, growth: percent a year of a measure against an anchor at least ``span`` years old."""
    return anchored_growth(n, ["campaign", "tag"], "year_frac", measure, span)


def gains(n: DataFrame, measure: str) -> DataFrame:
    """n with gain: what a measure gained since its last reading."""
    return n.withColumn("gain", half_even(gain(n, ["campaign", "tag"], "year_frac", measure).cast("double"), 4))


def across_campaigns(n: DataFrame) -> DataFrame:
    """Nations of at least two campaigns, with the time since their campaign began and the last that all reach."""
    many = n.groupBy("tag").agg(F.count_distinct("campaign").alias("campaigns")).where("campaigns >= 2").select("tag")
    since = n.withColumn("elapsed", F.col("year_frac") - F.min("year_frac").over(W.partitionBy("campaign")))
    ends = since.groupBy("campaign").agg(F.max("elapsed").alias("e")).agg(F.min("e").alias("last_common"))
    return since.join(many, "tag").join(F.broadcast(ends))
