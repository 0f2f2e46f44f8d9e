"""The wars of a campaign, merged from the records of all its saves: battles, parties, goals and what came of them.

A war's key is that of campaign.war_records(): campaign, name, attacker, defender, war.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import year_fraction
from ..operators.asof import asof
from ..operators.series import latest_wins
from .campaign import war_records

KEY = ["campaign", "name", "attacker", "defender", "war"]


def _of_wars(records: DataFrame, part: DataFrame) -> DataFrame:
    return part.join(records.select(*KEY, "save_id", "war_ord", "year_frac"), ["save_id", "war_ord"])


def battles(records: DataFrame, part: DataFrame) -> DataFrame:
    """Each battle of a war once, as the first save with it has it, with the first date that a save gives it.

    A battle is known by its name, place and both losses; alike ones of one save are told apart by their number in it.
    """
    alike = ["battle_name", "location", "a_losses", "d_losses"]
    b = _of_wars(records, part.withColumnRenamed("name", "battle_name"))
    b = b.withColumn("nth", F.row_number().over(W.partitionBy("save_id", "war_ord", *alike).orderBy("battle")))
    rest = ["won", "a_country", "a_leader", "a_units", "d_country", "d_leader", "d_units"]
    date = F.min_by("date", F.when(F.col("date").isNotNull(), F.col("year_frac")))
    first = F.min_by(F.struct(*rest), F.col("year_frac"))
    return b.groupBy(*KEY, *alike, "nth").agg(date.alias("date"), first.alias("_first_")).select(*KEY, *alike, "nth", "date", "_first_.*")


def at_sea(fought: DataFrame, kinds: DataFrame) -> DataFrame:
    """fought with sea: whether the first unit of known kind, the attacker's before the defender's, is naval.

    kinds: unit, kind (land, naval or another); a battle without such a unit was on land.
    """
    key = [*KEY, "battle_name", "location", "a_losses", "d_losses", "nth"]
    u = fought.select(*key, F.posexplode(F.concat("a_units", "d_units")).alias("ord", "u")).select(*key, "ord", F.col("u.unit").alias("unit"))
    sure = u.join(kinds.where("kind in ('land', 'naval')").dropDuplicates(["unit"]), "unit")
    return fought.join(sure.groupBy(*key).agg((F.min_by("kind", "ord") == "naval").alias("sea")), key, "left").na.fill(False, ["sea"])


def unit_list(units: Column) -> Column:
    """``kind:n;kind:n``, the most first, those of one number as they stand."""
    places = F.transform(units, lambda u, i: F.struct((-u["n"]).alias("less"), i.alias("i"), F.concat_ws(":", u["unit"], u["n"].cast("string")).alias("text")))
    return F.array_join(F.transform(F.array_sort(places), lambda p: p["text"]), ";")


def spans(records: DataFrame, moves: DataFrame, fought: DataFrame) -> DataFrame:
    """Each war with its first and last date, whether it is still fought, and its casualties.

    The end is the first that a save tells, or the last battle's date if that is later; null where no save tells one.
    """
    dates = _of_wars(records, moves).select("save_id", "war_ord", "date")
    own = records.select("save_id", "war_ord").join(dates, ["save_id", "war_ord"], "left").groupBy("save_id", "war_ord").agg(F.collect_list("date").alias("dates"))
    r = records.join(own, ["save_id", "war_ord"])
    at = lambda c: year_fraction(F.col(c))
    pick = lambda most: F.reduce("dates", F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (year_fraction(x) > year_fraction(a) if most else year_fraction(x) < year_fraction(a)), x).otherwise(a))
    r = r.withColumns({"first": pick(False), "last": F.when(~F.col("active"), pick(True))})
    g = r.groupBy(*KEY).agg(F.min_by("first", at("first")).alias("start"), F.min_by("last", F.when(F.col("last").isNotNull(), F.col("year_frac"))).alias("told_end"), F.bool_and("active").alias("active"))
    b = fought.groupBy(*KEY).agg(
        F.max_by("date", F.when(F.col("date").isNotNull(), at("date"))).alias("last_battle"), F.sum("a_losses").alias("attacker_losses"), F.sum("d_losses").alias("defender_losses"),
        F.count("*").alias("battles"), F.count("date").alias("dated"),
    )
    g = g.join(b, KEY, "left").na.fill(0, ["attacker_losses", "defender_losses", "battles", "dated"])
    later = F.col("last_battle").isNotNull() & (at("last_battle") > at("told_end"))
    return g.withColumn("end", F.when(F.col("told_end").isNotNull(), F.when(later, F.col("last_battle")).otherwise(F.col("told_end")))).drop("told_end", "last_battle")


def parties(records: DataFrame, moves: DataFrame, wars: DataFrame) -> DataFrame:
    """Who fought, by war and side: joined, left (null if to the end), leads, original, and the place in the list.

    A side that nobody joined has the war's leader. Original is who leads, has no date or joined within a month of the
    start. Who left is told only where that was after joining and before the end.
    """
    m = _of_wars(records, moves)
    when = year_fraction(F.col("date"))
    seen = m.groupBy(*KEY, "attacks", "tag").agg(F.min_by("date", F.when(F.col("joins"), when)).alias("joined"), F.max_by("date", F.when(~F.col("joins"), when)).alias("gone")).where("joined is not null")
    leaders = wars.select(*KEY, F.explode(F.array(F.struct(F.lit(True).alias("attacks"), F.col("attacker").alias("tag")), F.struct(F.lit(False).alias("attacks"), F.col("defender").alias("tag")))).alias("x")).select(*KEY, "x.*")
    alone = leaders.join(seen.select(*KEY, "attacks").distinct(), [*KEY, "attacks"], "left_anti")
    p = seen.unionByName(alone, allowMissingColumns=True).join(wars.select(*KEY, "start", "end"), KEY)
    since = year_fraction(F.col("joined"))
    leads = F.coalesce(F.col("tag") == F.when(F.col("attacks"), F.col("attacker")).otherwise(F.col("defender")), F.lit(False))
    early = F.col("joined").isNull() | F.col("start").isNull() | (since <= year_fraction(F.col("start")) + 1.0 / 12.0)
    out = year_fraction(F.col("gone"))
    leaves = F.col("end").isNull() | ((F.col("gone") != F.col("end")) & (out < year_fraction(F.col("end"))))
    p = p.withColumns({"leads": leads, "original": leads | early, "left": F.when(leaves & (F.col("joined").isNull() | (out >= since)), F.col("gone"))})
    place = F.row_number().over(W.partitionBy(*KEY, "attacks").orderBy(F.desc("original"), F.coalesce(since, F.lit(0.0)), "tag"))
    return p.select(*KEY, "attacks", "tag", "joined", "left", "leads", "original", place.alias("place"))


def goals(t: dict[str, DataFrame], records: DataFrame, part: DataFrame, wars: DataFrame, regions: DataFrame) -> DataFrame:
    """Each goal of a war with ``had`` provinces of its state that the receiver held at the save before the war, and
    ``took``, how many of them the actor holds at the save after it; met (all), part (some).

    A war without goals has the one that it began with. A fulfilled goal wins over one that is not. regions: pid,
    region; a province in no region is a state of its own. Before the first save that save counts, unless the war
    had ended by then; after the last save that one.
    """
    g = _of_wars(records, part).drop("war_ord", "save_id")
    what = ["actor", "receiver", "province", "casus_belli"]
    told = latest_wins(g.where("not first"), [*KEY, *what], [F.desc("fulfilled"), F.when(F.col("fulfilled"), -F.col("year_frac")).otherwise(F.col("year_frac"))])
    first = latest_wins(g.where("first").join(told.select(*KEY).distinct(), KEY, "left_anti"), KEY, [F.asc("year_frac")])
    g = told.unionByName(first).drop("first", "block", "year_frac").withColumn("_goal_", F.xxhash64(*what))
    saves = t["saves"].select("campaign", F.col("year_frac").alias("at"), "save_id", F.min("year_frac").over(W.partitionBy("campaign")).alias("opening"))
    w = wars.where("start is not null")
    before = asof(w.withColumn("at", year_fraction(F.col("start"))), saves, ["campaign"], "at", ["save_id", "opening"], clamp=True).withColumnRenamed("save_id", "before")
    before = before.withColumn("before", F.when(F.col("end").isNull() | (F.col("opening") < year_fraction(F.col("end"))), F.col("before"))).drop("at", "opening")
    both = asof(before.withColumn("at", year_fraction(F.coalesce("end", "start"))), saves, ["campaign"], "at", ["save_id"], forward=True, clamp=True).select(*KEY, "before", F.col("save_id").alias("after"))
    of = regions.select(F.col("pid").alias("province"), "region")
    g = g.join(of, "province", "left").join(both, KEY, "left")
    in_region = g.where("region is not null").join(regions, "region").unionByName(g.where("region is null and province <> 0").withColumn("pid", F.col("province")))
    owned = t["province"].select("save_id", "pid", "owner").dropDuplicates(["save_id", "pid"])
    had = in_region.join(owned.select(F.col("save_id").alias("before"), "pid", F.col("owner").alias("receiver")), ["before", "pid", "receiver"], "left_semi")
    now = owned.select(F.col("save_id").alias("after"), "pid", F.col("owner").alias("holder"))
    n = had.join(now, ["after", "pid"], "left").groupBy(*KEY, "_goal_").agg(F.count("*").alias("had"), F.count_if(F.col("holder") == F.col("actor")).alias("took"))
    out = g.join(n, [*KEY, "_goal_"], "left").na.fill(0, ["had", "took"]).drop("_goal_", "before", "after")
    return out.withColumns({"met": (F.col("had") > 0) & (F.col("took") == F.col("had")), "part": (F.col("took") > 0) & (F.col("took") < F.col("had"))})


def outcomes(listed: DataFrame) -> DataFrame:
    """The key and outcome of each war with goals that can be checked: how many of them took something."""
    n = listed.where("had > 0").groupBy(*KEY).agg(F.count("*").alias("of"), F.count_if(F.col("took") > 0).alias("won"))
    return n.select(*KEY, F.concat_ws(" ", F.col("won").cast("string"), F.lit("of"), F.col("of").cast("string"), F.lit("taken")).alias("outcome"))


def state_label(region: Column, region_name: Column, province_name: Column) -> Column:
    """The region's name, else the province's with `` Region``, else the region's key."""
    named = F.when(province_name != "", F.concat(province_name, F.lit(" Region")))
    return F.coalesce(F.nullif(region_name, F.lit("")), named, region, F.lit(""))


def fighters(fought: DataFrame, sides: DataFrame) -> DataFrame:
    """campaign, tag: every nation that a war or a battle names."""
    in_battle = fought.select("campaign", F.explode(F.array("a_country", "d_country")).alias("tag"))
    return sides.select("campaign", "tag").union(in_battle).where("tag is not null and tag not in ('', '---')").distinct()


def book(t: dict[str, DataFrame], parts: dict[str, DataFrame], regions: DataFrame, kinds: DataFrame) -> dict[str, DataFrame]:
    """wars, parties, goals, battles and fighters of the campaigns, by name."""
    r = war_records(t)
    fought = at_sea(battles(r, parts["battles"]), kinds)
    wars = spans(r, parts["moves"], fought)
    sides = parties(r, parts["moves"], wars)
    listed = goals(t, r, parts["goals"], wars, regions)
    text = {f"{s}_units": unit_list(F.col(f"{s}_units")) for s in "ad"}
    return {"wars": wars.join(outcomes(listed), KEY, "left").na.fill("", ["outcome"]), "parties": sides, "goals": listed, "battles": fought.withColumns(text), "fighters": fighters(fought, sides)}
