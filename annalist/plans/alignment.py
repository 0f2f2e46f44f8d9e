"""Where the numbers of inventions in saves begin: what nations hold against the order that rule files give.

A save names inventions by number, and what the first number is depends on the game's version. A number fits an
invention if those who hold it have the technologies that the invention needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: shares of holders with all that an invention needs, from which a number is settled or granted.
SETTLED, GRANTED = 0.95, 0.5


def ordered(sequence: DataFrame, techs: DataFrame, tags: DataFrame) -> DataFrame:
    """seq, invention, needs, may: the inventions in their order (seq from 0, invention) with their technologies and tags as arrays."""
    listed = lambda d, c, name: d.groupBy("invention").agg(F.sort_array(F.collect_set(c)).alias(name))
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    d = sequence.join(listed(techs, "tech", "needs"), "invention", "left").join(listed(tags, "tag", "may"), "invention", "left")
    return d.select("seq", "invention", none("needs"), none("may"))


def _has(needs: Column, techs: Column) -> Column:
    return F.size(F.array_except(needs, techs)) == 0


def violations(held: DataFrame, order: DataFrame, bases: tuple[int, ...] = (1, 0)) -> DataFrame:
    """campaign, base, bad, total: of the numbers that nations hold, how many no invention fits if the first is ``base``.

    held: as triggers.holdings(), so that what many saves repeat is weighed and not joined again; order: as ordered().
    A number fits if there is such an invention, its holder has all it needs and is one of its tags, if it has any.
    """
    each = held.select("campaign", "tag", "techs", "n", F.explode("ids").alias("id")).withColumn("base", F.explode(F.array(*map(F.lit, bases))))
    j = each.withColumn("seq", F.col("id") - F.col("base")).join(order, "seq", "left")
    fits = F.col("invention").isNotNull() & _has(F.col("needs"), F.col("techs")) & ((F.size("may") == 0) | F.array_contains("may", F.col("tag")))
    return j.groupBy("campaign", "base").agg(F.sum(F.when(fits, 0).otherwise(F.col("n"))).alias("bad"), F.sum("n").alias("total"))


def index_bases(counted: DataFrame, bases: tuple[int, ...] = (1, 0), most: float = 0.05) -> DataFrame:
    """campaign, base: the one with the least share of violations, of equal ones the first of ``bases``; none above ``most``."""
    rate = F.col("bad") / F.col("total")
    at = F.array_position(F.array(*map(F.lit, bases)), F.col("base"))
    best = counted.groupBy("campaign").agg(F.min_by("base", F.struct(rate, at)).alias("base"), F.min(rate).alias("rate"))
    return best.where((F.col("rate") <= most) & (F.col("rate") < 1)).select("campaign", "base")


def alignment(held: DataFrame, order: DataFrame, bases: DataFrame, technologies: DataFrame | None = None, shifts: tuple[int, ...] = (-2, -1, 0, 1, 2), least: int = 8) -> DataFrame:
    """campaign, shift, id, holders, have, class of each number that nations with technologies hold at least ``least`` times.

    Beside the base (campaign, base) in use, others are judged. class: settled or granted, by the share of holders that
    have what the invention needs, else suspect; unjudged where there is no such invention or it needs nothing;
    ungated where it needs a technology that no file has (technologies: tech).
    """
    each = held.where(F.size("techs") > 0).select("campaign", "techs", "n", F.explode("ids").alias("id"))
    often = each.groupBy("campaign", "id").agg(F.sum("n").alias("holders")).where(F.col("holders") >= least)
    gated = F.lit(True)
    if technologies is not None:
        lacking = order.select("seq", F.explode("needs").alias("tech")).join(technologies, "tech", "left_anti").select("seq").distinct().withColumn("lacks", F.lit(True))
        order, gated = order.join(lacking, "seq", "left"), F.col("lacks").isNull()
    judged = often.join(bases, "campaign").withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("seq", F.col("id") - F.col("base") - F.col("shift"))
    judged = judged.join(order.withColumn("gated", gated), "seq", "left")
    fits = each.join(judged.where("size(needs) > 0 and gated").select("campaign", "id", "shift", "needs"), ["campaign", "id"]).groupBy("campaign", "id", "shift").agg(F.sum(F.when(_has(F.col("needs"), F.col("techs")), F.col("n")).otherwise(0)).alias("have"))
    share = F.col("have") / F.col("holders")
    kind = F.when(F.coalesce(F.size("needs"), F.lit(0)) <= 0, "unjudged").when(~F.col("gated"), "ungated").when(share >= SETTLED, "settled").when(share >= GRANTED, "granted").otherwise("suspect")
    return judged.join(fits, ["campaign", "id", "shift"], "left").select("campaign", "shift", "id", "holders", "have", kind.alias("class"))


def scores(aligned: DataFrame) -> DataFrame:
    """campaign, shift and how many numbers are settled, granted, suspect, unjudged, ungated."""
    return aligned.groupBy("campaign", "shift").agg(*(F.count_if(F.col("class") == c).alias(c) for c in ("settled", "granted", "suspect", "unjudged", "ungated")))


def decoded(ids: DataFrame, order: DataFrame, bases: DataFrame) -> DataFrame:
    """save_id, tag, invention of ids (campaign, save_id, tag, id): the inventions of campaigns whose base is known."""
    return ids.join(bases, "campaign").withColumn("seq", F.col("id") - F.col("base")).join(order, "seq").select("save_id", "tag", "invention")


def past_end(ids: DataFrame, order: DataFrame, bases: DataFrame) -> DataFrame:
    """campaign, save_id, held, past: how many numbers nations of a save hold, and how many lie outside the order."""
    last = order.agg(F.max("seq").alias("last"))
    j = ids.join(bases, "campaign").crossJoin(F.broadcast(last)).withColumn("seq", F.col("id") - F.col("base"))
    return j.groupBy("campaign", "save_id").agg(F.count("*").alias("held"), F.count_if((F.col("seq") < 0) | (F.col("seq") > F.coalesce("last", F.lit(-1)))).alias("past"))


def numbers_held(t: dict[str, DataFrame]) -> DataFrame:
    """campaign, save_id, tag, id of the inventions that nations of sources.saves.tables() hold."""
    ids = t["country_list"].where("list = 'active_inventions'").select("save_id", "tag", F.col("name").try_cast("long").alias("id")).where("id is not null")
    return ids.join(t["saves"].select("save_id", "campaign"), "save_id").select("campaign", "save_id", "tag", "id")
