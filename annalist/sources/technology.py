"""Technologies, inventions, units and modifiers of a game's rule files, from their trees (sources.rules.rule_tree()).

What is read here is what the operators elsewhere ask for: the order of inventions and what each needs (plans.alignment,
attainable()), what technologies, inventions, national values and modifiers add (plans.mobilisation), the hulls of
ships and what is added to them (naval_profiles()), and who may form whom (plans.campaign.successions()). A rule
folder holds some megabytes, so single-task windows over it are meant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fixed: the stats of ships; what of a technology is no effect; the class of heavy hulls.
SHIP_STATS = ["hull", "gun_power", "evasion", "torpedo_attack", "score"]
NO_EFFECT = ["area", "year", "cost", "ai_chance", "unciv_military", "unciv_naval", "unciv_economic", "unciv_culture"]
HEAVY = "big_ship"


def _of(tree: DataFrame, folder: str, *names: str) -> DataFrame:
    t = tree.where(F.col("folder") == folder)
    return t.where(F.col("name").isin(*names)) if names else t.where(F.col("name").endswith(".txt"))


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _at(n: int) -> Column:
    """The key of the n-th block inside the one at the top, or null."""
    return F.get("path", F.lit(n - 1))


def _sizes(t: DataFrame) -> DataFrame:
    """name, value: mobilisation_size of blocks at the top, told there or in blocks of effects in a row; several add up."""
    told = ~F.col("is_block") & (F.col("key") == "mobilisation_size") & (F.col("depth") >= 1) & F.forall("path", lambda x: x == "effect")
    return t.where(told).groupBy(F.col("top").alias("name")).agg(F.sum(_number(F.col("value"))).alias("value")).where("value <> 0")


def _ship_changes(t: DataFrame, inside: Column) -> DataFrame:
    """name, ship_type, stat, value: what blocks of the top ones add to ships; several add up."""
    change = ~F.col("is_block") & F.col("key").isin(SHIP_STATS) & (F.size("path") >= 1) & inside
    return t.where(change).groupBy(F.col("top").alias("name"), F.element_at("path", -1).alias("ship_type"), F.col("key").alias("stat")).agg(F.sum(_number(F.col("value"))).alias("value"))


def technologies(tree: DataFrame) -> dict[str, DataFrame]:
    """techs (tech, category, area, place, year, cost), effects (tech, place, label, value), prerequisites (tech, needs).

    category: the file's name without ``_tech``; place: within the category's area, from 1, in the order of files. Of an
    area every technology needs those before it. label: the keys of the blocks around a value and its own, with colons.
    """
    t = _of(tree, "technologies")
    top = t.where((F.col("depth") == 0) & F.col("is_block")).select("name", "node", F.col("key").alias("tech"))
    first = lambda k: F.min_by("value", F.when((F.col("key") == k) & (F.col("depth") == 1) & ~F.col("is_block"), F.col("node")))
    told = t.where("depth = 1").groupBy(F.col("top").alias("tech"), F.col("name")).agg(F.coalesce(first("area"), F.lit("other")).alias("area"), *(F.coalesce(first(k).try_cast("double").cast("long"), F.lit(0)).alias(k) for k in ("year", "cost")))
    category = F.replace(F.regexp_replace("name", r"\.txt$", ""), F.lit("_tech"), F.lit(""))
    techs = top.join(told, ["tech", "name"], "left").na.fill({"area": "other", "year": 0, "cost": 0}).withColumn("category", category)
    techs = techs.withColumn("place", F.row_number().over(W.partitionBy("category", "area").orderBy("name", "node"))).select("tech", "category", "area", "place", "year", "cost")
    label = F.concat_ws(":", F.concat_ws(":", "path"), "key")
    effect = ~F.col("is_block") & F.col("key").isNotNull() & ~F.coalesce(_at(1), F.col("key")).isin(NO_EFFECT)
    effects = t.where((F.col("depth") >= 1) & effect).select(F.col("top").alias("tech"), F.col("node").alias("place"), F.regexp_replace(label, "^:", "").alias("label"), "value")
    before = techs.select("category", "area", F.col("place").alias("earlier"), F.col("tech").alias("needs"))
    needed = techs.join(before, ["category", "area"]).where("earlier < place").select("tech", "needs")
    return {"techs": techs, "effects": effects, "prerequisites": needed}


def inventions(tree: DataFrame) -> dict[str, DataFrame]:
    """sequence (seq from 0, invention) and, as attainable() has them, inventions, techs, tags, requires, blockers.

    The order is that of the files' names and of each file. An invention needs what its limit names outside of NOT:
    technologies (``name = 1``), a tag, other inventions. Of its chance, base and the factors of modifiers that hold
    where another invention is not active are read.
    """
    t = _of(tree, "inventions")
    top = t.where((F.col("depth") == 0) & F.col("is_block"))
    seq = F.row_number().over(W.orderBy("name", "node")) - 1
    sequence = top.select(seq.cast("long").alias("seq"), F.col("key").alias("invention"))
    leaf = t.where(~F.col("is_block") & F.col("key").isNotNull()).withColumnRenamed("top", "invention")
    limit = leaf.where((_at(1) == "limit") & ~F.array_contains("path", "NOT"))
    requires = limit.where("key = 'invention'").select("invention", F.col("value").alias("other")).distinct()
    tags = limit.where("key = 'tag'").select("invention", F.col("value").alias("tag")).distinct()
    tech = limit.where((F.col("value") == "1") & F.col("key").rlike("^[a-z_][a-z_0-9]*$")).select("invention", F.col("key").alias("tech")).distinct()
    tech = tech.join(requires.withColumnRenamed("other", "tech"), ["invention", "tech"], "left_anti")
    chance = leaf.where(_at(1) == "chance")
    base = chance.where("key = 'base'").groupBy("invention").agg(F.min_by("value", "node").try_cast("double").alias("base"))
    # a modifier's block is the one around its factor, and the one around the block that says NOT
    factor = chance.where((F.col("key") == "factor") & (F.element_at("path", -1) == "modifier")).groupBy("save_id", "invention", "parent").agg(F.min_by("value", "node").try_cast("double").alias("factor"))
    block = t.where("is_block").select("save_id", F.col("node").alias("not_block"), F.col("parent").alias("parent"))
    blocked = chance.where((F.col("key") == "invention") & (F.element_at("path", -1) == "NOT") & (F.get("path", F.size("path") - 2) == "modifier")).select("save_id", "invention", F.col("parent").alias("not_block"), F.col("value").alias("other"), "node")
    blocked = blocked.join(block, ["save_id", "not_block"]).groupBy("save_id", "invention", "parent").agg(F.min_by("other", "node").alias("other"))
    blockers = blocked.join(factor, ["save_id", "invention", "parent"]).where("factor is not null").select("invention", "other", "factor")
    rules = top.select(F.col("key").alias("invention")).distinct().join(base, "invention", "left")
    return {"sequence": sequence, "inventions": rules, "techs": tech, "tags": tags, "requires": requires, "blockers": blockers}


def unlocked(invention: dict[str, DataFrame], tech: dict[str, DataFrame]) -> DataFrame:
    """invention, tech, year: of each invention with technologies, all that it needs, theirs included, and when it can be had.

    year: that of the latest technology, null where a file has none of them.
    """
    direct = invention["techs"]
    every = direct.union(direct.join(tech["prerequisites"], "tech").select("invention", F.col("needs").alias("tech"))).distinct()
    d = every.join(tech["techs"].select("tech", "year").distinct(), "tech", "left")
    return d.withColumn("year", F.when(F.count_if(F.col("year").isNull()).over(W.partitionBy("invention")) == 0, F.max("year").over(W.partitionBy("invention")))).select("invention", "tech", "year")


def mobilisation_sizes(tree: DataFrame) -> DataFrame:
    """kind, name, value: what technologies, inventions, national values, event and triggered modifiers add, for mobilisation.sizes()."""
    of = {"tech": _of(tree, "technologies"), "invention": _of(tree, "inventions"), "national value": _of(tree, "common", "nationalvalues.txt"), "event modifier": _of(tree, "common", "event_modifiers.txt"), "triggered modifier": _of(tree, "common", "triggered_modifiers.txt")}
    return reduce(DataFrame.unionByName, (_sizes(t).select(F.lit(kind).alias("kind"), "name", "value") for kind, t in of.items()))


def hulls(tree: DataFrame) -> DataFrame:
    """ship_type, heavy, stat, value: the stats of naval units, 0 where a file tells none."""
    t = _of(tree, "units").where("depth = 1 and not is_block")
    first = lambda k: F.min_by("value", F.when(F.col("key") == k, F.col("node")))
    u = t.groupBy(F.col("top").alias("ship_type")).agg(first("type").alias("kind"), F.coalesce(first("unit_type") == HEAVY, F.lit(False)).alias("heavy"), *(_number(first(s)).alias(s) for s in SHIP_STATS))
    return u.where("kind = 'naval'").select("ship_type", "heavy", F.inline(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in SHIP_STATS))))


def hull_changes(tree: DataFrame) -> DataFrame:
    """what, ship_type, stat, value: what technologies and the effects of inventions add to hulls, for naval_profiles()."""
    tech = _ship_changes(_of(tree, "technologies"), ~F.array_contains("path", "ai_chance"))
    invention = _ship_changes(_of(tree, "inventions"), F.array_contains("path", "effect") & (F.element_at("path", -1) != "effect"))
    return tech.unionByName(invention).groupBy(F.col("name").alias("what"), "ship_type", "stat").agg(F.sum("value").alias("value"))


def formations(tree: DataFrame) -> DataFrame:
    """old, new: who may form whom by a decision: the tags that its potential names, and the tag that it changes to."""
    t = _of(tree, "decisions").where(~F.col("is_block"))
    decision = ["save_id", "top", "decision"]
    d = t.withColumn("decision", _at(1)).where("decision is not null")
    made = d.where("key in ('change_tag', 'change_tag_no_core_switch')").groupBy(*decision).agg(F.min_by("value", "node").alias("new"))
    of = d.where((_at(2) == "potential") & (F.col("key") == "tag") & F.col("value").rlike("^[A-Z][A-Z0-9]{2}$")).select(*decision, F.col("value").alias("old")).distinct()
    return made.join(of, decision).select("old", "new").distinct()
