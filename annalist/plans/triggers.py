"""Rules' triggers as data: trees of conditions from rule files, judged for all nations of all saves at once.

A trigger is a tree: its conditions stand in blocks that hold if all, any or none of what is in them does, and every
condition is true, false or unknown of a nation. nodes() has the tree of each rule as rows. For each node the value
is worked out once that it has of a nation of which nothing is known to match; judged() then follows only what
differs: conditions meet the nations' facts in joins on key and value, and level by level, from the leaves up, a
block's value is that of its usual counts of true and unknown conditions plus the differences of its children. What
is shuffled is thus proportional to the facts that a rule asks for, not to nations times conditions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import year_of
from ..operators.lineage import cut
from .campaign import great_powers

#: Fixed: conditions that are judged, by what they ask for.
YES_NO = ["civilized", "war", "exists", "is_greater_power", "ai"]
EQUAL = ["tag", "government", "primary_culture", "nationalvalue", "is_culture_group", "invention", "technology", "has_country_flag", "has_country_modifier"]
AT_LEAST = ["revanchism", "badboy", "prestige", "war_exhaustion", "plurality", "money", "total_pops", "year"]
WHOLE = ["capital", "owns"]
#: Fixed: blocks of conditions, and what is judged of the capital in a block ``capital_scope``.
LOGIC = ["AND", "OR", "NOT"]
SCOPE, OF_CAPITAL = "capital_scope", ["continent", "province_id"]

TRUE, FALSE, UNKNOWN = 1, 0, -1


def nodes(tree: DataFrame, file: str = "triggered_modifiers.txt", folder: str = "common", block: str = "trigger") -> DataFrame:
    """rule, node, parent, level, key, value, is_block, scoped of the triggers in a file, from sources.rules.rule_tree().

    A rule is a block at the top, its node of level 0 and all of its triggers; a rule without any always holds. What
    stands in a block that is none of conditions is left out, as are items without a key.
    """
    t = tree.where((F.col("folder") == folder) & (F.col("name") == file))
    number = lambda c: F.concat_ws("#", "save_id", c)
    around = F.slice("path", 2, F.greatest(F.size("path"), F.lit(1)))
    rule = (F.col("depth") == 0) & F.col("is_block")
    trigger = (F.col("depth") == 1) & F.col("is_block") & (F.col("key") == block)
    inside = (F.element_at(F.concat("path", F.array(F.lit(""))), 1) == block) & F.forall(around, lambda x: x.isin(*LOGIC, SCOPE)) & F.col("key").isNotNull() & ~F.startswith("key", F.lit("_"))
    return t.where(rule | trigger | inside).select(
        F.col("top").alias("rule"), number("node").alias("node"), F.when(~rule, number("parent")).alias("parent"), F.col("depth").alias("level"),
        F.when(rule | trigger, F.lit("AND")).otherwise(F.col("key")).alias("key"), "value", "is_block", F.array_contains("path", SCOPE).alias("scoped"),
    )


def unreadable(tree: DataFrame, reforms: DataFrame) -> DataFrame:
    """rule, key of what nobody can judge, in nodes(): no condition, no name of a reform (reform), or no block where one belongs."""
    named = tree.join(reforms.select(F.col("reform").alias("key"), F.lit(True).alias("is_reform")).distinct(), "key", "left")
    known = F.col("key").isin(YES_NO + EQUAL + AT_LEAST + WHOLE) | F.coalesce("is_reform", F.lit(False))
    logic = F.col("key").isin(LOGIC + [SCOPE])
    bad = F.when(F.col("scoped"), ~(F.col("key").isin(OF_CAPITAL) | (F.col("key").isin(LOGIC) & F.col("is_block")))).otherwise(F.when(logic, ~F.col("is_block")).otherwise(~known))
    return named.where(bad & (F.col("level") > 0)).select("rule", "key").distinct()


def mentioned(tree: DataFrame) -> DataFrame:
    """rule, key: the names that triggers mention, blocks of conditions aside."""
    return tree.where(~F.col("key").isin(LOGIC + [SCOPE])).select("rule", "key").distinct()


def _whole(text: Column, otherwise: int) -> Column:
    """A number in text without its fraction; another where there is none."""
    v = text.try_cast("double")
    return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < 1e18), v.cast("long")), F.lit(otherwise).cast("long"))


def _settled(tree: DataFrame, reforms: DataFrame, groups_known: bool, inventions_known: bool) -> DataFrame:
    """tree with how each condition is asked (ask: yes, text, least, whole, place, or null) and usual: its value where no fact matches."""
    key, text, want = F.col("key"), F.col("value"), F.lower("value") == "yes"
    named = tree.join(reforms.select(F.col("reform").alias("key"), F.lit(True).alias("is_reform")).distinct(), "key", "left")
    leaf = ~F.col("is_block") & ~key.isin(LOGIC + [SCOPE])
    reform = F.coalesce("is_reform", F.lit(False)) & ~key.isin(YES_NO + EQUAL + AT_LEAST + WHOLE)
    unknown_names = ([] if groups_known else ["is_culture_group"]) + ([] if inventions_known else ["invention"])
    ask = F.when(~leaf, None).when(F.col("scoped"), F.when(key == "continent", "place").when(key == "province_id", "whole")).when(key.isin("civilized", "war", "is_greater_power", "ai"), "yes")
    ask = ask.when(key.isin(unknown_names), None).when(key.isin(EQUAL) | reform, "text").when(key.isin(AT_LEAST), "least").when(key == "capital", "whole")
    usual = F.when(F.col("ask") == "yes", F.when(want == (key == "ai"), TRUE).otherwise(FALSE)).when(F.col("ask").isin("text", "least", "whole"), FALSE)
    usual = usual.when(leaf & ~F.col("scoped") & (key == "exists"), F.when(want, TRUE).when(F.lower(text) == "no", FALSE).otherwise(UNKNOWN)).when(leaf & ~F.col("scoped") & (key == "owns"), FALSE)
    logic = F.col("is_block") & key.isin(LOGIC + [SCOPE]) & ~((key == SCOPE) & F.col("scoped"))
    return named.withColumn("logic", logic).withColumn("ask", ask).withColumn("usual", F.when(~logic, F.coalesce(usual, F.lit(UNKNOWN)))).drop("is_reform")


def _value(key: Column, true: Column, false: Column, unknown: Column) -> Column:
    """What a block of conditions comes to, by how many of them are true, false and unknown."""
    every = lambda against: F.when(against > 0, FALSE).when(unknown > 0, UNKNOWN).otherwise(TRUE)
    return F.when(key == "OR", F.when(true > 0, TRUE).when(unknown > 0, UNKNOWN).otherwise(FALSE)).when(key == "NOT", every(true)).otherwise(every(false))


def judged(tree: DataFrame, facts: DataFrame, reforms: DataFrame, groups_known: bool = True, inventions_known: bool = True) -> DataFrame:
    """save_id, tag, rule of the rules whose trigger holds of a nation.

    tree: as nodes(), best without unreadable rules, which are judged as far as they are known; facts: as facts(), of
    all nations; reforms: reform. An all-of holds if nothing in it is false or unknown, an any-of if something is true,
    a NOT if everything in it is false; an empty all-of or NOT holds. Tables of rules are some megabytes at most.
    """
    s = _settled(tree, reforms, groups_known, inventions_known)
    deepest = tree.agg(F.max("level")).first()[0]
    if deepest is None:
        return facts.select("save_id", "tag", F.lit("").alias("rule")).limit(0)
    # the usual value of each block, from the leaves up
    counts = lambda v: [F.count_if(v == x).alias(n) for x, n in ((TRUE, "t"), (FALSE, "f"), (UNKNOWN, "u"))]
    done = [s.where((F.col("level") == deepest)).withColumns({c: F.lit(0).cast("long") for c in "tfu"}).withColumn("usual", F.coalesce("usual", _value(F.col("key"), F.col("t"), F.col("f"), F.col("u"))))]
    for level in range(deepest - 1, -1, -1):
        below = done[-1].groupBy(F.col("parent").alias("node")).agg(*counts(F.col("usual")))
        here = s.where(F.col("level") == level).join(below, "node", "left").na.fill(0, ["t", "f", "u"])
        done.append(here.withColumn("usual", F.coalesce("usual", _value(F.col("key"), F.col("t"), F.col("f"), F.col("u")))).select(done[-1].columns))
    known = cut(reduce(DataFrame.unionByName, done))

    differs = cut(_met(known, facts))
    up = differs.where(F.col("level") == deepest)
    for level in range(deepest - 1, -1, -1):
        change = lambda x: F.sum((F.col("now") == x).cast("int") - (F.col("usual") == x).cast("int"))
        moved = up.groupBy("save_id", "tag", F.col("parent").alias("node")).agg(change(TRUE).alias("dt"), change(FALSE).alias("df"), change(UNKNOWN).alias("du"))
        block = F.broadcast(known.where((F.col("level") == level) & F.col("logic")))
        now = _value(F.col("key"), F.col("t") + F.col("dt"), F.col("f") + F.col("df"), F.col("u") + F.col("du"))
        risen = moved.join(block, "node").withColumn("now", now).where("now <> usual").select(differs.columns)
        up = risen.unionByName(differs.where(F.col("level") == level))
    roots = known.where("level = 0").select("rule", "node", "usual")
    nations = facts.where("key = 'tag'").select("save_id", "tag").distinct()
    always = nations.crossJoin(F.broadcast(roots.where(F.col("usual") == TRUE).select("rule", "node"))).join(up.select("save_id", "tag", "node"), ["save_id", "tag", "node"], "left_anti")
    return always.select("save_id", "tag", "rule").unionByName(up.where(F.col("now") == TRUE).select("save_id", "tag", "rule")).distinct()


def _met(known: DataFrame, facts: DataFrame) -> DataFrame:
    """save_id, tag, rule, node, parent, level, usual, now of the conditions whose value of a nation is not the usual one."""
    c = F.broadcast(known.where("ask is not null").select("rule", "node", "parent", "level", "usual", "ask", F.when(F.col("key") == "province_id", "capital").otherwise(F.col("key")).alias("key"), F.col("value").alias("wanted")))
    alike = facts.join(c.where("ask = 'text'").withColumnRenamed("wanted", "text"), ["key", "text"]).withColumn("now", F.lit(TRUE))
    least = F.coalesce(F.col("wanted").try_cast("double"), F.lit(0.0))
    either = lambda x: F.when(x, TRUE).otherwise(FALSE)
    now = F.when(F.col("ask") == "yes", 1 - F.col("usual")).when(F.col("ask") == "least", F.when(F.col("number").isNull(), UNKNOWN).otherwise(either(F.col("number") >= F.when(F.col("key") == "year", _whole(F.col("wanted"), 0)).otherwise(least))))
    now = now.when(F.col("ask") == "whole", either(F.col("number") == _whole(F.col("wanted"), -2))).when(F.col("ask") == "place", either(F.col("text") == F.col("wanted")))
    others = facts.join(c.where("ask <> 'text'"), "key").withColumn("now", now)
    columns = ["save_id", "tag", "rule", "node", "parent", "level", "usual", "now"]
    return alike.select(columns).unionByName(others.select(columns)).where("now <> usual").distinct()


def facts(t: dict[str, DataFrame], nations: DataFrame, reforms: DataFrame, cultures: DataFrame, continents: DataFrame, inventions: DataFrame | None = None) -> DataFrame:
    """save_id, tag, key, text, number: what triggers ask of each nation, and of the world of its save.

    t: sources.saves.tables(); nations: plans.campaign.nations(); reforms: reform; cultures: culture, culture_group;
    continents: pid, continent; inventions: save_id, tag, invention, where their numbers could be read. A number that is
    not told is 0, a year 0 is unknown, a capital that is not told is -1. At war are the parties of open wars: those
    that fight now where the war tells, else all that have joined.
    """
    country, on = t["country"], ["save_id", "tag"]
    saves = t["saves"].select("save_id", year_of(F.col("date")).try_cast("long").alias("year"))
    n = country.join(nations.select(*on, "total_pop", "is_player"), on).join(saves, "save_id")
    row = lambda d, key, text=None, number=None: d.select(*on, F.lit(key).alias("key") if isinstance(key, str) else key.alias("key"), (F.lit(None).cast("string") if text is None else text).alias("text"), (F.lit(None).cast("double") if number is None else number.cast("double")).alias("number"))
    at_least = {"revanchism": "revanchism", "badboy": "badboy", "prestige": "prestige", "war_exhaustion": "war_exhaustion", "plurality": "plurality", "money": "money", "total_pops": "total_pop"}
    told = [F.struct(F.lit(k).alias("key"), F.lit(None).cast("string").alias("text"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("number")) for k, c in at_least.items()]
    told += [F.struct(F.lit(k).alias("key"), F.coalesce(F.col(c), F.lit("")).alias("text"), F.lit(None).cast("double").alias("number")) for k, c in (("tag", "tag"), ("government", "government"), ("primary_culture", "primary_culture"), ("nationalvalue", "nationalvalue"))]
    capital = _whole(F.col("capital").cast("string"), -1)
    told += [F.struct(F.lit("capital").alias("key"), F.lit(None).cast("string").alias("text"), capital.cast("double").alias("number")), F.struct(F.lit("year").alias("key"), F.lit(None).cast("string").alias("text"), F.nullif(F.col("year"), F.lit(0)).cast("double").alias("number"))]
    own = n.select(*on, F.inline(F.array(*told)))
    listed = t["country_list"]
    tech = listed.where("list = 'technology' and bare").groupBy(*on, "name").agg(F.min_by("value", "ord").alias("v")).where("v = '1'")
    wars = t["war"].where("active").select("save_id", F.explode(F.when(F.size("fighting") > 0, F.col("fighting")).otherwise(F.col("parties"))).alias("tag")).distinct()
    parts = [
        own, row(n.where("lower(civilized) = 'yes'"), "civilized"), row(n.where("is_player"), "ai"), row(wars, "war"), row(great_powers(t), "is_greater_power"), row(tech, "technology", F.col("name")),
        row(listed.where("list = 'flags'"), "has_country_flag", F.col("name")), row(listed.where("list = 'modifier' and name = 'modifier'"), "has_country_modifier", F.col("value")),
        row(t["country_field"].join(F.broadcast(reforms.select(F.col("reform").alias("key")).distinct()), "key"), F.col("key"), F.col("value")),
        row(n.join(cultures, n["primary_culture"] == cultures["culture"]), "is_culture_group", F.col("culture_group")), row(n.withColumn("pid", capital).join(continents, "pid"), "continent", F.col("continent")),
    ]
    if inventions is not None:
        parts.append(row(inventions, "invention", F.col("invention")))
    return reduce(DataFrame.unionByName, parts).join(nations.select(*on), on, "left_semi")


def holdings(t: dict[str, DataFrame], index_list: str = "active_inventions") -> DataFrame:
    """campaign, tag, techs, ids (both sorted), n: what nations hold of technologies and numbers of inventions, each once, and how often."""
    c = t["country_list"]
    tech = c.where("list = 'technology' and bare").groupBy("save_id", "tag", "name").agg(F.min_by("value", "ord").alias("v")).where("v = '1'").groupBy("save_id", "tag").agg(F.sort_array(F.collect_set("name")).alias("techs"))
    ids = c.where(F.col("list") == index_list).groupBy("save_id", "tag").agg(F.sort_array(F.collect_list(F.col("name").try_cast("long"))).alias("ids"))
    each = t["country"].select("save_id", "tag").join(tech, ["save_id", "tag"], "left").join(ids, ["save_id", "tag"], "left").join(t["saves"].select("save_id", "campaign"), "save_id")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return each.groupBy("campaign", "tag", none("techs", "string"), none("ids", "bigint")).agg(F.count("*").alias("n"))
