"""Snapshot files: plain text of nested ``key=value`` blocks, read into one long table of leaves.

A small tokenizer turns each file into rows; every table of a campaign is then made from the leaves by DataFrame
operations (see tables()). A file is one task's work; files that cannot be read are told apart with a reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import date_parts, losses, whole_number, year_fraction

TOKEN = re.compile(r'"([^"]*)"?|([{}=])|([^\s{}="#]+)|#[^\n]*')

#: Fixed: the blocks of a file, besides provinces (numbers) and countries (tags), that tables are made from.
KEPT = frozenset(["worldmarket", "active_war", "previous_war", "great_nations", "flags"])

DATED = r"^\d{1,4}\.\d{1,2}\.\d{1,2}$"

LEAVES = "save_id string, ord long, top string, top_ord long, path array<string>, block long, parent long, key string, value string"


def leaves(text: str, every: bool = False) -> Iterator[tuple]:
    """(ord, top, top_ord, path, block, parent, key, value) of a snapshot's leaves, in order.

    top and top_ord: the top-level key and its number; path: the keys of the blocks inside it; block and parent: the
    numbers of the innermost block and the one around it. A bare item of a list has no key. A block without leaves
    has one of neither key nor value. Unclosed and surplus braces are borne.
    Blocks at the top that no table of a snapshot is made from are passed over, unless every one is wanted.
    """
    tokens = [(m[3], 0) if m[3] is not None else (m[1], 0) if m[1] is not None else (m[2], 1) for m in TOKEN.finditer(text) if m[0][0] != "#"]
    stack: list[list] = []  # key, number, leaves so far
    tops = blocks = order = i = 0
    wanted = False

    def row(key: str | None, value: str | None) -> tuple:
        return (order, stack[0][0] if stack else None, tops, [s[0] or "" for s in stack[1:]], stack[-1][1] if stack else 0, stack[-2][1] if len(stack) > 1 else 0, key, value)

    while i < len(tokens):
        t, mark = tokens[i]
        key = None
        if not mark and i + 1 < len(tokens) and tokens[i + 1] == ("=", 1):
            key, i = t, i + 2
            if i >= len(tokens):
                break
            t, mark = tokens[i]
        i += 1
        if mark and t == "}":
            if stack:
                if wanted and not stack[-1][2]:
                    order += 1
                    yield row(None, None)
                stack.pop()
        elif mark and t == "{":
            if not stack:
                tops += 1
                wanted = every or bool(key) and (key in KEPT or key.isdigit() or re.fullmatch(r"[A-Z][A-Z0-9]{2}", key) is not None)
            else:
                stack[-1][2] += 1
            blocks += 1
            stack.append([key, blocks, 0])
        elif not mark:
            if stack:
                stack[-1][2] += 1
            if wanted or not stack:
                order += 1
                yield row(key, t)


def read_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, campaign (the folder's name), length, modificationTime, content, date and reason (null if readable).

    Reasons: packed (a zip), no date in the first 4 KB, cut off (the last character that is no space is not ``}``).
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.v2").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    tail = F.decode(F.substring("content", -256, 256), "ISO-8859-1")
    date = F.regexp_extract(head, r'(?m)^date="?(\d{1,4}\.\d{1,2}\.\d{1,2})', 1)
    reason = F.when(head.startswith("PK"), "packed").when(date == "", "no date").when(~F.rtrim(F.regexp_replace(tail, r"\s+$", "")).endswith("}"), "cut off")
    return f.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("campaign"), "length", "modificationTime", "content", date.alias("date"), reason.alias("reason"))


def one_per_date(files: DataFrame) -> DataFrame:
    """The readable files, one for each campaign and date: the last by name."""
    nth = F.row_number().over(W.partitionBy("campaign", "date").orderBy(F.desc("path")))
    return files.where("reason is null").withColumn("_nth_", nth).where("_nth_ = 1").drop("_nth_")


def read_leaves(files: DataFrame) -> DataFrame:
    """The leaves of each file, as LEAVES; save_id is the file's path."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in LEAVES.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = [(path, *r) for r in leaves(content.decode("latin-1"))]
                for a in range(0, len(rows), 100_000):
                    yield pd.DataFrame(rows[a : a + 100_000], columns=names)

    return files.select("path", "content").mapInPandas(run, LEAVES)


#: Fixed: the fields of a population group that are known; of the others, the one whose value is no number is the culture.
POP_FIELDS = [
    "id", "size", "money", "ideology", "issues", "mil", "con", "literacy", "bank", "con_factor", "luxury_needs", "everyday_needs", "life_needs",
    "size_changes", "movement", "promoted", "demoted", "days_of_loss", "converted", "local_migration", "external_migration", "colonial_migration",
    "assimilated", "type", "faction", "random", "political_movement", "social_movement", "supported_regiment", "employed", "stockpile",
    "movement_tag", "movement_issue", "need", "production_type", "last_spending", "current_producing", "percent_afforded",
    "percent_sold_domestic", "percent_sold_export", "leftover", "throttle", "needs_cost", "production_income", "promotion", "literacy_change",
    "con_change", "mil_change",
]


def _inside(nth: int) -> Column:
    """The key of the nth block around a leaf, from the outside or, if negative, the inside; null if there is none."""
    return F.try_element_at("path", F.lit(nth))


def _last(key: str, inside: Column | None = None) -> Column:
    """An aggregate: the last value of a key."""
    here = F.col("key") == key
    return F.max_by("value", F.when(here if inside is None else here & inside, F.col("ord")))


def _land(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provinces and population groups from leaves."""
    at_top = F.size("path") == 0
    number = lambda c: F.col(c).try_cast("double")
    p = rows.where(r"top rlike '^\\d+$'").withColumn("pid", F.col("top").cast("long"))
    level = F.max(F.when(_inside(1) == F.lit("naval_base"), number("value")))
    first = lambda name: F.coalesce(F.max_by(number("value"), F.when((_inside(1) == name), -F.col("ord"))), F.lit(0.0))
    province = p.groupBy("save_id", F.col("top_ord").alias("prov_ord"), "pid").agg(
        _last("owner", at_top).alias("owner"), _last("controller", at_top).alias("controller"), F.collect_set(F.when((F.col("key") == "core") & at_top, F.col("value"))).alias("cores"),
        F.coalesce(_last("colonial", at_top).try_cast("int"), F.lit(0)).alias("colonial"), F.coalesce(level, F.lit(0.0)).alias("naval_base"), first("fort").alias("fort"), first("railroad").alias("railroad"),
    )
    f = p.where(F.size("path") == 1)
    culture = (~F.col("key").isin(POP_FIELDS)) & number("value").isNull()
    pop = f.groupBy("save_id", F.col("top_ord").alias("prov_ord"), "pid", F.col("block").alias("pop_ord"), _inside(1).alias("pop_type")).agg(
        F.max_by("key", F.when(culture, -F.col("ord"))).alias("culture"), _last("size").alias("size"), _last("id").alias("id"), *(_last(k).try_cast("double").alias(k) for k in ("literacy", "con", "mil", "life_needs")),
    )
    return province, pop


def _typed_land(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provinces and population groups from rows of sources.blocks."""
    number = lambda x: x.try_cast("double")
    p, g = F.col("province"), F.col("pop")
    levels = lambda c: F.filter(F.transform(p[c], number), lambda x: x.isNotNull())
    first = lambda c: F.coalesce(F.get(levels(c), F.lit(0)), F.lit(0.0))
    province = typed.where("kind = 'province'").select(
        "save_id", F.col("top_ord").alias("prov_ord"), p["pid"].alias("pid"), p["owner"].alias("owner"), p["controller"].alias("controller"), F.array_distinct(p["cores"]).alias("cores"),
        F.coalesce(p["colonial"].try_cast("int"), F.lit(0)).alias("colonial"), F.coalesce(F.array_max(levels("naval_base")), F.lit(0.0)).alias("naval_base"), first("fort").alias("fort"), first("railroad").alias("railroad"),
    )
    key = lambda x: F.substring_index(x, "=", 1)
    culture = key(F.get(F.filter(F.split(g["others"], "\n"), lambda x: number(F.substring(x, F.length(key(x)) + 2, F.length(x))).isNull()), F.lit(0)))
    pop = typed.where("kind = 'pop'").select(
        "save_id", F.col("top_ord").alias("prov_ord"), g["pid"].alias("pid"), g["pop_ord"].alias("pop_ord"), g["pop_type"].alias("pop_type"), culture.alias("culture"), g["size"].alias("size"), g["id"].alias("id"),
        *(number(g[k]).alias(k) for k in ("literacy", "con", "mil", "life_needs")),
    )
    return province, pop


def tables(files: DataFrame, rows: DataFrame, typed: DataFrame | None = None) -> dict[str, DataFrame]:
    """A campaign's tables by name: saves, province, pop, country, country_list, country_field, state, unit, formation, market, war, great_nation.

    files: as one_per_date(); rows: their leaves, which should be persisted; typed: rows of provinces and population
    groups that have been read as such (see sources.blocks), whose leaves are not among the others then.
    """
    at_top = F.size("path") == 0
    number = lambda c: F.col(c).try_cast("double")
    saves = rows.where("top is null").groupBy("save_id").agg(_last("date").alias("date"), _last("player").alias("player"), _last("start_date").alias("start_date"))
    y, m, d = date_parts(F.col("date"))
    saves = saves.join(files.select(F.col("path").alias("save_id"), "campaign"), "save_id").withColumns({"y": y, "m": m, "d": d, "year_frac": year_fraction(F.col("date"))})

    province, pop = _typed_land(typed) if typed is not None else _land(rows)
    pop = pop.where("culture is not null and size is not null").withColumn("size", whole_number(F.col("size"))).withColumn("id", F.col("id").try_cast("long")).where("size > 0")

    c = rows.where(F.col("top").rlike("^[A-Z][A-Z0-9]{2}$"))
    scalar = {k: _last(k, at_top) for k in ("primary_culture", "government", "civilized", "nationalvalue", "human", "mobilize")}
    numeric = {k: _last(k, at_top).try_cast("double") for k in ("prestige", "badboy", "money", "tax_base", "research_points", "war_exhaustion", "revanchism", "plurality", "capital", "ruling_party")}
    country = c.groupBy("save_id", F.col("top").alias("tag")).agg(F.min("ord").alias("ord"), *(v.alias(k) for k, v in (scalar | numeric).items()))
    country_field = c.where(at_top & F.col("key").isNotNull()).groupBy("save_id", F.col("top").alias("tag"), "key").agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))
    entry = _inside(1)
    country_list = c.where((F.size("path") >= 1) & entry.isin("culture", "technology", "active_inventions", "flags", "saved_country_supply", "modifier")).select(
        "save_id", F.col("top").alias("tag"), "ord", entry.alias("list"), F.when(F.size("path") > 1, _inside(2)).otherwise(F.coalesce("key", "value")).alias("name"), "value", (F.col("key").isNull()).alias("bare"), "block"
    )
    s = c.where(entry == "state")
    in_list = _inside(2)
    state = s.withColumn("state_block", F.when(F.size("path") == 1, F.col("block")).otherwise(F.col("parent"))).groupBy("save_id", F.col("top").alias("tag"), "state_block").agg(
        F.collect_list(F.when(in_list == "provinces", F.col("value").try_cast("long"))).alias("provinces"), F.coalesce(_last("is_colonial").try_cast("int"), F.lit(0)).alias("is_colonial"),
        F.collect_list(F.when((in_list == "state_buildings") & (F.col("key") == "level"), F.col("value").try_cast("double"))).alias("levels"), F.count_distinct(F.when(in_list == "state_buildings", F.col("block"))).alias("factories"),
    )
    is_pop = (_inside(-1) == "pop") & (_inside(-2) == "regiment")
    u = c.where((_inside(-1).isin("regiment", "ship") | is_pop) & F.exists("path", lambda x: x.isin("army", "navy")))
    u = u.withColumns({"unit": F.when(is_pop, F.lit("regiment")).otherwise(_inside(-1)), "of_pop": is_pop, "block": F.when(is_pop, F.col("parent")).otherwise(F.col("block"))})
    unit = u.groupBy("save_id", F.col("top").alias("tag"), "block", "unit").agg(
        F.min("ord").alias("ord"), _last("type", ~F.col("of_pop")).alias("kind"), _last("strength").try_cast("double").alias("strength"), F.coalesce(_last("experience").try_cast("double"), F.lit(0.0)).alias("experience"),
        _last("id", F.col("of_pop")).try_cast("long").alias("pop_id"),
    )
    holds = lambda kind: F.count_distinct(F.when(_inside(-1) == kind, F.col("block")).when(_inside(-2) == kind, F.col("parent")))
    called = c.where((entry == "scheduled_mobilization") & (F.size("path") == 1)).groupBy("save_id", F.col("top").alias("tag"), "block").agg(F.lower(_last("spawned")).alias("spawned"))
    called = called.where("spawned is null or spawned <> 'yes'").groupBy("save_id", "tag").agg(F.count("*").alias("mobilizing"))
    formation = c.where(_inside(1).isin("army", "navy")).groupBy("save_id", F.col("top").alias("tag")).agg(holds("army").alias("armies"), holds("navy").alias("navies")).join(called, ["save_id", "tag"], "full")
    formation = formation.na.fill(0, ["armies", "navies", "mobilizing"])
    market = rows.where(F.col("top") == "worldmarket").where(F.size("path") >= 1).select("save_id", "ord", entry.alias("pool"), "block", F.col("key").alias("good"), number("value").alias("value"))
    w = rows.where(F.col("top").isin("active_war", "previous_war"))
    war = w.groupBy("save_id", F.col("top_ord").alias("war_ord"), (F.col("top") == "active_war").alias("active")).agg(
        _last("name", at_top).alias("name"), _last("original_attacker", at_top).alias("attacker"), _last("original_defender", at_top).alias("defender"),
        F.min(F.when(_inside(2).rlike(DATED), year_fraction(_inside(2)))).alias("start"), F.max(F.when(_inside(2).rlike(DATED), year_fraction(_inside(2)))).alias("until"),
        F.collect_set(F.when(F.col("key").isin("add_attacker", "add_defender"), F.col("value"))).alias("parties"), F.collect_set(F.when(F.col("key").isin("attacker", "defender") & at_top, F.col("value"))).alias("fighting"),
    )
    great = rows.where((F.col("top") == "great_nations") & F.col("key").isNull() & F.col("value").isNotNull())
    great = great.select("save_id", F.row_number().over(W.partitionBy("save_id").orderBy("ord")).alias("rank"), F.col("value").try_cast("int").alias("country_index"))
    return {"saves": saves, "province": province, "pop": pop, "country": country, "country_list": country_list, "country_field": country_field, "state": state, "unit": unit, "formation": formation, "market": market, "war": war, "great_nation": great}


def war_parts(rows: DataFrame) -> dict[str, DataFrame]:
    """What the records of wars hold, by save_id and war_ord: moves, goals, battles.

    moves: date, joins (else leaves), attacks, tag. goals: casus_belli, actor, receiver, province, added, fulfilled (null
    of a war's first goal, ``first``). battles: name, location, date (null if none), won by the attacker, and of the
    attacker (a_) and the defender (d_) country, leader, losses and units, an array of (unit, n) in the file's order.
    """
    w = rows.where(F.col("top").isin("active_war", "previous_war")).withColumnRenamed("top_ord", "war_ord")
    dated = (_inside(1) == "history") & _inside(2).rlike(DATED)
    moves = w.where(dated & (F.size("path") == 2) & F.col("key").isin("add_attacker", "add_defender", "rem_attacker", "rem_defender"))
    moves = moves.select("save_id", "war_ord", _inside(2).alias("date"), F.startswith("key", F.lit("add")).alias("joins"), F.endswith("key", F.lit("attacker")).alias("attacks"), F.col("value").alias("tag"))

    first = _inside(1) == "original_wargoal"
    text = lambda key: F.coalesce(_last(key), F.lit("")).alias(key)
    goals = w.where((F.size("path") == 1) & _inside(1).isin("war_goal", "original_wargoal")).groupBy("save_id", "war_ord", "block", first.alias("first")).agg(
        text("casus_belli"), text("actor"), text("receiver"), whole_number(_last("state_province_id")).alias("province"), F.coalesce(_last("date"), F.lit("")).alias("added"),
        F.when(~F.col("first"), F.coalesce(_last("is_fulfilled") == "yes", F.lit(False))).alias("fulfilled"),
    )
    goals = goals.where((F.col("actor") != "") | ((F.col("receiver") != "") & ~F.col("first")))

    depth = F.when((_inside(1) == "history") & (_inside(2) == "battle"), 2).when(dated & (_inside(3) == "battle"), 3)
    b = w.withColumn("depth", depth).where(F.size("path").isin(F.col("depth"), F.col("depth") + 1))
    side = F.when((F.size("path") > F.col("depth")) & _inside(-1).isin("attacker", "defender"), _inside(-1))
    own = F.size("path") == F.col("depth")
    b = b.withColumn("side", side).withColumn("battle", F.when(own, F.col("block")).otherwise(F.col("parent")))

    def of(who: str, sign: str) -> list[Column]:
        here = F.col("side") == who
        people = losses(whole_number(F.col("value")))
        unit = here & ~F.col("key").isin("country", "leader", "losses") & ~F.startswith("key", F.lit("_")) & (people != 0)
        units = F.array_sort(F.collect_list(F.when(unit, F.struct("ord", F.col("key").alias("unit"), people.alias("n")))))
        return [
            F.coalesce(_last("country", here), F.lit("")).alias(f"{sign}_country"), F.coalesce(_last("leader", here), F.lit("")).alias(f"{sign}_leader"),
            losses(whole_number(_last("losses", here))).alias(f"{sign}_losses"), F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), u["n"].alias("n"))).alias(f"{sign}_units"),
        ]

    battles = b.groupBy("save_id", "war_ord", "battle").agg(
        F.coalesce(_last("name", own), F.lit("")).alias("name"), whole_number(_last("location", own)).alias("location"), F.max(F.when(F.col("depth") == 3, _inside(2))).alias("date"),
        F.coalesce(_last("result", own) == "yes", F.lit(False)).alias("won"), *of("attacker", "a"), *of("defender", "d"),
    )
    return {"moves": moves, "goals": goals, "battles": battles}
