"""The report's tables whole: the sixty columns of a nation at a date, the long tables beside them, as CSV files too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_even, year_fraction
from ..streaming.keeper import place
from . import campaign as C

#: Fixed: the columns of a nation at a date, before those of its population's types and its accepted cultures.
COLUMNS = [
    "date", "year", "tag", "is_player", "primary_culture", "civilized", "provinces", "states", "total_pop", "accepted_pop", "accepted_pct", "primary_culture_pop", "avg_literacy", "avg_literacy_stated", "pop_noncolonial",
    "avg_consciousness", "avg_militancy", "brigades", "regular_brigades", "mobilized_brigades", "mobilizing", "brigade_cap", "is_mobilized", "armies", "ships", "navies", "factory_count", "factory_levels", "ports",
    "naval_base_levels", "max_naval_base", "railroad_levels", "fort_levels", "mobilisation_size", "mobilization_pool", "mobilization_pops", "mobilization_brigades", "mobilization_cap", "mobilization_available",
    "mobilization_remaining", "war_policy", "techs", "army_techs", "navy_techs", "prestige", "infamy", "treasury", "tax_base", "research_points", "war_exhaustion", "plurality", "pop_poor", "pop_middle", "pop_rich",
    "soldiers_noncolonial", "soldiers_noncolonial_pct", "life_unmet", "life_unmet_pct", "starving", "starving_pct",
]
#: Fixed: the goods of each kind; others are ``other``.
CATEGORIES = {
    "military": ["ammunition", "small_arms", "artillery", "canned_food", "barrels", "tanks", "aeroplanes"],
    "raw": ["cattle", "coal", "cotton", "dye", "fish", "fruit", "grain", "iron", "oil", "opium", "precious_metal", "rubber", "silk", "sulphur", "tea", "timber", "tobacco", "tropical_wood", "wool", "coffee"],
    "industrial": ["cement", "clipper_convoy", "electric_gear", "explosives", "fabric", "fertilizer", "fuel", "glass", "lumber", "machine_parts", "paper", "steamer_convoy", "steel"],
    "consumer": ["automobiles", "furniture", "liquor", "luxury_clothes", "luxury_furniture", "radio", "regular_clothes", "telephones", "wine"],
}
#: Fixed: the tables, their columns and the order of their rows (``at``, the date's place, first in all).
TABLES = {
    "prices": (["date", "year", "good", "category", "price"], ["good"]), "market_snapshot": (["date", "year", "good", "category", "price", "world_pool", "supply", "demand", "real_demand", "actual_sold", "discovered"], ["good"]),
    "ships_by_type": (["date", "year", "tag", "ship_type", "count", "effective"], ["tag", "ship_type"]), "brigades_by_type": (["date", "year", "tag", "regiment_type", "count"], ["tag", "regiment_type"]),
    "technologies": (["date", "year", "tag", "technology", "branch", "line"], ["tag", "technology"]), "pops_by_type": (["date", "year", "tag", "pop_type", "size"], ["tag", "pop_type"]),
    "pops_by_culture": (["date", "year", "tag", "culture", "size", "accepted"], ["tag", "place"]),
}


def category(good: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, goods in CATEGORIES.items():
        out = out.when(good.isin(goods), kind)
    return out.otherwise("other")


def technologies_held(t: dict[str, DataFrame], branches: DataFrame | None = None) -> DataFrame:
    """save_id, tag, technology, branch, line of what nations have; branches: tech, category, area (sources.technology)."""
    tech = t["country_list"].where("list = 'technology' and bare").groupBy("save_id", "tag", F.col("name").alias("technology")).agg(F.min_by("value", "ord").alias("v")).where("v = '1'").drop("v")
    if branches is None:
        return tech.select("*", F.lit("other").alias("branch"), F.lit("Other").alias("line"))
    of = branches.groupBy(F.col("tech").alias("technology")).agg(F.min("category").alias("branch"), F.min("area").alias("line"))
    return tech.join(of, "technology", "left").select("save_id", "tag", "technology", F.coalesce("branch", F.lit("other")).alias("branch"), F.coalesce("line", F.lit("Other")).alias("line"))


def nations_whole(t: dict[str, DataFrame], rates: DataFrame, impacts: DataFrame, policies: DataFrame, pop_types: list[str], branches: DataFrame | None = None, per: float = 3000.0, floor: int = 3, **how) -> DataFrame:
    """save_id, campaign, at and COLUMNS of each nation, pop_<type> of the types that are asked for, accepted_cultures.

    rates: save_id, tag, rate of mobilisation (plans.mobilisation); impacts: save_id, tag, impact of modifiers; policies:
    ruling_party (from 1), war_policy, value: what a policy adds to the impact, null where no rule tells. A nation without
    a rate mobilises nobody, one without a known policy has no cap. per and how: as nations(), of which the brigades that
    mobilise are worked out here with each nation's own rate.
    """
    on = ["save_id", "tag"]
    known = dict(t) | {"country": t["country"].join(rates.select(*on, "rate"), on, "left")}
    n = C.nations(known, per, F.coalesce("rate", F.lit(0.0)), **how)
    held = technologies_held(t, branches).groupBy(*on).agg(F.count_if(F.col("branch") == "army").alias("army_techs"), F.count_if(F.col("branch") == "navy").alias("navy_techs"))
    by_type = C.people(t).groupBy("save_id", F.col("owner").alias("tag")).agg(*(F.sum(F.when(F.col("pop_type") == p, F.col("size")).otherwise(0)).alias(f"pop_{p}") for p in pop_types)) if pop_types else None
    n = n.join(t["formation"], on, "left").join(held, on, "left").join(impacts.select(*on, "impact"), on, "left")
    n = n.join(policies.select(F.col("ruling_party").cast("double").alias("ruling_party"), "war_policy", F.col("value").alias("of_policy")), "ruling_party", "left")
    if by_type is not None:
        n = n.join(by_type, on, "left")
    n = n.na.fill(0, ["armies", "navies", "mobilizing", "army_techs", "navy_techs", *(f"pop_{p}" for p in pop_types)])
    standing = F.greatest(F.col("regular_brigades"), F.lit(floor))
    cap = F.when(F.col("of_policy").isNull(), 0).otherwise((standing * (1 + F.col("of_policy") + F.coalesce("impact", F.lit(0.0)))).cast("long"))
    n = n.withColumns({
        "at": F.col("year_frac"), "infamy": F.coalesce("badboy", F.lit(0.0)), "treasury": F.coalesce("money", F.lit(0.0)), "mobilisation_size": half_even(F.coalesce("rate", F.lit(0.0)), 5), "mobilization_cap": cap,
        "mobilization_available": F.when(cap != 0, F.least("mobilization_brigades", cap)).otherwise(F.col("mobilization_brigades")), "war_policy": F.coalesce("war_policy", F.lit("")),
        "mobilization_remaining": F.greatest(F.col("mobilization_brigades") - F.col("mobilized_brigades") - F.col("mobilizing"), F.lit(0)), "accepted_cultures": F.coalesce("accepted_cultures", F.lit("")),
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("prestige", "tax_base", "research_points", "war_exhaustion", "plurality", "avg_literacy", "avg_literacy_stated", "avg_consciousness", "avg_militancy")},
        **{c: F.coalesce(c, F.lit(0)) for c in ("primary_culture_pop", "pop_noncolonial", "mobilization_pool", "mobilization_pops", "pop_poor", "pop_middle", "pop_rich")}, "is_player": F.col("is_player").cast("int"), "is_mobilized": F.col("is_mobilized").cast("int"),
    })
    return n.select("save_id", "campaign", "at", "first_seen", *COLUMNS, *(f"pop_{p}" for p in pop_types), "accepted_cultures")


def long_tables(t: dict[str, DataFrame], last_update: DataFrame, branches: DataFrame | None = None) -> dict[str, DataFrame]:
    """TABLES by name, with campaign and at beside their columns."""
    stamp = t["saves"].select("save_id", "campaign", F.col("year_frac").alias("at"), "date", F.substring_index("date", ".", 1).alias("year"))
    out = C.long_counts(t) | {"technologies": technologies_held(t, branches), "market_snapshot": C.market_snapshot(t).withColumn("discovered", F.col("discovered").cast("int"))}
    out = {k: d.drop("date", "year").join(stamp, "save_id") for k, d in out.items()}
    by_campaign = C.prices(t, last_update)  # of one campaign: its saves' histories make one series
    out["prices"] = by_campaign.join(stamp.select("campaign").distinct(), how="cross").withColumn("at", year_fraction(F.col("date")))
    return {k: (d.withColumn("category", category(F.col("good"))) if "good" in d.columns else d).select("campaign", "at", *[c for c in d.columns if c == "place"], *TABLES[k][0]) for k, d in out.items()}


def spelled(x: Column) -> Column:
    """A double as Python writes it: the shortest digits, an exponent below 1e-4 and from 1e16 on, a point always else."""
    s = x.cast("double").cast("string")
    sign, mantissa = F.when(s.startswith("-"), "-").otherwise(""), F.regexp_extract(s, r"^-?([0-9.]+)", 1)
    e = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"^(\d)0$", "$1")
    plain = F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)).otherwise(F.concat(F.rpad(digits, e + 1, "0"), F.lit("."), F.when(F.length(digits) > e + 1, F.substring(digits, e + 2, F.length(digits))).otherwise("0")))
    plain = F.when((e >= 0) & (F.length(digits) > e + 1), F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.length(digits)))).otherwise(plain)
    short = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(digits)
    exponent = F.concat(short, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    exponent = F.when(F.abs(e) > 99, F.concat(short, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))).otherwise(exponent)
    return F.when(F.isnan(x), "nan").when(F.abs(x) == F.lit(float("inf")), F.concat(F.when(x < 0, "-").otherwise(""), F.lit("inf"))).when(e.isNull(), s).when((e < -4) | (e >= 16), F.concat(sign, exponent)).otherwise(F.concat(sign, plain))


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str], files: int | None = None) -> None:
    """Writes columns as CSV with a heading and CRLF, in order over all files; fields are quoted only where they must be.

    Rows are sorted by ranges, a file for each, so no task holds a whole table; files: how many, 1 for a single one.
    """
    text = [spelled(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c).cast("string").alias(c) for c, kind in df.select(columns).dtypes]
    ordered = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    shown = ordered.sortWithinPartitions(*order).select(*(F.coalesce(c, F.lit("")).alias(n) for c, n in zip(text, columns, strict=True)))
    # quoted here, since the writer also quotes fields with spaces around them and escapes otherwise
    quoted = [F.when(F.col(c).rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c)) for c in columns]
    lines = shown.select(F.concat_ws(",", *quoted).alias("line"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_tables(nations: DataFrame, tables: dict[str, DataFrame], folder: str, files: int | None = None) -> None:
    """Writes all eight tables into a folder, each a folder of its own with its heading in ``<table>.header.csv``."""
    columns = [c for c in nations.columns if c not in ("save_id", "campaign", "at", "first_seen")]
    every = {"nations_timeseries": (nations, columns, ["campaign", "at", "first_seen"])} | {k: (tables[k], cols, ["campaign", "at", *order]) for k, (cols, order) in TABLES.items()}
    for name, (df, cols, order) in every.items():
        write_csv(df, f"{folder}/{name}.csv", cols, order, files)
        fs, path = place(f"{folder}/{name}.header.csv")
        with fs.open_output_stream(path) as f:
            f.write((",".join(cols) + "\r\n").encode())
