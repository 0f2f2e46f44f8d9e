"""The share of people that mobilise, and its impact: what a nation holds, joined to what the rules say it adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import compensated_sum
from ..sources.rules import named_inventions

#: Fixed: the kinds of contributions, in their order.
KINDS = ["tech", "invention", "national value", "event modifier", "reform", "uncivilized", "triggered modifier"]
#: Fixed: the static modifier of nations that are not civilized.
UNCIVILIZED = "unciv_nation"


def holdings(t: dict[str, DataFrame], sequence: DataFrame, base: int, triggered: DataFrame | None = None) -> DataFrame:
    """save_id, tag, kind, name, place: what each nation of a save holds that may add to its mobilisation.

    sequence: seq, invention; base: the number of its first. triggered: save_id, tag, name of triggered modifiers whose
    trigger holds (see functions.triggers). A reform's name is ``reform = option``.
    """
    c = t["country_list"]
    tech = c.where("list = 'technology' and bare").groupBy("save_id", "tag", "name").agg(F.min_by("value", "ord").alias("v"), F.min("ord").alias("place")).where("v = '1'")
    ids = c.where("list = 'active_inventions'").select(F.struct("save_id", "tag").alias("tag"), F.array(F.col("name").try_cast("int")).alias("ids"))
    invention = named_inventions(ids, sequence, base).select("tag.save_id", "tag.tag", F.col("invention").alias("name")).join(sequence.select(F.col("invention").alias("name"), F.col("seq").alias("place")), "name")
    modifier = c.where("list = 'modifier' and name = 'modifier' and value is not null").select("save_id", "tag", F.col("value").alias("name"), F.col("ord").alias("place"))
    nation = t["country"].select("save_id", "tag", "nationalvalue", "civilized")
    reform = t["country_field"].select("save_id", "tag", F.concat_ws(" = ", "key", "value").alias("name"), F.col("ord").alias("place"))
    parts = {
        "tech": tech, "invention": invention, "national value": nation.select("save_id", "tag", F.col("nationalvalue").alias("name"), F.lit(0).alias("place")), "event modifier": modifier, "reform": reform,
        "uncivilized": nation.where("lower(civilized) = 'no'").select("save_id", "tag", F.lit(UNCIVILIZED).alias("name"), F.lit(0).alias("place")),
    }
    if triggered is not None:
        parts["triggered modifier"] = triggered.select("save_id", "tag", "name", F.lit(0).alias("place"))
    out = None
    for kind, d in parts.items():
        d = d.select("save_id", "tag", F.lit(kind).alias("kind"), "name", F.col("place").cast("long").alias("place"))
        out = d if out is None else out.unionByName(d)
    return out


def contributions(held: DataFrame, sizes: DataFrame) -> DataFrame:
    """held with value: what each thing adds, by sizes (kind, name, value); what adds nothing goes."""
    return held.join(sizes.where("value <> 0"), ["kind", "name"])


def rates(added: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate: the sum of contributions in their order, at least 0. Nations without any have no row: their rate is 0."""
    at = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    parts = added.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "place", "name", "value"))).alias("parts"))
    return parts.select(*keys, F.greatest(compensated_sum(F.transform("parts", lambda p: p["value"])), F.lit(0.0)).alias("rate"))


def impacts(held: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, impact: what event and triggered modifiers add to mobilisation's impact, by values (modifier, value)."""
    d = held.where(F.col("kind").isin("event modifier", "triggered modifier")).join(values.select(F.col("modifier").alias("name"), "value"), "name")
    return d.groupBy(*keys).agg(F.sum("value").alias("impact"))


def sizes(rules: dict[str, DataFrame], more: DataFrame) -> DataFrame:
    """kind, name, value from tables of rules; more has those of technologies, inventions, national values and modifiers."""
    reform = rules["reform_sizes"].select(F.lit("reform").alias("kind"), F.concat_ws(" = ", "reform", "option").alias("name"), "value")
    static = rules["static_sizes"].where(F.col("modifier") == UNCIVILIZED).select(F.lit("uncivilized").alias("kind"), F.col("modifier").alias("name"), "value")
    return more.select("kind", "name", "value").unionByName(reform).unionByName(static)
