"""What must hold of every nation at every date: rules as rows, judged in one pass, with a few of the rows that break each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import half_even

#: Fixed: how far two numbers may lie apart, in relation and at least.
RELATIVE, ABSOLUTE = 1e-9, 1e-6
#: Fixed: sums and shares (name, left, right), where right is a sum of columns or a share (part, whole, digits).
EQUAL = [
    ("the strata are the whole population", "total_pop", ["pop_poor", "pop_middle", "pop_rich"]), ("brigades are the standing ones plus the mobilized ones", "brigades", ["regular_brigades", "mobilized_brigades"]),
    ("the accepted share is the accepted population over the whole", "accepted_pct", ("accepted_pop", "total_pop", 2)), ("the unmet-needs share is that count over the whole", "life_unmet_pct", ("life_unmet", "total_pop", 3)),
    ("the starving share is that count over the whole", "starving_pct", ("starving", "total_pop", 3)), ("the soldier share is that count over the whole population", "soldiers_noncolonial_pct", ("soldiers_noncolonial", "total_pop", 3)),
]
#: Fixed: columns of 0 and 1; columns within a range; counts.
FLAGS = ["is_player", "is_mobilized"]
RANGES = [("avg_literacy", 0.0, 1.0), ("avg_literacy_stated", 0.0, 1.0), ("accepted_pct", 0.0, 100.0), ("life_unmet_pct", 0.0, 100.0), ("starving_pct", 0.0, 100.0), ("mobilisation_size", 0.0, 1.0)]
COUNTS = [
    "total_pop", "accepted_pop", "primary_culture_pop", "provinces", "states", "brigades", "regular_brigades", "mobilized_brigades", "mobilizing", "brigade_cap", "armies", "navies", "ships", "factory_count", "factory_levels",
    "ports", "naval_base_levels", "max_naval_base", "railroad_levels", "fort_levels", "techs", "army_techs", "navy_techs", "mobilization_pool", "mobilization_brigades", "life_unmet", "starving", "pop_poor", "pop_middle",
    "pop_rich", "pop_noncolonial", "soldiers_noncolonial",
]
#: Fixed: (name, left, right) where left is at most right.
ORDERED = [
    ("accepted culture is part of the population", "accepted_pop", "total_pop"), ("the primary culture is part of the accepted population", "primary_culture_pop", "accepted_pop"), ("people with unmet needs are part of the population", "life_unmet", "total_pop"),
    ("the starving are people whose needs are unmet", "starving", "life_unmet"), ("provinces with a naval base are provinces", "ports", "provinces"), ("the largest naval base is no larger than all of them together", "max_naval_base", "naval_base_levels"),
    ("soldiers outside the colonies are part of the population", "soldiers_noncolonial", "pop_noncolonial"), ("people outside the colonies are part of the population", "pop_noncolonial", "total_pop"), ("the mobilizable pool is part of the population", "mobilization_pool", "total_pop"),
    ("army and navy technologies are part of all technologies", "army_techs", "techs"), ("navy technologies are part of all technologies", "navy_techs", "techs"), ("standing brigades are within the cap", "regular_brigades", "brigade_cap"),
]


@dataclass(frozen=True)
class Rule:
    """Holds where left and right are alike (``=``) or left is at most right (``<=``); needs: the columns it asks for."""

    name: str
    left: Column
    kind: str
    right: Column
    needs: tuple[str, ...]

    def broken(self) -> Column:
        slack = F.greatest(F.lit(ABSOLUTE), F.lit(RELATIVE) * F.greatest(F.abs(self.left), F.abs(self.right)))
        return F.abs(self.left - self.right) > slack if self.kind == "=" else self.left - self.right > slack


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def rules() -> list[Rule]:
    """All 58. A column that is missing or blank in a row counts as 0."""
    out = []
    for name, left, right in EQUAL:
        if isinstance(right, list):
            value, needs = sum((_number(c) for c in right[1:]), _number(right[0])), (left, *right)
        else:
            part, whole, digits = right
            value, needs = F.when(_number(whole) != 0, half_even(F.lit(100.0) * _number(part) / _number(whole), digits)).otherwise(0.0), (left, part, whole)
        out.append(Rule(name, _number(left), "=", value, needs))
    out += [Rule(f"{c} is 0 or 1", _number(c), "=", F.when(_number(c) >= 0.5, 1.0).otherwise(0.0), (c,)) for c in FLAGS]
    out += [Rule(f"{c} lies from {low:g} to {high:g}", _number(c), "=", F.greatest(F.least(_number(c), F.lit(high)), F.lit(low)), (c,)) for c, low, high in RANGES]
    out += [Rule(f"{c} is not negative", F.lit(0.0), "<=", _number(c), (c,)) for c in COUNTS]
    return out + [Rule(name, _number(a), "<=", _number(b), (a, b)) for name, a, b in ORDERED]


def untested(nations: DataFrame, every: list[Rule] | None = None) -> list[str]:
    """The rules that ask for columns which a table does not have."""
    return [r.name for r in every or rules() if set(r.needs) - set(nations.columns)]


def violations(nations: DataFrame, keys: list[str], every: list[Rule] | None = None, most: int = 5) -> DataFrame:
    """rule, broken (in how many rows), place, left, right and keys of the first ``most`` rows in their order that break it.

    One pass over the rows; what breaks a rule is counted and cut to the first before it is shuffled on. Rules for columns
    that are not there are left out, see untested().
    """
    able = [r for r in every or rules() if not set(r.needs) - set(nations.columns)]
    if not able:
        return nations.select(F.lit("").alias("rule"), F.lit(0).cast("long").alias("broken"), F.lit(0).alias("place"), F.lit(0.0).alias("left"), F.lit(0.0).alias("right"), *keys).limit(0)
    each = F.filter(F.array(*(F.when(r.broken(), F.struct(F.lit(r.name).alias("rule"), r.left.alias("left"), r.right.cast("double").alias("right"))) for r in able)), lambda x: x.isNotNull())
    rows = nations.select(*keys, F.inline(each))
    counted = rows.groupBy("rule").agg(F.count("*").alias("broken"))
    place = F.row_number().over(W.partitionBy("rule").orderBy(*keys))
    return rows.withColumn("place", place).where(F.col("place") <= most).join(counted, "rule").select("rule", "broken", "place", "left", "right", *keys)
