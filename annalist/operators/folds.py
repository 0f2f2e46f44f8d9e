"""Ordered folds as higher-order functions: what depends on the order of a key's rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered(*columns: str) -> Column:
    """An aggregate: the key's rows as an array of structs, in the order of the columns."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


def brigades(sizes: Column, rate: Column, per: Column) -> Column:
    """How many brigades pops raise, in order: a pop of at least ``per`` raises its own and drops what was saved up;
    smaller ones are saved up until they make one.

    sizes: an array of sizes in order; each counts size * rate people.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("saved"))

    def step(s: Column, size: Column) -> Column:
        people = size * rate
        alone = people >= per
        saved = F.when(alone, F.lit(0.0)).otherwise(s["saved"] + people)
        full = saved >= per
        return F.struct((s["n"] + F.when(alone, F.floor(people / per)).otherwise(full.cast("long"))).cast("long").alias("n"), F.when(full, F.lit(0.0)).otherwise(saved).alias("saved"))

    return F.when((rate > 0) & (per > 0), F.aggregate(sizes, start, step, lambda s: s["n"])).otherwise(F.lit(0).cast("long"))


def compensated_sum(values: Column) -> Column:
    """The sum of an array of doubles, in its order, with Neumaier's correction."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(values, start, step, lambda a: a["s"] + a["c"])
