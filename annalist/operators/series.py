"""Operators over readings in time: each takes a DataFrame and names of columns, and orders explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by ``order``. Spark keeps one row a key and task before the shuffle."""
    return df.withColumn("_nth_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_nth_ = 1").drop("_nth_")


def gain(df: DataFrame, keys: list[str], at: str, value: str) -> Column:
    """The value less the previous one that is not null."""
    before = F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1))
    return F.col(value) - before


def rebase(keys: list[str], at: str, value: str, to: float = 100.0) -> Column:
    """The value where the first one that is not null is ``to``."""
    first = F.first(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return F.col(value) * F.lit(to) / first


def anchored_growth(df: DataFrame, keys: list[str], at: str, value: str, span: float) -> DataFrame:
    """keys, at, growth: percent a year against an anchor, which moves to a reading only when ``span`` has passed.

    Null and non-positive readings are left out; the first reading, and those before span has passed, have no growth.
    An ordered fold of one series' readings, which a key's own length bounds.
    """
    points = df.where((F.col(value) > 0) & F.col(at).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v")))).alias("p"))
    start = F.expr("named_struct('t', p[0].t, 'v', p[0].v, 'out', cast(array() as array<struct<t: double, g: double>>))")

    def step(s: Column, x: Column) -> Column:
        late = x["t"] - s["t"] >= span
        growth = F.when(late, (F.pow(x["v"] / s["v"], 1.0 / (x["t"] - s["t"])) - 1) * 100)
        out = F.concat(s["out"], F.array(F.struct(x["t"].alias("t"), growth.alias("g"))))
        return F.struct(F.when(late, x["t"]).otherwise(s["t"]).alias("t"), F.when(late, x["v"]).otherwise(s["v"]).alias("v"), out.alias("out"))

    grown = points.select(*keys, F.explode(F.aggregate("p", start, step, lambda s: s["out"])).alias("o"))
    return grown.select(*keys, F.col("o.t").alias(at), F.col("o.g").alias("growth"))


def densify(df: DataFrame, axes: list[DataFrame], on: list[str]) -> DataFrame:
    """df's rows on the grid of the axes (small tables of distinct values), with nulls where it has none."""
    grid = axes[0]
    for a in axes[1:]:
        grid = grid.crossJoin(a)
    return grid.join(df, on, "left")


def changes(df: DataFrame, keys: list[str], at: str, state: str) -> DataFrame:
    """The rows where a key's state is another than at its previous row (null-safe), with the state before."""
    w = W.partitionBy(*keys).orderBy(at)
    out = df.withColumn("before", F.lag(state).over(w)).withColumn("_first_", F.row_number().over(w) == 1)
    return out.where(F.col("_first_") | ~F.col("before").eqNullSafe(F.col(state))).drop("_first_")


def replay(changed: DataFrame, grid: DataFrame, keys: list[str], at: str, state: str) -> DataFrame:
    """The state at each place of the grid: that of the last change at or before it."""
    both = grid.select(*keys, at, F.lit(None).cast(changed.schema[state].dataType).alias(state), F.lit(1).alias("_asks_"))
    both = both.unionByName(changed.select(*keys, at, state, F.lit(0).alias("_asks_")))
    told = F.last(state, ignorenulls=True).over(W.partitionBy(*keys).orderBy(at, "_asks_").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(state, told).where("_asks_ = 1").drop("_asks_")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encoding: keys, run (from 1), value, n."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d = df.withColumn("_new_", new).withColumn("run", F.sum("_new_").over(w))
    return d.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def top_with_rest(df: DataFrame, keys: list[str], name: str, value: str, k: int, rest: str = "everyone else") -> DataFrame:
    """The k largest of each key, ties by name, and one row that sums the others."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), F.asc(name)))
    d = df.withColumn("_nth_", nth)
    d = d.withColumn(name, F.when(F.col("_nth_") <= k, F.col(name)).otherwise(F.lit(rest))).withColumn("rank", F.least("_nth_", F.lit(k + 1)))
    return d.groupBy(*keys, name, "rank").agg(F.sum(value).alias(value))
