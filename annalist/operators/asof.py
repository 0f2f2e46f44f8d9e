"""As-of, nearest and interval joins, which Spark SQL has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], forward: bool = False, tolerance: float | None = None, clamp: bool = False) -> DataFrame:
    """left with the values of right's last row at or before ``at`` (the first at or after it, if forward).

    clamp: where there is none, the first (last) row of the key instead. tolerance: none farther than this. right has
    one row for a key and place. One sort of both tables by key and place, in place of a range join, and one
    pass over each key's rows.
    """
    pick = F.struct(F.col(at).alias("t"), *values)
    r = right.select(*keys, at, pick.alias("_found_"), F.lit(1 if forward else 0).alias("_left_"), F.lit(None).alias("_row_"))
    l = left.select(*keys, at, F.lit(None).alias("_found_"), F.lit(0 if forward else 1).alias("_left_"), F.struct(*left.columns).alias("_row_"))  # noqa: E741
    both = r.unionByName(l)
    key = W.partitionBy(*keys)
    w = key.orderBy(F.desc(at), F.desc("_left_")) if forward else key.orderBy(at, "_left_")
    found = F.last("_found_", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    if clamp:  # the key's last or first row, taken once for the key
        place = F.when(F.col("_found_").isNotNull(), F.col(at))
        found = F.coalesce(found, (F.max_by if forward else F.min_by)("_found_", place).over(key))
    out = both.withColumn("_got_", found).where("_row_ is not null")
    if tolerance is not None:
        near = F.abs(F.col(at).cast("double") - F.col("_got_.t").cast("double")) <= tolerance
        out = out.withColumn("_got_", F.when(near, F.col("_got_")))
    return out.select("_row_.*", *(F.col(f"_got_.{v}").alias(v) for v in values))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of right's row of the least distance in ``at`` (a number), the earlier of two."""
    b = asof(left.withColumn("_id_", F.monotonically_increasing_id()), right.withColumn("_t0_", F.col(at)), keys, at, [*values, "_t0_"])
    for v in [*values, "_t0_"]:
        b = b.withColumnRenamed(v, f"_b_{v}")
    a = asof(b, right.withColumn("_t0_", F.col(at)), keys, at, [*values, "_t0_"], forward=True)
    nearer = F.col("_t0_").isNull() | (F.col(at) - F.col("_b__t0_") <= F.col("_t0_") - F.col(at))
    return a.select(*left.columns, *(F.when(F.coalesce(nearer, F.lit(False)), F.col(f"_b_{v}")).otherwise(F.col(v)).alias(v) for v in values))


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, keys: list[str] = ()) -> DataFrame:
    """Points with the spans that hold them, start <= at <= end: an equi-join on buckets of ``width``, then the test.

    A span is copied into each bucket that it touches, so width should be near the common span's length.
    """
    bucket = lambda c: F.floor(F.col(c).cast("double") / width).cast("long")
    p = points.withColumn("_bucket_", bucket(at))
    s = spans.where(F.col(start) <= F.col(end)).withColumn("_bucket_", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(s, [*keys, "_bucket_"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bucket_")


def running(spans: DataFrame, start: str, end: str, last: DataFrame, step: int, block: int = 4096) -> DataFrame:
    """at, running: how many spans, start <= at <= end, hold each of the dates 0, step, 2 * step and so on, where any does.

    start, end: whole numbers; a span without one of them, or that ends before it starts, holds no date. last: one row
    and column, which no date is beyond. A span is two rows, one where it begins to count and one where it no longer
    does; the rows of a date are summed, then dates within blocks of ``block``, then what comes before each block.
    """
    size = step * block
    nth = lambda c: F.greatest(F.ceil(c / step), F.lit(0)).cast("long") * step
    s = spans.where(F.col(start) <= F.col(end)).select(F.explode(F.array(F.struct(nth(F.col(start)).alias("at"), F.lit(1).alias("n")), F.struct(nth(F.col(end) + 1).alias("at"), F.lit(-1).alias("n")))).alias("x")).select("x.*")
    t = F.col(last.columns[0]).cast("long")
    blocks = last.where(t >= 0).select(t.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), t, F.lit(size).cast("long"))).alias("b"))
    dates = blocks.repartition("b").select(F.explode(F.sequence("b", F.least("t", F.col("b") + size - step), F.lit(step).cast("long"))).alias("at"), F.lit(0).alias("n"))
    turns = s.join(F.broadcast(last.select(t.alias("t"))), F.col("at") <= F.col("t")).select("at", "n").union(dates).groupBy("at").agg(F.sum("n").alias("n")).withColumn("b", F.floor(F.col("at") / size))
    before = turns.groupBy("b").agg(F.sum("n").alias("n")).select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("n").over(W.partitionBy("b").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumn("within", within).join(F.broadcast(before), "b").select("at", (F.col("within") + F.col("before")).alias("running")).where("running > 0")
