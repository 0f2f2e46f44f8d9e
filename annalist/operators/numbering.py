"""Dense numbers for distinct things, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .lineage import cut


def content_key(*parts: Column) -> Column:
    """128 bits of what is in the columns, arrays and structs included, told apart from other contents."""
    return F.substring(F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(parts))), {"ignoreNullFields": "false"}), 256), 1, 32)


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with its rows' places in an order, from 0: places within ranges of the order, and what comes before each range.

    The ranges' sizes are as many rows as there are ranges; ties of the order get any of their places.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range_", F.spark_partition_id()))
    sizes = ranged.groupBy("_range_").agg(F.count("*").alias("_n_"))
    before = sizes.withColumn("_before_", F.coalesce(F.sum("_n_").over(W.orderBy("_range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n_")
    place = F.row_number().over(W.partitionBy("_range_").orderBy(*order)) - 1
    return ranged.withColumn("_place_", place).join(F.broadcast(before), "_range_").withColumn(name, (F.col("_place_") + F.col("_before_")).cast("long")).drop("_range_", "_place_", "_before_")


def dictionary(df: DataFrame, holder: list[str], content: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(profiles: profile, key, holders, and the columns of the first holder; uses: holder, profile) of equal contents.

    profile: dense numbers from 0, in the order of each content's first holder.
    """
    keyed = cut(df.select(*holder, content_key(*content).alias("key")))
    each = keyed.groupBy("key").agg(F.min(F.struct(*holder)).alias("first"), F.count("*").alias("holders"))
    profiles = cut(numbered(each.select("key", "first.*", "holders"), holder, "profile"))
    return profiles, keyed.join(profiles.select("key", "profile"), "key").select(*holder, "profile")
