"""Gold tables kept up to date: only files that are new or have changed are read, only what depends on them is made again.

A store is a folder. Tables of single snapshots are pure functions of a file as it was, so each state of a file has
partitions of its own, which are written once (``saves``). The manifest says which states there are and which stand for
their campaign and date; its versions are whole tables, and the name of the current one is written last, so a refresh
that is cut short changes nothing that is read and is simply done again. Tables that look at neighbours (``derived``)
are made again for the dates and campaigns that a change touches: of owners for a date and the next one after it,
of gains and growth for the campaign, from the stored facts of nations.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import year_fraction
from ..operators.lineage import cut
from ..sources.blocks import campaigns
from ..streaming.keeper import place
from .campaign import gains, growth, long_counts, market_snapshot, nations

MANIFEST = "path string, length long, modified timestamp, campaign string, date string, reason string, key string, stands boolean"
MEASURES = ["total_pop", "brigades"]


def _key() -> Column:
    """A state of a file."""
    return F.substring(F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modified").cast("string")), 256), 1, 20)


def _by(path: Column) -> Column:
    """A path as it is compared: sources differ in the slashes of a local one."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modified, key of a folder's snapshots and those of the folders inside it; no content is read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.v2").option("recursiveFileLookup", "true").load(folder)
    return f.select(_by(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified")).withColumn("key", _key())


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """The current manifest (MANIFEST); empty for a store that is not there yet."""
    fs, path = place(f"{store}/current.json")
    if not fs.get_file_info(path).is_file:
        return spark.createDataFrame([], MANIFEST)
    with fs.open_input_stream(path) as f:
        return spark.read.schema(MANIFEST).parquet(f"{store}/manifest-{json.loads(f.read())['version']}")


def _commit(new: DataFrame, store: str) -> None:
    fs, path = place(f"{store}/current.json")
    old = None
    if fs.get_file_info(path).is_file:
        with fs.open_input_stream(path) as f:
            old = json.loads(f.read())["version"]
    version = 0 if old is None else old + 1
    new.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest-{version}")
    with fs.open_output_stream(f"{path}.new") as f:
        f.write(json.dumps({"version": version}).encode())
    fs.move(f"{path}.new", path)


def _standing(files: DataFrame) -> DataFrame:
    """files with stands: of the readable ones of a campaign and date, the last by name."""
    nth = F.row_number().over(W.partitionBy("campaign", "date", F.col("reason").isNull()).orderBy(F.desc("path")))
    return files.withColumn("stands", F.col("reason").isNull() & (nth == 1))


def _write(df: DataFrame, at: str, *by: str) -> None:
    """Replaces the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(at)


def _tables(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is kept of each snapshot, by save_id."""
    return {"nations": nations(t), "province": t["province"], "market": market_snapshot(t), **long_counts(t)}


def refresh(spark: SparkSession, folder: str, store: str) -> dict[str, int]:
    """Brings a store up to date with a folder; returns how many files were added or changed and gone, and dates touched.

    Broken files are in the manifest with their reason and are read again when they change. Repeating a refresh, or doing
    it again after a crash, gives the same store.
    """
    old, now = cut(manifest(spark, store)), cut(listed(spark, folder))
    fresh = cut(now.join(old, "key", "left_anti"))
    gone = old.join(now, "key", "left_anti")
    read, n_gone = fresh.count(), gone.count()
    if not read and not n_gone:
        return {"read": 0, "gone": 0, "touched": 0}
    kept = old.join(now, "key", "left_semi").select(*(c.split()[0] for c in MANIFEST.split(", ")))
    if read:
        # the paths of files to be read go to Spark's own source, as any list of files does
        t = campaigns(spark, [r["path"] for r in fresh.select("path").collect()])
        states = t["files"].withColumn("path", _by(F.col("path"))).select("path", "campaign", "date", "reason")
        added = fresh.join(states, "path", "left").withColumn("reason", F.when(F.col("campaign").isNull(), "empty").otherwise(F.col("reason")))
        keys = cut(added.where("reason is null").select(F.col("path").alias("p"), F.col("key").alias("save")))
        for name, df in _tables(t).items():
            _write(df.withColumn("p", _by(F.col("save_id"))).join(F.broadcast(keys), "p").drop("p"), f"{store}/saves/{name}", "save")
        kept = kept.unionByName(added.withColumn("stands", F.lit(False)).select(kept.columns))
    new = cut(_standing(kept))
    touched = cut(_touched(old, new))
    _derive(spark, store, new, touched)
    _commit(new, store)
    return {"read": read, "gone": n_gone, "touched": touched.count()}


def _touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """campaign, date: where another state of a file stands than before, or none."""
    a, b = (d.where("stands").select("campaign", "date", F.col("key").alias(c)) for d, c in ((old, "was"), (new, "is_")))
    return a.join(b, ["campaign", "date"], "full").where(~F.col("was").eqNullSafe(F.col("is_"))).select("campaign", "date")


def _dates(new: DataFrame) -> DataFrame:
    """campaign, date, save, at, previous (date) and previous_save of what stands."""
    w = W.partitionBy("campaign").orderBy("at")
    return new.where("stands").select("campaign", "date", F.col("key").alias("save"), year_fraction(F.col("date")).alias("at")).withColumns({"previous": F.lag("date").over(w), "previous_save": F.lag("save").over(w)})


def _derive(spark: SparkSession, store: str, new: DataFrame, touched: DataFrame) -> None:
    dates = cut(_dates(new))
    # a date is made again if it is touched, or if one between it and the date before it is
    t = touched.withColumn("changed", year_fraction(F.col("date"))).select("campaign", "changed")
    again = dates.withColumn("since", F.coalesce(year_fraction(F.col("previous")), F.lit(-1.0))).join(t, "campaign").where("changed <= at and changed >= since").select("campaign", "date", "save", "previous_save").distinct()
    again = cut(again)
    saved = _stored(spark, store, "province")
    if saved is not None:
        p = saved.join(F.broadcast(again.select("save", "campaign", "date")), "save").select("campaign", "date", "pid", "owner")
        q = saved.join(F.broadcast(again.where("previous_save is not null").select(F.col("previous_save").alias("save"), "campaign", "date")), "save").select("campaign", "date", "pid", F.col("owner").alias("before"))
        changes = p.join(q, ["campaign", "date", "pid"], "left").where(~F.col("owner").eqNullSafe(F.col("before")))
        none = again.select("campaign", "date", F.lit(None).cast("long").alias("pid"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("before"))
        _write(changes.unionByName(none), f"{store}/derived/owners", "campaign", "date")  # a row of nulls, so that a date without changes replaces one with
    of = touched.select("campaign").distinct()
    n = _stored(spark, store, "nations")
    if n is not None:
        n = n.drop("campaign", "date", "year_frac").join(F.broadcast(dates.join(of, "campaign").select("save", "campaign", "date", F.col("at").alias("year_frac"))), "save")
        n = cut(n.select("campaign", "tag", "date", "year_frac", *MEASURES))
        for m in MEASURES:
            _write(gains(n, m).select("campaign", "tag", "date", "gain"), f"{store}/derived/gain_{m}", "campaign")
            _write(growth(n, m), f"{store}/derived/growth_{m}", "campaign")


def _stored(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    fs, path = place(f"{store}/saves/{name}")
    return spark.read.parquet(f"{store}/saves/{name}") if fs.get_file_info(path).type.name == "Directory" else None


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the snapshots that stand, with their campaign and date; ``owners``, ``gain_...`` and ``growth_...`` are derived."""
    now = manifest(spark, store).where("stands")
    fs, path = place(f"{store}/derived/{name}")
    if fs.get_file_info(path).type.name == "Directory":
        d = spark.read.parquet(f"{store}/derived/{name}").withColumn("campaign", F.col("campaign").cast("string"))
        if name == "owners":
            d = d.where("pid is not null").withColumn("date", F.col("date").cast("string"))
            return d.join(now.select("campaign", "date"), ["campaign", "date"], "left_semi")
        return d.join(now.select("campaign").distinct(), "campaign", "left_semi")
    d = spark.read.parquet(f"{store}/saves/{name}")
    return d.drop("campaign", "date", "save_id").join(now.select(F.col("key").alias("save"), "campaign", "date"), "save").drop("save")
