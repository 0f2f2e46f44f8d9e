"""The keeper: a stream that copies each snapshot a game writes, once it is whole, into the folder of its campaign.

A game rotates a few file names, so files are told apart by path, length and time of change. Each batch lists the
folder; a file's sightings are the state of its path, and it counts once two in a row are alike. What counts is read
and copied by tasks. Campaigns are a small table beside the copies: its versions are written whole, batch by batch, so
a batch that is repeated after a crash finds the campaigns as they were before it and copies that are there already.
A file is held against campaigns in a join; no task holds all files or campaigns of a stream.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.window import Window as W

from ..operators.lineage import cut

#: Fixed: bytes of a file's head, and how many flags lost make two games, from how many flags on they tell anything.
HEAD, MOST_LOST, EVIDENCE = 400_000, 6, 3

SIGHTING = "path string, length long, modified long"
HEADER = f"{SIGHTING}, date string, months int, tag string, start_date string, flags array<string>, prefix string"
CAMPAIGN = "campaign string, start_date string, prefix string, first string, months int, date string, tag string, flags array<string>, tags array<struct<date:string,months:int,tag:string>>, folder string"


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file and its path there; plain paths are local."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def trouble(saves: str, out: str) -> str | None:
    """Why a folder cannot be kept, or None: copies must not lie in the watched folder, or they would be copied themselves."""
    fs, a = place(saves)
    _, b = place(out)
    if fs.get_file_info(a).type != pafs.FileType.Directory:
        return f"there is no folder of saves at {saves}"
    return f"keep the copies outside the watched folder: {out} is inside {saves}" if (b.rstrip("/") + "/").startswith(a.rstrip("/") + "/") else None


class _Folder(InputPartition):
    pass


class _SightingsReader(DataSourceStreamReader):
    """An offset is a time; what is between two is the folder as it is found."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, root = place(self.root)
        inside = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [_Folder((root, False)), *(_Folder((f.path, True)) for f in inside if f.type == pafs.FileType.Directory)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, deep = partition.value
        fs, _ = place(self.root)
        for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=deep)):
            if f.type == pafs.FileType.File and f.base_name.lower().endswith(".v2"):
                yield f.path, f.size, f.mtime_ns


class Sightings(DataSource):
    """A streaming source, ``sightings``: path, length and time of change of a folder's snapshots, anew in each batch.

    The folders inside it are listed by tasks of their own.
    """

    @classmethod
    def name(cls) -> str:
        return "sightings"

    def schema(self) -> str:
        return SIGHTING

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SightingsReader(self.options["path"])


class Settle(StatefulProcessor):
    """Hands on a path's sighting once when it is like the one before; forgets paths not seen for ``forget_ms``."""

    def __init__(self, forget_ms: int = 86_400_000):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "length long, modified long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        length, modified, told = self.seen.get() if self.seen.exists() else (-1, -1, False)
        out = []
        for r in (r for d in rows for r in d.sort_values("modified").itertuples()):
            alike = (r.length, r.modified) == (length, modified)
            if alike and not told:
                out.append((key[0], length, modified))
            length, modified, told = int(r.length), int(r.modified), alike
        self.seen.update((length, modified, told))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        yield pd.DataFrame(out, columns=["path", "length", "modified"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame(columns=["path", "length", "modified"])


def settled(spark: SparkSession, saves: str, forget_ms: int = 86_400_000) -> DataFrame:
    """A stream of the snapshots (SIGHTING) in a folder that were alike in two batches on end, each state of a file once."""
    spark.dataSource.register(Sightings)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = spark.readStream.format("sightings").option("path", saves).load()
    return seen.groupBy("path").transformWithStateInPandas(Settle(forget_ms), SIGHTING, "append", "ProcessingTime")


def head_fields(head: bytes) -> tuple[str, str, str, list[str]] | None:
    """date, player, start_date and flags of a snapshot's first bytes; None if it is packed or tells no date or player."""
    if head[:2] == b"PK" or b"date=" not in head[:4096]:
        return None
    found: dict[bytes, str] = {}
    for m in re.finditer(rb'(date|player|start_date)\s*=\s*"([^"]*)"', head):
        found.setdefault(m[1], m[2].decode("latin-1"))
    if b"date" not in found or b"player" not in found or not re.fullmatch(r"\d{1,4}\.\d{1,2}\.\d{1,2}", found[b"date"]):
        return None
    block = re.search(rb"(?ms)^flags=\s*\{(.*?)^\}", head)
    flags = sorted({m.decode() for m in re.findall(rb"(?m)^\s*([A-Za-z_]\w*)\s*=", block[1])}) if block else []
    return found[b"date"], found[b"player"], found.get(b"start_date", ""), flags


def headers(files: DataFrame, saves: str, every_months: int = 1) -> DataFrame:
    """files (SIGHTING) with what their heads say, as HEADER; one that has changed or gone meanwhile is left for later.

    Of the months only every n-th of a year is kept, from January. prefix: the folders between ``saves`` and the file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = place(saves)
        for d in batches:
            out = []
            for path, length, modified in zip(d["path"], d["length"], d["modified"], strict=True):
                try:
                    with fs.open_input_stream(path) as f:
                        found = head_fields(f.read(HEAD))
                    now = fs.get_file_info(path)
                except OSError:
                    continue
                if found is None or (now.size, now.mtime_ns) != (length, modified):
                    continue
                y, m, _ = map(int, found[0].split("."))
                if (m - 1) % every_months == 0:
                    prefix = " ".join(path.removeprefix(root.rstrip("/") + "/").split("/")[:-1])
                    out.append((path, length, modified, found[0], y * 12 + m - 1, *found[1:], prefix))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HEADER.split(", ")])

    return files.mapInPandas(run, HEADER)


def matched(files: DataFrame, campaigns: DataFrame) -> DataFrame:
    """path, modified, campaign of files that continue a campaign: fewest flags lost, of those of the same tag first.

    Flags gather: of two snapshots of one game the later has the earlier one's. A file may be the earlier one, after a
    reload. Where either has too few flags to tell, only the same tag and start date count, and last.
    """
    f = files.select("path", "modified", "start_date", F.col("tag").alias("f_tag"), F.col("flags").alias("f_flags"), F.col("months").alias("f_months"))
    j = f.join(campaigns.select("campaign", "start_date", "tag", "flags", "months"), "start_date")
    later = F.col("f_months") >= F.col("months")
    lost = F.when(later, F.size(F.array_except("flags", "f_flags"))).otherwise(F.size(F.array_except("f_flags", "flags")))
    lost = F.when((F.size("flags") >= EVIDENCE) & (F.size("f_flags") >= EVIDENCE), lost)
    same = F.col("f_tag") == F.col("tag")
    rank = F.when(lost.isNull() & same, F.struct(F.lit(2).alias("r"), F.lit(0).alias("lost"))).when(lost < MOST_LOST, F.struct(F.when(same, 0).otherwise(1).alias("r"), lost.alias("lost")))
    return j.withColumn("rank", rank).where("rank is not null").groupBy("path", "modified").agg(F.min_by("campaign", F.struct("rank", "campaign")).alias("campaign"))


def assigned(files: DataFrame, campaigns: DataFrame) -> DataFrame:
    """files (HEADER) with the campaign of each: one that it continues, or one that the batch begins.

    Files that continue none are taken in rounds: the earliest of each start date begins a campaign, and the others
    are held against those. campaign: the start date, the first file's tag and date, and a hash of the file's path,
    time and start, which is alike in every run.
    """
    left = cut(files.dropDuplicates(["path", "modified"]))
    known, out = campaigns.select("campaign", "start_date", "tag", "flags", "months"), []
    while True:
        found = cut(matched(left, known))
        out.append(left.join(found, ["path", "modified"]))
        left = cut(left.join(found, ["path", "modified"], "left_anti"))
        if left.isEmpty():
            break
        first = F.row_number().over(W.partitionBy("start_date").orderBy("months", "path", "modified"))
        code = F.substring(F.sha2(F.concat_ws("|", "start_date", "path", F.col("modified").cast("string"), "date", "tag"), 256), 1, 16)
        seeds = cut(left.withColumn("nth", first).where("nth = 1").drop("nth").withColumn("campaign", F.concat_ws("-", "start_date", "tag", "date", code)))
        out.append(seeds.select(out[0].columns))
        left = cut(left.join(seeds, ["path", "modified"], "left_anti"))
        known = seeds.select("campaign", "start_date", "tag", "flags", "months")
        if left.isEmpty():
            break
    rows = out[0]
    for d in out[1:]:
        rows = rows.unionByName(d)
    return rows


def updated(campaigns: DataFrame, files: DataFrame) -> DataFrame:
    """campaigns with what a batch's assigned files add: the newest by date, and tags in the order they were played."""
    told = files.select("campaign", "start_date", "prefix", "path", "months", "date", "tag", "flags")
    one = F.struct("date", "months", "tag")
    new = told.groupBy("campaign").agg(
        F.min("start_date").alias("start_date"), F.min_by("prefix", F.struct("months", "path")).alias("prefix"), F.min_by("date", F.struct("months", "path")).alias("first"), F.max_by(F.struct("months", "date", "tag", "flags"), F.struct("months", "path")).alias("newest"),
        F.collect_set(one).alias("tags"), F.lit(None).cast("string").alias("folder"),
    )
    new = new.select("campaign", "start_date", "prefix", "first", "newest.*", "tags", "folder")
    old = F.lit(1).alias("seen")
    both = campaigns.select("*", old).unionByName(new.select("*", F.lit(2).alias("seen")))
    newest = F.max_by(F.struct("months", "date", "tag", "flags"), F.struct("months", "seen"))
    g = both.groupBy("campaign").agg(
        F.min("start_date").alias("start_date"), F.min_by("prefix", "seen").alias("prefix"), F.min_by("first", F.struct(F.element_at(F.array_sort("tags"), 1)["months"], "seen")).alias("first"), newest.alias("newest"),
        F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"), F.max("folder").alias("folder"),
    )
    # of each tag its first date is enough
    tags = F.array_sort(F.transform("tags", lambda x: F.struct(x["months"].alias("months"), x["tag"].alias("tag"), x["date"].alias("date"))))
    firsts = F.filter(tags, lambda x, i: ~F.exists(F.slice(tags, 1, i), lambda y: y["tag"] == x["tag"]))
    return g.select("campaign", "start_date", "prefix", "first", "newest.*", F.transform(firsts, lambda x: F.struct(x["date"].alias("date"), x["months"].alias("months"), x["tag"].alias("tag"))).alias("tags"), "folder").select([c.split()[0] for c in re.split(r", (?![^<]*>)", CAMPAIGN)])


def titled(campaigns: DataFrame) -> DataFrame:
    """campaigns with title: the folders of their game, their tags in order and the year they began; numbered where alike."""
    year = F.split_part(F.when(F.col("start_date") != "", F.col("start_date")).otherwise(F.col("first")), F.lit("."), F.lit(1))
    title = F.concat(F.when(F.col("prefix") != "", F.concat("prefix", F.lit(" "))).otherwise(""), F.array_join(F.transform("tags", lambda x: x["tag"]), "-"), F.lit(" "), year)
    nth = F.row_number().over(W.partitionBy("plain").orderBy(F.col("folder").isNull(), "campaign"))
    d = campaigns.withColumn("plain", title).withColumn("nth", nth)
    return d.withColumn("title", F.when(F.col("nth") > 1, F.concat("plain", F.lit(" ("), "nth", F.lit(")"))).otherwise(F.col("plain"))).drop("plain", "nth")


def copied(files: DataFrame, saves: str, out: str) -> DataFrame:
    """path, modified, length, dest, kept of files (HEADER, title): copied under their tag and date into their campaign's folder.

    A copy is made under another name and moved into place once it is as long as the file and the file has not changed
    since; else kept is false and nothing is left. A copy of the same length that is there already is kept as it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = place(saves)
        to, root = place(out)
        for d in batches:
            rows = []
            for r in d.itertuples():
                y, m, day = map(int, r.date.split("."))
                dest = f"{root.rstrip('/')}/{r.title}/{r.tag}{y:04d}_{m:02d}_{day:02d}.v2"
                there = to.get_file_info(dest)
                kept = there.type == pafs.FileType.File and there.size == r.length
                if not kept:
                    part = f"{dest}.{uuid.uuid4().hex}.part"
                    to.create_dir(f"{root.rstrip('/')}/{r.title}", recursive=True)
                    try:
                        pafs.copy_files(r.path, part, source_filesystem=fs, destination_filesystem=to)
                        now = fs.get_file_info(r.path)
                        kept = (now.size, now.mtime_ns) == (r.length, r.modified) and to.get_file_info(part).size == r.length
                        if kept:
                            to.move(part, dest)
                    except OSError:
                        kept = False
                    finally:
                        if not kept and to.get_file_info(part).type == pafs.FileType.File:
                            to.delete_file(part)
                rows.append((r.path, r.modified, r.length, dest, kept))
            yield pd.DataFrame(rows, columns=["path", "modified", "length", "dest", "kept"])

    return files.select("path", "length", "modified", "date", "tag", "title").mapInPandas(run, "path string, modified long, length long, dest string, kept boolean")


class Ledger:
    """The campaigns beside the copies: a whole table for each batch, of which the last two are held."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.root = spark, f"{out.rstrip('/')}/.keeper"

    def _versions(self) -> list[int]:
        fs, path = place(self.root)
        return sorted(int(f.base_name.removeprefix("batch-").removesuffix(".json")) for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".json"))

    def before(self, batch: int) -> DataFrame:
        """The campaigns as they were when a batch began."""
        old = [v for v in self._versions() if v < batch]
        return self.spark.read.schema(CAMPAIGN).parquet(f"{self.root}/batch-{old[-1]}") if old else self.spark.createDataFrame([], CAMPAIGN)

    def latest(self) -> DataFrame:
        return self.before(1 << 62)

    def write(self, campaigns: DataFrame, batch: int) -> None:
        """A version counts once its mark is there, so one that was cut short is written again."""
        campaigns.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batch-{batch}")
        fs, path = place(self.root)
        with fs.open_output_stream(f"{path}/batch-{batch}.json") as f:
            f.write(json.dumps({"batch": batch}).encode())
        for v in self._versions()[:-2]:
            fs.delete_file(f"{path}/batch-{v}.json")
            fs.delete_dir(f"{path}/batch-{v}")


def _retitle(campaigns: DataFrame, out: str) -> DataFrame:
    """Moves the folders of campaigns whose title has changed, as far as no such folder is there; folder: what it is called now.

    Campaigns are a game's own playthroughs; only those whose title differs from their folder's name come to the driver.
    """
    fs, root = place(out)
    root = root.rstrip("/")
    changed = campaigns.where("folder is not null and folder <> title").select("campaign", "folder", "title").collect()
    kept = []
    for r in changed:
        here, there = (fs.get_file_info(f"{root}/{x}").type == pafs.FileType.Directory for x in (r["folder"], r["title"]))
        if here and not there:
            fs.move(f"{root}/{r['folder']}", f"{root}/{r['title']}")
        elif here:
            kept.append((r["campaign"], r["folder"]))
    still = campaigns.sparkSession.createDataFrame(kept, "campaign string, still string")
    return campaigns.join(F.broadcast(still), "campaign", "left").withColumn("folder", F.coalesce("still", "title")).drop("still", "title")


def keep_batch(files: DataFrame, batch: int, saves: str, out: str, every_months: int = 1) -> None:
    """Copies a batch of settled files (SIGHTING) and writes the campaigns after it; repeating it changes nothing."""
    spark = files.sparkSession
    heads = cut(headers(files, saves, every_months))
    if heads.isEmpty():
        return
    ledger = Ledger(spark, out)
    campaigns = cut(ledger.before(batch))
    rows = cut(assigned(heads, campaigns))
    after = cut(_retitle(titled(updated(campaigns, rows)), out))
    done = cut(copied(rows.join(after.select("campaign", F.col("folder").alias("title")), "campaign"), saves, out))
    kept = rows.join(done.where("kept").select("path", "modified"), ["path", "modified"], "left_semi")
    final = updated(campaigns, kept).drop("folder").join(after.select("campaign", "folder"), "campaign").select(after.columns)
    ledger.write(final, batch)


def keep(spark: SparkSession, saves: str, out: str, checkpoint: str, every_months: int = 1, poll: str = "5 seconds") -> StreamingQuery:
    """Starts a query that keeps copies of a folder's snapshots; stop it, and start it again with the same checkpoint to go on."""
    if why := trouble(saves, out):
        raise ValueError(why)
    stream = settled(spark, saves)
    return stream.writeStream.foreachBatch(lambda d, n: keep_batch(d, n, saves, out, every_months)).option("checkpointLocation", checkpoint).trigger(processingTime=poll).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The campaigns kept in a folder (CAMPAIGN), each with its newest snapshot's date, tag and flags."""
    return Ledger(spark, out).latest()
