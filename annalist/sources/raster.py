"""A map of provinces: a 24-bit bitmap read by ranges of its lines, as runs of one province.

The bitmap is cut into ranges of lines, each read by a task of its own; what leaves a task are runs of equal colour, some
hundred for a line, never pixels. Colours are joined to provinces, and all geometry is worked out from runs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window as W

from ..functions.scalars import half_even
from ..streaming.keeper import place

#: Fixed: what a province's marker is placed by, in this order.
SPOTS = ["unit", "text_position", "building_construction", "military_construction", "factory", "city", "town"]
RUNS = "y int, x int, n int, colour int"


def bitmap_header(uri: str) -> tuple[int, int, int, int] | None:
    """(where the pixels begin, width, height, bytes a line) of a 24-bit bitmap, else None."""
    fs, path = place(uri)
    try:
        with fs.open_input_stream(path) as f:
            head = f.read(54)
    except OSError:
        return None
    if len(head) < 54 or head[:2] != b"BM" or struct.unpack_from("<H", head, 28)[0] != 24:
        return None
    width, height = struct.unpack_from("<ii", head, 18)
    return struct.unpack_from("<I", head, 10)[0], width, height, (width * 24 + 31) // 32 * 4


def line_runs(line: bytes, width: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and colours (blue first, as stored) of a line's runs, of every scale-th pixel; what is missing is black."""
    cells = width // scale
    raw = np.zeros(width * 3, np.uint8)
    got = np.frombuffer(line, np.uint8)[: width * 3]
    got = got[: len(got) // 3 * 3]
    raw[: len(got)] = got
    p = raw.reshape(-1, 3)[: cells * scale : scale].astype(np.int32)
    colour = p[:, 0] | p[:, 1] << 8 | p[:, 2] << 16
    start = np.flatnonzero(np.concatenate([[True], colour[1:] != colour[:-1]])) if cells else np.zeros(0, np.int64)
    return start, np.diff(start, append=cells), colour[start]


class _Lines(InputPartition):
    pass


class _BitmapReader(DataSourceReader):
    def __init__(self, path: str, scale: int, lines: int):
        self.path, self.scale, self.lines = path, scale, lines

    def partitions(self) -> list[InputPartition]:
        head = bitmap_header(self.path)
        height = max(0, head[2] // self.scale) if head and head[1] > 0 else 0
        return [_Lines((a, min(a + self.lines, height))) for a in range(0, height, self.lines)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        at, width, _, stride = bitmap_header(self.path)
        fs, path = place(self.path)
        schema = pa.schema([(c, pa.int32()) for c in ("y", "x", "n", "colour")])
        with fs.open_input_file(path) as f:
            size = f.size()
            for y in range(*partition.value):
                begin = at + y * self.scale * stride
                x, n, colour = line_runs(f.read_at(max(0, min(stride, size - begin)), min(begin, size)), width, self.scale)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), y), pa.int32()), *(pa.array(c, pa.int32()) for c in (x, n, colour))], schema=schema)


class Bitmap(DataSource):
    """A source, ``bitmap_runs``: RUNS of a bitmap; options path, scale (1) and lines, how many a task reads (64)."""

    @classmethod
    def name(cls) -> str:
        return "bitmap_runs"

    def schema(self) -> str:
        return RUNS

    def reader(self, schema) -> DataSourceReader:
        return _BitmapReader(self.options["path"], int(self.options.get("scale", 1)), int(self.options.get("lines", 64)))


def definitions(files: DataFrame, path: str = "map", name: str = "definition.csv") -> DataFrame:
    """colour (as a bitmap stores it), pid, name of rule files' table of colours; of equal colours or ids the last line."""
    d = files.where((F.lower("folder") == path) & (F.lower("name") == name)).select(F.posexplode(F.split("text", "\n")).alias("nth", "line")).where("nth > 0")
    cell = lambda i: F.trim(F.get(F.split("line", ";"), F.lit(i)))
    whole = lambda i: cell(i).try_cast("int")
    d = d.select("nth", whole(0).alias("pid"), (whole(3) + whole(2) * 256 + whole(1) * 65536).alias("colour"), F.coalesce(F.trim(F.regexp_replace(cell(4), r"[\r\n]", "")), F.lit("")).alias("name"))
    d = d.where("pid is not null and colour is not null")
    return d.groupBy("colour").agg(F.max_by("pid", "nth").alias("pid"), F.max_by("name", "nth").alias("name"))


def province_runs(spark: SparkSession, path: str, colours: DataFrame, scale: int = 1, lines: int = 64) -> DataFrame:
    """y, x, n, pid of a bitmap's runs of one province, in lines as the file has them; 0 where no province has the colour.

    A file that is no 24-bit bitmap has none. Runs of different colours of one province are one.
    """
    spark.dataSource.register(Bitmap)
    r = spark.read.format("bitmap_runs").option("path", path).option("scale", scale).option("lines", lines).load()
    return merged(r.join(F.broadcast(colours.select("colour", "pid")), "colour", "left").select("y", "x", "n", F.coalesce("pid", F.lit(0)).cast("long").alias("pid")))


def merged(runs: DataFrame) -> DataFrame:
    """Runs that touch on a line and are of one province as one: y, x, n, pid."""
    w = W.partitionBy("y").orderBy("x")
    new = F.when((F.lag("pid").over(w) == F.col("pid")) & (F.lag(F.col("x") + F.col("n")).over(w) == F.col("x")), 0).otherwise(1)
    d = runs.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return d.groupBy("y", "run", "pid").agg(F.min("x").alias("x"), F.sum("n").alias("n")).select("y", "x", "n", "pid")


def geometry(runs: DataFrame) -> DataFrame:
    """pid, area, x0, x1, y0, y1, cx, cy of every province but 0: its cells, box and centre."""
    n, x = F.col("n"), F.col("x")
    g = runs.where("pid <> 0").groupBy("pid").agg(
        F.sum("n").alias("area"), F.min("x").alias("x0"), F.max(x + n - 1).alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        (F.sum(n * x + n * (n - 1) / 2) / F.sum("n")).alias("cx"), (F.sum(n * F.col("y")) / F.sum("n")).alias("cy"),
    )
    return g


def adjacency(runs: DataFrame, span: int = 64) -> DataFrame:
    """a, b (a < b): provinces, 0 aside, that touch on a line or from one line to the next.

    Runs meet those of the next line that share one of the parts of ``span`` cells that they reach into.
    """
    r = runs.where("pid <> 0")
    beside = r.withColumn("end", F.col("x") + F.col("n")).join(r.select("y", F.col("x").alias("end"), F.col("pid").alias("other")), ["y", "end"]).select("pid", "other")
    parts = F.explode(F.sequence(F.floor(F.col("x") / span), F.floor((F.col("x") + F.col("n") - 1) / span)))
    low = r.select("y", "x", (F.col("x") + F.col("n")).alias("end"), "pid", parts.alias("part"))
    high = low.select((F.col("y") - 1).alias("y"), F.col("x").alias("x2"), F.col("end").alias("end2"), F.col("pid").alias("other"), "part")
    above = low.join(high, ["y", "part"]).where("x < end2 and x2 < end").select("pid", "other")
    both = beside.unionByName(above).where("pid <> other")
    return both.select(F.least("pid", "other").alias("a"), F.greatest("pid", "other").alias("b")).distinct()


def anchors(runs: DataFrame) -> DataFrame:
    """pid, x, y: the cell of each province that is nearest to its centre, the first by line and place of equals."""
    m = geometry(runs).select("pid", "cx", "cy")
    r = runs.join(m, "pid")
    # of a run the nearest cell is the centre's, or its end; of two that are as near the left one
    near = F.greatest(F.col("x"), F.least(F.col("x") + F.col("n") - 1, F.ceil(F.col("cx") - 0.5)))
    d = r.withColumn("at", near.cast("int")).withColumn("far", F.round(F.pow(F.col("at") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2), 6))
    return d.groupBy("pid").agg(F.min_by(F.struct(F.col("at").alias("x"), "y"), F.struct("far", "y", "at")).alias("p")).select("pid", "p.x", "p.y")


def halved(runs: DataFrame) -> DataFrame:
    """Runs at half the scale: of each two by two cells the most common province, of equals the first by line and place."""
    cells = runs.select("y", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("n") - 1)).alias("x"), "pid")
    k = cells.groupBy(F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), "pid").agg(F.count("*").alias("n"), F.min(F.struct(F.col("y").alias("v"), F.col("x").alias("u"))).alias("first"))
    best = k.groupBy("y", "x").agg(F.min_by("pid", F.struct(-F.col("n"), "first")).alias("pid"))
    return merged(best.select("y", "x", F.lit(1).alias("n"), "pid"))


def markers(anchors: DataFrame, positions: DataFrame, height: int, scale: int = 1) -> DataFrame:
    """pid, x, y to one decimal: where a province's marker stands: where rule files place its units (pid, x, y from below), else its anchor.

    height: the lines of a map read at 1 / ``scale``.
    """
    told = positions.select("pid", half_even(F.col("x") / scale, 1).alias("px"), half_even((height * scale - F.col("y")) / scale, 1).alias("py"))
    return anchors.join(told, "pid", "full").select("pid", F.coalesce("px", F.col("x").cast("double")).alias("x"), F.coalesce("py", F.col("y").cast("double")).alias("y"))


def positions(tree: DataFrame) -> DataFrame:
    """pid, x, y of rule files' positions (sources.rules.rule_tree()): of units, else of the first of the others that has an x."""
    t = tree.where((F.col("folder") == "map") & (F.col("name") == "positions.txt") & (F.size("path") == 1) & F.col("key").isin("x", "y") & ~F.col("is_block"))
    spot = t.select(F.col("top").try_cast("long").alias("pid"), F.array_position(F.array(*map(F.lit, SPOTS)), F.get("path", F.lit(0))).alias("at"), "key", F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)).alias("v"), "node").where("pid is not null and at > 0")
    first = lambda k: F.min_by("v", F.when(F.col("key") == k, F.col("node")))
    each = spot.groupBy("pid", "at").agg(first("x").alias("x"), F.coalesce(first("y"), F.lit(0.0)).alias("y")).where("x is not null")
    return each.groupBy("pid").agg(F.min_by(F.struct("x", "y"), "at").alias("p")).select("pid", "p.x", "p.y")


def stacks(units: DataFrame, of: list[str], markers: DataFrame) -> DataFrame:
    """of, pid, x, y, total, sides of units (of, pid, tag, n): those in one province as one stack, the largest side first.

    A stack of several sides is contested. Units in no province that the map has are left out.
    """
    side = units.groupBy(*of, "pid", "tag").agg(F.sum("n").alias("n"))
    g = side.groupBy(*of, "pid").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "tag", "n"))).alias("sides"))
    return g.select(*of, "pid", "total", F.transform("sides", lambda s: F.struct(s["tag"].alias("tag"), s["n"].alias("n"))).alias("sides")).join(markers, "pid").withColumn("contested", F.size("sides") > 1)
