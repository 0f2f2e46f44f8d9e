"""Snapshot files read block by block, as typed rows, by all tasks at once.

In a snapshot as the game writes it every top-level block ends with a ``}`` at the start of a line. Spark's own text
reader takes that as the end of a record, so one file is split over many tasks and no task holds a file. Each record,
the scalars before a block and the block, is cut at its tabs: what no table needs is passed over without being
tokenised, and provinces and population groups become typed rows. Every cut is proved by counts of braces and
of indented lines; a record that is laid out otherwise is tokenised as a whole, and a file whose records are not
whole blocks (see ``layout`` of file_states()) is read by the tokenizer of sources.saves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .saves import KEPT, LEAVES, POP_FIELDS, leaves, one_per_date, tables

#: others: a line ``key=value`` for each field that is not known.
PROVINCE = "struct<pid:bigint,owner:string,controller:string,cores:array<string>,colonial:string,naval_base:array<string>,fort:array<string>,railroad:array<string>>"
POP = "struct<pop_ord:bigint,pid:bigint,pop_type:string,others:string,size:string,id:string,literacy:string,con:string,mil:string,life_needs:string>"
#: What a split of a file shows of it: where the part begins and ends, its bytes, whether each record is a whole block.
PART = "struct<size:bigint,at:bigint,last:bigint,bytes:bigint,whole:boolean,open:boolean,head:binary,tail:binary>"
BLOCKS = f"kind string, {LEAVES}, province {PROVINCE}, pop {POP}, part {PART}"

END = b"\n}"
TAG = re.compile(rb"[A-Z][A-Z0-9]{2}")
#: The sub-blocks of a country that tables are made from.
OF_COUNTRY = frozenset([b"culture", b"technology", b"active_inventions", b"flags", b"saved_country_supply", b"modifier", b"state", b"army", b"navy", b"scheduled_mobilization"])
OF_PROVINCE = frozenset([b"naval_base", b"fort", b"railroad"])
NUMBERS = ("size", "id", "literacy", "con", "mil", "life_needs")
KEY = re.compile(rb'[^\s={}"#\x1c-\x1f\x85\xa0]+=')
FIELD_1, FIELD_2 = (re.compile(r"\n" + "\t" * n + r'([^\s={}"#]+)=(?:"([^"\r\n]*)"|([^\s={}"#]+))\r*(?=\n|\Z)') for n in (1, 2))
ITEM = re.compile(r'"([^"]*)"|([^\s"]+)')
ROWS = 20_000


class NotLaidOut(Exception):
    """A block is not laid out line by line at its depth."""


def _opens(after: bytes) -> bool:
    """Whether a line ends here, after a brace."""
    return after.lstrip(b"\r")[:1] in (b"\n", b"")


def _children(body: bytes, depth: int) -> tuple[list[tuple[bytes, bytes]], bytes]:
    """The (key, content) of each block at a depth of tabs in a body, and the lines between them.

    Raises NotLaidOut unless braces and indents prove that these are all of the blocks and lines at that depth.
    """
    tabs = b"\n" + b"\t" * depth
    deeper = tabs + b"\t"
    pieces = body.split(tabs + b"{")
    between, out = [pieces[0]], []
    for piece in pieces[1:]:
        inner, closed, after = piece.partition(tabs + b"}")
        if not closed or inner.count(b"\n") != inner.count(deeper) or not (inner[:2] == b"\r\n" or _opens(inner)) or not (after[:2] == b"\r\n" or _opens(after)):
            raise NotLaidOut
        if (b"{" in inner or b"}" in inner) and (inner.count(b"{") != inner.count(b"}") or inner.find(b"}") < inner.find(b"{")):
            raise NotLaidOut
        lines, _, key = between[-1].rstrip(b"\r").rpartition(tabs)
        if not key.endswith(b"=") or KEY.fullmatch(key) is None:
            raise NotLaidOut
        between[-1] = lines
        out.append((key[:-1], inner))
        between.append(after)
    rest = b"".join(between)
    if b"{" in rest or b"}" in rest or rest.count(b"\n") != rest.count(tabs) or tabs + b"\t" in rest or not _opens(rest):
        raise NotLaidOut
    return out, rest


def _fields(lines: str, pattern: re.Pattern) -> list[tuple[str, str, str]]:
    """(key, quoted value, value) of each line; raises NotLaidOut if a line holds anything but one field."""
    found = pattern.findall(lines)
    if len(found) != lines.count("\n"):
        raise NotLaidOut
    return found


def _group(content: bytes) -> list[tuple[str, str, str]]:
    """The fields of a block two tabs in, without those of the blocks inside it; raises NotLaidOut as _children() does."""
    if b"{" not in content:
        return _fields(_text(content), FIELD_2)
    pieces = content.split(b"\n\t\t}")
    last, own = pieces.pop(), []
    for piece in pieces:
        part, opened, nested = piece.partition(b"\n\t\t{")
        if not opened or b"{" in nested or b"}" in nested or nested.count(b"\n") != nested.count(b"\n\t\t\t") or part.rstrip(b"\r")[-1:] != b"=" or nested.lstrip(b"\r")[:1] != b"\n" or not _opens(piece):
            return _fields(_text(_children(content, 2)[1]), FIELD_2)  # as an empty block, or one with blocks of its own
        own.append(part)
    rest = _text(b"".join([*own, last]))
    found = FIELD_2.findall(rest)  # a line ``key=`` before each block is none
    if rest.count("\n") != len(found) + len(pieces) or "{" in rest or "\n\t\t\t" in rest or not _opens(last):
        raise NotLaidOut
    return found


def _lined(text: str, path: list[str], block: int, order: int) -> Iterator[tuple]:
    """(ord, path, block, parent, key, value) of the leaves of a block's content, as leaves() gives them.

    Raises NotLaidOut unless each line is a brace, ``key=`` before one, one field, or plain items of a list.
    """
    stack: list[list] = [[block, 0, 0]]  # number, that of the block around, leaves
    path, pending, blocks = list(path), None, block
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        if s == "{":
            blocks += 1
            stack[-1][2] += 1
            stack.append([blocks, stack[-1][0], 0])
            path.append(pending or "")
            pending = None
            continue
        if pending is not None or "{" in s or (s != "}" and "}" in s) or "#" in s:
            raise NotLaidOut
        if s == "}":
            if len(stack) == 1:
                raise NotLaidOut
            number, around, n = stack.pop()
            if not n:
                order += 1
                yield order, list(path), number, around, None, None
            path.pop()
            continue
        key, equals, value = s.partition("=")
        if equals:
            if not key or '"' in key or "=" in value or len(key.split()) > 1 or key[-1].isspace():
                raise NotLaidOut
            if not value:
                pending = key
                continue
            if value[0] == '"':
                if len(value) < 2 or value[-1] != '"' or '"' in value[1:-1]:
                    raise NotLaidOut
                value = value[1:-1]
            elif '"' in value or len(value.split()) > 1 or value[0].isspace():
                raise NotLaidOut
            fields = ((key, value),)
        elif '"' in s:
            if s.count('"') % 2:
                raise NotLaidOut
            fields = tuple((None, m[1] if m[1] is not None else m[2]) for m in ITEM.finditer(s))
        else:
            fields = tuple((None, x) for x in s.split())
        top = stack[-1]
        for k, v in fields:
            top[2] += 1
            order += 1
            yield order, list(path), top[0], top[1], k, v
    if len(stack) > 1 or pending is not None:
        raise NotLaidOut
    if not stack[0][2]:
        yield order + 1, list(path), block, 0, None, None


def _text(b: bytes) -> str:
    return b.decode("latin-1")


class Reader:
    """Reads the records of one split of a file in turn into rows of BLOCKS' columns."""

    def __init__(self, path: str, start: int):
        self.path, self.at, self.start = path, start + (start > 0), start
        self.head, self.tail, self.whole, self.bytes = b"", b"", True, 0
        self.begin = self.last = self.at
        self.open = False

    def record(self, data: bytes) -> Iterator[tuple[str, tuple]]:
        """(kind, row) of one record; its place in the file numbers what is in it, in the order of the file."""
        if len(self.head) < 4096 and not self.start:
            self.head = (self.head + data[:4096] + END)[:4096]
        at, self.last, self.tail = self.at, self.at, data[-256:]
        self.at += len(data) + len(END)
        self.bytes += len(data) + len(END)
        opened, closed = data.count(b"{"), data.count(b"}")
        self.open = bool(opened or closed)
        if opened - closed != 1:
            self.whole = self.whole and not self.open  # only a last record has no block
            if not self.open:
                yield from self._scalars(data, at)
            return
        before, opened, body = data.partition(b"\n{")
        lines, _, key = before.rstrip(b"\r").rpartition(b"\n")
        if not opened or not key.endswith(b"=") or b"{" in before or b"}" in before or not _opens(body):
            self.whole = False
            return
        yield from self._scalars(lines, at)
        key, at = key[:-1].strip(), at + len(before)
        if key.isdigit():
            try:
                yield from self._province(key, body, at)
            except NotLaidOut:
                yield from self._loose(key, body, at)
        elif TAG.fullmatch(key):
            try:
                rows = list(self._country(key, body, at))
            except NotLaidOut:
                rows = list(self._loose(key, body, at))
            yield from rows
        elif _text(key) in KEPT:
            yield from self._loose(key, body, at)
        elif b"{" in body and body.find(b"}") < body.find(b"{"):
            self.whole = False

    def _scalars(self, lines: bytes, at: int) -> Iterator[tuple[str, tuple]]:
        if lines.strip():
            for r in leaves(_text(lines)):
                yield "leaf", (self.path, at + r[0], *r[1:2], at, *r[3:])

    def _loose(self, key: bytes, body: bytes, at: int) -> Iterator[tuple[str, tuple]]:
        """A block by the tokenizer: typed rows of a province, leaves of any other."""
        text = _text(body)
        try:
            rows = list(_lined(text, [], at, at))
        except NotLaidOut:
            rows = []
            for r in leaves(f"{_text(key)}={{{text}\n}}", every=True):
                if r[1] is None or r[2] != 1:  # a brace too many has closed the block before its end
                    self.whole = False
                    return
                rows.append((at + r[0], r[3], at + r[4] - 1, at + r[5] - 1 if r[5] else 0, r[6], r[7]))
        if not key.isdigit():
            yield from (("leaf", (self.path, n, _text(key), at, p, number, around, k, v)) for n, p, number, around, k, v in rows)
            return
        yield from self.typed(int(key), at, rows)

    def typed(self, pid: int, at: int, rows: list[tuple]) -> Iterator[tuple[str, tuple]]:
        """The typed rows of a province from its leaves (ord, path, block, parent, key, value)."""
        top = [(k, v) for _, p, _, _, k, v in rows if not p and k is not None]
        inside: dict[str, list[str]] = {"naval_base": [], "fort": [], "railroad": []}
        groups: dict[int, tuple[str, list]] = {}
        for _, p, number, _, k, v in rows:
            if p and p[0] in inside and v is not None:
                inside[p[0]].append(v)
            if len(p) == 1:
                groups.setdefault(number, (p[0], []))[1].append((k, v))
        yield "province", self._province_row(pid, at, dict(top), [v for k, v in top if k == "core"], inside)
        for number, (kind, fields) in groups.items():
            if row := self._pop_row(pid, at, number, kind, [(k, v) for k, v in fields if k is not None]):
                yield "pop", row

    def file(self, text: str) -> Iterator[tuple[str, tuple]]:
        """The rows of a whole file by the tokenizer."""
        for (top, at), rows in groupby(leaves(text), key=lambda r: (r[1], r[2])):
            if top and top.isdigit():
                yield from self.typed(int(top), at, [(r[0], *r[3:]) for r in rows])
            else:
                yield from (("leaf", (self.path, *r)) for r in rows)

    def _province_row(self, pid: int, at: int, last: dict, cores: list[str], inside: dict[str, list[str]]) -> tuple:
        return self.path, at, pid, last.get("owner"), last.get("controller"), cores, last.get("colonial"), inside["naval_base"], inside["fort"], inside["railroad"]

    def _pop_row(self, pid: int, at: int, number: int, kind: str, fields: list[tuple[str, str]]) -> tuple | None:
        last = dict(fields)
        others = "\n".join([f"{k}={v}" for k, v in fields if k not in POP_FIELDS])
        if not others or "size" not in last:
            return None
        return self.path, at, number, pid, kind, others, *map(last.get, NUMBERS)

    def _province(self, key: bytes, body: bytes, at: int) -> Iterator[tuple[str, tuple]]:
        blocks, lines = _children(body, 1)
        fields = [(k, q or v) for k, q, v in _fields(_text(lines), FIELD_1)]
        pid, pops, inside = int(key), [], {k: [] for k in OF_PROVINCE}
        for nth, (name, content) in enumerate(blocks, 1):
            if name in OF_PROVINCE:
                inside[name] += [r[5] for r in _lined(_text(content), [], 0, 0) if r[5] is not None]
            elif b"size=" in content:
                if row := self._pop_row(pid, at, at + nth, _text(name), [(k, q or v) for k, q, v in _group(content)]):
                    pops.append(row)
        yield "province", self._province_row(pid, at, dict(fields), [v for k, v in fields if k == "core"], {_text(k): v for k, v in inside.items()})
        yield from (("pop", p) for p in pops)

    def _country(self, key: bytes, body: bytes, at: int) -> Iterator[tuple[str, tuple]]:
        blocks, lines = _children(body, 1)
        tag, order, number = _text(key), at, at
        for k, q, v in _fields(_text(lines), FIELD_1):
            order += 1
            yield "leaf", (self.path, order, tag, at, [], at, 0, k, q or v)
        for name, content in blocks:
            number += 1
            if name in OF_COUNTRY:
                for n, path, block, around, k, v in _lined(_text(content), [_text(name)], number, order):
                    order = n
                    yield "leaf", (self.path, n, tag, at, path, block, around or at, k, v)
                number += content.count(b"{")
        if not blocks and order == at:
            yield "leaf", (self.path, at + 1, tag, at, [], at, 0, None, None)

    def part(self, size: int) -> tuple:
        return self.path, size, self.begin, self.last, self.bytes, self.whole, self.open, self.head, self.tail


def read_blocks(spark: SparkSession, folder: str | list[str], recursive: bool = False) -> DataFrame:
    """Rows of BLOCKS of the snapshots in a folder, file by file: leaf, province, pop, and a part for each split.

    ord, top_ord, block, parent and pop_ord are places in the file's bytes or lie between them, so they are in the file's order.
    """
    f = spark.read.format("text").option("lineSep", END.decode()).option("pathGlobFilter", "*.v2").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    meta = F.col("_metadata")
    f = f.select(F.col("value").cast("binary").alias("record"), meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_block_start"].alias("start"))
    schema = _schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader, size = Held(schema), None, 0
        for b in batches:
            for record, path, size_, start in zip(b["record"], *(b[c].to_pylist() for c in ("path", "size", "start")), strict=True):
                if reader is None or (reader.path, reader.start) != (path, start):
                    if reader:
                        held.add("part", reader.part(size))
                    reader, size = Reader(path, start), size_
                for kind, row in reader.record(record.as_py()):
                    held.add(kind, row)
                yield from held.full()
        if reader:
            held.add("part", reader.part(size))
        yield from held.full(1)

    return f.mapInArrow(run, BLOCKS)


def _schema() -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(BLOCKS))


class Held:
    """Rows of several kinds, handed on as batches of BLOCKS' columns when there are enough of a kind."""

    #: A kind's own columns, and the struct that the others make.
    COLUMNS = {"leaf": ([c.split()[0] for c in LEAVES.split(", ")], None), "province": (["save_id", "top_ord"], "province"), "pop": (["save_id", "top_ord"], "pop"), "part": (["save_id"], "part")}

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, {k: [] for k in self.COLUMNS}

    def add(self, kind: str, row: tuple) -> None:
        self.rows[kind].append(row)

    def full(self, least: int = ROWS) -> Iterator[pa.RecordBatch]:
        for kind, rows in self.rows.items():
            if len(rows) >= least:
                self.rows[kind] = []
                names, struct = self.COLUMNS[kind]
                columns = list(zip(*rows, strict=True))
                told = {c: pa.array(v, self.schema.field(c).type) for c, v in zip(names, columns, strict=False)} | {"kind": pa.array([kind] * len(rows))}
                if struct:
                    fields = list(self.schema.field(struct).type)
                    told[struct] = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns[len(names) :], fields, strict=True)], fields=fields)
                yield pa.RecordBatch.from_arrays([told[f.name] if f.name in told else pa.nulls(len(rows), f.type) for f in self.schema], schema=self.schema)


def file_states(blocks: DataFrame) -> DataFrame:
    """path, campaign, length, date, reason (null if readable; see read_files()) and layout (read block by block) of each file.

    A file whose parts' bytes are not those that were listed has changed while it was read.
    """
    p = blocks.where("kind = 'part'").select("save_id", "part.*").groupBy(F.col("save_id").alias("path")).agg(
        F.max("size").alias("length"), F.sum("bytes").alias("bytes"), F.bool_and("whole").alias("whole"), F.max_by("open", "last").alias("open"), F.min_by("head", "at").alias("head"), F.max_by("tail", "last").alias("tail"),
    )
    head, tail = F.decode("head", "ISO-8859-1"), F.regexp_replace(F.decode("tail", "ISO-8859-1"), r"\s+$", "")
    date = F.regexp_extract(head, r'(?m)^date="?(\d{1,4}\.\d{1,2}\.\d{1,2})', 1)
    ended = F.col("bytes") == F.col("length")  # with the end of a block; else there is one record more, that nothing ends
    reason = F.when(head.startswith("PK"), "packed").when(date == "", "no date").when(~ended & (F.col("bytes") != F.col("length") + len(END)), "changed").when(~ended & (tail != "") & ~tail.endswith("}"), "cut off")
    layout = F.col("whole") & (ended | ~F.col("open"))
    return p.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("campaign"), "length", date.alias("date"), reason.alias("reason"), layout.alias("layout"))


def otherwise_laid_out(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Rows of BLOCKS of the files (path, layout) that cannot be read block by block, each file by one task.

    Their names, which are few since the game writes no such files, go through the driver to Spark's file source.
    """
    paths = [r["path"] for r in files.where("not layout").select("path").collect()]
    schema = _schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(schema)
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                for kind, row in Reader(path, 0).file(_text(content.as_py())):
                    held.add(kind, row)
                    if len(held.rows[kind]) >= ROWS:
                        yield from held.full()
        yield from held.full(1)

    if not paths:
        return spark.createDataFrame([], BLOCKS)
    f = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("p"), "content")
    named = files.where("not layout").select("path", F.regexp_replace("path", "^file:/+", "file:/").alias("p"))
    return f.withColumn("p", F.regexp_replace("p", "^file:/+", "file:/")).join(F.broadcast(named), "p").select("path", "content").mapInArrow(run, BLOCKS)


def campaigns(spark: SparkSession, folder: str | list[str], recursive: bool = False) -> dict[str, DataFrame]:
    """The tables of sources.saves.tables(), the files' states (files) and the leaves (rows), from blocks read once.

    What is read is persisted: typed columns, most of them null, which each table takes its own of.
    """
    b = read_blocks(spark, folder, recursive).persist(StorageLevel.DISK_ONLY)
    states = file_states(b)
    kept = one_per_date(states).persist(StorageLevel.DISK_ONLY)
    whole = b.join(kept.where("layout").select(F.col("path").alias("save_id")), "save_id", "left_semi").select(b.columns)
    rows = whole.unionByName(otherwise_laid_out(spark, kept))
    t = tables(kept, rows.where("kind = 'leaf'").select([c.split()[0] for c in LEAVES.split(", ")]), rows)
    return t | {"files": states, "rows": rows}
