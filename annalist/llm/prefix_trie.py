"""Prefix trie of conversations: a level-order trie for each prefix shard, the heavy upper levels merged separately.

A turn becomes a digest of 16 bytes, a sequence of turns the digest of the one before it and its last turn. Nodes that
many conversations share are found by counting prefixes; together they are the top of the trie. What hangs below it
falls into subtrees of boundedly many conversations. Tasks read whole subtrees, build a trie of them level by level
(a bit vector in LOUDS order, a one for each child and a zero for each node, beside the array of labels), take parents
from its ranks and roll counts up in reverse level order. Their sums by node above then enter the same rollup of the top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

KEY = 16
NONE = np.iinfo(np.int64).max
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Louds:
    """A forest in level order: node 0 is above all roots; bits: a one for each child and a zero, node by node."""

    def __init__(self, parents: np.ndarray, levels: list[int], labels: np.ndarray):
        """parents: of nodes 1 on, ascending; levels: where each level begins, and the end; labels: by node, of nodes 1 on."""
        n = len(parents) + 1
        children = np.bincount(parents, minlength=n)
        self.bits = np.ones(2 * n - 1, bool)
        self.bits[np.cumsum(children + 1) - 1] = False
        self.levels, self.labels = levels, labels

    @property
    def n(self) -> int:
        return (len(self.bits) + 1) // 2

    def children(self) -> np.ndarray:
        """How many each node has: the ones between two zeros."""
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros, prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Of nodes 1 on: the zeros before their ones."""
        return np.flatnonzero(self.bits) - np.arange(self.n - 1)

    def rolled(self, own: np.ndarray, at=np.add.at) -> np.ndarray:
        """Each node's own value and those of all below it, from the last level to the first."""
        out, up = own.copy(), self.parents()
        for a, b in zip(reversed(self.levels[:-1]), reversed(self.levels[1:]), strict=True):
            at(out, up[a - 1 : b - 1], out[a:b])
        return out


def forest(keys: list[np.ndarray]) -> tuple[Louds, np.ndarray]:
    """A trie of sequences of keys (n x 2 words each) and the node of each key of each sequence in turn."""
    n = np.array([len(k) for k in keys], np.int64)
    flat, first = np.concatenate(keys), np.concatenate([[0], np.cumsum(n)])[:-1]
    of, up = np.zeros(len(flat), np.int64), np.zeros(len(keys), np.int64)
    live, levels, parents, labels = np.flatnonzero(n > 0), [1], [], []
    while len(live):
        at = first[live] + len(levels) - 1
        order = np.lexsort((flat[at, 1], flat[at, 0], up[live]))
        live, at = live[order], at[order]
        k, above = flat[at], up[live]
        new = np.ones(len(live), bool)
        new[1:] = (above[1:] != above[:-1]) | (k[1:] != k[:-1]).any(axis=1)
        parents.append(above[new])
        labels.append(k[new])
        of[at] = up[live] = levels[-1] + np.cumsum(new) - 1
        levels.append(levels[-1] + int(new.sum()))
        live = live[n[live] >= len(levels)]
    return Louds(np.concatenate(parents or [np.zeros(0, np.int64)]), levels, np.concatenate(labels or [flat])), of


def ends_of(node: np.ndarray, conv: np.ndarray, n: int) -> list[str]:
    """By node, the SHA-256 of the decimal numbers that end there, ascending and joined by commas."""
    out = [EMPTY_SHA] * n
    order = np.lexsort((conv, node))
    node, conv = node[order], conv[order]
    for a, b in _runs(node):
        out[node[a]] = hashlib.sha256(",".join(map(str, conv[a:b].tolist())).encode()).hexdigest()
    return out


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(x)]
    return zip(bounds, bounds[1:], strict=False) if len(x) else iter(())


def rebuilt(conversations: DataFrame, shared: int = 9, family: int = 5) -> DataFrame:
    """conv_id and turns (digest, n: bytes of the text) of every rebuilt conversation.

    Turns are in order of their number, null first, equal ones in order of their digests. Conversation c starts with
    the first h turns of conversation c - c % family, h = crc32 of c's decimals modulo ``shared``, and goes on with its
    own turns after its first h. Fewer turns than that are all; an absent conversation has none. A null role or text
    is an empty one. Rows of a null conv_id belong to no conversation. A conversation's digests, 24 bytes a turn, are
    one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, KEY)
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n")).alias("t"))
    own = scratch(t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["digest"].alias("digest"), x["n"].alias("n"))).alias("turns")), "conversations")
    base = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, shared - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    joined = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": h}).join(base, "base", "left")
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (of each prefix, KEY bytes one after another) and sizes (bytes of each text, as 64-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(1)
            at, flat = turns.offsets.to_pylist(), turns.values
            digests, sizes = flat.field("digest").to_pylist(), flat.field("n").to_numpy(zero_copy_only=False).astype("<i8")
            keys = []
            for a, b in zip(at, at[1:], strict=False):
                k, out = b"", []
                for d in digests[a:b]:
                    k = hashlib.blake2b(k + d, digest_size=KEY).digest()
                    out.append(k)
                keys.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([sizes[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["conv_id", "keys", "sizes"])

    return conversations.select("conv_id", "turns").mapInArrow(run, "conv_id long, keys binary, sizes binary")


def _split(keys: bytes) -> list[bytes]:
    return [keys[i : i + KEY] for i in range(0, len(keys), KEY)]


def heavy_nodes(p: DataFrame, least: int, most: int) -> dict[bytes, tuple[int, int]]:
    """n_convs and the smallest conv_id by key of the nodes that more than ``least`` conversations share.

    Fewer than ``most`` are heavy in any corpus: where there are many turns a heavy node has more than turns / most.
    """
    turns = p.agg(F.sum(F.octet_length("keys") / KEY)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([k for x in keys for k in _split(x)], pa.binary()), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) // KEY for x in keys]), pa.int64())], ["key", "conv_id"])

    counted = p.mapInArrow(run, "key binary, conv_id long").groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    found = counted.where(F.col("n") > F.lit(max(least, int(turns // most)))).toArrow()
    return dict(zip(found["key"].to_pylist(), zip(found["n"].to_pylist(), found["conv_id"].to_pylist(), strict=True), strict=True))


def trie(conversations: DataFrame, least: int = 1000, most: int = 500_000, held: int = 100_000) -> DataFrame:
    """A row of NODE for each distinct sequence of first turns of the rebuilt conversations (conv_id, turns).

    Conversations without turns are members of the root alone; an empty table gives no rows. A conversation is one
    row's work, a subtree below the heavy nodes one task's: at most ``least`` conversations, or a share of 1 / ``most``
    of all turns. The numbers that end at one node, its hash's input, are read as a sorted stream.
    """
    spark = conversations.sparkSession
    p = scratch(paths(conversations), "paths")
    total = p.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).first()
    top = spark.sparkContext.broadcast(heavy_nodes(p, least, most))
    first = total["conv_id"]

    def cut_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = top.value
        for batch in batches:
            rows = []
            for conv, keys, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                each = _split(keys)
                s = next((d for d, k in enumerate(each) if k not in heavy), len(each))
                above = each[s - 1] if s else b""
                for d in range(s):  # a heavy node is told of by its smallest member
                    if heavy[each[d]][1] == conv:
                        rows.append(("top", each[d], each[d - 1] if d else b"", conv, heavy[each[d - 1]][1] if d else first, d + 1, b"", sizes[8 * d : 8 * d + 8]))
                if s == len(each):
                    rows.append(("end", above, b"", conv, 0, s, b"", b""))
                else:
                    rows.append(("below", each[s], above, conv, heavy[above][1] if s else first, s, keys[KEY * s :], sizes[8 * s :]))
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["what", "key", "above", "conv_id", "parent_conv_id", "depth", "keys", "sizes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names)

    parts = scratch(p.mapInArrow(cut_below, "what string, key binary, above binary, conv_id long, parent_conv_id long, depth long, keys binary, sizes binary"), "parts")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, turns, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if turns > held and r["key"] != last:  # only between two subtrees
                    yield _subtrees(rows)
                    rows, turns = [], 0
                rows.append(r)
                turns, last = turns + len(r["sizes"]) // 8, r["key"]
        if rows:
            yield _subtrees(rows)

    subtrees = parts.where("what = 'below'").repartition("key").sortWithinPartitions("key", "conv_id").select("key", "above", "conv_id", "parent_conv_id", "depth", "keys", "sizes")
    low = scratch(subtrees.mapInArrow(below, NODE + ", above binary"), "nodes")

    hung = low.where("above is not null").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("hung"), F.sum("n_leaves").alias("hung_leaves"), F.sum("saved_tokens").alias("hung_saved"))
    ends = parts.where("what = 'end'").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_streamed, "key binary, ends_sha256 string")
    upper = parts.where("what = 'top'").select("key", "above", "conv_id", "parent_conv_id", "depth", "sizes")
    root = spark.createDataFrame([(bytearray(), None, first, None, 0, bytearray(8))] if total["n"] else [], upper.schema)
    high = upper.union(root).join(hung, "key", "left").join(ends, "key", "left")

    def upper_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if rows:
            yield _top(rows, top.value, total["n"])

    return low.select(*(c.split()[0] for c in NODE.split(", "))).unionByName(high.repartition(1).mapInArrow(upper_levels, NODE))


def _batch(**columns) -> pa.RecordBatch:
    """Rows of NODE and, if given, above."""
    kinds = {c.split()[0]: pa.string() if c.endswith("string") else pa.int64() for c in NODE.split(", ")} | {"above": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) for c in columns], list(columns))


def _subtrees(rows: list[dict]) -> pa.RecordBatch:
    """The nodes of whole subtrees, from the parts of their conversations below the heavy nodes."""
    keys = [np.frombuffer(r["keys"], "<u8").reshape(-1, 2) for r in rows]
    t, of = forest(keys)
    up, children, lengths = t.parents(), t.children(), np.array([len(k) for k in keys])
    tops, last = of[np.cumsum(lengths) - lengths], of[np.cumsum(lengths) - 1]
    conv = np.array([r["conv_id"] for r in rows], np.int64)
    smallest = np.full(t.n, NONE, np.int64)
    np.minimum.at(smallest, last, conv)
    smallest = t.rolled(smallest, np.minimum.at)
    n = t.rolled(np.bincount(last, minlength=t.n).astype(np.int64))
    leaves = t.rolled((children == 0).astype(np.int64))
    size = np.zeros(t.n, np.int64)
    size[of] = np.frombuffer(b"".join(r["sizes"] for r in rows), "<i8")
    saved = t.rolled((n - 1) * size)
    depth, parent = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
    depth[tops] = [r["depth"] for r in rows]
    parent[tops] = [r["parent_conv_id"] for r in rows]
    above = np.full(t.n, None, object)
    above[tops] = [r["above"] for r in rows]
    for a, b in zip(t.levels[1:-1], t.levels[2:], strict=True):
        depth[a:b], parent[a:b] = depth[up[a - 1 : b - 1]] + 1, smallest[up[a - 1 : b - 1]]
    ends = ends_of(last, conv, t.n)
    return _batch(conv_id=smallest[1:], depth=depth[1:] + 1, parent_conv_id=parent[1:], n_convs=n[1:], n_children=children[1:], n_leaves=leaves[1:], saved_tokens=saved[1:], ends_sha256=ends[1:], above=above[1:])


def _top(rows: list[dict], heavy: dict[bytes, tuple[int, int]], total: int) -> pa.RecordBatch:
    """The heavy nodes and the root, with what hangs below them added to the rollups."""
    rows.sort(key=lambda r: r["depth"])
    place, by_depth = {}, np.array([r["depth"] for r in rows])
    levels = np.searchsorted(by_depth, np.arange(by_depth[-1] + 2)).tolist()
    for a, b in zip(levels, levels[1:], strict=False):  # children in their parents' order, as a level-order trie has them
        rows[a:b] = sorted(rows[a:b], key=lambda r: (place.get(r["above"], -1), r["key"]))
        place |= {r["key"]: i for i, r in enumerate(rows[a:b], a)}
    of = lambda c: np.array([0, *(r[c] or 0 for r in rows)], np.int64)
    labels = np.array([np.frombuffer(r["key"].ljust(KEY, b"\0"), "<u8") for r in rows])
    t = Louds(np.array([0, *(place[r["above"]] + 1 for r in rows[1:])], np.int64), [x + 1 for x in levels], labels)
    children = t.children() + of("hung")
    n = np.array([0, total, *(heavy[r["key"]][0] for r in rows[1:])], np.int64)
    size = np.array([0, *(int.from_bytes(r["sizes"], "little") for r in rows)], np.int64)
    leaves = t.rolled((children == 0).astype(np.int64) + of("hung_leaves"))
    saved = t.rolled((n - 1) * size + of("hung_saved"))
    return _batch(conv_id=of("conv_id")[1:], depth=by_depth, parent_conv_id=[r["parent_conv_id"] for r in rows], n_convs=n[1:], n_children=children[1:], n_leaves=leaves[1:], saved_tokens=saved[1:], ends_sha256=[r["ends_sha256"] or EMPTY_SHA for r in rows])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's numbers, from rows sorted by key and number; no key's rows are held."""
    key, sha = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])
    for batch in batches:
        keys, conv = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        a = 0
        while a < len(keys):
            b = next((i for i in range(a, len(keys)) if keys[i] != keys[a]), len(keys))
            text = ",".join(map(str, conv[a:b])).encode()
            if keys[a] == key:
                sha.update(b"," + text)
            else:
                if sha:
                    yield out()
                key, sha = keys[a], hashlib.sha256(text)
            a = b
    if sha:
        yield out()


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


#: crc32 by its polynomial, bit by bit, since DuckDB has none; sequences of turns are told apart by all of their text.
OP12_SQL = """
with c as materialized (select conv_id, conv_id - conv_id % 5 as base,
    xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint),
      lambda acc, b: list_reduce([xor(acc, b)] || range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 9 as h
  from (select distinct conv_id from conversations where conv_id is not null)),
o as materialized (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
r as (select c.conv_id, o.pos, o.role, o.text from c join o on o.conv_id = c.base and o.pos < c.h
  union all select c.conv_id, coalesce(least(c.h, b.n), 0) + o.pos - c.h, o.role, o.text from c join o on o.conv_id = c.conv_id and o.pos >= c.h left join (select conv_id, count(*) as n from o group by all) b on b.conv_id = c.base),
k as materialized (select conv_id, pos + 1 as depth, strlen(text) as size, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' order by pos) over (partition by conv_id order by pos rows unbounded preceding)) as key from r
  union all select conv_id, 0, 0, '' from c),
n as materialized (select key, any_value(depth) as depth, any_value(size) as size, count(*) as n_convs, min(conv_id) as conv_id from k group by key),
e as (select n.*, u.key as above, u.conv_id as parent_conv_id from n left join k on k.conv_id = n.conv_id and k.depth = n.depth - 1 left join n u on u.key = k.key),
ch as materialized (select above as key, count(*) as n_children from e where above is not null group by all),
below as materialized (select k.key, count(*) filter (ch.key is null) as n_leaves, sum((n.n_convs - 1) * n.size)::bigint as saved_tokens from n join k on k.conv_id = n.conv_id and k.depth <= n.depth left join ch on ch.key = n.key group by all),
f as (select key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from (select conv_id, arg_max(key, depth) as key from k group by conv_id) group by key)
select e.conv_id, e.depth, e.parent_conv_id, e.n_convs, coalesce(ch.n_children, 0) as n_children, below.n_leaves, below.saved_tokens,
  coalesce(f.ends_sha256, sha256('')) as ends_sha256
from e join below using (key) left join ch using (key) left join f using (key)
"""
