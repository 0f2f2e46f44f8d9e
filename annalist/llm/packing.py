"""Packing documents into sequences by non-negative least squares over a histogram of lengths.

Documents are tokenised once. Each is cut into full windows, a head of whole units (64 ids) and a tail of less than a
unit. Shallow combinations of head lengths that fill a window exactly are enumerated; non-negative least squares finds
how often to repeat each against the histogram of heads; the counts are rounded down. What is left over, heads by
length and then all tails, is packed greedily end to end and cut at the windows' ends; the last window is cut into
powers of two, which need no padding. Ranks and offsets are sums over the parts that tasks have written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, scratch

WINDOW, UNIT, END_ID = 4096, 64, 2


def combinations(units: int, depth: int = 4) -> np.ndarray:
    """Every way to fill ``units`` with 2 to ``depth`` lengths of 1 to units - 1, as a row of counts by length."""
    found = []
    for n in range(1, depth):
        for c in combinations_with_replacement(range(1, units), n):
            if c[-1] <= (last := units - sum(c)) < units:
                found.append(np.bincount([*c, last], minlength=units))
    return np.array(found or np.zeros((0, units)), dtype=np.int64)


def nnls(a: np.ndarray, b: np.ndarray, most: int = 1000) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by active sets (Lawson and Hanson)."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(most):
        gain = np.where(on, -np.inf, a.T @ (b - a @ x))
        if not len(gain) or gain.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        on[gain.argmax()] = True
        while True:
            s = np.zeros_like(x)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s[on] > 0).all():
                break
            low = on & (s <= 0)
            x += min(1.0, (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()) * (s - x)
            on &= x > 1e-12
            x[~on] = 0
        x = s
    return x


class Plan:
    """Where each head goes by its length and rank; histogram: counts of heads by length in units."""

    def __init__(self, histogram: np.ndarray, fulls: int, tails: int, units: int, depth: int):
        ways = combinations(units, depth)
        x = np.floor(nnls(ways.T.astype(float), histogram.astype(float)) + 1e-6).astype(np.int64)
        while len(over := np.flatnonzero(ways.T @ x > histogram)):  # rounding can leave a few too many
            u = over[0]
            j = np.flatnonzero((ways[:, u] > 0) & (x > 0))[0]
            x[j] -= min(x[j], -(-(int(ways[:, u] @ x) - int(histogram[u])) // int(ways[j, u])))
        ways, x = ways[x > 0], x[x > 0]
        self.first = fulls + np.concatenate([[0], np.cumsum(x)])  # sequence of each combination's first repeat
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for u in range(units):
            js = np.flatnonzero(ways[:, u]) if len(ways) else np.zeros(0, int)
            to = np.cumsum(ways[js, u] * x[js]) if len(js) else np.zeros(0, np.int64)
            before = np.array([int((ways[j, u + 1 :] * np.arange(u + 1, units)).sum()) for j in js], np.int64)
            self.by_length.append((js, to, ways[js, u] if len(js) else to, before))
        planned = np.array([int(to[-1]) if len(to) else 0 for _, to, _, _ in self.by_length])
        left = (histogram - planned) * np.arange(units)
        self.left_from = (np.concatenate([[0], np.cumsum(left)])[:-1]) * UNIT
        self.tails_from = int(left.sum()) * UNIT
        self.stream, self.stream_first = self.tails_from + tails, int(self.first[-1])

    def head(self, length: int, rank: int) -> tuple[int, int] | int:
        """Sequence and offset in units, or the place in the stream of left-overs."""
        js, to, each, before = self.by_length[length]
        k = int(np.searchsorted(to, rank, side="right"))
        if k == len(to):
            return int(self.left_from[length]) + (rank - (int(to[-1]) if len(to) else 0)) * length * UNIT
        at = rank - (int(to[k - 1]) if k else 0)
        return int(self.first[js[k]]) + at // int(each[k]), int(before[k]) + at % int(each[k]) * length

    def in_stream(self, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        """Sequence, offset and length of each part of a run of left-overs."""
        even = self.stream // WINDOW * WINDOW
        while length:
            if at < even:
                seq, off, room = at // WINDOW, at % WINDOW, WINDOW - at % WINDOW
            else:  # the last window, in powers of two from the largest
                seq, off, size = even // WINDOW, at - even, self.stream - even
                while off >= (room := 1 << (size.bit_length() - 1)):
                    seq, off, size = seq + 1, off - room, size - room
                room -= off
            n = min(length, room)
            yield self.stream_first + seq, off, n
            at, length = at + n, length - n


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n and, by task (part): length (units of the head), rank (among its part's heads of that length), fulls and tails before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import chunk_tokenizer

        t, part = chunk_tokenizer(path), TaskContext.get().partitionId()
        ranks, fulls, tails, end = [0] * UNIT, 0, 0, np.array([end_id], np.int64)
        for batch in batches:
            rows, held = [], 0
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = t.encode(text.as_py())
                ids = np.concatenate([ids, end.astype(ids.dtype)])
                f, (length, tail) = len(ids) // WINDOW, divmod(len(ids) % WINDOW, UNIT)
                rows.append((i.as_py(), ids.tobytes(), len(ids), part, length, ranks[length], fulls, tails))
                ranks[length], fulls, tails, held = ranks[length] + 1, fulls + f, tails + tail, held + ids.nbytes
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, n long, part int, length int, rank long, fulls long, tails long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "ids", "n", "part", "length", "rank", "fulls", "tails"])


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, depth: int = 4, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids too if asked for.

    Each document's ids, and ``end_id`` after them, lie in pieces once each; a sequence's pieces have no gaps, and
    every sequence is full or as long as a power of two. A null text is an empty one: its piece is the end id. A
    null id is kept; repeated rows are packed each for itself; an empty table gives no rows; of other columns
    nothing is read. The driver holds a histogram of 64 counts, however large the corpus.
    """
    tokens = scratch(tokenised(docs, tokenizer_path, end_id, id_col, text_col), "tokens")

    n, tail = F.col("n"), F.pmod("n", F.lit(UNIT))
    counts = cut(tokens.groupBy("part", "length").agg(F.count("*").alias("heads"), F.sum(F.floor(n / WINDOW)).alias("f"), F.sum(tail).alias("t")))
    sums = {r["length"]: r for r in counts.groupBy("length").agg(F.sum("heads").alias("heads"), F.sum("f").alias("f"), F.sum("t").alias("t")).collect()}
    histogram = np.array([0, *(sums[u]["heads"] if u in sums else 0 for u in range(1, UNIT))], np.int64)
    plan = Plan(histogram, sum(r["f"] for r in sums.values()), sum(r["t"] for r in sums.values()), WINDOW // UNIT, depth)

    parts = counts.groupBy("part").agg(F.sum("f").alias("f"), F.sum("t").alias("t"))
    every = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(every), F.lit(0)).alias(f"{c}_from") for c in ("f", "t")))
    of_length = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("heads").over(of_length), F.lit(0)).alias("rank_from")).join(parts, "part")
    placed = tokens.join(bases, ["part", "length"]).select("doc_id", "ids", "n", "length", (F.col("rank") + F.col("rank_from")).alias("rank"), (F.col("fulls") + F.col("f_from")).alias("full"), (F.col("tails") + F.col("t_from")).alias("tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                n, length = r["n"], r["length"]
                ids = np.frombuffer(r["ids"], "<u2" if len(r["ids"]) == 2 * n else "<u4").astype("<u4")
                f = n // WINDOW
                cuts = [(i * WINDOW, WINDOW, r["full"] + i, 0) for i in range(f)]
                start = f * WINDOW
                if length:
                    to = plan.head(length, r["rank"])
                    if isinstance(to, tuple):
                        cuts.append((start, length * UNIT, to[0], to[1] * UNIT))
                    else:
                        for seq, off, k in plan.in_stream(to, length * UNIT):
                            cuts.append((start, k, seq, off))
                            start += k
                    start = f * WINDOW + length * UNIT
                for seq, off, k in plan.in_stream(plan.tails_from + r["tail"], n - start):
                    cuts.append((start, k, seq, off))
                    start += k
                out += [(r["doc_id"], a, k, zlib.crc32(b := ids[a : a + k].tobytes()), n, seq, off, *([b] if with_ids else [])) for a, k, seq, off in cuts]
            if out:
                kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

    return placed.mapInArrow(run, PIECE + ", ids binary" * with_ids)


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
