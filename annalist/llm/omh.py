"""Document fingerprints by Order MinHash, which follows edit distance.

Words, lower-cased in A-Z, form k-mers; each k-mer carries the number of its occurrence. For each of ``sketches`` hash
functions the ``ell`` minimal of them are taken, in the order they have in the text, and hashed as a tuple to 16 bits.
The likeness of two fingerprints is the share of their tuples that agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import clamp, cut

K, ELL, SKETCHES = 2, 2, 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _A)


def kmers(text: str, k: int = K) -> np.ndarray:
    """A hash of each k-mer of words with the number of its occurrence, from 0, in text order; fewer words than k are one k-mer."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    if not k:
        return h
    x = h[: len(h) - k + 1]
    for i in range(1, k):
        x = _mix(x * _A + h[i : len(h) - k + 1 + i])
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mix(x + nth * _A)


def signature(text: str, k: int = K, ell: int = ELL, sketches: int = SKETCHES) -> np.ndarray:
    """``sketches`` hashes of 16 bits; of a text without words all are 0. A hash function multiplies by an odd number."""
    x = kmers(text, k)
    out = np.zeros(sketches, np.uint16)
    if not len(x):
        return out
    seeds = _seeds(sketches) | np.uint64(1)
    step = max(1, (1 << 18) // len(x))
    for i in range(0, sketches, step):  # a few hash functions at a time, so that a long text takes little memory
        seed = seeds[i : i + step]
        if len(x) <= ell:
            at = np.broadcast_to(np.arange(len(x)), (len(seed), len(x)))
        else:
            y, at, rows = np.multiply.outer(seed, x), np.empty((len(seed), ell), np.int64), np.arange(len(seed))
            for j in range(ell):
                at[:, j] = y.argmin(axis=1)
                y[rows, at[:, j]] = np.iinfo(np.uint64).max
            at.sort(axis=1)
        v = seed
        for j in range(at.shape[1]):
            v = _mix(v * _A ^ x[at[:, j]])
        out[i : i + step] = v >> np.uint64(48)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_bytes(s: np.ndarray) -> bytes:
    return s.astype(">u2").tobytes()


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RAW = OUT.replace("sha256 string", "sha256 binary").replace("print string", "print binary")
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "end", "own", "first"]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 10_000) -> DataFrame:
    """Each document's fingerprint, and its likeness to an edited self and to the next document.

    The next document is by ascending id (null ids last; equal ids by a hash of their text, then its length); the
    first follows the last. A null text is an empty one, whose fingerprint is zeros; equal texts have equal
    fingerprints. A lone document is its own next. Other columns are not read; an empty table gives no rows.

    Texts are shuffled once, by ranges of ids. A task knows each document's next but for its last one's: that one's
    text and the first one's of each range go on to a small join of neighbouring ranges.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = docs.select(id_col).count()
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.length("text")]
    ranged = d.repartitionByRange(clamp(n // rows_per_part, d.sparkSession.sparkContext.defaultParallelism, 1 << 16), *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first, out = TaskContext.get().partitionId(), None, None, []

        def judged(held: tuple, text: str, sig: np.ndarray) -> tuple:
            e = edited(held[1], text)
            es = signature(e)
            return (held[0], len(held[1]), hashlib.sha256(e.encode()).digest(), as_bytes(held[2]), as_bytes(es), likeness(held[2], es), likeness(held[2], sig), part, 0, None, None)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                sig = held[2] if held and held[1] == text else signature(text)
                if held:
                    out.append(judged(held, text, sig))
                else:
                    first = text
                held = (i, text, sig)
                if len(out) >= 2000:
                    yield _batch(out)
                    out = []
        if held:
            out.append((held[0], None, None, None, None, None, None, part, 1, held[1], first))
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    done = cut(ranged.mapInArrow(run, RAW + ", part int, end int, own string, first string"))
    ends = done.where("end = 1").select("doc_id", "part", "own", "first")
    # an end's next is the first text of the next range that has rows; ranges are numbered without texts
    at = ends.select("part").withColumn("nth", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("part"))).withColumn("n", F.count("*").over(W.partitionBy(F.lit(0))))
    ends = ends.join(at, "part")
    firsts = ends.select((F.when(F.col("nth") == 1, F.col("n")).otherwise(F.col("nth") - 1)).alias("nth"), F.col("first").alias("following"))
    pairs = ends.select("doc_id", "nth", "own").join(firsts, "nth").select("doc_id", "own", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                e = edited(r["own"], r["following"])
                s, es, ns = signature(r["own"]), signature(e), signature(r["following"])
                rows.append((r["doc_id"], len(r["own"]), hashlib.sha256(e.encode()).digest(), as_bytes(s), as_bytes(es), likeness(s, es), likeness(s, ns)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=False)], _NAMES[:7])

    every = done.where("end = 0").select(_NAMES[:7]).unionByName(pairs.mapInArrow(close, RAW))
    text = ("edited_sha256", "fingerprint", "edited_fingerprint")
    return every.withColumns({c: F.lower(F.hex(c)) for c in text})


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
