"""SimHash near-duplicates by covering locality-sensitive hashing.

Structured bit masks guarantee that fingerprints within the radius agree in some table: each bit gets a vector of
radius + 1 bits that are not all 0, and table v keeps the bits whose vector has an odd product with v. Whatever bits
two fingerprints differ in, if they are no more than the radius, some v is orthogonal to the vectors of all of them.

Documents with one fingerprint become one row first. A bucket of few fingerprints is searched for links; one of many
is split by the same construction over the bits that its table did not keep. Fingerprints being distinct, what is left
of it holds at most 2 to the number of bits that neither keeps, about 14 of 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, put_back, set_aside
from .components import components
from .tokens import blocks

_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of the shingles of ``words`` words of a UTF-8 text, A-Z lower-cased; 0 if it has no word.

    A bit is 1 if it is set in over half of the shingles' XXH64 with seed 42; fewer words are one shingle.
    """
    from xxhash import xxh64_intdigest

    counts, n, last = np.zeros(64, np.int64), 0, []
    data = (text or b"").lower()
    for block in blocks(data):
        seq = last + block.split()
        if len(seq) >= words:
            joined = b" ".join(seq)
            ends = np.cumsum(np.fromiter(map(len, seq), np.int64, len(seq)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(seq) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")
            at = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
            counts += (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
            n += len(h)
        last = seq[max(0, len(seq) - words + 1) :]
    if not n:
        return xxh64_intdigest(b" ".join(last), 42) if last else 0
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def masks(radius: int, bits: list[int]) -> list[int]:
    """For each table the bits that it keeps, of those given: 2 ** (radius + 1) - 1 tables."""
    n = 2 ** (radius + 1)
    return [sum(1 << b for i, b in enumerate(bits) if ((i % (n - 1) + 1) & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius, enough of them to join all fingerprints that links join."""
    out, left = [], fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            f = front.pop()
            near = np.bitwise_count(left ^ f) <= radius
            if near.any():
                out += [(int(f), int(x)) for x in left[near]]
                front += list(left[near])
                left = left[~near]
    return out


def fingerprinted(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], ["doc_id", "text_key", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fp long")


def fingerprint_links(fps: DataFrame, radius: int = 3, few: int = 64) -> DataFrame:
    """Links a, b within the radius between the distinct fingerprints fp: as many as join all that links join."""
    first = masks(radius, list(range(64)))
    second = [[m | s for s in masks(radius, [b for b in range(64) if not m >> b & 1])] for m in first]
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(first)))
    tried = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = cut(tried.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    sizes = sizes.select(F.col("t").alias("s_t"), F.col("key").alias("s_key"), "n")
    shared = cut(tried.join(sizes, (F.col("t") == F.col("s_t")) & (F.col("key") == F.col("s_key"))).select("fp", "t", "key", "n"))
    split = F.array(*(F.array(*(F.struct(F.lit(len(first) * (t + 1) + s).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for s, m in enumerate(ms))) for t, ms in enumerate(second)))
    large = shared.where(F.col("n") > few).select("fp", F.explode(F.element_at(split, F.col("t") + 1)).alias("k")).select("fp", "k.t", "k.key")
    buckets = shared.where(F.col("n") <= few).select("fp", "t", "key").union(large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = np.zeros(0, np.uint64), None

        def links(group: np.ndarray) -> list[tuple[int, int]]:
            return spanning(group, radius) if len(group) > 1 else []

        for b in batches:
            if not b.num_rows:
                continue
            t, k, fp = (np.asarray(c) for c in b.columns)
            fp, out = fp.astype(np.int64).view(np.uint64), []
            at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
            if key == (t[0], k[0]):
                held, at = np.concatenate([held, fp[: at[1] if len(at) > 1 else len(fp)]]), at[1:]
            if len(at):
                out += links(held)
                for a, z in zip(at[:-1], at[1:], strict=True):
                    if z - a > 1:
                        out += links(fp[a:z])
                held, key = fp[at[-1] :].copy(), (t[-1], k[-1])
            if out:
                yield _pairs(out)
        if out := links(held):
            yield _pairs(out)

    def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        p = np.array(out, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(p.min(axis=1)), pa.array(p.max(axis=1))], ["a", "b"])

    return buckets.repartition("t", "key").sortWithinPartitions("t", "key").select("t", "key", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, fingerprint (16 hex digits), component_id, the smallest id that links reach, and text_key.

    Texts with fingerprints that differ in at most ``radius`` bits are linked. Null, empty and wordless texts have
    fingerprint zero and are linked like any other. Null ids are kept and never the smallest; repeated rows stay
    repeated; an empty table gives no rows; other columns are not read.
    """
    own = cut(fingerprinted(docs, words, id_col, text_col))
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(classes.select("fp"), radius))
    linked = cut(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r"))
    of_fp = cut(linked.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"))
    return own.join(of_fp, F.col("fp") == F.col("f")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key")


def without_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, that of the smallest id, of each group that links join; a repeated row stays once.

    Documents with null ids stay only where no other of their group has an id; then those of one text are one. Null,
    empty and wordless texts are one group; an empty table stays empty; columns may have any names.
    """
    own, names = set_aside(docs)
    groups = near_duplicates(docs, words, radius, id_col, text_col)
    stay = cut(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stay_"), F.col("text_key").alias("_stay_text_")).distinct())
    d = own.withColumn("_id_", F.col(names[id_col])).withColumn("_text_", F.xxhash64(F.col(names[text_col])))
    same = F.col("_id_").cast("long").eqNullSafe(F.col("_stay_")) & (F.col("_text_") == F.col("_stay_text_"))
    return put_back(d.join(stay, same, "left_semi").dropDuplicates(["_id_", "_text_"]), names)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
