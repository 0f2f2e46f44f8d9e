"""Vector code compression: each part of a vector becomes the index of the nearest entry of its part's codebook.

Distances are screened by one float32 matrix product for each part of a block of vectors. Every product carries an
interval that holds the true distance whatever the order of the sums was, so only entries whose interval overlaps the
best one can be nearest; these are weighed again in int64, and equal distances go to the lower index. Codebooks are
refined over all vectors: tasks send sums and counts by entry, which are added up before and after the shuffle, and
the driver holds nothing but the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .topk import usable

#: Whole numbers beyond this count as this, so that each fits a long.
MOST = 1 << 62
#: Half the distance from 1 to the next float32.
ROUND = 2.0**-24


@dataclass(frozen=True)
class Codebooks:
    """scale: what components are multiplied with; cuts: where parts begin and end; books: entries by part."""

    scale: int
    cuts: tuple[int, ...]
    books: tuple[np.ndarray, ...]

    @property
    def dim(self) -> int:
        return self.cuts[-1]

    def sha256(self) -> str:
        """Of all entries' components by part, entry and place, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for row in b for v in row).encode()).hexdigest()


def cuts(dim: int, parts: int) -> tuple[int, ...]:
    """Where ``parts`` consecutive parts begin and end; the first are longer by one where they cannot be equal."""
    each, more = divmod(dim, parts)
    return tuple(i * each + min(i, more) for i in range(parts + 1))


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, at most MOST in size."""
    with np.errstate(over="ignore"):  # what is infinite then counts as MOST
        return np.clip(np.floor(values.astype(np.float64) * scale), -float(MOST), float(MOST)).astype(np.int64)


def exact_distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers, in int64 where they fit, else in Python's own whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(to).max(initial=0)))
    kind = np.int64 if x.shape[-1] * (2 * most) ** 2 < 1 << 62 else object
    d = x.astype(kind) - to.astype(kind)
    return (d * d).sum(axis=-1) if x.shape[-1] else np.zeros(np.broadcast_shapes(x.shape[:-1], to.shape[:-1]), np.int64)


def screened(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Whether an entry can be the nearest of each row, by a float32 product and a bound of its rounding errors.

    A product of float32 rows of n components that were rounded themselves is off by at most g |x| |c|, where
    g = (n + 2) u / (1 - (n + 2) u), in any order of the sums. The squares and the last sums are float64.
    """
    n = x.shape[1] + 2
    g = n * ROUND / (1 - n * ROUND)
    xf, cf = x.astype(np.float64), book.astype(np.float64)
    product = (xf.astype(np.float32) @ cf.astype(np.float32).T).astype(np.float64)
    square = (cf * cf).sum(axis=1)
    size = np.sqrt((xf * xf).sum(axis=1))[:, None] * np.sqrt(square)
    d = square - 2 * product
    off = (2 * g * size) * (1 + 1e-6) + (n + 8) * 2.0**-51 * (square + 2 * size)
    return d - off <= (d + off).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry, the lowest of equal ones, and its squared distance."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if (x.shape[1] + 2) * ROUND >= 0.5 or x.shape[1] * (2 * most) ** 2 >= 1 << 62:  # beyond float32 and int64
        d = exact_distances(x[:, None, :], book[None, :, :])
        best = np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
        return best, d[np.arange(len(x)), best]
    may = screened(x, book)
    best = may.argmax(axis=1)
    open_ = np.flatnonzero(may.sum(axis=1) > 1)
    if len(open_):
        row, entry = np.nonzero(may[open_])
        d = np.full((len(open_), len(book)), np.iinfo(np.int64).max, np.int64)
        d[row, entry] = exact_distances(x[open_[row]], book[entry])
        best[open_] = d.argmin(axis=1)
    return best, exact_distances(x, book[best])


def read_vectors(column: pa.Array, scale: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are kept (a vector of finite numbers), which of them have ``dim`` components, and those as whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    start, end = column.offsets.to_numpy()[:-1], column.offsets.to_numpy()[1:]
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    kept = column.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[start])
    fits = kept & (end - start == dim)
    at = start[fits][:, None] + np.arange(dim)
    return kept, fits, scaled(values[at], scale)


def train(vectors: DataFrame, vec_col: str, id_col: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks from all vectors; None where there is no usable one.

    The vectors of the smallest ids begin as entries; each round puts every part to its nearest entry, then moves each
    used entry to the floor of its parts' mean. Vectors that are null or hold what is null or no finite number take no
    part, nor do those of another length than the most frequent (of equal counts the longest). Null ids come last,
    equal ids in order of their vectors; with fewer vectors than entries there are fewer entries.
    """
    kept = vectors.where(usable(F.col(vec_col))).select(F.col(id_col).alias("i"), F.col(vec_col).alias("v"))
    length = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return None
    first = kept.where(F.size("v") == length["n"]).orderBy(F.asc_nulls_last("i"), "v").limit(entries).collect()
    cut = cuts(length["n"], parts)
    start = scaled(np.array([r["v"] for r in first], np.float64).reshape(len(first), -1), scale)
    books = Codebooks(scale, cut, tuple(start[:, a:b] for a, b in zip(cut, cut[1:], strict=False)))
    for _ in range(rounds):
        books = refined(vectors, vec_col, books)
    return books


def refined(vectors: DataFrame, vec_col: str, books: Codebooks) -> Codebooks:
    """Each entry moved to the floor of the mean of its parts, over all vectors; those without parts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books.books]
        counts = [np.zeros(len(b), np.int64) for b in books.books]
        for batch in batches:
            _, _, x = read_vectors(batch.column(0), books.scale, books.dim)
            for p, book in enumerate(books.books):
                part = x[:, books.cuts[p] : books.cuts[p + 1]]
                at, _ = nearest(part, book)
                kind = np.int64 if len(part) * int(np.abs(part).max(initial=0)) < 1 << 62 else object
                more = np.zeros(book.shape, kind)
                np.add.at(more, at, part.astype(kind))
                sums[p] += more.astype(object)
                counts[p] += np.bincount(at, minlength=len(book))
        rows = [(p, e, j, Decimal(int(sums[p][e, j])), int(counts[p][e])) for p in range(len(sums)) for e in np.flatnonzero(counts[p]) for j in range(sums[p].shape[1])]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "entry", "place", "total", "n"])

    told = vectors.select(vec_col).mapInArrow(run, "part int, entry int, place int, total decimal(38,0), n long")
    out = [b.copy() for b in books.books]
    for r in told.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # as many rows as the codebooks hold numbers
        out[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(books.scale, books.cuts, tuple(out))


def encode(vectors: DataFrame, vec_col: str, books: Codebooks | None, keep: list[Column | str]) -> DataFrame:
    """The columns to keep, code (two hex digits for each part) and error (summed squared distances) of each usable vector.

    Vectors of another length than the codebooks' have neither code nor error; an error beyond a long is its largest.
    """
    of = vectors.select(F.col(vec_col).alias("_vector_"), F.struct(*keep).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            kept, fits, x = read_vectors(batch.column(0), books.scale if books else 1, books.dim if books else -1)
            code, error = np.full(len(kept), None, object), np.full(len(kept), None, object)
            if books:
                found = [nearest(x[:, a:b], book) for a, b, book in zip(books.cuts, books.cuts[1:], books.books, strict=False)]
                code[fits] = ["".join(r) for r in digits[np.stack([f[0] for f in found], axis=1)]]
                error[fits] = [min(sum(map(int, e)), (1 << 63) - 1) for e in zip(*(f[1] for f in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(kept)), pa.array(code[kept], pa.string()), pa.array(error[kept], pa.int64())], ["kept", "code", "error"])

    kind = of.select("kept").schema["kept"].dataType.simpleString()
    return of.mapInArrow(run, f"kept {kind}, code string, error bigint").select("kept.*", "code", "error")


def decoded(code: str, books: Codebooks) -> np.ndarray:
    """What a code stands for: its entries' middles, in the scale of the vectors."""
    at = [int(code[i : i + 2], 16) for i in range(0, len(code), 2)]
    return (np.concatenate([b[i] for b, i in zip(books.books, at, strict=True)]) + 0.5) / books.scale


def compressed(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """The id (vec_id), code, error, label_error and codebooks_sha256 of each usable vector; see train() and encode().

    label_error: the errors of all rows with that label, nulls together; null where none of them has a code. Repeated
    rows are coded each for itself; an empty table gives no rows; an empty codebook's hash is that of no text. Entries
    are at most 256. A label may hold most rows: errors are summed before they are shuffled, and the table of sums is
    joined to the rows, where Spark splits what is skewed.
    """
    books = train(vectors, vec_col, id_col, parts, entries, rounds, scale)
    rows = scratch(encode(vectors, vec_col, books, [F.col(id_col).alias("vec_id"), F.col(label_col).alias("label")]), "codes")
    sums = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    sums = sums.select("of_label", F.least("s", F.lit(Decimal((1 << 63) - 1))).cast("long").alias("label_error"))
    sha = books.sha256() if books else hashlib.sha256(b"").hexdigest()
    return rows.join(sums, rows["label"].eqNullSafe(sums["of_label"]), "left").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 6) -> str:
    """The same for vectors of one length: a table of assignments (a) and of codebooks (b) for each round."""
    assign = "select v.vec_id, v.part, arg_min(b.entry, (d.d, b.entry)) as entry, min(d.d) as d from p v join b{r} b using (part), lateral (select list_sum(list_transform(list_zip(v.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d) d group by all"
    move = "select b.part, b.entry, coalesce(m.v, b.v) as v from b{r} b left join (select part, entry, list(x order by place) as v from (select a.part, a.entry, j.place, floor(sum(p.v[j.place]) / count(*))::bigint as x from a{r} a join p using (vec_id, part), lateral (select unnest(range(1, len(p.v) + 1)) as place) j group by all) group by all) m using (part, entry)"
    steps = "".join(f",\na{r} as materialized ({assign.format(r=r)})" + (f",\nb{r + 1} as materialized ({move.format(r=r)})" if r < rounds else "") for r in range(rounds + 1))
    return f"""
with k as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, t.part, v[t.part * len(v) // 8 + 1 : (t.part + 1) * len(v) // 8] as v from k, (select unnest(range(8)) as part) t),
b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v from p where vec_id in (select vec_id from k order by vec_id limit 16)){steps},
e as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by vec_id),
h as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds})
select k.vec_id, code, error, (sum(error) over (partition by k.label))::bigint as label_error, codebooks_sha256 from k join e using (vec_id), h
"""


OP13_SQL = _sql()
