"""Mixing sources to target weights: fixed-length blocks of words, drawn per output shard and joined by index.

Each source's documents are laid end to end and cut into blocks of ``block`` words. The mix has as many slots as the
targets ask for, in shards of ``shard_slots``. A shard's counts of each source are a multinomial draw under the
condition that the shards add up to the targets: one pseudorandom permutation of all slots deals them to shards.
A source's slots, numbered through the shards, go through a pseudorandom permutation of its blocks, a new one each
time all are used, and so meet their blocks by index. Given the totals, such counts are what multinomial draws give (multivariate hypergeometric).
Everything is DataFrame functions; hashes are the only chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import WORD, clamp, cut, put_back, set_aside

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """x's place in a pseudorandom permutation of 0 .. n-1: a Feistel network over a grid of about n cells.

    Cells from n on are walked through until one is below n. There are at most sqrt(n) of them: 24 steps are enough
    for certain up to n = 576, and beyond that with a chance of failure below 1e-33 for any x.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def half(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        return F.when(i % 2 == 1, F.struct(F.pmod(left + F.pmod(F.xxhash64(right, i, seed), a), a).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), F.pmod(right + F.pmod(F.xxhash64(left, i, seed), b), b).alias("r")))

    def step(p: Column) -> Column:
        start = F.struct(F.floor(p / b).cast("long").alias("l"), F.pmod(p, b).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, half, lambda s: s["l"] * b + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), step(x), lambda p, _: F.when(p < n, p).otherwise(step(p)))


def row_key(id_col: str, source_col: str, text_col: str) -> Column:
    """A hash of a row's id, source and text; equal rows have equal keys."""
    return F.xxhash64(id_col, F.col(id_col).isNull(), source_col, F.col(source_col).isNull(), text_col)


def sizes_of(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> also ordinal (code-point order, null last) and target.

    Targets are shared by weight, none above ``most`` times its source's size; what is above is shared again by
    weight. The level at which that ends is found in one pass over the sources by size for their weight.
    """
    every = W.partitionBy(F.lit(0))
    s = sources.withColumn("ordinal", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("ordinal") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("full", F.lit(most).cast("double") * F.col("source_size") / F.col("w"))
    before = W.partitionBy(F.lit(0)).orderBy("full", "ordinal").rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("level", left / open_w)
    ends = F.when(F.col("level") <= F.col("full"), F.struct("full", "ordinal", "level"))
    s = s.withColumn("level", F.min(ends).over(every)["level"])
    target = F.least(most * F.col("source_size").cast("double"), F.col("w") * F.col("level"))
    return s.select("source", "source_size", "ordinal", F.coalesce(target, most * F.col("source_size").cast("double")).alias("target"))


class Mix:
    """What a mix is made of: ``placed``, ``sources`` and ``slots``; see mix()."""

    def __init__(self, placed: DataFrame, sources: DataFrame, slots: DataFrame, block: int):
        self.placed, self.sources, self.slots, self.block = placed, sources, slots, block


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = 128, shard_slots: int = 4096, seed: int = 1, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> Mix:
    """Plans the mix of docs.

    placed: id, size, key (as row_key()), ordinal, source_size, target, start (of the document among its
    source's words). slots: shard, ordinal, epoch, index: the blocks of each output shard. sources: as source_targets().

    A null source is a source, the last. Null and empty texts have size 0 and no place in a block. Repeated rows are
    rows of their own. Other columns are not read. Documents of one source are spread over buckets by a hash of the
    id, so no task holds a source.
    """
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), sizes_of(docs, text_col).alias("size"), row_key(id_col, source_col, text_col).alias("key")))
    n = sizes.count()
    buckets = clamp(n // 2048, 16, 1 << 16)
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets)))
    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = cut(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    wanted = F.when(F.col("source_size") > 0, F.least(most * blocks, F.round(F.col("target") * blocks / F.col("source_size")).cast("long"))).otherwise(0)
    w = W.partitionBy(F.lit(0)).orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    sources = cut(sources.withColumn("blocks", blocks).withColumn("wanted", wanted).withColumn("slot_from", F.coalesce(F.sum("wanted").over(w), F.lit(0))))

    bucket_from = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sums.withColumn("bucket_from", bucket_from).alias("a").join(sources.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source"))).select(F.col("a.source").alias("b_source"), F.col("bucket").alias("b_bucket"), "bucket_from", "ordinal", "source_size", "target")
    inner = W.partitionBy("source", "bucket").orderBy(F.col("id").asc_nulls_last(), "key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("in_bucket", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))).select("id", "size", "key", "ordinal", "source_size", "target", (F.col("bucket_from") + F.col("in_bucket")).alias("start"))

    total = sources.agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("n")).first()["n"]
    chunk = 1 << 14
    runs = sources.where("wanted > 0").select("ordinal", "blocks", "wanted", "slot_from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("wanted") - 1) / chunk).cast("long"))).alias("run"))
    parts = clamp(total // (8 * chunk), 1, 1 << 16)
    runs = runs.repartition(parts, "ordinal", "run")
    run_from = F.col("slot_from") + F.col("run") * chunk
    run_to = F.col("slot_from") + F.least((F.col("run") + 1) * chunk, F.col("wanted")) - 1
    drawn = runs.select("ordinal", "blocks", F.explode(F.sequence(run_from, run_to)).alias("slot"))
    shard = F.floor(permuted(F.col("slot"), F.lit(max(total, 1)).cast("long"), F.lit(seed)) / shard_slots).cast("long")
    counts = drawn.groupBy("ordinal", "blocks", shard.alias("shard")).agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("ordinal").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("first", first).repartition(parts, "ordinal", "shard")
    slots = counts.select("shard", "ordinal", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    epoch = F.floor(F.col("draw") / F.col("blocks")).cast("long")
    index = permuted(F.pmod("draw", "blocks"), F.col("blocks"), F.xxhash64("ordinal", epoch, F.lit(seed)))
    return Mix(placed, sources, slots.select("shard", "ordinal", epoch.alias("epoch"), index.alias("index")), block)


def pieces(m: Mix) -> DataFrame:
    """A row for each block that a document has words in: the placed row, index, and piece_from and piece_len there."""
    b = F.lit(m.block)
    p = m.placed.where("size > 0")
    end = F.col("start") + F.col("size")
    p = p.select("*", F.explode(F.sequence(F.floor(F.col("start") / b).cast("long"), F.floor((end - 1) / b).cast("long"))).alias("index"))
    a = F.greatest("start", F.col("index") * b)
    return p.select("*", (a - F.col("start")).alias("piece_from"), (F.least(end, (F.col("index") + 1) * b) - a).alias("piece_len"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    For nulls, empty texts, repeated rows and other columns see mix(); an empty table gives no rows.
    """
    m = mix(docs, **how)
    times = m.slots.groupBy("ordinal", "index").agg(F.count("*").alias("times"))
    # a piece's shard says nothing of its document: the key of this join is a block, which holds few documents
    # the plan can't tell how many rows a sequence explodes to: without the hint it would broadcast them
    took = pieces(m).join(times.hint("merge"), ["ordinal", "index"], "left").groupBy("ordinal", "start", "id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("piece_len") * F.col("times")), F.lit(0)).alias("taken"))
    out = ["id", "size", "source_size", "target", "taken"]
    return took.select(out).unionByName(m.placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(out)).withColumnRenamed("id", "doc_id")


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The documents as the mix takes them, with the columns of docs; n_chars, if there, is of the new text.

    A document comes out once for each epoch that takes any of it: whole where all of its blocks are taken, else as
    the words of those that are, with the white space between them. Documents without a word are not part of a mix.
    Texts are shuffled once, by a key of the row; equal rows are taken as often as all of them together. Null sources are
    one, the last; an empty table stays empty; columns may have any names.
    """
    m = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **how)
    of = F.struct("piece_from", "piece_len")
    took = pieces(m).join(m.slots.select("ordinal", "index", "epoch").hint("merge"), ["ordinal", "index"]).groupBy("key", "ordinal", "start", "size", "epoch").agg(F.sort_array(F.collect_list(of)).alias("_runs_"), F.sum("piece_len").alias("words"))
    took = took.select(F.col("key").alias("_took_"), F.when(F.col("words") < F.col("size"), F.col("_runs_")).alias("_runs_"))
    own, names = set_aside(docs)
    text = F.col(names[text_col])
    one = own.withColumn("_key_", row_key(names[id_col], names[source_col], names[text_col])).dropDuplicates(["_key_"])
    words = F.regexp_extract_all(text, F.lit(f"({WORD})[\\x20\\x09-\\x0D]*"), 0)
    some = F.rtrim(F.array_join(F.flatten(F.transform("_runs_", lambda r: F.slice(words, (r["piece_from"] + 1).cast("int"), r["piece_len"].cast("int")))), ""))
    out = one.join(took.hint("merge"), F.col("_key_") == F.col("_took_")).withColumn(names[text_col], F.when(F.col("_runs_").isNull(), text).otherwise(some))
    if n_chars := names.get("n_chars"):
        out = out.withColumn(n_chars, F.length(text).cast("long"))
    return put_back(out, names)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
