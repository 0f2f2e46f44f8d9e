"""URL filters: a blocked Bloom filter passes possible hits on a list of canonical URL prefixes to an exact hash join.

Everything here is DataFrame expressions. A list entry is a host and a path that starts and ends with ``/``; it fits
its host and all subdomains, where the URL's path starts with the entry's. So a URL is looked up under each suffix of
its host at a dot, joined to each prefix of its path at a slash, as far as any entry has as many labels or slashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: The policy: host and path, verdict. The longest that fits wins.
POLICY = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Sites on the block list; they decide where no rule of the policy fits.
LISTED = ["ads-track.example.org/", "casino-win.example.org/", "cheap-pills.example.com/", "free-bets.example.com/", "spam-farm.example.org/"]


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def url_list(spark: SparkSession, policy=POLICY, listed=LISTED) -> DataFrame:
    """The list as rows of key (host and path), verdict, policy (whether the key is shown as the rule)."""
    rows = [(k, v, True) for k, v in policy] + [(k, "block", False) for k in listed]
    return spark.createDataFrame(rows, "key string, verdict string, policy boolean")


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _masks(key: Column) -> Column:
    """Four words of 64 bits with two bits set in each: what an entry sets in its block of 256 bits."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return F.array(*(bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)))


def bloom(entries: DataFrame, n_blocks: int) -> DataFrame:
    """A row of four words for each block that has a bit: at most n_blocks rows, however long the list."""
    m = entries.select(_block(F.col("key"), n_blocks).alias("block"), _masks(F.col("key")).alias("m"))
    return m.groupBy("block").agg(F.array(*(F.bit_or(F.col("m")[i]) for i in range(4))).alias("words"))


def filter_urls(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", n_blocks: int | None = None, most_blocks: int = 1 << 18, small_list: int = 10_000, salts: int = 32) -> DataFrame:
    """id_col, host, path, rule, verdict for each row of pages.

    entries: as of url_list(). The filter has a block of 256 bits for each 16 entries, unless ``n_blocks`` are asked for, so
    that it passes few URLs that are not listed, however long the list. It is broadcast up to ``most_blocks`` rows of 40
    bytes; beyond that it is joined by block. A list of up to ``small_list`` rows is broadcast to the exact join too; a longer one is hash-joined with each key under ``salts``
    salts, so that a key that many URLs share is spread over as many tasks.

    Null URLs and URLs without ``://`` have an empty host and path, no rule, and the verdict allow. Repeated rows stay
    repeated, empty tables give no rows, and other columns, whatever their names, are not read. Of two entries of one
    length that fit, the one with the longer host wins.
    """
    e = entries.select("key", "verdict", "policy")
    shape = e.agg(F.count("*").alias("n"), F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("labels"), F.max(F.length("key") - F.length(F.replace(F.col("key"), F.lit("/"), F.lit("")))).alias("slashes")).first()
    labels, slashes = shape["labels"] or 0, shape["slashes"] or 0
    n_blocks = n_blocks or 1 << max(10, (shape["n"] // 16).bit_length())

    u = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    u = u.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = F.split("host", r"\.")
    deep = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    none = F.array().cast("array<string>")
    hosts = F.when(F.lit(labels) > 0, F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))).otherwise(none)
    paths = F.when((deep > 0) & F.lit(slashes > 0), F.transform(F.sequence(F.lit(1), F.least(deep, F.lit(max(slashes, 1)))), lambda j: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), j), F.lit("/")))).otherwise(none)
    tried = u.select("id", "host", "path", F.posexplode_outer(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))).alias("pos", "key"))
    tried = tried.withColumns({"block": _block(F.col("key"), n_blocks), "m": _masks(F.col("key")), "first": F.coalesce(F.col("pos") == 0, F.lit(True))})

    hit = F.coalesce(F.expr("words is not null and forall(sequence(0, 3), i -> words[i] & m[i] = m[i])"), F.lit(False))
    words = bloom(e, n_blocks)
    passed = tried.join(F.broadcast(words) if n_blocks <= most_blocks else words.hint("merge"), "block", "left").withColumn("key", F.when(hit, F.col("key"))).where(F.col("key").isNotNull() | F.col("first")).select("id", "host", "path", "key", "first")

    if shape["n"] <= small_list:
        found = passed.join(F.broadcast(e), "key", "left")
    else:
        spread = e.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = passed.withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), F.lit(salts)).cast("int")).join(spread.hint("shuffle_hash"), ["key", "salt"], "left")
    rank = F.struct(F.col("policy"), F.length("key").alias("long"), F.length(F.substring_index("key", "/", 1)).alias("host_long"), F.col("key"), F.col("verdict"))
    best = found.groupBy("id", "host", "path").agg(F.max(F.when(F.col("verdict").isNotNull(), rank)).alias("best"), F.sum(F.col("first").cast("long")).alias("copies"))
    best = best.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.when(F.col("best.policy"), F.col("best.key")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_list(spark))


OP7_SQL = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
fits as (select *, (host = 'net' or host like '%.net') and path like '/%' as net, (host = 'example.net' or host like '%.example.net') and path like '/en/%' as net_en,
  (host = 'example.com' or host like '%.example.com') and path like '/de/%' as com_de, (host = 'org' or host like '%.org') and path like '/fr/%' as org_fr,
  path like '/%' and (host in ('ads-track.example.org', 'casino-win.example.org', 'cheap-pills.example.com', 'free-bets.example.com', 'spam-farm.example.org')
    or host like '%.ads-track.example.org' or host like '%.casino-win.example.org' or host like '%.cheap-pills.example.com' or host like '%.free-bets.example.com' or host like '%.spam-farm.example.org') as listed
  from (select page_id, coalesce(host, '') as host, coalesce(path, '') as path from p))
select page_id, host, path,
  case when net_en then 'example.net/en/' when com_de then 'example.com/de/' when org_fr then 'org/fr/' when net then 'net/' end as rule,
  case when net_en or org_fr then 'allow' when com_de or net or listed then 'block' else 'allow' end as verdict from fits
"""
