"""Text and numbers of snapshots: stamps, keys, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from .base import query, table

STAMP = "s as (select o_orderkey as id, year(o_orderdate) || '.' || month(o_orderdate) || '.' || day(o_orderdate) as stamp, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d from orders)"


def _stamps(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat_ws(".", F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("stamp"))


@query(f"""
with {STAMP} select id, stamp, round(y + (m - 1) / 12.0::double + (d - 1) / 365.0::double, 6) as fraction, y::varchar as year from s
""")
def q_year_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """A stamp as a fraction of years."""
    s = F.col("stamp")
    return _stamps(spark, sf).select("id", "stamp", F.round(X.year_fraction(s), 6).alias("fraction"), X.year_of(s).alias("year"))


@query(f"""
with {STAMP} select id, ((y * 12 + m - 1 - id % 36) // 12)::varchar || '.' || ((y * 12 + m - 1 - id % 36) % 12 + 1)::varchar || '.1' as month from s
""")
def q_month_shift(spark: SparkSession, sf: str) -> DataFrame:
    """The month some months before a stamp's."""
    return _stamps(spark, sf).select("id", X.month_shift(F.col("stamp"), F.col("id") % 36).alias("month"))


@query(f"""
with {STAMP}, g as (select id, y * 365 + [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][m] + d - 1 as days from s)
select id, days::bigint as days, (days // 365)::bigint as years, (days - 1995 * 365)::bigint as since from g
""")
def q_game_duration(spark: SparkSession, sf: str) -> DataFrame:
    """Days between stamps in a calendar without leap days."""
    d = X.game_days(F.col("stamp")).cast("long")
    return _stamps(spark, sf).select("id", d.alias("days"), F.floor(d / 365).alias("years"), (d - 1995 * 365).alias("since"))


@query("""
select l_orderkey, l_linenumber, l_partkey, case when l_quantity::bigint - 25 < 0 then l_quantity::bigint - 25 + 4294967 else l_quantity::bigint - 25 end as losses, least(greatest(l_discount, 0.02), 0.05) as clamped,
  round((l_quantity + case when l_returnflag = 'A' then l_tax else 0.0 end) * 2 / (1 - least(l_discount, 0.95)), 4) as power from lineitem
""")
def q_overflow_clamp_power(spark: SparkSession, sf: str) -> DataFrame:
    """Losses past 32 bits, clamping, and a hull's power."""
    line = table(spark, sf, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", X.losses(F.col("l_quantity").cast("long") - 25).alias("losses"), X.clamped(F.col("l_discount"), 0.02, 0.05).alias("clamped"),
        F.round(X.hull_power(F.col("l_quantity"), F.lit(2.0), F.least("l_discount", F.lit(0.95)), F.col("l_tax"), F.col("l_returnflag") == "A"), 4).alias("power"),
    )


@query("""
select event_id, regexp_extract(props, '"(\\w+)": *(-?\\d+)', 1) as key, try_cast(regexp_extract(props, '"(\\w+)": *(-?\\d+)', 2) as bigint)::double as value, try_cast(event_type as double) is not null as numeric from events
""")
def q_kv_parse(spark: SparkSession, sf: str) -> DataFrame:
    """A key and a value from text, and whether text is a number."""
    pair = r'"(\w+)": *(-?\d+)'
    return table(spark, sf, "events").select("event_id", F.regexp_extract("props", pair, 1).alias("key"), F.regexp_extract("props", pair, 2).try_cast("long").cast("double").alias("value"), F.col("event_type").try_cast("double").isNotNull().alias("numeric"))


@query(r"""
with b as (select page_id, unnest(regexp_extract_all(html, '<(\w+)(?:>|\s[^>]*>)', 1)) as tag from pages)
select page_id, lower(tag) as kind, count(*) as blocks from b group by all
""")
def q_block_split(spark: SparkSession, sf: str) -> DataFrame:
    """What blocks a page opens, and how many of each."""
    b = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<(\w+)(?:>|\s[^>]*>)"), 1)).alias("tag"))
    return b.groupBy("page_id", F.lower("tag").alias("kind")).agg(F.count("*").alias("blocks"))


@query("""
with w as (select doc_id, unnest(regexp_extract_all(text, '[a-z]+=[^ \\n]+')) as pair from documents union all select doc_id, 'size=' || n_chars from documents union all select doc_id, lang || '=' || source from documents)
select split_part(pair, '=', 1) as culture, count(*) as pops from w where split_part(pair, '=', 1) not in ('size', 'id', 'literacy') and try_cast(split_part(pair, '=', 2) as double) is null group by 1
""")
def q_elimination_key(spark: SparkSession, sf: str) -> DataFrame:
    """The key that is no known field and whose value is no number: a population's culture."""
    d = table(spark, sf, "documents")
    found = d.select(F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+=[^ \n]+"), 0)).alias("pair"))
    pairs = found.union(d.select(F.concat(F.lit("size="), F.col("n_chars")))).union(d.select(F.concat("lang", F.lit("="), "source")))
    key, value = F.split_part("pair", F.lit("="), F.lit(1)), F.split_part("pair", F.lit("="), F.lit(2))
    return pairs.where(~key.isin("size", "id", "literacy") & value.try_cast("double").isNull()).groupBy(key.alias("culture")).agg(F.count("*").alias("pops"))


@query("""
select doc_id, contains(lower(text), 'license') as licensed, contains(lower(source), '1') as listed from documents where contains(lower(text), 'th')
""")
def q_text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Text that contains what is looked for, in any case."""
    d = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("th")))
    return d.select("doc_id", F.contains(F.lower("text"), F.lit("license")).alias("licensed"), F.contains(F.lower("source"), F.lit("1")).alias("listed"))


@query("""
select c_custkey as id, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as title, regexp_full_match(substr(c_mktsegment, 1, 3), '[A-Z][A-Z0-9]{2}') as is_tag,
  case when c_custkey < 1000 then c_custkey::varchar else printf('%.1fk', c_custkey / 1000.0) end as compact from customer
""")
def q_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Titles, tags and short counts."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), X.titled(F.lower("c_mktsegment")).alias("title"), X.is_tag(F.substring("c_mktsegment", 1, 3)).alias("is_tag"), X.compact_count(F.col("c_custkey")).alias("compact"))


@query("""
select o_orderkey as id, stamp from (select o_orderkey, md5(o_orderpriority) as stamp from orders)
""")
def q_stamp_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A stamp of what a result was made from."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderpriority").cast("binary")).alias("stamp"))
