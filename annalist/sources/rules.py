"""Rule files of a game and a mod laid over it, as small tables: leaves of nested blocks, layered by file.

A rule folder holds some megabytes; every table here is of thousands of rows at most, so single-task windows are meant.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import clamped
from ..operators.lineage import cut
from .saves import LEAVES, TOKEN, leaves

#: Fixed: the keys of a culture group that are no cultures.
NOT_CULTURES = ["color", "unit", "union", "leader", "is_overseas"]
#: Fixed: the constants of mobilisation and of what supports a brigade.
DEFINES = [
    "POP_SIZE_PER_REGIMENT", "POP_MIN_SIZE_FOR_REGIMENT", "MIN_MOBILIZE_LIMIT", "POP_MIN_SIZE_FOR_REGIMENT_COLONY_MULTIPLIER",
    "POP_MIN_SIZE_FOR_REGIMENT_NONCORE_MULTIPLIER", "POP_MIN_SIZE_FOR_REGIMENT_PROTECTORATE_MULTIPLIER",
]
_UPPER = "".join(chr(b) for b in range(128, 160))
_WINDOWS = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(128, 160))


def text_of(content: Column) -> Column:
    """Bytes in Windows' Latin encoding as text, without a byte order mark."""
    latin = F.translate(F.decode(content, "ISO-8859-1"), _UPPER, _WINDOWS)
    return F.regexp_replace(latin, "^ï»¿", "")


def folder_key(folder: Column) -> Column:
    """A folder as ``a/b`` in lower case, for comparing."""
    return F.regexp_replace(F.lower(F.replace(folder, F.lit("\\"), F.lit("/"))), "^/+|/+$", "")


def read_layer(spark: SparkSession, root: str, layer: int) -> DataFrame:
    """layer, folder, name, path, content of the rule files below a root, as text, comments and all."""
    root = root.rstrip("/") + "/"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,csv,lua,mod}").load(root)
    at = F.substring_index("path", root, -1)
    return f.select(F.lit(layer).alias("layer"), F.regexp_extract(at, "^(.*)/[^/]*$", 1).alias("folder"), F.substring_index(at, "/", -1).alias("name"), "path", text_of(F.col("content")).alias("text"))


def descriptor(files: DataFrame) -> DataFrame:
    """path, nth, key, value of the ``key = value`` lines of descriptors; quotes and comments are minded."""
    line = r'^\s*([A-Za-z_]\w*)\s*=\s*(?:"([^"]*)"|([^\s#"{}]+))'
    d = files.select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("nth", "line"))
    key, quoted, bare = (F.regexp_extract("line", line, i) for i in (1, 2, 3))
    return d.select("path", "nth", key.alias("key"), F.when(quoted != "", quoted).otherwise(bare).alias("value")).where("key <> ''")


def layers(game: DataFrame, mod: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """The files of both, without the game's in folders that the mod's descriptor replaces (those very folders alone)."""
    if described is not None:
        gone = described.where("key = 'replace_path' and value <> ''").select(folder_key(F.col("value")).alias("gone")).distinct()
        game = game.join(gone, folder_key(F.col("folder")) == F.col("gone"), "left_anti")
    return game.unionByName(mod)


def resolved(files: DataFrame, of_all_layers: tuple[str, ...] = ("cultures.txt",)) -> DataFrame:
    """Of files with one place and name, whatever their case, that of the highest layer; those named are read of all."""
    nth = F.row_number().over(W.partitionBy(folder_key(F.col("folder")), F.lower("name")).orderBy(F.desc("layer")))
    return files.withColumn("_nth_", nth).where((F.col("_nth_") == 1) | F.lower("name").isin(*of_all_layers)).drop("_nth_")


def localisation(files: DataFrame) -> DataFrame:
    """key, text, hash (a line that begins with #): the first text of each key, the mod's files first, then by name and line."""
    f = files.where((folder_key(F.col("folder")) == "localisation") & F.lower("name").endswith(".csv"))
    d = f.select("layer", "name", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("nth", "line"))
    cells = F.split("line", ";")
    d = d.withColumns({"key": F.trim(F.element_at(cells, 1)), "text": F.trim(F.coalesce(F.get(cells, F.lit(1)), F.lit("")))}).where("text <> ''")
    w = W.partitionBy("key").orderBy(F.desc("layer"), "name", "nth")
    return d.withColumn("_nth_", F.row_number().over(w)).where("_nth_ = 1").select("key", "text", F.startswith("line", F.lit("#")).alias("hash"))


def rule_leaves(files: DataFrame) -> DataFrame:
    """The leaves of resolved files, as LEAVES with the file's layer, folder and name; save_id is its path."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in LEAVES.split(", ")]
        for b in batches:
            for path, text in zip(b["path"], b["text"], strict=True):
                yield pd.DataFrame([(path, *r) for r in leaves(text, every=True)], columns=names)

    of = files.select(F.col("path").alias("save_id"), "layer", folder_key(F.col("folder")).alias("folder"), F.lower("name").alias("name"))
    return files.select("path", "text").mapInPandas(run, LEAVES).join(of, "save_id")


TREE = "save_id string, top string, node long, parent long, depth int, path array<string>, key string, value string, is_block boolean"


def tree(text: str) -> Iterator[tuple]:
    """(top, node, parent, depth, path, key, value, is_block) of every block and leaf of a file, in order.

    node: numbers from 1; parent: the block around it, 0 at the top; depth: how many blocks there are around it; path:
    the keys of those inside the one at the top.
    """
    tokens = [(m[3], 0) if m[3] is not None else (m[1], 0) if m[1] is not None else (m[2], 1) for m in TOKEN.finditer(text) if m[0][0] != "#"]
    stack: list[tuple[int, str | None]] = []
    n = i = 0
    while i < len(tokens):
        (t, mark), key = tokens[i], None
        if not mark and tokens[i + 1 : i + 2] == [("=", 1)]:
            key, i = t, i + 2
            if i >= len(tokens):
                break
            t, mark = tokens[i]
        i += 1
        if mark and t == "}":
            if stack:
                stack.pop()
        elif not mark or t == "{":
            n += 1
            around = [k or "" for _, k in stack]
            yield around[0] if stack else key, n, stack[-1][0] if stack else 0, len(stack), around[1:], key, None if mark else t, bool(mark)
            if mark:
                stack.append((n, key))


def rule_tree(files: DataFrame) -> DataFrame:
    """The blocks and leaves of resolved files, as TREE with the file's layer, folder and name; save_id is its path."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in TREE.split(", ")]
        for b in batches:
            for path, text in zip(b["path"], b["text"], strict=True):
                yield pd.DataFrame([(path, *r) for r in tree(text)], columns=names)

    of = files.select(F.col("path").alias("save_id"), "layer", folder_key(F.col("folder")).alias("folder"), F.lower("name").alias("name"))
    return files.select("path", "text").mapInPandas(run, TREE).join(of, "save_id")


def _in(rows: DataFrame, folder: str, *names: str) -> DataFrame:
    return rows.where((F.col("folder") == folder) & F.col("name").isin(*names))


def _number(value: str = "value") -> Column:
    return F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))


def defines(files: DataFrame) -> DataFrame:
    """key, value of the constants in DEFINES that are told; Lua comments are left out."""
    text = F.regexp_replace("text", r"--[^\r\n]*", "")
    d = files.where((folder_key(F.col("folder")) == "common") & (F.lower("name") == "defines.lua")).select(text.alias("text"), F.explode(F.array(*map(F.lit, DEFINES))).alias("key"))
    found = F.expr(r"regexp_extract(text, concat('(?<![\\w.])', key, '\\s*=\\s*([-\\d.]+)'), 1)")
    return d.select("key", found.try_cast("double").alias("value")).where("value is not null")


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Tables of rules by name, from the leaves of resolved files:

    strata (pop_type, stratum), continents (pid, continent; the last wins), regions (pid, region), prices (good, cost),
    cultures (culture, culture_group), modifier_impacts and static_sizes (modifier, value), policy_impacts (policy,
    value), reform_sizes (reform, option, value), parties (party, from 1 in load order; war_policy or empty).
    """
    top_block, inside = F.col("top"), lambda n: F.try_element_at("path", F.lit(n))
    depth = F.size("path")
    last = lambda d, keys, value: d.groupBy(*keys).agg(F.max_by(value, F.struct("layer", "name", "ord")).alias(value))

    strata = rows.where((F.col("folder") == "poptypes") & (F.col("key") == "strata")).groupBy(F.regexp_replace("name", r"\.txt$", "").alias("pop_type")).agg(F.lower(F.min_by("value", "ord")).alias("stratum"))
    land = _in(rows, "map", "continent.txt").where((inside(1) == "provinces") & F.col("key").isNull())
    continents = last(land.select("layer", "name", "ord", F.col("value").try_cast("long").alias("pid"), top_block.alias("continent")).where("pid is not null"), ["pid"], "continent")
    place = _in(rows, "map", "region.txt").where((depth == 0) & F.col("key").isNull() & F.col("top").isNotNull())
    regions = last(place.select("layer", "name", "ord", F.col("value").try_cast("long").alias("pid"), top_block.alias("region")).where("pid is not null"), ["pid"], "region")
    goods = _in(rows, "common", "goods.txt").where((depth == 1) & (F.col("key") == "cost"))
    prices = last(goods.select("layer", "name", "ord", inside(1).alias("good"), _number().alias("cost")), ["good"], "cost")
    peoples = _in(rows, "common", "cultures.txt").where((depth >= 1) & ~inside(1).isin(NOT_CULTURES))
    cultures = last(peoples.select("layer", "name", "ord", inside(1).alias("culture"), top_block.alias("culture_group")), ["culture"], "culture_group")

    impact = (F.col("key") == "mobilization_impact") & (depth == 0)
    modifiers = _in(rows, "common", "event_modifiers.txt", "triggered_modifiers.txt").where(impact & F.col("top").isNotNull())
    modifier_impacts = last(modifiers.select("layer", "name", "ord", top_block.alias("modifier"), _number().alias("value")), ["modifier"], "value")
    # sizes told several times, or in effects, add up
    sized = lambda d: (F.col("key") == "mobilisation_size") & (depth >= d) & F.forall(F.slice("path", d + 1, F.greatest(depth, F.lit(1))), lambda x: x == "effect")
    static = _in(rows, "common", "static_modifiers.txt").where(sized(0) & F.col("top").isNotNull())
    static_sizes = static.groupBy(top_block.alias("modifier")).agg(F.sum(_number()).alias("value")).where("value <> 0")
    issues = _in(rows, "common", "issues.txt")
    policy = issues.where((top_block == "party_issues") & (inside(1) == "war_policy") & (F.col("key") == "mobilization_impact") & (depth >= 2))
    policy_impacts = policy.groupBy(inside(2).alias("policy")).agg(F.min_by(_number(), "ord").alias("value"))
    reform = issues.where((top_block != "party_issues") & sized(2))
    reform_sizes = reform.groupBy(inside(1).alias("reform"), inside(2).alias("option")).agg(F.sum(_number()).alias("value")).where("value <> 0")

    listed = _in(rows, "common", "countries.txt").where("top is null and key rlike '^[A-Z][A-Z0-9]{2}$'").groupBy("key").agg(F.min("ord").alias("place"), F.min_by("value", "ord").alias("file"))
    listed = listed.select("place", F.concat(F.lit("common/"), folder_key(F.col("file"))).alias("file"))
    party = rows.where("top = 'party'").groupBy(F.concat_ws("/", "folder", "name").alias("file"), "top_ord").agg(F.coalesce(F.min_by("value", F.when(F.col("key") == "war_policy", F.col("ord"))), F.lit("")).alias("war_policy"))
    parties = party.join(listed, "file").select(F.row_number().over(W.orderBy("place", "top_ord")).alias("party"), "war_policy")
    return {
        "strata": strata, "continents": continents, "regions": regions, "prices": prices, "cultures": cultures, "modifier_impacts": modifier_impacts, "static_sizes": static_sizes,
        "policy_impacts": policy_impacts, "reform_sizes": reform_sizes, "parties": parties,
    }


def ruling_impact(countries: DataFrame, rules: dict[str, DataFrame]) -> DataFrame:
    """countries with war_policy and mobilisation_impact of their ruling party, a number from 1; null and 0 where unknown."""
    c = countries.join(rules["parties"].withColumnRenamed("party", "ruling_party"), "ruling_party", "left")
    c = c.join(rules["policy_impacts"].select(F.col("policy").alias("war_policy"), F.col("value").alias("mobilisation_impact")), "war_policy", "left")
    return c.na.fill(0.0, ["mobilisation_impact"])


def attainable(rules: dict[str, DataFrame], holdings: DataFrame) -> DataFrame:
    """campaign, invention: what anybody in a campaign can come to have.

    rules: inventions (invention, base: its chance, null if none), techs (invention, tech), tags (invention, tag; none:
    anyone), requires (invention, other), blockers (invention, other, factor). holdings: campaign, tag, tech. At first
    those count for which some nation has all technologies; then those go that require one that is gone or unknown, and
    those whose chance the factors of blockers that are gone bring to zero or less, until none goes. Each round follows
    only what went in the one before; tables stay on the cluster, and a round ends in a checkpoint.
    """
    held = holdings.select("campaign", "tag", "tech").distinct()
    known = rules["inventions"].select("invention", "base").distinct()
    needs = rules["techs"].select("invention", "tech").distinct()
    n = needs.groupBy("invention").agg(F.count("*").alias("n"))
    told = rules["tags"].select("invention", "tag").distinct()
    anyone = known.select("invention").join(told, "invention", "left_anti").withColumn("anyone", F.lit(True))
    nations = held.select("campaign", "tag").distinct()
    full = needs.join(held, "tech").groupBy("campaign", "invention", "tag").agg(F.count("*").alias("has")).join(n, "invention").where("has = n")
    full = full.join(anyone, "invention", "left").join(told.withColumn("may", F.lit(True)), ["invention", "tag"], "left").where("anyone or may").select("campaign", "invention")
    free = known.select("invention").join(n, "invention", "left_anti")  # no technology needed
    free_to_all = free.join(anyone, "invention").select("invention").crossJoin(F.broadcast(nations.select("campaign").distinct())).select("campaign", "invention")
    free_to_some = free.join(told, "invention").join(nations, "tag").select("campaign", "invention")
    able = full.unionByName(free_to_all).unionByName(free_to_some).distinct()
    every = cut(nations.select("campaign").distinct().crossJoin(known.select("invention").distinct()))
    able = cut(every.join(able, ["campaign", "invention"], "left_semi"))

    requires = rules["requires"].select(F.col("invention").alias("of"), F.col("other").alias("invention")).distinct()
    lost = requires.join(known, "invention", "left_anti").select(F.col("of").alias("invention")).distinct()  # what they require is unknown
    blockers = rules["blockers"].select(F.col("invention").alias("of"), F.col("other").alias("invention"), "factor")
    chances = known.where("base is not null").select(F.col("invention").alias("of"), "base")
    gone = cut(every.join(able, ["campaign", "invention"], "left_anti").unionByName(every.join(lost, "invention", "left_semi").select("campaign", "invention")).distinct())
    new, weighed = gone, None
    while not new.isEmpty():
        unmet = new.join(requires, "invention").select("campaign", F.col("of").alias("invention"))
        more = new.join(blockers, "invention").join(chances, "of").groupBy("campaign", "of", "base").agg(F.sum("factor").alias("more"))
        weighed = cut(more if weighed is None else weighed.unionByName(more).groupBy("campaign", "of", "base").agg(F.sum("more").alias("more")))
        hopeless = weighed.where("base + more <= 0").select("campaign", F.col("of").alias("invention"))
        new = cut(unmet.unionByName(hopeless).distinct().join(gone, ["campaign", "invention"], "left_anti"))
        gone = cut(gone.unionByName(new))
    return able.join(gone, ["campaign", "invention"], "left_anti")


def named_inventions(held: DataFrame, sequence: DataFrame, base: int) -> DataFrame:
    """tag, invention of held (tag, ids): numbers from ``base`` on in the sequence (seq from 0, invention); others go."""
    ids = held.select("tag", F.explode("ids").alias("id")).withColumn("seq", F.col("id") - base)
    return ids.join(sequence, "seq").select("tag", "invention")


def naval_profiles(base: DataFrame, deltas: DataFrame, holdings: DataFrame) -> DataFrame:
    """holder, ship_type, stat, value: each hull's stats with what the holder's technologies and inventions add.

    base: ship_type, stat, value; deltas: what, ship_type (``navy_base`` for every hull), stat, value. No stat but the
    score falls below zero; evasion is 0.95 at most.
    """
    own = holdings.join(deltas, holdings["has"] == deltas["what"]).groupBy("holder", "ship_type", "stat").agg(F.sum("value").alias("more"))
    each = holdings.select("holder").distinct().crossJoin(F.broadcast(base))
    on = ["holder", "ship_type", "stat"]
    every = own.where("ship_type = 'navy_base'").select("holder", "stat", F.col("more").alias("all"))
    d = each.join(own.where("ship_type <> 'navy_base'"), on, "left").join(every, ["holder", "stat"], "left")
    total = F.col("value") + F.coalesce("more", F.lit(0.0)) + F.coalesce("all", F.lit(0.0))
    return d.select(*on, F.when(F.col("stat") == "evasion", clamped(total, 0.0, 0.95)).when(F.col("stat") == "score", total).otherwise(F.greatest(total, F.lit(0.0))).alias("value"))
