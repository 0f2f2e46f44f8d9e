import pytest
from pyspark.sql import functions as F

from annalist.plans import campaign as C
from annalist.sources import blocks as B
from annalist.sources import saves as S

from .savebuilder import islands


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("campaigns") / "north"
    d.mkdir()
    (d / "a.v2").write_bytes(islands())
    (d / "b.v2").write_bytes(islands("1837.1.1", "TOL").replace(b"size=15000", b"size=18000"))
    (d / "older_name.v2").write_bytes(islands())
    (d / "zip.v2").write_bytes(b"PK\x03\x04 date=")
    (d / "cut.v2").write_bytes(islands()[:900])
    (d / "headless.v2").write_bytes(b"1=\n{\n}\n")
    return str(d)


@pytest.fixture(scope="module")
def files(spark, folder):
    return S.read_files(spark, folder)


@pytest.fixture(scope="module", params=["tokens", "blocks"])
def t(spark, files, folder, request):
    if request.param == "blocks":
        return B.campaigns(spark, folder)
    kept = S.one_per_date(files).persist()
    return S.tables(kept, S.read_leaves(kept).persist())


def test_broken_files_are_told_apart(files):
    found = {r.path.rsplit("/", 1)[1]: r.reason for r in files.collect()}
    assert found == {"a.v2": None, "b.v2": None, "older_name.v2": None, "zip.v2": "packed", "cut.v2": "cut off", "headless.v2": "no date"}


def test_one_file_for_a_date_the_last_by_name(files):
    assert sorted(r.path.rsplit("/", 1)[1] for r in S.one_per_date(files).collect()) == ["b.v2", "older_name.v2"]


def test_leaves_bear_broken_braces():
    assert [r[6:] for r in S.leaves('a=1 ENG={ b={ 2 3 } } } c="x y"')] == [("a", "1"), (None, "2"), (None, "3"), ("c", "x y")]
    assert list(S.leaves("")) == []
    assert [r[3] for r in S.leaves("ENG={ army={ regiment={ type=inf")] == [["army", "regiment"]]


def test_nations(t):
    n = {r.tag: r for r in C.nations(t, rate=F.lit(0.2)).where("date = '1836.1.1'").collect()}
    s, d = n["ZAN"], n["MIR"]
    assert (s.total_pop, d.total_pop, s.provinces, s.states, s.factory_count, s.factory_levels) == (31300, 9100, 3, 2, 1, 3)
    assert (s.regular_brigades, s.mobilized_brigades, s.ships, s.ports, s.techs) == (1, 1, 1, 1, 1)
    assert (d.starving, s.accepted_pop, s.accepted_pct, s.avg_literacy, s.pop_noncolonial) == (7000, 30100, 96.17, 0.25, 29500)
    assert (s.soldiers_noncolonial_pct, s.accepted_cultures, s.is_player, d.is_player) == (12.78, "orlic", True, False)
    assert (s.mobilization_pool, s.mobilization_pops, s.mobilization_brigades) == (25500, 3, 1)
    assert s.brigade_cap == 2 and C.nations(t, least=5000).where("date = '1836.1.1' and tag = 'ZAN'").first().brigade_cap == 1


def test_counts_market_and_wars(t, spark):
    long = C.long_counts(t)
    first = F.col("date") == "1836.1.1"
    cultures = [(r.culture, r["size"], r.accepted) for r in long["pops_by_culture"].where(first & (F.col("tag") == "ZAN")).orderBy("place").collect()]
    assert cultures == [("zanite", 27600, 1), ("orlic", 2500, 1), ("pelish", 1200, 0)]
    assert [(r.ship_type, r["count"], r.effective) for r in long["ships_by_type"].where(first).collect()] == [("steamer", 1, 1.0)]
    assert C.world_population(t).agg(F.max("world_pop")).first()[0] == 43800  # at the second date
    stamps = t["saves"].select("save_id", F.lit("1835.12.1").alias("stamp"))
    p = {(r.date, r.good): r.price for r in C.prices(t, stamps).collect()}
    assert p[("1835.11.1", "tea")] == 1.25 and p[("1835.12.1", "tea")] == 2.75 and p[("1836.1.1", "tea")] == 3.5
    assert {(r.good, r.supply) for r in C.market_snapshot(t).where(first).collect()} == {("tea", 14.0), ("iron", 0.0)}
    book = C.war_book(t).collect()
    assert len(book) == 1 and book[0].parties == ["MIR", "ZAN"] and book[0].records == 2 and book[0].active
    assert [(r["rank"], r.tag) for r in C.great_powers(t).join(t["saves"].where(first), "save_id").orderBy("rank").collect()] == [(1, "MIR"), (2, "ZAN")]


def test_changes_successions_and_growth(t, spark):
    changed = C.ownership_changes(t).where("before is not null").collect()
    assert [(r.pid, r.before, r.owner) for r in changed] == [(14, "MIR", "TOL")]
    none = spark.createDataFrame([], "old string, new string")
    assert [(r.old, r.new, r.share) for r in C.successions(t, none).collect()] == [("MIR", "TOL", 1.0)]
    n = C.nations(t)
    g = C.growth(n, "total_pop").where("tag = 'ZAN' and growth is not null").collect()
    assert len(g) == 1 and abs(g[0].growth - 100 * 3000 / 31300) < 1e-6
    assert [r.gain for r in C.gains(n, "total_pop").where("tag = 'ZAN'").orderBy("year_frac").collect()] == [None, 3000.0]
    assert C.across_campaigns(n).count() == 0
