"""The report's tables whole, as files, and what must hold of them."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from annalist.plans import gold as G
from annalist.plans import invariants as I
from annalist.sources import blocks as B

from .bigsave import big_snapshot
from .savebuilder import islands, land, realm, snapshot


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("gold") / "north"
    d.mkdir()
    called = [("scheduled_mobilization", [("spawned", "no")]), ("scheduled_mobilization", [("spawned", "yes")]), ("scheduled_mobilization", [("province", 3)])]
    more = realm("QAB", "dusk", *called, ("navy", [("name", '"N"'), ("army", [("name", '"A"')]), ("ship", [("type", "raft")])]))
    (d / "a.v2").write_bytes(islands())
    later = snapshot("1837.1.1", "ZAN", "a", [more, land(16, "QAB")])
    (d / "b.v2").write_bytes(islands("1837.1.1") + later[later.index(b"QAB=") :])
    (d / "big.v2").write_bytes(big_snapshot("1850.1.1", 40, 4, 6, 3))
    return B.campaigns(spark, str(d))


@pytest.fixture(scope="module")
def nations(spark, t):
    d = spark.createDataFrame
    saves = {r.date: r.save_id for r in t["saves"].collect()}
    rates = d([(saves["1836.1.1"], "ZAN", 0.2)], "save_id string, tag string, rate double")
    impacts = d([(saves["1836.1.1"], "ZAN", 0.5)], "save_id string, tag string, impact double")
    policies = d([(1, "hawks", 0.25)], "ruling_party int, war_policy string, value double")
    branches = d([("sail_craft", "navy", "hulls")], "tech string, category string, area string")
    known = dict(t) | {"country": t["country"].withColumn("ruling_party", F.when(F.col("tag") == "ZAN", 1.0))}
    return G.nations_whole(known, rates, impacts, policies, ["farmers", "clerks"], branches).persist()


def test_columns(nations):
    assert len(G.COLUMNS) == 60 and nations.columns[4:64] == G.COLUMNS and nations.columns[64:] == ["pop_farmers", "pop_clerks", "accepted_cultures"]
    z = nations.where("date = '1836.1.1' and tag = 'ZAN'").first()
    # one standing brigade, at least three: 3 * 1.75 is 5; one can be raised, as a share of 0.2 of the groups
    assert (z.mobilisation_size, z.mobilization_cap, z.mobilization_available, z.mobilization_remaining, z.war_policy) == (0.2, 5, 1, 0, "hawks")
    assert (z.armies, z.navies, z.techs, z.navy_techs, z.army_techs, z.pop_farmers, z.is_player, z.infamy) == (1, 1, 1, 1, 0, 18700, 1, 0.0)
    q = nations.where("tag = 'QAB'").first()
    assert (q.mobilizing, q.navies, q.armies, q.ships) == (2, 1, 1, 1) and (q.total_pop, q.mobilization_cap, q.avg_literacy, q.war_policy) == (0, 0, 0.0, "")


def test_all_rules_hold(nations):
    assert len(I.rules()) == 58 and I.untested(nations) == []
    assert I.violations(nations, ["campaign", "at", "tag"]).collect() == []


def test_broken_rules_are_told(nations):
    bad = nations.withColumn("total_pop", F.when(F.col("tag") == "MIR", -5).otherwise(F.col("total_pop"))).withColumn("avg_literacy", F.lit(1.5)).withColumn("is_player", F.lit(3)).withColumn("techs", F.lit(None).cast("long"))
    got = {}
    for r in I.violations(bad, ["at", "tag"], most=2).collect():
        got.setdefault(r.rule, []).append((r.place, r.broken, r.tag))
    n = nations.count()
    assert sorted(got["avg_literacy lies from 0 to 1"]) == [(1, n, "MIR"), (2, n, "ZAN")] and sorted(got["total_pop is not negative"]) == [(1, 2, "MIR"), (2, 2, "MIR")]
    assert {"the strata are the whole population", "is_player is 0 or 1", "navy technologies are part of all technologies", "people outside the colonies are part of the population"} <= set(got)
    assert "the accepted share is the accepted population over the whole" in got and I.untested(nations.drop("techs")) == ["techs is not negative", "army and navy technologies are part of all technologies", "navy technologies are part of all technologies"]


def test_numbers_as_python_writes_them(spark):
    xs = [0.0, -0.0, 1.0, 0.25, 100.0, 1e-3, 1e-4, 1.5e-4, 1e-5, -2.5e-7, 1e7, 12345678.0, 12345678.5, -1.5e15, 1e16, 1.234e20, 1e100, 1e-300, 9999999.0, 123456789012345.6, float("inf"), float("nan"), 5e-324, 1 / 3]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(G.spelled(F.col("x"))).collect()]
    assert got[:-2] == [repr(x) for x in xs[:-2]] and got[-1] == repr(xs[-1])


def test_files(spark, t, nations, tmp_path):
    stamps = t["saves"].select("save_id", F.lit("1835.12.1").alias("stamp"))
    tables = G.long_tables(t, stamps)
    G.write_tables(nations, tables, f"file://{tmp_path}/out", files=2)

    def read(name):
        head = (tmp_path / f"out/{name}.header.csv").read_bytes()
        body = b"".join(p.read_bytes() for p in sorted((tmp_path / f"out/{name}.csv").glob("part-*")))
        return list(csv.DictReader(io.StringIO((head + body).decode(), newline="")))

    rows = read("nations_timeseries")
    assert [r["date"] for r in rows] == sorted(r["date"] for r in rows) and len(rows) == nations.count()
    assert next(r for r in rows if r["tag"] == "ZAN")["avg_literacy"] == "0.25" and rows[0]["accepted_cultures"] == "orlic"
    assert {k: list(read(k)[0]) for k in G.TABLES} == {k: c for k, (c, _) in G.TABLES.items()}
    tea = [(r["date"], r["category"], r["price"]) for r in read("prices") if r["good"] == "tea"]
    assert tea == [("1835.11.1", "raw", "1.25"), ("1835.12.1", "raw", "2.75"), ("1836.1.1", "raw", "3.5"), ("1837.1.1", "raw", "3.5")]
    cultures = [(r["culture"], r["size"]) for r in read("pops_by_culture") if r["tag"] == "ZAN" and r["date"] == "1836.1.1"]
    assert cultures == [("zanite", "27600"), ("orlic", "2500"), ("pelish", "1200")]
    odd = spark.createDataFrame([(1, 'a,"b"'), (2, " c "), (3, None), (4, "d\r\ne")], "at int, x string")
    G.write_csv(odd, f"file://{tmp_path}/odd", ["at", "x"], ["at"], 1)
    assert b"".join(p.read_bytes() for p in (tmp_path / "odd").glob("part-*")) == b'1,"a,""b"""\r\n2, c \r\n3,\r\n4,"d\r\ne"\r\n'
