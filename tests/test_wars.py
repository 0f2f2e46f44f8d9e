"""The war book on two snapshots of one campaign, and rounding against Python's own."""

import math
import random

import pytest
from pyspark.sql import functions as F

from annalist.functions.scalars import half_even
from annalist.plans import wars as B
from annalist.sources import saves as S

from .savebuilder import land, realm, snapshot


def battle(name, place, won, ours, theirs):
    def side(tag, lost, **units):
        return [("country", f'"{tag}"'), ("leader", '"Cpt"'), *units.items(), ("losses", lost)]

    return ("battle", [("name", f'"{name}"'), ("location", place), ("result", won), ("attacker", side(*ours[:2], **ours[2])), ("defender", side(*theirs[:2], **theirs[2]))])


REEF = battle("Reef", 22, "yes", ("KOR", 300, {"barge": 4}), ("LUM", 700, {"barge": 2}))
HILL = battle("Hill", 23, "no", ("KOR", -4294000, {"lancer": 3000, "digger": 9000}), ("LUM", 50, {"lancer": 100}))


def war(*more, goal_done="no", leaves=()):
    history = [("1840.5.1", [("add_attacker", '"KOR"'), ("add_defender", '"LUM"')]), ("1840.5.20", [("add_defender", '"PEL"')]), ("1841.2.1", [("add_attacker", '"OST"'), REEF]), *more, *leaves]
    goal = ("war_goal", [("state_province_id", 22), ("casus_belli", '"grab"'), ("actor", '"KOR"'), ("receiver", '"LUM"'), ("date", '"1840.5.1"'), ("is_fulfilled", goal_done)])
    return [("name", '"Reef War"'), ("history", history), ("original_attacker", '"KOR"'), ("original_defender", '"LUM"'), goal]


def scene(date, holder, state):
    return snapshot(date, "KOR", "a b", [land(21, "KOR"), land(22, holder), land(23, holder), land(24, "LUM"), realm("KOR", "korri"), realm("LUM", "lumi"), state])


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("fought") / "south"
    d.mkdir()
    quit_ = ("1841.6.1", [("rem_defender", '"PEL"')])
    end = ("1842.1.1", [("rem_attacker", '"KOR"'), ("rem_defender", '"LUM"')])
    (d / "a.v2").write_bytes(scene("1839.1.1", "LUM", ("previous_war", [("name", '"Old"'), ("original_attacker", '"KOR"'), ("original_defender", '"---"')])))
    (d / "b.v2").write_bytes(scene("1841.3.1", "LUM", ("active_war", war())))
    (d / "c.v2").write_bytes(scene("1843.1.1", "KOR", ("previous_war", war(("1842.3.1", [HILL]), goal_done="yes", leaves=[quit_, end]))))
    kept = S.one_per_date(S.read_files(spark, str(d))).persist()
    rows = S.read_leaves(kept).persist()
    regions = spark.createDataFrame([(22, "shore"), (23, "shore"), (24, "shore")], "pid long, region string")
    kinds = spark.createDataFrame([("barge", "naval"), ("lancer", "land"), ("digger", "support")], "unit string, kind string")
    return B.book(S.tables(kept, rows), S.war_parts(rows), regions, kinds)


def test_wars_of_two_saves_are_one(book):
    (w,) = book["wars"].collect()
    assert (w.start, w.end, w.active, w.battles, w.dated, w.outcome) == ("1840.5.1", "1842.3.1", False, 2, 2, "1 of 1 taken")
    assert (w.attacker_losses, w.defender_losses) == (300 + 967, 750)


def test_battles_once_with_place_and_units(book):
    got = {r.battle_name: (r.date, r.won, r.sea, r.a_units, r.d_units, r.a_losses) for r in book["battles"].collect()}
    assert got == {"Reef": ("1841.2.1", True, True, "barge:4", "barge:2", 300), "Hill": ("1842.3.1", False, False, "digger:9000;lancer:3000", "lancer:100", 967)}


def test_parties_in_order_with_their_dates(book):
    got = sorted((not r.attacks, r.place, r.tag, r.joined, r.left, r.leads, r.original) for r in book["parties"].collect())
    assert got == [
        (False, 1, "KOR", "1840.5.1", "1842.1.1", True, True), (False, 2, "OST", "1841.2.1", None, False, False),
        (True, 1, "LUM", "1840.5.1", "1842.1.1", True, True), (True, 2, "PEL", "1840.5.20", "1841.6.1", False, True),
    ]


def test_goals_against_the_ledgers(book):
    (g,) = book["goals"].collect()
    assert (g.region, g.had, g.took, g.met, g.part, g.fulfilled) == ("shore", 3, 2, False, True, True)
    assert {r.tag for r in book["fighters"].collect()} == {"KOR", "LUM", "OST", "PEL"}


def test_state_labels(spark):
    rows = [("r", "Shore", "Quay"), ("r", "", "Quay"), ("r", None, ""), (None, None, None)]
    d = spark.createDataFrame(rows, "a string, b string, c string")
    assert [r[0] for r in d.select(B.state_label(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["Shore", "Quay Region", "r", ""]


@pytest.mark.parametrize("digits", [0, 2, 5])
def test_rounding_is_that_of_exact_binary_values(spark, digits):
    rng = random.Random(digits)
    xs = [2.675, 0.125, 0.375, 2.5, 3.5, -0.125, 1.005, 0.0, 1e300, 4503599627370497.5, 12345.0005, 5e-324]
    xs += [rng.uniform(-1000, 1000) for _ in range(3000)] + [(2 * rng.randrange(10**7) + 1) / 10**digits / 2 for _ in range(3000)] + [rng.randrange(10**6) / 8 for _ in range(500)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    got = dict(d.select("i", half_even(F.col("x"), digits)).collect())
    assert [got[i] for i in range(len(xs))] == [round(x, digits) for x in xs]
    odd = d.limit(1).select(half_even(F.lit(None), digits), half_even(F.lit(math.nan), digits), half_even(F.lit(math.inf), digits)).first()
    assert odd[0] is None and math.isnan(odd[1]) and odd[2] == math.inf
