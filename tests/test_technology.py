"""Technologies, inventions, ships and decisions from rule files, and what operators make of them."""

import pytest
from pyspark.sql import functions as F

from annalist.plans import alignment as A
from annalist.plans import mobilisation as M
from annalist.sources import rules as R
from annalist.sources import technology as T

FILES = {
    "technologies/army_tech.txt": "drill = { area = infantry year = 1840 cost = 3600 mobilisation_size = 0.02 ai_chance = { factor = 1 frigate = { hull = 9 } } }\nguns = { area = artillery year = 1850 morale = 0.1 }\nmass_drill = { area = infantry year = 1870 frigate = { hull = 2 gun_power = 1 } navy_base = { evasion = 0.1 } unciv_military = yes }",
    "technologies/culture_tech.txt": "presses = { year = 1836 plurality = 0.5 rgo = { size = { wool = 0.2 } } }",
    "inventions/a_army.txt": "# first\nconscripts = { limit = { mass_drill = 1 tag = ABE NOT = { presses = 1 tag = XXX } } chance = { base = 2 modifier = { factor = -1 NOT = { invention = news } } modifier = { factor = 1 year = 1870 } } effect = { mobilisation_size = 0.01 effect = { mobilisation_size = 0.005 } } }\nnews = { limit = { presses = 1 } chance = { base = 5 } effect = { frigate = { gun_power = 3 } shared_prestige = 1 } }",
    "inventions/B_late.txt": "levy = { limit = { invention = conscripts AND = { drill = 1 } } effect = { navy_base = { hull = 4 } navy_base = { hull = 1 } } }\nfree = { chance = { base = 1 modifier = { factor = -1 NOT = { invention = lost } } modifier = { factor = -2 NOT = { invention = conscripts } } } }",
    "common/nationalvalues.txt": "duty = { mobilisation_size = 0.03 }\ncalm = { mobilisation_size = 0 }", "common/event_modifiers.txt": "zeal = { mobilisation_size = 0.04 icon = 2 }",
    "common/triggered_modifiers.txt": "alarm = { trigger = { war = yes mobilisation_size = 7 } mobilisation_size = 0.06 }",
    "units/frigate.txt": "frigate = { type = naval unit_type = light_ship hull = 10 gun_power = 5 evasion = 0.2 }", "units/ironclad.txt": "ironclad = { type = naval unit_type = big_ship hull = 50 torpedo_attack = -1 }", "units/infantry.txt": "infantry = { type = infantry hull = 1 }",
    "decisions/union.txt": "political_decisions = { form_ged = { potential = { OR = { tag = ABE tag = CED } NOT = { exists = GED } } effect = { change_tag = GED } } fleet = { potential = { tag = ABE } effect = { money = 1 } } }",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("rules")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return R.rule_tree(R.resolved(R.read_layer(spark, str(root), 0))).persist()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_trees():
    got = list(R.tree("a = { b = { 1 2 } c = x } d = 4 # no\n } e = {"))
    assert got == [("a", 1, 0, 0, [], "a", None, True), ("a", 2, 1, 1, [], "b", None, True), ("a", 3, 2, 2, ["b"], None, "1", False), ("a", 4, 2, 2, ["b"], None, "2", False), ("a", 5, 1, 1, [], "c", "x", False), ("d", 6, 0, 0, [], "d", "4", False), ("e", 7, 0, 0, [], "e", None, True)]
    assert list(R.tree("")) == [] and list(R.tree("a =")) == []


def test_technologies(tree):
    t = T.technologies(tree)
    assert rows(t["techs"], "category", "area", "place", "tech", "year", "cost") == [("army", "artillery", 1, "guns", 1850, 0), ("army", "infantry", 1, "drill", 1840, 3600), ("army", "infantry", 2, "mass_drill", 1870, 0), ("culture", "other", 1, "presses", 1836, 0)]
    assert rows(t["prerequisites"], "tech", "needs") == [("mass_drill", "drill")]
    assert rows(t["effects"], "tech", "label", "value") == [("drill", "mobilisation_size", "0.02"), ("guns", "morale", "0.1"), ("mass_drill", "frigate:gun_power", "1"), ("mass_drill", "frigate:hull", "2"), ("mass_drill", "navy_base:evasion", "0.1"), ("presses", "plurality", "0.5"), ("presses", "rgo:size:wool", "0.2")]


def test_inventions_and_what_follows(spark, tree):
    i = T.inventions(tree)
    assert rows(i["sequence"], "seq", "invention") == [(0, "conscripts"), (1, "news"), (2, "levy"), (3, "free")]
    assert rows(i["techs"], "invention", "tech") == [("conscripts", "mass_drill"), ("levy", "drill"), ("news", "presses")]
    assert rows(i["tags"], "invention", "tag") == [("conscripts", "ABE")] and rows(i["requires"], "invention", "other") == [("levy", "conscripts")]
    assert rows(i["blockers"], "invention", "other", "factor") == [("conscripts", "news", -1.0), ("free", "conscripts", -2.0), ("free", "lost", -1.0)]
    assert {r.invention: r.base for r in i["inventions"].collect()} == {"conscripts": 2.0, "news": 5.0, "levy": None, "free": 1.0}
    assert rows(T.unlocked(i, T.technologies(tree)), "invention", "tech", "year") == [("conscripts", "drill", 1870), ("conscripts", "mass_drill", 1870), ("levy", "drill", 1840), ("news", "presses", 1836)]
    held = spark.createDataFrame([("one", "ABE", t) for t in ("drill", "mass_drill")] + [("two", "CED", t) for t in ("drill", "mass_drill", "presses")], "campaign string, tag string, tech string")
    # news are dead in one, which leaves conscripts a chance of 1; conscripts are for ABE alone, without them levies and what is free go
    assert rows(R.attainable(i, held), "campaign", "invention") == [("one", "conscripts"), ("one", "free"), ("one", "levy"), ("two", "news")]
    assert rows(A.ordered(i["sequence"], i["techs"], i["tags"]), "seq", "needs", "may") == [(0, ["mass_drill"], ["ABE"]), (1, ["presses"], []), (2, ["drill"], []), (3, [], [])]


def test_sizes_and_ships(spark, tree):
    assert rows(T.mobilisation_sizes(tree), "kind", "name", "value") == [("event modifier", "zeal", 0.04), ("invention", "conscripts", 0.015), ("national value", "duty", 0.03), ("tech", "drill", 0.02), ("triggered modifier", "alarm", 0.06)]
    none = {"reform_sizes": spark.createDataFrame([], "reform string, option string, value double"), "static_sizes": spark.createDataFrame([], "modifier string, value double")}
    held = spark.createDataFrame([("ABE", "tech", "drill", 1), ("ABE", "invention", "conscripts", 0), ("ABE", "tech", "guns", 2)], "tag string, kind string, name string, place long")
    assert [(r.tag, round(r.rate, 9)) for r in M.rates(M.contributions(held, M.sizes(none, T.mobilisation_sizes(tree))), ["tag"]).collect()] == [("ABE", 0.035)]
    hulls = T.hulls(tree)
    assert rows(hulls.where("value <> 0"), "ship_type", "heavy", "stat", "value") == [("frigate", False, "evasion", 0.2), ("frigate", False, "gun_power", 5.0), ("frigate", False, "hull", 10.0), ("ironclad", True, "hull", 50.0), ("ironclad", True, "torpedo_attack", -1.0)]
    assert rows(T.hull_changes(tree), "what", "ship_type", "stat", "value") == [("levy", "navy_base", "hull", 5.0), ("mass_drill", "frigate", "gun_power", 1.0), ("mass_drill", "frigate", "hull", 2.0), ("mass_drill", "navy_base", "evasion", 0.1), ("news", "frigate", "gun_power", 3.0)]
    holdings = spark.createDataFrame([("ABE", "mass_drill"), ("ABE", "levy"), ("ABE", "news")], "holder string, has string")
    got = {r[:2]: r[2] for r in rows(R.naval_profiles(hulls.drop("heavy"), T.hull_changes(tree), holdings).where(F.col("stat").isin("hull", "gun_power", "evasion")), "ship_type", "stat", "value")}
    assert {k: round(v, 9) for k, v in got.items()} == {("frigate", "hull"): 17.0, ("frigate", "gun_power"): 9.0, ("frigate", "evasion"): 0.3, ("ironclad", "hull"): 55.0, ("ironclad", "gun_power"): 0.0, ("ironclad", "evasion"): 0.1}


def test_formations(tree):
    assert rows(T.formations(tree), "old", "new") == [("ABE", "GED"), ("CED", "GED")]
