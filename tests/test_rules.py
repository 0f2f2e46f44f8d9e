"""Rule files of a game and a mod over it: which file counts, what is read from it, and what follows for nations."""

import random

import pytest

from annalist.sources import rules as R

GAME = {
    "common/defines.lua": "defines = {\n POP_SIZE_PER_REGIMENT = 2800, -- MIN_MOBILIZE_LIMIT = 7\n XMIN_MOBILIZE_LIMIT = 8\n}",
    "common/countries.txt": 'AAB = "countries/Aab.txt"\nCCD = "countries/Ccd.txt"\nAAB = "countries/Other.txt"\ndynamic_tags = yes',
    "common/countries/Aab.txt": 'party = { name = "a" war_policy = hawks }\nparty = { name = "b" }',
    "common/countries/Ccd.txt": "party = { war_policy = doves }",
    "common/goods.txt": "raw = { tin = { cost = 2.5 } fur = { cost = 1 color = { 1 2 3 } } }",
    "common/cultures.txt": "north = { leader = x unit = { a } zan = { color = { 1 2 3 } } orl = { color = { 4 5 6 } } }",
    "common/issues.txt": "party_issues = { war_policy = { hawks = { mobilization_impact = 0.4 } doves = { mobilization_impact = 0.1 } } }\nmilitary = { draft = { none = { x = 1 } some = { mobilisation_size = 0.02 effect = { mobilisation_size = 0.03 } on_execute = { mobilisation_size = 9 } } } }",
    "common/static_modifiers.txt": "war = { mobilisation_size = 0.01 }\npeace = { mobilisation_size = 0 }",
    "poptypes/Miners.txt": "# strata = rich\nstrata = POOR",
    "poptypes/lords.txt": "strata = rich",
    "map/region.txt": "shore = { 1 2 } # three\nhill = { 3 }",
    "map/continent.txt": "isle = { provinces = { 1 2 3 } farm = 1 }",
    "localisation/a.csv": "AAB;Aabland;x\nKEY;of the game;\n#AAC;noted;\nEMPTY;;x",
}
MOD = {
    "common/Goods.txt": "raw = { tin = { cost = 3.5 } }",
    "common/cultures.txt": "south = { orl = { color = { 7 8 9 } } }",
    "poptypes/lords.txt": "strata = middle",
    "localisation/z.csv": "KEY;of the mod\x92s;\nKEY;later;",
    "over.mod": '﻿name = "Over: A = B" # told\npath = "mod/over"\nreplace_path = "map"\n# replace_path = common\n',
}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    out = []
    for name, files in (("game", GAME), ("over", MOD)):
        root = tmp_path_factory.mktemp(name)
        for rel, text in files.items():
            (root / rel).parent.mkdir(parents=True, exist_ok=True)
            (root / rel).write_bytes(text.encode("utf-8") if rel.endswith(".mod") else text.encode("latin-1"))
        out.append(str(root))
    return out


@pytest.fixture(scope="module")
def files(spark, folders):
    return R.read_layer(spark, folders[0], 0).persist(), R.read_layer(spark, folders[1], 1).persist()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_descriptors_and_replaced_folders(files):
    game, mod = files
    told = R.descriptor(mod.where("name = 'over.mod'"))
    assert rows(told, "nth", "key", "value") == [(0, "name", "Over: A = B"), (1, "path", "mod/over"), (2, "replace_path", "map")]
    kept = {(r.layer, r.folder, r.name) for r in R.resolved(R.layers(game, mod, told)).collect()}
    assert (1, "common", "Goods.txt") in kept and (0, "common", "goods.txt") not in kept and not [k for k in kept if k[1] == "map"]


def test_tables_of_rules(files):
    t = R.tables(R.rule_leaves(R.resolved(R.layers(*files))).persist())
    assert rows(t["strata"], "pop_type", "stratum") == [("lords", "middle"), ("miners", "poor")]
    assert rows(t["prices"], "good", "cost") == [("tin", 3.5)]
    assert rows(t["cultures"], "culture", "culture_group") == [("orl", "south"), ("zan", "north")]
    assert rows(t["regions"], "pid", "region") == [(1, "shore"), (2, "shore"), (3, "hill")]
    assert rows(t["continents"], "pid", "continent") == [(1, "isle"), (2, "isle"), (3, "isle")]
    assert rows(t["policy_impacts"], "policy", "value") == [("doves", 0.1), ("hawks", 0.4)]
    assert rows(t["reform_sizes"], "reform", "option", "value") == [("draft", "some", 0.05)]
    assert rows(t["static_sizes"], "modifier", "value") == [("war", 0.01)]
    assert rows(t["parties"], "party", "war_policy") == [(1, "hawks"), (2, ""), (3, "doves")]
    c = t["parties"].sparkSession.createDataFrame([("AAB", 1.0), ("CCD", 3.0), ("EEF", 9.0)], "tag string, ruling_party double")
    assert rows(R.ruling_impact(c, t), "tag", "mobilisation_impact") == [("AAB", 0.4), ("CCD", 0.1), ("EEF", 0.0)]


def test_constants_and_names(files):
    both = R.layers(*files)
    assert rows(R.defines(R.resolved(both)), "key", "value") == [("POP_SIZE_PER_REGIMENT", 2800.0)]
    assert rows(R.localisation(both), "key", "text", "hash") == [("#AAC", "noted", True), ("AAB", "Aabland", False), ("KEY", "of the mod’s", False)]


def test_what_can_be_invented(spark):
    d = lambda rows, cols: spark.createDataFrame(rows, cols)
    rules = {
        "inventions": d([("a", None), ("b", None), ("c", None), ("d", 1.0), ("e", 1.0), ("f", None)], "invention string, base double"),
        "techs": d([("a", "t1"), ("a", "t2"), ("b", "t1"), ("c", "t1"), ("d", "t1"), ("e", "t1")], "invention string, tech string"),
        "tags": d([("f", "YYZ")], "invention string, tag string"), "requires": d([("c", "a")], "invention string, other string"),
        "blockers": d([("d", "c", -1.0), ("e", "b", -1.0), ("e", "unknown", -1.0)], "invention string, other string, factor double"),
    }
    # nobody has both t1 and t2, so a goes; c needs a; what c's absence adds brings d to nothing
    holdings = d([("w", "XXY", "t1"), ("w", "YYZ", "t2"), ("v", "XXY", "t1"), ("v", "XXY", "t2")], "campaign string, tag string, tech string")
    assert rows(R.attainable(rules, holdings), "campaign", "invention") == [("v", "a"), ("v", "b"), ("v", "c"), ("v", "d"), ("v", "e"), ("w", "b"), ("w", "e"), ("w", "f")]
    assert R.attainable(rules, holdings.limit(0)).collect() == []
    held = R.named_inventions(d([("XXY", [5, 6, 99])], "tag string, ids array<int>"), d([(0, "p"), (1, "q")], "seq int, invention string"), 5)
    assert rows(held, "tag", "invention") == [("XXY", "p"), ("XXY", "q")]


def test_naval_profiles(spark):
    base = spark.createDataFrame([("barge", "gun", 5.0), ("barge", "evasion", 0.5), ("skiff", "gun", 1.0), ("skiff", "score", 1.0)], "ship_type string, stat string, value double")
    deltas = spark.createDataFrame([("t1", "navy_base", "gun", 2.0), ("t2", "barge", "evasion", 0.7), ("t3", "skiff", "gun", -9.0), ("t3", "skiff", "score", -4.0)], "what string, ship_type string, stat string, value double")
    holdings = spark.createDataFrame([("XXY", "t1"), ("XXY", "t2"), ("XXY", "t3"), ("YYZ", "none")], "holder string, has string")
    got = {r[:3]: r[3] for r in rows(R.naval_profiles(base, deltas, holdings), "holder", "ship_type", "stat", "value")}
    assert got == {
        ("XXY", "barge", "gun"): 7.0, ("XXY", "barge", "evasion"): 0.95, ("XXY", "skiff", "gun"): 0.0, ("XXY", "skiff", "score"): -3.0,
        ("YYZ", "barge", "gun"): 5.0, ("YYZ", "barge", "evasion"): 0.5, ("YYZ", "skiff", "gun"): 1.0, ("YYZ", "skiff", "score"): 1.0,
    }


def test_long_chains_and_sums_of_blockers(spark):
    r = random.Random(6)
    names = [f"i{k:02d}" for k in range(90)]
    base = {x: r.choice([None, 1.0, 2.0]) for x in names}
    requires = {(names[k], names[k - 1]) for k in range(1, 30)} | {(r.choice(names), r.choice(names)) for _ in range(10)}
    blockers = [(r.choice(names), r.choice([*names, "other"]), r.choice([-1.0, -0.5, -2.0])) for _ in range(120)]
    needs = {(x, f"t{r.randint(0, 6)}") for x in names for _ in range(r.randint(0, 2))} | {("i00", "never")}
    tags = {(x, r.choice("PQ")) for x in r.sample(names, 12)}
    held = {(c, r.choice("PQR"), f"t{r.randint(0, 6)}") for c in "uv" for _ in range(14)}
    want = set()
    for c in "uv":
        techs = {t: {k for cc, tt, k in held if cc == c and tt == t} for cc, t, _ in held if cc == c}
        live = {x for x in names if any({k for y, k in needs if y == x} <= have and (not any(y == x for y, _ in tags) or (x, t) in tags) for t, have in techs.items())}
        while True:
            dead = {x for x in live if any(y == x and o not in live for y, o in requires) or (base[x] is not None and (gone := [f for y, o, f in blockers if y == x and o in names and o not in live]) and base[x] + sum(gone) <= 0)}
            if not dead:
                break
            live -= dead
        want |= {(c, x) for x in live}
    d = spark.createDataFrame
    rules = {
        "inventions": d(list(base.items()), "invention string, base double"), "techs": d(list(needs), "invention string, tech string"), "tags": d(list(tags), "invention string, tag string"),
        "requires": d(list(requires), "invention string, other string"), "blockers": d(blockers, "invention string, other string, factor double"),
    }
    got = set(rows(R.attainable(rules, d(list(held), "campaign string, tag string, tech string")), "campaign", "invention"))
    assert got == want and not any(("u", x) in got for x in names[:30])  # a chain of thirty goes link by link
