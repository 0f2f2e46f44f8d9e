"""Triggers as data against a walk of each tree by plain Python."""

import random

import pytest

from annalist.plans import campaign as C
from annalist.plans import triggers as T
from annalist.sources import blocks as B
from annalist.sources import rules as R

from .savebuilder import land, realm, snapshot

FACTS = "save_id string, tag string, key string, text string, number double"
REFORMS = ["draft", "press"]


def whole(text, otherwise):
    try:
        return int(float(text))
    except ValueError:
        return otherwise


def number(text):
    try:
        return float(text)
    except ValueError:
        return 0.0


def every(values):
    return False if False in values else None if None in values else True


def logic(key, values):
    if key == "OR":
        return True if True in values else None if None in values else False
    return every([None if v is None else not v for v in values] if key == "NOT" else values)


def ask(key, value, n, scoped=False):
    """Of a condition (key, text or list) and a nation's dict."""
    if key in ("AND", "OR", "NOT"):
        return logic(key, [ask(k, v, n, scoped) for k, v in value]) if isinstance(value, list) else None
    if scoped:
        if isinstance(value, list):
            return None
        return (None if n["continent"] is None else n["continent"] == value) if key == "continent" else n["capital"] == whole(value, -2) if key == "province_id" else None
    if key == "capital_scope":
        return every([ask(k, v, n, True) for k, v in value]) if isinstance(value, list) else None
    if isinstance(value, list):
        return None
    if key in ("civilized", "war", "is_greater_power", "ai"):
        return n[key] == (value.lower() == "yes")
    if key == "exists":
        return {"yes": True, "no": False}.get(value.lower())
    if key in ("tag", "government", "primary_culture", "nationalvalue", "is_culture_group", *REFORMS):
        return n.get(key) == value
    if key in ("invention", "technology", "has_country_flag", "has_country_modifier"):
        return value in n[key]
    if key == "year":
        return None if n["year"] is None else n["year"] >= whole(value, 0)
    if key in T.AT_LEAST:
        return n[key] >= number(value)
    return n["capital"] == whole(value, -2) if key == "capital" else False if key == "owns" else None


def some_nation(r, i):
    n = {k: r.random() < 0.5 for k in ("civilized", "war", "is_greater_power", "ai")} | {k: float(r.randint(0, 3)) for k in T.AT_LEAST}
    n |= {k: r.choice("ab") for k in ("government", "primary_culture", "nationalvalue", "is_culture_group", "draft", "press")} | {k: set(r.sample("abcd", 2)) for k in ("invention", "technology", "has_country_flag", "has_country_modifier")}
    return n | {"tag": f"T{i:02d}", "capital": r.randint(-2, 3), "continent": r.choice(["a", "b", None]), "year": r.choice([None, 1, 2])}


def rows_of(n):
    yes = [(k, None, None) for k in ("civilized", "war", "is_greater_power") if n[k]] + ([] if n["ai"] else [("ai", None, None)])
    texts = [(k, n[k], None) for k in ("tag", "government", "primary_culture", "nationalvalue", "is_culture_group", "draft", "press")] + [(k, x, None) for k in ("invention", "technology", "has_country_flag", "has_country_modifier") for x in n[k]]
    numbers = [(k, None, n[k]) for k in T.AT_LEAST if k != "year"] + [("year", None, n["year"] if n["year"] is None else float(n["year"])), ("capital", None, float(n["capital"]))]
    return [("s", n["tag"], *x) for x in yes + texts + numbers + ([("continent", n["continent"], None)] if n["continent"] else [])]


def some_trigger(r, depth=0, scoped=False):
    out = []
    for _ in range(r.randint(0 if depth else 1, 3)):
        key = r.choice(["AND", "OR", "NOT", "capital_scope"] if depth < 3 and r.random() < 0.45 else T.OF_CAPITAL if scoped else T.YES_NO + T.EQUAL + T.AT_LEAST + T.WHOLE + REFORMS + ["odd"])
        if key in ("AND", "OR", "NOT", "capital_scope"):
            out.append((key, some_trigger(r, depth + 1, scoped or key == "capital_scope") if r.random() < 0.95 else "yes"))
        else:
            value = r.choice(["yes", "no", "x"]) if key in T.YES_NO else r.choice(["-1", "0", "1", "2", "3", "x"]) if key in T.AT_LEAST + T.WHOLE + ["province_id"] else r.choice("abc")
            out.append((key, value if r.random() < 0.97 else [("tag", "a")]))
    return out


def text_of(conditions):
    return "{ " + " ".join(f"{k} = {text_of(v) if isinstance(v, list) else v}" for k, v in conditions) + " }"


def tree_of(spark, rules, tmp_path):
    (tmp_path / "common").mkdir(parents=True)
    (tmp_path / "common/triggered_modifiers.txt").write_text("".join(f"{name} = {{ icon = 3 trigger = {text_of(t)} size = 0.5 }}\n" for name, t in rules.items()) + "always = { size = 1 }\n")
    return R.rule_tree(R.read_layer(spark, str(tmp_path), 0))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_triggers(spark, tmp_path, seed):
    r = random.Random(seed)
    rules = {f"r{i}": some_trigger(r) for i in range(150)}
    nations = [some_nation(r, i) for i in range(12)]
    reforms = spark.createDataFrame([(x,) for x in REFORMS], "reform string")
    tree = T.nodes(tree_of(spark, rules, tmp_path))
    facts = spark.createDataFrame([x for n in nations for x in rows_of(n)], FACTS)
    got = {(x.tag, x.rule) for x in T.judged(tree, facts, reforms).collect()}
    assert got == {(n["tag"], name) for n in nations for name, t in rules.items() if every([ask(k, v, n) for k, v in t]) is True} | {(n["tag"], "always") for n in nations}
    assert 100 < len(got) < 1500

    def odd(conditions, scoped=False):
        for k, v in conditions:
            if k in ("AND", "OR", "NOT") or (k == "capital_scope" and not scoped):
                if not isinstance(v, list) or odd(v, scoped or k == "capital_scope"):
                    return True
            elif k not in (T.OF_CAPITAL if scoped else T.YES_NO + T.EQUAL + T.AT_LEAST + T.WHOLE + REFORMS):
                return True
        return False

    assert {x.rule for x in T.unreadable(tree, reforms).collect()} == {name for name, t in rules.items() if odd(t)}


def test_facts_of_a_snapshot(spark, tmp_path):
    d = tmp_path / "west"
    d.mkdir()
    zan = realm("ZAN", "zanite", ("government", '"crown"'), ("capital", 5), ("human", "yes"), ("badboy", "3.5"), ("draft", '"all"'), ("flags", [("proud", "yes")]), ("technology", [("drill", ["1 0.000"]), ("maps", ["0 0.000"])]), ("modifier", [("modifier", '"zeal"'), ("date", '"1840.1.1"')]))
    wars = [("active_war", [("name", '"A"'), ("history", [("1830.1.1", [("add_attacker", '"ZAN"'), ("add_defender", '"MIR"')])]), ("attacker", '"MIR"')]), ("active_war", [("name", '"B"'), ("history", [("1831.1.1", [("add_attacker", '"OLD"')])])])]
    (d / "a.v2").write_bytes(snapshot("1842.1.1", "ZAN", "f", [land(5, "ZAN"), land(6, "MIR"), zan, realm("MIR", "mirran"), realm("OLD", "dusk"), ("great_nations", ["2"]), *wars]))
    t = B.campaigns(spark, str(d))
    table = lambda rows, cols: spark.createDataFrame(rows, cols)
    reforms = table([("draft",)], "reform string")
    facts = T.facts(t, C.nations(t), reforms, table([("zanite", "north")], "culture string, culture_group string"), table([(5, "isle")], "pid long, continent string"))
    rules = {
        "own": [("tag", "ZAN"), ("government", "crown"), ("draft", "all"), ("has_country_flag", "proud"), ("has_country_modifier", "zeal"), ("technology", "drill"), ("badboy", "3"), ("year", "1842"), ("ai", "no"), ("is_culture_group", "north"), ("capital_scope", [("continent", "isle"), ("province_id", "5")])],
        "fights": [("war", "yes")], "great": [("is_greater_power", "yes")], "peace": [("NOT", [("war", "yes"), ("technology", "maps")])], "knows": [("NOT", [("invention", "press")])], "late": [("year", "1843")],
    }
    tree = T.nodes(tree_of(spark, rules, tmp_path / "rules"))
    got = {(x.tag, x.rule) for x in T.judged(tree, facts, reforms, inventions_known=False).collect()}
    assert got == {("ZAN", "own"), ("MIR", "fights"), ("MIR", "great"), ("ZAN", "peace"), ("ZAN", "always"), ("MIR", "always")}
    assert {(x.rule, x.key) for x in T.mentioned(tree).where("rule = 'peace'").collect()} == {("peace", "war"), ("peace", "technology")}
    held = {(r.tag, tuple(r.techs), r.n) for r in T.holdings(t).collect()}
    assert held == {("ZAN", ("drill",), 1), ("MIR", (), 1), ("OLD", (), 1)}


def test_no_rules(spark):
    none = spark.createDataFrame([], "rule string, node string, parent string, level int, key string, value string, is_block boolean, scoped boolean")
    assert T.judged(none, spark.createDataFrame([("s", "A", "tag", "A", None)], FACTS), spark.createDataFrame([], "reform string")).collect() == []
