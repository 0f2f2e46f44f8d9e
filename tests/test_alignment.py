"""The first number of inventions, against counts in plain Python."""

import random
from collections import Counter, defaultdict

import pytest

from annalist.plans import alignment as A

HELD = "campaign string, tag string, techs array<string>, ids array<long>, n long"


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(3)
    order = [(k, f"inv{k}", sorted(r.sample([f"t{x}" for x in range(8)], r.randint(0, 2))), ["PAA"] if k % 9 == 4 else []) for k in range(40)]
    order[7] = (7, "inv7", ["lost"], [])
    held = []
    for base, campaign in ((1, "one"), (0, "zero"), (3, "else")):
        for _ in range(60):
            tag, techs = r.choice(["PAA", "PBB"]), set(r.sample([f"t{x}" for x in range(8)], 6))
            fit = [k for k, _, needs, may in order if set(needs) <= techs and (not may or tag in may)]
            ids = sorted(k + base for k in r.sample(fit, min(9, len(fit)))) + ([99] if r.random() < 0.1 else [])
            held.append((campaign, tag, sorted(techs) if r.random() < 0.95 else [], ids, r.randint(1, 4)))
    d = spark.createDataFrame
    return held, order, d(held, HELD), d(order, "seq long, invention string, needs array<string>, may array<string>")


def plain_violations(held, order, base):
    bad, total = Counter(), Counter()
    for c, tag, techs, ids, n in held:
        for i in ids:
            j = i - base
            total[c] += n
            if not 0 <= j < len(order) or not set(order[j][2]) <= set(techs) or (order[j][3] and tag not in order[j][3]):
                bad[c] += n
    return {(c, base): (bad[c], total[c]) for c in total}


def test_violations_and_bases(world):
    held, order, d, o = world
    counted = A.violations(d, o)
    assert {(r.campaign, r.base): (r.bad, r.total) for r in counted.collect()} == plain_violations(held, order, 1) | plain_violations(held, order, 0)
    least = {c: min((plain_violations(held, order, b)[c, b][0] / plain_violations(held, order, b)[c, b][1], -b) for b in (1, 0)) for c in ("one", "zero", "else")}
    assert {r.campaign: r.base for r in A.index_bases(counted, most=0.2).collect()} == {c: -b for c, (rate, b) in least.items() if rate <= 0.2}
    assert {r.campaign: r.base for r in A.index_bases(counted, most=0.2).collect()} == {"one": 1, "zero": 0}


def test_classes_of_numbers(spark, world):
    held, order, d, o = world
    bases = spark.createDataFrame([("one", 1), ("zero", 0)], "campaign string, base int")
    rows = defaultdict(list)
    for c, _, techs, ids, n in held:
        for i in ids if techs else ():
            rows[c, i] += [set(techs)] * n
    want = {}
    for (c, i), who in rows.items():
        if c == "else" or len(who) < 8:
            continue
        for shift in (-2, -1, 0, 1, 2):
            j = i - {"one": 1, "zero": 0}[c] - shift
            if not 0 <= j < len(order) or not order[j][2]:
                want[c, shift, i] = "unjudged"
            elif "lost" in order[j][2]:
                want[c, shift, i] = "ungated"
            else:
                share = sum(set(order[j][2]) <= t for t in who) / len(who)
                want[c, shift, i] = "settled" if share >= 0.95 else "granted" if share >= 0.5 else "suspect"
    aligned = A.alignment(d, o, bases, spark.createDataFrame([(f"t{x}",) for x in range(8)], "tech string"))
    assert {(r.campaign, r["shift"], r.id): r["class"] for r in aligned.collect()} == want
    scored = {(r.campaign, r["shift"]): r for r in A.scores(aligned).collect()}
    assert scored["one", 0].settled > scored["one", 1].settled and sum(scored["one", 0][2:]) == len([k for k in want if k[:2] == ("one", 0)])


def test_names_and_numbers_past_the_end(spark, world):
    _, _, _, o = world
    ids = spark.createDataFrame([("one", "s1", "PAA", 1), ("one", "s1", "PAA", 41), ("one", "s1", "PBB", 0), ("one", "s2", "PBB", 40), ("none", "s3", "PAA", 1)], "campaign string, save_id string, tag string, id long")
    bases = spark.createDataFrame([("one", 1)], "campaign string, base int")
    assert sorted(map(tuple, A.decoded(ids, o, bases).collect())) == [("s1", "PAA", "inv0"), ("s2", "PBB", "inv39")]
    assert sorted(map(tuple, A.past_end(ids, o, bases).collect())) == [("one", "s1", 3, 2), ("one", "s2", 1, 0)]


def test_arrays_of_needs(spark):
    d = spark.createDataFrame
    o = A.ordered(d([(0, "a"), (1, "b")], "seq long, invention string"), d([("a", "y"), ("a", "x"), ("z", "q")], "invention string, tech string"), d([("b", "PAA")], "invention string, tag string"))
    assert sorted(map(tuple, o.collect())) == [(0, "a", ["x", "y"], []), (1, "b", [], ["PAA"])]
