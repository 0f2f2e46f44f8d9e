"""What a nation of a snapshot holds, and the rate of mobilisation that rules give it."""

import pytest
from pyspark.sql import functions as F

from annalist.plans import mobilisation as M
from annalist.sources import saves as S

from .savebuilder import land, snapshot


def nation(tag, *more):
    return (tag, [("primary_culture", '"x"'), *more])


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("raised") / "east"
    d.mkdir()
    abe = nation("ABE", ("civilized", '"no"'), ("draft", "some"), ("nationalvalue", '"duty"'), ("technology", [("drill", ["1 0.000"]), ("maps", ["0 0.000"])]), ("active_inventions", ["7 8 40"]), ("modifier", [("modifier", '"zeal"'), ("date", '"1840.1.1"')]))
    (d / "a.v2").write_bytes(snapshot("1840.1.1", "ABE", "a", [land(31, "ABE"), abe, nation("CED", ("civilized", '"yes"'), ("draft", "none"))]))
    kept = S.one_per_date(S.read_files(spark, str(d))).persist()
    sequence = spark.createDataFrame([(0, "press"), (1, "rail")], "seq int, invention string")
    return M.holdings(S.tables(kept, S.read_leaves(kept).persist()), sequence, 7).persist()


def test_holdings(held):
    got = {(r.kind, r.name) for r in held.where("tag = 'ABE' and kind <> 'reform'").collect()}
    assert got == {("tech", "drill"), ("invention", "press"), ("invention", "rail"), ("national value", "duty"), ("event modifier", "zeal"), ("uncivilized", "unciv_nation")}
    assert held.where("tag = 'ABE' and name = 'draft = some'").count() == 1


def test_rates(spark, held):
    d = lambda rows, cols: spark.createDataFrame(rows, cols)
    rules = {"reform_sizes": d([("draft", "some", 0.05), ("draft", "all", 0.1)], "reform string, option string, value double"), "static_sizes": d([("unciv_nation", -0.01), ("war", 0.5)], "modifier string, value double")}
    more = d([("tech", "drill", 0.02), ("tech", "maps", 9.0), ("invention", "rail", 0.005), ("event modifier", "zeal", 0.01), ("national value", "duty", 0.0)], "kind string, name string, value double")
    added = M.contributions(held, M.sizes(rules, more))
    assert {(r.tag, r.kind): r.value for r in added.collect()} == {("ABE", "tech"): 0.02, ("ABE", "invention"): 0.005, ("ABE", "event modifier"): 0.01, ("ABE", "reform"): 0.05, ("ABE", "uncivilized"): -0.01}
    assert [(r.tag, round(r.rate, 12)) for r in M.rates(added, ["save_id", "tag"]).collect()] == [("ABE", 0.075)]
    less = M.rates(added.withColumn("value", -F.col("value")), ["tag"]).first()
    assert less.rate == 0.0
    impact = M.impacts(held, d([("zeal", 0.3), ("other", 1.0)], "modifier string, value double"), ["tag"]).collect()
    assert [(r.tag, r.impact) for r in impact] == [("ABE", 0.3)]
