"""Snapshots read block by block give the tables that the tokenizer gives, however they are laid out."""

import re

import pytest
from pyspark.sql import functions as F

from annalist.sources import blocks as B
from annalist.sources import saves as S

from .bigsave import big_snapshot
from .savebuilder import group, islands, land, realm, snapshot

WAR = ("previous_war", [("name", '"Old War"'), ("history", [("1830.1.1", [("add_attacker", '"ZAN"')]), ("battle", [("name", '"Ford"'), ("location", 11), ("result", "yes"), ("attacker", [("country", '"ZAN"'), ("hussar", 3000), ("losses", 200)]), ("defender", [("country", '"MIR"'), ("losses", 900)])])]), ("war_goal", [("casus_belli", "grab"), ("actor", '"ZAN"'), ("receiver", '"MIR"')])])
MORE = [("rebel_faction", [("type", "mob")]), WAR, realm("D01", "dusk"), realm("EMP", "dusk", ("army", []), ("technology", [])), ("region", ["1 2", '"a b"'])]


def scene(date):
    return islands(date).removesuffix(b"") + snapshot(date, "ZAN", "x", MORE).split(b"start_date", 1)[1].split(b"\r\n", 1)[1]


def on_one_line(text):
    """One top-level block after the other, each as a line of its own; the rest of the blanks go."""
    return re.sub(rb"\s+", b" ", text).replace(b" = ", b"=").replace(b"date=", b"\ndate=", 1)


LAYOUTS = {
    "as_written": lambda t: t, "line_feeds": lambda t: t.replace(b"\r\n", b"\n"), "one_line": on_one_line, "no_tabs": lambda t: t.replace(b"\t", b""), "spaces": lambda t: t.replace(b"\t", b"  "),
    "braces_behind": lambda t: t.replace(b"=\r\n\t{", b"={").replace(b"=\r\n\t\t{", b"= {"), "closed_behind": lambda t: re.sub(rb"\r\n\t+\}", b" }", t), "two_in_a_line": lambda t: t.replace(b"\r\n\t\tsize=", b" size="),
    "blank_lines": lambda t: t.replace(b"\r\n\t\tsize", b"\r\n\r\n   \r\n\t\tsize"), "comments": lambda t: t.replace(b"\r\n\t\tsize", b"\r\n\t\t# } size=1\r\n\t\tsize"), "surplus": lambda t: t.replace(b"\r\n12=", b"\r\n}\r\n12="),
    "surplus_inside": lambda t: t.replace(b"\t\tsize=8000", b"\t\t} size=8000", 1) + b"\r\n}", "unclosed": lambda t: t.replace(b"\r\n}\r\n12=", b"\r\n12=", 1), "unclosed_group": lambda t: t.replace(b"\t}\r\n\tsoldiers=", b"\tsoldiers=", 1),
    "quoted_braces": lambda t: t.replace(b'"Land 11"', b'"Land } 11 { ="').replace(b'"Land 12"', b'"{"'), "tabs_less": lambda t: t.replace(b"\t\tliteracy", b"\tliteracy"), "tabs_more": lambda t: t.replace(b"\t\tliteracy", b"\t\t\t\tliteracy"),
    "nested_in_groups": lambda t: t.replace(b"\t\tsize=", b"\t\tideology=\r\n\t\t{\r\n\t\t\t1=5.0\r\n\t\t\tsize=9\r\n\t\t}\r\n\t\tsize="), "nested_deeply": lambda t: t.replace(b"\t\tsize=", b"\t\ta=\r\n\t\t{\r\n\t\t\tb=\r\n\t\t\t{\r\n\t\t\t\tsize=1\r\n\t\t\t}\r\n\t\t}\r\n\t\tc=\r\n\t\t{\r\n\t\t}\r\n\t\tsize="),
    "repeated": lambda t: t.replace(b"\t\tsize=", b"\t\tsize=7\r\n\t\tsize=").replace(b'\tcore="ZAN"', b'\tcore="ZAN"\r\n\tcore="MIR"\r\n\tcore="ZAN"\r\n\towner="ZAN"'), "levels": lambda t: t.replace(b"\tnaval_base=\r\n\t{\r\n\t\tlevel=3", b"\tfort=\r\n\t{\r\n\t\t2.000 1.000\r\n\t}\r\n\tnaval_base=\r\n\t{\r\n\t\t6.0 6.0"),
    "no_end": lambda t: t.rstrip()[:-1].rstrip() + b" }", "after_the_end": lambda t: t + b'checksum="x"\r\nx={ y }', "odd_letters": lambda t: t.replace(b"zanite", "zanité\xa0".encode("latin-1")).replace(b"orlic", "orliç".encode("latin-1")),
    "empty_blocks": lambda t: t.replace(b"\t\tsize=2500\r\n", b"").replace(b"\r\n14=", b"\r\n99=\r\n{\r\n}\r\n14="),
}
ORDER = {"province": ["prov_ord"], "pop": ["prov_ord", "pop_ord"], "country": ["ord"], "country_list": ["ord"], "country_field": ["tag", "ord"], "state": ["state_block"], "unit": ["ord"], "market": ["ord"], "war": ["war_ord"], "moves": ["war_ord"], "goals": ["war_ord", "block"], "battles": ["war_ord", "battle"]}
NUMBERED = {"ord", "prov_ord", "pop_ord", "block", "state_block", "war_ord", "battle"}


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("layouts") / "north"
    d.mkdir()
    for i, (name, change) in enumerate(LAYOUTS.items()):
        (d / f"{name}.v2").write_bytes(change(scene(f"18{36 + i}.1.1")))
    (d / "big.v2").write_bytes(big_snapshot("1899.1.1", 60, 5, 12, 6))
    files = S.one_per_date(S.read_files(spark, str(d))).persist()
    rows = S.read_leaves(files).persist()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # so that files are split
    try:
        t = B.campaigns(spark, str(d))
        t["rows"].persist().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    leaves = t["rows"].where("kind = 'leaf'").drop("kind", "province", "pop", "part")
    return S.tables(files, rows) | S.war_parts(rows), t | S.war_parts(leaves)


def plain(df, name):
    """By file, the rows in the order of the file, without the numbers that tell it."""
    out: dict[str, list] = {}
    cols = sorted(c for c in df.columns if c not in NUMBERED)
    df = df.withColumn("cores", F.sort_array("cores")) if "cores" in df.columns else df
    df = df.withColumn("parties", F.sort_array("parties")) if "parties" in df.columns else df
    for r in sorted(df.collect(), key=lambda r: [r[c] for c in ORDER.get(name, [])]):
        out.setdefault(re.sub(r".*/", "", r["save_id"]), []).append(tuple(str(r[c]) for c in cols if c != "save_id"))
    return {k: v if name in ORDER and name != "moves" else sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("name", ["saves", "province", "pop", "country", "country_list", "country_field", "state", "unit", "market", "war", "great_nation", "moves", "goals", "battles"])
def test_tables_are_alike(both, name):
    tokens, blocks = (plain(t[name], name) for t in both)
    assert tokens.keys() == blocks.keys()
    for file in tokens:
        assert blocks[file] == tokens[file], file
    assert len(tokens) >= (len(LAYOUTS) - 3 if name not in ("moves", "goals", "battles") else 10)


def test_what_is_laid_out_as_written_needs_no_tokenizer(both):
    layout = {re.sub(r".*/|\.v2$", "", r.path): r.layout for r in both[1]["files"].collect()}
    assert {"as_written", "line_feeds", "big", "nested_in_groups", "levels", "tabs_less", "two_in_a_line", "odd_letters", "surplus"} <= {k for k, v in layout.items() if v}
    assert {"one_line", "no_tabs", "after_the_end"} <= {k for k, v in layout.items() if not v}


def test_records_of_a_whole_file_and_of_its_splits_are_alike():
    data = big_snapshot("1850.1.1", 30, 4, 8, 5)
    whole = B.Reader("x", 0)
    rows = [r for x in data.split(B.END) for r in whole.record(x)]
    assert whole.whole and len([k for k, _ in rows if k == "pop"]) == 120
    places = [r[1] for k, r in rows if k == "leaf"]
    assert places == sorted(set(places)) and whole.bytes == len(data) + 2


def test_files_that_cannot_be_read(spark, tmp_path):
    for name, data in {"zip": b"PK\x03\x04 date=", "cut": islands()[:900], "headless": b"1=\n{\n}\n", "late": b"x=1\n" * 2000 + b'date="1836.1.1"\n}', "good": islands(), "blank_end": islands() + b"\r\n \r\n"}.items():
        (tmp_path / f"{name}.v2").write_bytes(data)
    found = {re.sub(r".*/|\.v2$", "", r.path): r.reason for r in B.file_states(B.read_blocks(spark, str(tmp_path))).collect()}
    assert found == {"zip": "packed", "cut": "cut off", "headless": "no date", "late": "no date", "good": None, "blank_end": None}
    assert found == {re.sub(r".*/|\.v2$", "", r.path): r.reason for r in S.read_files(spark, str(tmp_path)).collect()}


def test_groups_without_a_known_culture_or_size_are_none():
    out = list(B.Reader("x", 0).record(snapshot("1836.1.1", "A", "f", [land(3, "ZAN", group("farmers", 1, 5, "zan"), ("farmers", [("id", 2), ("size", 5)]), ("farmers", [("id", 3), ("dusk", "x")]))]).split(B.END)[1]))
    assert [k for k, _ in out if k != "leaf"] == ["province", "pop"]
