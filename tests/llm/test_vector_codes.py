"""Vector codes against whole-number arithmetic in plain Python."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalist.llm import vector_codes as V

KIND = "vec_id long, embedding array<double>, label string, code string, error long, kept long"


def plainly(rows, parts=8, entries=16, rounds=6):
    """vec_id, code, error, label_error, sha of (vec_id, vector, label) rows of one length."""
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in rows]
    dim = len(whole[0])
    at = [(p * (dim // parts), (p + 1) * (dim // parts)) for p in range(parts)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0], rows[k][1]))
    books = [[whole[k][a:b] for k in order[:entries]] for a, b in at]

    def near(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(at):
            of = [near(v[a:b], books[p])[1] for v in whole]
            for j in range(len(books[p])):
                mine = [v[a:b] for v, k in zip(whole, of, strict=True) if k == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[near(v[a:b], books[p]) for p, (a, b) in enumerate(at)] for v in whole]
    errors = [min(sum(d for d, _ in f), 2**63 - 1) for f in found]
    total = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in f), e, min(total[r[2]], 2**63 - 1), sha) for r, f, e in zip(rows, found, errors, strict=True)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KIND)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(seed, n, dim=16, steps=3):
    r = random.Random(seed)
    return [(i, [r.randint(-steps, steps) / 4096 * r.choice([1, 1, 700]) for _ in range(dim)], r.choice(["a", "b", None])) for i in range(n)]


def test_codes_are_those_of_plain_arithmetic(spark):
    rows = vectors(1, 150) + [(3, None, "a"), (900, [1.0] * 15 + [None], "a"), (901, [math.nan] * 16, "b"), (902, [math.inf] + [0.0] * 15, "b"), (None, [0.5] * 16, None), (5, [0.25] * 16, "a"), (5, [0.25] * 16, "a")]
    assert got(V.compressed(table(spark, rows).repartition(5))) == plainly(rows)
    few = rows[:5]
    assert got(V.compressed(table(spark, few))) == plainly(few)


def test_numbers_beyond_float32_and_int64(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([1, -1]) * r.choice([1.0, 1e6, 3e9, 1e14]) * r.random() for _ in range(8)], "a") for i in range(40)]
    assert got(V.compressed(table(spark, rows))) == plainly(rows)
    assert got(V.compressed(table(spark, [(1, [1e300] * 8, "a"), (2, [-1e300] * 8, "a")])))[0][2] == 0  # each is an entry


def test_other_lengths_and_empty_tables(spark):
    rows = vectors(2, 30)
    label_of = {i: label for i, _, label in rows}
    plain = plainly(rows)
    total = {label_of[r[0]]: r[3] for r in plain}
    more = [(500, None, None, total["a"], plain[0][4]), (501, None, None, total["b"], plain[0][4])]
    assert got(V.compressed(table(spark, [*rows, (500, [1.0, 2.0], "a"), (501, [], "b")]))) == sorted(plain + more, key=str)
    assert got(V.compressed(table(spark, [(500, [1.0, 2.0, 3.0], "a")]))) == [(500, "00" * 8, 0, 0, hashlib.sha256(b"4096,8192,12288").hexdigest())]
    assert got(V.compressed(table(spark, []))) == [] and got(V.compressed(table(spark, [(1, None, "a"), (2, [math.nan], None)]))) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.integers(1, 40), st.sampled_from([1, 3, 5000, 1 << 20, 1 << 27]), st.integers(0, 10**6))
def test_no_nearest_entry_is_screened_out(width, entries, most, seed):
    r = np.random.default_rng(seed)
    book = r.integers(-most, most + 1, (entries, width))
    x = np.concatenate([r.integers(-most, most + 1, (20, width)), book + r.integers(-1, 2, book.shape)])  # some lie close to several
    d = ((x[:, None].astype(object) - book.astype(object)) ** 2).sum(axis=2)
    best, error = V.nearest(x, book)
    assert best.tolist() == [min(range(entries), key=row.__getitem__) for row in d] and error.tolist() == [min(row) for row in d]


def test_what_a_code_stands_for(spark):
    rows = table(spark, vectors(3, 16))
    books = V.train(rows, "embedding", "vec_id")
    one = V.encode(rows, "embedding", books, ["vec_id", "embedding"]).where("error = 0").first()
    assert one and max(abs(a - b) for a, b in zip(V.decoded(one.code, books), one.embedding, strict=True)) <= 0.5 / 4096


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql_gives_the_same(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = sorted(con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({V.OP13_SQL})").fetchall(), key=str)
    assert got(V.op13_vector_codes(spark, d)) == want and len(want) == 500
