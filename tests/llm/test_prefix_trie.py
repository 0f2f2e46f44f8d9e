"""The trie of conversations against sets of prefixes in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from annalist.llm import prefix_trie as P

KIND = "conv_id long, turn long, role string, text string, key string, depth long, digest long"
COLS = [c.split()[0] for c in P.NODE.split(", ")]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def plainly(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in own.items()}
    new = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        new[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in new.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    out, leaves, saved = [], {}, {}
    for s in sorted(members, key=len, reverse=True):
        m = members[s]
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = sum(saved[x] for x in children[s]) + (len(m) - 1) * (len(s[-1][1].encode()) if s else 0)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], sha))
    return sorted(out, key=str)


def talks(seed, n, long=40):
    """Conversations of few different turns, which begin alike; some are long, some repeat, some are out of order."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 5 * n), n):
        for t in range(long if r.random() < 0.05 else r.randint(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant"][: 1 + t % 2]), r.choice("ab") * (1 + (r.random() < 0.1))))
    rows += [(c, 0, "user", "same") for c in (100_000, 100_005, 100_010)] + [(7, None, None, None), (7, None, "é", "ü"), (None, 1, "user", "lost"), (8, 3, "x", ""), (8, 3, "x", ""), (8, 3, "", "x")]
    r.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], KIND)


def got(df):
    return sorted(map(tuple, df.select(COLS).collect()), key=str)


@pytest.mark.parametrize("least", [1000, 4, 0])
def test_nodes_are_those_of_plain_prefixes(spark, least):
    rows = talks(1, 120)
    assert got(P.trie(P.rebuilt(table(spark, rows).repartition(5)), least=least, held=30)) == plainly(rows)


def test_one_beginning_for_most_and_bounded_heavy_nodes(spark):
    rows = [(5 * c, t, "system", f"turn {t}") for c in range(400) for t in range(9)] + [(5 * c, 9, "user", f"own {c % 30}") for c in range(0, 400, 2)]
    want = plainly(rows)
    talk = P.rebuilt(table(spark, rows))
    assert got(P.trie(talk, least=10)) == want and got(P.trie(talk, least=0, most=20)) == want
    assert len(P.heavy_nodes(P.paths(talk), 0, 20)) < 20


def test_long_conversations_and_empty_tables(spark):
    rows = [(c, t, "user", str(t % 50)) for c in (5, 10, 15) for t in range(3000)] + [(15, 3000, "user", "x")]
    assert got(P.trie(P.rebuilt(table(spark, rows)))) == plainly(rows)
    assert got(P.trie(P.rebuilt(table(spark, [])))) == [] and got(P.trie(P.rebuilt(table(spark, [(None, 1, "a", "b")])))) == []
    alone = [(3, 0, None, None)]  # its h is over one, its base is absent: it has no turns left
    assert got(P.trie(P.rebuilt(table(spark, alone)))) == plainly(alone) == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]


def test_level_order_trie():
    key = lambda *xs: np.array([[x, x] for x in xs], np.uint64).reshape(-1, 2)
    t, of = P.forest([key(1, 2), key(1, 3), key(4), key(1, 2, 5)])
    assert t.n == 6 and t.bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    assert t.parents().tolist() == [0, 0, 1, 1, 3] and t.children().tolist() == [2, 2, 0, 1, 0, 0]
    assert of.tolist() == [1, 3, 1, 4, 2, 1, 3, 5] and t.labels[:, 0].tolist() == [1, 4, 2, 3, 5]
    assert t.rolled(np.ones(6, np.int64)).tolist() == [6, 4, 1, 2, 1, 1]


def test_sql_gives_the_same(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = con.execute(f"select {', '.join(COLS)} from ({P.OP12_SQL})").fetchall()
    rows = [tuple(r) for r in con.execute("select * from conversations").fetchall()]
    assert got(P.op12_prefix_trie(spark, d)) == sorted(want, key=str) == plainly(rows)
