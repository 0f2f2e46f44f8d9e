"""SimHash near-dedup and substring dedup against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from annalist.llm import simhash as H
from annalist.llm import substring as B
from annalist.llm.components import components

from .helpers import no_docs, odd_docs, odd_rows, prose


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: dict) -> dict:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in fps}


def test_fingerprints_of_odd_texts():
    for text in [r[1] for r in odd_rows()] + ["A b\x0bC\x0cd", "x" * 100, "a " * 5000]:
        assert H.fingerprint((text or "").encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    chance = random.Random(radius)
    ms = H.masks(radius, list(range(64)))
    for _ in range(3000):
        diff = sum(1 << b for b in chance.sample(range(64), radius))
        assert any(not diff & m for m in ms)


def test_near_duplicates_against_brute_force(spark):
    chance, base = random.Random(0), prose(50, 900).split()
    texts = [prose(100 + i, 40) for i in range(12)]
    for i in range(90):  # a group of near copies, larger than a bucket that is searched as it is
        words = list(base)
        words[chance.randrange(900)] = f"w{i}"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[0]), (201, ""), (202, None)]
    got = {r.doc_id: r for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def test_links_in_large_buckets_lose_no_component(spark):
    chance = random.Random(4)
    start = chance.getrandbits(64)
    fps = {start}
    while len(fps) < 400:
        x = chance.choice(sorted(fps))
        fps.add(x ^ (1 << chance.randrange(64)) ^ (1 << chance.randrange(64)))
    fps |= {chance.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(H._signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in components(H.fingerprint_links(df, few=16)).collect()}
    want = brute_components({x: x for x in fps})
    groups = defaultdict(set)
    for x, r in want.items():
        groups[r].add(H._signed(x))
    for g in groups.values():
        assert len({roots.get(x, x) for x in g}) == 1
    assert len(set(roots.values())) == sum(len(g) > 1 for g in groups.values())


def test_components_of_a_path_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[100 + i] for i in range(60)}) == 1 and got[500] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark):
    got = H.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].component_id == by[2].component_id == 1 and by[3].component_id == by[4].component_id == by[5].component_id == 3 and by[6].fingerprint == by[7].fingerprint
    assert H.near_duplicates(no_docs(spark)).count() == 0
    left = H.without_near_duplicates(odd_docs(spark))
    assert left.columns == odd_docs(spark).columns and sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 3, 6, 8, 9, 10, 11, 12] and left.count() == 9


def test_compact_windows_hold_each_run_once():
    chance = np.random.default_rng(3)
    for n, width in [(5, 6), (6, 6), (60, 6), (200, 20)]:
        v = chance.integers(0, 40, n).astype(np.uint64)
        at, left, right = B.compact_windows(v, width)
        for s in range(n - width + 1):
            for e in (s + width, min(n, s + width + 7)):
                least = s + int(v[s:e].argmin())
                holding = [a for a, lo, hi in zip(at, left, right, strict=True) if a - lo <= s and e - 1 <= a + hi and s <= a < e]
                assert least in holding and all(v[a] == v[least] for a in holding)


def test_repeated_passages(spark):
    passage, other = prose(7, 55), prose(8, 51)
    edited = passage.split()
    edited[30] = "changed"
    rows = [(i, f"{prose(20 + i, 40 + i)} {passage} {prose(60 + i, 30)}") for i in range(6)]
    rows += [(10, f"{prose(90, 20)} {' '.join(edited * 1)} {prose(91, 9)}"), (11, prose(92, 200)), (12, prose(93, 70)), (13, f"{other} {prose(94, 8)}"), (14, f"{prose(95, 80)} {other.upper()}"), (15, rows[0][1])]
    rows += [(20 + i, f"{prose(7, 30)} {prose(200 + i, 90)}") for i in range(5)]  # thirty words are no passage
    got = B.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), hashes=6).collect()
    words = {i: t.lower().split() for i, t in rows}
    spans = defaultdict(set)
    for r in got:
        spans[r.doc_id] |= set(range(r.start, r.start + r.words))
        assert r.similarity >= 0.8 and (not r.kept or r.doc_id == r.first_doc_id)
    for i in range(6):
        assert set(range(40 + i, 95 + i)) <= spans[i]
    assert set(range(51)) <= spans[13] and set(range(80, 131)) <= spans[14] and set(spans) <= {*range(6), 10, 13, 14, 15} and 10 in spans
    assert spans[15] == set(range(len(words[15])))
    assert sum(1 for r in got if r.doc_id == 15 and r.words == len(words[15]) and not r.kept) == 1


def test_passages_that_differ_from_the_least_text_are_found_too(spark):
    shared = prose(300, 30)
    rows = [(i, f"{prose(310 + i, 40)} {shared} {prose(400 + i // 2, 60)} {prose(330 + i, 20)}") for i in range(20)]
    got = defaultdict(set)
    for r in B.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.start, r.start + r.words))
    for i in range(20):  # each two share ninety words
        assert len(got[i] & set(range(40, 130))) >= 80, i


def test_without_repeats_and_odd_documents(spark):
    d = odd_docs(spark)
    left = {(r.doc_id, r.source): r.text for r in B.without_repeats(d).collect()}
    assert B.without_repeats(d).columns == d.columns
    assert left[(3, "a")] is None and left[(4, None)] == "" and left[(6, "a")] == "One two" and left[(8, "b")] == "déjà vu — ça va?"
    kept = " ".join(t for t in left.values() if t)
    for part in (prose(1, 120), prose(4, 60), prose(5, 70), prose(3, 80)):
        assert " ".join(kept.split()).count(part) == 1
    assert B.repeated_passages(no_docs(spark)).count() == 0
