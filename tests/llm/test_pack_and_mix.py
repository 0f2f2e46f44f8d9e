"""Packing and mixing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annalist.llm import mixing as M
from annalist.llm import packing as P
from annalist.llm.tokens import ChunkTokenizer

from .helpers import no_docs, odd_docs, odd_rows, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_chunks_give_the_ids_of_whole_texts(text):
    assert CHUNKS.encode(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


CHUNKS, WHOLE = ChunkTokenizer(PATH, most=50), Tokenizer.from_file(PATH)


def test_odd_texts_have_their_ids():
    for text in ["don't WON'T's İstanbul ΣΑΣ ½ Ⅷ é a\x1cb\x85c \xa0x <|endoftext|>y 日本語 ²³ _f_ 'S", prose(1, 400_000)]:
        assert CHUNKS.encode(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids
    assert CHUNKS.encode(None).tolist() == []


def check_pieces(rows, docs):
    """Each id in one piece, sequences without gaps, full or as long as a power of two."""
    want = defaultdict(int)
    for i, text in docs:
        want[i, zlib.crc32(np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    assert sum(r.length for r in rows) == sum(len(WHOLE.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    for i, pieces in by_doc.items():
        if sum(k == i for k, _ in docs) == 1:
            pieces.sort(key=lambda r: r.start)
            assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
            assert want[i, zlib.crc32(b"".join(r.ids for r in pieces))] == 1 and pieces[0].doc_tokens == sum(r.length for r in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))] and n <= 4096 and n & (n - 1) == 0


def test_pack(spark):
    docs = [(i, prose(i, 20 + 37 * (i % 90))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    check_pieces(P.pack(df, PATH, with_ids=True).collect(), docs)


def test_pack_odd_documents(spark):
    check_pieces(P.pack(odd_docs(spark), PATH, with_ids=True).collect(), [r[:2] for r in odd_rows()])
    assert P.pack(no_docs(spark), PATH).count() == 0


def test_least_squares():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.allclose(P.nnls(a, np.array([4.0, 2.0])) @ a.T, [4, 2], atol=1e-6)
    assert (P.nnls(a, np.array([-1.0, 3.0])) >= 0).all()
    ways = P.combinations(8, 3)
    assert {tuple(w) for w in ways} == {tuple(np.bincount(c, minlength=8)) for c in [(1, 7), (2, 6), (3, 5), (4, 4), (1, 1, 6), (1, 2, 5), (1, 3, 4), (2, 2, 4), (2, 3, 3)]}


def test_plan_uses_no_head_twice():
    h = np.random.default_rng(2).integers(0, 50, 64)
    h[0] = 0
    plan, used = P.Plan(h, 3, 100, 64, 4), defaultdict(list)
    for u in range(1, 64):
        for rank in range(h[u]):
            to = plan.head(u, rank)
            if isinstance(to, tuple):
                used[to[0]].append((to[1], u))
            else:
                used["rest"].append((to // 64, u))
    for k, v in used.items():
        v.sort()
        assert all(a + u == b for (a, u), (b, _) in zip(v, v[1:], strict=False)) and v[0][0] == 0 and (k == "rest" or sum(u for _, u in v) == 64)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 577, 5000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


def brute_targets(sizes: list[int]) -> list[float]:
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        level = left / sum(w[i] for i in free) if free else 0
        over = {i for i in free if w[i] * level > 2 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in capped else w[i] * level for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("sizes", [[10], [100, 100, 100], [1, 1000, 1000, 5], [0, 0, 7], [0], [5000, 3, 80, 900, 40, 7, 1]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in M.source_targets(df).orderBy("ordinal").collect()]
    assert np.allclose(got, brute_targets(sizes))


def test_mix(spark):
    rows = [(i, prose(i, 30 + i * 7 % 400), f"s{i % 5}" if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix_documents(df, block=32).collect()
    assert len(got) == 400 and all(0 <= r.taken <= 2 * r.size and r.size == len(rows[r.doc_id][1].split()) for r in got)
    by = defaultdict(list)
    for r in got:
        by[rows[r.doc_id][2]].append(r)
    for k, v in by.items():
        assert {r.source_size for r in v} == {sum(r.size for r in v)} and abs(sum(r.taken for r in v) - v[0].target) <= 64, k
    assert sorted(got) == sorted(M.mix_documents(df.repartition(7), block=32).collect())
    texts = M.mixed_texts(df, block=32)
    assert texts.columns == df.columns
    taken = defaultdict(int)
    for r in texts.collect():
        taken[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(rows[r.doc_id][1].split())
    assert {k: v for k, v in taken.items() if v} == {r.doc_id: r.taken for r in got if r.taken}


def test_mix_odd_documents(spark):
    got = M.mix_documents(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows()) and sum(r.size == 0 and r.taken == 0 for r in got) == 4
    assert M.mix_documents(no_docs(spark)).count() == 0 and M.mixed_texts(no_docs(spark)).count() == 0
    assert {r.doc_id for r in M.mixed_texts(odd_docs(spark)).collect()} <= {r[0] for r in odd_rows()}
