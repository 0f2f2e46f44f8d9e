"""Files of token ids: what is read back is what the tokenizer gives, in order."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from annalist.llm import token_files as T
from annalist.llm.tokens import ChunkTokenizer

from .helpers import no_docs, odd_docs, odd_rows, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text, end=1):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def in_order(rows):
    return sorted(rows, key=lambda r: (r.start, r.n_tokens))


def test_odd_rows_come_back(spark, tmp_path):
    at = f"file://{tmp_path}/a"
    manifest = T.write(odd_docs(spark).repartition(3), at, PATH)
    rows = in_order(T.read(spark, at, with_ids=True).collect())
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in rows]
    assert keys == sorted(keys) and manifest["documents"] == len(rows) == len(odd_rows())
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist() and manifest["tokens"] == sum(r.n_tokens for r in rows)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(i), ids_of(t)) for i, t, *_ in odd_rows())
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids) for r in rows)


def test_single_documents_are_found(spark, tmp_path):
    at = f"file://{tmp_path}/a"
    T.write(odd_docs(spark).repartition(4), at, PATH, end_id=7)
    for i in {r[0] for r in odd_rows() if r[0] is not None}:
        assert sorted(x.tolist() for x in T.find(at, i)) == sorted(ids_of(t, 7) for k, t, *_ in odd_rows() if k == i)
    assert T.find(at, 10**9) == [] and T.find(at, -1) == []


def test_empty_table_and_one_id_for_most_rows(spark, tmp_path):
    assert T.write(no_docs(spark), f"file://{tmp_path}/none", PATH)["files"] == []
    assert T.read(spark, f"file://{tmp_path}/none").collect() == []
    r = random.Random(5)
    docs = [(7 if r.random() < 0.7 else i, prose(i % 40, 30)) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manifest = T.write(spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}/hot", PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(manifest["files"]) > 1 and max(f["documents"] for f in manifest["files"]) < 0.7 * len(docs)  # the id is spread
    rows = in_order(T.read(spark, f"file://{tmp_path}/hot").collect())
    assert [x.doc_id for x in rows] == sorted(i for i, _ in docs) and sorted((x.doc_id, x.ids_crc32) for x in rows) == sorted((i, crc(ids_of(t))) for i, t in docs)


def test_files_tell_what_they_need(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 60) + " shared words of all documents") for i in range(300)], "doc_id long, text string")
    at = f"file://{tmp_path}/a"
    T.write(docs, at, PATH)
    with pytest.raises(ValueError, match="another dictionary"):
        T.TokenFile(f"{at}/{json.loads((tmp_path / 'a/manifest.json').read_text())['files'][0]['name']}", T.Coder(b""))
    with pytest.raises(ValueError, match="no file of token ids"):
        (tmp_path / "a/other").write_bytes(b"x" * 100)
        T.TokenFile(f"{at}/other", T.Coder(b""))
    plain = T.write(docs, f"file://{tmp_path}/b", PATH, dictionary=b"")
    shared = json.loads((tmp_path / "a/manifest.json").read_text())
    assert sum(f["bytes"] for f in shared["files"]) < sum(f["bytes"] for f in plain["files"])
    (tmp_path / "a/part-00000099-left").write_bytes(b"half")  # of an attempt that was lost
    T.write(docs, at, PATH)
    assert not (tmp_path / "a/part-00000099-left").exists() and T.read(spark, at).count() == 300


def test_query_gives_the_ids_of_whole_documents(spark):
    d = "/root/testdata/sf0.001"
    start, want = 0, []
    for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        ids = ids_of(r.text)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, T.op11_token_files(spark, d).collect())) == want


def test_chunks_end_in_marks_and_hold_letters_beyond_ascii():
    t = ChunkTokenizer(PATH)
    for mark in ("", ",", "!", "?", ";", ":", ")", "'s", "...", "-", ".)"):
        for x in (prose(60, 50).replace(" ", f"{mark} "), prose(61, 50).upper() + mark, f"Élan{mark} ĀB{mark} é{mark}ß{mark} e\u0301{mark} ª{mark}", mark):
            assert t.encode(x).tolist() == ids_of(x)[:-1]


def test_words_that_come_back_are_tokenised_once():
    letters = "abcdefghilmnoprstuvz"
    words, t, seen = ["".join((a, b, c, d, e)) for e in "xyw" for a in letters for b in letters for c in letters for d in letters], ChunkTokenizer(PATH), []
    word = t._word
    t._word = lambda w: seen.append(w) or word(w)
    for mark in (",", ";"):
        for i in range(0, len(words), 1000):
            t.encode(f"{mark} ".join(words[i : i + 1000]))
    assert len(words) == 480_000 and len(seen) == len(set(seen))
