"""The pipeline's stages in turn, and run() against them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annalist.llm import langid as L

from .helpers import no_docs, odd_docs, prose


def test_run_gives_what_its_stages_give_in_turn(spark, tmp_path):
    langs = {"en": "the and of to in", "fr": "le la des et une"}
    rows = [(i, f"{langs[k]} {prose(i % 30, 60)} {langs[k]}", k, "ab"[i % 2], 0) for i in range(60) for k in ["en" if i % 3 else "fr"]] + [(100, None, "en", "a", 0), (101, "12 34", None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{name}")
        assert after.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
        now = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(now.count())
    assert counts[0] == 60 and counts[1] == 30 and counts[2] == 30
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("length", "sequence_id").collect())) == sorted(map(tuple, now.select("length", "sequence_id").collect()))


CLASHES = ["fp", "key", "text_key", "doc_id_", "_id_", "_key_", "_cuts_", "_stay_", "_stay_text_", "_text_", "_took_", "_runs_", "_judged_", "_html_", "lang_pred", "score", "component_id", "start", "size", "index", "own 0", "a.b", "source_size"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_bear_columns_of_any_name_and_empty_tables(spark, tmp_path, stage):
    name, f = stage
    d = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is null or doc_id < 9 or doc_id > 9")
    d = d.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))
    out = f(spark, d, str(tmp_path))
    rows = out.collect()
    assert rows and f(spark, d.limit(0), str(tmp_path)).count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == d.columns and all(r[c] == i for r in rows for i, c in enumerate(CLASHES))


def test_language_stage_bears_odd_documents(spark):
    d = odd_docs(spark)
    kept = L.in_a_language(d)
    assert kept.columns == d.columns and None not in [r.text for r in kept.collect()]
    assert L.in_a_language(no_docs(spark)).count() == 0


def test_every_language_is_learned(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join([alphabet[k % 26] * 3 + alphabet[k // 26] * 2] * 20), f"l{k}") for i, k in enumerate(list(range(260)) * 3)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=600)
    assert len(model.langs) == 260
