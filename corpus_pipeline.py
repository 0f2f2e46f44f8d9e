"""The corpus pipeline: raw documents to packed sequences of token ids, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalist.llm.common import forget, scratch
from annalist.llm.langid import in_a_language
from annalist.llm.mixing import mixed_texts
from annalist.llm.packing import pack
from annalist.llm.simhash import without_near_duplicates
from annalist.llm.substring import without_repeats


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that the labelled ones teach.

    Null, empty and letterless texts go; where no document has a language all stay. Long texts are read whole, repeated
    rows are judged alike, an empty table stays empty, columns may have any names.
    """
    return in_a_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest id.

    Null, empty and wordless texts are one group; of repeated rows one stays; null ids stay only where no other of their
    group has an id. Long texts are read whole, an empty table stays empty, columns may have any names.
    """
    return without_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that repeat another document's; a document of which nothing is left goes.

    Null, empty and short texts stay as they are, as do repeated rows of the document that stands for its text. Long texts
    are read whole, an empty table stays empty, columns may have any names.
    """
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes blocks of each source's words to its target; a document comes out once for each time that any of it is taken.

    Documents without a word are no part of a mix; null sources are one, the last; equal rows are taken as often as all
    of them together. Long texts are spread over blocks, an empty table stays empty, columns may have any names.
    """
    return mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into sequences; returns pieces, not documents.

    A null or empty text is its end id; a text longer than a sequence is cut; repeated rows are packed each for itself; an
    empty table gives no rows; other columns are not read.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: The stages are trained, hashed and drawn: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents in turn; each but the last is written out, so that none is computed again.

    A stage's table goes once the next one's is written; the last goes when the session ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
