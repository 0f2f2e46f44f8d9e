"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

N-grams of one to three characters are hashed to a fixed number of features. Document frequencies are counted over
every training document; the regression itself is fitted on a bounded sample (``per_lang`` documents of each language,
fewer where languages are so many that they would exceed ``most_rows``, chosen by a hash of the id, one at least) by
follow-the-regularised-leader with elastic-net penalties, and its temperature on a part of the sample that the fit has
not seen. Predictions read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import put_back, set_aside

FEATURES = 1 << 14


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None) -> np.ndarray | None:
    """How often each hashed feature occurs in a whole text; None if it has no letter.

    Characters are lower-cased; runs of anything but letters count as one space.
    """
    if not text:
        return None
    counts = np.zeros(FEATURES)
    found, last = False, np.array([32], np.uint64)
    for at in range(0, len(text), 1 << 20):  # in pieces, so that a very long text takes little memory
        c = np.frombuffer(text[at : at + (1 << 20)].lower().encode("utf-32-le", "replace"), "<u4")
        letter = _letters()[np.minimum(c, 0x10FFFF)]
        found = found or bool(letter.any())
        c = np.where(letter, c, 32).astype(np.uint64)
        c = np.concatenate([last, c])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        h = c * np.uint64(0x9E3779B97F4A7C15)
        for k in (h, h[1:] + (h[:-1] << np.uint64(7)) * np.uint64(3), h[2:] + (h[1:-1] << np.uint64(7)) * np.uint64(5) + (h[:-2] << np.uint64(13)) * np.uint64(7)):
            k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            counts += np.bincount((k >> np.uint64(50)).astype(np.int64), minlength=FEATURES)
        last = c[-2:]
    return counts if found else None


@dataclass
class Model:
    """langs in order, idf by feature, weights by feature and lang, bias by lang, temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its probability; ``und`` and 0 for a text without a letter, or if nothing was learned."""
        counts = grams(text)
        if counts is None or not self.langs:
            return "und", 0.0
        x = counts * self.idf
        p = _softmax((x / max(np.sqrt(x @ x), 1e-12) @ self.weights + self.bias) / self.temperature)
        return self.langs[int(p.argmax())], float(min(1.0, p.max()))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader (proximal) on rows of features, values and class."""
    z, n = np.zeros((FEATURES + 1, n_langs)), np.zeros((FEATURES + 1, n_langs))

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            more = g * g
            z[at] += g - (np.sqrt(n[at] + more) - np.sqrt(n[at])) / alpha * w
            n[at] += more
    w = weights(slice(None))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, g = np.log(0.25), np.log(10.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1000, most_rows: int = 4000, updates: int = 20_000, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 1e-3) -> Model:
    """Learns from the rows of labelled with a language and a text.

    Every language that has a text with a letter is learned, from one document at least: what the fit is not to see is
    left out of it only where the language has others. The driver gets the count of each language, a document frequency
    for each of 16,384 features, and all features of about ``most_rows`` sampled documents (one at least for each
    language), 98 KB each at most whatever the length of their texts. The sample is gone through four times, a small one
    more often, for about ``updates`` steps in all. An empty table gives a model that predicts ``und``.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    chance = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    letters = F.col("text").rlike(r"\p{L}")
    told = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.when(letters, chance)).alias("first")).collect()
    langs, first = {r["lang"]: r["n"] for r in told}, {r["lang"]: -1.0 if r["first"] is None else r["first"] for r in told}
    if not langs:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    names, per_lang = sorted(langs), max(1, min(per_lang, most_rows // len(langs)))
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for k in names for x in (k, values[k]))), F.col("lang"))
    picked = F.coalesce((chance < of({k: min(1.0, per_lang / n) for k, n in langs.items()})) | (chance == of(first)), F.lit(False))
    unseen = F.pmod(F.xxhash64("id", F.lit("unseen")), F.lit(5)) == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            got: list[tuple] = []
            for text, lang, pick, un in zip(*b.columns, strict=True):
                c = grams(text.as_py())
                if c is None:
                    continue
                at = np.flatnonzero(c)
                df[at] += 1
                n += 1
                if pick.as_py():
                    got.append((lang.as_py(), un.as_py(), at.astype("<u2").tobytes(), c[at].astype("<f4").tobytes(), -1, 0))
            if got:
                yield _batch(got)
        yield _batch([(None, None, None, None, int(i), int(df[i])) for i in np.flatnonzero(df)] + [(None, None, None, None, FEATURES, n)])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["lang", "unseen", "at", "count", "feature", "df"])

    seen = rows.select("text", "lang", picked.alias("picked"), unseen.alias("unseen")).mapInArrow(run, "lang string, unseen boolean, at binary, count binary, feature int, df long")
    # one pass: frequencies are summed by feature, and a sampled document is a group of its own
    got = seen.groupBy("feature", "lang", "unseen", "at", "count").agg(F.sum("df").alias("df"), F.count("*").alias("copies")).collect()
    df, sample = np.zeros(FEATURES + 1, np.int64), []
    for r in got:
        if r["feature"] >= 0:
            df[r["feature"]] = r["df"]
        else:
            sample += [r] * r["copies"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    fit, check = [], []
    for r in sorted(sample, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["count"]))):
        if r["lang"] in langs:
            at = np.frombuffer(r["at"], "<u2").astype(np.int64)
            x = np.frombuffer(r["count"], "<f4") * idf[at]
            row = (np.append(at, FEATURES), np.append(x / max(np.sqrt(x @ x), 1e-12), 1.0), names.index(r["lang"]))
            (check if r["unseen"] else fit).append(row)
    taught = {y for *_, y in fit}
    fit += [r for r in check if r[2] not in taught]  # a language's only documents
    check = [r for r in check if r[2] in taught]
    epochs = max(4, min(100, updates // max(1, len(fit))))
    w, bias = ftrl(fit, len(names), epochs, alpha, beta, l1, l2)
    t = _temperature(np.array([x[:-1] @ w[at[:-1]] + bias for at, x, _ in check]), np.array([y for *_, y in check])) if check else 1.0
    return Model(names, idf, w, bias, t)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score after its own columns (columns of those names are replaced).

    A null text or one without letters is ``und`` with score 0. Other columns are passed through as they are.
    """

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts):
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    out = docs.drop("lang_pred", "score").withColumn("_judged_", judge(F.col(text_col).alias("text")))
    return out.select("*", "_judged_.lang_pred", "_judged_.score").drop("_judged_")


def in_a_language(docs: DataFrame, least: float = 1.2, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those whose language is ``und`` or has a probability below ``least`` times that of a mere guess.

    Learns from all documents of docs but held-out ones. If no document has a language, none is rejected. Null, empty
    and letterless texts are ``und``; repeated rows are judged alike; an empty table stays empty; other columns pass.
    """
    model = train(docs.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, **how)
    if not model.langs:
        return docs
    own, names = set_aside(docs)
    judged = predict(own, model, names[text_col])
    return put_back(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= min(0.9, least / len(model.langs)))), names)


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text is divisible by 5; true for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
