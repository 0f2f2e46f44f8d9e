"""Small tables with what operators must bear: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, key long, id long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 8))) for _ in range(words))


def odd_rows() -> list[tuple]:
    long = prose(9, 6000)
    rows = [
        (1, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "b"), (2, prose(1, 120), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "fr", ""),
        (6, "One two", "en", "a"), (7, "ONE TWO", "en", "a"), (8, "déjà vu — ça va?", "fr", "b"), (9, long, "en", "c"), (None, prose(3, 80), "de", "c"), (None, None, None, None),
        (10, prose(4, 60) + " " + prose(1, 120), "en", "a"), (11, prose(4, 60) + " " + prose(5, 70), "de", None), (12, "0", "en", "a"), (13, long.replace(" ", "  ", 1), "en", "c"),
    ]
    return [(*r, len(r[1] or ""), 7, 8, 9, 10) for r in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
