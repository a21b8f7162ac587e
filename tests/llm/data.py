"""Small frames with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, texts, first: int = 0):
    rows = [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark, seed: int = 1):
    """Documents with a null id, a repeated row, null, empty, blank, unlettered and very long texts."""
    rng = random.Random(seed)
    base = " ".join(words(rng, 120))
    texts = [base, base, None, "", "  \n ", "123 456 !!", "one", "ÀÉ Straße 中文", " ".join(words(rng, 30000)), "x" * 50000, base.upper()]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
