from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"
#: Names the operators use inside; an input may have columns of the same names.
CLASHING = ["n", "fp", "block", "content", "digest", "at", "copy", "known", "owner", "_language", "component"]
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It runs away, far away.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "   \n\t ", "de", "b"),
    (5, "word " * 40_000, "en", "a"),
    (6, "x" * 200_000, None, "b"),
    (7, "The quick brown fox  jumps over the lazy dog. It runs away, far away.", "en", "a"),
    (7, "The quick brown fox  jumps over the lazy dog. It runs away, far away.", "en", "a"),
    (8, "Ünïcödé 漢字 😀 é ▁ <|endoftext|> </s> don't", "fr", "c"),
    (None, "no id here at all", "es", None),
    (9, "one", "en", "c"),
    (9, "two words", "en", "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    extra = ", ".join(f"`{name}` string" for name in CLASHING)
    rows = [(*row, len(row[1] or ""), *["z"] * len(CLASHING)) for row in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return {name: spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "pages", "benchmark")}
