from __future__ import annotations

import pytest

from tarn.llm.shared import ship_package

DOCS = "doc_id long, text string, mark string, value long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, ids in order, with columns that clash with inner names."""
    ship_package(spark)

    def build(texts, first=0):
        rows = [(first + i, text, "x", 7) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return build


def words(n, stem="w"):
    return " ".join(f"{stem}{i}" for i in range(n))


PASSAGE = words(60, "shared")
TEXTS = [
    "",
    None,
    " \t\n",
    "one",
    "one two",
    words(100),
    words(100),
    words(100) + " extra",
    "Head " + PASSAGE + " tail",
    PASSAGE,
    words(30, "a") + " " + PASSAGE + " " + words(30, "b"),
    "the the the " * 40,
    "é" * 120 + " " + PASSAGE,
    words(40, "long") * 200,
    words(100).upper(),
]
