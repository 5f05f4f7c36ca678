from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts, or from (doc_id, text, lang)."""

    def build(rows, partitions=3):
        rows = [(i, r, "en") if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(partitions)

    return build


LONG = "".join(f"w{i % 977} " for i in range(40_000))
#: Nulls, empty and blank texts, repeated rows, one id for two texts, a very long text and a very long word.
ODD = [
    (0, None, "en"),
    (1, "", "en"),
    (2, " \n\t ", None),
    (3, "one", "en"),
    (4, "the same row", "de"),
    (4, "the same row", "de"),
    (5, "one id two texts a b c d", "en"),
    (5, "one id two texts e f g h", "en"),
    (None, "no id at all but some words here", None),
    (None, None, None),
    (6, LONG, "en"),
    (7, "x" * 300_000, "en"),
    (8, "naïve Ärger ñandú 漢字 😀 text", "fr"),
]
