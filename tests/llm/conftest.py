from __future__ import annotations

import pytest

TEXTS = [
    "The cat sat on the mat. The cat sat on the mat.", "", None, "   \n\t ", "word",
    "Ein Größenmaß für Öl – naïve café; ½ ﬁ 中文 🙂\nzweite Zeile\nzweite Zeile",
    "a b c a b c a b c\n\na b c", "don't 'STOP' <|endoftext|> now  two  spaces ", "x" * 5000,
    " ".join(f"tok{i % 97} and {i}" for i in range(1500)),
]


@pytest.fixture
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), 7, 1.0, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[1], (3, "another text with id three", None, None, None, 1, 2.0, "y"),
             (None, "no id at all", "en", "s", 12, 1, 2.0, "z")]
    names = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, fp string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture
def none(docs):
    return docs.where("false")
