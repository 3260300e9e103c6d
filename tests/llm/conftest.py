import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text) or (id, text, lang)."""

    def make(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None, *[f"x{c}" for c in extra]) for r in rows]
        return spark.createDataFrame(full, DOCS + "".join(f", {c} string" for c in extra))

    return make


@pytest.fixture(scope="session")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


#: Nulls, empty and odd texts that every operator must take.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "12 34 !!"),
    (5, "word"),
    (6, "a b c d"),
    (7, "a b c d"),
    (8, "long " * 30_000),
    (9, "x" * 60_000),
    (10, "日本語のテキスト。とても短い。"),
    (11, "One sentence. Another one! A third? And a fourth here."),
    (None, "no id at all"),
]
