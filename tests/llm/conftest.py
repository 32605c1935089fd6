import pytest


@pytest.fixture(scope="session")
def tables(spark):
    """Builds ``documents``-like tables: ids and texts, odd columns beside them."""

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long", extra=True):
        full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, schema)
        if not extra:
            return df
        clashes = ("row", "digest", "key", "ids", "spans", "fp", "_text", "words", "copies", "n_words", "text.x")
        return df.selectExpr("*", *[f"'x' as `{c}`" for c in clashes])

    return build
