import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        """documents with nulls, and with columns whose names clash with inner ones."""
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for c in ("id", "tx", "keep_id", "__id", "n", "hash", "tokens", "label", "kept"):
                d = d.selectExpr("*", f"'x' AS `{c}`")
        return d

    return make
