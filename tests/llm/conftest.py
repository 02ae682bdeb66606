from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes tables into a folder and gives its path."""

    def write(**frames):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(str(folder / f"{name}.parquet"))
        return str(folder)

    return write


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        """rows: (doc_id, text)."""
        return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)

    return make
