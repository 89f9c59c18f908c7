from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table from texts, with awkward extra columns if asked for."""

    def make(texts, sources=None, langs=None, ids=None, extra=False):
        n = len(texts)
        rows = [
            (i, t, lang, s, len(t) if t is not None else None)
            for i, t, lang, s in zip(ids or range(n), texts, langs or ["en"] * n, sources or ["src0"] * n, strict=True)
        ]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("score", "kept", "size", "spans", "node", "n", "aw_text", "label", "tie", "start", "length"):
                df = df.withColumn(c, F.lit(None).cast("string"))
        return df

    return make
