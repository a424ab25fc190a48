import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use for themselves.
CLASHING = ("row", "uid", "spans", "line_classes", "h", "h1", "key", "fp", "node", "__t", "__w", "__keep", "__lang", "component", "kept", "stratum", "u", "d")


@pytest.fixture(scope="session")
def table(spark):
    """docs from texts or (doc_id, text) pairs; extra: with columns of clashing names."""

    def make(rows, extra=False):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        df = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})
        return df

    return make


@pytest.fixture
def words():
    """Prose of n words out of an invented vocabulary."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))
