import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, sources=None, extra=""):
        rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, SCHEMA)
        for c in extra.split():          # names that the operators use themselves
            from pyspark.sql import functions as F
            df = df.withColumn(c, F.lit("given"))
        return df
    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def edge_texts(prose):
    """Null, empty, blank, short, very long, repeated and odd texts."""
    base = prose(1, 120)
    return [None, "", " \t\n", "one", "two words", base, base, base.replace(" ", "  ", 3), base.upper(), prose(2, 40), prose(3, 20_000),
            "x" * 5000, "é́中文😀 ǅ \x1c   Σ ς", base + " tail that differs", "a\nb\n\nb\n" * 30, prose(2, 40) + ".\n" + prose(4, 60)]
