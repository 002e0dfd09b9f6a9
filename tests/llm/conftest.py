import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, white and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + ".\nA line that several documents share\nend"
    copy = prose(40)
    rows = [
        (5, copy, "en", "s0", 1), (6, copy, "en", "s0", 1), (6, copy, "en", "s0", 1), (7, copy + " more", None, None, None),
        (8, None, "en", "s1", None), (9, "", None, "s1", 0), (10, " \t\r\n ", "fr", "s1", 3), (11, "1234 !!", None, "s0", 7),
        (12, "word", "de", None, 4), (13, "Ünï ’s 😀 it's x", "es", "s2", 9), (14, prose(60_000), "en", "s0", None),
        (None, "no id but a text that is long enough", "en", "s0", None), (None, None, None, None, None),
        (16, "A line that several documents share\nA LINE THAT SEVERAL DOCUMENTS SHARE  \nshort", "en", "s3", None),
    ]
    return rows + [(100 + i, prose(30), rng.choice(["en", "fr"]), f"s{i % 3}", 10) for i in range(40)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with extra columns whose names operators use for their own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.withColumns({"fingerprint": F.lit("x"), "score": F.lit("y"), "fp": F.lit(1), "tokens": F.lit(None).cast("int"), "key": F.lit("k"), "part": F.lit(2), "owner": F.lit(3), "shard": F.lit(1), **{x: F.lit(0) for x in ("qn_doc", "qn_body", "qn_gone", "qn_kept", "qn_lines", "qn_dropped", "kept_doc_id", "component_id", "place", "n", "root", "a", "b", "edge", "share", "known")}})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
