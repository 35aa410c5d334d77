import pytest

#: Rows that every operator must take: nulls, empty and long texts, repeated rows, ties, clashing names.
LONG = " ".join(f"word{i % 977}" for i in range(60_000)) + "."


def awkward_rows():
    plain = "The quick brown fox jumps over the lazy dog. It does so every day, rain or shine, without fail."
    rows = [
        (1, plain, "en", "a", 1), (2, plain, "en", "a", 1), (3, plain + " Again.", "en", "b", 2), (4, None, "en", None, None), (5, "", None, "a", 0),
        (6, "   \n\t ", "en", "b", 3), (7, LONG, "en", "a", len(LONG)), (8, "ünïcödé wörds ärè fine ß 漢字 漢字", "de", "c", 5), (9, "one", "en", "c", 3),
        (None, "a row without an id", "en", "a", 4), (None, None, None, None, None), (10, plain, "en", "a", 1), (10, plain, "en", "a", 1), (11, "x\u0000y nul", "en", "c", 3),
        (12, "Licensed under the Apache License, Version 2.0. You idiot.", "en", "b", 9),
    ]
    return [(*r, "kept", 1.5, "same") for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, position double, shard string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int((i or 1) % 2 == 0), int(i == 12), "x") for i in (1, 2, 3, 5, 7, 8, 9, 12, None)], "doc_id long, quality int, toxic int, text string")
