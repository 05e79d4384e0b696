import pytest


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and blank texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(3000))
    data = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1, "x"),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1, "x"),
        (2, None, "en", "a", None, "x"),
        (3, "", None, None, 0, None),
        (4, " \n\t ", "en", "b", 4, "y"),
        (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 9, "x"),
        (5, long, "de", None, None, "x"),
        (6, long, "de", None, None, "x"),
        (7, "one", None, "b", 3, "x"),
        (7, "two words", None, "b", 3, "x"),
    ]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, rank string"
    ).selectExpr("*", "rank AS size", "rank AS hash", "rank AS bucket", "1 AS a", "2 AS b", "3 AS _id")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
