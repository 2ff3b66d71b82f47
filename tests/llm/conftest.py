import pytest

#: Texts with which every operator has to cope: words of all sorts, empty, null, very long, ties, copies.
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(60_000))
BASE = "The quick brown fox jumps over the lazy dog while seven wizards quietly box in the cold river near old towns of the north every day"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, repeated rows, and further columns whose names operators might use themselves."""
    rows = [
        (1, BASE, "en", "src1", len(BASE)),
        (2, BASE, "en", "src1", len(BASE)),
        (3, BASE.replace("seven", "nine"), None, "src2", 10),
        (4, "", "en", None, 0),
        (5, None, "de", "src1", None),
        (6, LONG, "en", "src1", len(LONG)),
        (7, "été çà «quotes» “curly” 日本語 ½ x² don't we'll THE'S   \n\n end ", "fr", "src3", None),
        (8, "one", "en", "src1", 3),
        (8, "one", "en", "src1", 3),
        (None, "no id here at all", "en", "src1", 17),
        (9, "a b", None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(("id", "n", "y", "a", "b", "rep", "size", "grp", "part", "component", "slot", "rank", "node", "features", "count")):
        df = df.selectExpr("*", f"{i} as `{c}`")
    return df.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
