import pytest

LONG = " ".join(f"w{i % 700}" for i in range(6000))
TWENTY = " ".join(f"t{i}" for i in range(25))

#: Texts with nulls, empty and very long ones, ties, repeated rows and other spaces.
EDGE_TEXTS = [
    (1, "The cat sat on the mat. " * 8, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "de", None),
    (5, LONG, "en", "a"), (6, LONG + " tail", "en", "a"), (7, TWENTY, "fr", "b"), (8, "intro words " + TWENTY + " and an end", "fr", "b"),
    (9, "x y\x1cz café \U0001f600 <|endoftext|> end", "fr", "c"), (10, "De " * 200, "de", "a"), (10, "De " * 200, "de", "a"),
    (None, "no id here " * 9, "en", None), (None, None, None, None), (11, "the cat sat on the mat. " * 8, "en", "a"),
    (12, "Der Hund lief über die Straße und bellte sehr laut.", "de", "b"), (13, "12 34 !! 56", "en", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge texts with columns that clash with names inside the operators."""
    rows = [(*r, 0, "x", 1.5, "y", 2, "z") for r in EDGE_TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, id int, kept string, "
                                       "fp double, _key string, anchor int, host string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("1 = 0")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
