import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.default.parallelism", "4").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Texts that any operator on documents has to bear; doc_ids may be null or repeated.
HARD = [
    (1, "The quick brown fox jumps over the lazy dog.\nAnother line follows here.", "a"), (2, "", "a"), (3, None, None), (4, " \t\n\x0b\x0c\r ", "b"),
    (5, "x" * 5000, "b"), (6, "word " * 3000, None), (7, "same text here for both", "a"), (8, "same text here for both", "a"), (8, "same text here for both", "a"),
    (None, "no id on this one", "c"), (None, None, None), (9, "äöü ß € 漢字 😀\x1c\x85 end", ""), (10, "one", "z"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """HARD with extra columns that clash with names used inside."""
    rows = [(i, t, s, "en", None if t is None else len(t), 1, "k", 0.5, "x") for i, t, s in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size int, kept string, score double, `_lw_text` string")


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
