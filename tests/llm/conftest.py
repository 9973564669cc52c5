import pytest
from pyspark.sql import functions as F

LONG = "A long text with many words, none of which is new. " * 20_000
TRICKY = [
    (1, "plain words in a row, said once and then not again"), (2, ""), (3, None), (None, "no id here at all"),
    (4, " \t\n\x0b\x0c\r "), (5, LONG), (6, "x" * 50_000), (7, "same text"), (8, "same text"), (7, "same text"),
    (9, "ünïcode ßtraße 漢字 テキスト 🙂🙂 ́ é İ Σας"), (10, "<|endoftext|> </s> [INST] <|startoftext|>"),
    (11, "\x00 nul \x1c sep \x85 nel   line"), (12, "token = \"abcdef0123456789abcdef0123\" and a.b@c.de +1 (415) 555-0132"),
]
# Names that operators use inside, as columns of the input.
CLASHES = ("print", "kept", "chunk", "blob", "spans", "component_id", "label", "word", "seq", "block", "score", "bits", "held",
           "kept_key", "blob_of_text", "spans_of_blob", "root", "node")


@pytest.fixture(scope="session")
def tricky(spark):
    """Documents with NULLs in every column, odd texts, repeated rows and clashing columns."""
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None if t is None or k % 4 == 0 else len(t))
            for k, (i, t) in enumerate(TRICKY)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    """The documents as Python pairs, for brute force."""
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
