import pytest

ODD_NAMES = ("n_words", "hit_words", "item_ids", "_hash", "gone", "component", "uid", "token_ids", "secret_spans", "size", "main_text", "group", "bands", "rep")
LONG = " ".join(f"word{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with inner names."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (None, text, "en", "a"), (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, text, None, None), (4, text, None, None),
        (5, LONG, "en", "a"), (6, "x", "en", "b"), (7, text + " extra", "de", "b"), (None, None, None, None), (8, "ÄÖ ß naïve 日本語 🙂 " * 3, "de", "a"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(ODD_NAMES):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(k).cast("long"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def tables(tmp_path):
    """Writes tables to a folder as the queries read them."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
