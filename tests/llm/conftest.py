import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

#: Names that operators use inside.
CLASHING = ("id", "t", "k", "row", "fp", "v", "key", "seed", "spans", "n_tokens", "n_bytes", "pii_text", "pii_spans",
            "kept", "component_id", "text_hash", "lang_pred", "score", "label", "file", "block", "__text", "__kept", "a.b")

LONG = " ".join(f"word{i % 977} x{i % 13}" for i in range(40_000))
BENCH = "the quick brown fox jumps over the lazy dog while seven wizards brew potent tea"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    mail = "Write to Jane.Doe@mail.example.com or +1 (644) 555-7859, card 4279 0558 9076 4913, from 10.0.0.255 or 10.0.0.256."
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi"
    rows = [
        (1, "", "en", "s", 0), (2, None, "en", None, None), (3, LONG, None, "s", 1), (4, mail, "en", "s", 5),
        (5, base, "en", "s", 5), (5, base, "en", "s", 5), (6, base + " psi", "en", "s", 5), (7, base, "de", "s", 5),
        (8, LONG + " end", "en", "s", 1), (None, base, "en", "s", 1), (None, None, None, None, None), (9, "  \t\n ", "fr", "s", 4),
        (10, "12345 !!! ...", "fr", "s", 4), (11, "Straße ÉCOLE ñandú 日本語 <|endoftext|> x", "de", "s", 4),
        (12, BENCH.upper() + ", he said.", "en", "s", 4), (13, "so " + BENCH.replace("lazy", "sleepy") + " again", "en", "s", 4),
        (14, "x" * 30_000 + "@" + "y" * 10 + ".com", "en", "s", 4), (15, "a", "en", "s", 4),
        (16, "Released under the MIT License. " + base, "en", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(CLASHING):
        df = df.withColumn(c, F.lit(f"extra{i}"))
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()
