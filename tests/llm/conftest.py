import pytest

# Nulls in any column, empty and blank texts, a repeated row, one id with two texts, ties, a long text, odd characters.
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
SHARED = "\n".join(f"this shared line number {i} stands in many documents" for i in range(6))
ROWS = [
    (1, "The quick brown fox. It jumps over the lazy dog!", "en", "a", 47),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, "   \n\t\n ", "en", "b", 6),
    (5, LONG, "en", "a", len(LONG)),
    (6, SHARED, "en", "a", len(SHARED)),
    (7, "own first line of seven\n" + SHARED + "\nown last line of seven", "en", "a", 0),
    (8, SHARED, "en", "a", len(SHARED)),
    (8, SHARED, "en", "a", len(SHARED)),
    (9, "one text of nine", "en", "a", 16),
    (9, "another text of nine", "de", "a", 20),
    (None, "a text without an id", "fr", "a", 20),
    (None, None, None, None, None),
    (10, "Größe É é é H̱ İ ΑΣ K 漢字 🙂 <|endoftext|> don't it's I'VE 12,5% a b x\u001cy!!", "de", "a", 1),
    (11, "Größe É é é H̱ İ ΑΣ K 漢字 🙂 <|endoftext|> don't it's I'VE 12,5% a b x\u001cy!!", "de", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(table):
    return {r["doc_id"]: r["text"] or "" for r in table.collect()}
