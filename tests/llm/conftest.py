import pytest

SF = "/root/testdata/sf0.001"
LINE = "a line that is repeated in a number of documents"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    words = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    plain = "The quick brown fox jumps over the lazy dog near the river bank while seven small birds sing"
    texts = [
        (None, plain, "en"), (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "a", "en"), (5, words, "en"), (6, plain, "en"), (7, plain, None), (7, plain, None),
        (8, f"{LINE}\nfirst\n{LINE}", "de"), (9, f"second\n {LINE.upper()} ", "de"), (10, f"{LINE}\n", "de"), (11, "1234 5678 !!! ???", "en"), (12, "日本語のテキスト 'quoted' <|endoftext|>", "ja"),
        (13, plain + " again", "en"), (-4, "é" * 300 + "\n" * 5, "fr"),
    ]
    rows = [(d, t, lang, "s", len(t or ""), 1, "clash", "clash", 5, "x") for d, t, lang in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int, sequence_id string, n_lines string, p int, hash string")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) of the small driver table, as Python rows."""
    import duckdb

    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
