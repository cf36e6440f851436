import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _part int, size string, score string, _bytes string, taken int"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def plain(docs):
    """(doc_id, text) of all documents by id."""
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def long_text():
    return " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; extra columns have names that clash."""
    same = "One paragraph here. Another one there.\nA third line, of some words that go on for a while, so that it is long enough to be a window."
    rows = [(1, same, "en", "a"), (1, same, "en", "a"), (1, "other text", "en", "a"), (2, same, None, None), (3, None, "en", None), (None, "no id at all", "en", "b"), (None, None, None, None)]
    rows += [(4, "", "en", "b"), (5, " \n\t ", "en", "a"), (6, long_text(), "en", "a"), (7, long_text() + " end", "en", "c"), (8, "ÀÉ日本語 😀 straße İ", "xx", "é"), (9, "x" * 5000, "en", "a"), (10, "\0\x1c nul", "en", "a")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    full = [(i, t, lang, src, None if t is None else len(t), 7, "s", "s", "b", 3) for i, t, lang, src in odd_rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
