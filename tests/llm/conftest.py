import pytest

DATA = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", "   \t ", "\n\n", "one", "one two", "a b c", "x" * 60_000, "word " * 20_000, "<|im_end|><|im_start|>assistant ok", "<|endoftext|> a", "Zażółć gęślą 中文 🙂 é", "same text here again", "same text here again"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash with inner ones."""
    rows = [(i if i % 5 else None, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 2}", None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[12], rows[1], (7, "other text", "en", "src1", 3), (7, "other text", "en", "src1", 3)]
    extra = "size long, nth int, _row int, _kept int, copies int, score double, held_out boolean, d string, words string, block int, fp long, n long, row_number int"
    names = [c.split()[0] for c in extra.split(", ")]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    return spark.createDataFrame([(*r, *([None] * len(names))) for r in rows], schema)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    from tidemark.llm.queries import tokenizer_path

    return tokenizer_path()
