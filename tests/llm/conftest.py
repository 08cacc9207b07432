import pytest

SMALL = "/root/testdata/sf0.001"

LONG = "The quick brown fox jumps over the lazy dog.\n" * 3000
EDGE_TEXTS = [
    None, "", " ", "\n\n", "a", "two words", "same line\nsame line\nsame line", "  lead and trail  ", "tab\tand\r\nreturn\x0bvertical\x0cfeed",
    "NUL\0byte", "ß Straße ÉCOLE ñandú", "你好 世界 こんにちは", "🙂 emoji 👩‍👩‍👧", "a b c\u0085d\u001ce", "▁mark ▁▁ here", "<|endoftext|> x<|endoftext|>", "</s> <unk> <0x0A>",
    "1234567890 12,345.67 don't we'll", "a  b   c    d", "x\n\n\n  y\n z ", LONG,
]


@pytest.fixture
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, row string, n_words int, key string, count int"
    rows = [(i, t, "en", "s", None, 1, "r", 2, "k", 3) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[5], rows[5], (None, "a null id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
