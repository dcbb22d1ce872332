import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp string, body string, score string, kept string, id string, severity string, null string, at string, own string, spans string, __xd_digest string, __sh_id string, __pi_done string"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog again and again",
    "The quick  brown\tfox jumps over\nthe lazy dog again and again",
    "the quick brown fox jumps over the lazy dog again and again today",
    "",
    None,
    "   \n\t ",
    "one",
    "One two",
    LONG,
    LONG + " tail",
    "Héé ÀÉÎ 日本語 text ß Ünïcode\u00a0space",
    "x" * 200_000,
    " " * 50_000,
    "!" * 50_000,
    "same text",
    "same text",
    "a\x0bb\x0cc\rd",
]


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, ties, repeated rows, long texts."""
    out = [(k, t, "en", "src0" if k % 2 else None, len(t or ""), *["clash"] * 14) for k, t in enumerate(TEXTS)]
    out.append((14, "same text", "en", None, 9, *["clash"] * 14))
    out.append((None, "same text", None, None, None, *[None] * 14))
    out.append((None, "without an id", None, None, None, *[None] * 14))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
