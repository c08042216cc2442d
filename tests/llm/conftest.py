import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long and repeated texts, ties and columns whose names clash with results'."""
    long = "word " * 30_000 + "end."
    rows = [
        (1, "The cat sat on the mat, and the dog ate it all up.", "en", "src1"), (2, "The cat sat on the mat, and the dog ate it all up.", "en", "src1"), (3, None, None, None), (4, "", "", ""),
        (5, long, "en", "src0"), (6, long, "en", "src0"), (None, "no id\there  two  spaces ", "de", "src2"), (None, "no id\there  two  spaces ", "de", "src2"), (7, "x", "fr", "other"), (7, "x", "fr", "other"),
        (8, "日本語 テスト \U0001f600 naïve café ▁▁ \x00 end", "ja", "src3"), (9, "a <|endoftext|> b<|endoftext|></s>", "en", "src4"), (10, "   leading and trailing\n\n\n", "en", "src5"), (11, "don't it's 'll 1234567890 !!!???", "en", "src6"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 AS score", "'x' AS fp", "7 AS n_tokens", "5 AS predicted", "3 AS `group`", "2 AS y", "true AS query", "4 AS _text", "5 AS _domain", "6 AS mix_other", "7 AS mix_part", "8 AS _key", "9 AS _range", "1 AS _id", "2 AS _hash", "3 AS _rows", "4 AS _own_hash", "5 AS tokens", "6 AS `a.b`", "7 AS `row`", "8 AS own_id", "'x' AS domain", "9 AS `key`", "1 AS `range`").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
