import random

import pytest
from pyspark.sql import types as T

#: A text table with what an operator must bear: nulls, empty and odd texts, repeated rows, clashing extra columns.
ODD = [None, "", " \t\n", "one", "two words", "same line\nsame line\n", "ünï cödé ☃ 𝔘𝔫𝔦", "x" * 5000, "a b c d e f g h i j " * 500, "password = hunter2hunter2"]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("kept", T.StringType()), ("v", T.IntegerType()), ("n", T.StringType()), ("rows", T.StringType()), ("words", T.StringType()), ("score", T.StringType()))])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and to in is that for was on with as it by at from stone river candle market window garden letter winter number bridge"
                               .split()) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def rows(texts, first=0):
    return [(None if t == "no id" else first + i, None if t == "no id" else t, [None, "en", "de", "xx"][i % 4], None, None, "k", 1, "n", "r", "w", "s") for i, t in enumerate(texts)]


@pytest.fixture
def odd(spark):
    made = rows([*ODD, "no id"])
    return spark.createDataFrame([*made, made[4], made[8]], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
