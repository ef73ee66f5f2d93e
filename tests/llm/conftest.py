import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: doc_id, text, lang, source: nulls in every column, empty, blank, repeated rows, ties, copies, one very long text.
PROSE = " ".join(f"word{i} of{i % 7} the{i % 3} text{i * 37 % 101}" for i in range(60))
EDGE = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE + " end", "en", None), (4, PROSE.replace(" ", "\n"), None, "b"),
    (5, None, "en", "b"), (6, "", "fr", "a"), (7, " \t\n", "fr", "b"), (None, "sans numéro ici", "fr", "b"), (None, PROSE, "en", "c"),
    (8, "été déjà là où ça", "fr", "c"), (9, "!!! ???", None, None), (10, "ab " * 9000, "en", "a"), (11, "x" * 40000, "de", "a"),
    (12, "<|endoftext|> two  spaces \n\n 日本語 🙂", "ja", "d"), (13, "one two", "en", "d"), (14, "ONE  Two", "en", "d"),
]


@pytest.fixture(scope="session")
def spark():
    from loadscope.session import get_spark, shared_dir
    s = get_spark("local[4]", 4, app="loadscope-llm-tests", driver_memory="6g")
    shared_dir(s)
    yield s
    s.stop()


def clashing(df):
    """Extra columns, named as the operators' own."""
    from pyspark.sql import functions as F
    for c in ("size", "pos", "n", "key", "cid", "t1", "ids", "shard", "_part", "_kept_key", "_mix_key", "_id", "_text", "part", "rate", "c0"):
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="session")
def edge(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return clashing(spark.createDataFrame([(*r, len(r[1] or "")) for r in EDGE], schema))


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("1 = 0")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    from loadscope.llm.queries import tokenizer_path
    return tokenizer_path()
