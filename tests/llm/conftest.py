import os

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Intermediate tables go to the folder the session names; tests name one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[i * 7 % 20] + str(i % 97) for i in range(30_000))
PASSAGE = " ".join(f"{w}{i}" for i in range(4) for w in WORDS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, PASSAGE + "\nend one", "en"), (2, None, "en"), (3, "", None), (4, "   \n\t\n ", "en"), (5, LONG, "de"), (6, LONG, "de"), (7, PASSAGE + "\nend seven", None),
        (8, "Ünïcode ẞ 你好 😀 a\x00b", "fr"), (9, "one two", "en"), (9, "one two", "en"), (9, "one two three", "en"), (10, "One, two!", "en"), (None, "no id at all here now", "en"), (None, None, None),
        (11, "\n\n" + PASSAGE.upper(), "en"), (12, "a" * 70_000, "en"), (13, "%%% *** $$$ ###", "en"),
    ]
    names = ["n_words", "score", "part", "node", "bucket", "h", "i", "id", "key", "n_hit", "class_id", "rank", "template", "ids", "removed"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *[T.StructField(n, T.StringType()) for n in names]])
    return spark.createDataFrame([(*r, *names) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def path(name: str) -> str:
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert os.path.exists(public_tokenizers.path(name))
    return public_tokenizers.path(name)
