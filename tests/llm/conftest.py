import os
import random

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("digest", "node", "key", "keys", "label", "score", "code", "kind", "tokens", "start", "host", "suffix", "vector", "n")


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    spark.sparkContext.environment["PYTHONPATH"] = REPO


def words(n, seed, stock=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(stock)}{'xyz'[r.randrange(3)]}" for _ in range(n))


def table(spark, rows, clash=True):
    """Documents of (id, text) rows, with extra columns whose names operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("extra") for c in CLASHES})
    return df


#: Null id, null text, no text, no words, one word, a very long text.
ODD = [(None, "a text without an id, long enough to be something"), (901, None), (902, ""), (903, " \n\t "), (904, "word"), (905, words(30_000, 5, 20_000))]
