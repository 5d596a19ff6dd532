import random

import pytest
from pyspark.sql import types as T

from skyhive.llm.common import prepare

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # names that the operators use inside
                     T.StructField("kept", T.StringType()), T.StructField("node", T.LongType()), T.StructField("bucket", T.IntegerType()),
                     T.StructField("words", T.StringType()), T.StructField("keep", T.BooleanType())])


@pytest.fixture(scope="session")
def llm_spark(spark):
    return prepare(spark)


def some_texts(seed=5, n=60):
    """Texts with all the odd cases: null, empty, white space only, long, repeated, near copies, shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = make(60), make(300)
    texts = [None, "", " \t\n\x0b", "one", "two words", "x" * 5000, "▁   \x00 日本\n\n<|endoftext|>", " ".join(make(9000))]
    texts += [" ".join(base)] * 3
    for _ in range(4):
        near = list(base)
        near[rng.randrange(300)] = "changed"
        texts.append(" ".join(near))
    for _ in range(n):
        words = make(rng.randint(1, 200))
        if rng.random() < 0.3:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        texts.append(rng.choice([" ", " ", "  ", "\n"]).join(words).replace("aa", "A, a"))
    texts.append(" ".join(base[:100] + base[:100]))
    return texts


@pytest.fixture(scope="session")
def corpus(llm_spark):
    """Rows (doc_id, text) and the table of them: ids not in order, one null, one repeated."""
    texts = some_texts()
    ids = [(7 * i) % len(texts) * 3 for i in range(len(texts))]
    rows = list(zip(ids, texts)) + [(None, "a row without an id"), (ids[-1], "another text of the same id"), (ids[12], texts[12])]
    full = [(i, t, "en" if k % 3 else None, "src0" if k % 2 else None, 1, "kept", 3, 4, "w", None) for k, (i, t) in enumerate(rows)]
    return rows, llm_spark.createDataFrame(full, DOCS).repartition(5)


@pytest.fixture(scope="session")
def nothing(llm_spark):
    return llm_spark.createDataFrame([], DOCS)
