import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, node long, kind string"


def words(rng, n, size=400):
    return " ".join(rng.choice(["stone", "river", "green", "walks", "over", "quiet", "hills"]) + str(rng.randrange(size)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, shared passages, personal data, nulls, empty and long ones, in a table with clashing extra columns."""
    rng = random.Random(4)
    passage, template = words(rng, 70), words(rng, 150)
    texts = [words(rng, rng.randrange(1, 300)) for _ in range(40)]
    texts += [words(rng, 30) + "\n" + passage + "  " + words(rng, 20) for _ in range(8)]
    for i in range(10):
        copy = template.split()
        for _ in range(i % 4):
            copy[rng.randrange(150)] = "edited"
        texts.append(" ".join(copy))
    texts += [template] * 5 + [template.upper(), "", " \n\t ", None, None, "x" * 5000, words(rng, 3000), "one", "a b c d e", "é漢🙂 " * 60]
    texts += ["same line\n" * 40, "word " * 80, "### $$$ " * 50 + words(rng, 60)]
    texts += ["write to jo.doe@mail.example.com or +1 (509) 555-6973, host 10.0.0.1", "card 4111 1111 1111 1111 and 4111111111111112"]
    out = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[3], out[3], (None, words(rng, 90)), (None, None), (10_000_000_000, template)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en", None, None, 7, -1, "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3, F.col("text"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect() if r["doc_id"] is not None}
