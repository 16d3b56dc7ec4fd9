import random
import zlib

import pytest

TOXIC_WORDS = ["idiot", "moron", "scum", "loser"]
#: Names that the operators use inside; extra columns of these names must do no harm.
CLASHING = ["node", "root", "size", "rank", "hash", "chunk", "digest", "class", "offset", "score", "n_words", "tree", "ids", "fold",
            "gone_doc", "gone_hash", "gone_ks", "own_hash", "changed", "repeat_doc", "repeated_digests", "rejected_id", "k", "block", "word", "n"]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, clashing columns."""
    rng = random.Random(5)
    long = sentence(rng, 40_000)
    shared = sentence(rng, 80)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, shared), (6, shared), (7, "x " + shared + " y"), (None, shared), (None, None), (8, "One."), (9, "One."), (9, "Two words.")]
    return clashing(spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def toxic_corpus(spark):
    """Labelled documents: toxic ones hold two of four insults."""
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(600):
        words = sentence(rng, rng.randint(20, 60)).split()
        toxic = int(i % 5 == 0)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC_WORDS))
        docs.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        labels.append((i, int(i % 7 != 0), toxic))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0
