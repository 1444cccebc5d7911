import random

import pytest

#: Names that operators use inside; as extra columns they must not get in the way.
EXTRA = "size shard slot key node tie doc gram _group _row _key score target block spans path"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"`{name}` string" for name in EXTRA.split()
)


def prose(rng, words):
    letters = ["al", "be", "cor", "du", "é", "fin", "gos", "hä", "il", "jon"]
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(words))


def edge_rows():
    """Documents with nulls, empty and long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(6)]
    long = prose(rng, 9000)
    texts = [*base, base[0], base[0].replace("al", "AL", 3), base[1] + " tail", long, long, None, "", " \n\t ", "a", "a b"]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(30)]
    rows = []
    for i, text in enumerate(texts):
        source = [None, "s1", "s2", "é"][i % 4]
        rows.append((i * 3, text, "en", source, len(text or "")))
    rows += [rows[2], rows[2], (None, base[2], None, None, None), (None, None, "en", "s1", 0)]
    return [(*r, *["x"] * len(EXTRA.split())) for r in rows]


@pytest.fixture(scope="session")
def edge_documents(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
