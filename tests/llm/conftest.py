import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=3 + k % 7)) for k in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty, very long and repeated rows, copies, near copies and a shared passage."""
    base, passage = prose(1, 300), prose(2, 80)
    near = base.split()
    near[50], near[200] = "changed", "other"
    texts = {
        0: base, 1: base, 2: " ".join(near), 3: None, 4: "", 5: "   \n\t ", 6: "one two", 7: prose(3, 60) + " " + passage, 8: prose(4, 60) + " " + passage + " " + prose(5, 10),
        9: prose(6, 9000), 10: "x" * 30000, 11: "é ñ ß 日本 🎉 " * 20, 12: "Call +1 (844) 555-2728 or mail ob.9@mail4.example.com, card 4012888888881881.", 13: base,
    }
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in texts.items()]
    return [*rows, rows[2], (None, base, None, None, 5), (20, prose(7, 100), None, None, None)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(spark, edge_docs):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["home", "bucket", "label", "key", "cid", "ids", "score", "kept", "part", "length", "nth", "base", "node", "u", "v", "rank", "data"]
    return edge_docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
