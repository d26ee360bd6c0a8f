import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from flowforge.session import get_session
    return get_session(master="local[4]", shuffle_partitions=4)


SCHEMA = "doc_id long, text string, source string, n_chars long, id string, batch long"


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and blank texts, repeated rows, ties, a long text, passages
    that documents share, clashing column names (id, batch)."""
    import random
    r = random.Random(5)
    words = ["the", "of", "Alpha", "beta", "éa", "x1", "Omega,", "|", "$5", "日本", "ﬁ", "Straße"]
    passage = " ".join(r.choice(words) for _ in range(60))

    def text(n):
        return "".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))

    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (None, "null id text " * 20),
           (6, "ab " * 500), (7, "ab " * 300), (8, "<|endoftext|> and <|im_end|> x"), (9, "a" * 700)]
    out += [(10 + i, text(r.randint(30, 200))) for i in range(25)]
    out += [(40 + i, text(20) + "\n" + passage + "\n" + text(20)) for i in range(6)]
    out += [(50 + i, out[12][1]) for i in range(4)] + [(50, out[12][1]), (50, out[13][1])]
    out += [(60, text(4000))]
    return [(i, t, f"s{k % 2}" if k % 7 else None, len(t or ""), "clash", k) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
