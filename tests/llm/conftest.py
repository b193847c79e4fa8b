import pathlib

import pandas as pd
import pytest

DATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def docs_pdf():
    return pd.read_parquet(DATA / "documents.parquet")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(str(DATA / "documents.parquet"))


#: Texts that are odd in some way, under ids with repeats and a null.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one word"), (4, "one word"), (5, "one\tword"), (6, "one  word\n"), (None, "one word"), (7, "é" * 50 + " " + "long " * 30_000), (8, "tie a b c d e"), (9, "tie a b c d e"),
    (10, "<|im_start|> 🙂 日本語 \x00 \x85"), (11, "a" * 60_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with extra columns whose names operators also use."""
    rows = [(i, t, "en", "s" if i != 5 else None, k, "x", float(k), True) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long, id string, score double, kept boolean")


def components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
