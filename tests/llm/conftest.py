"""A small table with nulls, ties, repeated rows, copies and extra columns."""

import random

import pytest

from brute import SCHEMA, made_texts


@pytest.fixture(scope="session")
def rows():
    texts = made_texts()
    order = list(range(len(texts)))
    random.Random(8).shuffle(order)
    out = [(k * 3, texts[i]) for k, i in enumerate(order)]
    out.append(out[7])  # a row twice
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1, "clash", 0.5, "clash", "clash") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
