"""Small tables for the tests of the subpackage."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): copies, near copies, shared passages, odd and empty texts."""
    r = random.Random(5)
    words = [a + b for a in "the of and lo mi ra".split() for b in "na te ki so u er".split()] + ["the", "of", "and", "to", "in"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(40)
    base = text(300)
    rows = [(i, text(r.randint(1, 120))) for i in range(40)]
    rows += [(100, base), (101, base), (102, base + " more"), (103, base.upper())]
    rows += [(110 + i, f"{text(20)}\n{passage}\n{text(15)}") for i in range(6)]
    rows += [(120, "a b a b " * 40), (121, "x " * 30), (122, "x " * 30), (123, "ab\x0bc\x0cd e  f\n\n"), (124, "Ünï çödé 漢字 😀 " * 9)]
    rows += [(130, None), (131, ""), (132, " \n\t "), (133, "one"), (None, passage), (None, None), (100, base), (134, "w" * 3000)]
    rows += [(140, text(4000)), (141, "<|endoftext|> said <|endoftext|>" + text(5)), (-5, passage + " end")]
    return rows


def table(spark, rows, partitions=3):
    data = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


def clashing(docs, *names):
    """``docs`` with string columns of the given names."""
    from pyspark.sql import functions as F
    return docs.withColumns({n: F.lit("mine") for n in names})
