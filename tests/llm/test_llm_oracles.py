"""Registered queries against their SQL on small tables of odd rows."""

import random

import pytest

from compare import compare
from conftest_llm import SCHEMA, corpus  # noqa: F401
from reasonscope.llm.oracles import ORACLES
from reasonscope.llm.queries import QUERIES


def against_sql(spark, folder, name, table, rows, schema):
    import duckdb
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = compare(QUERIES[name](spark, str(folder)), con, ORACLES[name])
    assert found["cols_ok"] and found["types_ok"] and found["values_ok"], found
    return found["spark_rows"]


def test_quality_sql(spark, corpus, tmp_path):
    langs = ["en", "de", "it", "ru", None, "", " UND", "fr"]
    rows = [(i, t, langs[n % 8] if n % 3 else "en", "s", None) for n, (i, t) in enumerate(corpus)]
    assert against_sql(spark, tmp_path, "op10_quality_rules", "documents", rows, SCHEMA) == len(corpus)


def test_quality_sql_by_random_texts(spark, tmp_path):
    r = random.Random(3)
    pool = ["the", "und", "de", "La", "été", "x#$", "12", "Straße,", "\n", "\n", "漢字", "a\tb", "ÉTÉ", "THE"]
    rows = [(i, " ".join(r.choice(pool[:r.randint(2, 14)]) for _ in range(r.randint(0, 300))), r.choice(["en", "de", "fr", "es", "it"]), "s", 1)
            for i in range(150)]
    assert against_sql(spark, tmp_path, "op10_quality_rules", "documents", rows, SCHEMA) == 150


def test_chat_sql(spark, tmp_path):
    r = random.Random(4)
    pool = ["<|", "|>", "\\", "\n", "</s>", "[INST]", "[/INST]", "<", "s>", " ok ", "漢", "<|end|>", "\\<|", "[SEP]"]
    rows = [(i % 40, i // 40, r.choice(["user", "assistant", "system", "a\\b", "<|x\n", None]),
             r.choice([None, "", "".join(r.choice(pool) for _ in range(r.randint(1, 20)))])) for i in range(300)]
    rows += [(5, 1, "assistant", "again")] * 2
    assert against_sql(spark, tmp_path, "op5_chat_formatting", "conversations", rows, "conv_id long, turn long, role string, text string") == 41


@pytest.mark.parametrize("name", ["op10_quality_rules", "op5_chat_formatting"])
def test_empty_tables(spark, tmp_path, name):
    table, schema = ("documents", SCHEMA) if name.startswith("op10") else ("conversations", "conv_id long, turn long, role string, text string")
    assert against_sql(spark, tmp_path, name, table, [], schema) == (name == "op5_chat_formatting")
