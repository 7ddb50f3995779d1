"""The corpus pipeline against its stages' brute force, and the registration."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from conftest_llm import SCHEMA, corpus, table  # noqa: E402, F401
from test_dedup import brute_components, brute_print, brute_removal  # noqa: E402


def test_stages_take_effect(spark, corpus, tmp_path):
    table(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        results.append([r.asDict() for r in docs.collect()])
    kept, single, cut, pieces = results
    assert 0 < len(kept) < len(corpus) and all(r["text"] for r in kept)
    rows = [(r["doc_id"], r["text"]) for r in kept]
    prints = [brute_print(t) for _, t in rows]
    groups = brute_components([i for i, _ in rows], prints)
    assert len(single) == len({(g, p if g is None else 0) for g, p in zip(groups, prints)})
    want = {i: text for i, _, n, text in brute_removal([(r["doc_id"], r["text"]) for r in single]) if n}
    for r in cut:
        if r["doc_id"] in want:
            assert r["text"] == want[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert want and {p["doc_id"] for p in pieces} == {r["doc_id"] for r in cut}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == list(pieces[0]) and whole.agg({"length": "sum"}).first()[0] == sum(p["length"] for p in pieces)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_operator_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
