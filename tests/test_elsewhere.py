"""The core runs from any folder, without the source folder on the workers' path and
without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.insert(0, {src!r})
import __spark_entry__ as E
from reasonscope.session import build_session
from reasonscope.plans.categorize import categorize
from reasonscope.sources.fixtures import VIEW_OPTIONS, VIEWS
from reasonscope.streaming.classify import classify_stream
spark = build_session("local[4]", shuffle_partitions=4)
assert not any(name.startswith("op") for name in E.queries())
assert E.entry(spark).count() > 0
for name, query in E.queries().items():
    assert query(spark, {sf!r}).collect() is not None, name
    spark.catalog.clearCache()
view, opts = VIEWS["turn"](spark, {sf!r}), VIEW_OPTIONS["turn"]
detail, model = categorize(view, opts)
expected = sorted((r.row_id, r.Category) for r in detail.collect())
assert sorted((r.row_id, r.Category) for r in classify_stream(view, opts, model).collect()) == expected
print("all", len(E.queries()))
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_every_core_query_from_an_empty_folder(tmp_path):
    source, empty = tmp_path / "source", tmp_path / "empty"
    shutil.copytree(os.path.join(HERE, "reasonscope"), source / "reasonscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), source)
    empty.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(src=str(source), sf=SF)], cwd=empty, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "all " in done.stdout, done.stderr[-3000:]
