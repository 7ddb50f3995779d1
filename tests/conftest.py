import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)


@pytest.fixture(scope="session")
def spark():
    from reasonscope.session import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", app_name="reasonscope-tests", shuffle_partitions=8)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


def comments(spark, rows):
    """Comment table from (row_id, borrower, entity, notch, flag, text) tuples."""
    data = [(r[0], r[1], r[2], "AR", "MR", r[3], r[4], r[5]) for r in rows]
    return spark.createDataFrame(
        data, "row_id bigint, borrower_name string, entity_id string, actual_rating string, model_rating string, "
              "notch_difference string, override_flag string, reason_text string")
