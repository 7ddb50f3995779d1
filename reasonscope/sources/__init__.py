"""Table loading, column mapping, test views and report sinks."""

from reasonscope.sources.columns import LOGICAL_FIELDS, ColumnIndex, Header, Position, project_fields  # noqa: F401
from reasonscope.sources.readers import load_table, with_row_id  # noqa: F401
