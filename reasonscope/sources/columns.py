"""Map logical fields onto the columns of an input table.

A field is named by spreadsheet letters (``"B"``: the second column) or by header
text. ``ColumnIndex`` holds both tables of one schema and looks specs up in them;
only the schema is read, the data is only projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, product
from string import ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonscope.defaults import DEFAULT_COLUMN_MAP

LOGICAL_FIELDS = tuple(DEFAULT_COLUMN_MAP)


@dataclass(frozen=True)
class Position:
    """A column by spreadsheet letters."""
    letters: str


@dataclass(frozen=True)
class Header:
    """A column by header text, whatever it is spelt like."""
    text: str


def spreadsheet_letters() -> Iterator[str]:
    """A, B, ..., Z, AA, AB, ..."""
    for width in count(1):
        yield from map("".join, product(ascii_uppercase, repeat=width))


def tidy(header) -> str:
    """A header as it is compared: lower case, single spaces."""
    return " ".join(str(header).lower().split())


def as_spec(given):
    """A spec from its JSON form: ``{"header": ...}``, ``{"letters": ...}`` or a string."""
    if isinstance(given, dict):
        (kind, text), = given.items()
        return {"header": Header, "letters": Position}[kind](text)
    return given


class ColumnIndex:
    """The columns of one schema, by letters and by tidied header (of equal headers
    the last one counts)."""

    def __init__(self, columns: list[str]):
        self.by_letters = dict(zip(spreadsheet_letters(), columns))
        self.by_header = {tidy(name): name for name in columns}

    def find(self, spec) -> str:
        """A spec object says which table to use; a plain string of letters A-Z is a
        position, any other one a header."""
        if not isinstance(spec, (Position, Header)):
            text = str(spec).strip()
            spec = Position(text) if text.isascii() and text.isalpha() else Header(text)
        table, key = ((self.by_letters, spec.letters.strip().upper()) if isinstance(spec, Position)
                      else (self.by_header, tidy(spec.text)))
        if key not in table:
            raise KeyError(f"{spec} names none of the {len(self.by_letters)} columns {list(self.by_letters.values())}")
        return table[key]


def project_fields(df: DataFrame, column_map, keep=("row_id",)) -> DataFrame:
    """Select the logical fields (aliased) plus the ``keep`` columns present."""
    index = ColumnIndex(df.columns)
    fields = dict(column_map)
    kept = [F.col(f"`{name}`") for name in keep if name in df.columns]
    return df.select(*kept, *[F.col(f"`{index.find(spec)}`").alias(field) for field, spec in fields.items()])
