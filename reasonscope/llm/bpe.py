"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text's element is its exact encoding as a text of its own. Texts over ``leaf``
characters are halved until the halves fit, leaves are encoded by the tokenizer
library, and neighbours are joined up the tree: the tokens of a window around the
seam are replaced by those of the re-encoded window. A window may only begin and
end at *seams that hold in any context*: before a space that stands between two
characters that aren't white space. No match of the splitting pattern can reach
across such a place (a match has a space only in front, or consists of white space
alone), so the tokens outside the window are proven to stay. A window without such
places grows by doubling, up to both whole halves.

Decoding concatenates the bytes of blocks of ids up a tree.

Defined cases: a null text counts as empty and has no tokens; special strings in a
text are ordinary text. Rows are independent: repeated rows and ids are kept.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField

from reasonscope.llm.common import append, extended, utf8, without

LEAF = 1 << 15
WINDOW = 64
_LOADED: dict[tuple, object] = {}


def rank_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a file of ``base64 rank`` lines; loaded once per process."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def vocabulary_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level BPE in a tokenizer's JSON file, whose tokens are
    written with one printable character for each byte."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in whole["added_tokens"]}
    return {bytes(byte_of[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in special}


def holds(text: str, at: int) -> bool:
    """Whether a token boundary before the space at ``at`` holds in any context."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def _seam_before(text: str, low: int, high: int) -> int | None:
    """The last holding seam in [low, high)."""
    at = text.rfind(" ", low, high)
    while at >= low and at != -1 and not holds(text, at):
        at = text.rfind(" ", low, at)
    return at if at >= low and at != -1 else None


def _seam_after(text: str, low: int, high: int) -> int | None:
    """The first holding seam in [low, high)."""
    at = text.find(" ", low, high)
    while at != -1 and not holds(text, at):
        at = text.find(" ", at + 1, high)
    return at if at != -1 else None


def encode(text: str, library: Callable[[str], list[int]], leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """The ids of ``text``, equal to ``library(text)``."""
    def element(low: int, high: int) -> list[int]:
        if high - low <= leaf:
            return library(text[low:high])
        middle = (low + high) // 2
        return join(low, middle, high, element(low, middle), element(middle, high))

    def join(low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        width = window
        while True:
            begin, end = max(low, middle - width), min(high, middle + width)
            p = low if begin == low else _seam_before(text, begin, middle - 1)
            q = high if end == high else _seam_after(text, middle + 1, end)
            if p is not None and q is not None:
                tail, head = library(text[p:middle]), library(text[middle:q])
                return left[: len(left) - len(tail)] + library(text[p:q]) + right[len(head):]
            width *= 2

    return element(0, len(text))


def decode(ids: list[int], library: Callable[[list[int]], bytes], leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return library(ids)
    middle = len(ids) // 2
    return decode(ids[:middle], library, leaf) + decode(ids[middle:], library, leaf)


def _codec(path: str, pattern: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_encoding(path, pattern)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):  # few texts' ids are held at a time
                part = batch.slice(row, 256)
                ids, back = [], []
                for t in utf8(part.column(text_col)):
                    one = encode(t.decode(), coder.encode_ordinary)
                    back.append(decode(one, coder.decode_bytes))
                    ids.append(np.array(one, "<u4").tobytes())
                yield append(part, ids=pa.array(ids, pa.binary()), n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()),
                             decoded=pa.array(back, pa.binary()))
    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit), ``n_tokens`` and
    ``decoded`` (the bytes the ids stand for)."""
    source = without(docs, ("ids", "n_tokens", "decoded"))
    return source.mapInArrow(_codec(path, pattern, text_col), extended(
        source.schema, StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("decoded", BinaryType())))
