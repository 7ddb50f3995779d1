"""Token counts by overlap resynchronisation.

A text over ``chunk`` characters is encoded as overlapping chunks, with offsets.
Two neighbours are spliced at a boundary that both have inside the overlap and that
is proven stable: just behind ASCII white space (which no token of this tokenizer
crosses), where both encodings have the same tokens up to the next white space.
Where there is none, the overlap is doubled and the chunk encoded again.

Shorter texts are one chunk. A chunk that needs no offsets is counted word by word:
words between ASCII white space are independent for the same reason, so each
distinct word is encoded once by the library and its count is kept (``MEMO`` words
at most, then the memo starts anew).

Defined cases: a null text counts as empty and has no tokens. Special strings in
texts are handled as the library does by default. Rows are independent.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField
from tokenizers import Tokenizer

from reasonscope.llm.common import append, extended, utf8, without

CHUNK = 1 << 15
OVERLAP = 256
MEMO = 1 << 19
_SPACE = " \t\n\x0b\f\r"
_LOADED: dict[str, "Counter"] = {}


class Counter:
    """Token counts under one tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.chunk, self.overlap, self.limit = chunk, overlap, memo
        self.memo: dict[bytes, int] = {}
        self.floor = 0  # where the last splice was: nothing before it is encoded again

    def _by_word(self, texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]
        new = list({w for ws in words for w in ws if w not in self.memo})
        if len(self.memo) + len(new) > self.limit:
            self.memo = {}
            new = list({w for ws in words for w in ws})
        for i in range(0, len(new), 4096):
            part = new[i: i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)):
                self.memo[w] = len(e.ids)
        get = self.memo.__getitem__
        return [sum(map(get, ws)) for ws in words]

    def _encoded(self, text: str, low: int, high: int) -> tuple[list[int], list[int]]:
        """Ids and start offsets (in ``text``) of one chunk."""
        e = self.tokenizer.encode(text[low:high], add_special_tokens=False)
        return e.ids, [low + a for a, _ in e.offsets]

    def _splice(self, text: str, a, b, low: int, high: int) -> tuple[int, int] | None:
        """Indexes of a token of ``a`` and of ``b`` that begin at the same stable
        boundary within the overlap [low, high); None if there is none."""
        at = low
        while at < high:
            if text[at] in _SPACE and at + 1 < high and text[at + 1] not in _SPACE:
                begin = at + 1
                end = begin
                while end < high and text[end] not in _SPACE:
                    end += 1
                if end == high:
                    return None
                i, j = bisect_left(a[1], begin), bisect_left(b[1], begin)
                m, n = bisect_left(a[1], end), bisect_left(b[1], end)
                if i < m and j < n and a[1][i] == begin == b[1][j] and a[0][i:m] == b[0][j:n] and a[1][i:m] == b[1][j:n]:
                    return i, j
                at = end
            else:
                at += 1
        return None

    def long(self, text: str) -> int:
        """Tokens of a text of any length, chunk by chunk: at most two chunks'
        encodings are held."""
        total, kept, high = 0, None, 0
        while high < len(text):
            overlap = min(self.overlap, high)
            while True:
                low = high - overlap
                top = min(len(text), low + max(self.chunk, 2 * overlap))
                now = self._encoded(text, low, top)
                if kept is None:
                    kept = now
                    break
                at = self._splice(text, kept, now, low, high)
                if at is not None:
                    total += at[0]
                    kept = now[0][at[1]:], now[1][at[1]:]
                    break
                floor = self.floor
                if overlap >= high - floor:  # nothing stable behind the last splice: one chunk from there on
                    top = min(len(text), floor + 2 * (top - floor))
                    kept = self._encoded(text, floor, top)
                    break
                overlap = min(2 * overlap, high - floor)
            self.floor = kept[1][0] if kept[1] and total else 0
            high = top
        return total + (len(kept[0]) if kept else 0)

    def counts(self, texts: list[bytes]) -> list[int]:
        self.floor = 0
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [0] * len(texts)
        for i, n in zip(short, self._by_word([texts[i] for i in short])):
            out[i] = n
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                self.floor = 0
                out[i] = self.long(t.decode())
        return out


def _counts(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Counter(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 1024):
                part = batch.slice(row, 1024)
                texts = utf8(part.column(text_col))
                yield append(part.select([c for c in part.schema.names if c != text_col]),
                             n_bytes=pa.array(map(len, texts), pa.int64()),
                             n_tokens=pa.array(_LOADED[path].counts(texts), pa.int64()))
    return run


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    source = without(docs, ("n_bytes", "n_tokens"))
    schema = extended(without(source, (text_col,)).schema, StructField("n_bytes", LongType()), StructField("n_tokens", LongType()))
    return source.mapInArrow(_counts(path, text_col), schema)
