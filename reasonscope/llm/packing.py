"""Sum-of-squares online packing of token sequences.

Each document is its ids and an end id. Whole windows of ``size`` ids are cut off
and are sequences of their own; the rest is placed online. A level array counts the
partially filled windows of each fill level; the rest goes to the level (or a new
window) after which the sum of the squared counts is least, ties to the fuller one.
Full windows leave the array.

Every partition of the input packs on its own (a shard), so no document is
shuffled. At the end of a shard its open windows are merged: the fullest are topped
up with pieces cut from the emptiest, so at most one window per shard is padded.
The same happens when more than ``max_open`` windows are open, which bounds the
memory. Sequence ids hold the shard in their upper bits.

Encoding: between two seams that hold in any context (before a space between two
characters that aren't white space) ids are independent, so a text's new pieces are
encoded at once and their ids kept, up to ``MEMO`` pieces (a full memo takes no more,
and a later task starts it anew).

Defined cases: a null text counts as empty and is the end id alone. Null and
repeated ids are packed like any others. Other columns aren't carried.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reasonscope.llm.bpe import vocabulary_ranks
from reasonscope.llm.common import utf8

SIZE = 1024
END = 0
MEMO = 1 << 20
MAX_OPEN = 8192
ROWS = 1 << 14
SCRIPTS = "\u0530"  # from here on the two libraries' character tables could be of other Unicode versions
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_LOADED: dict[tuple[str, str], "PieceEncoder"] = {}


class PieceEncoder:
    """Ids (little-endian unsigned 32-bit bytes) of texts under a tokenizer's JSON
    file; the same ids as the library's, special strings included."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        ranks = vocabulary_ranks(path)
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.behind_space = np.zeros(max(ranks.values()) + 1, bool)  # of a closed piece, the first token alone
        self.behind_space[[i for t, i in ranks.items() if t[0] == 32]] = True
        self.memo: dict[bytes, bytes | bool] = {}
        self.limit = memo

    def renew(self) -> None:
        if len(self.memo) > self.limit // 2:
            self.memo.clear()

    def direct(self, text: bytes) -> bytes:
        plain = text.decode()
        if max(plain, default="") >= SCRIPTS or any(s in text for s in self.special):
            ids = self.library.encode(plain, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(plain)
        return np.array(ids, "<u4").tobytes()

    @staticmethod
    def _open(piece: bytes) -> bool:
        """Whether the piece is empty or has white space at either end."""
        if piece and 32 < piece[0] < 127 and 32 < piece[-1] < 127:
            return False
        text = piece.decode()
        return not text or text[0].isspace() or text[-1].isspace()

    def _new(self, pieces: set[bytes]) -> dict[bytes, bytes | bool]:
        """The ids of each piece behind a space; False for an open one."""
        closed = [p for p in pieces if not self._open(p)]
        found: dict[bytes, bytes | bool] = dict.fromkeys(pieces, False)
        joined = b"".join(b" " + p for p in closed)
        text = joined.decode()
        if max(text, default="") < SCRIPTS and not any(s in joined for s in self.special):
            ids = np.array(self.fast.encode_ordinary(text), "<u4")
            cuts = [*(4 * np.flatnonzero(self.behind_space[ids])).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            found.update((p, raw[b:e]) for p, b, e in zip(closed, cuts, cuts[1:]))
        else:
            found.update((p, self.direct(b" " + p)) for p in closed)
        if len(self.memo) + len(found) <= self.limit:
            self.memo.update(found)
        return found

    def encode(self, text: bytes) -> bytes:
        pieces = text.split(b" ")
        ids = list(map(self.memo.get, pieces))
        if None in ids:
            new = self._new({p for p, i in zip(pieces, ids) if i is None})
            ids = [new[p] if i is None else i for p, i in zip(pieces, ids)]
        if False in ids:
            return self._merged(pieces, ids)
        ids[0] = self.direct(pieces[0])
        return b"".join(ids)

    def _merged(self, pieces: list[bytes], ids: list) -> bytes:
        """With open pieces: runs around them are encoded as one."""
        out, run, whole = [], [pieces[0]], True
        for i in range(1, len(pieces)):
            if ids[i - 1] is not False and ids[i] is not False:
                out.append(self.direct(b" ".join(run)) if whole else ids[i - 1])
                run, whole = [b"", pieces[i]], False
            else:
                run.append(pieces[i])
                whole = True
        out.append(self.direct(b" ".join(run)) if whole else ids[-1])
        return b"".join(out)


class Packer:
    """Places pieces ``(document, start, document tokens, ids)``; ``done`` are rows."""

    def __init__(self, size: int, first: int, max_open: int):
        self.size, self.next, self.max_open = size, first, max_open
        self.levels = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[list]] = defaultdict(list)
        self.open = 0
        self.done: list[tuple] = []

    def close(self, window: list) -> None:
        offset = 0
        for doc, start, tokens, ids in window:
            self.done.append((doc, start, len(ids) // 4, tokens, self.next, offset, ids))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        tokens, step = len(ids) // 4, 4 * self.size
        whole = tokens // self.size * self.size
        for start in range(0, whole, self.size):
            self.close([(doc, start, tokens, ids[4 * start: 4 * start + step])])
        if whole < tokens:
            self.place((doc, whole, tokens, ids[4 * whole:]), tokens - whole)

    def place(self, piece: tuple, n: int) -> None:
        levels, size = self.levels, self.size
        at = np.flatnonzero(levels[1: size - n + 1]) + 1
        best, window = 0, []
        if len(at):
            # change of the sum of squares: one less at the level, one more at the new one
            change = 1 - 2 * levels[at] + np.where(at + n < size, 2 * levels[at + n] + 1, 0)
            i = len(at) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= 2 * levels[n] + 1:
                best = int(at[i])
        if best:
            window = self.windows[best].pop()
            levels[best] -= 1
            self.open -= 1
        window.append(piece)
        self.put(window, best + n)
        if self.open > self.max_open:
            self.merge()

    def put(self, window: list, fill: int) -> None:
        if fill == self.size:
            self.close(window)
        else:
            self.windows[fill].append(window)
            self.levels[fill] += 1
            self.open += 1

    def merge(self, last: bool = False) -> None:
        """Tops up the fullest open windows with pieces of the emptiest."""
        order = [w for fill in sorted(self.windows, reverse=True) for w in self.windows[fill]]
        self.windows.clear()
        self.levels[:] = 0
        self.open = 0
        low, high = 0, len(order) - 1
        while low <= high:
            window, fill = order[low], sum(len(p[3]) // 4 for p in order[low])
            low += 1
            while fill < self.size and low <= high:
                doc, start, tokens, ids = order[high].pop()
                room = self.size - fill
                if len(ids) // 4 > room:
                    order[high].append((doc, start + room, tokens, ids[4 * room:]))
                    ids = ids[: 4 * room]
                window.append((doc, start, tokens, ids))
                fill += len(ids) // 4
                if not order[high]:
                    high -= 1
            if fill == self.size or last:
                self.close(window)
            else:
                self.put(window, fill)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in columns[:6]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[6], pa.binary())], names=[*names, "ids"])


def _packed(path: str, pattern: str, size: int, end: int, max_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = PieceEncoder(path, pattern)
        encoder = _LOADED[path, pattern]
        encoder.renew()
        packer = Packer(size, TaskContext.get().partitionId() << 40, max_open)
        ending = np.array([end], "<u4").tobytes()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                packer.add(doc, encoder.encode(text) + ending)
                if len(packer.done) >= ROWS:
                    yield _batch(packer.done)
                    packer.done = []
        packer.merge(last=True)
        if packer.done:
            yield _batch(packer.done)
    return run


def pack(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
         end: int = END, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids
    (little-endian unsigned 32-bit)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_packed(path, pattern, size, end, max_open), SCHEMA)
