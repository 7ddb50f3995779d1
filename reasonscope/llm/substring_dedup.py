"""Substring dedup by seed and extend.

A window is ``window`` (13) consecutive words of one text. A word is removed when
a window covering it also starts in a document with a smaller id.

Seeds: the winnowed anchors of a text are the rightmost minimal 4-word hashes
among the 10 inside each window. The choice depends on the window's words alone,
so equal windows hold the same anchor at the same place, and joining documents on
anchors misses no match.

Extension: the consecutive windows that chose one anchor occurrence form its
*stretch* (the anchor extended both ways as far as a window can reach). Rows
``(anchor, stretch, document)`` are dealt out by anchor and sorted, so each task
streams over them with the state of one anchor and forms no pairs:

* equal stretches: all but the smallest document's are repeats as a whole;
* an anchor with several stretches: a match may end inside one, so the smallest
  document of each stretch extends word by word: its windows are compared one by
  one, again as sorted rows. (A later document with an equal stretch is settled.)

Both kinds of rows are judged inside each block of texts (about 1 MB) first. A block
sends the task of an anchor at most the smallest document of two stretches, and the
task of a window its smallest document, however common they are; rows it has settled
go through the same exchange dealt out by document.

Overlapping matched windows join into maximal repeats; every kept one has at least
``window`` words. All hashes compared together have 128 bits.

Texts are shuffled once, by document id; both later joins read the same exchange.
Defined cases: a null text has no words. A null id counts as larger than any id.
Rows with the same id are one document: they never remove each other's words.
Texts shorter than the window are kept whole. Other columns pass through; input
columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from reasonscope.llm.common import append, blocks, extended, utf8, without
from reasonscope.llm.wordhash import Words, mix, range_sums

WINDOW = 13
ANCHOR = 4
_LAST = 2**63 - 1
_SIG_BASE = 0xC2B2AE3D27D4EB4F
_RESULTS = ("n_words", "n_removed", "kept_text")
_ROWS = "a long, b long, _key long, state byte"
OPEN, REPEAT, ASKED = np.int8(0), np.int8(1), np.int8(2)


def _anchors(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the rightmost minimum of h[i:i+span] for each i."""
    value, place, have = h, np.arange(len(h)), 1
    while have < span:
        step = min(have, span - have)
        a, b = slice(0, len(value) - step), slice(step, len(value))
        right = value[b] <= value[a]
        value, place = np.where(right, value[b], value[a]), np.where(right, place[b], place[a])
        have += step
    return place


class _Stretches:
    """Stretches of a block: ``anchor`` and ``sig`` (64-bit hashes), ``doc``, and
    the half-open range ``first``..``last`` of the window starts they hold."""

    def __init__(self, words: Words, window: int):
        n = len(words) - window + 1
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.doc = empty
        self.anchor = self.sig = empty.astype(np.uint64)
        if n < 1:
            return
        whole = words.doc[:n] == words.doc[window - 1:]
        if not whole.any():
            return
        h = words.hashes[0]
        gram = np.zeros(len(h) - ANCHOR + 1, np.uint64)
        for j in range(ANCHOR):
            gram += h[j: len(h) - ANCHOR + 1 + j] * np.uint64(2 * j * j + 6 * j + 3)
        gram = mix(gram)
        place = _anchors(gram, window - ANCHOR + 1)
        change = np.ones(n, bool)
        change[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
        first = np.flatnonzero(change & whole)
        ends = np.flatnonzero(np.append(change[1:] | ~whole[1:], True) & whole)
        self.first, self.last = first, ends + 1
        self.doc = words.doc[first]
        spot = place[first]
        self.anchor = gram[spot]
        content = range_sums(words.hashes[1], _SIG_BASE, first, ends + window)
        self.sig = mix(content + mix((spot - first).astype(np.uint64) * np.uint64(64)
                                     + (self.last - first).astype(np.uint64)))


def _sent_rows(a: np.ndarray, b: np.ndarray, keys: np.ndarray, ask: bool) -> pa.RecordBatch:
    """The rows (a, b, _key, state) of a block, each once, judged as far as the block
    can: rows whose (a, b) a smaller document of the block has are ``REPEAT``. With
    ``ask``, the first rows of an ``a``'s third and further ``b`` are ``ASKED``: the
    first two tell the task of ``a`` that there are several. All others are ``OPEN``."""
    order = np.lexsort((keys, b, a))
    a, b, keys = a[order], b[order], keys[order]
    new_a, new_b, new = np.ones(len(a), bool), np.ones(len(a), bool), np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_b[1:] = new_a[1:] | (b[1:] != b[:-1])
    new[1:] = new_b[1:] | (keys[1:] != keys[:-1])
    state = np.where(new_b, OPEN, REPEAT).astype(np.int8)
    if ask:
        nth = np.cumsum(new_b)
        nth -= nth[np.flatnonzero(new_a)][np.cumsum(new_a) - 1] if len(a) else 0
        state[new_b & (nth > 1)] = ASKED
    return pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64)), pa.array(keys[new]),
                                       pa.array(state[new])], names=["a", "b", "_key", "state"])


def _seed_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("_key").to_numpy(), utf8(batch.column(1))
            for b, e in blocks(texts):
                s = _Stretches(Words(texts[b:e], versions=2), window)
                yield _sent_rows(s.anchor, s.sig, keys[b:e][s.doc], True)
    return run


def _later(batches: Iterator[pa.RecordBatch], ask: bool) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (a, b, _key): the rows whose (a, b) a smaller document
    also has (``whole``). With ``ask``, also the first row of each (a, b) whose
    ``a`` has several ``b``, to be extended window by window (``whole`` false).
    Rows judged in their block pass through."""
    prev = None  # the last row's a, b and least key; the first b's row until a second b comes
    pending = None
    for batch in batches:
        a, b, k, state = (batch.column(c).to_numpy() for c in ("a", "b", "_key", "state"))
        done, still = state != OPEN, state == OPEN
        out_a, out_b, out_k, out_w = [a[done]], [b[done]], [k[done]], [state[done] == REPEAT]
        a, b, k = a[still], b[still], k[still]
        if len(a):
            new_a, new_b = np.ones(len(a), bool), np.ones(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            new_b[1:] = new_a[1:] | (b[1:] != b[:-1])
            if prev is not None:
                new_a[0] = a[0] != prev[0]
                new_b[0] = new_a[0] or b[0] != prev[1]
            at = np.flatnonzero(new_b)
            group = np.cumsum(new_b) - 1
            least = np.append(k[at], 0)[group]
            least[group < 0] = prev[2] if prev is not None else 0
            repeat = k > least
            out_a.append(a[repeat]), out_b.append(b[repeat]), out_k.append(k[repeat])
            out_w.append(np.ones(int(repeat.sum()), bool))
            if ask:
                more = new_b & ~new_a                       # a further b of its a: asked for
                follow = np.zeros(len(at), bool)            # a first b with another behind it
                follow[:-1] = more[at[1:]]
                wanted = at[more[at] | follow]
                if pending is not None and len(at) and more[at[0]]:
                    out_a.append(np.array([pending[0]])), out_b.append(np.array([pending[1]]))
                    out_k.append(np.array([pending[2]])), out_w.append(np.zeros(1, bool))
                out_a.append(a[wanted]), out_b.append(b[wanted]), out_k.append(k[wanted])
                out_w.append(np.zeros(len(wanted), bool))
                if len(at):
                    pending = (a[at[-1]], b[at[-1]], k[at[-1]]) if new_a[at[-1]] else None
            prev = (a[-1], b[-1], least[-1])
        columns = [np.concatenate(x) for x in (out_a, out_b, out_k, out_w)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "_key", "whole"])


def _stretch_verdicts(batches):
    return _later(batches, True)


def _window_verdicts(batches):
    return _later(batches, False)


def _members(batch: pa.RecordBatch, column: str, rows: range, docs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether (a[i], b[i]) is in the list ``column`` holds for text docs[i]."""
    lists = batch.column(column).slice(rows.start, len(rows))
    size = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
    if not size.sum() or not len(a):
        return np.zeros(len(a), bool)
    pairs = lists.flatten()
    owner = np.repeat(np.arange(len(rows)), size)
    kind = np.dtype([("d", np.int64), ("a", np.int64), ("b", np.int64)])
    have, want = np.empty(len(owner), kind), np.empty(len(a), kind)
    have["d"], have["a"], have["b"] = owner, pairs.field("a").to_numpy(zero_copy_only=False), pairs.field("b").to_numpy(zero_copy_only=False)
    want["d"], want["a"], want["b"] = docs, a.view(np.int64), b.view(np.int64)
    _, code = np.unique(np.concatenate([have, want]), return_inverse=True)
    known = np.zeros(int(code.max()) + 1, bool)
    known[code[: len(have)]] = True
    return known[code[len(have):]]


def _window_rows(window: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = np.flatnonzero(batch.column("_asked").is_valid().to_numpy(zero_copy_only=False))
            batch = batch.take(pa.array(asked))
            keys, texts = batch.column("_key").to_numpy(), utf8(batch.column(text_col))
            for b, e in blocks(texts):
                words = Words(texts[b:e], versions=2)
                s = _Stretches(words, window)
                hit = _members(batch, "_asked", range(b, e), s.doc, s.anchor, s.sig)
                if not hit.any():
                    continue
                at = _spans(s.first[hit], s.last[hit], len(words))
                _, wa, wb = _hashed_windows(words, window)
                yield _sent_rows(wa[at], wb[at], keys[b:e][words.doc[at]], False)
    return run


def _spans(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """The positions inside any [first, last)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, last, -1)
    return np.flatnonzero(np.cumsum(depth)[:n] > 0)


def _hashed_windows(words: Words, window: int):
    """Two hashes for each window start (zero where no window starts)."""
    n = len(words)
    out = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    for v in (0, 1):
        at, h = words.windows(window, v)
        out[v][at] = h
    whole = np.zeros(n, bool)
    whole[words.windows(window, 0)[0]] = True
    return whole, out[0], out[1]


def _removal(window: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(text_col))
            n_words, n_removed, kept = [], [], []
            found = {c: batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("_whole", "_single")}
            touched = found["_whole"] | found["_single"]
            for b, e in blocks(texts):
                if not touched[b:e].any():
                    lists = [t.split() for t in texts[b:e]]
                    n_words += map(len, lists)
                    n_removed += [0] * len(lists)
                    kept += map(b" ".join, lists)
                    continue
                words = Words(texts[b:e], versions=2)
                s = _Stretches(words, window)
                hit = _members(batch, "_whole", range(b, e), s.doc, s.anchor, s.sig)
                first, last = s.first[hit], s.last[hit]
                if found["_single"][b:e].any():
                    whole, wa, wb = _hashed_windows(words, window)
                    at = np.flatnonzero(whole & found["_single"][b:e][words.doc])
                    at = at[_members(batch, "_single", range(b, e), words.doc[at], wa[at], wb[at])]
                    first, last = np.concatenate([first, at]), np.concatenate([last, at + 1])
                gone = np.zeros(len(words), bool)
                gone[_spans(first, last + window - 1, len(words))] = True
                total = np.bincount(words.doc, minlength=e - b)
                lost = np.bincount(words.doc, weights=gone, minlength=e - b).astype(np.int64)
                all_words, ends = words.word_list(), np.cumsum(total)
                for i in range(e - b):
                    own = slice(int(ends[i] - total[i]), int(ends[i]))
                    own_words = all_words[own]
                    if lost[i]:
                        own_words = [all_words[j] for j in (np.flatnonzero(~gone[own]) + own.start).tolist()]
                    kept.append(b" ".join(own_words))
                n_words += total.tolist()
                n_removed += lost.tolist()
            keep = [i for i, c in enumerate(batch.schema.names) if c not in ("_key", "_whole", "_asked", "_single")]
            yield append(batch.select(keep), n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()),
                         kept_text=pa.array(kept, pa.binary()).cast(pa.string()))
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (the kept words
    joined by one space)."""
    source = without(docs, (*_RESULTS, "_key", "_whole", "_asked", "_single"))
    texts = source.withColumn("_key", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)))
    seeds = texts.select("_key", text_col).mapInArrow(_seed_rows(window), _ROWS)

    def verdicts(rows: DataFrame, judge) -> DataFrame:
        # rows judged in their block are spread by document, not sent to the task of a
        place = F.when(F.col("state") == int(OPEN), F.col("a")).otherwise(F.col("_key"))
        return rows.repartition(place).sortWithinPartitions("a", "b", "_key").mapInArrow(
            judge, "a long, b long, _key long, whole boolean")

    def pairs(condition: Column) -> Column:
        found = F.collect_set(F.when(condition, F.struct("a", "b")))
        return F.when(F.size(found) > 0, found)

    lists = verdicts(seeds, _stretch_verdicts).groupBy("_key").agg(
        pairs(F.col("whole")).alias("_whole"), pairs(~F.col("whole")).alias("_asked"))
    # both consumers take this join with all its columns, so its two exchanges are made once
    joined = texts.join(lists.hint("shuffle_hash"), "_key", "left")
    singles = verdicts(joined.mapInArrow(_window_rows(window, text_col), _ROWS), _window_verdicts)
    found = singles.groupBy("_key").agg(pairs(F.col("whole")).alias("_single"))
    schema = extended(source.schema, StructField("n_words", LongType()), StructField("n_removed", LongType()),
                      StructField("kept_text", StringType()))
    return joined.join(found.hint("shuffle_hash"), "_key", "left").mapInArrow(_removal(window, text_col), schema)
