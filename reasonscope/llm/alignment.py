"""Cross-tokenizer alignment by interval coalescing.

Each text, with a space in front, is encoded by tokenizer A (a byte-level BPE file)
and by tokenizer B (a sentencepiece model, which adds the space itself). All tokens
are byte intervals. They are sorted by start (``lexsort``) and the running maximum of
their ends is taken: a group ends where a start reaches it. Within a group every A token is
linked to the B tokens whose interval overlaps its own.

How often each pair of ids is linked in the whole corpus is counted by blocks of texts
(about ``BLOCK`` bytes): one row per block and distinct pair, summed by Spark. The totals,
and whether a pair is the most frequent of its B id, go back to the blocks that asked for
the pair, again one row per block and pair, so a pair that is everywhere has one row per block
at most. What the blocks hold lies in the shared folder between these jobs, so no text
is encoded twice. Texts over ``SEGMENT`` characters are aligned segment by
segment and may lie in several blocks.

Encoding: a space between two characters that aren't white space begins a new stretch.
No match of A's pattern crosses it, and no piece of B has a space behind another
character (checked when the model is loaded; else a text is one stretch). So the ids
of a stretch depend on nothing else: each distinct one is encoded by the libraries once
(new ones below U+0530 together, A's through its rank table, which gives the same ids),
and kept up to ``MEMO`` stretches (then the memo starts anew). Both tokenizers
end a token at such a place, so groups never cross it.

Defined cases: texts that are null or empty, or have a stretch whose A or B tokens don't
give back its bytes (one with U+2581, say), have no tokens: zeros and an empty digest. Special strings in
texts are ordinary text. Null and repeated ids are kept as rows of their own. Other
columns are carried without the text; added columns replace those of the same name. A
stretch without a seam (a text without spaces) is encoded in one piece.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from reasonscope.llm.bpe import _seam_after, vocabulary_ranks
from reasonscope.llm.common import extended, without, working_folder
from reasonscope.llm.packing import SCRIPTS
from reasonscope.session import ship_package

MEMO = 1 << 18
SEGMENT = 1 << 20
BLOCK = 1 << 22
_SEAM = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[tuple, "Pairer"] = {}
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class _Lists:
    """Growing list of id lists in two flat arrays."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.number = np.zeros(1 << 14, np.int64), 0

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(array):
            return array
        grown = np.zeros(max(2 * len(array), used + more), array.dtype)
        grown[:used] = array[:used]
        return grown

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used, len(flat))
        self.flat[self.used: self.used + len(flat)] = flat
        self.starts = self._room(self.starts, self.number + 1, len(sizes))
        self.starts[self.number + 1: self.number + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.number += len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists ``which`` one behind the other, and their lengths."""
        begin = self.starts[which]
        size = self.starts[which + 1] - begin
        shift = np.repeat(begin - np.cumsum(size) + size, size)
        return self.flat[np.arange(int(size.sum())) + shift], size


class Pairer:
    """The two tokenizers, their ids' byte lengths and the stretches encoded so far."""

    def __init__(self, path_a: str, path_b: str, pattern: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.special = [t.content for t in self.a.get_added_tokens_decoder().values()]
        ranks = vocabulary_ranks(path_a)
        self.fast = tiktoken.Encoding("stretches", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.size_a, self.size_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.bytes_a = np.zeros(self.size_a, np.int64)
        self.bytes_a[list(vocabulary.values())] = [len(t) for t in vocabulary]  # one printable character per byte
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = np.array([1 if self.b.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(pieces)])
        self.first_a = np.zeros(self.size_a, bool)
        self.first_a[[i for t, i in ranks.items() if t[0] == 32]] = True
        self.first_b = np.array([p.startswith("▁") for p in pieces])
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.names = [np.array([f"{sep}{i}".encode() for sep in ("", ";", "|", ",") for i in range(n)], object)
                      for n in (self.size_a, self.size_b)]
        self.limit = memo
        self.renew()

    def renew(self) -> None:
        """Index of each stretch kept; -1: white space at an end, no stretch of its own;
        -2: it doesn't come back. Pieces between spaces, and stretches of other texts."""
        self.pieces: dict[str, int] = {}
        self.others: dict[str, int] = {}
        self.lists = _Lists(), _Lists()

    def _simple(self, stretches: list[str]) -> tuple[np.ndarray, ...]:
        """Both tokenizers' ids, and their number by stretch, of stretches without a space:
        encoded as one text, in which only the first token of each begins with a space."""
        ids_a = np.array(self.fast.encode_ordinary("".join(" " + s for s in stretches)), np.int32)
        ids_b = np.array([i for at in range(0, len(stretches), 256) for i in self.b.encode(" ".join(stretches[at: at + 256]))], np.int32)
        sizes = [np.diff(np.append(np.flatnonzero(first[ids]), len(ids))) for first, ids in ((self.first_a, ids_a), (self.first_b, ids_b))]
        return ids_a, ids_b, *sizes

    def _any(self, stretches: list[str]) -> tuple[np.ndarray, ...]:
        encoded = ([e.ids for e in self.a.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)],
                   self.b.encode(stretches, num_threads=1))
        return (*[np.fromiter((i for one in many for i in one), np.int32) for many in encoded],
                *[np.array(list(map(len, many)), np.int64) for many in encoded])

    def _plain(self, text: str) -> bool:
        return max(text, default="") < SCRIPTS and not any(s in text for s in self.special)

    def _add(self, memo: dict[str, int], stretches: list[str]) -> None:
        for at in range(0, len(stretches), 4096):
            part = stretches[at: at + 4096]
            if memo is self.pieces:
                plain = [True] * len(part) if self._plain(" ".join(part)) else list(map(self._plain, part))
            else:
                plain = [False] * len(part)
            for encode, chosen in ((self._simple, [s for s, p in zip(part, plain) if p]), (self._any, [s for s, p in zip(part, plain) if not p])):
                if not chosen:
                    continue
                *flat, size_a, size_b = encode(chosen)
                fine = np.array(["\u2581" not in s for s in chosen])
                lengths = np.array([1 + len(s.encode()) for s in chosen])
                for ids, size, width in zip(flat, (size_a, size_b), (self.bytes_a, self.bytes_b)):
                    total, end = np.append(0, np.cumsum(width[ids])), np.cumsum(size)
                    fine &= total[end] - total[end - size] == lengths
                first = self.lists[0].number
                memo.update(zip(chosen, np.where(fine, first - 1 + np.cumsum(fine), -2).tolist()))
                for lists, ids, size in zip(self.lists, flat, (size_a, size_b)):
                    lists.extend(ids[np.repeat(fine, size)], size[fine])

    def _new(self, memo: dict[str, int], many: list[list[str]]) -> list[str]:
        return list({s for parts in many for s in parts if s not in memo})

    def stretches(self, texts: list[str]) -> list[list[int]]:
        """The indexes of each text's stretches."""
        split = [t.split(" ") if t else [] for t in texts]
        found: list[list[int]] = [[-1]] * len(texts)
        if self.cuts:
            new = self._new(self.pieces, split)
            ends = {s for s in new if not s or s[0].isspace() or s[-1].isspace()}
            self.pieces.update(dict.fromkeys(ends, -1))
            self._add(self.pieces, [s for s in new if s not in ends])
            found = [list(map(self.pieces.__getitem__, parts)) for parts in split]
        again = [i for i, f in enumerate(found) if -1 in f and texts[i]]
        split = [_SEAM.split(texts[i]) if self.cuts else [texts[i]] for i in again]
        self._add(self.others, self._new(self.others, split))
        for i, parts in zip(again, split):
            found[i] = list(map(self.others.__getitem__, parts))
        return [f if t else [] for f, t in zip(found, texts)]

    def full(self) -> bool:
        return len(self.pieces) + len(self.others) > self.limit


class Piece:
    """What is known so far of one text."""

    def __init__(self, row: int):
        self.row, self.counts, self.codes, self.digest = row, np.zeros(4, np.int64), [], None


def segments(text: str, size: int) -> Iterator[str]:
    """A text cut at seams, about ``size`` characters each; the space at a cut goes."""
    low = 0
    while low < len(text):
        cut = _seam_after(text, low + size, len(text)) if len(text) - low > size else None
        yield text[low:cut]
        low = len(text) if cut is None else cut + 1


def align(pairer: Pairer, texts: list[list[int]]) -> tuple[np.ndarray, list[np.ndarray], list[list[bytes]]]:
    """For texts given by their stretches: rows of (A tokens, B tokens, groups, links);
    the linked pairs' codes, A id * B ids + B id, in order; the groups written out, in parts."""
    sizes = np.array([len(t) for t in texts])
    which = np.fromiter((i for t in texts for i in t), np.int64, int(sizes.sum()))
    ids, starts, ends, docs = [], [], [], []
    owner = np.repeat(np.arange(len(texts)), sizes)
    for lists, width in zip(pairer.lists, (pairer.bytes_a, pairer.bytes_b)):
        own, count = lists.take(which)
        end = np.cumsum(width[own])
        ids.append(own), ends.append(end), starts.append(end - width[own]), docs.append(np.repeat(owner, count))
    start, end = np.concatenate(starts), np.concatenate(ends)
    kind = np.repeat(np.array([0, 1], np.int8), [len(ids[0]), len(ids[1])])
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    opens = np.append(True, start[order][1:] >= reach[:-1])[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens)
    doc = np.concatenate(docs)
    # links: of each A token, the B tokens from the first that ends behind its start to the last that starts before its end
    low = np.searchsorted(ends[1], starts[0], side="right")
    count = np.searchsorted(starts[1], ends[0], side="left") - low
    at = np.arange(int(count.sum())) + np.repeat(low - np.cumsum(count) + count, count)
    code = np.repeat(ids[0].astype(np.int64) * pairer.size_b, count) + ids[1][at]
    number = len(texts)
    counts = np.column_stack([np.bincount(docs[0], minlength=number), np.bincount(docs[1], minlength=number),
                              np.bincount(doc[order][opens], minlength=number), np.bincount(docs[0], count, number).astype(np.int64)])
    # groups in order, in each the A ids before the B ids
    place = np.argsort(2 * group + kind, kind="stable")
    key = (2 * group + kind)[place]
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    begins = np.append(True, doc[place][1:] != doc[place][:-1])[: len(key)]
    sign = np.where(fresh, np.where(kind[place] == 1, 2, np.where(begins, 0, 1)), 3)
    token = np.concatenate(ids)[place]
    written = np.empty(len(place), object)
    for k in (0, 1):
        own = kind[place] == k
        written[own] = pairer.names[k][sign[own] * (pairer.size_a, pairer.size_b)[k] + token[own]]
    cuts = np.cumsum(np.bincount(doc, minlength=number))[:-1]
    return counts, np.split(code, np.cumsum(counts[:, 3])[:-1]), [w.tolist() for w in np.split(written, cuts)]


class _Blocks:
    """Aligns the texts of one partition and yields their blocks' rows."""

    def __init__(self, pairer: Pairer, carried: list[str], schema: pa.Schema, segment: int, block: int):
        context = TaskContext.get()
        self.base = (context.partitionId() if context else 0) << 40
        self.pairer, self.carried, self.schema, self.segment, self.block = pairer, carried, schema, segment, block
        self.rows = self.blocks = 0

    def _aligned(self, pieces: list[Piece], texts: list[list[int]]) -> None:
        for piece, counts, codes, written in zip(pieces, *align(self.pairer, texts)):
            if piece.digest is None and written:
                piece.digest = hashlib.sha256()
            elif written:
                written[0] = b";" + written[0]
            if written:
                piece.digest.update(b"".join(written))
            piece.counts += counts
            piece.codes.append(codes)

    def _comes_back(self, text: str) -> bool:
        return all(-2 not in self.pairer.stretches([s])[0] for s in segments(text, self.segment))

    def _settle(self, pieces: list[Piece], texts: list[str]) -> None:
        """Align texts of ``segment`` characters at most."""
        found = [(p, f) for p, f in zip(pieces, self.pairer.stretches(texts)) if f and -2 not in f]
        if found:
            self._aligned(*map(list, zip(*found)))
        if self.pairer.full():
            self.pairer.renew()

    def of_batch(self, batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
        done: list[tuple[Piece, bool]] = []   # of this block; whether the text ends here
        pieces: list[Piece] = []
        texts: list[str] = []
        held = size = 0
        for row, text in enumerate(batch.column(text_col).cast(pa.large_string()).to_pylist()):
            piece = Piece(row)
            if text and len(text) <= self.segment:
                pieces.append(piece), texts.append(text)
                size += len(text)
            elif text and self._comes_back(text):
                for part in segments(text, self.segment):
                    self._settle([piece], [part])
                    held += len(part)
                    if held >= self.block:
                        self._settle(pieces, texts)
                        pieces, texts, size = [], [], 0
                        yield self._rows(batch, [*done, (piece, False)])
                        done, held, digest = [], 0, piece.digest
                        piece = Piece(row)
                        piece.digest = digest
            done.append((piece, True))
            if size >= min(self.segment, self.block):
                self._settle(pieces, texts)
                held += size
                pieces, texts, size = [], [], 0
            if held >= self.block:
                self._settle(pieces, texts)
                pieces, texts, size = [], [], 0
                yield self._rows(batch, done)
                done, held = [], 0
        self._settle(pieces, texts)
        if done:
            yield self._rows(batch, done)
        self.rows += batch.num_rows

    def _rows(self, batch: pa.RecordBatch, done: list[tuple[Piece, bool]]) -> pa.RecordBatch:
        """A row for each piece, its links as places in the block's list of pairs, and one with that list."""
        codes = [np.concatenate(p.codes) if p.codes else np.zeros(0, np.int64) for p, _ in done]
        pairs, place, count = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        place = place.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
        cuts = np.cumsum([0, *map(len, codes)]) * place.itemsize
        raw, n = place.tobytes(), len(done)
        source = batch.select(self.carried).take(pa.array([p.row if last else None for p, last in done] + [None], pa.int64()))
        own = {
            "_row": pa.array([self.base + self.rows + p.row for p, _ in done] + [None], pa.int64()),
            "_block": pa.array([self.base + self.blocks] * (n + 1), pa.int64()),
            **{c: pa.array([int(p.counts[i]) for p, _ in done] + [None], pa.int64()) for i, c in enumerate(SUMS[:4])},
            "groups_sha256": pa.array([(p.digest.hexdigest() if p.digest else "") if last else None for p, last in done] + [None], pa.string()),
            "_links": pa.array([raw[b:e] for b, e in zip(cuts, cuts[1:])] + [None], pa.binary()),
            "_width": pa.array([place.itemsize] * (n + 1), pa.int64()),
            "_pairs": pa.array([None] * n + [pairs], pa.list_(pa.int64())),
            "_counts": pa.array([None] * n + [count], pa.list_(pa.int64())),
        }
        self.blocks += 1
        return pa.RecordBatch.from_arrays([*source.columns, *own.values()], names=[*self.carried, *own])


def _encode(paths: tuple[str, str, str, int], carried: list[str], text_col: str, segment: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _LOADED:
            _LOADED[paths] = Pairer(*paths)
        blocks = None
        for batch in batches:
            blocks = blocks or _Blocks(_LOADED[paths], carried, batch.schema, segment, block)
            if batch.num_rows:
                yield from blocks.of_batch(batch, text_col)
    return run


def _scored(carried: list[str]):
    """Each piece's links looked up in what its block got back."""
    def run(pieces: pa.Table, marks: pa.Table) -> pa.Table:
        counts, best = np.zeros(marks.num_rows, np.int64), np.zeros(marks.num_rows, np.int64)
        slot = marks.column("_slot").to_numpy()
        counts[slot], best[slot] = marks.column("_total").to_numpy(), marks.column("_best").to_numpy()
        sums, bests = [], []
        for links, width in zip(pieces.column("_links").to_pylist(), pieces.column("_width").to_pylist()):
            own = np.frombuffer(links, f"<u{width}")
            sums.append(int(counts[own].sum()))
            bests.append(int(best[own].sum()))
        out = pieces.select([*carried, "_row", *SUMS[:4], "groups_sha256"])
        return out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
    return run


def compare_tokenizers(docs: DataFrame, path_a: str, path_b: str, pattern: str, text_col: str = "text",
                       memo: int = MEMO, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """``docs`` without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum
    and groups_sha256."""
    spark = docs.sparkSession
    ship_package(spark)
    source = without(docs, (*SUMS, "groups_sha256", "_row", "_block", "_links", "_width", "_pairs", "_counts"))
    carried = [c for c in source.columns if c.lower() != text_col.lower()]
    long = LongType()
    kept = StructType([StructField(f.name, f.dataType) for f in source.schema.fields if f.name in carried])
    sums = [StructField(c, long) for c in SUMS]
    digest = StructField("groups_sha256", StringType())
    schema = extended(kept, StructField("_row", long), StructField("_block", long), *sums[:4], digest, StructField("_links", BinaryType()),
                      StructField("_width", long), StructField("_pairs", ArrayType(long)), StructField("_counts", ArrayType(long)))
    folder = working_folder(spark, "alignment")
    source.mapInArrow(_encode((path_a, path_b, pattern, memo), carried, text_col, segment, block), schema).write.parquet(f"{folder}/blocks")
    written = spark.read.schema(schema).parquet(f"{folder}/blocks")
    lists = written.where(F.col("_pairs").isNotNull())
    (lists.select(F.inline(F.arrays_zip(F.col("_pairs").alias("_pair"), F.col("_counts").alias("_n")))).toDF("_pair", "_n")
     .groupBy("_pair").agg(F.sum("_n").alias("_total")).write.parquet(f"{folder}/totals"))
    totals = spark.read.parquet(f"{folder}/totals")
    b_id = (F.col("_pair") % sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()).alias("_b")
    most = totals.groupBy(b_id).agg(F.max("_total").alias("_most"))
    known = totals.withColumn("_b", b_id).join(most, "_b").select("_pair", "_total", (F.col("_total") == F.col("_most")).cast("long").alias("_best"))
    asked = lists.select(F.col("_block").alias("_of"), F.posexplode("_pairs").alias("_slot", "_pair"))
    marks = asked.join(known, "_pair").select("_of", "_slot", "_total", "_best")
    pieces = written.where(F.col("_row").isNotNull()).drop("_pairs", "_counts")
    scored = pieces.groupBy("_block").cogroup(marks.groupBy("_of")).applyInArrow(
        _scored(carried), StructType([*kept.fields, StructField("_row", long), *sums[:4], digest, *sums[4:]]))
    first = [F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in carried]
    out = scored.groupBy("_row").agg(*first, *[F.sum(c).alias(c) for c in SUMS], F.max("groups_sha256").alias("groups_sha256"))
    return out.drop("_row")
