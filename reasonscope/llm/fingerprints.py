"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's five-word
shingles (lower-cased A-Z; a shorter text is one shingle), in ascending order, as
base64 of big-endian numbers. Sketches merge: the k smallest of two sketches'
hashes sketch both parts together. Two sketches estimate resemblance (the share of
the merged sketch that both hold), containment and distinct shingle counts.

``with_next`` pairs each document with the next one in descending id, streaming:
ids are dealt into ranges by approximate percentiles, the texts are shuffled once by
range (one partition each) and sorted, and each range's top row is copied to the
range before it. There is a range for every ``RANGE_BYTES`` of text; an id that many
rows hold (null included) gets ranges of its own, split by a hash of the text. The
driver holds some plain numbers per range, ``MAX_RANGES`` of them at most: beyond
``MAX_RANGES * RANGE_BYTES`` (4 TB) the ranges grow, and a range is streamed in any case.

Defined cases: a null text counts as empty and has an empty sketch; two empty
sketches have likeness 1, an empty and another one 0. Rows with equal ids are
ordered by a hash of their texts; null ids come last. Rows equal in id and text are
each other's next ones and lie in one range. A single document is its own next one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from reasonscope.llm.common import blocks, utf8
from reasonscope.llm.wordhash import Words, mix

K = 128
SHINGLE = 5
RANGE_BYTES = 1 << 26
MIN_RANGES, MAX_RANGES = 64, 1 << 16
_NONE = np.zeros(0, np.uint64)


def sketches(texts: list[bytes], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text."""
    out = []
    for b, e in blocks(texts):
        words = Words(texts[b:e], lower=True)
        at, hashes = words.windows(shingle)
        cuts = np.searchsorted(words.doc[at], np.arange(e - b + 1))
        ends = np.searchsorted(words.doc, np.arange(e - b + 1))
        for i in range(e - b):
            own = hashes[cuts[i]: cuts[i + 1]]
            if not len(own):
                few = words.hashes[0][ends[i]: ends[i + 1]]
                own = mix(np.array([sum(int(h) * (2 * j + 3) for j, h in enumerate(few)) % 2**64], np.uint64)) if len(few) else _NONE
            if len(own) > 4 * k:
                own = smallest(own, k)
            out.append(np.unique(own)[:k])
    return out


def smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes that hold the k smallest distinct ones (more are taken while repeats
    leave too few)."""
    take = 2 * k
    while take < len(hashes):
        part = np.partition(hashes, take)[:take]
        if len(np.unique(part)) >= k:
            return part
        take *= 4
    return hashes


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated distinct shingles: exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((int(a[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(union, a), b)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def written(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def _fingerprinted(text_col: str, k: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(utf8(batch.column(text_col)), k, shingle)
            rest = batch.select([c for c in batch.schema.names if c != text_col])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(map(written, found), pa.string()), pa.array([distinct(x, k) for x in found])],
                names=[*rest.schema.names, "fingerprint", "distinct_shingles"])
    return run


def fingerprint(docs: DataFrame, text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` and ``distinct_shingles``."""
    rest = [f for f in docs.schema.fields if f.name not in (text_col, "fingerprint", "distinct_shingles")]
    schema = StructType([*rest, StructField("fingerprint", StringType()), StructField("distinct_shingles", DoubleType())])
    return docs.select(*[f"`{f.name}`" for f in rest], text_col).mapInArrow(_fingerprinted(text_col, k, shingle), schema)


def merged(prints: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """The sketch of each group of fingerprints, as ascending ``hashes`` (written as
    16 hexadecimal digits): partial lists of k meet, never a whole group."""
    bits = F.hex(F.unbase64("fingerprint"))
    each = prints.select(*by, F.explode(F.regexp_extract_all(bits, F.lit("(.{16})"), F.lit(1))).alias("hash")).distinct()
    first = Window.partitionBy(*by).orderBy("hash")
    return each.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k).groupBy(*by).agg(
        F.sort_array(F.collect_list("hash")).alias("hashes"))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of the next."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_PAIRED = StructType([StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()),
                      StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()),
                      StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()),
                      StructField("edited_containment", DoubleType()), StructField("distinct_shingles", DoubleType())])


def _pairs(k: int, shingle: int):
    """Over rows sorted by (range, copy, id descending): each row with the next."""
    def rows(ids: list, texts: list[bytes], heads: list[bytes], own: list, following: list) -> pa.RecordBatch:
        changed = [edited(t.decode(), h.decode()).encode() for t, h in zip(texts, heads)]
        other = sketches(changed, k, shingle)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t.decode()) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array(map(written, own), pa.string()),
            pa.array(map(written, other), pa.string()), pa.array([resemblance(a, b, k) for a, b in zip(own, other)]),
            pa.array([resemblance(a, b, k) for a, b in zip(own, following)]),
            pa.array([containment(a, b, k) for a, b in zip(own, other)]), pa.array([distinct(a, k) for a in own])],
            schema=pa.schema([pa.field(f.name, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[
                f.dataType.typeName()]) for f in _PAIRED.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one
        for batch in batches:
            place, copy, ids = (batch.column(c).to_pylist() for c in ("_range", "_copy", "doc_id"))
            texts = utf8(batch.column("text"))
            for b, e in blocks(texts):
                found = sketches(texts[b:e], k, shingle)
                waiting = [held] if held is not None else []
                waiting += [(place[i], copy[i], ids[i], texts[i], found[i - b]) for i in range(b, e)]
                pairs = [(x, y) for x, y in zip(waiting, waiting[1:]) if x[0] == y[0] and not x[1]]
                if pairs:
                    yield rows([x[2] for x, _ in pairs], [x[3] for x, _ in pairs], [y[3] for _, y in pairs],
                               [x[4] for x, _ in pairs], [y[4] for _, y in pairs])
                held = waiting[-1]
    return run


class _Ranges:
    """Numbers of ranges, in ascending (id, digest reversed). ``cuts`` are ids in ascending
    order; an id listed n times makes n ranges of its own, told apart by digest."""

    def __init__(self, cuts: list[int]):
        values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        pieces = dict(zip(values.tolist(), times.tolist()))
        for v in values[times > 1].tolist():
            if v < 2**63 - 1:
                pieces.setdefault(v + 1, 1)
        self.starts = np.array(sorted(pieces), np.int64)
        self.pieces = np.array([1, *[pieces[v] for v in self.starts.tolist()]], np.int64)
        self.base = np.cumsum(self.pieces) - self.pieces
        self.total = int(self.pieces.sum())

    def of(self, key: np.ndarray, digest: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, key, side="right")
        share = (digest.astype(np.int64).view(np.uint64) ^ np.uint64(2**63)) >> np.uint64(32)
        piece = (share * self.pieces[at].astype(np.uint64)) >> np.uint64(32)
        return (self.base[at] + self.pieces[at] - 1 - piece.astype(np.int64)).astype(np.int32)


def range_count(docs: DataFrame, text_col: str = "text") -> int:
    """Ranges of about ``RANGE_BYTES`` of text each, ``MIN_RANGES`` at least."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("size")).first()["size"] or 0
    return min(max(MIN_RANGES, -(-size // RANGE_BYTES)), MAX_RANGES)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE,
              ranges: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (see
    ``edited``), and the likeness to it and to the next document's. ``ranges``
    follows the size of the texts if not given."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranges = ranges or range_count(source)
    source = source.withColumns({"_key": F.coalesce(F.col("doc_id"), F.lit(-(2**63))), "_digest": F.xxhash64("text")})
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = _Ranges(source.agg(F.percentile_approx("_key", shares, max(10000, 16 * ranges)).alias("cuts")).first()["cuts"] or [])

    @F.pandas_udf("int")
    def range_of(key: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series(cuts.of(key.to_numpy(), digest.to_numpy()), dtype="int32")

    ranged = source.withColumn("_range", range_of("_key", "_digest"))
    top = F.struct(F.col("_key"), (F.lit(-1) - F.col("_digest")).alias("_back"))
    tops = [(r["_range"], r["top"]["_key"], -1 - r["top"]["_back"]) for r in
            ranged.groupBy("_range").agg(F.max(top).alias("top")).orderBy(F.desc("_range")).collect()]  # one row per range
    if not tops:
        return ranged.limit(0).select("_range", F.lit(False).alias("_copy"), "doc_id", "text").mapInArrow(_pairs(k, shingle), _PAIRED)
    copies = [(key, digest, before) for (_, key, digest), (before, _, _) in zip(tops, [tops[-1], *tops[:-1]])]
    guests = source.sparkSession.createDataFrame(copies, "_key long, _digest long, _before int")
    own = F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_copy"))
    guest = F.struct(F.col("_before").alias("_range"), F.lit(True).alias("_copy"))
    dealt = ranged.join(F.broadcast(guests), ["_key", "_digest"], "left").select(
        "_key", "_digest", "doc_id", "text", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("_at"))
    # one range, one partition: a hash of the range's number would put several into one task
    dealt = dealt.select("_at.*", "doc_id", "text", "_key", "_digest").repartitionById(cuts.total, "_range").sortWithinPartitions(
        "_range", "_copy", F.desc("_key"), "_digest")
    return dealt.select("_range", "_copy", "doc_id", "text").mapInArrow(_pairs(k, shingle), _PAIRED)
