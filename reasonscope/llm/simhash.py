"""SimHash near-dedup by anchor-point covering.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of
the text's 3-word shingles (lower-cased A-Z, repeats included). Fingerprints that
differ in at most ``MAX_BITS`` (3) bits are linked; components are the classes of
linked fingerprints.

Covering: two fingerprints at most 3 bits apart differ in at most 1 bit in one of
their 32-bit halves. The anchors of a half are the words of a covering code, the
Hamming(31,26) code with one free bit: every 32-bit word is within 1 bit (the
covering radius) of an anchor. Each fingerprint is copied to every anchor within
1 + 1 = 2 bits of each half (17 at most), so a linked pair meets at the anchor that
is nearest to either of the two, among 2 x 2**27 anchors.

Only distinct fingerprints are copied. Anchors with over ``HOT`` fingerprints are
found by a count and dealt out further by each byte of the other half (a linked
pair agrees in at least one of its four bytes); (anchor, byte) groups still over
``HOT`` once more by each six bits of the other half's remaining 24 (a linked pair
agrees in at least one of these four groups). A task's group is then of one anchor,
one byte and six bits at least. An anchor's task finds the classes
of its fingerprints by growing them and emits one link for each further member,
never all pairs. Classes are joined over anchors by alternating star steps, each
of which is checkpointed.

Defined cases: a null text counts as empty; an empty text has fingerprint zero,
which is linked like any other. A null id counts as larger than any id; a class
without any id has a null component_id. Repeated rows share a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reasonscope.llm.common import append, cut_lineage, utf8, without

SHINGLE = 3
MAX_BITS = 3
HOT = 4096
SPLIT = 64
_LAST = 2**63 - 1
_HALF = np.uint64(0xFFFFFFFF)
_FREE = np.uint64(1 << 31)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i: i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(text_col: str, shingle: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in utf8(batch.column(text_col))], np.uint64)
            if not keep_text:
                batch = batch.select([c for c in batch.schema.names if c != text_col])
            yield append(batch, fp=pa.array(prints.view(np.int64)))
    return run


def _masks() -> list[np.ndarray]:
    """For each syndrome of the Hamming(31,26) code: the changes of at most two
    bits (of 32, bit 31 being free) that lead to a code word."""
    out = []
    for syndrome in range(32):
        found = [0, 1 << 31] if syndrome == 0 else [1 << (syndrome - 1), (1 << (syndrome - 1)) | (1 << 31)]
        for i in range(1, 32):
            j = i ^ syndrome
            if syndrome and i < j:
                found.append((1 << (i - 1)) | (1 << (j - 1)))
        out.append(np.array(found, np.uint64))
    return out


_MASKS = _masks()


def _syndromes(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.uint64)
    for i in range(1, 32):
        out ^= ((half >> np.uint64(i - 1)) & np.uint64(1)) * np.uint64(i)
    return out


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, fp) for every anchor in reach of either half."""
    for batch in batches:
        prints = batch.column("fp").to_numpy().view(np.uint64)
        for side, half in enumerate((prints & _HALF, prints >> np.uint64(32))):
            syndrome = _syndromes(half)
            for s in range(32):
                at = np.flatnonzero(syndrome == s)
                if not len(at):
                    continue
                anchors = (half[at][:, None] ^ _MASKS[s][None, :]) | np.uint64(side << 32)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.ravel().view(np.int64)),
                                                  pa.array(np.repeat(prints[at], len(_MASKS[s])).view(np.int64))], names=["anchor", "fp"])


def _classes(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member) that join linked fingerprints."""
    members, firsts, left = [], [], prints
    while len(left) > 1:
        first, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for one in front:
                near |= np.bitwise_count(left ^ one) <= max_bits
            front, left = left[near], left[~near]
            members.append(front)
            firsts.append(np.full(len(front), first))
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *members]), np.concatenate([empty, *firsts])


def _links(max_bits: int):
    """Over rows sorted by the key columns: the links of each run of one key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def close() -> pa.RecordBatch | None:
            if sum(map(len, held)) < 2:
                return None
            a, b = _classes(np.unique(np.concatenate(held)), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            anchor, part, prints = (batch.column(c).to_numpy() for c in ("anchor", "part", "fp"))
            if not len(anchor):
                continue
            prints = prints.view(np.uint64)
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            edges = np.concatenate([[0], cuts, [len(anchor)]])
            if held_key != (anchor[0], part[0]):
                if (out := close()) is not None:
                    yield out
                held = []
            for b, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b:
                    if (out := close()) is not None:
                        yield out
                    held = []
                held.append(prints[b:e])
            held_key = (anchor[-1], part[-1])
        if (out := close()) is not None:
            yield out
    return run


def _dealt_again(dealt: DataFrame, other: Column, hot: int) -> DataFrame:
    """Rows of crowded anchors, those of (anchor, byte) groups over ``hot`` dealt out by
    each six of the other half's 24 bits beside the byte."""
    crowded = dealt.groupBy("anchor", "part").count().where(F.col("count") > hot).select("anchor", "part", F.lit(True).alias("hot"))
    byte = F.shiftright("part", 8)
    rest = reduce(lambda out, i: out.when(byte == i, F.shiftleft(F.shiftright(other, 8 * i + 8), 8 * i).bitwiseOR(
        other.bitwiseAND(F.lit((1 << 8 * i) - 1)))), range(1, 4), F.when(byte == 0, F.shiftright(other, 8)))
    parts = F.array(*[(F.col("part") * 256 + 1024 + 64 * i).cast("int") + F.shiftright(rest, 6 * i).bitwiseAND(F.lit(63)).cast("int")
                      for i in range(4)])
    return dealt.join(crowded, ["anchor", "part"], "left").select(
        "anchor", "fp", F.explode(F.when(F.col("hot"), parts).otherwise(F.array("part"))).alias("part"))


def _links_of(prints: DataFrame, max_bits: int, hot: int) -> DataFrame:
    rows = prints.select("fp").mapInArrow(_anchor_rows, "anchor long, fp long")
    crowded = rows.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("hot"))
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    other = F.when(F.shiftright("anchor", 32) == 0, high).otherwise(low)
    parts = F.array(*[(F.shiftright(other, 8 * i).bitwiseAND(F.lit(255)) + 256 * i).cast("int") for i in range(4)])
    dealt = rows.join(crowded, "anchor", "left").select(
        "anchor", "fp", F.explode(F.when(F.col("hot"), parts).otherwise(F.array(F.lit(-1)))).alias("part"))
    dealt = dealt.where(F.col("part") < 0).unionAll(_dealt_again(dealt.where(F.col("part") >= 0), other, hot))
    return dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_links(max_bits), "u long, v long")


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (u, v), by alternating large-star
    and small-star steps until nothing changes. The neighbours of a node are dealt out in
    ``SPLIT`` parts, so the root of a large component doesn't gather them in one task."""
    def both(e: DataFrame) -> DataFrame:
        return e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # a hub's neighbours lie in up to SPLIT parts: the least of each part, of all parts, and back to the parts
        near = near.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SPLIT)))
        parts = near.groupBy("u", "s").agg(F.min("v").alias("m"))
        least = parts.groupBy("u").agg(F.least("u", F.min("m")).alias("m"))
        linked = near.join(parts.select("u", "s").join(least, "u"), ["u", "s"])
        if large:
            out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
                least.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = cut_lineage(links.where(F.col("u") != F.col("v")).distinct())
    before = None
    while (now := mark(edges)) != before:
        before = now
        edges = cut_lineage(star(star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rows(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    key = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key"),
                      F.xxhash64(F.col(text_col).cast("string")).alias("digest"), F.col(text_col).cast("string").alias("text"))
    schema = "key long, digest long, fp long"
    return cut_lineage(key.mapInArrow(_fingerprints("text", shingle, False), schema))


def _components(rows: DataFrame, max_bits: int, hot: int) -> DataFrame:
    """``(fp, root)``: the class of every distinct fingerprint."""
    prints = rows.select("fp").distinct()
    roots = connected(_links_of(prints, max_bits, hot))
    return prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: the id, ``fp`` (signed 64 bits) and
    ``component_id``, the smallest id of its component."""
    rows = _rows(docs, id_col, text_col, shingle)
    least = rows.groupBy("fp").agg(F.min("key").alias("key"))  # before the join: a class's copies are one row
    classes = _components(rows, max_bits, hot)
    ids = least.join(classes, "fp").groupBy("root").agg(F.min("key").alias("component_id"))
    labels = cut_lineage(classes.join(ids, "root").select("fp", "component_id"))
    no_null = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    return rows.join(labels, "fp").select(no_null("key").alias(id_col), "fp", no_null("component_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of repeated
    rows, one)."""
    rows = _rows(docs, id_col, text_col, shingle)
    first = rows.groupBy("fp").agg(F.min(F.struct("key", "digest")).alias("first"))
    kept = first.join(_components(rows, max_bits, hot), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = cut_lineage(kept.select("first.*").withColumnsRenamed({"key": "_key", "digest": "_digest"}).distinct())
    keyed = without(docs, ("_key", "_digest", "_rank")).withColumns({
        "_key": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), "_digest": F.xxhash64(F.col(text_col).cast("string"))})
    one = Window.partitionBy("_key", "_digest").orderBy(F.lit(1))
    return keyed.join(kept, ["_key", "_digest"], "left_semi").withColumn("_rank", F.row_number().over(one)).where(
        F.col("_rank") == 1).drop("_key", "_digest", "_rank")
