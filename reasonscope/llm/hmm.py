"""Hidden Markov language model over word classes.

Tokens are a text's words (A-Z lower-cased) and one end. The ``head`` most frequent
training tokens are classes of their own; every other token's class is a bucket of
its last three bytes. The model is p(class sequence) under a hidden Markov chain,
times p(token | class): 1 in the head, else (c + 0.1) / (N_b + 0.1 (V_b + 1)) with the
bucket's tokens and distinct tokens (one share is for all unseen ones), so known and
unseen tokens together have probability 1 after any history.

Training: Baum-Welch. Each partition runs the scaled forward and backward recursions
over its training sequences (cut into segments of ``segment`` tokens, many at a time)
and gives its expected counts, which Spark sums; the driver holds one model (states x
classes, a bounded size) and starts the next pass. All training texts take part in
every pass. Scores use the forward recursion over the whole sequence, uncut.

Counts: tokens are counted in every partition and summed by token. The ``dictionary``
most frequent ones (a parameter) are broadcast with their counts; all rarer tokens
of all documents are looked up by a join on the token, where no key is hot.

Defined cases: a null text counts as empty (one token, the end). A null id counts as
the empty text, which is held out. Repeated rows are scored each on its own. If
nothing is left for training, all tokens are unseen and the model is uniform.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonscope.llm.common import cut_lineage, utf8

END = b""  # no word is empty
ADDED = 0.1
COUNTED = 1 << 19


@dataclass(frozen=True)
class HmmOptions:
    states: int = 8
    passes: int = 4
    head: int = 1 << 14
    buckets: int = 1 << 10
    dictionary: int = 1 << 18
    segment: int = 256
    together: int = 2048
    stay: float = 0.9
    prior: float = 50.0
    seed: int = 7


@dataclass
class Model:
    """``start`` (K), ``move`` (K x K), ``emit`` (classes x K)."""
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def bucket(token: bytes, buckets: int) -> int:
    return zlib.crc32(token[-3:]) % buckets


def first_model(share: np.ndarray, o: HmmOptions) -> Model:
    """Near the token shares, each state with its own noise."""
    noise = np.random.Generator(np.random.PCG64(o.seed)).normal(0, 1, (len(share), o.states))
    emit = share[:, None] * np.exp(noise)
    move = np.full((o.states, o.states), (1 - o.stay) / max(1, o.states - 1))
    np.fill_diagonal(move, o.stay if o.states > 1 else 1.0)
    return Model(np.full(o.states, 1 / o.states), move, emit / emit.sum(axis=0))


def expected(model: Model, classes: np.ndarray, lengths: np.ndarray, o: HmmOptions):
    """Expected start, move and emission counts of sequences laid end to end."""
    k = o.states
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))
    begins = np.cumsum(lengths) - lengths
    pieces = [(b + i, min(o.segment, n - i)) for b, n in zip(begins.tolist(), lengths.tolist()) for i in range(0, n, o.segment)]
    pieces.sort(key=lambda x: -x[1])
    for i in range(0, len(pieces), o.together):
        at, size = map(np.array, zip(*pieces[i: i + o.together]))
        top = int(size[0])
        live = np.searchsorted(-size, -np.arange(top), side="left")  # sequences longer than t come first
        rows = np.concatenate([[0], np.cumsum(live)])
        flat = np.concatenate([at[:m] + t for t, m in enumerate(live.tolist())])
        seen = model.emit[classes[flat]]
        alpha, scale = np.empty_like(seen), np.empty(len(flat))
        now = None
        for t in range(top):
            m, own = int(live[t]), slice(rows[t], rows[t + 1])
            now = (model.start if t == 0 else now[:m] @ model.move) * seen[own]
            scale[own] = now.sum(axis=1)
            now = now / scale[own][:, None]
            alpha[own] = now
        beta = np.ones((0, k))
        gamma = alpha
        for t in range(top - 1, -1, -1):
            own = slice(rows[t], rows[t + 1])
            if t + 1 < top:
                after = slice(rows[t + 1], rows[t + 2])
                m = int(live[t + 1])
                ahead = seen[after] * beta / scale[after][:, None]
                move += alpha[own][:m].T @ ahead
                beta = np.concatenate([ahead @ model.move.T, np.ones((int(live[t]) - m, k))])
            else:
                beta = np.ones((int(live[t]), k))
            if t + 1 < top:
                gamma[after] = late
            late = alpha[own] * beta
        gamma[: rows[1]] = late
        start += gamma[: rows[1]].sum(axis=0)
        ids = classes[flat]
        for s in range(k):
            emit[:, s] += np.bincount(ids, weights=gamma[:, s], minlength=len(emit))
    return start, move * model.move, emit


def likelihoods(model: Model, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence, by the scaled forward recursion."""
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    total = np.zeros(len(lengths))
    now = None
    for t in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -t, side="left"))
        now = (model.start if t == 0 else now[:m] @ model.move) * model.emit[classes[begins[:m] + t]]
        scale = now.sum(axis=1)
        total[:m] += np.log10(scale)
        now = now / scale[:, None]
    out = np.empty(len(lengths))
    out[order] = total
    return out


def improved(start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray, o: HmmOptions) -> Model:
    """The model of summed expected counts, with ``prior`` tokens of the overall
    shares in each state."""
    emit = emit + o.prior * share[:, None]
    move = move + 1.0
    start = start + 1.0
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _count_rows(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["token", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in utf8(batch.column(text_col)):
                counts.update(tokens(text))
                if len(counts) >= COUNTED:
                    yield flush()
        if counts:
            yield flush()
    return run


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(token, n)`` over all texts; each task sums up before the shuffle."""
    rows = docs.select(text_col).mapInArrow(_count_rows(text_col), "token binary, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


def _bucket_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros(buckets), np.zeros(buckets)
        for batch in batches:
            at = np.array([bucket(t, buckets) for t in batch.column("token").to_pylist()], np.int64)
            total += np.bincount(at, weights=batch.column("n").to_numpy(), minlength=buckets)
            kinds += np.bincount(at, minlength=buckets)
        at = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(kinds[at])], names=["bucket", "total", "kinds"])
    return run


@dataclass
class Vocabulary:
    """The counted tokens as the tasks need them. ``known``: the dictionary, head first."""
    known: list[bytes]
    counts: np.ndarray
    head: int
    buckets: int
    in_bucket: np.ndarray    # training tokens of each bucket that aren't in the head
    kinds: np.ndarray        # and distinct ones
    total: int
    distinct: int
    name: str

    def share(self) -> np.ndarray:
        """Of each class among the training tokens, smoothed."""
        n = np.concatenate([self.counts[: self.head].astype(float), self.in_bucket]) + ADDED
        return n / n.sum()


def vocabulary(counts: DataFrame, o: HmmOptions) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = F.floor(16 * F.log2("n")).cast("int")
    steps = sorted(((r["size"], r["count"]) for r in counts.groupBy(size.alias("size")).count().collect()), reverse=True)
    least, found = None, 0
    for step, n in steps:  # at most 16 for each power of two
        if found + n > o.dictionary:
            break
        least, found = step, found + n
    known: list[tuple[bytes, int]] = []
    if least is not None:
        top = counts.where(size >= least).toArrow()  # at most ``dictionary`` rows
        known = sorted(zip(top["token"].to_pylist(), top["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    head = min(o.head, len(known))
    rows = counts.mapInArrow(_bucket_rows(o.buckets), "bucket int, total double, kinds double").groupBy("bucket").agg(
        F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).collect()
    in_bucket, kinds = np.zeros(o.buckets), np.zeros(o.buckets)
    for r in rows:
        in_bucket[r["bucket"]], kinds[r["bucket"]] = r["total"], r["kinds"]
    for t, n in known[:head]:
        in_bucket[bucket(t, o.buckets)] -= n
        kinds[bucket(t, o.buckets)] -= 1
    return Vocabulary([t for t, _ in known], np.array([n for _, n in known], np.int64), head, o.buckets, in_bucket, kinds, total, distinct, uuid.uuid4().hex)


_TABLES: dict[str, tuple] = {}


def _tables(shared: Broadcast) -> tuple:
    """The vocabulary as a dict and arrays over (dictionary, then buckets); made once
    per process."""
    v: Vocabulary = shared.value
    if v.name not in _TABLES:
        _TABLES.clear()
        place = {t: i for i, t in enumerate(v.known)}
        rest = v.known[v.head:]
        classes = np.concatenate([np.arange(v.head), [v.head + bucket(t, v.buckets) for t in rest],
                                  v.head + np.arange(v.buckets)]).astype(np.uint16)
        count_log = np.concatenate([np.log10(v.counts + ADDED), np.zeros(v.buckets)])
        word_log = count_log.copy()
        word_log[: v.head] = 0.0
        share_log = np.log10(v.in_bucket + ADDED * (v.kinds + 1))
        word_log -= np.concatenate([np.zeros(v.head), share_log])[classes]
        _TABLES[v.name] = v, place, classes, count_log, word_log
    return _TABLES[v.name]


_ENCODED = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, count_log double, word_log double, "
            "classes binary, rare array<binary>")


def _encoded(shared: Broadcast):
    """Each text as classes, with the parts of its scores that the dictionary gives
    and its tokens outside the dictionary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, place, class_of, count_log, word_log = _tables(shared)
        n = len(v.known)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                lists = [tokens(t) for t in utf8(batch.column("text"))]
                lengths = np.array([len(x) for x in lists])
                rare, flat = [], []
                for x in lists:
                    at = [place.get(t, -1) for t in x]
                    mine = [t for t, i in zip(x, at) if i < 0]
                    if mine:
                        new = iter([n + bucket(t, v.buckets) for t in mine])
                        at = [next(new) if i < 0 else i for i in at]
                    rare.append(mine)
                    flat += at
                at = np.array(flat, np.int64)
                edges = np.cumsum(lengths)[:-1]
                sums = [np.add.reduceat(x, np.concatenate([[0], edges])) for x in (count_log[at], word_log[at], at < n)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(lengths), pa.array(sums[2].astype(np.int64)),
                    pa.array(sums[0]), pa.array(sums[1]), pa.array([c.tobytes() for c in np.split(class_of[at], edges)], pa.binary()),
                    pa.array(rare, pa.list_(pa.binary()))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "count_log", "word_log", "classes", "rare"])
    return run


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint16).astype(np.int64), np.array([len(x) // 2 for x in raw], np.int64)


def _expected_rows(model: Model, o: HmmOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(o.states), np.zeros((o.states, o.states)), np.zeros_like(model.emit)
        for batch in batches:
            if batch.num_rows:
                for total, part in zip((start, move, emit), expected(model, *_sequences(batch.column("classes")), o)):
                    total += part
        table = np.vstack([start[None, :], move, emit])
        at = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(table[at, s].copy()) for s in range(o.states)]],
                                         names=["place", *[f"v{s}" for s in range(o.states)]])
    return run


def train(encoded: DataFrame, share: np.ndarray, o: HmmOptions) -> Model:
    """Baum-Welch passes over the training rows of ``encoded``."""
    model = first_model(share, o)
    columns = [f"v{s}" for s in range(o.states)]
    schema = "place int, " + ", ".join(f"{c} double" for c in columns)
    used = encoded.where(~F.col("held_out")).select("classes")
    for _ in range(o.passes):
        sums = used.mapInArrow(_expected_rows(model, o), schema).groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        table = np.zeros((1 + o.states + len(share), o.states))
        table[sums["place"].to_numpy()] = np.column_stack([sums[c].to_numpy() for c in columns])
        model = improved(table[0], table[1: 1 + o.states], table[1 + o.states:], share, o)
    return model


def _likelihood_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = likelihoods(model, *_sequences(batch.column("classes")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "chain_log"])
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: HmmOptions | None = None) -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (smoothed unigrams) and score (this model), both log10 probabilities of the text.
    Texts whose crc32(id) mod 10 is 0 are held out, the others are learnt from."""
    o = options or HmmOptions()
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    counts = cut_lineage(token_counts(source.where(~F.col("held_out"))))
    v = vocabulary(counts, o)
    shared = spark.sparkContext.broadcast(v)
    encoded = cut_lineage(source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_encoded(shared), _ENCODED))
    model = train(encoded, v.share(), o)
    rare = encoded.select("row", F.explode("rare").alias("token")).join(counts, "token").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + ADDED) - F.lit(float(np.log10(ADDED)))).alias("more_log"), F.count(F.lit(1)).alias("more"))
    kept = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "count_log", "word_log", F.size("rare").alias("n_rare"), "classes")
    chain = kept.mapInArrow(_likelihood_rows(model), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, "
                                                     "count_log double, word_log double, n_rare int, chain_log double")
    unseen = F.col("n_rare") * float(np.log10(ADDED)) + F.coalesce("more_log", F.lit(0.0))  # log10(c + 0.1) of the rare ones
    every = float(np.log10(v.total + ADDED * (v.distinct + 1)))
    return chain.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("count_log") + unseen - F.col("n_tokens") * every).alias("base_score"),
        (F.col("chain_log") + F.col("word_log") + unseen).alias("score"))
