"""Token counts, byte-level BPE and packing against the libraries."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from conftest_llm import SCHEMA, clashing, corpus, table  # noqa: F401

public_tokenizers = pytest.importorskip("public_tokenizers")
from reasonscope.llm import bpe, packing, token_counts  # noqa: E402

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

ODD = ["", " ", "a", "  two  spaces  ", "tab\tand\nline\r\n\r\n end ", "nbsp x   y", "don't we'll I'd 've 's", "123 456,789",
       "<|endoftext|> x<|startoftext|><|endoftext|>", "漢字かな交じり文" * 30, "é ä " * 40, "😀👍🏽 " * 20, "word" * 400, "!?" * 300,
       "x\x1cy\x85z \x00 q", "a" + " " * 700 + "b", ("lorem ipsum " * 60 + "\n") * 20]


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (100, 16), (1 << 15, 256)])
def test_token_counts_equal_the_library(corpus, chunk, overlap):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(WORD)
    counter = token_counts.Counter(WORD, chunk, overlap)
    for text in [*ODD, *[t or "" for _, t in corpus]]:
        assert counter.counts([text.encode()]) == [len(library.encode(text, add_special_tokens=False).ids)], text[:80]


def test_token_counts_memo_is_bounded():
    counter = token_counts.Counter(WORD, memo=8)
    many = [" ".join(f"w{i}" for i in range(n, n + 8)).encode() for n in range(0, 80, 8)]
    whole = token_counts.Counter(WORD)
    assert [counter.counts([t])[0] for t in many] == whole.counts(many) and len(counter.memo) <= 8


def test_token_counts_query(spark, corpus):
    docs = clashing(table(spark, corpus), "n_tokens")
    rows = token_counts.count_tokens(docs, WORD).collect()
    whole = token_counts.Counter(WORD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == sorted(
        (str(i), len((t or "").encode()), whole.counts([(t or "").encode()])[0]) for i, t in corpus)
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), WORD).count() == 0


@pytest.mark.parametrize("leaf,window", [(1, 1), (7, 2), (64, 8), (1 << 15, 64)])
def test_tree_encoding_equals_the_library(corpus, leaf, window):
    coder = bpe.rank_encoding(RANKS, PATTERN)
    for text in [*ODD, *[(t or "")[:600] for _, t in corpus]]:
        ids = bpe.encode(text, coder.encode_ordinary, leaf, window)
        assert ids == coder.encode_ordinary(text), text[:80]
        assert bpe.decode(ids, coder.decode_bytes, max(1, leaf)) == text.encode()


def test_encode_decode_query(spark, corpus):
    out = bpe.encode_decode(clashing(table(spark, corpus), "ids"), RANKS, PATTERN).collect()
    coder = bpe.rank_encoding(RANKS, PATTERN)
    assert len(out) == len(corpus)
    for r in out:
        assert bytes(r.decoded).decode() == (r.text or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == coder.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) // 4
    assert bpe.encode_decode(spark.createDataFrame([], SCHEMA), RANKS, PATTERN).count() == 0


def test_piece_encoder_equals_the_library(corpus):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(BYTE)
    for memo in (4, packing.MEMO):
        encoder = packing.PieceEncoder(BYTE, PATTERN, memo)
        for text in [*ODD, *[t or "" for _, t in corpus]]:
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == want, text[:80]


def check_pieces(pieces, documents, size):
    """Every id in one piece, sequences gapless and within size."""
    sequences, parts = defaultdict(list), defaultdict(list)
    for doc, start, length, tokens, sequence, offset, ids in pieces:
        assert len(ids) == 4 * length > 0 and tokens == len(documents[doc]) // 4
        assert documents[doc][4 * start: 4 * (start + length)] == ids
        sequences[sequence].append((offset, length))
        parts[doc].append((start, length))
    for group in (sequences, parts):
        for spans in group.values():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
    fill = [sum(n for _, n in s) for s in sequences.values()]
    assert max(fill) <= size and {d: sum(n for _, n in s) for d, s in parts.items()} == {d: len(i) // 4 for d, i in documents.items()}
    return fill


@pytest.mark.parametrize("max_open", [3, 8192])
def test_packer_places_everything_once(max_open):
    r = np.random.default_rng(4)
    documents = {i: np.arange(n, dtype="<u4").tobytes() for i, n in enumerate(r.integers(1, 300, 500).tolist())}
    packer = packing.Packer(64, 1000, max_open)
    for i, ids in documents.items():
        packer.add(i, ids)
        assert packer.open <= max_open and packer.open == packer.levels.sum()
    packer.merge(last=True)
    fill = check_pieces(packer.done, documents, 64)
    assert sum(f < 64 for f in fill) <= 1


def test_packer_minimises_the_sum_of_squares():
    r = np.random.default_rng(8)
    packer = packing.Packer(16, 0, 10**6)
    for n in r.integers(1, 16, 400).tolist():
        before = packer.levels.copy()
        best = None
        for h in [0, *[h for h in range(1, 17 - n) if before[h]]]:
            after = before.copy()
            after[h] -= h > 0
            after[h + n] += h + n < 16
            squares = int((after[1:16] ** 2).sum())
            best = squares if best is None else min(best, squares)
        packer.place((0, 0, n, bytes(4 * n)), n)
        assert int((packer.levels[1:16] ** 2).sum()) == best


def test_pack_query(spark, corpus):
    rows = [(i, t) for i, t in {i: t for i, t in corpus if i is not None}.items()]
    out = packing.pack(clashing(table(spark, rows), "start", "sequence_id"), BYTE, PATTERN).collect()
    encoder = packing.PieceEncoder(BYTE, PATTERN)
    documents = {i: encoder.encode((t or "").encode()) + bytes(4) for i, t in rows}
    fill = check_pieces([(*r[:6], bytes(r.ids)) for r in out], documents, packing.SIZE)
    assert sum(f < packing.SIZE for f in fill) <= 3
    assert zlib.crc32(documents[131]) == zlib.crc32(bytes(4))
    assert packing.pack(table(spark, corpus), BYTE, PATTERN).where("doc_id is null").count() >= 2
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTE, PATTERN).count() == 0
