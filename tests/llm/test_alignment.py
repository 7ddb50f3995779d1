"""Tokenizer alignment against the two libraries and all pairs of tokens."""

import hashlib
from collections import Counter

import pytest

from conftest_llm import clashing, corpus, table  # noqa: F401

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from reasonscope.llm import alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  two  spaces  ", "tab\tand\nline\r\n\r\n end ", "nbsp\xa0x \xa0 y", "don't we'll I'd 've 's", "123 456,789",
       "<|endoftext|> x<|startoftext|><|endoftext|>", "漢字かな交じり文" * 9, "é ä " * 20, "😀👍🏽 " * 9, "word" * 60, "!?" * 60,
       "x\x1cy\x85z \x00 q", "a" + " " * 70 + "b", "lorem ipsum \n" * 9, "a▁b c", "\ta b", "a b\t", "a \tb c", " lead", "trail ",
       "<s> </s> <unk> <0x0A>", "　 x 　", "Ἀρχή одно ab", "one▁"]


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def plain(texts):
    """By the libraries, cuts and all pairs."""
    a, b, table_ = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    a.encode_special_tokens = True
    known, total = {}, Counter()
    for t in set(texts):
        known[t] = 0, 0, 0, [], ""
        if not t:
            continue
        ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        tokens = ([bytes(table_[c] for c in a.id_to_token(i)) for i in ids[0]],
                  [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if any(b"".join(x) != (" " + t).encode() for x in tokens):
            continue
        spans = []
        for side in tokens:
            at, own = 0, []
            for x in side:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, s in zip(ids[k], spans[k]) if low <= s[0] < high) for k in (0, 1)) for low, high in zip([0, *cuts], cuts)]
        links = [(i, j) for i, s in zip(ids[0], spans[0]) for j, u in zip(ids[1], spans[1]) if s[0] < u[1] and u[0] < s[1]]
        known[t] = len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
    for t in texts:
        total.update(known[t][3])
    most = Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    return {t: (*v[:3], len(v[3]), sum(total[x] == most[x[1]] for x in v[3]), sum(total[x] for x in v[3]), v[4]) for t, v in known.items()}


@pytest.mark.parametrize("memo,segment,block", [(alignment.MEMO, alignment.SEGMENT, alignment.BLOCK), (50, 40, 300)])
def test_equal_to_the_libraries(spark, corpus, memo, segment, block):
    docs = [(i, None if t is None else t[:500]) for i, t in corpus] + [(500 + i, t) for i, t in enumerate(ODD)]
    expected = plain([t for _, t in docs])
    out = alignment.compare_tokenizers(clashing(table(spark, docs), "n_a", "_links"), A, B, public_tokenizers.PATTERN, memo=memo, segment=segment, block=block)
    got = sorted((str(r.doc_id), *[r[c] for c in alignment.SUMS], r.groups_sha256) for r in out.collect())
    assert got == sorted((str(i), *expected[t]) for i, t in docs)
    assert {"lang", "source"} <= set(out.columns) and "text" not in out.columns


def test_empty_table(spark):
    assert alignment.compare_tokenizers(table(spark, []), A, B, public_tokenizers.PATTERN).count() == 0


def test_segments_cut_at_seams():
    text = "ab cd  ef\tg h " * 50
    parts = list(alignment.segments(text, 20))
    assert " ".join(parts) == text and max(map(len, parts)) < 40


def test_memo_starts_anew():
    pairer = alignment.Pairer(A, B, public_tokenizers.PATTERN, memo=5)
    pairer.stretches(["one two three four five six seven"])
    assert pairer.full()
    pairer.renew()
    assert not pairer.full() and len(pairer.stretches(["one two one"])[0]) == 3
