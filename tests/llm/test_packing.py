import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import packing
from ledgerlens.llm.tables import tokenizer

FILE = "word_bpe_49k.json"


def _check(docs, rows):
    """Every id in one piece, sequences gapless; returns the padding."""
    encode = Tokenizer.from_file(tokenizer(FILE))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 4096
        padding += 4096 - end if end & (end - 1) else 0
    expected = defaultdict(list)
    for d in docs:
        expected[d.doc_id].append(np.array([*encode.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    assert set(expected) == set(pieces)
    for doc, copies in expected.items():
        got = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces[doc])
        assert sum(g[1] for g in got) == sum(map(len, copies))
        if len(copies) == 1:
            end = 0
            for start, length, crc, total in got:
                assert start == end and total == len(copies[0])
                assert crc == zlib.crc32(copies[0][start : start + length].tobytes())
                end += length
    return padding


def test_messy_rows(messy, nothing):
    rows = packing.pack(messy, tokenizer(FILE)).collect()
    assert _check(messy.collect(), rows) < 4096
    assert packing.pack(nothing, tokenizer(FILE)).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_one_padded_sequence_over_all_partitions(spark, parts):
    texts = [("word %d " % (i % 97)) * (i * 37 % 900) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    rows = packing.pack(docs, tokenizer(FILE), step_tokens=1 << 14).collect()
    assert _check(docs.collect(), rows) < 4096
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.step_group] += r.length
    assert max(sizes.values()) - min(sizes.values()) <= sum(packing.TIERS) + 4096


def test_words_alone_give_the_tokenizers_ids():
    encode, whole = packing.Encoder(tokenizer(FILE)), Tokenizer.from_file(tokenizer(FILE))
    for text in ["It's we'LL 12³ ½x", "ÀÉ ß ÿ µm ªº", "a b\u0085c\x1fd", "é ΣΑΣ ΐ İ", "<|startoftext|> x <|endoftext|>", "!!!?? #$%&'s 'tis \t\r\n", "日本語 テスト", ""]:
        assert encode([text]) == [packing.packed(whole.encode(text, add_special_tokens=False).ids)]


def test_texts_together_give_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 500)
    rnd, encode, whole = random.Random(5), packing.Encoder(tokenizer(FILE)), Tokenizer.from_file(tokenizer(FILE))
    signs = "abcxyzABÉßÿªµ0129²½'\"!?.,-_<|> \t\n\u00ad\u00d7\u00f7" + "'s't're " + "語\u0085"
    for _ in range(200):
        texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 60))) for _ in range(rnd.randint(0, 20))] + ["w" * rnd.randint(0, 200)]
        assert encode(texts) == [packing.packed(whole.encode(t, add_special_tokens=False).ids) for t in texts]
        assert max(map(len, encode.words), default=0) <= packing.LONG_WORD
