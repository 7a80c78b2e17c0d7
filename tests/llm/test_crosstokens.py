import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import crosstokens
from ledgerlens.llm.tables import stored, tokenizer

A_PATH, B_PATH = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
PARTS = [" ", " ", "  ", "\n", "\t", "a", "the", "don", "'t", "1", "23", "é", "▁", "中", ".", "!!", "<s>", "<|endoftext|>", "\x00", "\x1c", "\x85", "\u200b", "😀", "\r\n", "ing", "Σ", "\u3000", "\ufeff", "\u00a0"]


@pytest.fixture(scope="module")
def aligner():
    return crosstokens.Aligner(A_PATH, B_PATH)


def _texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def _whole(aligner, text):
    """Tokens of the whole text at once, and groups by comparing all ends."""
    a, b = list(aligner.a.encode(" " + text, add_special_tokens=False).ids), list(aligner.b.encode(text))
    x, y = ([table[i] for i in ids] for table, ids in ((aligner.a_bytes, a), (aligner.b_bytes, b)))
    if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
        return [], [], []
    ends = [np.cumsum([len(t) for t in tokens]).tolist() for tokens in (x, y)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def _shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def _ids(shown):
    """The ids of A and of B in the notation of groups."""
    sides = [group.split("|") for group in shown.split(";")] if shown else []
    return tuple([int(i) for side in sides for i in side[k].split(",")] for k in (0, 1))


def test_tokens_and_groups_are_those_of_the_whole_text(aligner):
    texts = _texts(3000, 1) + ["word " * 3000, "x" * 5000, "中" * 3000]
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        for text, (n_a, n_b, shown, pairs, sizes) in zip(part, aligner.align(part), strict=True):
            x, y, groups = _whole(aligner, text)
            assert _ids(shown) == (x, y) and (n_a, n_b) == (len(x), len(y)), text
            assert shown == _shown(groups)
            assert pairs.tolist() == [g[0][-1] << 32 | g[1][-1] for g in groups]
            assert sizes.sum() == (len((" " + text).encode()) if groups else 0)


def test_memo_changes_nothing(aligner, monkeypatch):
    monkeypatch.setattr(crosstokens, "WORDS", 3)
    monkeypatch.setattr(crosstokens, "WINDOWS", 3)
    small = crosstokens.Aligner(A_PATH, B_PATH)
    texts = _texts(400, 2)
    for text in texts:
        (own,), (other,) = small.align([text]), aligner.align([text])
        assert own[:3] == other[:3] and all(np.array_equal(x, y) for x, y in zip(own[3:], other[3:], strict=True))
    assert len(small.words) < 100 and len(small.windows) < 100


def test_windows_of_words_in_a_row_are_those_of_the_text(aligner):
    for text in [t for t in _texts(400, 5) if t] + ["one  two\t three\n four" * 50]:
        a, b, groups = _whole(aligner, text)
        if groups:
            windows, ends = aligner.windows_of(*(np.array(ids, np.int32).tobytes() for ids in (a, b)))
            assert ends[-1] == 4 * len(a) and ";".join(shown for shown, _, _ in aligner.align_windows(windows)) == _shown(groups)
            assert aligner.align([text])[0][2] == _shown(groups)


def test_counts_by_both_ways(spark, aligner, messy, nothing):
    texts = _texts(120, 3) + [None, "", "the the the", "the the the"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "the a")], "doc_id long, text string").unionByName(messy.select("doc_id", "text"))
    docs = docs.select("*", *[F.lit("clash").alias(c) for c in ("pairs", "links", "groups", "n_a", "pair", "count")])
    whole = [(r.doc_id, *_whole(aligner, r.text or "")) for r in docs.collect()]
    links = [[(g[0][-1], g[1][-1]) for g in groups] for *_, groups in whole]
    counts = Counter(p for own in links for p in own)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    expected = sorted([(i, len(a), len(b), _shown(g), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own)) for (i, a, b, g), own in zip(whole, links, strict=True)], key=str)
    aligned = stored(crosstokens.align(docs, A_PATH, B_PATH), "aligned")
    for most_sent in (10**6, 0):
        rows = crosstokens.agreement(aligned, most_sent).collect()
        assert sorted([(r.doc_id, r.n_a, r.n_b, r.groups, r.n_links, r.n_best, r.count_sum) for r in rows], key=str) == expected
        assert all(len(r.ends) == r.n_links for r in rows)
    empty = stored(crosstokens.align(nothing, A_PATH, B_PATH), "aligned")
    assert crosstokens.agreement(empty).count() == 0 and crosstokens.agreement(empty, -1).count() == 0
