import random

from ledgerlens.llm import tokencount
from ledgerlens.llm.tables import tokenizer

FILE = "byte_bpe_50k.tiktoken"


def test_edits_against_whole_counts():
    rnd, counter = random.Random(2), tokencount.Counter(tokenizer(FILE))
    signs = "ab c  \n\t'sé1!.,x  tré"
    for _ in range(500):
        tree = tokencount.CountTree("".join(rnd.choice(signs) for _ in range(rnd.choice([0, 1, 5, 30, 300, 3000]))), counter)
        for _ in range(4):
            a = rnd.randint(0, len(tree.text))
            b = min(len(tree.text), a + rnd.choice([0, 0, 1, 3, 20, 200]))
            new = "".join(rnd.choice(signs) for _ in range(rnd.choice([0, 0, 1, 4, 50, 400])))
            text = tree.text[:a] + new + tree.text[b:]
            assert tree.replace(a, b, new) == len(counter.encoding.encode_ordinary(text))
            assert tree.text == text


def test_only_the_region_is_counted_again():
    counter = tokencount.Counter(tokenizer(FILE))
    tree = tokencount.CountTree("some words of a text, " * 5000, counter)
    tree.replace(50_000, 50_003, "other")
    assert tree.recounted < 100
    assert tree.tokens == len(counter.encoding.encode_ordinary(tree.text))


def test_rows(messy, nothing):
    counter = tokencount.Counter(tokenizer(FILE))
    texts = {r.doc_id: r.text or "" for r in messy.collect()}
    rows = tokencount.count_edits(messy, tokenizer(FILE)).collect()
    assert len(rows) == messy.count()
    for r in rows:
        text = texts[r.doc_id]
        edited = text[: len(text) // 3] + text[:40] + text[len(text) // 3 :]
        place = 2 * len(edited) // 3
        edited = edited[:place] + edited[place + 40 :]
        assert r.n_chars == len(text)
        assert r.n_tokens == len(counter.encoding.encode_ordinary(text))
        assert r.edited_tokens == len(counter.encoding.encode_ordinary(edited))
    assert tokencount.count_edits(nothing, tokenizer(FILE)).count() == 0
