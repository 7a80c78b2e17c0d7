import random

import pytest
import sentencepiece

from ledgerlens.llm import nbest
from ledgerlens.llm.tables import tokenizer

BYTES = [f"<0x{i:02X}>" for i in range(256)]
SMALL = nbest.Vocabulary(["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "▁▁", ".", ".a", *BYTES], [0, -3, -2, -2.5, -3.1, -3.7, -4.2, -3.3, -4.1, -4.4, -5, -1, -2.2, *[0] * 256], {0})


def _all(text):
    out = []

    def go(i, score, cuts):
        if i == len(text):
            out.append((score, SMALL.ids(text, cuts)))
        single = False
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in SMALL.find:
                s, number = SMALL.find[text[i:j]]
                go(j, score + s, [*cuts, (i, number)])
                single = single or j == i + 1
        if i < len(text) and not single:
            go(i + 1, score + SMALL.unknown, [*cuts, (i, -1)])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_against_all_segmentations():
    rnd, segmenter = random.Random(4), nbest.Segmenter(SMALL, 5)
    for _ in range(400):
        text = "".join(rnd.choice("ab ab.é\n") for _ in range(rnd.randint(0, 9)))
        every = _all("▁" + text.replace(" ", "▁") if text else "")
        got = segmenter.segmentations(text)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in every[:5]]
        assert len({tuple(ids) for _, ids in got}) == len(got)
        assert all(any(abs(s - a) < 1e-9 and ids == b for a, b in every) for s, ids in got)
        assert {segmenter.decode(ids) for _, ids in got} == {text}


def test_public_vocabulary_round_trip():
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    segmenter = nbest.Segmenter(nbest.Vocabulary.load(tokenizer("piece_bpe_32k.model")))
    for text in ["Hello,  world!\n\tü 𝄞 “x”", " lead", "tail ", "a" * 3000, "x.y.z(); {}", "日本語"]:
        found = segmenter.found(text)
        scores, ids = found.scores, found.ids()[0].tolist()
        assert segmenter.decode(ids) == text == model.decode(ids)
        assert scores == sorted(scores, reverse=True)
        own = sum(segmenter.vocabulary.find.get(p, (segmenter.vocabulary.unknown, 0))[0] for p in model.encode(text, out_type=str) if not p.startswith("<0x"))
        if not any(p.startswith("<0x") for p in model.encode(text, out_type=str)):
            assert scores[0] >= own


def test_pieces_with_inner_marks_are_refused():
    with pytest.raises(ValueError):
        nbest.Vocabulary(["a▁b"], [0.0])


def test_rows(messy, nothing):
    rows = nbest.encode(messy, tokenizer("piece_bpe_32k.model"))
    assert rows.count() == messy.count() and nbest.encode(nothing, tokenizer("piece_bpe_32k.model")).count() == 0
    import hashlib

    texts = {r.doc_id: r.text or "" for r in messy.collect()}
    for r in rows.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    empty = rows.filter("doc_id = 3").first()
    assert (empty.n_pieces, empty.scores) == (0, [0.0])


def test_ids_of_all_segmentations(messy, nothing, monkeypatch):
    import hashlib
    import zlib
    from array import array

    monkeypatch.setattr(nbest, "BATCH_IDS", 10)
    model = tokenizer("piece_bpe_32k.model")
    segmenter = nbest.Segmenter(nbest.Vocabulary.load(model))
    found, short = nbest.encode(messy, model), nbest.summary(messy, model)
    assert found.schema["ids"].dataType.simpleString() == "array<array<int>>"
    assert short.count() == messy.count() and nbest.summary(nothing, model).count() == 0
    texts = sorted((r.doc_id or -1, r.text or "") for r in messy.collect())
    rows = sorted(found.collect(), key=lambda r: (r.doc_id or -1, r.n_chars))
    for (_, text), r, q in zip(texts, rows, sorted(short.collect(), key=lambda r: (r.doc_id or -1, r.n_chars)), strict=True):
        assert list(zip(r.scores, r.ids, strict=True)) == segmenter.segmentations(text)
        assert len(r.ids) == (nbest.N if len(text) > 4 and text.strip() else len(r.scores)) == len({tuple(i) for i in r.ids})
        assert (r.n_pieces, r.n_pieces, r.scores) == (len(r.ids[0]), q.n_pieces, q.scores)
        assert q.all_n_pieces == list(map(len, r.ids)) and q.ids_crc32 == r.ids_crc32 == q.all_ids_crc32[0]
        assert q.all_ids_crc32 == [zlib.crc32(array("i", i).tobytes()) for i in r.ids]
        assert q.all_decoded_sha256 == [hashlib.sha256(text.encode()).hexdigest()] * len(r.ids) and q.decoded_sha256 == r.decoded_sha256
    decoded = nbest.decode(found, model, ["doc_id"]).collect()
    assert sorted((r.doc_id or -1, d) for r in decoded for d in r.decoded) == sorted((i, t) for (i, t), r in zip(texts, rows, strict=True) for _ in r.ids)
