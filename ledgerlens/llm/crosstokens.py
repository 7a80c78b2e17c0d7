"""Cross-tokenizer alignment of a byte-level BPE (A) and a SentencePiece model (B) over whole documents.

A sees a space and the text, B the text, which it prefixes with a space itself. Strings of special tokens
are plain text. The bytes of A's tokens and those of B's joined must both be the space and the text in
UTF-8; where either differs (U+2581 in a text decodes as a space), and for null and empty texts, there are
no tokens.

Where a token of A and one of B end together, a group ends; tokens that end together are linked. After
full tokenization, anchors are the byte offsets at which both tokenizers start a token that begins with a
space; each is verified to be a shared end. Both tokenizers start anew at a single space before a visible
character, so tokenization itself goes word by word; the ids are those of the whole text. Anchors cut ids into windows of a few, and the
alignment of a window depends on its ids alone, so it is memoised by both tuples of ids (packed as one key). Every word starts at
an anchor, so a document's windows are those of its words in a row: a memo of words keeps the alignments of each word's windows.
Both memos are bounded by entries of bounded length; a window of more than ``LONG`` bytes of ids is not kept.

A pair of ids counts, over the corpus, as many links as hold it. Links of a document are added up to one
number for each pair before anything is shuffled, and pairs are added up again on the map side. The counts
are sent to all tasks if there are at most ``broadcast_pairs`` of them, which is checked; otherwise links
and counts meet in a shuffled join, with the same result.

Rows may repeat, and keys may be null or of any type; every row is a document of its own.
"""

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import kept_in_worker, stored

#: Bounds of both memos: entries of a generation, and the longest word (characters) and window (bytes of its ids) kept.
WORDS = 300_000
WINDOWS = 50_000
LONG_WORD = 64
LONG = 160
CHUNK = 256
BROADCAST_PAIRS = 2_000_000
#: A space after no space and before a character that is no white space (U+007F to U+00A0 are left out whole).
VISIBLE = re.compile("[\x21-\x7e\u00a1-\u167f\u1681-\u1fff\u200b-\u2027\u2030-\u205e\u2060-\u2fff\u3001-\U0010ffff]")
WORD = re.compile(f"(?<! ) (?={VISIBLE.pattern})")


def _byte_characters() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memo(dict):
    """Two generations of at most ``most`` entries each: what is used moves to the younger, what is not goes with the older."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        self[key] = value = self.older[key]
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class Aligner:
    """Both tokenizers, the bytes of their tokens and the memo of windows; one for each Python worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = _byte_characters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.lengths = [np.array([len(t) for t in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.spaced = [np.array([t[:1] == b" " for t in table]) for table in (self.a_bytes, self.b_bytes)]
        self.words = Memo(WORDS)
        self.windows = Memo(WINDOWS)
        #: Every id in decimal with the sign after it, inside a group and at the end of its part.
        self.shown = [f"{i}{end}" for table, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for i in range(len(table)) for end in ends]
        self.b_from = len(self.a_bytes)

    def align(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray, np.ndarray]]:
        """Of each text: tokens of A and of B, groups as text, linked pairs (A's id in the upper, B's in the lower 32 bits), byte lengths of groups.

        All are empty where the bytes do not come out as the space and the text.
        """
        cut = []
        for text in texts:
            first, *words = WORD.split(" " + text)
            cut.append(([first[1:]] if first else []) + words if text else [])
        known = self.words
        new = self._aligned(self._words(list(set(chain.from_iterable(cut)).difference(known, known.older))))
        known.update(new)
        nothing = np.zeros(0, np.int64)
        out = []
        for words in cut:
            each = list(map(known.__getitem__, words))
            if not each or None in each:
                out.append((0, 0, "", nothing, nothing))
                continue
            n_a, n_b, shown, pairs, sizes = zip(*each, strict=True)
            out.append((sum(n_a), sum(n_b), ";".join(shown), np.frombuffer(b"".join(pairs), np.int64), np.frombuffer(b"".join(sizes), np.int64)))
        # long words do not recur
        for word in new:
            if len(word) > LONG_WORD:
                del known[word]
        known.turn()
        return out

    def _aligned(self, encoded: dict[str, tuple[bytes, bytes] | None]) -> dict[str, tuple[int, int, str, bytes, bytes] | None]:
        """Words with the alignments of their windows in a row: tokens of A and of B, groups, pairs, byte lengths.

        The words' ids stand end to end for this: each word starts at an anchor, so none of their windows holds ids of two.
        """
        out: dict[str, tuple | None] = dict.fromkeys(encoded)
        sound = [word for word, both in encoded.items() if both]
        if not sound:
            return out
        of_a, of_b = zip(*map(encoded.__getitem__, sound), strict=True)
        windows, ends = self.windows_of(b"".join(of_a), b"".join(of_b))
        last = np.searchsorted(ends, np.cumsum(list(map(len, of_a))))
        memo = self.windows
        fresh = list(set(windows).difference(memo, memo.older))
        memo.update(zip(fresh, self.align_windows(fresh), strict=True))
        each = list(map(memo.__getitem__, windows))
        start = 0
        for word, a, b, end in zip(sound, of_a, of_b, (last + 1).tolist(), strict=True):
            shown, pairs, sizes = each[start] if end == start + 1 else (";".join([e[0] for e in each[start:end]]), *[b"".join([e[k] for e in each[start:end]]) for k in (1, 2)])
            out[word] = (len(a) // 4, len(b) // 4, shown, pairs, sizes)
            start = end
        # long windows do not recur
        for window in fresh:
            if len(window) > LONG:
                del memo[window]
        memo.turn()
        return out

    def _words(self, words: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Packed ids of words by both, each with a space before it; None where the bytes differ."""
        joined = [w for w in words if VISIBLE.match(w) and not w.endswith(" ")]
        out = self._joined(joined) if joined else {}
        alone = [w for w in words if w not in out]
        if alone:
            first = self.a.encode_batch_fast([" " + w for w in alone], add_special_tokens=False)
            for word, a, b in zip(alone, first, self.b.encode(alone, num_threads=1), strict=True):
                same = self._bytes(a.ids, b) == [b" " + word.encode("utf-8", "surrogatepass")] * 2
                out[word] = (np.array(a.ids, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if same else None
        return out

    def _bytes(self, a: list[int], b: list[int]) -> list[bytes]:
        return [b"".join(map(self.a_bytes.__getitem__, a)), b"".join(map(self.b_bytes.__getitem__, b))]

    def _joined(self, words: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Words encoded as one text, which both tokenizers take apart again; nothing if the bytes differ."""
        text = " ".join(words)
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        if self._bytes(a, b) != [b" " + text.encode("utf-8", "surrogatepass")] * 2:
            return {}
        ends, packed = np.cumsum([1 + len(w.encode("utf-8", "surrogatepass")) for w in words]), []
        for ids, table in ((np.array(a, np.int32), self.lengths[0]), (np.array(b, np.int32), self.lengths[1])):
            own = np.cumsum(table[ids])
            at = np.searchsorted(own, ends)
            if (own[at] != ends).any():
                return {}
            cuts, whole = [0, *(4 * (at + 1)).tolist()], ids.tobytes()
            packed.append([whole[i:j] for i, j in zip(cuts, cuts[1:], strict=False)])
        return dict(zip(words, zip(*packed, strict=True), strict=True))

    def windows_of(self, packed_a: bytes, packed_b: bytes) -> tuple[list[bytes], list[int]]:
        """Ids cut at their anchors: each window's ids of A, then those of B raised by ``b_from``, packed; where windows end in ``packed_a``."""
        a, b = np.frombuffer(packed_a, np.int32), np.frombuffer(packed_b, np.int32)
        starts, marked = [], []
        for ids, table, spaced in zip((a, b), self.lengths, self.spaced, strict=True):
            own = np.flatnonzero(spaced[ids])
            own = own[own > 0]
            marked.append(own)
            # where the token before ends, which is where the marked one starts
            starts.append(np.cumsum(table[ids])[own - 1])
        # an offset at which both start a marked token ends a token of both
        _, x, y = np.intersect1d(*starts, assume_unique=True, return_indices=True)
        cut_a, cut_b = (4 * marked[0][x]).tolist(), (4 * marked[1][y]).tolist()
        raised = (b + self.b_from).tobytes()
        ends = [*cut_a, len(packed_a)]
        return [packed_a[i:j] + raised[k:m] for i, j, k, m in zip([0, *cut_a], ends, [0, *cut_b], [*cut_b, len(raised)], strict=True)], ends

    def align_windows(self, windows: list[bytes]) -> list[tuple[str, bytes, bytes]]:
        """Groups as text, linked pairs and byte lengths of groups of windows; all at once, since they end together end to end."""
        if not windows:
            return []
        both, per_window = np.frombuffer(b"".join(windows), np.int32), np.cumsum([len(w) // 4 for w in windows])
        of_b = both >= self.b_from
        a, b = both[~of_b], both[of_b] - self.b_from
        in_a = np.cumsum(~of_b)[per_window - 1]
        ends, last_a, last_b = np.intersect1d(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]), assume_unique=True, return_indices=True)
        # in the notation a group's ids of A stand before its ids of B
        of_a, of_b = (np.searchsorted(last, np.arange(len(ids))) for last, ids in ((last_a, a), (last_b, b)))
        shown = np.empty(len(a) + len(b), dtype=np.int64)
        shown[np.arange(len(a)) + np.append(0, last_b + 1)[of_a]] = 2 * a + (np.arange(len(a)) == last_a[of_a])
        shown[np.arange(len(b)) + last_a[of_b] + 1] = 2 * self.b_from + 2 * b + (np.arange(len(b)) == last_b[of_b])
        words = list(map(self.shown.__getitem__, shown.tolist()))
        places = [0, *per_window.tolist()]
        pairs, sizes = ((a[last_a].astype(np.int64) << 32) | b[last_b]).tobytes(), np.diff(ends, prepend=0).astype(np.int64).tobytes()
        groups = [0, *(8 * (np.searchsorted(last_a, in_a - 1) + 1)).tolist()]
        return [
            ("".join(words[i:j])[:-1], pairs[g:h], sizes[g:h])
            for i, j, g, h in zip(places, places[1:], groups, groups[1:], strict=False)
        ]


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment of every document.

    key, n_a, n_b (tokens), groups (``a1,a2|b1;a3|b2,b3``: ids in order), ends (byte offset of the end of each
    group, the leading space included), pairs (distinct linked pairs, A's id in the upper 32 bits, B's in the
    lower), links (how often each pair is linked here).
    """
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_a long, n_b long, groups string, ends array<long>, pairs array<long>, links array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = kept_in_worker(Aligner, a_path, b_path)
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                out = []
                for n_a, n_b, groups, linked, sizes in aligner.align([t or "" for t in batch.column(1).to_pylist()]):
                    pairs, often = np.unique(linked, return_counts=True)
                    out.append((n_a, n_b, groups, np.cumsum(sizes), pairs, often))
                kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3]
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_a", "n_b", "groups", "ends", "pairs", "links"])

    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links that hold it), is_best (no pair of the same B id counts more) of a table with pairs and links."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "links")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("count"))
    counts = stored(counts, "pair_counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    best = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))
    return stored(counts.join(best, b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("is_best")), "pair_best")


def agreement(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The rows of ``aligned`` (a stored table) with n_links, n_best and count_sum in place of pairs and links.

    n_best: links whose pair no other pair of the same B id outnumbers in the corpus; count_sum: the counts of
    all links' pairs.
    """
    counts = pair_counts(aligned)
    kept = [c for c in aligned.columns if c not in ("pairs", "links")]
    if counts.count() <= broadcast_pairs:
        return _agreement_sent(aligned, counts, kept)
    return _agreement_joined(aligned, counts, kept)


def _agreement_sent(aligned: DataFrame, counts: DataFrame, kept: list[str]) -> DataFrame:
    table = counts.toArrow().sort_by("pair")
    columns = [table["pair"].to_numpy(), table["count"].to_numpy(), table["is_best"].to_numpy()]
    shared = aligned.sparkSession.sparkContext.broadcast(columns)
    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept) + ", n_links long, n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = shared.value
        for batch in batches:
            own, links = batch.column(len(kept)), batch.column(len(kept) + 1).flatten().to_numpy()
            place = np.searchsorted(pairs, own.flatten().to_numpy())
            row = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
            sums = []
            for each in (links, links * best[place], links * count[place]):
                total = np.zeros(batch.num_rows, dtype=np.int64)
                np.add.at(total, row, each)
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *sums], names=[*kept, "n_links", "n_best", "count_sum"])

    return aligned.select(*kept, "pairs", "links").mapInArrow(run, schema)


def _agreement_joined(aligned: DataFrame, counts: DataFrame, kept: list[str]) -> DataFrame:
    numbered = stored(aligned.select(*kept, "pairs", "links", F.monotonically_increasing_id().alias("__row")), "numbered")
    each = numbered.select("__row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("__row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("k"))
    sums = each.join(counts, "pair").groupBy("__row").agg(
        F.sum("k").alias("n_links"), F.sum(F.when(F.col("is_best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("count")).alias("count_sum")
    )
    joined = numbered.join(sums, "__row", "left")
    return joined.select(*kept, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")])
