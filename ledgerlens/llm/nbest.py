"""N-best segmentation of texts into pieces of a sentence-piece vocabulary.

A text is escaped (a space becomes the mark ▁, one is put in front) and seen as a lattice of
vocabulary pieces with their scores; a character no piece covers is an unknown node scored ten below
the lowest piece and written as byte pieces. The forward pass keeps the best score of every prefix.
The backward search starts at the end with a heap ordered by (score so far + best prefix score): the
heuristic is exact, so segmentations leave the heap in order of their scores.

No piece goes on past a mark after another character, nor over a sign that no piece has after a
letter, nor over a control character no piece has. The lattice of a text so falls into units and a segmentation's score is the sum over its units. The forward pass gives each unit its best
segmentation and the loss to its second. Only the units with
the smallest losses can differ in the ``n`` best segmentations of a text: these alone are searched,
and their losses are merged.

Null and empty texts have no pieces and one segmentation of score 0. Of equal scores any may come
first; the order is the same in every run.
"""

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import kept_in_worker

MARK = "▁"
#: Letters after which a vocabulary may forbid some signs.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Bounds of what a segmenter keeps: units, and the longest of them (characters).
KEPT_UNITS = 800_000
LONG_UNIT = 64
#: Ids in a batch of results, about.
BATCH_IDS = 2_000_000
N = 4


class Vocabulary:
    """Pieces with ids and scores; ``find`` maps a normal piece to (score, id)."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int] = frozenset()):
        self.pieces = pieces
        self.bytes = {int(m[1], 16): i for i, p in enumerate(pieces) if (m := BYTE.fullmatch(p))}
        self.raw_bytes = frozenset(self.bytes.values())
        #: The bytes of each piece, with spaces for marks.
        self.raw = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.find = {p: (s, i) for i, (p, s) in enumerate(zip(pieces, scores, strict=True)) if i not in special and not BYTE.fullmatch(p) and p}
        self.longest = max(map(len, self.find), default=1)
        together = {p[k : k + 2] for p in self.find for k in range(len(p) - 1)}
        letter = re.compile(f"[{LETTERS}]")
        joined = {b for a, b in together if letter.match(a)}
        alone = "".join(c for c in "\t\n\r" if not any(c in p for p in self.find)) or "\0"
        cut = "".join(re.escape(c) for c in SIGNS if c not in joined)
        alone, stop = re.escape(alone), re.escape(alone) + cut
        other = f"[^{MARK}{LETTERS}{alone}]"
        self.unit = re.compile(f"[{alone}]|{MARK}*{other}*+(?:[{LETTERS}]++(?![{stop}]){other}++)*+[{LETTERS}]*+")
        #: ``find`` by characters: a dictionary of next characters, with the hit under an empty string where a piece ends.
        self.tree: dict = {}
        for p, hit in self.find.items():
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = hit
        self.unknown = min((s for s, _ in self.find.values()), default=0.0) - 10.0
        if any(MARK in p.lstrip(MARK) for p in self.find):
            raise ValueError("pieces must not hold a mark after another character")

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], special)

    def units(self, text: str) -> list[str]:
        """The text in units: no piece goes over a border between them."""
        if not text:
            return []
        found = self.unit.findall(MARK + text.replace(" ", MARK))
        if not found[-1]:  # the empty match at the end
            found.pop()
        return found

    def lattice(self, text: str) -> list[list[tuple[int, float, int]]]:
        """For each end the pieces that end there: (begin, score, id); id -1 is an unknown character."""
        find, longest, ends = self.find, self.longest, [[] for _ in range(len(text) + 1)]
        for i in range(len(text)):
            single = False
            for j in range(i + 1, min(len(text), i + longest) + 1):
                if (hit := find.get(text[i:j])) is not None:
                    ends[j].append((i, *hit))
                    single = single or j == i + 1
            if not single:
                ends[i + 1].append((i, self.unknown, -1))
        return ends

    def ids(self, text: str, cuts: list[tuple[int, int]]) -> list[int]:
        """Ids of a segmentation [(begin, id)...]; unknown characters as bytes."""
        out = []
        for begin, i in cuts:
            out.extend([i] if i >= 0 else [self.bytes.get(b, 0) for b in text[begin].encode("utf-8", "surrogatepass")])
        return out

    def decode_unit(self, ids: list[int]) -> bytes:
        """What the ids of a unit stand for in the text with its leading space."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw if self.raw_bytes.isdisjoint(ids) else raw.decode("utf-8", "replace").replace(MARK, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; undoes any segmentation."""
        text = "".join(map(self.pieces.__getitem__, ids))
        if "<0x" in text:  # bytes, unless these are the text's own characters
            out, values = [], {i: b for b, i in self.bytes.items()}
            for i in ids:
                out.append(bytes([values[i]]) if i in values else self.pieces[i].encode())
            text = b"".join(out).decode("utf-8", "replace")
        return text.removeprefix(MARK).replace(MARK, " ")


def forward(ends: list) -> list[float]:
    """Best score of every prefix."""
    best = [0.0]
    for here in ends[1:]:
        best.append(max(best[i] + s for i, s, _ in here))
    return best


def search(vocabulary: Vocabulary, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations (score, ids) by backward A*."""
    ends = vocabulary.lattice(text)
    best, found, order = forward(ends), [], 0
    heap = [(-best[-1], 0, len(text), 0.0, None)]
    while heap and len(found) < n:
        _, _, at, tail, path = heapq.heappop(heap)
        if at == 0:
            cuts = []
            while path is not None:
                cuts.append(path[0])
                path = path[1]
            found.append((tail, vocabulary.ids(text, cuts)))
            continue
        for i, s, piece in ends[at]:
            order += 1
            heapq.heappush(heap, (-(best[i] + s + tail), order, i, s + tail, ((i, piece), path)))
    return found


def best_and_loss(vocabulary: Vocabulary, text: str) -> tuple[float, list[int], float]:
    """Best score and ids of a unit, and what its second best segmentation loses (infinite if none).

    The forward pass keeps the two best scores of every prefix; lookups end where no piece begins so.
    """
    tree, size, none = vocabulary.tree, len(text), float("-inf")
    first, second, begin, piece = [none] * (size + 1), [none] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
    first[0] = 0.0

    for i in range(size):
        x, y, j, node = first[i], second[i], i, tree.get(text[i])
        # a character that is no piece is unknown
        hit = (vocabulary.unknown, -1) if node is None else node.get("", (vocabulary.unknown, -1))
        while True:
            j += 1
            if hit is not None:
                v, z = x + hit[0], y + hit[0]
                if v > first[j]:
                    v, first[j] = first[j], v
                    begin[j], piece[j] = i, hit[1]
                if v < z:
                    v = z
                if v > second[j]:
                    second[j] = v
            if node is None or j == size or (node := node.get(text[j])) is None:
                break
            hit = node.get("")
    cuts, at = [], size
    while at:
        cuts.append((begin[at], piece[at]))
        at = begin[at]
    cuts.reverse()
    ids = [i for _, i in cuts]
    return first[size], ids if -1 not in ids else vocabulary.ids(text, cuts), first[size] - second[size]


class Units(dict):
    """What was found for the units met last; long units do not recur and are not kept."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, unit: str):
        found = self.find(unit)
        if len(unit) <= LONG_UNIT:
            if len(self) >= KEPT_UNITS:
                self.clear()
            self[unit] = found
        return found


class Found:
    """The n best segmentations of a text.

    ``units`` has the ids (packed) of each unit's best segmentation, ``texts`` what these decode to;
    ``options`` the same for all segmentations of the units that may differ, and ``taken`` which of
    them each segmentation has there: ((unit, option), ...).
    """

    __slots__ = ("scores", "units", "texts", "options", "taken")

    def __init__(self, scores: list[float], units: tuple[bytes, ...], texts: tuple[bytes, ...], options: dict[int, list[tuple[bytes, bytes]]], taken: list[tuple]):
        self.scores, self.units, self.texts, self.options, self.taken = scores, units, texts, options, taken

    def _with(self, own: tuple[bytes, ...], which: int, choices: list[tuple]) -> Iterator[bytes]:
        """``own`` joined, with what each choice has in place of the best."""
        best = b"".join(own)
        starts = {i: sum(map(len, own[:i])) for i in self.options}
        for choice in choices:
            parts, at = [], 0
            for i, k in choice:
                parts += [best[at : starts[i]], self.options[i][k][which]]
                at = starts[i] + len(own[i])
            yield b"".join([*parts, best[at:]])

    def ids(self) -> list[array]:
        """Ids of each segmentation."""
        return [array("i", packed) for packed in self._with(self.units, 0, self.taken)]

    def digests(self) -> list[str]:
        """sha256 of the text that each segmentation decodes to; one that decodes to the same in every unit has the same."""
        changed = [tuple((i, k) for i, k in choice if self.options[i][k][1] != self.texts[i]) for choice in self.taken]
        different = list(dict.fromkeys(changed))
        known = {c: hashlib.sha256(text.removeprefix(b" ")).hexdigest() for c, text in zip(different, self._with(self.texts, 1, different), strict=True)}
        return [known[c] for c in changed]


class Segmenter:
    """N-best segmentations of whole texts; keeps what it found for the units met last."""

    def __init__(self, vocabulary: Vocabulary, n: int = N):
        self.vocabulary, self.n = vocabulary, n
        self.units, self.several = Units(self._best), Units(self._several)

    @classmethod
    def load(cls, path: str, n: int) -> "Segmenter":
        return cls(Vocabulary.load(path), n)

    def _best(self, unit: str) -> tuple[float, float, bytes, bytes]:
        """Score and loss to the second of the best segmentation; its ids and what they decode to."""
        score, ids, loss = best_and_loss(self.vocabulary, unit)
        return score, loss, array("i", ids).tobytes(), self.vocabulary.decode_unit(ids)

    def _several(self, unit: str) -> list[tuple[float, bytes, bytes]]:
        """Scores and ids of the n best, and what they decode to."""
        return [(score, array("i", ids).tobytes(), self.vocabulary.decode_unit(ids)) for score, ids in search(self.vocabulary, unit, self.n)]

    def _nearest(self, losses: tuple[float, ...]) -> list[int]:
        """Places of the n - 1 smallest finite losses (of equal ones the first), in order of place."""
        if self.n < 2:
            return []
        each = np.array(losses)
        if len(each) >= self.n:
            most = np.partition(each, self.n - 2)[self.n - 2]
            places = np.flatnonzero(each <= most)
        else:
            places = np.arange(len(each))
        return sorted(sorted((i for i in places.tolist() if losses[i] < float("inf")), key=losses.__getitem__)[: self.n - 1])

    def found(self, text: str) -> Found:
        """The n best segmentations."""
        units = self.vocabulary.units(text)
        if not units:
            return Found([0.0], (), (), {}, [()])
        scores, losses, ids, texts = zip(*map(self.units.__getitem__, units), strict=True)
        total, chosen, options = sum(scores), [(0.0, ())], {}
        for i in self._nearest(losses):
            others = self.several[units[i]]
            options[i] = [(own, decoded) for _, own, decoded in others]
            if (ids[i], texts[i]) in options[i] and ids[i] != options[i][0][0]:  # of equal score
                options[i].remove((ids[i], texts[i]))
                options[i].insert(0, (ids[i], texts[i]))
            merged = ((loss + others[0][0] - score, (*taken, (i, k))) for loss, taken in chosen for k, (score, _, _) in enumerate(others))
            chosen = heapq.nsmallest(self.n, merged)
        return Found([total - loss for loss, _ in chosen], ids, texts, options, [taken for _, taken in chosen])

    def segmentations(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text (score, ids)."""
        found = self.found(text)
        return [(s, ids.tolist()) for s, ids in zip(found.scores, found.ids(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; undoes any segmentation."""
        return self.vocabulary.decode(ids)


def _nested(rows: list[list[array]]) -> pa.Array:
    """array<array<int>> of ids."""
    lists = list(chain.from_iterable(rows))
    flat = array("i")
    for ids in lists:
        flat += ids
    inner = pa.array(array("i", accumulate(map(len, lists), initial=0)), pa.int32())
    outer = pa.array(array("i", accumulate(map(len, rows), initial=0)), pa.int32())
    values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, values))


def _segmented(docs: DataFrame, model: str, key: str, text: str, n: int, columns: dict[str, tuple]) -> DataFrame:
    """key and ``columns`` of every row: name -> (type, function of content, what was found and all ids; None for the ids)."""
    schema = ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", *(f"{c} {t}" for c, (t, _) in columns.items())])
    arrow = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = kept_in_worker(Segmenter.load, model, n)
        for batch in batches:
            start, held, out = 0, 0, {c: [] for c in columns}
            for row, value in enumerate(batch.column(1), 1):
                content = value.as_py() or ""
                found = segment.found(content)
                ids = found.ids()
                for c, (_, value_of) in columns.items():
                    out[c].append(ids if value_of is None else value_of(content, found, ids))
                held += sum(map(len, ids))
                if held >= BATCH_IDS or row == batch.num_rows:
                    arrays = [_nested(out[c]) if f is None else pa.array(out[c], arrow[t]) for c, (t, f) in columns.items()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, row - start), *arrays], names=[key, *columns])
                    start, held, out = row, 0, {c: [] for c in columns}

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


#: What both operators say of a row: name -> (type, function).
BEST = {
    "n_chars": ("long", lambda content, found, ids: len(content)),
    "n_pieces": ("long", lambda content, found, ids: len(ids[0])),
    "ids_crc32": ("long", lambda content, found, ids: zlib.crc32(ids[0])),
    "scores": ("array<double>", lambda content, found, ids: found.scores),
}


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """key, n_chars, n_pieces, ids_crc32 and decoded_sha256 (of the best), scores and ids (arrays of the n best, falling) of every row."""
    columns = BEST | {"ids": ("array<array<int>>", None), "decoded_sha256": ("string", lambda content, found, ids: found.digests()[0])}
    return _segmented(docs, model, key, text, n, columns)


def summary(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """As ``encode``; in place of ids, all_n_pieces, all_ids_crc32 and all_decoded_sha256: arrays of the n best.

    The ids are decoded where they are found, unit by unit, so they need not leave the task.
    """
    columns = BEST | {
        "all_n_pieces": ("array<long>", lambda content, found, ids: list(map(len, ids))),
        "all_ids_crc32": ("array<long>", lambda content, found, ids: list(map(zlib.crc32, ids))),
        "all_decoded_sha256": ("array<string>", lambda content, found, ids: found.digests()),
    }
    return _segmented(docs, model, key, text, n, columns).withColumn("decoded_sha256", F.get("all_decoded_sha256", F.lit(0)))


def decode(rows: DataFrame, model: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and decoded, the texts of ``ids`` (array<array<int>>) of every row; null where ids are null."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", decoded array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(model)
        for batch in batches:
            texts = [None if v is None else [None if i is None else vocabulary.decode(i) for i in v] for v in (x.as_py() for x in batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.list_(pa.string()))], names=[*keep, "decoded"])

    return rows.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)
