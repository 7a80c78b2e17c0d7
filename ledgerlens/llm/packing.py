"""Hierarchical packing of documents into sequences of several lengths.

Documents become token ids, each closed by an end id. What a document has beyond whole windows is
routed to the tier (512, 1024, 2048 or 4096 tokens) that just holds it. Each tier is packed in order;
where the next document does not fit, the gap is filled with whole documents of shorter tiers, and at
last with a cut piece. Sequences of a tier are therefore exactly full. All this happens while a
partition is read; what no window holds at its end, under 4096 tokens, is packed over all partitions
by running sums, so that one padded sequence is left in all.

Sequences of each tier are dealt in turn to step groups, which so have equal numbers of tokens but
for one sequence of each tier.

Null texts count as empty; an empty document has the end id alone. Repeated rows are packed once each.
"""

import re
import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import kept_in_worker, stored

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
STEP_TOKENS = 1 << 20
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Bounds of what an encoder keeps: words, and the longest of them (characters).
KEPT_WORDS = 600_000
LONG_WORD = 64
#: Characters of the texts that are encoded together, but for a longer text.
CHUNK = 1 << 20

#: Latin-1 without the characters at which engines differ about white space.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
#: The file's own splitting pattern for lower-cased text of these characters.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\s0-9²³¹¼½¾a-zªµºß-öø-ÿ]+")
#: What the last token of every part ends with.
PART_END = "</w>"


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else b"".join(i.to_bytes(4, "little") for i in ids)


def plain(text: str) -> bool:
    """Whether a text has only the Latin-1 characters of ``PLAIN``."""
    try:
        return not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return False


class Encoder:
    """Token ids, as little-endian 32-bit numbers, equal to the tokenizer's own.

    White space always parts tokens, so plain texts go word by word; the words met last are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids of words as they stand between white space, and of the parts these have.
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(PART_END)]] = True

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, cut, new = self.words, [], set()
        for text in texts:
            words = text.lower().split() if plain(text) and "<|" not in text else None
            found = [] if words is None else list(map(known.get, words))
            missing = [i for i, ids in enumerate(found) if ids is None]
            new.update([words[i] for i in missing])
            cut.append((words, found, missing))
        fresh = self._words(list(new))
        out = []
        for text, (words, found, missing) in zip(texts, cut, strict=True):
            for i in missing:
                found[i] = fresh[words[i]]
            out.append(self._whole(text) if words is None else b"".join(found))
        known.update(fresh)
        _shorten(known, fresh)
        return out

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _words(self, words: list[str]) -> dict[str, bytes]:
        known, cut = self.parts, list(map(PARTS.findall, words))
        new = list(set(chain.from_iterable(cut)).difference(known))
        fresh = dict(zip(new, self._parts(new), strict=True))
        known.update(fresh)
        out = {word: b"".join(map(known.__getitem__, parts)) for word, parts in zip(words, cut, strict=True)}
        _shorten(known, fresh)
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, encoded as one text with spaces between them, which is cut again where parts end."""
        if not parts:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(parts):
            return list(map(self._whole, parts))
        cuts, whole = [0, *(4 * (ends + 1)).tolist()], ids.tobytes()
        return [whole[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def _shorten(known: dict[str, bytes], fresh: dict[str, bytes]) -> None:
    """Takes out what is long of the words just added (long words do not recur); starts anew at ``KEPT_WORDS``."""
    if len(known) >= KEPT_WORDS:
        known.clear()
        return
    for word in [w for w in fresh if len(w) > LONG_WORD]:
        del known[word]


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class Packer:
    """Packs pieces that come one by one; holds less than two windows of each tier."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.waiting = {t: deque() for t in tiers}
        self.tokens = dict.fromkeys(tiers, 0)
        self.made = dict.fromkeys(tiers, 0)

    def put(self, piece: Piece) -> Iterator[tuple]:
        longest = self.tiers[-1]
        while len(piece) >= longest:
            head, piece = piece.cut(longest)
            yield from self._closed(longest, [head])
        if len(piece):
            tier = self._wait(piece)
            if self.tokens[tier] >= tier:
                yield from self._window(tier)

    def _wait(self, piece: Piece, first: bool = False) -> int:
        tier = next(t for t in self.tiers if t >= len(piece))
        (self.waiting[tier].appendleft if first else self.waiting[tier].append)(piece)
        self.tokens[tier] += len(piece)
        return tier

    def _take(self, tier: int) -> Piece:
        piece = self.waiting[tier].popleft()
        self.tokens[tier] -= len(piece)
        return piece

    def _window(self, tier: int) -> Iterator[tuple]:
        """One full window of ``tier``, from its own and shorter tiers."""
        usable, gap, inside = [t for t in reversed(self.tiers) if t <= tier], tier, []
        while gap:
            fits = next((t for t in usable if self.waiting[t] and len(self.waiting[t][0]) <= gap), None)
            if fits is None:
                shortest = next(t for t in reversed(usable) if self.waiting[t])
                head, rest = self._take(shortest).cut(gap)
                self._wait(rest, first=True)
            else:
                head = self._take(fits)
            inside.append(head)
            gap -= len(head)
        yield from self._closed(tier, inside)

    def _closed(self, tier: int, inside: list[Piece]) -> Iterator[tuple]:
        offset, number = 0, self.made[tier]
        self.made[tier] += 1
        for x in inside:
            yield (x.doc, x.start, len(x), zlib.crc32(x.ids), x.total, tier, number, offset, None)
            offset += len(x)

    def rest(self) -> Iterator[tuple]:
        """Full windows as long as there are any; then the pieces left over, under one window, with their ids."""
        while sum(self.tokens.values()) >= self.tiers[-1]:
            yield from self._window(self.tiers[-1])
        offset = 0
        for tier in reversed(self.tiers):
            while self.waiting[tier]:
                x = self._take(tier)
                yield (x.doc, x.start, len(x), zlib.crc32(x.ids), x.total, 0, 0, offset, x.ids)
                offset += len(x)


def _pieces(docs: DataFrame, key: str, text: str, path: str, end_id: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, tier int, number long, offset long, ids binary, part int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, part, end = kept_in_worker(Encoder, path), Packer(), TaskContext.get().partitionId(), packed([end_id])
        arrow = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = [arrow, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tier", "number", "offset", "ids", "part"]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int32())], names=names)

        for batch in batches:
            arrow, rows, docs, texts, held = batch.schema.field(0).type, [], [], [], 0
            for row, (doc, content) in enumerate(zip(batch.column(0), batch.column(1), strict=True), 1):
                docs.append(doc.as_py())
                texts.append(content.as_py() or "")
                held += len(texts[-1])
                if held >= CHUNK or row == batch.num_rows:
                    for own, ids in zip(docs, encode(texts), strict=True):
                        ids += end
                        rows.extend(packer.put(Piece(own, 0, ids, len(ids) // 4)))
                    docs, texts, held = [], [], 0
            yield batch_of(rows)
        if arrow is not None:
            yield batch_of(list(packer.rest()))

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group.

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    pieces = stored(_pieces(docs, key, text, tokenizer, end_id), "pieces")
    # running sums over one row for each partition and tier
    made = pieces.groupBy("tier", "part").agg((F.max("number") + 1).alias("n"), F.sum("length").alias("tokens"))
    order = Window.orderBy(F.desc("tier"), "part").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    count = F.when(F.col("tier") > 0, F.col("n")).otherwise(0)
    everything = Window.partitionBy()
    bases = stored(made.select(
        "tier", "part",
        F.coalesce(F.sum(count).over(order), F.lit(0)).alias("base"), F.coalesce(F.sum(count).over(own), F.lit(0)).alias("nth"),
        F.coalesce(F.sum("tokens").over(own), F.lit(0)).alias("before"), F.sum("tokens").over(everything).alias("all_tokens"),
        F.sum(count).over(everything).alias("closed"),
    ), "bases")
    placed = pieces.join(bases, ["tier", "part"])
    steps = F.ceil(F.col("all_tokens") / step_tokens)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    full = placed.filter("tier > 0").withColumns({
        "sequence_id": F.col("base") + F.col("number"), "window": F.col("tier"),
        "step_group": F.pmod(F.col("nth") + F.col("number"), steps),
    })
    # what partitions left over stands in one line that is cut at every window
    at = F.col("before") + F.col("offset")
    last = F.col("__at") + F.col("length") - 1
    cut = placed.filter("tier = 0").withColumn("__at", at).withColumn("__window", F.explode(F.sequence(F.floor(F.col("__at") / WINDOW), F.floor(last / WINDOW))))
    begin = F.greatest(F.col("__at"), F.col("__window") * WINDOW)
    end = F.least(last + 1, (F.col("__window") + 1) * WINDOW)
    cut = cut.withColumns({"__begin": begin, "__length": end - begin})
    skipped = F.col("__begin") - F.col("__at")
    ids = F.substring(F.col("ids"), (4 * skipped + 1).cast("int"), (4 * F.col("__length")).cast("int"))
    left = cut.select(
        "doc_id", (F.col("start") + skipped).alias("start"), F.col("__length").alias("length"), F.crc32(ids).alias("ids_crc32"), "doc_tokens",
        (F.col("closed") + F.col("__window")).alias("sequence_id"), F.pmod(F.col("__begin"), F.lit(WINDOW)).alias("offset"),
        F.lit(WINDOW).alias("window"), F.pmod(F.col("closed") + F.col("__window"), steps).alias("step_group"),
    )
    return full.select(*names).unionByName(left.select(*names))
