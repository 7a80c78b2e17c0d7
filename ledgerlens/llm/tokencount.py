"""Edit-aware token counts.

A text is cut into pre-tokens, whose byte-pair tokens do not depend on each other. They are kept in
leaves of 64 to 128; a segment tree over the leaves holds sums of characters and tokens. An edit finds
its place by going down the tree by characters, starts two pre-tokens before it (the pattern looks
ahead by no more than a run of white space and a character) and cuts the new text into pre-tokens
until one ends where an old one ended after the edit; from there on all are as before. Only those are
counted anew, and only the sums above the leaves that hold them change.

Null texts count as empty; an empty text has no tokens. Counts are those of the whole new text.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 64
BACK = 2
KEPT = 300_000
LONGEST = 64

#: The pattern with which byte-level vocabularies of this kind are used.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter(dict):
    """Tokens of a pre-token, kept for those met last of at most ``LONGEST`` characters."""

    def __init__(self, path: str):
        super().__init__()
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        out = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = out
        return out


class CountTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.recounted = text, counter, 0
        pieces = counter.pattern.findall(text)
        lengths, counts = list(map(len, pieces)), list(map(counter.__getitem__, pieces))
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]
        self._build()

    def _build(self) -> None:
        """All sums; node k has the children 2k and 2k + 1, leaves begin at ``width``."""
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        sums = [(sum(a), sum(b)) for a, b in self.leaves]
        sums += [(0, 0)] * (self.width - len(sums))
        self.nodes = [(0, 0)] * self.width + sums
        for k in range(self.width - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        (a, b), (c, d) = self.nodes[2 * k], self.nodes[2 * k + 1]
        self.nodes[k] = (a + c, b + d)

    @property
    def tokens(self) -> int:
        return self.nodes[1][1]

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character and where it begins; the last leaf for the end of the text."""
        k, begin = 1, 0
        while k < self.width:
            k *= 2
            if position >= begin + self.nodes[k][0] and self.nodes[k + 1][0]:
                begin += self.nodes[k][0]
                k += 1
        return min(k - self.width, max(0, len(self.leaves) - 1)), begin

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of characters start to end; returns the tokens of the new text."""
        start, end = max(0, min(start, len(self.text))), max(0, min(end, len(self.text)))
        end = max(start, end)
        old_text, self.text = self.text, self.text[:start] + new + self.text[end:]
        if not self.leaves:
            self.__init__(self.text, self.counter)
            self.recounted = len(self.text)
            return self.tokens
        first, begin = self._leaf_at(start)
        # step back into the leaf before where the edit stands near its leaf's beginning
        index, at = 0, begin
        while index < len(self.leaves[first][0]) and at + self.leaves[first][0][index] < start:
            at += self.leaves[first][0][index]
            index += 1
        while index < BACK and first > 0:
            first -= 1
            begin -= self.nodes[self.width + first][0]
            index += len(self.leaves[first][0])
        index = max(0, index - BACK)
        at = begin + sum(self.leaves[first][0][:index])
        kept_lengths, kept_counts = self.leaves[first][0][:index], self.leaves[first][1][:index]

        shift = len(new) - (end - start)
        last, place, old_end = first, index, at  # old pre-tokens passed so far end at old_end
        lengths, counts, done = [], [], at
        matches = self.counter.pattern.finditer(self.text, at)
        while True:
            while last < len(self.leaves) and old_end < max(end, done - shift):
                old_end += self.leaves[last][0][place]
                place += 1
                if place == len(self.leaves[last][0]):
                    last, place = last + 1, 0
            if old_end >= end and old_end == done - shift and done >= start + len(new):
                break
            match = next(matches, None)
            if match is None:
                last, place = len(self.leaves), 0
                break
            lengths.append(match.end() - match.start())
            counts.append(self.counter[match[0]])
            done = match.end()
        self.recounted += sum(lengths)
        if last < len(self.leaves):
            lengths += self.leaves[last][0][place:]
            counts += self.leaves[last][1][place:]
            last += 1
        self._put(first, last, kept_lengths + lengths, kept_counts + counts)
        assert len(old_text) + shift == len(self.text) == self.nodes[1][0]
        return self.tokens

    def _put(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        """Put leaves in place of those from ``first`` to ``last`` (excluded); without a change of number only paths are updated."""
        wanted = max(1, len(lengths) // LEAF) if lengths else 0
        if last - first >= 1 and lengths and len(lengths) <= 2 * LEAF * (last - first) and len(lengths) >= last - first:
            wanted = last - first
        cuts = [len(lengths) * i // wanted for i in range(wanted + 1)] if wanted else [0]
        self.leaves[first:last] = [(lengths[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        if wanted != last - first:
            self._build()
            return
        changed = set()
        for k in range(first, last):
            self.nodes[self.width + k] = (sum(self.leaves[k][0]), sum(self.leaves[k][1]))
            changed.add((self.width + k) // 2)
        while changed - {0}:
            for k in changed:
                self._add(k)
            changed = {k // 2 for k in changed} - {0}


def count_edits(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = 40) -> DataFrame:
    """key, n_chars, n_tokens, edited_tokens, recounted_chars of every row.

    The edits put the first ``length`` characters of the text a second time at a third of it, and
    take out ``length`` characters at two thirds; recounted_chars is how much of the text the edits
    had to count anew.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_chars long, n_tokens long, edited_tokens long, recounted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            out = []
            for value in batch.column(1):
                content = value.as_py() or ""
                tree = CountTree(content, counter)
                before = tree.tokens
                tree.replace(len(content) // 3, len(content) // 3, content[:length])
                place = 2 * len(tree.text) // 3
                tree.replace(place, place + length, "")
                out.append((len(content), before, tree.tokens, tree.recounted))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=[key, "n_chars", "n_tokens", "edited_tokens", "recounted_chars"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, schema)
