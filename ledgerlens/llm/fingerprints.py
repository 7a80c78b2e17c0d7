"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is what stands between line feeds; its digest is SHA-256 over a mark and its text. A
section ends after an empty paragraph, after one whose digest begins with 0 (so that borders move
with the content, not with its position), and at the end; its node hashes its paragraphs' digests.
The root hashes the section nodes. Splitting at line feeds can be undone and the borders follow from
the digests, so two texts have the same root exactly if they are equal. Branches that differ locate an
edit: the paragraphs between the equal sections at both ends.

Below the paragraphs, likeness compares the sets of short runs of words (leaves): twice the common
leaves by the sum of both counts, 1 for equal roots.

Nulls count as empty texts. An empty text has one empty paragraph, one section and no leaf; two
different texts without leaves have likeness 0.
"""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import let, text_of

#: Runs of at most eight words that end early after a sentence.
LEAF = r"(?:[^\t\n\x0b\f\r ]*[^\t\n\x0b\f\r .!?][\t\x0b\f\r ]+){0,7}[^\t\n\x0b\f\r ]+[\t\x0b\f\r ]*"
DOCS_PER_CELL = 1024
MOST_CELLS = 65_536
PICKED = 16


def leaves(text: Column) -> Column:
    """Distinct hashes of the text's runs of words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda leaf: F.xxhash64(leaf)))


def tree(text: Column) -> Column:
    """struct(root, sections, ends, paragraphs): digests, and the number of the last paragraph of each section from 1."""
    blank = F.sha2(F.lit("p"), 256)

    def over(digests: Column) -> Column:
        last = lambda i: (i == F.size(digests)) | F.startswith(F.get(digests, i - 1), F.lit("0")) | (F.get(digests, i - 1) == blank)
        return let(F.filter(F.sequence(F.lit(1), F.size(digests)), last), lambda ends: above(digests, ends))

    def above(digests: Column, ends: Column) -> Column:
        def node(end: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(ends, k - 1), F.lit(0))
            return F.sha2(F.concat(F.lit("s"), F.array_join(F.slice(digests, begin + 1, end - begin), "")), 256)

        return let(F.transform(ends, node), lambda nodes: F.struct(
            F.sha2(F.concat(F.lit("r"), F.array_join(nodes, "")), 256).alias("root"),
            nodes.alias("sections"), ends.alias("ends"), digests.alias("paragraphs"),
        ))

    return let(F.transform(F.split(text, "\n", -1), lambda p: F.sha2(F.concat(F.lit("p"), p), 256)), over)


def edits(old: Column, new: Column) -> Column:
    """struct(changed_from, changed_to, changed_paragraphs): where ``new`` differs from ``old``.

    Leading and trailing sections with equal nodes are passed over; the paragraphs (from 0, to
    excluded) of the branches between are compared. All null for equal roots.
    """
    equal = lambda a, b: a.eqNullSafe(b)
    head = F.array_position(F.zip_with(new["sections"], old["sections"], equal), False).cast("int") - 1
    foot = F.array_position(F.zip_with(F.reverse(new["sections"]), F.reverse(old["sections"]), equal), False).cast("int") - 1

    def between(begin: Column, tail: Column, side: Column) -> tuple[Column, Column]:
        end = F.coalesce(F.get(side["ends"], F.size(side["ends"]) - 1 - tail), F.lit(0))
        return end, F.slice(side["paragraphs"], begin + 1, F.greatest(end - begin, F.lit(0)))

    def at(place: Column) -> Column:
        begin = F.coalesce(F.get(new["ends"], place["head"] - 1), F.lit(0))
        tail = F.least(place["foot"], F.least(F.size(new["sections"]), F.size(old["sections"])) - place["head"])
        end, fresh = between(begin, tail, new)
        _, known = between(begin, tail, old)
        return F.struct(begin.alias("changed_from"), end.alias("changed_to"), F.size(F.array_except(fresh, known)).alias("changed_paragraphs"))

    return F.when(old["root"] != new["root"], let(F.struct(head.alias("head"), foot.alias("foot")), at))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """0 to 1; 1 for equal roots."""
    both = F.size(leaves_a) + F.size(leaves_b)
    share = F.when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / both)
    return F.when(root_a == root_b, 1.0).otherwise(share)


def with_cell(docs: DataFrame, key: str) -> DataFrame:
    """Add ``__cell``: the number of a range of ``key`` that holds about 1 024 rows, -1 for a null key.

    Keys of ``docs`` are picked by hash, PICKED for each range wanted, and every PICKED-th is a border; so
    ranges follow the keys however unevenly those are spread. At most 2 * MOST_CELLS borders are used.
    """
    rows = docs.count()
    one_in = math.ceil(rows / (min(MOST_CELLS, math.ceil(rows / DOCS_PER_CELL)) or 1)) or 1
    each = min(PICKED, one_in)
    number = F.col(key).cast("double")
    picked = docs.where(number.isNotNull() & (F.pmod(F.xxhash64(key), F.lit(one_in // each)) == 0))
    every = F.filter(F.array_sort(F.collect_set(number)), lambda x, i: i % each == each - 1)
    borders = picked.agg(F.slice(every, 1, 2 * MOST_CELLS).alias("borders")).first().borders
    if not borders:
        borders = [0.0]
    ranges = Bucketizer(splits=[-math.inf, *borders, math.inf], inputCol="__number", outputCol="__range", handleInvalid="keep")
    placed = ranges.transform(docs.withColumn("__number", number))
    cell = F.when(F.col(key).isNull(), -1).otherwise(F.col("__range"))
    return placed.withColumn("__cell", cell.cast("long")).drop("__number", "__range")


def with_next(docs: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Add ``name``: the value of ``column`` in the next row by ``key`` (nulls first), after the last row the first's.

    Rows of equal keys stand in the order of ``column``. The rows that open a cell (a range of keys)
    also go to the cell before, so one shuffle by cell is enough and no task sees all rows.
    """
    placed = with_cell(docs, key)
    everything = Window.orderBy("__cell")
    borders = placed.groupBy("__cell").agg(F.min(key).alias("__opens")).select(
        F.col("__cell").alias("__of"), "__opens",
        F.coalesce(F.lag("__cell").over(everything), F.max("__cell").over(Window.partitionBy())).alias("__before"),
    )
    # at most 2 * MOST_CELLS + 2 rows, so it may be broadcast whatever the input
    opening = placed.join(F.broadcast(borders), F.col("__cell") == F.col("__of"))
    home = F.struct(F.col("__cell").alias("cell"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("__before").alias("cell"), F.lit(True).alias("guest"))
    targets = F.when(F.col(key).eqNullSafe(F.col("__opens")), F.array(home, guest)).otherwise(F.array(home))
    sent = opening.withColumn("__to", F.explode(targets)).select(*docs.columns, F.col("__to.cell").alias("__cell"), F.col("__to.guest").alias("__guest"))
    order = Window.partitionBy("__cell").orderBy("__guest", F.col(key).asc_nulls_first(), F.col(column).asc_nulls_first())
    return sent.withColumn(name, F.lead(column).over(order)).filter(~F.col("__guest")).drop("__cell", "__guest")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with fingerprint, n_sections and n_paragraphs (columns of these names are replaced)."""
    grown = docs.withColumn("__tree", tree(text_of(text)))
    return grown.withColumns({
        "fingerprint": F.col("__tree.root"), "n_sections": F.size("__tree.sections"), "n_paragraphs": F.size("__tree.paragraphs"),
    }).drop("__tree")


def against_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and that to the next document.

    The edit replaces the last floor(n/2) code points by the first as many of the next document.
    """
    own = docs.select("doc_id", text_of("text").alias("text"))
    paired = with_next(own, "doc_id", "text", "next_text")
    n = F.length("text").cast("bigint")
    half = F.floor(n / 2).cast("int")
    texts = paired.select("doc_id", n.alias("n_chars"), "text", "next_text", F.concat(F.substring("text", F.lit(1), n.cast("int") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    grown = texts.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("text")).alias("t"), tree(F.col("edited")).alias("e"), tree(F.col("next_text"))["root"].alias("next_root"),
        leaves(F.col("text")).alias("tl"), leaves(F.col("edited")).alias("el"), leaves(F.col("next_text")).alias("nl"),
    )
    changed = edits(F.col("t"), F.col("e"))
    return grown.select(
        "doc_id", "n_chars", "edited_sha256", F.col("t.root").alias("fingerprint"), F.col("e.root").alias("edited_fingerprint"),
        likeness(F.col("t.root"), F.col("tl"), F.col("e.root"), F.col("el")).alias("near_edited"),
        likeness(F.col("t.root"), F.col("tl"), F.col("next_root"), F.col("nl")).alias("near_next"),
        F.size("t.sections").alias("n_sections"), F.size("t.paragraphs").alias("n_paragraphs"), changed.alias("c"),
    ).select("*", "c.changed_from", "c.changed_to", "c.changed_paragraphs").drop("c")
