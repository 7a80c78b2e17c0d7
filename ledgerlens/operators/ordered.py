"""Ordered numbering, look-back and quantile cuts that survive hot keys.

A window over a hot key puts all of its rows into one task. Here the rows of a key are first split
into cells of equal rank value and at most 2**BLOCK_BITS sequence numbers; the window runs inside a
cell. Far smaller passes carry the state on: over the cells of one key and rank value, then over the
rank values of a key, so no window holds all cells of a hot key. The sequence column must be a unique
integer; the closer it is to a running number, the fewer the cells.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.schemas import SEQ

BLOCK_BITS = 20
_NO_DAY = 2**31 - 1


def day_rank(day: Column) -> Column:
    """Days since 1970 as a non-null sort key that puts missing dates last."""
    return F.coalesce(F.unix_date(day), F.lit(_NO_DAY))


def _cells(df: DataFrame, keys: Sequence[str], rank: Column, seq: str, bits: int):
    """``df`` with its cell columns, the names of the key part and of the whole cell."""
    parts = [f"_key{i}" for i in range(len(keys))]
    out = df
    for part, key in zip(parts, keys):
        out = out.withColumn(part, F.coalesce(F.col(key).cast("string"), F.lit("\u0000")))
    out = out.withColumn("_rank", rank).withColumn("_block", F.shiftright(F.col(seq), bits))
    return out, parts, [*parts, "_rank", "_block"]


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    rank: Column,
    out: str,
    seq: str = SEQ,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add ROW_NUMBER per key in (rank, seq) order."""
    split, parts, cell = _cells(df, keys, rank, seq, bits)
    ranked = [*parts, "_rank"]
    earlier = Window.partitionBy(*ranked).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy(*parts).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    sizes = split.groupBy(*cell).agg(F.count(F.lit(1)).alias("_size"))
    starts = (
        sizes.groupBy(*ranked)
        .agg(F.sum("_size").alias("_size"))
        .select(*ranked, F.coalesce(F.sum("_size").over(smaller), F.lit(0)).alias("_start"))
    )
    offsets = (
        sizes.select(*cell, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_earlier"))
        .join(starts, ranked)
        .select(*cell, (F.col("_start") + F.col("_earlier")).alias("_before"))
        .where(F.col("_before") > 0)
    )
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(seq))
    return (
        split.withColumn("_inside", inside)
        .join(offsets, cell, "left")
        .withColumn(out, F.col("_inside") + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, out)
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    rank: Column,
    columns: Sequence[str],
    out: str,
    keep: Column,
    across: bool = True,
    seq: str = SEQ,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Rows that satisfy ``keep``, each with a struct of the key's preceding row, NULL for the first.

    The order is (rank, seq) over all rows; ``keep`` only limits which rows are returned. With
    ``across`` off, the preceding row must have the same rank.
    """
    split, parts, cell = _cells(df, keys, rank, seq, bits)
    ranked = [*parts, "_rank"]
    tails = split.groupBy(*cell).agg(*[F.max_by(c, seq).alias(f"_last_{c}") for c in columns])
    last = F.struct(*[F.col(f"_last_{c}").alias(c) for c in columns])
    tails = tails.select(*cell, last.alias("_tail"))
    earlier = F.lag("_tail").over(Window.partitionBy(*ranked).orderBy("_block"))
    carried = tails.select(*cell, earlier.alias("_carried"))
    if across:
        smaller = F.lag("_end").over(Window.partitionBy(*parts).orderBy("_rank"))
        ends = tails.groupBy(*ranked).agg(F.max_by("_tail", "_block").alias("_end"))
        carried = carried.join(ends.select(*ranked, smaller.alias("_prior")), ranked).select(
            *cell, F.coalesce("_carried", "_prior").alias("_carried")
        )
    carried = carried.where(F.col("_carried").isNotNull())
    inside = F.lag(F.struct(*columns)).over(Window.partitionBy(*cell).orderBy(seq))
    return (
        split.withColumn("_inside", inside)
        .where(keep)
        .join(carried, cell, "left")
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .select(*df.columns, out)
    )


def with_tile(
    df: DataFrame,
    score: Column,
    tiles: int,
    out: str,
    coarse: int,
    seq: str = SEQ,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add NTILE(tiles) over the whole frame in (score, seq) order, without a single-task sort.

    ``score`` is a non-null integer. Only the last row of each tile is located: counts per score cell
    are added up inside ranges of ``coarse`` score units, then across ranges, and the cell that holds
    a tile's last position is ranked. Rows are then labelled by comparison with those few cut rows.
    """
    scored = df.withColumn("_score", score)
    split, _, _ = _cells(scored, [], F.col("_score"), seq, bits)
    split = split.withColumn("_range", F.floor(F.col("_score") / coarse))
    counts = split.groupBy("_range", "_rank", "_block").agg(F.count(F.lit(1)).alias("_size"))

    # one row per range of scores: the only window without a partition, over that short list
    ranges = counts.groupBy("_range").agg(F.sum("_size").alias("_size"))
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        "_range",
        F.coalesce(F.sum("_size").over(whole), F.lit(0)).alias("_range_start"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"),
    )
    inner = (
        Window.partitionBy("_range")
        .orderBy("_rank", "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("_range_start") + F.coalesce(F.sum("_size").over(inner), F.lit(0))
    placed = counts.join(starts, "_range").withColumn("_start", start)

    # position of the last row of tiles 1 .. tiles-1: the first total % tiles tiles hold one row more
    total, size = F.col("_total"), F.col("_total").cast("long")
    positions = F.transform(
        F.sequence(F.lit(1), F.lit(tiles - 1)),
        lambda t: F.struct(
            t.alias("tile"),
            (t * F.expr(f"_total div {tiles}") + F.least(t.cast("long"), size % tiles)).alias("position"),
        ),
    )
    cuts = (
        placed.withColumn("_cut", F.explode(positions))
        .where(
            (F.col("_cut.position") > F.col("_start"))
            & (F.col("_cut.position") <= F.col("_start") + F.col("_size"))
        )
        .select("_rank", "_block", "_cut.tile", (F.col("_cut.position") - F.col("_start")).alias("_nth"))
    )
    inside = F.row_number().over(Window.partitionBy("_rank", "_block", "tile").orderBy(seq))
    cut_rows = (
        split.select("_rank", "_block", seq)
        .join(F.broadcast(cuts), ["_rank", "_block"])  # at most tiles - 1 rows
        .withColumn("_inside", inside)
        .where(F.col("_inside") == F.col("_nth"))
        .agg(F.array_sort(F.collect_list(F.struct("_rank", seq))).alias("cuts"))
    )
    here = F.struct(F.col("_score").alias("_rank"), F.col(seq))
    passed = F.filter(F.col("_cuts"), lambda cut: cut < here)
    return (
        scored.withColumn("_cuts", cut_rows.scalar())
        .withColumn(out, F.size(passed) + 1)
        .select(*df.columns, out)
    )
