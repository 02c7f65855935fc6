"""Rows parted by a bit map of hashes, so that an exact join moves few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map.
MAP = 1 << 25


def parted(rows: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash in ``column`` has its bit set in a bit map of the wanted ones, which are all of those and a few others,
    and the rows without, null hashes among them. Nothing of ``rows`` is moved.

    At most ``MAP`` / 64 rows are broadcast, 12 MB; with many more hashes than bits the map only stops sparing."""
    bit = F.pmod(F.col(column), F.lit(MAP))
    mask = F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    words = wanted.select(bit.alias("_bit")).where("_bit IS NOT NULL").groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    placed = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(words), "_word", "left")
    marked = F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))
    return placed.where(marked).select(rows.columns), placed.where(~marked).select(rows.columns)
