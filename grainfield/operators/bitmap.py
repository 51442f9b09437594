"""Hit voxels as bitmaps: one row for up to 32,768 neighbouring cells instead of one a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, voxel_id
from .select import hit_voxels

#: Bitmaps, of four kilobytes each, up to which all tasks get all of them.
FEW = 4096
_WORDS = 1024


def hit_bitmaps(scores: DataFrame, component: int = 0, isovalue: float = 1.0) -> DataFrame:
    """(bucket, words): the hit voxels of a component, a bit each, in buckets of neighbouring ids; words are 32 bits.

    Partial bitmaps are made where the scores are, so a bucket is one row of each task in the shuffle, however many hits it has.
    """
    hits = hit_voxels(scores, component, isovalue)
    bits = hits.groupBy(F.bitmap_bucket_number("voxel_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("voxel_id")).alias("bits"))

    def word(i: Column) -> Column:
        four = F.conv(F.hex(F.substring("bits", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
        return F.when(four >= 1 << 31, four - (1 << 32)).otherwise(four).cast("int")

    return bits.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), word).alias("words"))


def in_bitmap(cell: Column, words: Column) -> Column:
    """Whether the bit of a cell is set in its bucket's words; false without a cell or words."""
    at = F.bitmap_bit_position(cell).cast("int")
    # a word's first byte holds its first eight bits, but is its highest
    bit = at.bitwiseAND(31).bitwiseXOR(24)
    return F.coalesce(F.getbit(F.get(words, F.shiftright(at, 5)), bit) == 1, F.lit(False))


def select_by_bitmap(ions: DataFrame, bitmaps: DataFrame, grid: GridSpec, invert: bool = False, bounds: str = "wrap", few: int = FEW) -> DataFrame:
    """The rows of ``select_ions`` from bitmaps of hits; ions may be a stream, bitmaps should be a written table.

    The join's right side has a row a bucket, not a row a hit. Up to ``few`` of them (counted; 16 MB at the default) go to every task; more
    are joined by bucket, where Spark splits crowded buckets. Rows in buckets without hits need no test.
    """
    own = ions.withColumn("_bit_cell", voxel_id(F.col("x"), F.col("y"), F.col("z"), grid, bounds))
    own = own.withColumn("_bit_bucket", F.bitmap_bucket_number("_bit_cell"))
    right = bitmaps.select(F.col("bucket").alias("_bit_own"), F.col("words").alias("_bit_words"))
    if bitmaps.limit(few + 1).count() <= few:
        right = F.broadcast(right)
    hit = in_bitmap(F.col("_bit_cell"), F.col("_bit_words"))
    joined = own.join(right, F.col("_bit_bucket") == F.col("_bit_own"), "left" if invert else "inner")
    return joined.where(~hit if invert else hit).select(*[F.col(f"`{c}`") for c in ions.columns])
