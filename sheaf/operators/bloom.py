"""A Bloom filter as a table of bitmaps, and the anti-join it splits in two.

Each key sets ``PROBES`` bits in one block of ``BLOCK_BITS``, the size of Spark's bitmap aggregate, so a lookup is one
broadcast join on the block and a few bits of one value. The number of blocks follows the number of keys up to
``FILTER_BYTES``, which is what bounds the broadcast; with more keys the filter lets more pass, and the join after it
has more to do. The rows never depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import durable, lookup_side

BLOCK_BITS = 32_768
BITS_PER_KEY = 12
PROBES = 4
FILTER_BYTES = 64 << 20

_BLOCK, _HASH, _BITS = "__block", "__hash", "__bits"


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _positions(hash_: Column) -> list[Column]:
    # Fifteen bits of the hash for each probe.
    return [F.shiftrightunsigned(hash_, 15 * n).bitwiseAND(F.lit(BLOCK_BITS - 1)) for n in range(PROBES)]


def block_count(keys: int) -> int:
    """Blocks for that many keys: 12 bits a key, within ``FILTER_BYTES``."""
    wanted = -(-keys * BITS_PER_KEY // BLOCK_BITS)
    return max(1, min(wanted, FILTER_BYTES * 8 // BLOCK_BITS))


def bloom_filter(keys: DataFrame, column: str, expected: int | None = None) -> tuple[DataFrame, int]:
    """``(__block, __bits)`` for the values of ``column``, and the number of blocks; nulls set nothing.

    Repeated keys are folded before they are sent to their block, as a hash, not as text. The table is written
    once. Without ``expected`` the keys are counted first, repeats included.
    """
    keys = keys.select(F.col(column).alias("k")).where(F.col("k").isNotNull())
    blocks = block_count(keys.count() if expected is None else expected)
    hashed = keys.select(_block(F.col("k"), blocks).alias(_BLOCK), F.xxhash64("k", F.lit(1)).alias(_HASH)).distinct()
    # Sent by block as hashes: partial bitmaps of each task would be far larger than what they stand for.
    probes = hashed.repartition(_BLOCK).select(_BLOCK, F.explode(F.array(*_positions(F.col(_HASH)))).alias("p"))
    return durable(probes.groupBy(_BLOCK).agg(F.bitmap_construct_agg("p").alias(_BITS)), "bloom"), blocks


def with_maybe(df: DataFrame, column: str, bloom: tuple[DataFrame, int], name: str = "__maybe") -> DataFrame:
    """Add ``name``: false where the value is certainly not among the filter's keys. Null is false."""
    table, blocks = bloom
    key = F.col(column)

    def is_set(position: Column) -> Column:
        byte = F.substring(F.col(_BITS), (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.getbit(value, position.bitwiseAND(F.lit(7)).cast("int")) == 1

    found = F.lit(True)
    for position in _positions(F.col(_HASH)):
        found = found & is_set(position)
    hashed = df.withColumn(_BLOCK, _block(key, blocks)).withColumn(_HASH, F.xxhash64(key, F.lit(1)))
    return hashed.join(F.broadcast(table), _BLOCK, "left").select(
        *df.columns, F.coalesce(key.isNotNull() & found, F.lit(False)).alias(name)
    )


def split_anti_join(df: DataFrame, keys: DataFrame, column: str, bloom: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among ``keys`` (distinct, same name); rows with null stay.

    Rows that the filter rules out are done where they are read; only the others, the known ones and about one
    new one in a hundred, are sent to the join. ``df`` is read twice, with the filter applied in both reads, so it
    should be a scan or a written table.
    """
    flagged = with_maybe(df, column, bloom or bloom_filter(keys, column))
    sure = flagged.where(~F.col("__maybe")).drop("__maybe")
    rest = flagged.where("__maybe").join(lookup_side(keys.select(column)), column, "left_anti")
    return sure.unionByName(rest.select(*df.columns))
