"""A filter of keys, small enough to go to every task at any scale."""

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplemill.plans.scratch import written

# A block's bits, 4 KB, are words of 64 bits.
BLOCK_BITS = 32_768
WORDS = BLOCK_BITS // 64
BITS_PER_KEY = 8
# 64 MB at most. With more than 64 million keys the filter lets more rows through
# that have no key; it never holds one back that has.
MOST_BLOCKS = 16_384
# So many keys are broadcast as their hashes, about 64 MB of them.
FEW_KEYS = 500_000


class KeyFilter:
    """Bloom filter of the keys of a table, as a table of bitmaps.

    A key has two bits in one block. Blocks are a row each, bounded in number, and
    are broadcast; a row is tested by a look-up and two bits of it, in the JVM.
    """

    def __init__(self, keys: DataFrame, key: str, most_blocks: int = MOST_BLOCKS):
        n = keys.count()
        self.few = n <= FEW_KEYS
        self.blocks = min(most_blocks, n * BITS_PER_KEY // BLOCK_BITS + 1)
        self._hashed = keys.select(F.xxhash64(key).alias("_hash"))

    @cached_property
    def table(self) -> DataFrame:
        h = F.col("_hash")
        bits = self._hashed.select(
            self._block(h).alias("_block"), F.explode(F.array(*self._bits(h))).alias("_bit")
        ).select("_block", F.shiftright("_bit", 6).alias("_word"), self._mask("_bit").alias("_set"))
        every = self._hashed.sparkSession.range(self.blocks * WORDS).select(
            F.shiftright("id", 9).alias("_block"),
            F.col("id").bitwiseAND(WORDS - 1).alias("_word"),
            F.lit(0).cast("bigint").alias("_set"),
        )
        words = bits.unionByName(every).groupBy("_block", "_word").agg(F.bit_or("_set").alias("_set"))
        whole = F.sort_array(F.collect_list(F.struct("_word", "_set")))["_set"]
        return written(words.groupBy("_block").agg(whole.alias("_bitmap")))

    @cached_property
    def _hashes(self) -> DataFrame:
        return written(self._hashed.distinct())

    def kept(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key may be in the table. With few keys a semi-join by their
        hashes does it, which Spark does before it makes the columns of the rows."""
        if not self.few:
            return self.marked(rows, key, "_may").where("_may").drop("_may")
        return rows.join(F.broadcast(self._hashes), F.xxhash64(key) == F.col("_hash"), "left_semi")

    def _block(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.blocks))

    def _bits(self, h: Column) -> tuple[Column, Column]:
        return tuple(
            F.shiftrightunsigned(h, shift).bitwiseAND(BLOCK_BITS - 1) for shift in (34, 49)
        )

    def _mask(self, bit: str) -> Column:
        # The last bit is the sign of a number; a shift cannot be that long.
        place = F.col(bit).bitwiseAND(63)
        powers = F.array(*(F.lit(2**i if i < 63 else -(2**63)).cast("bigint") for i in range(64)))
        return F.get(powers, place.cast("int"))

    def marked(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """Rows with whether their key may be in the table; if not, it is not."""
        h = F.xxhash64(key)

        def is_set(bit: Column) -> Column:
            word = F.get("_bitmap", F.shiftright(bit, 6).cast("int"))
            return F.getbit(word, bit.bitwiseAND(63).cast("int")) == 1

        first, second = (is_set(bit) for bit in self._bits(h))
        return (
            rows.withColumn("_block", self._block(h))
            .join(F.broadcast(self.table), "_block", "left")
            .withColumn(name, F.coalesce(first & second, F.lit(False)))
            .drop("_block", "_bitmap")
        )
