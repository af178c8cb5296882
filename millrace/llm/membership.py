"""Finding the rows of a large table whose key is in another, without shuffling the rows that are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bits of a filter: as a table of 64-bit words it is 8 MB at most, whatever the number of keys. Beyond some
#: two million keys it lets more and more of the other rows through, and of a hundred million nearly all: those are shuffled
#: and dropped by the join that follows, so the result is the same and the worst case is one shuffle of the table.
MOST_BITS = 1 << 25
LEAST_BITS = 1 << 12


def filter_size(count: int) -> int:
    """Bits of a filter of so many keys: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))


def key_words(keys: DataFrame, place: Column, count: int) -> tuple[DataFrame, int]:
    """A bitmap of a number for each key, as rows (word, bits), and its number of bits."""
    size = filter_size(count)
    bits = keys.select(F.pmod(place, F.lit(size)).alias("place")).selectExpr("shiftright(place, 6) AS __millrace_word", "shiftleft(1L, CAST(place & 63 AS INT)) AS bit")
    return bits.groupBy("__millrace_word").agg(F.bit_or("bit").alias("__millrace_bits")), size


def key_filter(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """A bitmap of the keys' hashes, as rows (word, bits), and its number of bits."""
    return key_words(keys, F.xxhash64(key), count)


def split_by_filter(rows: DataFrame, key: Column, filter_rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the filter, rows whose key is not). A null key is in no filter."""
    place = F.pmod(F.xxhash64(key), F.lit(size))
    marked = rows.withColumn("__millrace_place", place).withColumn("__millrace_word", F.shiftright("__millrace_place", 6))
    marked = marked.join(F.broadcast(filter_rows), "__millrace_word", "left")
    hit = F.expr("coalesce((shiftright(__millrace_bits, CAST(__millrace_place & 63 AS INT)) & 1) = 1, false)") & key.isNotNull()
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)
