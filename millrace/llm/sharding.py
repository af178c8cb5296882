"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Every (key, shard) pair has a pseudo-random score; a record goes to the shard where ln(u) / weight is
largest. Which other shards exist does not change a pair's score, so one more shard only takes rows to itself.

Slots number the rows of a shard without gaps. A shard holds a fixed share of all rows, so its rows are
numbered within buckets of a bounded expected size, and each bucket starts behind those before it. The scores are
computed once, and what they place is written. The table of bucket starts is joined as the session's threshold says.

Cases: a null text has size 16 and the checksum of no bytes; a null key hashes as an empty one, so such rows share a
shard, in which their buckets go by the checksum; rows with equal keys share a shard and get different slots; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import scratch, written

#: Hexadecimal digits of the digest that make the score: 52 bits, which a double holds exactly.
DIGITS = 13
SPAN = float(16**DIGITS)
OVERHEAD = 16
#: Rows that a slot bucket holds, by expectation.
BUCKET_ROWS = 4000


def unit_hash(text: Column) -> Column:
    """A number strictly between 0 and 1 from the digest of a string."""
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(SPAN)


def shard_score(key: Column, shard: Column, weight: Column) -> Column:
    """Comparable scores: the greatest wins, ties go to the lower shard."""
    return F.struct((F.ln(unit_hash(F.concat(key, F.lit(":"), shard.cast("string")))) / weight).alias("score"), (-shard).alias("minus_shard"))


def rendezvous(key: Column, weights: list[float]) -> tuple[Column, Column]:
    """The winning score struct among len(weights) shards, and the shard's number."""
    shards = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    if len(set(weights)) == 1:
        best = F.array_max(F.transform(shards, lambda s: shard_score(key, s, F.lit(float(weights[0])))))
    else:
        table = F.array(*(F.lit(float(w)) for w in weights))
        best = F.array_max(F.transform(shards, lambda s: shard_score(key, s, F.element_at(table, s + 1))))
    return best, (-best["minus_shard"]).cast("int")


@scratch
def assign_shards(docs: DataFrame, shards: int, weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """One row per document: its size, checksum, shard and slot, and its shard if there were one more."""
    weights = weights or [1.0] * shards
    rows = docs.select().count()
    buckets = max(1, -(-rows // (shards * BUCKET_ROWS)))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    best, _ = rendezvous(key, weights)
    slim = slim.withColumn("best", best).withColumn("grown", F.greatest(F.col("best"), shard_score(key, F.lit(shards), F.lit(float(grown_weight)))))
    placed = slim.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        (-F.col("best.minus_shard")).cast("int").alias("shard"),
        (-F.col("grown.minus_shard")).cast("int").alias("grown_shard"),
        F.pmod(F.when(F.col("doc_id").isNull(), F.col("text_crc32")).otherwise(F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("bigint")), F.lit(buckets)).cast("int").alias("bucket"),
    )
    placed = written(placed, "placed")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("place", F.row_number().over(within) - 1)
    if buckets > 1:
        # A row for each bucket; summed in each shard in the buckets' order.
        before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        numbered = numbered.join(starts, ["shard", "bucket"])
    else:
        numbered = numbered.withColumn("start", F.lit(0))
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("place")).cast("bigint").alias("slot"), "grown_shard")


#: The same over the table `documents`, with the checksum computed byte by byte from its table.
ORACLE_40 = """
WITH tbl AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0,0,0,0,0,0,0,0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, octet_length(encode(coalesce(text, ''))) AS n_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, k, n_bytes + 16 AS size,
         xor(CAST(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(h, '..'), lambda p: CAST('0x' || p AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS BIGINT), 4294967295) AS text_crc32
  FROM d, tbl
), r AS (
  SELECT doc_id, k, size, text_crc32, j, CAST('0x' || substr(md5(k || ':' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) AS u FROM s, range(41) g(j)
), b AS (
  SELECT doc_id, k, size, text_crc32,
         CAST(arg_max(j, u) FILTER (WHERE j < 40) AS INTEGER) AS shard, CAST(arg_max(j, u) AS INTEGER) AS grown_shard
  FROM r GROUP BY doc_id, k, size, text_crc32
), n AS (SELECT greatest(1, CAST(ceil(count(*) / 160000.0) AS BIGINT)) AS buckets FROM documents)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY CASE WHEN doc_id IS NULL THEN text_crc32 ELSE CAST('0x' || substr(md5(k), 1, 13) AS BIGINT) END % buckets, doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM b, n
"""
