"""Operator 9: rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a uniform number u from md5(key ':' shard) and the
score -weight / ln(u); a record goes to the shard of its highest score. A new
shard can only win records, so those that move all move into it, in proportion
to its weight.

Records with a null key are hashed as the key '' (all into one shard); equal
keys share a shard. Slots number the records of each shard from 0 without gaps.
An empty table gives an empty result; columns beside the key and the text are
not read, so clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

N_SHARDS = 24
#: 13 hex digits of md5 are 52 bits, which a double holds exactly
_BITS = 52
#: slot order within a shard: by this many ranges of md5(key), then by key
_RANGE_HEX = 3


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) that a record's string key goes to; ties go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = []
    for i, w in enumerate(weights):
        digits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{i}")).cast("binary")), 1, 13), 16, 10)
        u = (digits.cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**_BITS))
        scores.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(-i).alias("shard")))
    if len(scores) == 1:
        return F.lit(0)
    return -F.greatest(*scores)["shard"]


def assign(
    df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * N_SHARDS, extra_weight: float = 1.0
) -> DataFrame:
    """Return key, size, text_crc32, law, shard, slot and grown_shard of each row of df.

    grown_shard is the row's shard once one more shard of extra_weight is added.
    Slots come from counts: of each (shard, range of keys), then of the equal
    records in each input partition, so no task ever holds a whole shard, even
    where one record is repeated in a third of all rows.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous_shard(k, weights).alias("shard"),
        rendezvous_shard(k, [*weights, extra_weight]).alias("grown_shard"),
        F.substring(F.md5(k.cast("binary")), 1, _RANGE_HEX).alias("range"),
        F.spark_partition_id().alias("part"),
    )
    rows = stored(rows, "rendezvous")
    same = ["shard", "range", "doc_id", "text_crc32", "size", "part"]
    counts = rows.groupBy(*same).agg(F.count("*").alias("n"))
    ranges = counts.groupBy("shard", "range").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*same, F.coalesce(F.sum("n").over(within), F.lit(0)).alias("offset")).join(starts, ["shard", "range"])
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("grown_shard")) - 1)
    hit = F.lit(True)
    o = offsets.select(*[F.col(c).alias(f"o_{c}") for c in same], "offset", "start")
    for c in same:
        hit = hit & numbered[c].eqNullSafe(o[f"o_{c}"])
    return numbered.join(o, hit).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("offset") + F.col("nth")).cast("bigint").alias("slot"), "grown_shard",
    )


def op9_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))


def _score_sql(i: int) -> str:
    return f"-1.0 / ln((('0x' || left(md5(k || ':{i}'), 13))::BIGINT::DOUBLE + 0.5) / {2**_BITS}.0)"


def _shard_sql(n: int) -> str:
    return f"list_position(scores[1:{n}], list_max(scores[1:{n}])) - 1"


#: crc32 bit by bit over each text's bytes, the table made from the polynomial
ORACLE_SQL = {
    "op9_rendezvous": f"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
keyed AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS text FROM documents),
scored AS (
  SELECT doc_id, k, octet_length(encode(text)) + 8 AS size,
    CASE WHEN text = '' THEN 0 ELSE xor(4294967295, list_reduce(
      [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(text)), '..')],
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) END AS text_crc32,
    [{", ".join(_score_sql(i) for i in range(N_SHARDS + 1))}] AS scores
  FROM keyed, tab)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, ({_shard_sql(N_SHARDS)})::INTEGER AS shard,
  row_number() OVER (PARTITION BY {_shard_sql(N_SHARDS)} ORDER BY left(md5(k), {_RANGE_HEX}), doc_id, text_crc32, size) - 1 AS slot,
  ({_shard_sql(N_SHARDS + 1)})::INTEGER AS grown_shard
FROM scored"""
}
QUERIES = {"op9_rendezvous": op9_rendezvous}
