"""Sharding by extendible hashing, in DataFrame functions only.

Every row has a bit string: the bits of ``md5(doc_id)``, then, past bit 32, of a
hash that also takes in a row number, so repeated ids can be told apart. The
directory starts with one bucket for the empty prefix; only a bucket over the
byte limit is split on one more bit. Byte counts are taken once per 16 bits of
prefix (65,536 rows at most, whatever the input), so a round of 16 possible
splits costs one aggregation; the directory of a round has that proven size and
is broadcast, and the documents themselves are never shuffled.

Defined results: null or empty texts weigh 0 bytes; a null id hashes as the
empty string; repeated rows are rows of their own; a row over the limit by
itself gets a shard of its own (``shard`` starts with ``x``); an empty table
gives an empty result. Columns called ``shard``, ``depth``, ``shard_bytes`` or
``n_bytes`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

BITS = 16
ROUNDS = 9
_MADE = ("n_bytes", "shard", "depth", "shard_bytes")


def _digits(round_: int) -> Column:
    """The 16 bits that a round of splits may use, as four hex digits."""
    if round_ < 2:
        return F.substring("__id_hex", 4 * round_ + 1, 4)
    return F.substring("__row_hex", 4 * (round_ - 2) + 1, 4)


def _directory(rows: DataFrame, round_: int, max_bytes: int) -> DataFrame:
    """Leaf of each (path so far, 16 bits); depth is null where 16 bits do not suffice."""
    counts = rows.groupBy("__path", _digits(round_).alias("__hex")).agg(F.sum("n_bytes").alias("b"))
    counts = counts.withColumn("__bits", F.lpad(F.conv("__hex", 16, 2), BITS, "0"))
    levels = counts.withColumn("level", F.explode(F.sequence(F.lit(0 if round_ == 0 else 1), F.lit(BITS))))
    levels = levels.withColumn("prefix", F.expr("left(__bits, level)"))
    sums = levels.groupBy("__path", "level", "prefix").agg(F.sum("b").alias("s"))
    fits = levels.join(sums, ["__path", "level", "prefix"]).groupBy("__path", "__hex", "__bits").agg(
        F.min(F.when(F.col("s") <= max_bytes, F.struct("level", "prefix", "s"))).alias("leaf")
    )
    return fits.select(
        "__path",
        "__hex",
        F.concat("__path", F.col("leaf.prefix")).alias("shard"),
        (F.col("leaf.level") + BITS * round_).cast("int").alias("depth"),
        F.col("leaf.s").alias("shard_bytes"),
        F.concat("__path", "__bits").alias("__next"),
    )


def extendible_shards(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, shard (hash-prefix bits), depth and shard_bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    names, keep = [c for c in docs.columns if c not in _MADE], ["__own"]
    own = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("__own")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(own, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.md5(key).alias("__id_hex"))
    light = scratch.save("sizes", rows.select("n_bytes", "__id_hex").filter(F.col("n_bytes") <= max_bytes).withColumn("__path", F.lit("")))
    done, round_ = [], 0
    again = F.row_number().over(W.partitionBy("__id_hex").orderBy("n_bytes"))  # over oversized rows only
    large = rows.filter(F.col("n_bytes") > max_bytes).select(
        *keep, "n_bytes", F.concat(F.lit("x"), "__id_hex", F.when(again > 1, F.concat(F.lit("."), again.cast("string"))).otherwise("")).alias("shard"), F.lit(4 * 32).alias("depth"), F.col("n_bytes").alias("shard_bytes")
    )
    rows = rows.filter(F.col("n_bytes") <= max_bytes).withColumn("__path", F.lit(""))
    while True:
        table = scratch.save(f"directory{round_}", _directory(light, round_, max_bytes))
        fixed = table.filter("depth is not null").drop("__next")
        # at most 65,536 rows below a path; paths that go on are few, as only oversized buckets split
        joined = rows.withColumn("__hex", _digits(round_)).join(_bounded(fixed), ["__path", "__hex"])
        done.append(joined.select(*keep, *_MADE))
        over = table.filter("depth is null").select("__path", "__hex", "__next")
        if over.isEmpty():
            break
        if round_ + 1 >= ROUNDS:
            raise RuntimeError(f"{BITS * ROUNDS} bits of hash do not tell the rows of a shard apart")
        more = lambda df: df.withColumn("__hex", _digits(round_)).join(_bounded(over), ["__path", "__hex"]).drop("__path", "__hex").withColumnRenamed("__next", "__path")
        rows = more(rows)
        if round_ == 1:  # what is left shares 32 bits: number the rows, once and for all
            rows = scratch.save("repeats", rows.withColumn("__uid", F.monotonically_increasing_id()))
            rows = rows.withColumn("__row_hex", F.md5(F.concat_ws("#", "__id_hex", F.col("__uid").cast("string"))))
            light = rows.select("n_bytes", "__id_hex", "__row_hex", "__path")
        else:
            light = scratch.save(f"rest{round_}", more(light))
        round_ += 1
    out = large
    for part in done:
        out = out.unionByName(part)
    return out.select(*[F.col(f"__own.`{c}`").alias(c) for c in names], *_MADE)


def _bounded(table: DataFrame) -> DataFrame:
    """Broadcast a directory whose row count, checked here, is within 2**17; else leave the join to Catalyst."""
    return F.broadcast(table) if table.count() <= 1 << (BITS + 1) else table


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; rows are dealt by shard first, so each is written by one task."""
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


SHARD_BYTES = 1 << 20


def op9_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return extendible_shards(docs, SHARD_BYTES).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hex
  FROM documents),
b AS (SELECT doc_id, n_bytes, hex, lpad(bin(CAST('0x' || left(hex, 4) AS INTEGER)), 16, '0') AS bits
      FROM d WHERE n_bytes <= {SHARD_BYTES}),
lv AS (SELECT b.*, l.level, left(bits, CAST(l.level AS INTEGER)) AS prefix FROM b, range(0, 17) AS l(level)),
s AS (SELECT level, prefix, CAST(sum(n_bytes) AS BIGINT) AS s FROM lv GROUP BY level, prefix),
leaf AS (SELECT lv.doc_id, lv.n_bytes, lv.prefix, lv.level, s.s,
                row_number() OVER (PARTITION BY lv.doc_id, lv.n_bytes ORDER BY lv.level) AS rn
         FROM lv JOIN s ON lv.level = s.level AND lv.prefix = s.prefix WHERE s.s <= {SHARD_BYTES})
SELECT doc_id, n_bytes, prefix AS shard, CAST(level AS INTEGER) AS depth, s AS shard_bytes FROM leaf WHERE rn = 1
UNION ALL
SELECT doc_id, n_bytes, 'x' || hex || CASE WHEN row_number() OVER (PARTITION BY hex ORDER BY n_bytes) > 1
  THEN '.' || row_number() OVER (PARTITION BY hex ORDER BY n_bytes) ELSE '' END, 128, n_bytes FROM d WHERE n_bytes > {SHARD_BYTES}
"""
