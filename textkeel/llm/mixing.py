"""Mixing sources to target weights, in DataFrame functions only.

Each row gets a hash-random key. Rows are ordered by that key within their
source by fixed key ranges (the keys are uniform, so equal ranges are balanced
and need no sampling): sums per (source, range) give each range its offset, and
a running sum inside the range completes the prefix sum. No task ever holds a
whole source. The budget of a source is cut exactly, in words: whole epochs
first, then the rows whose prefix lies below the rest, the last one in part.

Defined results: a null or empty text weighs 0 words and takes 0; a null source
is a source of its own, the last; a null id hashes as the empty string; repeated
rows are rows of their own (rows that agree in id and size are
interchangeable); an empty table gives an empty result. Columns called size,
source_size, target or taken are replaced; all others travel in a struct, so their
names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
RANGE_DIGITS = 3  # hex digits of the key that number a range: 4096 a source
_MADE = ("size", "source_size", "target", "taken")


def n_words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Per source its target: shares of the total by weight, none above ``cap``
    times its size, the excess dealt again by weight until none is above.

    Filling by ascending cap/weight finds the same shares in one ordered pass.
    The table has one row a source.
    """
    ranked = source_sizes.withColumn("__n", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("__n") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("__w", w).withColumn("__cap", F.col("source_size") * cap)
    fill = W.orderBy(F.col("__cap") / F.col("__w"), "__n")
    below, every = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    d = lambda c: c.cast("double")
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(below), F.lit(0))
    free = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(below), F.lit(0))
    full = ranked.withColumn("__full", d(left) * d(F.col("__w")) >= d(F.col("__cap")) * d(free))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(every), F.lit(0))
    pull = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(every)
    return full.withColumn("target", F.when(F.col("__full"), d(F.col("__cap"))).otherwise(d(rest) * d(F.col("__w")) / d(pull))).drop("__n", "__w", "__cap", "__full")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = True, write_sizes: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words, repeats counted);
    unless ``keep_text``, without the text, which is then read once, for its size, as
    sizes are written down (not if ``write_sizes`` is false, as where rows are large)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keep = [c for c in docs.columns if c not in _MADE and (keep_text or c != text_col)]
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    own = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("__own")
    # never null, so windows and joins by it share one partitioning
    named = F.coalesce(F.concat(F.lit("v"), F.col(source_col).cast("string")), F.lit("n"))
    rows = docs.select(own, F.col(id_col).alias("__id"), named.alias("__source"), n_words(text_col).alias("__size"), key.alias("__key"))
    if write_sizes and not keep_text:
        rows = scratch.save("sizes", rows)
    part = F.substring("__key", 1, RANGE_DIGITS)
    rows = rows.withColumn("__range", part)
    ranges = scratch.save("ranges", rows.groupBy("__source", "__range").agg(F.sum("__size").alias("__sum")))
    sizes = ranges.groupBy("__source").agg(F.sum("__sum").alias("source_size")).withColumn("source", F.expr("if(startswith(__source, 'v'), substring(__source, 2), NULL)"))
    goal = scratch.save("targets", targets(sizes, weights, cap).drop("source"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy("__source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.withColumn("__offset", before).join(goal, "__source").select("__source", "__range", "__offset", "source_size", "target")
    inside = W.partitionBy("__source", "__range").orderBy("__key", "__id", "__size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    rows = rows.join(offsets, ["__source", "__range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__offset") - F.col("__in")))
    taken = (epochs * F.col("__size") + part).cast("long").alias("taken")
    return rows.select(*[F.col(f"__own.`{c}`").alias(c) for c in keep], F.col("__size").alias("size"), "source_size", "target", taken)


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in whole documents: a row per copy; of the one document
    a source's budget cuts, the copy stays if at least half of it is inside."""
    columns = docs.columns
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias("row"), "doc_id", "source", "text")
    mixed = mix_sources(packed, keep_text=False, write_sizes=False, **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    mixed = mixed.select("row", copies.alias("copies")).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken", "source")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, n % 3 + 1 AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0) AS lft,
             sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS free
      FROM w WINDOW below AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CAST(lft AS DOUBLE) * w >= CAST(cap AS DOUBLE) * free AS is_full FROM f),
t AS (SELECT source, source_size,
             CASE WHEN is_full THEN CAST(cap AS DOUBLE)
                  ELSE CAST(sum(source_size) OVER () - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS DOUBLE) * w
                       / CAST(sum(w) FILTER (NOT is_full) OVER () AS DOUBLE) END AS target FROM g),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""
