"""A corpus pipeline of five operators; each stage takes documents and returns them.

Stages take (spark, docs, sf_dir). All but the last return the columns of
``documents``; the last adds the shard of each. What a stage returns is written as
Parquet and read again as the next one's input. The first stages tell rows apart by
their place in packed shards, so null and repeated ids are safe, and the columns a
stage does not look at travel inside the shards, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkeel.llm.decontam import build_index, search_index
from textkeel.llm.jaccard import jaccard_classes
from textkeel.llm.mixing import mixed_copies
from textkeel.llm.perplexity import score_shards
from textkeel.llm.scratch import Scratch, partitions_for
from textkeel.llm.sharding import extendible_shards
from textkeel.llm.shards import Shards

SHARD_BYTES = 1 << 20
USED = ("doc_id", "text", "lang", "source")
#: The rows of run() are not expressible in SQL (perplexity model, random mix).
ORACLE_SQL = None


def _pack(docs: DataFrame) -> DataFrame:
    """The columns in use, and all others in one struct."""
    return docs.select(*USED, F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in USED]).alias("__rest"))


def _unpack(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*[F.col(c) if c in USED else F.col(f"__rest.`{c}`").alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; there are none without words left."""
    scratch = Scratch(spark, "quality")
    shards = Shards(docs, scratch)
    verdicts = score_shards(shards, scratch, ("lang",))
    return shards.take(verdicts.filter("kept").select("shard", "pos"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity the smallest doc_id stays (of repeats of
    it, one; null comes last); documents without words are in no group and stay."""
    scratch = Scratch(spark, "near_duplicates")
    shards = Shards(docs, scratch)
    rows = jaccard_classes(shards, scratch, partitions_for(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "shard", "pos")).alias("first")
    stay = rows.filter("root IS NOT NULL").groupBy("root").agg(first).select("first.shard", "first.pos")
    return shards.take(stay.unionAll(rows.filter("root IS NULL").select("shard", "pos")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go: one whole item in a
    training text is a leak, though the operator's own verdict asks for two."""
    scratch = Scratch(spark, "decontaminate")
    shards = Shards(docs, scratch)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = search_index(build_index(shards, scratch), items, scratch)
    scratch.drop("index")
    return shards.take(found.filter("n_items = 0").select("shard", "pos"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, in whole documents, repeated where a target asks for it."""
    return _unpack(mixed_copies(_pack(docs)), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard; no shard is over the limit."""
    return extendible_shards(docs, SHARD_BYTES)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before has written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(f"stage{k}", stage(spark, docs, sf_dir))
    return docs
