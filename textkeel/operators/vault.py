"""Placeholders and the values they stand for.

A vault is a table (placeholder, value). Null texts hold no placeholders and are
restored as null; repeated rows give equal results; an empty vault restores nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import holds, matches, once, quoted
from .credentials import PLACEHOLDER


def entries(redacted: DataFrame) -> DataFrame:
    """(placeholder, value) of redacted rows, each once."""
    return redacted.select(F.explode("vault").alias("placeholder", "value")).dropDuplicates(["placeholder"])


def marked(redacted: DataFrame, mark: Column) -> DataFrame:
    """An ``entry`` (marked, placeholder, value) for each placeholder of redacted rows: is one of
    its rows marked. It is one column, so whatever is taken of it Catalyst reads the same: plans
    over the marked entries, over all and over their names share one exchange."""
    rows = redacted.withColumn("marked", F.coalesce(mark, F.lit(False))).select("marked", F.explode("vault").alias("placeholder", "value"))
    return rows.groupBy("placeholder").agg(F.max(F.struct("marked", "placeholder", "value")).alias("entry")).select("entry")


def upsert(vault: DataFrame, new: DataFrame) -> DataFrame:
    """``vault`` with the entries of ``new`` it lacks."""
    return vault.unionByName(new.join(vault, "placeholder", "left_anti").dropDuplicates(["placeholder"]))


def rollback(vault: DataFrame, failed: DataFrame) -> DataFrame:
    """``vault`` without the entries of ``failed``; those it lacks do not matter."""
    return vault.join(failed.select("placeholder"), "placeholder", "left_anti")


def cleared(spark: SparkSession) -> DataFrame:
    """A vault without entries."""
    return spark.createDataFrame([], "placeholder string, value string")


def placeholders(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with placeholders: the distinct ones of the text; null of a null text."""
    return once(df, "placeholders", f"array_distinct(regexp_extract_all(`{text_col}`, '{PLACEHOLDER.replace(chr(92), chr(92) * 2)}', 0))")


def restore(df: DataFrame, vault: DataFrame, key: str, text_col: str) -> DataFrame:
    """``df`` with restored_text, n_restored (instances) and n_missing; unknown
    placeholders stay. ``key`` names a row. Catalyst picks the join by the vault's size.

    Rows are dealt out by key, as the last join asks for anyway, before placeholders are looked
    for, so what made the texts is worked out once and both sides of that join read it. Rows
    whose key is null meet nothing in it and go beside it: the join would ask them of one side."""
    kind = "array<struct<placeholder:string,value:string>>"
    found = placeholders(df.filter(F.col(key).isNotNull()).repartition(key), text_col)
    wanted = found.select(key, F.explode("placeholders").alias("placeholder"))
    known = wanted.join(vault, "placeholder").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("placeholder", "value"))).alias("__known"))
    beside = placeholders(df.filter(F.col(key).isNull()), text_col).withColumn("__known", F.lit(None).cast(kind))
    out = found.join(known, key, "left").unionByName(beside).withColumn("__known", F.expr(f"coalesce(__known, CAST(array() AS {kind}))"))
    pattern = quoted(PLACEHOLDER)
    # one pass: what is put in is never looked into again
    filled = f"array_join(zip_with(split(`{text_col}`, {pattern}, -1), regexp_extract_all(`{text_col}`, {pattern}, 0), (t, p) -> concat(t, if(p IS NULL, '', coalesce(__values[p], p)))), '')"
    return (
        out.withColumn("__values", F.map_from_entries("__known"))
        .withColumns(
            {
                "restored_text": F.expr(f"if(size(__known) = 0, `{text_col}`, {filled})"),
                "n_restored": F.expr(f"if(size(__known) = 0, 0, size(filter(regexp_extract_all(`{text_col}`, {pattern}, 0), p -> map_contains_key(__values, p))))"),
                "n_missing": F.expr("size(placeholders) - size(__known)"),
            }
        )
        .drop("__known", "__values", "placeholders")
    )


def placeholder_ranges(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ranges: array of (raw, at) of every placeholder, ``at`` in UTF-16 units; none of a null text."""
    return df.withColumn("ranges", F.expr(matches(f"`{text_col}`", PLACEHOLDER, holds(f"`{text_col}`", ("{{SECRET_",)))))


def redact_one(df: DataFrame, text_col: str, value_col: str, offset_col: str, replacement_col: str) -> DataFrame:
    """Replace one value at an offset, only where the text still holds it there."""
    same = f"substring(`{text_col}`, `{offset_col}` + 1, length(`{value_col}`)) = `{value_col}`"
    return df.withColumn(text_col, F.expr(f"if({same}, overlay(`{text_col}` PLACING `{replacement_col}` FROM `{offset_col}` + 1 FOR length(`{value_col}`)), `{text_col}`)"))
