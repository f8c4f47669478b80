"""Reports over findings.

Every report has a defined result for no rows (counts of 0, no files); repeated rows count
as often as they stand, but for values and types, which are told once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_file_secrets(redacted: DataFrame, path: str = "path") -> DataFrame:
    """file, count of distinct values, distinct types; files without secrets are left out."""
    hit = redacted.filter("n_secrets > 0").select(path, F.explode("vault").alias("p", "v"), "detected_types")
    return hit.groupBy(F.col(path).alias("file")).agg(F.count_distinct("p").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("detected_types")))).alias("types"))  # sets of a file's types


def per_file_injection(findings: DataFrame, path: str = "path") -> DataFrame:
    """file, count, distinct types, criticals."""
    return findings.groupBy(F.col(path).alias("file")).agg(F.count("*").alias("count"), F.array_sort(F.collect_set("type")).alias("types"), F.count_if(F.col("severity") == "critical").alias("critical"))


def actionable(config_findings: DataFrame) -> DataFrame:
    """Configuration findings without the informational ones, per file."""
    return per_file_injection(config_findings.filter("severity <> 'info'"))


def totals(report: DataFrame) -> DataFrame:
    """One row: files, total count, all types in order, and criticals where the report has them."""
    rows = report.select("*", F.posexplode_outer("types").alias("i", "t"))
    once = lambda c: F.coalesce(F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, c)), F.lit(0))
    critical = [once(F.col("critical")).alias("critical")] if "critical" in report.columns else []
    return rows.agg(once(F.lit(1)).alias("files"), once(F.col("count")).alias("total"), F.array_sort(F.collect_set("t")).alias("types"), *critical)


def first_summary(redacted: DataFrame) -> DataFrame:
    """One row: secrets in all, and files with any."""
    return redacted.agg(F.coalesce(F.sum("n_secrets"), F.lit(0)).alias("secrets"), F.count_if(F.col("n_secrets") > 0).alias("files"))


def top_files(report: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` files by count, then name, and how many more there are."""
    over = report.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return report.orderBy(F.desc("count"), "file").limit(n).withColumn("more", over.scalar())


def dashboard(report: DataFrame, n: int = 8) -> DataFrame:
    """The view of ``top_files``: a row per line, file names escaped, and a last line where there are more."""
    top = top_files(report, n)
    lines = top.select(F.row_number().over(W.orderBy(F.desc("count"), "file")).alias("line"), html_escaped("file").alias("name"), F.col("count").cast("string").alias("badge"))
    more = top.filter("more > 0").select(F.lit(n + 1).alias("line"), F.concat(F.lit("+"), F.col("more").cast("string"), F.lit(" more files")).alias("name"), F.lit("").alias("badge")).distinct()
    return lines.unionAll(more)


def session_counters(redacted: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: scans, secrets found, texts redacted, injection findings and the critical ones."""
    a = redacted.agg(F.count("*").alias("scans"), F.coalesce(F.sum("n_secrets"), F.lit(0)).alias("secrets_found"), F.count_if(F.col("n_secrets") > 0).alias("redactions"))
    b = findings.agg(F.count("*").alias("injections"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return a.crossJoin(b)  # a row each, so the texts are scanned once


def rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Subtotals over the keys, from right to left."""
    return findings.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def html_escaped(column: str):
    """The column with & < > and quotes as entities; null stays null."""
    out = F.col(column)
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out
