"""Text files as rows: path, content."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import CODE_EXTENSIONS, ENV_EXCLUDED, EXCLUDED, PROSE_EXTENSIONS, RULE_FILES
from ..operators.shield import glob_regex
from ..shipping import ship


def _any(path: Column, globs) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def scannable(path: str) -> Column:
    """Code, prose and rule files outside of build and dependency folders."""
    p = F.col(path)
    kinds = [f"**/*.{e}" for e in CODE_EXTENSIONS + PROSE_EXTENSIONS] + [f"**/{x}" for x in RULE_FILES]
    return _any(p, kinds) & ~_any(p, EXCLUDED)


def is_env_file(path: str) -> Column:
    p = F.col(path)
    return _any(p, ("**/.env", "**/.env.*")) & ~_any(p, ENV_EXCLUDED)


def _hidden(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of files whose names begin with a dot or underscore, which
    Spark's listing leaves out. Names are listed by the driver, contents read by tasks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    walk, names = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while walk.hasNext():
        one = walk.next().getPath()
        if one.getName()[:1] in "._":
            names.append((one.toString(),))
    ship(spark)

    def read(batches):
        for batch in batches:
            paths, bodies = batch.column("path"), []
            for uri in paths.to_pylist():
                try:
                    where, name = fs.FileSystem.from_uri(uri)
                    with where.open_input_stream(name) as f:
                        bodies.append(f.read())
                except (OSError, pa.ArrowInvalid):  # unreadable files are skipped, with a null content
                    bodies.append(None)
            yield pa.RecordBatch.from_arrays([paths, pa.array(bodies, pa.binary())], names=["path", "content"])

    listed = spark.createDataFrame(names, "path string")
    return listed.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")).mapInArrow(read, "path string, content binary")


def read_texts(spark: SparkSession, folder: str, keep=scannable) -> DataFrame:
    """Files below ``folder`` that ``keep`` accepts; bytes that are not UTF-8 give a
    null content. The path filter runs before contents are read into rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(folder)
    files = files.select("path", "content").filter(keep("path")).union(_hidden(spark, folder).filter(keep("path")))
    return files.select("path", F.expr("try_validate_utf8(CAST(content AS STRING))").alias("content"))


def sample(files: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` files by path: a quick look, not a scan."""
    return files.orderBy("path").limit(n)


def env_files(spark: SparkSession, folder: str) -> DataFrame:
    return read_texts(spark, folder, is_env_file)
