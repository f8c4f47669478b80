"""The scanners on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.credentials import redact
from ..operators.injection import scan_injection
from ..operators.vault import entries


def json_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Events, a JSON document a line, as they arrive in a folder."""
    return parsed(spark.readStream.format("text").load(folder), schema)


def parsed(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The events of JSON lines; bad, empty and null lines give null fields."""
    return lines.select(F.from_json(column, schema).alias("e")).select("e.*")


_LAST = "last string"


def _changes(key_col: str, value_col: str, ts_col: str):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values([ts_col, value_col], kind="stable")
        rows = rows[rows[value_col].notna() & (rows[value_col] != "")]
        new = rows[rows[value_col] != rows[value_col].shift(fill_value=last)]
        if len(rows):
            state.update((rows[value_col].iloc[-1],))
        yield new

    return run


def changed_only(events: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """Polled values of each key that are not the value polled before: A, B, A are three changes.
    Null and empty values are no poll. State is one value a key; rows of a micro-batch are taken in
    order of time. On a static table the same as a window."""
    rows = events.select(key, value, ts)
    if not events.isStreaming:
        before = F.lag(value).over(W.partitionBy(key).orderBy(ts, value))
        return rows.filter(F.col(value) != "").filter(F.col(value).isNotNull()).withColumn("__b", before).filter("__b IS NULL OR __b <> " + f"`{value}`").drop("__b")
    return rows.groupBy(key).applyInPandasWithState(_changes(key, value, ts), rows.schema, _LAST, "append", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, key: str, ts: str, value: str, gap: str = "500 milliseconds", delay: str = "1 minute") -> DataFrame:
    """The last value of each burst of changes of a key (of equal times, the greatest)."""
    bursts = events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap))
    return bursts.agg(F.max(F.struct(ts, value)).alias("__last"), F.count("*").alias("n_changes")).select(key, F.col("session_window.end").alias("ended"), F.col(f"__last.{value}").alias(value), "n_changes")


def once_per_session(events: DataFrame) -> DataFrame:
    """The first event of each session; state is one hash a session."""
    return events.withColumn("marker", F.expr("left(sha2(session_id, 256), 32)")).dropDuplicates(["marker"])


def counters(scanned: DataFrame) -> DataFrame:
    """Running totals (complete mode)."""
    return scanned.agg(F.count("*").alias("scans"), F.sum("n_secrets").alias("secrets"), F.count_if(F.col("n_secrets") > 0).alias("redactions"))


def scan_stream(events: DataFrame, text_col: str = "text") -> DataFrame:
    return scan_injection(events, text_col)


def vault_writer(text_path: str, vault_path: str, text_col: str = "text"):
    """A foreachBatch function: redacted rows first, then what the vault lacks, so a
    vault entry never precedes its text. A repeated batch overwrites its own part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = redact(batch, text_col)
        out.drop("vault", text_col).write.mode("overwrite").parquet(f"{text_path}/batch={batch_id}")
        entries(out).write.mode("overwrite").parquet(f"{vault_path}/batch={batch_id}")

    return write


def exit_codes(decided: DataFrame) -> DataFrame:
    """``decided`` with exit_code, as a hook process would end: 2 where the decision blocks, else 0."""
    return decided.withColumn("exit_code", F.when(F.col("decision") == "block", 2).otherwise(0))


def decision_writer(path: str):
    """A foreachBatch function: the decisions of a batch that are not silent, a JSON document a
    line. A repeated batch overwrites its own part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.filter("decision IS NOT NULL AND decision <> 'pass'").select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/batch={batch_id}")

    return write
