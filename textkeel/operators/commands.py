"""Commands that read a secret and send it away, as a verdict column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ANY_URL, BARE_TOOL, ENV_DUMP, GIT_PUSH, SECRET_FILE, STAGING_DEST, STAGING_TOOL, URL_TOOL
from ..functions.text import host_of, java, loopback, quoted


def hosts(column: str) -> Column:
    """Lower-cased hosts of all URLs in a command."""
    urls = f"regexp_extract_all({column}, {quoted(java(ANY_URL))}, 1)"
    return F.expr(f"filter(transform({urls}, u -> {host_of('''split(u, '[/?#]', -1)[0]''')}), h -> h <> '')")


def has_egress(column: str) -> Column:
    """Any outside host; else a tool with a bare destination; else, without URLs, a URL tool."""
    text = F.col(column)
    found = hosts(column)
    return F.when(F.exists(found, lambda h: ~loopback(h)), True).when(text.rlike(java(BARE_TOOL)), True).when(F.size(found) > 0, False).otherwise(text.rlike(java(URL_TOOL)))


def judge_commands(df: DataFrame, column: str = "command") -> DataFrame:
    """``df`` with source ('file', 'environment' or null) and reason ('network',
    'git', 'staging' or null). Null and empty commands have neither."""
    text = F.col(column)
    source = F.when(text.rlike(java(SECRET_FILE)), "file").when(text.rlike(java(ENV_DUMP)), "environment")
    df = df.withColumn("source", source)
    reason = (
        F.when(F.col("source").isNull(), F.lit(None).cast("string"))
        .when(has_egress(column), "network")
        .when(text.rlike(java(GIT_PUSH)), "git")
        .when(text.rlike(java(STAGING_TOOL)) & text.rlike(java(STAGING_DEST)), "staging")
    )
    return df.withColumn("reason", reason)


def command_gate(events: DataFrame) -> DataFrame:
    """Events (tool_name, command) with ``decision``: an ask as JSON for shell
    commands with a verdict, null (let through) for all else."""
    judged = judge_commands(events.withColumn("command", F.when(F.col("tool_name") == "Bash", F.col("command"))))
    message = F.concat(F.lit("This command reads a secret ("), F.col("source"), F.lit(") and its shape is that of exfiltration: "), F.col("reason"))
    ask = F.to_json(F.struct(F.lit("ask").alias("permissionDecision"), message.alias("permissionDecisionReason")))
    return judged.withColumn("decision", F.when(F.col("reason").isNotNull(), ask))
