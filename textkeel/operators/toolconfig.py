"""Audit of tool-server configuration JSON.

The document is walked once in Python (key order, duplicate keys and bounds are
those of a JSON object model), which yields the texts to judge; judging them is
done by the same column expressions as everywhere else.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CONFIG_BELOW, CONFIG_FILES, CREDENTIAL_BLOCKS, INDIRECT, MODEL_FACING
from ..functions.text import host_of, loopback, once, quoted
from ..shipping import ship
from .credentials import CredentialConfig, detect
from .injection import ScanConfig, scan_injection

MAX_SITES, MAX_DEPTH = 500, 32
_INDIRECT, _FACING = re.compile(INDIRECT, re.ASCII), re.compile(MODEL_FACING, re.IGNORECASE | re.ASCII)
_SITES = "path string, ord int, kind string, server string, key string, text string, n_servers int"


def is_config_path(column: str) -> Column:
    """Known file names; ``mcp_config.json`` only below two known folders; a trailing separator is a folder."""
    parts = f"filter(split(replace({column}, '\\\\', '/'), '/', -1), x -> x <> '')"
    base, parent = f"coalesce(try_element_at({parts}, -1), '')", f"coalesce(try_element_at({parts}, -2), '')"
    below, folders = CONFIG_BELOW
    listed = lambda names: ", ".join(map(quoted, names))
    named = f"{base} IN ({listed(CONFIG_FILES)}) OR {base} = {quoted(below)} AND {parent} IN ({listed(folders)})"
    return F.expr(f"coalesce({column} <> '' AND NOT {column} RLIKE '[\\\\\\\\/]\\\\s*\\\\z' AND size({parts}) > 0 AND ({named}), false)")


def _text(value) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return str(int(value)) if float(value).is_integer() and abs(value) < 1e21 else str(value)
    if isinstance(value, list):
        parts = [x for x in map(_text, value) if x is not None]
        return " ".join(parts) if parts else None
    return None


class _Walk:
    """Model-facing strings of a document, up to so many and so deep."""

    def __init__(self, max_sites: int, max_depth: int):
        self.left, self.depth, self.truncated = max(1, max_sites), max(1, max_depth), False

    def sites(self, node, depth: int = 0) -> Iterator[tuple[str, str]]:
        if self.left <= 0 or depth > self.depth:
            self.truncated = True
        elif isinstance(node, list):
            for child in node:
                yield from self.sites(child, depth + 1)
        elif isinstance(node, dict):
            for key, value in node.items():
                if not (isinstance(value, str) and _FACING.match(key)):
                    yield from self.sites(value, depth + 1)
                elif self.left <= 0:
                    self.truncated = True
                    return
                else:
                    self.left -= 1
                    yield key, value


def _reject(word: str):
    raise ValueError(f"{word} is not JSON")


def audit_sites(text: str | None, max_sites: int = MAX_SITES, max_depth: int = MAX_DEPTH) -> tuple[list[tuple], int]:
    """(kind, server, key, text) of everything to judge, and the number of servers (-1: not a configuration)."""
    try:
        doc = json.loads(text or "", parse_constant=_reject)
    except (ValueError, RecursionError):
        return [("unparseable", None, None, None)], -1
    block = next((doc[k] for k in ("mcpServers", "servers") if isinstance(doc.get(k), dict)), None) if isinstance(doc, dict) else None
    if block is None:
        return [("unrecognised", None, None, None)], -1
    out, walk = [], _Walk(max_sites, max_depth)
    for name, server in block.items():
        if not isinstance(server, dict):
            continue
        mark = len(out)
        try:
            for part in CREDENTIAL_BLOCKS:
                if isinstance(server.get(part), dict):
                    values = ((k, _text(v)) for k, v in server[part].items())
                    out += [("credential", name, f"{part}.{k}", v) for k, v in values if v is not None and not _INDIRECT.match(v)]
            args = [server["command"]] if isinstance(server.get("command"), str) else []
            if isinstance(server.get("args"), list):
                args += [x for x in map(_text, server["args"]) if x is not None and not _INDIRECT.match(x)]
            if args:
                out.append(("arguments", name, "args", " ".join(args)))
            url = next((server[k] for k in ("url", "endpoint") if isinstance(server.get(k), str)), None)
            if url:
                out.append(("transport", name, "url", url))
            out += [("description", name, key, value) for key, value in walk.sites(server)]
        except Exception:  # noqa: BLE001  one server's trouble is told and leaves the others alone
            del out[mark:]
            out.append(("not_audited", name, None, None))
    if walk.truncated:
        out.append(("truncated", None, None, None))
    return out, len(block)


def sites(configs: DataFrame, max_sites: int = MAX_SITES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """A row per text to judge of (path, content)."""
    ship(configs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found, servers = audit_sites(content, max_sites, max_depth)
                rows += [(path, i, *site, servers) for i, site in enumerate(found)] or [(path, 0, "clean", None, None, None, servers)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SITES.split(", ")])

    return configs.select("path", "content").mapInArrow(run, _SITES)


def _judged(configs: DataFrame, guard: ScanConfig = ScanConfig(), scanner: CredentialConfig = CredentialConfig(), max_sites: int = MAX_SITES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """A row per site with ``what``, its findings. Each detector sees only the kinds of sites it judges."""
    kind, nothing = F.col("kind"), F.lit(None).cast("string")
    found = sites(configs, max_sites, max_depth).withColumns({"__secret": F.when(kind.isin("credential", "arguments"), F.col("text")).otherwise(nothing), "__shown": F.when(kind == "description", F.col("text")).otherwise(nothing)})
    found = scan_injection(detect(found, "__secret", scanner), "__shown", guard)
    types = "array_join(array_distinct(transform(secrets, s -> s.type)), ' / ')"
    url = "regexp_replace(text, '^\\\\s+|\\\\s+\\\\z', '')"
    authority = f"regexp_extract({url}, '(?i)^[a-z][a-z0-9+.-]*://([^/?#]+)', 1)"
    host = F.expr(f"CASE WHEN {authority} <> '' THEN nullif({host_of(authority)}, '') END")
    found = once(found, "__host", F.when(F.col("kind") == "transport", host))
    remote = F.col("__host").isNotNull() & ~loopback(F.col("__host"))

    def one(kind: str, severity: str, detail: Column | str) -> Column:
        text = F.lit(detail) if isinstance(detail, str) else detail
        return F.array(F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), text.alias("detail")))

    kind, secret = F.col("kind"), F.size("secrets") > 0
    none = F.expr("CAST(array() AS array<struct<type:string,severity:string,detail:string>>)")
    poison = F.expr(
        "transform(filter(findings, f -> f.severity IN ('critical', 'high')), f -> named_struct('type', 'MCP Tool Poisoning', 'severity', f.severity, "
        "'detail', concat('model-facing text contains ', lower(f.type), if(f.decoded IS NULL, '', concat('; decodes to: ', substring(f.decoded, 1, 200))))))"
    )
    what = (
        F.when(kind == "unparseable", one("Unparseable MCP Config", "low", "not JSON, so not audited"))
        .when(kind == "unrecognised", one("Unrecognised MCP Config", "low", "no servers object"))
        .when(kind == "not_audited", one("MCP Server Not Audited", "low", "could not be walked; treat as unverified"))
        .when(kind == "truncated", one("MCP Scan Truncated", "medium", "deeper or larger than the bounds; parts were not audited"))
        .when((kind == "credential") & secret, one("Hardcoded Credential in MCP Config", "critical", F.concat(F.lit("literal "), F.expr(types))))
        .when((kind == "arguments") & secret, one("Hardcoded Credential in MCP Launch Arguments", "critical", F.concat(F.lit("literal "), F.expr(types))))
        .when(
            kind == "transport",
            F.concat(
                F.when(remote & F.expr(f"{url} RLIKE '(?i)^http://'"), one("MCP Cleartext Transport", "high", "plain HTTP to another host")).otherwise(none),
                F.when(remote, one("Remote MCP Server", "info", "runs on another host")).otherwise(none),
            ),
        )
        .when(kind == "description", poison)
        .otherwise(none)
    )
    return once(found, "what", what).select("path", "ord", "kind", "server", "key", "n_servers", "what")  # once: a reader that explodes it asks first if it is empty


def audit(configs: DataFrame, **options) -> DataFrame:
    """A row per finding of (path, content): path, ord, type, severity, server, key, detail.
    Values of credentials never pass. A null or empty content is unparseable; repeated
    rows give repeated findings."""
    judged = _judged(configs, **options)
    return judged.select("path", "ord", "server", "key", "n_servers", F.explode("what").alias("f")).select("path", "ord", "f.type", "f.severity", "server", "key", "f.detail", "n_servers")


def audit_files(configs: DataFrame, **options) -> DataFrame:
    """A row per file: findings in order, server_count, parsed, truncated."""
    judged = _judged(configs, **options)
    one = F.expr("transform(what, (f, i) -> struct(ord, i, f.type AS type, f.severity AS severity, server, key, f.detail AS detail))")
    out = judged.groupBy("path").agg(F.array_sort(F.flatten(F.collect_list(one))).alias("findings"), F.max("n_servers").alias("n"), F.bool_or(F.col("kind") == "truncated").alias("truncated"))
    return out.select("path", F.expr("transform(findings, f -> struct(f.ord, f.type, f.severity, f.server, f.key, f.detail))").alias("findings"), F.greatest("n", F.lit(0)).alias("server_count"), (F.col("n") >= 0).alias("parsed"), "truncated")
