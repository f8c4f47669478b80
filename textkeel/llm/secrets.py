"""Secret scans with an incremental blob ledger.

Every text version is addressed by its SHA-256. The ledger is a pair of Parquet
tables: ``seen`` (blob, rule_version) and ``findings`` (blob, rule_version, kind,
start, end). A scan anti-joins the blobs at hand with what the ledger has seen
under the same rule version, scans one copy of each blob that is left, appends,
and joins the findings back to every path (row) that holds the blob.

The scan itself is Python ``re`` in Arrow batches, a blob at a time; offsets are
code points, end exclusive. Keys of the joins are blobs, so a text with very
many copies is scanned once; its copies are light rows (id and blob) that the
findings join deals out with a salt.

Defined results: a null text is the empty blob; an empty text has no findings;
repeated rows give repeated results; a null id keeps its row; extra columns are
not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, prepare_python

SALT = 32
#: Base kinds, in their order: pattern, group that counts, least characters. ASCII only.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds: documented shapes of public key formats.
MORE = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("github_pat", r"github_pat_[A-Za-z0-9_]{22,}", 0, 33),
    ("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
    ("private_key", r"-----BEGIN (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----", 0, 20),
    ("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@", 0, 10),
    ("npm", r"npm_[A-Za-z0-9]{36}", 0, 40),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}", 0, 30),
)
KINDS = tuple(k for k, *_ in BASE + MORE)
#: What must stand in a text for a further kind to match: checked before its regex.
HINTS = {"github": "gh", "github_pat": "github_pat_", "slack": "xox", "google": "AIza", "stripe": "k_live_", "jwt": "eyJ", "private_key": "PRIVATE KEY", "url_login": "://", "npm": "npm_", "sendgrid": "SG."}
#: The version is the content of the rules.
RULE_VERSION = hashlib.sha256(repr((BASE, MORE)).encode()).hexdigest()[:16]

_COMPILED = [(k, re.compile(p, re.ASCII), group, least) for k, p, group, least in BASE + MORE]
_WORDS = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}")


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans of all kinds, by start, then kind in order."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(_COMPILED):
        if kind == "assign" and not _WORDS.search(text) or kind == "access" and "AKIA" not in text or HINTS.get(kind, "") not in text:
            continue
        if kind == "hex":  # runs of fewer than 24 fail, so only longer ones are looked for
            pattern = _HEX
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def gate(text_col: str = "text") -> Column:
    """True wherever some kind can match; JVM-side, so texts without a hint never reach Python or a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lowered = F.lower(text)
    test = text.rlike("[0-9a-f]{24}") | F.contains(text, F.lit("AKIA"))
    for hint in ("passw", "secret", "token", "apikey", "api_key"):
        test = test | F.contains(lowered, F.lit(hint))
    for hint in sorted(set(HINTS.values())):
        test = test | F.contains(text, F.lit(hint))
    return test


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs, kinds, starts, ends = [], [], [], []
        for blob, text in zip(batch.column("blob"), batch.column("text"), strict=True):
            for kind, start, end in find_secrets(text.as_py() or ""):
                blobs.append(blob.as_py())
                kinds.append(kind)
                starts.append(start)
                ends.append(end)
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["blob", "kind", "start", "end"])


class BlobLedger:
    """``seen`` and ``findings`` under one folder; append-only."""

    SEEN = "blob string, rule_version string"
    FINDINGS = "blob string, rule_version string, kind string, start long, end long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._read("seen", self.SEEN)

    def findings(self, rule_version: str) -> DataFrame:
        """Distinct, as a scan that was broken off and repeated may have appended twice."""
        return self._read("findings", self.FINDINGS).filter(F.col("rule_version") == rule_version).drop("rule_version").distinct()

    def scan(self, versions: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
        """Scan what is unseen of ``versions`` (id, text) under ``rule_version``;
        returns (id, blob) of every version. Findings are appended before
        ``seen`` is, so a scan that dies in between is repeated, not lost."""
        prepare_python(self.spark)
        scratch = Scratch(self.spark, "secrets")
        rows = versions.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        paths = scratch.save("paths", rows.select("id", "blob"))
        known = self.seen().filter(F.col("rule_version") == rule_version).select("blob")
        fresh = scratch.save("fresh", paths.groupBy("blob").agg(F.min("id").alias("id")).join(known, "blob", "left_anti"))
        # the copy with the least id is scanned; ids of null only where a blob has no other
        pick = fresh.select(F.col("blob").alias("__blob"), F.col("id").alias("__id"))
        once = rows.filter(gate()).join(pick, (F.col("blob") == F.col("__blob")) & F.col("id").eqNullSafe(F.col("__id"))).select("blob", "text")
        found = once.mapInArrow(_scan, "blob string, kind string, start long, end long")
        tag = F.lit(rule_version).alias("rule_version")
        found.select("blob", tag, "kind", "start", "end").write.mode("append").parquet(f"{self.folder}/findings")
        fresh.select("blob", tag).write.mode("append").parquet(f"{self.folder}/seen")
        return paths


def _joined(kinds: tuple[str, ...]) -> str:
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"""array_join(transform(array_sort(transform(filter(s, x -> x.kind IN ({names})),
      x -> named_struct('start', x.start, 'o', CASE x.kind {order} END, 'kind', x.kind, 'end', x.end))),
      x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"""


def secrets_of_paths(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """Join findings back to every path: id, counts of the base kinds, base_sha256, spans."""
    own = findings.groupBy("blob").agg(F.collect_list(F.struct("kind", "start", "end")).alias("s"))
    counts = {f"n_{k}": F.expr(f"CAST(size(filter(s, x -> x.kind = '{k}')) AS BIGINT)") for k, *_ in BASE}
    own = own.withColumns(counts | {"base": F.expr(_joined(tuple(k for k, *_ in BASE))), "spans": F.expr(_joined(KINDS))}).drop("s")
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = paths.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(own, ["blob", "salt"], "left")
    none = {k: F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in counts}
    return dealt.select("id", "blob", *none.values(), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    ledger = BlobLedger(spark, Scratch(spark, "ledger").root)
    paths = ledger.scan(docs)
    out = secrets_of_paths(paths, ledger.findings(RULE_VERSION))
    return out.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")
