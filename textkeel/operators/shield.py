"""Exclusion lists for assistants: which files they cover, and the files that carry them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import COVERAGE, DENY_RULES, IGNORE_FILES, SETTINGS_FILE, SHIELD_GLOBS
from ..functions.text import quoted
from ..shipping import ship

BEGIN, END = "# >>> shield >>>", "# <<< shield <<<"


def glob_regex(glob: str) -> str:
    """``**/`` is any folders, ``*`` stays in a segment, all else is literal."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".+()[]{}^$|?\\" else glob[i]), i + 1
    return f"^{out}\\z"


def exposed(files: DataFrame, path: str = "path", globs: tuple[str, ...] = SHIELD_GLOBS) -> DataFrame:
    """``files`` with ``covered``: the last glob that matches decides; ! takes back."""
    covered = F.lit(False)
    clean = F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "^/+", "")
    for g in globs:
        covered = F.when(clean.rlike(glob_regex(g.removeprefix("!"))), F.lit(not g.startswith("!"))).otherwise(covered)
    return files.withColumn("covered", F.coalesce(covered, F.lit(False)))


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The lists as tables of fixed size: patterns, ignore_files, deny_rules, coverage."""
    one = lambda rows, name: spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"ord int, {name} string")
    return {
        "patterns": one(SHIELD_GLOBS, "pattern"),
        "ignore_files": one(IGNORE_FILES, "file"),
        "deny_rules": one(DENY_RULES, "rule"),
        "coverage": spark.createDataFrame(list(COVERAGE), "tool string, file string, blocks_indexing boolean, terminal_bypass boolean"),
    }


_BLOCK = "\n".join([BEGIN, *SHIELD_GLOBS, END])
_BLOCK_RE = "(?s)\\n?" + BEGIN.replace(" ", "\\x20") + ".*?" + END.replace(" ", "\\x20") + "\\n?"


def with_block(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The block appended, once; a null file becomes the block."""
    t = f"`{text_col}`"
    body = f"CASE WHEN {t} IS NULL OR {t} = '' THEN {quoted(_BLOCK + chr(10))} WHEN contains({t}, {quoted(BEGIN)}) THEN {t} ELSE concat(rtrim('\\n', {t}), '\\n\\n', {quoted(_BLOCK + chr(10))}) END"
    return df.withColumns({"has_block": F.expr(f"coalesce(contains({t}, {quoted(BEGIN)}), false)"), text_col: F.expr(body)})


def without_block(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All blocks taken out; a null text stays null."""
    return df.withColumn(text_col, F.regexp_replace(text_col, _BLOCK_RE, ""))


def _merge(text: str | None, remove: bool) -> tuple[str | None, list[str] | None, bool]:
    """(whole document, deny list, changed) of one settings file; see ``merge_deny``."""
    try:
        doc = json.loads(text) if text and text.strip() else {}
    except ValueError:
        return text, None, False
    if not isinstance(doc, dict) or text is None and remove:
        return text, None, False
    permissions = doc["permissions"] if isinstance(doc.get("permissions"), dict) else {}
    now = permissions["deny"] if isinstance(permissions.get("deny"), list) else []
    now = [r for r in now if isinstance(r, str)]
    after = [r for r in now if r not in DENY_RULES] + ([] if remove else list(DENY_RULES))
    if now == after:
        return text, now, False
    doc["permissions"] = permissions | {"deny": after}
    return json.dumps(doc, indent=2, ensure_ascii=False) + "\n", after, True


def merge_deny(settings: DataFrame, column: str = "settings", remove: bool = False) -> DataFrame:
    """``settings`` with ``merged`` (the whole document after adding or taking out our rules;
    all else in it stays, theirs keep their order and repeats), ``deny`` and ``changed``.

    A document that does not parse, or is no object, stays as it is, with a null ``deny``;
    an empty or null one counts as without settings (nothing is taken out of a null one).
    Of repeated keys the last counts. Files are few and small, so they are parsed in Python."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_merge(t, remove) for t in texts], columns=["merged", "deny", "changed"])

    ship(settings.sparkSession)
    merge = F.pandas_udf(run, "merged string, deny array<string>, changed boolean")
    out = settings.withColumn("__m", merge(F.col(column)))
    return out.withColumns({"merged": F.col("__m.merged"), "deny": F.col("__m.deny"), "changed": F.col("__m.changed")}).drop("__m")


def deny_json() -> str:
    return json.dumps({"permissions": {"deny": list(DENY_RULES)}})


def _write(where: fs.FileSystem, path: str, text: str) -> None:
    """Under another name first, then renamed, so readers see the old file or the new one."""
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(f"{path}.tmp") as out:
        out.write(text.encode())
    where.move(f"{path}.tmp", path)


def _read(where: fs.FileSystem, path: str) -> str | None:
    if where.get_file_info(path).type != fs.FileType.File:
        return None
    with where.open_input_stream(path) as f:
        return f.read().decode(errors="replace")


def shield_folder(folder: str, enable: bool = True) -> list[str]:
    """Put the block into (or take it out of) a folder's ignore files and our rules into its
    settings; returns the files that changed. A fixed few small files, so the driver writes them.

    Files that are not there are made when enabling and left alone when not; a block that
    stands there already, and settings that do not parse, stay as they are."""
    where, root = fs.FileSystem.from_uri(folder)
    changed = []
    for name in IGNORE_FILES:
        path = f"{root}/{name}"
        before = _read(where, path)
        if enable:
            after = before if before is not None and BEGIN in before else f"{before or ''}\n{_BLOCK}\n"
        else:
            after = before if before is None else re.sub(_BLOCK_RE.replace("\\x20", " "), "", before)
        if after != before:
            _write(where, path, after)
            changed.append(name)
    path = f"{root}/{SETTINGS_FILE}"
    merged, _, new = _merge(_read(where, path), not enable)
    if new:
        _write(where, path, merged)
        changed.append(SETTINGS_FILE)
    return changed


def is_shielded(folder: str) -> bool:
    """Does any ignore file hold the block, or the settings our first rule?"""
    where, root = fs.FileSystem.from_uri(folder)
    return any(BEGIN in (_read(where, f"{root}/{name}") or "") for name in IGNORE_FILES) or DENY_RULES[0] in (_read(where, f"{root}/{SETTINGS_FILE}") or "")
