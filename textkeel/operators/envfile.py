"""Masking of environment files: values never pass, unparsed lines are withheld."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted

MASK = "<HIDDEN>"


def env_key_ok(key: str) -> str:
    """SQL: short enough, and not a long token of mixed letters and digits."""
    return f"(length({key}) <= 64 AND NOT (length({key}) >= 20 AND {key} RLIKE '[a-z]' AND {key} RLIKE '[A-Z]' AND {key} RLIKE '[0-9]'))"


def _closes(text: str, quote: str) -> str:
    """SQL: an unescaped quote stands in the text."""
    body = f"regexp_replace({text}, '(?s)\\\\\\\\.', '')"
    return f"contains({body}, {quote})"


def mask_env(column: str, mask: str = MASK) -> Column:
    """The masked file: every line ends in a newline; a quoted value that goes on hides the lines up to its end."""
    assign = quoted(r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_.-]*)\s*=(.*)\z")
    comment = quoted(r"^(\s*#+\s*)((?:export\s+)?[A-Za-z_][A-Za-z0-9_.-]*)(\s*=\s*)(\S.*)\z")
    trimmed = "regexp_replace(l, '^\\\\s+|\\\\s+\\\\z', '')"
    key, value = f"regexp_extract({trimmed}, {assign}, 1)", f"regexp_replace(regexp_extract({trimmed}, {assign}, 2), '^\\\\s+|\\\\s+\\\\z', '')"
    ckey = f"regexp_replace(regexp_extract(l, {comment}, 2), '^export\\\\s+', '')"
    masked_comment = f"""CASE WHEN NOT l RLIKE {comment} THEN l WHEN NOT {env_key_ok(ckey)} THEN '# {mask} (unparsed comment withheld)'
      ELSE concat(regexp_extract(l, {comment}, 1), regexp_extract(l, {comment}, 2), '={mask}') END"""
    parsed = f"({trimmed} RLIKE {assign} AND {env_key_ok(key)})"
    opens = f"CASE WHEN {parsed} AND NOT startswith({trimmed}, '#') AND substring({value}, 1, 1) IN ('\"', '\\'', '`') AND NOT {_closes(f'substring({value}, 2)', f'substring({value}, 1, 1)')} THEN substring({value}, 1, 1) END"
    line = f"CASE WHEN {trimmed} = '' THEN l WHEN startswith({trimmed}, '#') THEN {masked_comment} WHEN {parsed} THEN concat({key}, '={mask}') ELSE '# {mask} (unparsed line withheld)' END"
    return F.expr(
        f"""aggregate(split({column}, '\\\\r?\\\\n', -1), named_struct('open', CAST(NULL AS STRING), 'out', CAST(array() AS array<string>)),
      (a, l) -> CASE WHEN a.open IS NOT NULL THEN named_struct('open', if({_closes('l', 'a.open')}, NULL, a.open), 'out', a.out)
                ELSE named_struct('open', {opens}, 'out', array_append(a.out, concat({line}, '\\n'))) END,
      a -> array_join(a.out, ''))"""
    )


UNREAD, UNVERIFIED = "# could not be read\n", "# {mask} (could not be verified as safe to share)\n"


def mask_env_files(files: DataFrame, redact=None, mask: str = MASK) -> DataFrame:
    """(path, content) files as one text a folder, in path order with a header each.

    A null content is an error line. ``redact``, a function of a DataFrame and column, is run
    over each masked file as a last check; a file it has no answer for is withheld. A folder's
    environment files are few, which bounds a text; repeated rows are repeated; no files, no rows."""
    body = F.when(F.col("content").isNull(), F.lit(UNREAD)).otherwise(mask_env("content", mask))
    masked = files.select("path", body.alias("masked"))
    if redact is not None:
        checked = F.regexp_replace("redacted_text", r"\{\{SECRET_[a-z0-9]+\}\}", mask)
        masked = redact(masked, "masked").select("path", F.coalesce(checked, F.lit(UNVERIFIED.format(mask=mask))).alias("masked"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    parts = F.array_sort(F.collect_list(F.struct("path", F.concat(F.lit("# --- "), "path", F.lit(" ---\n"), "masked").alias("t"))))
    return masked.groupBy(folder.alias("folder")).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("masked"))
